"""SimHash near-duplicates over a Gray-order hierarchical index (operator 2).

1. Every text gets a 128-bit SimHash of its distinct lower-case words, in one
   Arrow pass; equal fingerprints collapse to their smallest ``doc_id`` with a
   partially aggregated ``groupBy``.
2. The Hamming join is spread over the cluster by blocks of bits that cover the
   fingerprint (``cover``), each with a radius: two fingerprints within the
   threshold are within the radius in one of them at least, as more differences in
   all blocks would add up to more. So no pair is missed. The number of fingerprints
   only decides how many blocks there are and by how many first bits each is split
   into shards.
3. In a shard the fingerprints are grouped by their block and sorted by Gray
   rank, and a hierarchical index is laid over them: the group's nodes hold the
   bits besides the block's that all their members share. A query goes to the
   groups within the radius of its own block. It descends with the
   differences accumulated so far and drops a node, with all that is under it,
   once they exceed the threshold; a node whose members must all be within it
   is taken whole.
4. The matches of a shard are reduced to a spanning forest, so that a group of
   n copies yields n - 1 edges. Few edges are merged in one task; more by rounds of
   minimum-label contraction, each cut from the lineage in the shared folder.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _bytes as B
from ._spark import BROADCAST_BYTES, bounded, cut, small

BITS = 128
#: Documents whose fingerprints differ in at most this many of 128 bits are near duplicates.
MAX_DISTANCE = 16
#: Fingerprints in a shard, about; a block with more is split by its first bits.
SHARD_ROWS = 600_000
_U = np.uint64
_ONES = _U(0xFFFFFFFFFFFFFFFF)
#: Bits of a block that are looked up at most, and what a lookup costs in compared fingerprints, about.
KEY_BITS, LOOKUP = 30, 8
#: Query-node pairs compared at once in a shard.
_FRONTIER = 1 << 14
#: Matches of a shard that are held until they are reduced to a forest.
_MATCHES = 1 << 20
_FAN = (64, 8)


def fingerprints(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(n x 2 uint64 fingerprints, words per row) of a string array. Rows without words get zeros."""
    hashes, rows = B.word_hashes(column)
    n = len(column)
    counts = np.bincount(rows, minlength=n)
    hashes, rows = B.distinct_per_row(hashes, rows)
    out = np.zeros((n, 2), _U)
    if not len(hashes):
        return out, counts
    # 16-bit counters, four to a lane; a run of at most 2**15 words can't overflow them.
    rank = np.arange(len(rows)) - np.searchsorted(rows, rows)
    begins = np.flatnonzero((rank % (1 << 15)) == 0)
    owner = rows[begins]
    first = np.searchsorted(owner, np.arange(n))
    present = np.flatnonzero(np.bincount(owner, minlength=n))
    distinct = np.bincount(rows, minlength=n)[present]
    lane = _U(0x0001000100010001)
    for half in range(2):
        h = B.mix(hashes, 40 + half)
        for shift in range(16):
            sums = np.add.reduceat((h >> _U(shift)) & lane, begins)
            parts = (sums[:, None] >> (_U(16) * np.arange(4, dtype=_U))) & _U(0xFFFF)
            totals = np.add.reduceat(parts.astype(np.int64), first[present], axis=0)
            bits = (2 * totals > distinct[:, None]).astype(_U)
            out[present, half] |= (bits << (_U(16) * np.arange(4, dtype=_U) + _U(shift))).sum(axis=1, dtype=_U)
    return out, counts


def _fingerprint_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for piece in B.pieces(batches):
        prints, counts = fingerprints(piece.column("text"))
        has = counts > 0
        yield pa.RecordBatch.from_arrays(
            [piece.column("doc_id").filter(pa.array(has)), pa.array(prints[has, 0].view(np.int64)), pa.array(prints[has, 1].view(np.int64))],
            names=["doc_id", "f0", "f1"],
        )


def document_fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id, f0, f1`` of every text with at least one word and a doc_id."""
    return bounded(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id IS NOT NULL AND text IS NOT NULL").mapInArrow(_fingerprint_batches, "doc_id long, f0 long, f1 long")


def _ball(width: int, radius: int) -> int:
    return sum(math.comb(width, k) for k in range(radius + 1))


def _masks(width: int, radius: int) -> list[int]:
    """All differences of at most ``radius`` of ``width`` bits, none first."""
    return [sum(1 << k for k in bits) for n in range(radius + 1) for bits in itertools.combinations(range(width), n)]


def cover(count: int, max_distance: int = MAX_DISTANCE) -> list[tuple[list[int], int]]:
    """Blocks of bit positions, each with a radius: fingerprints within ``max_distance`` are within the radius in one of the blocks.

    If they weren't, each block had radius + 1 differences, and these add up to
    max_distance + 1. Of all such covers in even blocks it is the one that costs least
    on ``count`` random fingerprints; few wide blocks serve many fingerprints.
    """
    differences = min(max_distance, BITS) + 1
    order = np.random.default_rng(20).permutation(BITS)

    def of(blocks: int) -> list[tuple[list[int], int]]:
        radius, more = divmod(differences - blocks, blocks)
        return [(sorted(own[:KEY_BITS].tolist()), radius + int(k < more)) for k, own in enumerate(np.array_split(order, blocks))]

    def cost(blocks: list[tuple[list[int], int]]) -> float:
        return sum(_ball(len(own), radius) * (LOOKUP + count / 2 ** len(own)) for own, radius in blocks)

    return min((of(blocks) for blocks in range(1, min(differences, BITS) + 1)), key=cost)


def plan_bands(count: int, max_distance: int = MAX_DISTANCE) -> tuple[int, int]:
    """(width, bands): the cover for ``count`` as bit samples, one for every choice of bits that a block leaves out; the width is that of the narrowest."""
    blocks = cover(count, max_distance)
    return min(len(own) - radius for own, radius in blocks), sum(math.comb(len(own), radius) for own, radius in blocks)


def prefix_bits(count: int, blocks: list[tuple[list[int], int]], rows: int) -> int:
    """By how many of its first bits each block is split, so that a shard has about ``rows`` of ``count`` fingerprints, its own and its guests."""
    most, radius = min(len(own) for own, _ in blocks), max(r for _, r in blocks)
    return next((b for b in range(most) if count * (1 + _ball(b, radius)) / 2 <= rows << b), most)


def _block_keys(prints: np.ndarray, own: list[int]) -> np.ndarray:
    """The bits of a block, its first position highest."""
    out = np.zeros(len(prints), np.int64)
    for p in own:
        out = (out << 1) | ((prints[:, p // 64] >> _U(p % 64)) & _U(1)).astype(np.int64)
    return out


def _shard_rows(batches: Iterator[pa.RecordBatch], blocks: list[tuple[list[int], int]], prefix: int) -> Iterator[pa.RecordBatch]:
    """Each fingerprint for the shard of its first bits in every block, and as a guest for the lower ones within the radius, whose own fingerprints look it up."""
    for batch in batches:
        prints = np.stack([batch.column(c).to_numpy().view(_U) for c in ("f0", "f1")], axis=1)
        for k, (own, radius) in enumerate(blocks):
            first = _block_keys(prints, own) >> (len(own) - prefix)
            rows, shards = [np.arange(len(prints))], [first]
            for mask in _masks(prefix, radius)[1:]:
                guests = np.flatnonzero(first ^ mask < first)
                rows.append(guests)
                shards.append(first[guests] ^ mask)
            out = batch.select(["doc_id", "f0", "f1"]).take(pa.array(np.concatenate(rows)))
            yield pa.RecordBatch.from_arrays([pa.array((k << prefix) | np.concatenate(shards)), *out.columns], names=["shard", "doc_id", "f0", "f1"])


def _gray_rank(words: np.ndarray) -> np.ndarray:
    """Position of each bit string (n x k uint64, high word first) in the reflected Gray sequence: the prefix xor of its bits."""
    out = words.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        out ^= out >> _U(shift)
    for k in range(1, out.shape[1]):
        out[:, k] ^= np.where(out[:, k - 1] & _U(1), _ONES, _U(0))
    return out


def _distance(a: np.ndarray, b: np.ndarray, mask: np.ndarray) -> np.ndarray:
    return np.bitwise_count((a ^ b) & mask).sum(axis=1, dtype=np.int32)


def _ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for each pair, one after another."""
    total = int(counts.sum())
    return np.repeat(starts - np.concatenate(([0], np.cumsum(counts)[:-1])), counts) + np.arange(total)


class GrayIndex:
    """Nodes over fingerprints that are sorted by (group, Gray rank): for each group blocks of 64, under these blocks of 8, under these the leaves.

    A node has the ``shared`` mask of bits on which all its members agree and
    that no node above it has taken, and the common ``pattern`` of those bits.
    """

    def __init__(self, prints: np.ndarray, group_starts: np.ndarray, taken: np.ndarray):
        self.prints = prints
        n = len(prints)
        group_ends = np.append(group_starts[1:], n)
        self.levels = []
        above = taken
        lows, highs = group_starts, group_ends
        for fan in _FAN:
            per = -(-(highs - lows) // fan)
            first = np.concatenate(([0], np.cumsum(per)[:-1])).astype(np.int64)
            parent = np.repeat(np.arange(len(lows)), per)
            start = lows[parent] + (np.arange(len(parent)) - first[parent]) * fan
            stop = np.minimum(start + fan, highs[parent])
            every, some = np.bitwise_and.reduceat(prints, start, axis=0), np.bitwise_or.reduceat(prints, start, axis=0)
            agreed = ~(every ^ some)
            self.levels.append({"first": first, "count": per, "start": start, "stop": stop, "shared": agreed & ~above[parent], "pattern": every, "free": BITS - np.bitwise_count(agreed).sum(axis=1, dtype=np.int32), "covered": agreed | above[parent]})
            above, lows, highs = agreed | above[parent], start, stop

    def self_join(self, groups: np.ndarray, max_distance: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Index pairs that connect all fingerprints of a group within ``max_distance`` of each other; ``groups`` has the group of each row."""
        yield from self.join(np.arange(len(self.prints)), groups, 0, max_distance)

    def join(self, queries: np.ndarray, groups: np.ndarray, spent: int, max_distance: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Index pairs that connect each row of ``queries`` with those after it in the group beside it in ``groups``, within ``max_distance``; ``spent`` of it in the bits that were taken before."""
        n = len(queries)
        top, low = self.levels
        p0, p1 = np.ascontiguousarray(self.prints[:, 0]), np.ascontiguousarray(self.prints[:, 1])
        tops = top["count"][groups]
        at = 0
        ends = np.cumsum(tops)
        while at < n:
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + _FRONTIER, side="right")))
            q = np.repeat(queries[at:to], tops[at:to])
            node = _ranges(top["first"][groups[at:to]], tops[at:to])
            at = to
            keep = top["stop"][node] > q + 1
            q, node = q[keep], node[keep]
            acc = spent + _distance(self.prints[q], top["pattern"][node], top["shared"][node])
            keep = acc <= max_distance
            q, node, acc = q[keep], node[keep], acc[keep]
            count = low["count"][node]
            q, acc = np.repeat(q, count), np.repeat(acc, count)
            node = _ranges(low["first"][node], count)
            keep = low["stop"][node] > q + 1
            q, node, acc = q[keep], node[keep], acc[keep]
            acc = acc + _distance(self.prints[q], low["pattern"][node], low["shared"][node])
            keep = acc <= max_distance
            q, node, acc = q[keep], node[keep], acc[keep]
            whole = acc + low["free"][node] <= max_distance
            inside = low["start"][node[whole]]
            size = low["stop"][node[whole]] - inside
            yield np.repeat(q[whole], size), _ranges(inside, size)
            q, node = q[~whole], node[~whole]
            size = low["stop"][node] - low["start"][node]
            leaf = _ranges(low["start"][node], size)
            q = np.repeat(q, size)
            near = np.flatnonzero((np.bitwise_count(p0[q] ^ p0[leaf]) <= max_distance) & (leaf > q))
            q, leaf = q[near], leaf[near]
            near = np.bitwise_count(p0[q] ^ p0[leaf]) + np.bitwise_count(p1[q] ^ p1[leaf]) <= max_distance
            yield q[near], leaf[near]


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index of each node's component, by hooking and pointer jumping on whole arrays."""
    label = np.arange(n)
    while len(a):
        la, lb = label[a], label[b]
        differ = la != lb
        if not differ.any():
            break
        a, b, la, lb = a[differ], b[differ], la[differ], lb[differ]
        np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
        while True:
            jumped = label[label]
            if (jumped == label).all():
                break
            label = jumped
    return label


def _shard_edges(rows: pa.Table, blocks: list[tuple[list[int], int]], prefix: int, max_distance: int) -> pa.Table:
    """``a, b``: a spanning forest of what the own fingerprints of one shard match, there and among the guests."""
    shard = rows.column("shard")[0].as_py()
    own, radius = blocks[shard >> prefix]
    ids = rows.column("doc_id").to_numpy()
    prints = np.stack([rows.column("f0").to_numpy().view(_U), rows.column("f1").to_numpy().view(_U)], axis=1)
    keys, rank = _block_keys(prints, own), _gray_rank(prints)
    order = np.lexsort((rank[:, 1], rank[:, 0], keys))
    keys, ids, prints = keys[order], ids[order], np.ascontiguousarray(prints[order])
    starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    names, sizes = keys[starts], np.diff(np.append(starts, len(keys)))
    taken = np.zeros(2, _U)
    for p in own:
        taken[p // 64] |= _U(1) << _U(p % 64)
    index = GrayIndex(prints, starts, np.repeat(taken[None], len(starts), axis=0))
    label, held, count = np.arange(len(ids)), [], 0

    def reduced() -> np.ndarray:
        pairs = [*held, (np.arange(len(ids)), label)]
        return forest(len(ids), np.concatenate([a for a, _ in pairs]), np.concatenate([b for _, b in pairs]))

    residents = np.flatnonzero(names >> (len(own) - prefix) == shard & ((1 << prefix) - 1))
    for mask in _masks(len(own), radius):
        # of two groups the lower one looks up the other, which comes later
        sought = names[residents] ^ mask
        met = np.minimum(np.searchsorted(names, sought), len(names) - 1)
        found = (sought >= names[residents]) & (names[met] == sought)
        asking, met = residents[found], met[found]
        queries = _ranges(starts[asking], sizes[asking])
        for a, b in index.join(queries, np.repeat(met, sizes[asking]), mask.bit_count(), max_distance):
            if len(a):
                held.append((a, b))
                count += len(a)
                if count > _MATCHES:
                    label, held, count = reduced(), [], 0
    root = _smallest(ids, reduced())
    linked = root != ids
    return pa.table({"a": ids[linked], "b": root[linked]})


def _smallest(ids: np.ndarray, label: np.ndarray) -> np.ndarray:
    """The smallest id of each row's component."""
    smallest = np.full(len(ids), np.iinfo(np.int64).max)
    np.minimum.at(smallest, label, ids)
    return smallest[label]


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``doc_id, group_id`` of the edges ``a, b`` of one partition."""
    got = [b for b in batches if b.num_rows]
    if not got:
        return
    edges = pa.Table.from_batches(got)
    a, b = edges.column("a").to_numpy(), edges.column("b").to_numpy()
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    root = _smallest(ids, forest(len(ids), at[: len(a)], at[len(a) :]))
    yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(root)], names=["doc_id", "group_id"])


def components(edges: DataFrame, one_task: int = BROADCAST_BYTES // 16) -> DataFrame:
    """``doc_id, group_id`` of every node that an edge ``a, b`` touches; the group is its smallest node.

    Up to ``one_task`` counted edges are merged in one task. More of them by
    alternating large-star and small-star contraction: each round joins nothing
    wider than the edge list and shrinks the depth of the forest; rounds end when
    every edge points to a root. The list of each round is cut from the lineage.
    """
    now = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    if now.count() <= one_task:
        return now.coalesce(1).mapInArrow(_merged, "doc_id long, group_id long")
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b"))
        large = large.where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("low"))
        pairs = large.join(least, "a")
        next_edges = pairs.select("a", F.col("low").alias("b")).unionByName(pairs.where("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b"))).where("a <> b").distinct()
        now = cut(next_edges)
        roots = now.select("b").distinct()
        if now.join(roots.withColumnRenamed("b", "a"), "a", "left_semi").isEmpty() and now.groupBy("a").count().where("count > 1").isEmpty():
            break
    nodes = now.select(F.col("a").alias("doc_id"), F.col("b").alias("group_id"))
    return nodes.unionByName(now.select(F.col("b").alias("doc_id"), F.col("b").alias("group_id")).distinct())


def near_duplicates(docs: DataFrame, max_distance: int = MAX_DISTANCE, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Members of near-duplicate groups of ``docs(doc_id, text, ...)``.

    Returns ``doc_id, group_id, kept``: one row for each distinct doc_id in a
    group of at least two; ``group_id`` is the group's smallest doc_id, the one
    ``kept``. A group is a connected component of the pairs within
    ``max_distance`` bits, all of them, so ties need no rule.

    Rows without doc_id and texts that are null, empty or without words belong
    to no group. Rows that repeat a doc_id are one document; if their texts differ
    it connects the groups of all of them. Other columns are ignored. An empty
    table gives an empty result.
    """
    prints = cut(document_fingerprints(docs))
    heads = cut(prints.groupBy("f0", "f1").agg(F.min("doc_id").alias("head")))
    count = heads.count()
    blocks = cover(count, max_distance)
    prefix = prefix_bits(count, blocks, shard_rows)
    placed = heads.select(F.col("head").alias("doc_id"), "f0", "f1").mapInArrow(lambda it: _shard_rows(it, blocks, prefix), "shard long, doc_id long, f0 long, f1 long")
    near = placed.groupBy("shard").applyInArrow(lambda rows: _shard_edges(rows, blocks, prefix, max_distance), "a long, b long")
    same = prints.join(heads, ["f0", "f1"]).where("doc_id <> head").select(F.col("doc_id").alias("a"), F.col("head").alias("b"))
    # A doc_id with several texts has no row of its own that ties them; its fingerprints are tied here.
    groups = components(near.unionByName(same))
    return groups.select("doc_id", "group_id", (F.col("doc_id") == F.col("group_id")).alias("kept"))


def drop_near_duplicates(docs: DataFrame, max_distance: int = MAX_DISTANCE) -> DataFrame:
    """``docs`` without the members of near-duplicate groups that aren't kept; null doc_ids and groups of one stay. Columns and rows that repeat a kept doc_id stay as they are."""
    gone = cut(near_duplicates(docs, max_distance).where("NOT kept").select(F.col("doc_id").alias("_gone")))
    return docs.join(small(gone, 24), docs["doc_id"].cast("long") == gone["_gone"], "left_anti")
