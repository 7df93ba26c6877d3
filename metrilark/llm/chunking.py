"""Document fingerprints from content-defined chunks (operator 4).

A gear hash is computed for every byte at once, by doublings of shifted sums; the
bits that are looked at depend on the last 16 bytes. Boundaries are normalised: from MIN_BYTES to NORMAL_BYTES
after the last boundary a strict mask has to be zero, then, up to MAX_BYTES, a loose
one. As boundaries depend on the bytes near them only, an insertion shifts them
along and all chunks but those it touches keep their digests. The set of a document's
chunk digests, each weighted by its bytes, is its fingerprint; the share of a
document's weight that another one's set holds is its containment there.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import _bytes as B
from ._spark import bounded, cut, small

#: Short against the passages to be found, for a passage is found only if a whole chunk lies within it.
MIN_BYTES, NORMAL_BYTES, MAX_BYTES = 16, 32, 128
#: Bits that have to be zero before and after NORMAL_BYTES; of the lowest 16, which depend on the last 16 bytes only.
STRICT, LOOSE = np.uint32(0b111111 << 10), np.uint32(0b1111 << 12)
#: Share of a document from which ``fingerprints`` gives all its containers.
LEAST = 0.5
_GEAR = (B.mix(np.arange(256, dtype=np.uint64), 4) >> np.uint64(32)).astype(np.uint32)


def gear_hashes(flat: np.ndarray) -> np.ndarray:
    """sum of GEAR[byte k back] << k over the bytes that end at each position: the lowest 16 bits, for which 16 bytes count."""
    h = _GEAR[flat]
    for shift in (1, 2, 4, 8):
        h[shift:] = h[shift:] + (h[:-shift] << np.uint32(shift))
    return h


def boundaries(flat: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and rows of the chunks of each row, in order; an empty row has none.

    Hashes near the start of a row see bytes of the row before it, but no boundary can
    lie within MIN_BYTES, the window, of it.
    """
    h = gear_hashes(flat)
    loose = np.flatnonzero((h & LOOSE) == 0) + 1  # ends of chunks
    strict = (h[loose - 1] & STRICT) == 0
    starts, ends, rows = [], [], []
    at = loose.tolist()
    is_strict = strict.tolist()
    first = np.searchsorted(loose, offsets[:-1]).tolist()
    bounds = offsets.tolist()
    for r in range(len(bounds) - 1):
        low, high = bounds[r], bounds[r + 1]
        k, n = first[r], len(at)
        while low < high:
            near, middle, far = low + MIN_BYTES, low + NORMAL_BYTES, min(low + MAX_BYTES, high)
            while k < n and at[k] < near:
                k += 1
            end = far
            while k < n and at[k] < far:
                if is_strict[k] or at[k] >= middle:
                    end = at[k]
                    break
                k += 1
            starts.append(low)
            ends.append(end)
            rows.append(r)
            low = end
    return np.array(starts, np.int64), np.array(ends, np.int64), np.array(rows, np.int64)


def _chunk_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for piece in B.pieces(batches):
        flat, offsets = B.text_buffer(piece.column("text"))
        starts, ends, rows = boundaries(flat, offsets)
        digest = B.span_hashes(flat, starts, ends)
        order = np.lexsort((digest, rows))
        digest, rows, size = digest[order], rows[order], (ends - starts)[order]
        new = np.concatenate(([True], (rows[1:] != rows[:-1]) | (digest[1:] != digest[:-1]))) if len(rows) else np.zeros(0, bool)
        take = np.flatnonzero(new)
        yield pa.RecordBatch.from_arrays([piece.column("doc_id").take(pa.array(rows[take])), pa.array(digest[take].view(np.int64)), pa.array(size[take].astype(np.int32))], names=["doc_id", "digest", "bytes"])


def chunk_digests(docs: DataFrame) -> DataFrame:
    """``doc_id, digest, bytes``: the set of chunk digests of every row of ``docs(doc_id, text, ...)``, each once, with its chunk's length."""
    plain = bounded(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return plain.mapInArrow(_chunk_batches, "doc_id long, digest long, bytes int")


def chunk_sets(docs: DataFrame) -> DataFrame:
    """``chunk_digests`` with the rows of a doc_id made one set; only repeated doc_ids are shuffled for it. Chunking again costs less than the disk for all digests."""
    rows = chunk_digests(docs).where("doc_id IS NOT NULL")
    again = cut(docs.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").select("doc_id"))
    n = again.count()
    if not n:
        return rows
    again = small(again, 16, n)
    merged = rows.join(again, "doc_id", "left_semi").groupBy("doc_id", "digest").agg(F.max("bytes").alias("bytes"))
    return rows.join(again, "doc_id", "left_anti").unionByName(merged)


def _shared_keys(sets: DataFrame) -> DataFrame:
    """``doc_id, keys``: the sorted keys of what each document shares with another one. A key is a digest whose lowest byte gives way to its chunk's length."""
    keyed = sets.select("doc_id", F.col("digest").bitwiseAND(F.lit(-256)).bitwiseOR(F.col("bytes").cast("long")).alias("key"))
    held = keyed.withColumn("df", F.count("*").over(Window.partitionBy("key"))).where("df > 1")
    return held.groupBy("doc_id").agg(F.sort_array(F.collect_list("key")).alias("keys"))


def _group_items(lists: DataFrame, groups: DataFrame) -> DataFrame:
    """``head, items, least_bytes``: the keys of each group that other groups have too, the rarest first, each with in how many it is and the first other one."""
    by_key = Window.partitionBy("key")
    sets = lists.join(groups.select(F.col("head").alias("doc_id")), "doc_id").select(F.col("doc_id").alias("head"), F.explode("keys").alias("key"))
    ranked = sets.withColumns({"df": F.count("*").over(by_key), "at": F.row_number().over(by_key.orderBy("head"))}).where("df > 1")
    edges = {"first": F.min("head").over(by_key), "second": F.min(F.when(F.col("at") == 2, F.col("head"))).over(by_key)}
    holder = F.when(F.col("at") == 1, F.col("second")).otherwise(F.col("first"))
    item = F.struct(F.col("df").cast("int").alias("df"), "key", holder.alias("holder"))
    rows = ranked.withColumns(edges).select("head", item.alias("item"), F.lit(None).cast("long").alias("least_bytes"))
    # the bytes of a group come along, so that its items needn't be sent once more to meet them
    rows = rows.unionByName(groups.select("head", F.lit(None).cast("struct<df:int,key:bigint,holder:bigint>").alias("item"), "least_bytes"))
    return rows.groupBy("head").agg(F.sort_array(F.collect_list("item")).alias("items"), F.max("least_bytes").alias("least_bytes")).where("size(items) > 0")


def _searches(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    """``head, key`` of the rarest keys of each group, of which a container with ``least`` of a document of it must hold one; ``head, other``: the one that is first in most of its bytes."""
    for batch in batches:
        items = batch.column("items")
        starts = items.offsets.to_numpy().astype(np.int64)
        flat = items.values.slice(starts[0], starts[-1] - starts[0])
        key, holder = flat.field("key").to_numpy(), flat.field("holder").to_numpy()
        starts = starts - starts[0]
        heads, size = batch.column("head").to_numpy(), key & 255
        rows = np.repeat(np.arange(len(heads)), np.diff(starts))
        sums = np.concatenate(([0], np.cumsum(size)))
        before, whole = sums[:-1] - sums[starts[:-1]][rows], (sums[starts[1:]] - sums[starts[:-1]])
        limit = whole - (least - 1e-12) * batch.column("least_bytes").to_numpy()
        rare = np.flatnonzero(before <= limit[rows])
        order = np.lexsort((holder, rows))
        new = np.flatnonzero(np.concatenate(([True], (rows[order][1:] != rows[order][:-1]) | (holder[order][1:] != holder[order][:-1]))) if len(order) else [])
        credit, owner, first = np.add.reduceat(size[order], new) if len(new) else size, rows[order][new], holder[order][new]
        best = np.lexsort((first, -credit, owner))
        best = best[np.unique(owner[best], return_index=True)[1]]
        out = {"head": np.concatenate([heads[rows[rare]], heads[owner[best]]]), "key": pa.concat_arrays([pa.array(key[rare]), pa.nulls(len(best), pa.int64())]), "other": pa.concat_arrays([pa.nulls(len(rare), pa.int64()), pa.array(first[best])])}
        yield pa.RecordBatch.from_arrays([pa.array(out["head"]), out["key"], out["other"]], names=list(out))


def _group_pairs(items: DataFrame, least: float) -> DataFrame:
    """``head, listed, top`` of groups: all others that have at least ``least`` of a document of ``head``, and the one that has most of it of those looked at, as (-common, id)."""
    searches = bounded(items).mapInArrow(lambda it: _searches(it, least), "head long, key long, other long")
    others = items.select(F.col("head").alias("other"), F.explode("items.key").alias("key"))
    searched = searches.where("key IS NOT NULL").select("head", "key").join(others, "key").where("head <> other").select("head", "other")
    pairs = searched.unionByName(searches.where("other IS NOT NULL").select("head", "other")).select(F.least("head", "other").alias("a"), F.greatest("head", "other").alias("b"))
    side = lambda c: items.select(F.col("head").alias(c), F.col("items.key").alias(f"keys_{c}"), F.col("least_bytes").alias(f"least_{c}"))
    # each pair once by sets of the second ones, which already are where the first one's keys go
    met = pairs.groupBy("a").agg(F.collect_set("b").alias("b")).join(side("a"), "a").select("a", "keys_a", "least_a", F.explode("b").alias("b")).join(side("b"), "b")
    met = met.select("a", "b", "least_a", "least_b", F.expr("aggregate(array_intersect(keys_a, keys_b), 0L, (n, key) -> n + (key & 255))").alias("common"))
    way = lambda head, other: F.struct(F.col(head).alias("head"), F.struct((-F.col("common")).alias("less"), F.col(other).alias("id")).alias("one"), (F.col("common") >= least * F.col(f"least_{head}") - 1e-6).alias("most"))
    return met.select(F.explode(F.array(way("a", "b"), way("b", "a"))).alias("way")).select("way.*").groupBy("head").agg(F.collect_list(F.when(F.col("most"), F.col("one"))).alias("listed"), F.min("one").alias("top"))


def fingerprints(docs: DataFrame, least: float = LEAST) -> DataFrame:
    """The fingerprint of every document in ``docs(doc_id, text, ...)`` and its containment in the others.

    Returns ``doc_id, chunks, bytes, sketch, shared_bytes, containment, container_id,
    container_share, group_id, containers``: the number and the summed length of the
    distinct chunks, the exclusive or of the digests, the length of those that any other
    document has too and its share, the document that holds most of it, with the exact
    share of its length that this one's set holds, the smallest doc_id of its group, and
    all groups with a share of at least ``least`` as ``array<struct<container_id, share>>``,
    by falling share. Documents with the same shared chunks are a group, for whatever one holds of another
    document all hold; a container stands for its group by the smallest doc_id that isn't the
    document's own, so that the result stays linear in copies. All pairs are in there, as in
    ``containment_pairs``: join ``container_id`` with the ``group_id`` of the documents.

    From ``least`` on the container is the best of all, of several the one of the smallest
    doc_id. Below, it is the best that was looked at, at least the group that is first in most of
    the chunks; without a shared chunk it is null and its share 0.

    Exact: a group is looked up by its rarest digests only, as many as any container must hold one of.

    Rows of one doc_id are one document with all their chunks. Rows without doc_id and
    null and empty texts have no fingerprint. Other columns are ignored. An empty table
    gives an empty result.
    """
    sets = chunk_sets(docs)
    lists = cut(_shared_keys(sets))
    whole = sets.groupBy("doc_id").agg(F.count("*").alias("chunks"), F.sum("bytes").alias("bytes"), F.bit_xor("digest").alias("sketch"))
    signed = lists.select("doc_id", F.xxhash64("keys").alias("s0"), F.xxhash64(F.lit(1), "keys").alias("s1"), F.size("keys").alias("shared"), F.expr("aggregate(keys, 0L, (n, key) -> n + (key & 255))").alias("shared_bytes"))
    # what shares nothing is a group of its own
    alone = {"s0": F.coalesce("s0", "doc_id"), "s1": F.coalesce("s1", F.lit(0)), "shared": F.coalesce("shared", F.lit(0)), "shared_bytes": F.coalesce("shared_bytes", F.lit(0)).cast("long")}
    signature = ["s0", "s1", "shared"]
    same = Window.partitionBy(*signature)
    placed = whole.join(signed, "doc_id", "left").withColumns(alone).withColumns({"head": F.min("doc_id").over(same), "at": F.row_number().over(same.orderBy("doc_id"))})
    placed = cut(placed.withColumns({"second": F.min(F.when(F.col("at") == 2, F.col("doc_id"))).over(same), "least_bytes": F.min("bytes").over(same)}).drop("s0", "s1", "at"))
    groups = placed.where("doc_id = head AND shared > 0").select("head", "least_bytes")
    others = _group_pairs(cut(_group_items(lists, small(groups, 16))), least)
    copy = F.when(F.col("doc_id") == F.col("head"), F.col("second")).otherwise(F.col("head"))
    none = F.array().cast("array<struct<less:bigint,id:bigint>>")
    own = F.when(copy.isNotNull(), F.array(F.struct((-F.col("shared_bytes")).alias("less"), copy.alias("id")))).otherwise(none)
    # the best one is among those listed, if any are
    met = F.when(F.size("listed") > 0, F.col("listed")).when(F.col("top").isNotNull(), F.array("top")).otherwise(none)
    out = placed.join(others, "head", "left").withColumn("holders", F.sort_array(F.concat(own, met)))
    share = lambda c: F.coalesce(c / F.col("bytes"), F.lit(0.0))
    best = F.try_element_at("holders", F.lit(1))
    pairs = F.transform("holders", lambda h: F.struct(h["id"].alias("container_id"), (-h["less"] / F.col("bytes")).alias("share")))
    return out.select("doc_id", "chunks", "bytes", "sketch", "shared_bytes", share(F.col("shared_bytes")).alias("containment"), best["id"].alias("container_id"), share(-best["less"]).alias("container_share"), F.col("head").alias("group_id"), F.filter(pairs, lambda p: p["share"] >= least).alias("containers"))


def containment_pairs(docs: DataFrame, least: float) -> DataFrame:
    """All pairs ``doc_id, container_id, share`` with at least ``least`` of the first's length in the second's set.

    Exact: a document is looked up by its rarest digests only, as many as hold more than
    1 - least of its length, of which any container must hold one. Its result grows with
    the square of the size of groups of copies, for which ``fingerprints`` is linear.
    """
    sets = cut(chunk_digests(docs).where("doc_id IS NOT NULL").groupBy("doc_id", "digest").agg(F.max("bytes").alias("bytes")))
    rarity = sets.groupBy("digest").agg(F.count("*").alias("df"))
    by_doc = Window.partitionBy("doc_id")
    rare = by_doc.orderBy("df", "digest")
    ordered = sets.join(rarity, "digest").withColumns({"whole": F.sum("bytes").over(by_doc), "before": F.sum("bytes").over(rare) - F.col("bytes")})
    prefix = ordered.where((F.col("before") <= (1 - least + 1e-12) * F.col("whole")) & (F.col("df") > 1))
    candidates = prefix.select("doc_id", "digest").join(sets.select(F.col("doc_id").alias("container_id"), "digest"), "digest").where("doc_id <> container_id").select("doc_id", "container_id").distinct()
    common = candidates.join(sets, "doc_id").join(sets.select(F.col("doc_id").alias("container_id"), "digest"), ["container_id", "digest"]).groupBy("doc_id", "container_id").agg(F.sum("bytes").alias("common"))
    whole = sets.groupBy("doc_id").agg(F.sum("bytes").alias("whole"))
    return common.join(whole, "doc_id").select("doc_id", "container_id", (F.col("common") / F.col("whole")).alias("share")).where(F.col("share") >= least)
