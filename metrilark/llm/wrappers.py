"""HTML extraction with union-free regular expressions inferred per host (operator 8).

1. A page is read as a stream of tags and texts. Blocks that follow themselves are
   folded, the shortest first, into repeated groups, which leaves a short skeleton.
2. Pages of a host with the same skeleton are merged in each task and then by a
   partially aggregated ``groupBy``; a text stays where all of them agree. What is left
   are the distinct skeletons of a host, however many pages it has.
3. Skeletons are aligned one after another. A mismatch against a repeated group
   is resolved by folding the other side's occurrences into it, one of texts by a text slot, any other by
   optional groups. Skeletons that share less than half start a wrapper of their own. This is
   done within hash buckets of a host first, then over the buckets' wrappers, as
   wrappers align with each other in the same way.
4. Every page is aligned with its host's closest wrapper: what meets a slot is a field,
   what meets a fixed text is template.
"""

from __future__ import annotations

import hashlib
import html as entities
import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _bytes as B
from ._spark import bounded, cut, small

#: Share of two expressions' elements that must align for them to be one wrapper.
LEAST_SHARED = 0.5
#: Groups of skeletons of a host that are aligned in parallel before their wrappers are.
BUCKETS = 16
#: Fixed texts that are longer are kept as digests.
SHOWN = 64
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|textarea)\b[^>]*>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([A-Za-z][\w:-]*)((?:[^<>\"']|\"[^\"<]*\"|'[^'<]*')*+)/?>|<[!?][^>]*>",
    re.S | re.I,
)
_MARK = re.compile(r"\b(?:class|id)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_BLANK = re.compile(r"\s+")
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
INLINE = frozenset("a abbr b bdi bdo cite code dfn em font i kbd mark q s samp small span strong sub sup tt u var wbr".split())
#: Elements, and classes or ids, whose texts are fields but not content.
ASIDE = frozenset("nav footer aside head form button select option ad ads advert advertisement banner breadcrumb breadcrumbs cookie cookies menu navbar navigation promo sidebar share social sponsored".split())
SCHEMA = "page_id long, host string, wrapper int, fields array<struct<slot:int,text:string>>, text string"


class Page:
    """The tokens of a page: ``keys`` ("#" for a text), ``texts``, whether each text is ``content``, and its ``block``."""

    def __init__(self, source: str):
        self.keys: list[str] = []
        self.texts: list[str | None] = []
        self.content: list[bool] = []
        self.block: list[int] = []
        self._stack: list[tuple[str, bool]] = []
        self._blocks = 0
        at = 0
        for m in TOKEN.finditer(source):
            self._text(source[at : m.start()])
            at = m.end()
            if m[3]:
                self._tag(bool(m[2]), m[3].lower(), m[4])
            elif m[1]:
                self._token(f"<{m[1].lower()}", None)
        self._text(source[at:])

    def _token(self, key: str, text: str | None) -> None:
        self.keys.append(key)
        self.texts.append(text)
        self.content.append(text is not None and not (self._stack and self._stack[-1][1]))
        self.block.append(self._blocks)

    def _text(self, raw: str) -> None:
        text = _BLANK.sub(" ", entities.unescape(raw))
        if text.strip():
            self._token("#", text)

    def _tag(self, closing: bool, name: str, attributes: str) -> None:
        if name not in INLINE:
            self._blocks += 1
        if closing:
            for k in range(len(self._stack) - 1, -1, -1):
                if self._stack[k][0] == name:
                    del self._stack[k:]
                    break
            self._token(f"</{name}", None)
            return
        marks = sorted({w for m in _MARK.finditer(attributes) for w in (m[1] or m[2] or m[3] or "").split() if w.isascii() and w.replace("-", "").replace("_", "").isalpha()}) if "=" in attributes else []
        self._token(".".join([f"<{name}", *marks]), None)
        if name not in VOID:
            aside = bool(self._stack and self._stack[-1][1]) or name in ASIDE or any(w.lower() in ASIDE for w in marks)
            self._stack.append((name, aside))


# A node of a skeleton is (key, children or None, indices of its texts or None); a repeated group's key starts with "(".


def fold(keys: list[str]) -> list[tuple]:
    """The skeleton of a token stream: blocks that start with an opening tag and follow themselves become repeated groups, the shortest first."""
    nodes: list[tuple] = [(k, None, [i] if k == "#" else None) for i, k in enumerate(keys)]
    number: dict[str, int] = {}
    ids = np.array([number.setdefault(n[0], len(number)) for n in nodes], np.int64)
    length = 1
    while 2 * length <= len(nodes):
        same = ids[length:] == ids[:-length]
        if same.sum() < length:
            length += 1
            continue
        run = np.concatenate(([0], np.cumsum(same)))
        squares = np.flatnonzero(run[length:] - run[:-length] == length).tolist()
        out, at, folded = [], 0, False
        for i in squares:
            if i < at or not nodes[i][0].startswith(("<", "(")) or nodes[i][0].startswith("</"):
                continue
            end = i + length
            while end + length <= len(nodes) and (ids[i : i + length] == ids[end : end + length]).all():
                end += length
            out += nodes[at:i]
            body = nodes[i : i + length]
            for k in range(i + length, end, length):
                body = [_joined(a, b) for a, b in zip(body, nodes[k : k + length])]
            if length == 1 and body[0][1] is not None:
                out.append(body[0])  # a repeated group that follows itself is one
            else:
                out.append((f"( {' '.join(n[0] for n in body)} )+", body, None))
            at, folded = end, True
        if folded:
            nodes = out + nodes[at:]
            ids = np.array([number.setdefault(n[0], len(number)) for n in nodes], np.int64)
            length = 1  # a group may now follow itself
        else:
            length += 1
    return nodes


def _joined(a: tuple, b: tuple) -> tuple:
    return (a[0], None if a[1] is None else [_joined(x, y) for x, y in zip(a[1], b[1])], None if a[2] is None else a[2] + b[2])


def _slots(nodes: list[tuple]) -> Iterator[list[int]]:
    """The texts' indices of each slot, in order."""
    for _, children, texts in nodes:
        if texts is not None:
            yield texts
        elif children is not None:
            yield from _slots(children)


def _shown(text: str) -> str:
    text = text.strip()
    return text if len(text) <= SHOWN else "#" + hashlib.blake2b(text.encode(), digest_size=12).hexdigest()


# An expression is a list of elements [key, value, group]: a tag has the value None; a text ("#") has [fixed text or None, pages];
# a repeated group ("+" and its first tag) has an expression. Elements of group 0 are there always, neighbours of one other group together or not at all.


def expression(skeleton: str, fixed: list[str | None], pages: int) -> list[list]:
    """The expression of a skeleton string whose slots have these fixed texts."""
    texts = iter(fixed)

    def read(words: Iterator[str]) -> list[list]:
        out: list[list] = []
        for w in words:
            if w == ")+":
                return out
            if w == "(":
                body = read(words)
                out.append([_plus_key(body), body, 0])
            elif w == "#":
                out.append(["#", [next(texts), pages], 0])
            else:
                out.append([w, None, 0])
        return out

    return read(iter(skeleton.split()))


def _plus_key(body: list[list]) -> str:
    """"+" and the first tag that the group must start with."""
    first = body[0][0]
    return first if first[0] == "+" else "+" + first


def _iterated(these: list[list], those: list[list]) -> list[list]:
    """``these`` with what matches the body of a repeated group of ``those`` folded into such a group."""
    for key, body, _ in those:
        if key[0] != "+" or any(e[0] == key for e in these):
            continue
        need = [e[0] for e in body if not e[2]]
        n, out, at = len(need), [], 0
        keys = [e[0] for e in these]
        while at < len(these):
            if n and keys[at : at + n] == need and all(e[2] == these[at][2] for e in these[at : at + n]):
                block = [[k, v, 0] for k, v, _ in these[at : at + n]]
                if out and out[-1][0] == key and out[-1][2] == these[at][2]:
                    out[-1] = [key, align(out[-1][1], block)[0], out[-1][2]]
                else:
                    out.append([key, block, these[at][2]])
                at += n
            else:
                out.append(these[at])
                at += 1
        these = out
    return these


def _pairs(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """A longest common subsequence, as index pairs."""
    low = 0
    while low < min(len(a), len(b)) and a[low] == b[low]:
        low += 1
    high = 0
    while high < min(len(a), len(b)) - low and a[len(a) - 1 - high] == b[len(b) - 1 - high]:
        high += 1
    x, y = a[low : len(a) - high], b[low : len(b) - high]
    best = [[0] * (len(y) + 1)]
    for i in range(len(x) - 1, -1, -1):
        before, row = best[-1], [0] * (len(y) + 1)
        for j in range(len(y) - 1, -1, -1):
            row[j] = before[j + 1] + 1 if x[i] == y[j] else max(before[j], row[j + 1])
        best.append(row)
    best.reverse()
    out = [(k, k) for k in range(low)]
    i = j = 0
    while i < len(x) and j < len(y):
        if x[i] == y[j]:
            out.append((low + i, low + j))
            i, j = i + 1, j + 1
        elif best[i + 1][j] >= best[i][j + 1]:
            i += 1
        else:
            j += 1
    return out + [(len(a) - high + k, len(b) - high + k) for k in range(high)]


def align(one: list[list], other: list[list]) -> tuple[list[list], float]:
    """The expression that holds both, and the share of their elements that aligned."""
    one, other = _iterated(one, other), _iterated(other, one)
    pairs = _pairs([e[0] for e in one], [e[0] for e in other])
    out: list[list] = []
    i = j = 0
    for p, q in [*pairs, (len(one), len(other))]:
        out += [[k, v, ("one", g, p)] for k, v, g in one[i:p]] + [[k, v, ("other", g, q)] for k, v, g in other[j:q]]
        if p < len(one):
            (key, a, g), (_, b, h) = one[p], other[q]
            value = None
            if key == "#":
                value = [a[0] if a[0] is not None and a[0] == b[0] else None, a[1] + b[1]]
            elif key[0] == "+":
                value = align(a, b)[0]
            out.append([key, value, ("both", g, h) if g or h else 0])
        i, j = p + 1, q + 1
    groups: dict = {0: 0}
    total = len(one) + len(other)
    return [[k, v, groups.setdefault(g, len(groups))] for k, v, g in out], 2 * len(pairs) / total if total else 1.0


def infer(parts: list[tuple[list[list], int]]) -> list[tuple[list[list], int]]:
    """Wrappers, with their pages, of (expression, pages) that are aligned in this order."""
    out: list[tuple[list[list], int]] = []
    for part, pages in parts:
        best = max(range(len(out)), key=lambda k: (align(out[k][0], part)[1], -k), default=None)
        if best is not None:
            merged, share = align(out[best][0], part)
            if share >= LEAST_SHARED:
                out[best] = (merged, out[best][1] + pages)
                continue
        out.append((part, pages))
    return out


def _varies(one: list[list]) -> bool:
    return any(_varies(v) if k[0] == "+" else k == "#" and v[0] is None for k, v, _ in one)


def regex(one: list[list]) -> str:
    """The union-free regular expression in writing: tags, fixed texts in quotes, #TEXT slots, (...)? and (...)+."""
    out: list[str] = []
    groups = [e[2] for e in one]
    for k, (key, value, g) in enumerate(one):
        if g and (not k or groups[k - 1] != g):
            out.append("(")
        if key == "#":
            out.append("#TEXT" if _is_slot(value) else json.dumps(value[0], ensure_ascii=False))
        else:
            out.append(f"( {regex(value)} )+" if key[0] == "+" else key + ">")
        if g and (k + 1 == len(one) or groups[k + 1] != g):
            out.append(")?")
    return " ".join(out)


def _is_slot(value: list) -> bool:
    """A text that differs between pages, or that no second page confirms."""
    return value[0] is None or value[1] < 2


class Wrapper:
    """An expression ready to be applied."""

    def __init__(self, one: list[list]):
        self.one = one

    def roles(self, skeleton: str, texts: list[str | None]) -> tuple[float, list[int | None]]:
        """How much of a page aligns, and for each of its slots the wrapper's slot, or None for fixed text; what the wrapper lacks is slot -1."""
        numbers: dict[int, int] = {}

        def count(one: list[list]) -> None:
            for key, value, _ in one:
                if key == "#":
                    numbers[id(value)] = len(numbers)
                elif key[0] == "+":
                    count(value)

        count(self.one)
        page = expression(skeleton, texts, 1)
        order: dict[int, int] = {}

        def places(one: list[list]) -> None:
            for key, value, _ in one:
                if key == "#":
                    order[id(value)] = len(order)
                elif key[0] == "+":
                    places(value)

        places(page)
        out: list[int | None] = [-1] * len(order)

        def meet(wrapper: list[list], other: list[list]) -> float:
            wrapper, other = _grouped(wrapper, other), _grouped(other, wrapper)
            pairs = _pairs([e[0] for e in wrapper], [e[0] for e in other])
            for p, q in pairs:
                key, a, b = wrapper[p][0], wrapper[p][1], other[q][1]
                if key == "#":
                    out[order[id(b)]] = numbers[id(a)] if _is_slot(a) or (b[0] is not None and b[0] != a[0]) else None
                elif key[0] == "+":
                    for block in b if isinstance(b, _Blocks) else [b]:
                        for mine in a if isinstance(a, _Blocks) else [a]:
                            meet(mine, block)
            return 2 * len(pairs) / max(1, len(wrapper) + len(other))

        return meet(self.one, page), out


class _Blocks(list):
    """Occurrences of a repeated group's body that stand one by one."""


def _grouped(these: list[list], those: list[list]) -> list[list]:
    """As ``_iterated``, but with the occurrences kept apart and their values as they are."""
    for key, body, _ in those:
        if key[0] != "+" or isinstance(body, _Blocks) or any(e[0] == key for e in these):
            continue
        need = [e[0] for e in body if not e[2]]
        n, out, at = len(need), [], 0
        keys = [e[0] for e in these]
        while at < len(these):
            if n and keys[at : at + n] == need:
                if out and out[-1][0] == key:
                    out[-1][1].append(these[at : at + n])
                else:
                    out.append([key, _Blocks([these[at : at + n]]), these[at][2]])
                at += n
            else:
                out.append(these[at])
                at += 1
        these = out
    return these


def _read(source: str) -> tuple[Page, str, list[list[int]], list[str | None]]:
    """(page, skeleton, texts of each slot, its fixed text or None)."""
    page = Page(source)
    nodes = fold(page.keys)
    slots = list(_slots(nodes))
    fixed = []
    for at in slots:
        shown = {_shown(page.texts[i]) for i in at}
        fixed.append(shown.pop() if len(shown) == 1 else None)
    return page, " ".join(n[0] for n in nodes), slots, fixed


def _agreed(a: list[str | None], b: list[str | None]) -> list[str | None]:
    return [x if x == y else None for x, y in zip(a, b)]


def _skeletons(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct (host, skeleton) of a task, merged as they come; handed on whenever they grow large."""
    held: dict[tuple, list] = {}
    size = 0

    def flush() -> pa.RecordBatch:
        rows = [(h, zlib.crc32(s.encode()) % BUCKETS, s, f, n, d) for (h, s), (f, n, d) in held.items()]
        columns = list(zip(*rows)) if rows else [()] * 6
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int32(), pa.string(), pa.list_(pa.string()), pa.int64(), pa.bool_()))], names=["host", "bucket", "skeleton", "fixed", "pages", "differ"])

    for piece in B.pieces(batches, "html"):
        for host, source in zip(piece.column("host").to_pylist(), piece.column("html").to_pylist()):
            if not source:
                continue
            _, skeleton, _, fixed = _read(source)
            got = held.get((host, skeleton))
            if got is None:
                held[host, skeleton] = [fixed, 1, False]
                size += len(skeleton) + sum(len(x or "") for x in fixed)
            else:
                both = _agreed(got[0], fixed)
                got[2] = got[2] or both != got[0] or both != fixed
                got[0] = both
                got[1] += 1
        if size > 8 << 20:
            yield flush()
            held, size = {}, 0
    yield flush()


def _same_skeleton(rows: pa.Table) -> pa.Table:
    """One row of the rows with one host and skeleton. Pages that are all alike count as one, for copies confirm nothing."""
    fixed: list | None = None
    differ = any(rows.column("differ").to_pylist())
    for x in rows.column("fixed").to_pylist():
        both = x if fixed is None else _agreed(fixed, x)
        differ = differ or (fixed is not None and (both != fixed or both != x))
        fixed = both
    pages = sum(rows.column("pages").to_pylist())
    return pa.table({"host": rows.column("host")[:1], "bucket": rows.column("bucket")[:1], "order": pa.array([rows.column("skeleton")[0].as_py()]), "wrapper": pa.array([json.dumps(expression(rows.column("skeleton")[0].as_py(), fixed or [], pages if differ else 1), ensure_ascii=False)]), "pages": pa.array([pages], pa.int64())})


PART = "host string, bucket int, order string, wrapper string, pages long"


def _same_bucket(rows: pa.Table) -> pa.Table:
    parts = sorted(zip(rows.column("pages").to_pylist(), rows.column("order").to_pylist(), rows.column("wrapper").to_pylist()), key=lambda p: (-p[0], p[1]))
    found = infer([(json.loads(w), n) for n, _, w in parts])
    k = len(found)
    return pa.table({"host": pa.array([rows.column("host")[0].as_py()] * k, pa.string()), "bucket": pa.array([0] * k, pa.int32()), "order": pa.array([f"{rows.column('bucket')[0].as_py():03d} {i:09d}" for i in range(k)]), "wrapper": pa.array([json.dumps(w, ensure_ascii=False) for w, _ in found]), "pages": pa.array([n for _, n in found], pa.int64())})


def _plain(pages: DataFrame) -> DataFrame:
    host = F.lower(F.regexp_extract(F.col("url").cast("string"), r"^\s*(?:[A-Za-z][\w+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))
    return bounded(pages).select(F.col("page_id").cast("long").alias("page_id"), F.coalesce(host, F.lit("")).alias("host"), F.col("html").cast("string").alias("html"))


def wrappers(pages: DataFrame) -> DataFrame:
    """``host, wrapper, expression, regex, pages`` of the wrappers inferred from ``pages(url, html, ...)``, numbered by falling number of pages.

    Every page takes part. Pages without a host form a host "" of their own; null and empty pages have none.
    """
    found = _plain(pages).select("host", "html").mapInArrow(_skeletons, "host string, bucket int, skeleton string, fixed array<string>, pages long, differ boolean")
    parts = found.groupBy("host", "bucket", "skeleton").applyInArrow(_same_skeleton, PART)
    parts = parts.groupBy("host", "bucket").applyInArrow(_same_bucket, PART)
    whole = parts.groupBy("host").applyInArrow(_same_bucket, PART)

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("host", "order", "wrapper", "pages")), pa.array([regex(json.loads(w)) for w in batch.column("wrapper").to_pylist()], pa.string())], names=["host", "order", "expression", "pages", "regex"])

    whole = whole.mapInArrow(written, "host string, order string, expression string, pages long, regex string")
    return whole.select("host", F.substring_index("order", " ", -1).cast("int").alias("wrapper"), "expression", "regex", "pages")


class _Hosts:
    """Parsed wrappers and the roles of the skeletons met, kept while they are few."""

    def __init__(self) -> None:
        self.parsed: dict[str, list[Wrapper]] = {}
        self.roles: dict[tuple, tuple] = {}

    def of(self, key: str, source: list[str], skeleton: str, fixed: list[str | None]) -> tuple[int | None, list[int | None]]:
        known = (key, skeleton, tuple(fixed))
        got = self.roles.get(known)
        if got is None:
            if len(self.roles) > 20_000:
                self.roles.clear()
            mine = self.parsed.get(key)
            if mine is None:
                if len(self.parsed) > 1000:
                    self.parsed.clear()
                mine = self.parsed[key] = [Wrapper(json.loads(s)) for s in source]
            best, which, roles = -1.0, None, [-1] * len(fixed)
            for k, wrapper in enumerate(mine):
                share, r = wrapper.roles(skeleton, fixed)
                if share > best:
                    best, which, roles = share, k, r
            got = self.roles[known] = (which, roles)
        return got


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hosts = _Hosts()
    kind = pa.list_(pa.struct([("slot", pa.int32()), ("text", pa.string())]))
    for piece in B.pieces(batches, "html"):
        out = []
        for host, source, ours in zip(piece.column("host").to_pylist(), piece.column("html").to_pylist(), piece.column("expressions").to_pylist()):
            if not source:
                out.append((None, [], ""))
                continue
            page, skeleton, slots, fixed = _read(source)
            which, roles = hosts.of(host, ours or [], skeleton, fixed)
            slot_of = {i: role for at, role in zip(slots, roles) for i in at if role is not None}
            fields = [{"slot": slot_of[i], "text": page.texts[i].strip()} for i in sorted(slot_of)]
            lines: list[str] = []
            last = None
            for i in sorted(slot_of):
                if page.content[i]:
                    if page.block[i] == last:
                        lines[-1] += page.texts[i]
                    else:
                        lines.append(page.texts[i])
                    last = page.block[i]
            out.append((which, fields, "\n".join(line.strip() for line in lines)))
        which, fields, text = zip(*out)
        yield pa.RecordBatch.from_arrays([piece.column("page_id"), piece.column("host"), pa.array(which, pa.int32()), pa.array(fields, kind), pa.array(text, pa.string())], names=["page_id", "host", "wrapper", "fields", "text"])


def extract(pages: DataFrame) -> DataFrame:
    """The fields and the content of every row of ``pages(page_id, url, html, ...)``: ``page_id, host, wrapper, fields, text``.

    ``fields`` has every text that meets a slot of the host's closest wrapper, in the
    order of the page; -1 is the slot of what the wrapper lacks. ``text`` is the part of them outside
    navigation, advertisements and the like, a line for each block.

    A text that stands on one page of its host only, or on copies of one page, is a
    field, as nothing shows that it belongs to the template. Null and empty pages have no
    fields, no wrapper and an empty text. Pages without a host share one. Repeated rows and null ids are
    kept. Other columns are ignored. An empty table gives an empty result.
    """
    found = cut(wrappers(pages).groupBy("host").agg(F.transform(F.array_sort(F.collect_list(F.struct("wrapper", "expression"))), lambda x: x["expression"]).alias("expressions")))
    size = found.agg(F.count("*").alias("n"), F.sum(F.octet_length(F.to_json(F.struct("expressions")))).alias("bytes")).first()
    per_row = -(-(size["bytes"] or 1) // max(1, size["n"])) + 64
    joined = _plain(pages).join(small(found, per_row, size["n"]), "host", "left")
    return joined.select("page_id", "host", "html", "expressions").mapInArrow(_extracted, SCHEMA)
