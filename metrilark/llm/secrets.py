"""Secret scans with one deterministic automaton for all rules (operator 5).

The rules, regular expressions over bytes, are parsed and joined in one
nondeterministic automaton; subset construction and partition refinement give the
smallest deterministic one, kept as a transition array over byte classes. A scan
looks each byte up once, whatever the number of rules: texts are cut into equally long
segments that advance side by side in array operations, later segments from a guessed
state; where the guess was wrong, the segment is run again from the true state until
it falls in with what was recorded, so the result is that of one pass from the start.
Positions where a rule ends are rare; from each the rule's reversed automaton is walked
back to the earliest start.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _bytes as B
from ._spark import bounded

WORD = frozenset(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_")
EDGE = WORD | frozenset(b"-")
DIGIT = frozenset(b"0123456789")
SPACE = frozenset(b" \t\r\n\f\v")
ANY = frozenset(range(256)) - {10}

#: name -> expression. A match starts after, and ends before, a byte that isn't a letter, digit, underscore or hyphen, if its own edge is one that is.
RULES = {
    "aws_access_key": r"(?:AKIA|ASIA)[A-Z0-9]{16}",
    "github_token": r"gh[pousr]_[A-Za-z0-9]{36}",
    "gitlab_token": r"glpat-[A-Za-z0-9_-]{20}",
    "slack_token": r"xox[abprs]-[A-Za-z0-9-]{10,}",
    "google_api_key": r"AIza[A-Za-z0-9_-]{35}",
    "stripe_key": r"[sr]k_live_[A-Za-z0-9]{24,}",
    "npm_token": r"npm_[A-Za-z0-9]{36}",
    "sendgrid_key": r"SG\.[A-Za-z0-9_-]{22}\.[A-Za-z0-9_-]{43}",
    "json_web_token": r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}",
    "private_key": r"-----BEGIN (?:RSA |EC |DSA |OPENSSH |ENCRYPTED )?PRIVATE KEY-----",
    "url_password": r"[a-z]{2,}://[^\s:/@\"'<>]+:[^\s:/@\"'<>]+@",
    "assigned_secret": r"(?i:token|secret|password|passwd|api_?key|access_?key|auth_?key)[^A-Za-z0-9\"'\n:=]{0,8}[:=]{1,2}[^A-Za-z0-9\"'\n:=]{0,8}[\"'][A-Za-z0-9_-]{16,}={0,2}[\"']",
}
SEGMENT = 512
#: Rule sets that need more states are refused; counted repeats that can overlap themselves make them explode.
MAX_STATES = 20_000
SCHEMA = "doc_id long, rule string, start int, end int, secret_sha256 string"


class _Parser:
    """Expressions to trees: ("set", bytes), ("cat", parts), ("or", parts), ("rep", part, least, most or None)."""

    def __init__(self, source: str):
        self.s, self.i, self.fold = source, 0, False

    def parse(self):
        tree = self._either()
        if self.i < len(self.s):
            raise ValueError(f"unexpected {self.s[self.i]!r} at {self.i} in {self.s!r}")
        return tree

    def _either(self):
        options = [self._sequence()]
        while self.s[self.i : self.i + 1] == "|":
            self.i += 1
            options.append(self._sequence())
        return options[0] if len(options) == 1 else ("or", options)

    def _sequence(self):
        parts = []
        while self.i < len(self.s) and self.s[self.i] not in "|)":
            parts.append(self._repeated(self._atom()))
        return ("cat", parts)

    def _repeated(self, atom):
        while self.i < len(self.s) and self.s[self.i] in "*+?{":
            c = self.s[self.i]
            self.i += 1
            if c == "{":
                end = self.s.index("}", self.i)
                low, comma, high = self.s[self.i : end].partition(",")
                self.i = end + 1
                bounds = (int(low), int(high) if high else None) if comma else (int(low), int(low))
            else:
                bounds = {"*": (0, None), "+": (1, None), "?": (0, 1)}[c]
            atom = ("rep", atom, *bounds)
        return atom

    def _atom(self):
        c = self.s[self.i]
        self.i += 1
        if c == "(":
            before = self.fold
            if self.s.startswith("?i:", self.i):
                self.fold = True
                self.i += 3
            elif self.s.startswith("?:", self.i):
                self.i += 2
            tree = self._either()
            if self.s[self.i : self.i + 1] != ")":
                raise ValueError(f"unclosed group in {self.s!r}")
            self.i += 1
            self.fold = before
            return tree
        if c == "[":
            return ("set", self._class())
        if c == ".":
            return ("set", ANY)
        if c == "\\":
            return ("set", self._folded(self._escape()))
        raw = c.encode()
        if len(raw) > 1:
            return ("cat", [("set", frozenset([b])) for b in raw])
        return ("set", self._folded(frozenset(raw)))

    def _folded(self, some: frozenset) -> frozenset:
        return some | {b ^ 32 for b in some if chr(b).isascii() and chr(b).isalpha()} if self.fold else some

    def _escape(self) -> frozenset:
        c = self.s[self.i]
        self.i += 1
        known = {"d": DIGIT, "w": WORD, "s": SPACE, "n": frozenset(b"\n"), "t": frozenset(b"\t"), "r": frozenset(b"\r")}
        return known[c] if c in known else frozenset(c.encode())

    def _class(self) -> frozenset:
        negated = self.s[self.i] == "^"
        self.i += negated
        out: set[int] = set()
        first = True
        while first or self.s[self.i] != "]":
            first = False
            c = self.s[self.i]
            self.i += 1
            some = self._escape() if c == "\\" else frozenset(c.encode())
            if len(some) == 1 and self.s[self.i] == "-" and self.s[self.i + 1] != "]":
                high = self.s[self.i + 1]
                self.i += 2
                some = frozenset(range(next(iter(some)), ord(high) + 1))
            out |= some
        self.i += 1
        out = set(self._folded(frozenset(out)))
        return frozenset(range(256)) - out if negated else frozenset(out)


def _reverse(tree):
    if tree[0] == "cat":
        return ("cat", [_reverse(t) for t in reversed(tree[1])])
    if tree[0] == "or":
        return ("or", [_reverse(t) for t in tree[1]])
    if tree[0] == "rep":
        return ("rep", _reverse(tree[1]), *tree[2:])
    return tree


class _Nfa:
    def __init__(self):
        self.empty: list[list[int]] = []
        self.moves: list[list[tuple[frozenset, int]]] = []

    def state(self) -> int:
        self.empty.append([])
        self.moves.append([])
        return len(self.empty) - 1

    def add(self, tree, start: int) -> int:
        """Adds the tree after ``start``; returns its end."""
        if tree[0] == "set":
            end = self.state()
            self.moves[start].append((tree[1], end))
            return end
        if tree[0] == "cat":
            for part in tree[1]:
                start = self.add(part, start)
            return start
        if tree[0] == "or":
            end = self.state()
            for part in tree[1]:
                own = self.state()
                self.empty[start].append(own)
                self.empty[self.add(part, own)].append(end)
            return end
        _, part, least, most = tree
        for _ in range(least):
            start = self.add(part, start)
        end = self.state()
        self.empty[start].append(end)
        if most is None:
            loop = self.state()
            self.empty[start].append(loop)
            after = self.add(part, loop)
            self.empty[after].extend([loop, end])
        else:
            for _ in range(most - least):
                start = self.add(part, start)
                self.empty[start].append(end)
        return end

    def closure(self, states) -> frozenset:
        seen, todo = set(states), list(states)
        while todo:
            for t in self.empty[todo.pop()]:
                if t not in seen:
                    seen.add(t)
                    todo.append(t)
        return frozenset(seen)


def _byte_classes(sets: set[frozenset]) -> tuple[np.ndarray, list[int]]:
    """Class of each byte and a byte of each class: bytes in the same sets share one."""
    keys: dict[tuple, int] = {}
    of, one = np.zeros(256, np.uint8), []
    order = sorted(sets, key=sorted)
    for b in range(256):
        key = tuple(b in s for s in order)
        if key not in keys:
            keys[key] = len(keys)
            one.append(b)
        of[b] = keys[key]
    return of, one


@dataclass
class Dfa:
    """``table[state * classes + class]`` is the next state times ``classes``; ``accept`` has the rules that end in a state as bits."""

    byte_class: np.ndarray
    classes: int
    table: np.ndarray
    accept: np.ndarray
    start: int


def determinise(nfa: _Nfa, start: frozenset, accepting: dict[int, int]) -> Dfa:
    """Subset construction, then Moore's partition refinement."""
    of, one = _byte_classes({s for m in nfa.moves for s, _ in m} | {EDGE})
    subsets, rows, todo = {start: 0}, [], [start]
    for subset in todo:
        moves = [m for s in subset for m in nfa.moves[s]]
        row = []
        for b in one:
            target = nfa.closure(frozenset(t for s, t in moves if b in s))
            if target not in subsets:
                subsets[target] = len(subsets)
                todo.append(target)
                if len(todo) > MAX_STATES:
                    raise ValueError(f"the rules need more than {MAX_STATES} states")
            row.append(subsets[target])
        rows.append(row)
    table = np.array(rows)
    accept = np.array([sum({1 << accepting[s] for s in subset if s in accepting}) for subset in subsets], np.int64)
    _, part = np.unique(accept, return_inverse=True)
    while True:
        _, finer = np.unique(np.column_stack([part, part[table]]), axis=0, return_inverse=True)
        finer = finer.ravel()
        if finer.max() == part.max():
            break
        part = finer
    _, head = np.unique(part, return_index=True)
    small = part[table[head]].astype(np.int64) * len(one)
    return Dfa(of, len(one), small.ravel().astype(np.int32), accept[head], int(part[0]) * len(one))


class Scanner:
    """All rules as one automaton; ``find`` gives the maximal matches of each rule."""

    def __init__(self, rules: dict[str, str]):
        self.names = list(rules)
        nfa = _Nfa()
        # where a text stands before a byte, by the byte before it
        after_other, after_edge = nfa.state(), nfa.state()
        for s in (after_other, after_edge):
            nfa.moves[s] += [(frozenset(range(256)) - EDGE, after_other), (EDGE, after_edge)]
        accepting = {}
        self.backward, self.edge = [], []
        for k, source in enumerate(rules.values()):
            tree = _Parser(source).parse()
            entry = nfa.state()
            accepting[nfa.add(tree, entry)] = k
            nfa.empty[after_other].append(entry)
            edge = EDGE if self._firsts(tree) & EDGE else frozenset()
            if not edge:
                nfa.empty[after_edge].append(entry)
            back = _Nfa()
            begin = back.state()
            end = back.add(_reverse(tree), begin)
            self.backward.append(determinise(back, back.closure([begin]), {end: 0}))
            self.edge.append(edge)
        self.dfa = determinise(nfa, nfa.closure([after_other]), accepting)
        self.rule_bits = self.dfa.accept
        self.ends = self.dfa.accept != 0
        self.dead = [b.table.reshape(-1, b.classes) for b in self.backward]

    def _firsts(self, tree) -> frozenset:
        nfa = _Nfa()
        start = nfa.state()
        nfa.add(tree, start)
        return frozenset(b for s in nfa.closure([start]) for some, _ in nfa.moves[s] for b in some)

    def accepting(self, flat: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(positions after which a rule ends, bits of these rules), each text scanned from its own start."""
        d = self.dfa
        size = np.diff(offsets)
        per = -(-size // SEGMENT)
        lanes = int(per.sum())
        if not lanes:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        row = np.repeat(np.arange(len(size)), per)
        index = np.arange(lanes) - np.concatenate(([0], np.cumsum(per)[:-1]))[row]
        start = offsets[row] + index * SEGMENT
        stop = np.minimum(start + SEGMENT, offsets[row + 1])
        classes = np.concatenate([d.byte_class[flat], np.zeros(SEGMENT, np.uint8)])
        grid = np.lib.stride_tricks.sliding_window_view(classes, SEGMENT)[start].T.astype(np.int32)  # step x lane
        first = index == 0
        # the guess: the state that the byte before leads to from the start of a text
        begin = np.where(first, d.start, d.table[d.start + classes[start - 1].astype(np.int64)]).astype(np.int32)
        states = np.empty((SEGMENT, lanes), np.int32)
        state = begin
        for k in range(SEGMENT):
            state = d.table.take(state + grid[k])
            states[k] = state
        length = stop - start
        while True:  # a segment whose guess was wrong runs again
            true = begin.copy()
            later = np.flatnonzero(~first)
            true[later] = states[length[later - 1] - 1, later - 1]
            wrong = np.flatnonzero(true != begin)
            if not len(wrong):
                break
            begin[wrong] = true[wrong]
            state = true[wrong]
            for k in range(SEGMENT):
                state = d.table.take(state + grid[k, wrong])
                differ = state != states[k, wrong]
                wrong, state = wrong[differ], state[differ]
                if not len(wrong):
                    break
                states[k, wrong] = state
        step, lane = np.nonzero(self.ends[states // d.classes])
        inside = step < length[lane]
        step, lane = step[inside], lane[inside]
        return start[lane] + step + 1, self.rule_bits[states[step, lane] // d.classes]

    def _earliest(self, flat: np.ndarray, low: int, end: int, rule: int) -> int:
        """The earliest start of a match of the rule that ends at ``end``, or -1."""
        d, found, at, state = self.backward[rule], -1, end, self.backward[rule].start
        table, classes, accept = d.table, d.byte_class, d.accept
        while at > low:
            at -= 1
            state = int(table[state + int(classes[flat[at]])])
            here = state // d.classes
            if accept[here] and (at == low or int(flat[at - 1]) not in self.edge[rule]):
                found = at
            if not accept[here] and (self.dead[rule][here] == state).all():
                break
        return found

    def find(self, column: pa.Array) -> list[tuple[int, int, int, int]]:
        """(row, rule, start, end) in bytes of the row's text: the matches that no other match of the rule contains."""
        flat, offsets = B.text_buffer(column)
        position, bits = self.accepting(flat, offsets)
        row = np.searchsorted(offsets, position - 1, side="right") - 1
        out = []
        for k in range(len(self.names)):
            at = np.flatnonzero(bits >> k & 1)
            by_row: dict[int, list[tuple[int, int]]] = {}
            for r, end in sorted(zip(row[at].tolist(), position[at].tolist())):
                low, high = int(offsets[r]), int(offsets[r + 1])
                if end < high and int(flat[end]) in EDGE and int(flat[end - 1]) in EDGE:
                    continue
                start = self._earliest(flat, low, end, k)
                if start >= 0:
                    spans = by_row.setdefault(r, [])
                    while spans and spans[-1][0] >= start:  # ends rise: the later one contains it
                        spans.pop()
                    spans.append((start, end))
            out += [(r, k, s - int(offsets[r]), e - int(offsets[r])) for r, spans in by_row.items() for s, e in spans]
        return sorted(out, key=lambda x: (x[0], x[2], x[1]))


_scanners: dict[tuple, Scanner] = {}


def scanner(rules: dict[str, str]) -> Scanner:
    """The compiled rules, made once in a process."""
    key = tuple(rules.items())
    if key not in _scanners:
        _scanners[key] = Scanner(rules)
    return _scanners[key]


def secrets(docs: DataFrame, rules: dict[str, str] | None = None) -> DataFrame:
    """``doc_id, rule, start, end, secret_sha256`` of every maximal match of a rule in ``docs(doc_id, text, ...)``; offsets in characters.

    Null and empty texts have none. Matches of different rules may overlap, each is
    reported. Repeated rows report their matches once each, with their doc_id or
    null. Other columns are ignored. An empty table gives an empty result.
    """
    rules = rules or RULES
    scan = scanner(rules)  # compiled here once; its arrays travel with the task

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in B.pieces(batches):
            text = piece.column("text")
            found = scan.find(text)
            row, name, start, end, digest = [], [], [], [], []
            for r, k, s, e in found:
                raw = text[r].as_py().encode()
                row.append(r)
                name.append(scan.names[k])
                start.append(len(raw[:s].decode()))
                end.append(len(raw[:e].decode()))
                digest.append(hashlib.sha256(raw[s:e]).hexdigest())
            yield pa.RecordBatch.from_arrays([piece.column("doc_id").take(pa.array(row, pa.int64())), pa.array(name, pa.string()), pa.array(start, pa.int32()), pa.array(end, pa.int32()), pa.array(digest, pa.string())], names=["doc_id", "rule", "start", "end", "secret_sha256"])

    return bounded(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, SCHEMA)
