"""Personal data by weak supervision (operator 1).

Candidate spans come from loose patterns. Seven labelers (regular expressions,
checksums, gazetteers, context) each vote for, against or abstain. One pass over the
corpus counts the distinct (kind, votes, shape) patterns, of which there are only as many as
the labelers allow; expectation-maximisation on these counts estimates how often
each labeler is right on each kind and the probability that a pattern is personal
data; a logistic classifier on votes and shape is then trained on these
probabilities. A second pass finds the spans again and scores them in place. Neither
pass shuffles text.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _bytes as B
from ._spark import bounded

KINDS = ("EMAIL", "IP", "IBAN", "SSN", "PHONE", "CARD", "NAME")
#: Loose patterns; of overlapping candidates the leftmost counts, of those the first kind.
CANDIDATE = re.compile(
    r"(?P<EMAIL>(?<![\w.+%-])[\w.+%-]{1,64}@[\w-]+(?:\.[\w-]+)+)"
    r"|(?P<IP>(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?!\.?[0-9]))"
    r"|(?P<IBAN>(?<!\w)[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w))"
    r"|(?P<SSN>(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-]))"
    r"|(?P<PHONE>(?<![\w+])(?:\+1[ .-]?\(?[0-9]{3}\)?[ .-]?[0-9]{3}[ .-]?[0-9]{4}|\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)[ .-]?)?[0-9]{2,4}(?:[ .-]?[0-9]{2,4}){1,4}|\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}|[0-9]{3}[.-][0-9]{3}[.-][0-9]{4})(?!\w))"
    r"|(?P<CARD>(?<![\w.-])[0-9](?:[ -]?[0-9]){12,18}(?![\w-]))"
    r"|(?P<NAME>\b(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Señora?|Monsieur|Madame)\.? [A-ZÀ-Þ][\w'-]+(?: [A-ZÀ-Þ][\w'-]+)?)"
)
STRICT = {
    "EMAIL": re.compile(r"[A-Za-z0-9](?:[\w.+%-]*[A-Za-z0-9])?@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,24}"),
    "IP": re.compile(r"(?:(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])(?:\.(?!$)|$)){4}"),
    "IBAN": re.compile(r"[A-Z]{2}[0-9]{2}[A-Z0-9 ]{11,40}"),
    "SSN": re.compile(r"(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}"),
    "PHONE": re.compile(r"\+?[0-9]{0,3}[ .-]?\(?[0-9]{2,4}\)?[ .-]?[0-9]{2,4}(?:[ .-]?[0-9]{2,4}){1,3}"),
    "CARD": re.compile(r"[0-9]{13,19}|[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{1,7}|[0-9]{4}([ -])[0-9]{6}\2[0-9]{5}"),
    "NAME": re.compile(r"[^0-9]+"),
}
#: Gazetteers: top-level domains, calling codes, card issuers and given names.
DOMAINS = frozenset("com org net edu gov io co info biz me dev app uk de fr es it nl eu ch at be pt pl se no dk fi ie us ca au nz jp cn in br mx ar ru kr".split())
CALLING = ("1", "7", *"20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98 351 352 353 354 355 358 359 370 371 372 380 385 386 420 421 852 886 966 971 972".split())
ISSUER = re.compile(r"4|5[1-5]|2(?:22[1-9]|2[3-9]|[3-6]|7[01]|720)|3[47]|6011|65|64[4-9]|35|30[0-5]|36|38")
GIVEN = frozenset("james mary john patricia robert jennifer michael linda david elizabeth william barbara richard susan joseph jessica thomas sarah charles karen maria anna peter hans klaus jean pierre marie luis carlos ana juan josé laura paul anne julia martin thomas stefan andreas claire sophie antonio carmen".split())
FOR = re.compile(r"(?i)(e-?mail|mail|contact|write|reach|tel|phone|call|mobile|cell|fax|ip|host|address|client|card|visa|mastercard|amex|credit|iban|account|konto|compte|cuenta|ssn|social|name|signed|dear|mr|mrs|ms|dr|herr|frau|téléphone|telefon|teléfono|correo|courriel)\W*(?:\w+\W+){0,2}$")
AGAINST = re.compile(r"(?i)(?:(?:\bv|\bver|version|build|isbn|issn|order|ticket|invoice|serial|sku|part|hash|sha|md5|token|commit|page|fig|section|uuid|ref|test|sample|dummy)\W*(?:no|nr|id|number)?\W*|=\s*[\"']?)$")
LABELERS = ("strict_pattern", "checksum", "gazetteer", "cue_before", "counter_cue", "edges", "placeholder")
#: Kinds whose checksum every true span passes, and how often digits by chance do.
CHECKED = {"CARD": 0.1, "IBAN": 1 / 97}
#: Probability from which a span is personal data.
THRESHOLD = 0.5
SCHEMA = "doc_id long, start int, end int, kind string, score double"


def luhn(digits: str) -> bool:
    """Whether ASCII digits, one at least, have the check digit of cards."""
    if not digits:
        return False
    total = 0
    for k, c in enumerate(reversed(digits)):
        x = int(c) * (1 + k % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def mod97(iban: str) -> bool:
    text = iban[4:] + iban[:4]
    return int("".join(str(int(c, 36)) for c in text)) % 97 == 1


def votes(kind: str, span: str, before: str, after: str) -> tuple[int, ...]:
    """The vote of each of LABELERS on a candidate: 1 for, -1 against, 0 abstains."""
    digits = re.sub(r"[^0-9]", "", span)
    strict = 1 if STRICT[kind].fullmatch(span) else -1
    check = gazetteer = 0
    if kind == "CARD":
        check = 1 if luhn(digits) else -1
        gazetteer = 1 if ISSUER.match(digits) else -1
    elif kind == "IBAN":
        check = 1 if mod97(span.replace(" ", "")) else -1
    elif kind == "IP":
        parts = [int(x) for x in span.split(".")]
        check = -1 if max(parts) > 255 or parts[0] in (0, 10, 127) or parts[0] >= 240 or parts[:2] in ([192, 168], [169, 254]) or (parts[0] == 172 and 16 <= parts[1] < 32) else 1
    elif kind == "PHONE":
        check = 1 if 10 <= len(digits) <= 15 else -1
        gazetteer = (1 if digits.startswith(CALLING) else -1) if span[0] == "+" else 0
    elif kind == "EMAIL":
        gazetteer = 1 if span.rpartition(".")[2].lower() in DOMAINS else -1
        check = -1 if ".." in span else 1
    elif kind == "NAME":
        gazetteer = 1 if any(w.lower() in GIVEN for w in span.split()[1:]) else 0
    cue = 1 if FOR.search(before) else 0
    counter = -1 if AGAINST.search(before) else 0
    edges = -1 if (before[-1:].isalnum() or after[:1].isalnum()) else 1
    same = len(set(digits)) <= 2 if len(digits) > 5 else False
    run = digits in "01234567890123456789" or digits in "98765432109876543210" if len(digits) > 7 else False
    return strict, check, gazetteer, cue, counter, edges, (-1 if same or run else 0)


def candidates(text: str) -> Iterator[tuple[int, int, str, tuple[int, ...], int]]:
    """(start, end, kind, votes, shape) of every candidate, in characters; shape is a length class."""
    for m in CANDIDATE.finditer(text):
        start, end = m.span()
        kind = m.lastgroup
        yield start, end, kind, votes(kind, m.group(), text[max(0, start - 40) : start], text[end : end + 1]), min((end - start) // 8, 4)


def _may_hold(column: pa.Array) -> np.ndarray:
    """Rows that can hold a candidate: with an ASCII digit, an @ or a form of address, as CANDIDATE asks for."""
    return pc.fill_null(pc.match_substring_regex(column, r"[0-9@]|\b(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Señora?|Monsieur|Madame)\b"), False).to_numpy(zero_copy_only=False)


def _patterns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter = Counter()
    for piece in B.pieces(batches):
        text = piece.column("text")
        for value in text.filter(pa.array(_may_hold(text))):
            counts.update((kind, cast, shape) for _, _, kind, cast, shape in candidates(value.as_py()))
    kind, cast, shape = ([k[i] for k in counts] for i in range(3))
    yield pa.RecordBatch.from_arrays([pa.array(kind, pa.string()), pa.array([list(c) for c in cast], pa.list_(pa.int32())), pa.array(shape, pa.int32()), pa.array(list(counts.values()), pa.int64())], names=["kind", "votes", "shape", "n"])


def _features(kind: str, cast: tuple[int, ...], shape: int) -> np.ndarray:
    out = np.zeros(1 + len(KINDS) + 2 * len(LABELERS) + 5)
    out[0] = 1
    out[1 + KINDS.index(kind)] = 1
    for k, v in enumerate(cast):
        if v:
            out[1 + len(KINDS) + 2 * k + (v > 0)] = 1
    out[1 + len(KINDS) + 2 * len(LABELERS) + shape] = 1
    return out


@dataclass
class Model:
    """``correct[kind]`` has each labeler's estimated reliability (true votes for, true votes against); ``weights`` the classifier's."""

    prior: dict[str, float]
    correct: dict[str, np.ndarray]
    weights: np.ndarray

    def probability(self, kind: str, cast: tuple[int, ...], shape: int) -> float:
        return float(1 / (1 + np.exp(-_features(kind, cast, shape) @ self.weights)))


def expectation_maximisation(cast: np.ndarray, n: np.ndarray, rounds: int = 200, chance: float | None = None) -> tuple[float, np.ndarray, np.ndarray]:
    """Two-class model of conditionally independent votes on the distinct vote patterns ``cast`` with counts ``n``.

    Returns the prior, P(vote | class) as [labeler, class, vote + 1], and the
    posterior of each pattern. It starts at 80 % right votes and keeps these as
    pseudo-counts of 2 % of the candidates (2 at least), which also settles kinds
    with one pattern only. ``chance``: the checksum's rates are known and not estimated: a true span
    fails with the probability of a typing error, 0.002, and any other passes with this one.
    """
    labelers = cast.shape[1]
    # abstaining says nothing about the class at first
    start = np.tile(np.array([[0.8, 1.0, 0.2], [0.2, 1.0, 0.8]]) / 2, (labelers, 1, 1))
    at_check = LABELERS.index("checksum")
    # it never abstains on these kinds; room for that would let one class explain every span better
    known = None if chance is None else np.array([[1 - chance, 1e-9, chance], [0.002, 1e-9, 0.998]])
    if known is not None:
        start[at_check] = known
    theta, prior = start.copy(), 0.5
    strength = max(2.0, 0.02 * n.sum())
    posterior = np.full(len(n), 0.5)
    for _ in range(rounds):
        at = cast + 1
        logs = [np.log(theta[np.arange(labelers), y, at]).sum(axis=1) for y in (0, 1)]
        odds = logs[1] - logs[0] + np.log(prior / (1 - prior))
        now = 1 / (1 + np.exp(-np.clip(odds, -60, 60)))
        done = np.abs(now - posterior).max(initial=0) < 1e-9
        posterior = now
        if done:
            break
        for y, mass in ((0, n * (1 - posterior)), (1, n * posterior)):
            for v in range(3):
                theta[:, y, v] = ((at == v) * mass[:, None]).sum(axis=0) + strength * start[:, y, v]
            theta[:, y] /= theta[:, y].sum(axis=1, keepdims=True)
        if known is not None:
            theta[at_check] = known
        prior = ((n * posterior).sum() + 1) / (n.sum() + 2)
    return prior, theta, posterior


def train_classifier(x: np.ndarray, target: np.ndarray, n: np.ndarray, ridge: float = 0.1) -> np.ndarray:
    """Logistic weights by Newton's method on weighted soft labels."""
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (n * (target - p)) - ridge * w
        hessian = (x * (n * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(hessian, gradient)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(docs: DataFrame) -> Model | None:
    """The labelers' reliabilities and the span classifier, from the pattern counts of the whole corpus; None without candidates."""
    rows = bounded(docs).select(F.col("text").cast("string").alias("text")).mapInArrow(_patterns, "kind string, votes array<int>, shape int, n long").groupBy("kind", "votes", "shape").agg(F.sum("n").alias("n")).collect()
    return train([(r["kind"], tuple(r["votes"]), r["shape"], r["n"]) for r in rows])


def train(patterns: list[tuple[str, tuple[int, ...], int, int]]) -> Model | None:
    """``fit`` from (kind, votes, shape, count) rows."""
    if not patterns:
        return None
    patterns = sorted(patterns)
    target = np.zeros(len(patterns))
    n = np.array([p[3] for p in patterns], float)
    prior, correct = {}, {}
    for kind in KINDS:
        at = np.array([p[0] == kind for p in patterns])
        if at.any():
            prior[kind], theta, target[at] = expectation_maximisation(np.array([p[1] for p in patterns])[at], n[at], chance=CHECKED.get(kind))
            correct[kind] = np.stack([theta[:, 1, 2] / np.maximum(theta[:, 1, 2] + theta[:, 1, 0], 1e-12), theta[:, 0, 0] / np.maximum(theta[:, 0, 0] + theta[:, 0, 2], 1e-12)], axis=1)
    x = np.stack([_features(*p[:3]) for p in patterns])
    # kinds and votes meet in the posterior; their products keep the classifier as sharp
    return Model(prior, correct, train_classifier(x, target, n))


def spans(text: str, model: Model) -> list[tuple[int, int, str, float]]:
    """(start, end, kind, probability) of the personal data in a text."""
    found = []
    for start, end, kind, cast, shape in candidates(text):
        p = model.probability(kind, cast, shape)
        if p >= THRESHOLD:
            found.append((start, end, kind, p))
    return found


def redacted(text: str, model: Model) -> str:
    """The text with every span replaced by its kind in angle brackets."""
    out, at = [], 0
    for start, end, kind, _ in spans(text, model):
        out += [text[at:start], f"<{kind}>"]
        at = end
    return "".join([*out, text[at:]])


def pii_spans(docs: DataFrame) -> DataFrame:
    """``doc_id, start, end, kind, score`` of all personal data in ``docs(doc_id, text, ...)``, offsets in characters.

    Null and empty texts have none. Repeated rows report their spans once each, with
    their doc_id or null. Other columns are ignored. Without candidates the result is empty.
    """
    model = fit(docs)
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    if model is None:
        return docs.sparkSession.createDataFrame([], SCHEMA)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in B.pieces(batches):
            at = np.flatnonzero(_may_hold(piece.column("text")))
            texts = piece.column("text").take(pa.array(at)).to_pylist()
            found = [(k, *s) for k, text in zip(at, texts) for s in spans(text, model)]
            row, start, end, kind, p = zip(*found) if found else ((),) * 5
            yield pa.RecordBatch.from_arrays([piece.column("doc_id").take(pa.array(row, pa.int64())), pa.array(start, pa.int32()), pa.array(end, pa.int32()), pa.array(kind, pa.string()), pa.array(p, pa.float64())], names=["doc_id", "start", "end", "kind", "score"])

    return plain.mapInArrow(run, SCHEMA)


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with the personal data in ``text`` replaced by ``<KIND>``; a column ``n_chars`` is counted anew where the text changes. All rows and other columns stay as they are."""
    model = fit(docs)
    if model is None:
        return docs
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in B.pieces(batches):
            text = piece.column("text")
            at = np.flatnonzero(_may_hold(text))
            old = text.take(pa.array(at)).to_pylist()
            new = [redacted(t, model) for t in old]
            at = [int(k) for k, a, b in zip(at, old, new) if a != b]
            if at:
                mask = np.zeros(piece.num_rows, bool)
                mask[at] = True
                changed = [b for a, b in zip(old, new) if a != b]
                columns = list(piece.columns)
                columns[names.index("text")] = pc.replace_with_mask(text, pa.array(mask), pa.array(changed, text.type))
                if "n_chars" in names:
                    old_n = piece.column("n_chars")
                    columns[names.index("n_chars")] = pc.replace_with_mask(old_n, pa.array(mask), pa.array([len(t) for t in changed]).cast(old_n.type))
                piece = pa.RecordBatch.from_arrays(columns, schema=piece.schema)
            yield piece

    return docs.mapInArrow(run, docs.schema)
