"""The ten operators against brute-force versions, and on awkward tables."""

import itertools
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from metrilark.llm import chunking, decontaminate, license, packing, pii, quality, secrets, simhash, toxicity, wrappers
from metrilark.llm import _bytes as B
from pyspark.sql import functions as F

WORDS = [a + b for a in "bdfgklmnprst" for b in ("a", "en", "il", "or", "um")]
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def documents(spark, texts):
    return spark.createDataFrame([(k, t, "en", "s", len(t or "")) for k, t in enumerate(texts)], DOCS)


# --- 1 ---


def test_pii_reliabilities_and_spans(spark):
    rng = random.Random(1)
    valid = [c for k in range(1000) if pii.luhn((c := f"4539 1488 0343 {1000 + k}").replace(" ", ""))]
    cards = valid + [c[:-1] + str((int(c[-1]) + 1) % 10) for c in valid[:30]]
    texts = [f"{prose(rng, 6)} mail {rng.choice(WORDS)}.{k}@{rng.choice(WORDS)}.com {prose(rng, 3)} call +1 415-555-{1000 + k} now" for k in range(60)] + [f"version 10.0.0.{k} {prose(rng, 5)}" for k in range(30)] + [f"card {c} here" for c in cards]
    found = pii.pii_spans(documents(spark, texts)).collect()
    text_of = lambda r: texts[r["doc_id"]][r["start"] : r["end"]]
    assert sum(r["kind"] == "EMAIL" for r in found) == 60 and all("@" in text_of(r) for r in found if r["kind"] == "EMAIL")
    assert sum(r["kind"] == "PHONE" for r in found) == 60
    assert {text_of(r) for r in found if r["kind"] == "CARD"} == set(valid)
    clean = {r["doc_id"]: r["text"] for r in pii.redact(documents(spark, texts)).collect()}
    assert "@" not in clean[0] and "<EMAIL>" in clean[0]


def test_em_recovers_reliability():
    rng = np.random.default_rng(3)
    truth = rng.random(4000) < 0.4
    cast = np.stack([np.where(rng.random(4000) < p, np.where(truth, 1, -1), np.where(truth, -1, 1)) for p in (0.9, 0.85, 0.8, 0.7, 0.7, 0.75, 0.8)], axis=1)
    patterns, inverse, n = np.unique(cast, axis=0, return_inverse=True, return_counts=True)
    prior, theta, posterior = pii.expectation_maximisation(patterns, n.astype(float))
    assert abs(prior - 0.4) < 0.05 and abs(theta[0, 1, 2] - 0.9) < 0.05
    assert ((posterior[inverse.ravel()] > 0.5) == truth).mean() > 0.93


# --- 2 ---


def test_simhash_against_brute_force(spark):
    rng = random.Random(2)
    texts = []
    for _ in range(60):
        base = prose(rng, 120).split()
        for _ in range(rng.randint(1, 4)):
            copy = list(base)
            for _ in range(rng.randint(0, 6)):
                copy[rng.randrange(len(copy))] = rng.choice(WORDS)
            texts.append(" ".join(copy))
    prints, _ = simhash.fingerprints(pa.array(texts))
    distance = np.bitwise_count(prints[:, None] ^ prints[None]).sum(axis=2)
    a, b = np.nonzero(np.triu(distance <= simhash.MAX_DISTANCE, 1))
    label = simhash.forest(len(texts), a, b)
    group = {r["doc_id"]: r["group_id"] for r in simhash.near_duplicates(documents(spark, texts)).collect()}
    together = [group.get(x, -1 - x) == group.get(y, -1 - y) for x, y in zip(a.tolist(), b.tolist())]
    assert np.mean(together) >= 0.9
    assert all(label[d] == label[g] for d, g in group.items())
    for d, width in ((16, 16),):
        w, bands = simhash.plan_bands(10**6)
        alone = np.prod([(128 - d - k) / (128 - k) for k in range(w)])
        assert 1 - (1 - alone) ** bands >= 0.9


def test_simhash_finds_every_pair(spark):
    rng = random.Random(6)
    texts = []
    for _ in range(250):
        base = [f"{rng.choice(WORDS)}{rng.randrange(1000)}" for _ in range(120)]
        other = list(base)
        for k in rng.sample(range(120), rng.randint(6, 16)):
            other[k] = f"{rng.choice(WORDS)}{rng.randrange(1000)}"
        texts += [" ".join(base), " ".join(other)]
    prints, _ = simhash.fingerprints(pa.array(texts))
    distance = np.bitwise_count(prints[:, None] ^ prints[None]).sum(axis=2)
    a, b = np.nonzero(np.triu(distance <= simhash.MAX_DISTANCE, 1))
    assert (distance[a, b] >= simhash.MAX_DISTANCE - 3).sum() > 40
    label = simhash.forest(len(texts), a, b)
    wanted = {d: int(label[d]) for d in {*a.tolist(), *b.tolist()}}
    docs = documents(spark, texts)
    assert {r["doc_id"]: r["group_id"] for r in simhash.near_duplicates(docs).collect()} == wanted
    split = {r["doc_id"]: r["group_id"] for r in simhash.near_duplicates(docs, shard_rows=100).collect()}
    assert split == wanted


def test_components_in_rounds_and_in_one_task(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(1, 20)] + [(30, 25), (40, 30), (25, 30)], "a long, b long")
    wanted = {**dict.fromkeys(range(1, 21), 1), **dict.fromkeys((25, 30, 40), 25)}
    for one_task in (0, 100):
        assert {r["doc_id"]: r["group_id"] for r in simhash.components(edges, one_task).collect()} == wanted


@pytest.mark.parametrize("count", [100, 10**5, 10**6, 15 * 10**6])
def test_cover_meets_every_difference(count):
    rng = np.random.default_rng(7)
    for most in (0, 1, 5, 16):
        blocks = simhash.cover(count, most)
        assert sum(radius + 1 for _, radius in blocks) == most + 1
        for _ in range(200):
            differ = rng.choice(128, most, replace=False)
            assert any(np.isin(own, differ).sum() <= radius for own, radius in blocks)


@pytest.mark.parametrize(("count", "prefix"), [(2000, 0), (10**5, 3), (15 * 10**6, 4)])
def test_shards_hold_every_pair(count, prefix):
    rng = np.random.default_rng(8)
    base = rng.integers(0, 1 << 64, (400, 2), dtype=np.uint64)
    other = base.copy()
    for row in other:
        for bit in rng.choice(128, rng.integers(12, 20), replace=False):
            row[bit // 64] ^= np.uint64(1) << np.uint64(bit % 64)
    prints = np.concatenate([base, other])
    blocks = simhash.cover(count)
    batch = pa.table({"doc_id": np.arange(800), "f0": prints[:, 0].view(np.int64), "f1": prints[:, 1].view(np.int64)}).to_batches()
    rows = pa.Table.from_batches(list(simhash._shard_rows(iter(batch), blocks, prefix)))
    shard = rows.column("shard").to_numpy()
    edges = [simhash._shard_edges(rows.filter(pa.array(shard == s)), blocks, prefix, 16) for s in np.unique(shard)]
    ours = simhash.forest(800, *(np.concatenate([e.column(c).to_numpy() for e in edges]) for c in ("a", "b")))
    a, b = np.nonzero(np.triu(np.bitwise_count(prints[:, None] ^ prints[None]).sum(axis=2) <= 16, 1))
    assert len(a) > 150 and (ours == simhash.forest(800, a, b)).all()


def test_gray_index_is_exact():
    rng = np.random.default_rng(4)
    base = rng.integers(0, 1 << 63, (40, 2)).astype(np.uint64)
    rows = np.repeat(base, 10, axis=0)
    for row in rows:
        for bit in rng.integers(0, 128, rng.integers(0, 14)):
            row[bit // 64] ^= np.uint64(1) << np.uint64(bit % 64)
    rank = simhash._gray_rank(rows)
    rows = np.ascontiguousarray(rows[np.lexsort((rank[:, 1], rank[:, 0]))])
    index = simhash.GrayIndex(rows, np.array([0]), np.zeros((1, 2), np.uint64))
    pairs = list(index.self_join(np.zeros(len(rows), np.int64), 16))
    ours = simhash.forest(len(rows), np.concatenate([p for p, _ in pairs]), np.concatenate([q for _, q in pairs]))
    a, b = np.nonzero(np.triu(np.bitwise_count(rows[:, None] ^ rows[None]).sum(axis=2) <= 16, 1))
    assert (ours == simhash.forest(len(rows), a, b)).all()


# --- 3 ---


def least_bins(sizes, capacity):
    best = len(sizes)

    def place(k, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if k == len(sizes):
            best = len(rooms)
            return
        for i in {r: i for i, r in enumerate(rooms) if r >= sizes[k]}.values():
            place(k + 1, rooms[:i] + [rooms[i] - sizes[k]] + rooms[i + 1 :])
        place(k + 1, [*rooms, capacity - sizes[k]])

    place(0, [])
    return best


def test_packing_reduction_is_optimal():
    rng = random.Random(6)
    for _ in range(150):
        capacity = rng.randint(6, 20)
        sizes = sorted((rng.randint(1, capacity) for _ in range(rng.randint(1, 9))), reverse=True)
        histogram = {w: sizes.count(w) for w in sizes}
        fixed, rest = packing.reduce_dominated(histogram, capacity)
        left = [w for w, n in rest.items() for _ in range(n)]
        assert sum(g.count for g in fixed) + least_bins(sorted(left, reverse=True), capacity) == least_bins(sizes, capacity)


def test_packing_places_every_word_once(spark):
    rng = random.Random(7)
    texts = [prose(rng, rng.choice([0, 1, 3, 60, 500, 1500, 2048, 5000])) for _ in range(120)]
    rows = packing.pack(documents(spark, texts)).collect()
    used = {}
    for r in rows:
        used.setdefault(r["bin_id"], []).append((r["bin_offset"], r["length"]))
    for spans in used.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= packing.CAPACITY
    per = {}
    for r in rows:
        per[r["doc_id"]] = per.get(r["doc_id"], 0) + r["length"]
    assert per == {k: len(t.split()) for k, t in enumerate(texts) if t.split()}


# --- 4 ---


def test_chunks_against_a_loop(spark):
    rng = random.Random(8)
    texts = [prose(rng, n) for n in (0, 5, 400, 3000)]

    def loop(raw):
        ends, start = [], 0
        while start < len(raw):
            end = min(start + chunking.MAX_BYTES, len(raw))
            for at in range(start + chunking.MIN_BYTES, end):
                h = sum(int(chunking._GEAR[raw[at - 1 - k]]) << k for k in range(32)) & 0xFFFFFFFF
                if h & int(chunking.STRICT if at < start + chunking.NORMAL_BYTES else chunking.LOOSE) == 0:
                    end = at
                    break
            ends.append((start, end))
            start = end
        return ends

    starts, ends, rows = chunking.boundaries(*B.text_buffer(pa.array(texts)))
    base = np.concatenate(([0], np.cumsum([len(t.encode()) for t in texts])))
    for k, t in enumerate(texts):
        got = [(int(s - base[k]), int(e - base[k])) for s, e, r in zip(starts, ends, rows) if r == k]
        assert got == loop(t.encode())
    shifted = "A few words more. " + texts[3]
    out = {r["doc_id"]: r for r in chunking.fingerprints(documents(spark, [texts[3], shifted, texts[2]])).collect()}
    assert out[1]["container_id"] == 0 and out[1]["container_share"] > 0.9 and out[2]["container_id"] is None


def test_containment_pairs_against_brute_force(spark):
    rng = random.Random(9)
    base = prose(rng, 800)
    texts = [base, base + " " + prose(rng, 200), prose(rng, 800), base[: len(base) // 2]]
    digests = {}
    for r in chunking.chunk_digests(documents(spark, texts)).collect():
        digests.setdefault(r["doc_id"], {})[r["digest"]] = r["bytes"]
    wanted = {(a, b) for a, b in itertools.permutations(digests, 2) if sum(v for d, v in digests[a].items() if d in digests[b]) >= 0.7 * sum(digests[a].values())}
    assert {(r["doc_id"], r["container_id"]) for r in chunking.containment_pairs(documents(spark, texts), 0.7).collect()} == wanted


def test_fingerprints_give_all_containers(spark):
    rng = random.Random(10)
    part = [prose(rng, 1500) for _ in range(4)]
    whole = part[0] + " " + part[1]
    texts = [part[0], whole, whole, part[0] + " " + part[2], part[0], prose(rng, 900), part[3], part[3] + " " + part[1], part[2] + " " + part[0] + " " + part[3]]
    docs = documents(spark, texts)
    sets = {}
    for r in chunking.chunk_digests(docs).collect():
        sets.setdefault(r["doc_id"], {})[r["digest"]] = r["bytes"]
    share = {(a, b): sum(v for d, v in sets[a].items() if d in sets[b]) / sum(sets[a].values()) for a, b in itertools.permutations(sets, 2)}
    out = {r["doc_id"]: r for r in chunking.fingerprints(docs).collect()}
    members = {}
    for r in out.values():
        members.setdefault(r["group_id"], []).append(r["doc_id"])
    pairs = {(a, b): c["share"] for a, r in out.items() for c in r["containers"] for b in members[out[c["container_id"]]["group_id"]] if a != b}
    assert pairs == pytest.approx({k: v for k, v in share.items() if v >= chunking.LEAST}) and len(pairs) > 12
    for a, r in out.items():
        best = max(v for k, v in share.items() if k[0] == a)
        if best >= chunking.LEAST:
            assert (r["container_id"], r["container_share"]) == (min(b for (x, b), v in share.items() if x == a and v == best), pytest.approx(best))
    assert out[1]["container_id"] == 2 and out[2]["container_id"] == 1 and out[5]["container_id"] is None


def test_containers_are_not_shuffled(spark, capsys):
    rng = random.Random(12)
    passage, other = prose(rng, 150), prose(rng, 150)
    texts = [passage] * 30 + [f"{passage} {prose(rng, 3)} {other}" for _ in range(20)] + [other] * 10
    out = chunking.fingerprints(documents(spark, texts))
    out.explain(mode="formatted")
    moved = [n for n in re.split(r"\n\(\d+\) ", capsys.readouterr().out) if n.startswith("Exchange")]
    assert moved and not [n for n in moved if "holders#" in n]
    rows = {r["doc_id"]: r for r in out.collect()}
    assert all(rows[0]["containers"][1:] == rows[k]["containers"][1:] for k in range(30)) and len(rows[0]["containers"]) > 1


def test_searches_against_a_loop():
    rng = random.Random(13)
    groups = [(h, sorted((rng.randint(2, 9), (rng.getrandbits(50) << 8) | rng.randint(16, 128), rng.randint(100, 104)) for _ in range(n)), rng.randint(200, 3000)) for h, n in enumerate((1, 40, 3, 90, 7))]
    items = pa.list_(pa.struct([("df", pa.int32()), ("key", pa.int64()), ("holder", pa.int64())]))
    rows = [{"head": h, "items": [dict(zip(("df", "key", "holder"), i)) for i in own], "least_bytes": n} for h, own, n in groups]
    batch = pa.RecordBatch.from_pylist(rows, pa.schema([("head", pa.int64()), ("items", items), ("least_bytes", pa.int64())]))
    for part, some in ((batch, groups), (batch.slice(2, 2), groups[2:4]), (batch.slice(0, 0), [])):
        got = [tuple(r.values()) for b in chunking._searches(iter([part]), 0.5) for r in b.to_pylist()]
        wanted = []
        for h, own, n in some:
            held, before, credit = sum(k & 255 for _, k, _ in own), 0, {}
            for _, k, holder in own:
                if before <= held - 0.5 * n:
                    wanted.append((h, k, None))
                before += k & 255
                credit[holder] = credit.get(holder, 0) + (k & 255)
            wanted.append((h, None, min(credit, key=lambda c: (-credit[c], c))))
        assert sorted(got, key=str) == sorted(wanted, key=str)


def test_short_passages_and_edited_copies_share_chunks(spark):
    rng = random.Random(11)
    texts = []
    for _ in range(40):
        passage, base = prose(rng, 50), prose(rng, 200).split()
        texts += [f"{prose(rng, 100)} {passage} {prose(rng, 100)}", f"{prose(rng, 130)} {passage} {prose(rng, 70)}", " ".join(base), " ".join(rng.choice(WORDS) if k % 40 == 7 else w for k, w in enumerate(base))]
    out = {r["doc_id"]: r for r in chunking.fingerprints(documents(spark, texts)).collect()}
    assert sum(out[k]["container_id"] == k + 1 for k in range(0, 160, 4)) >= 36
    assert sum(out[k + 3]["container_id"] == k + 2 and out[k + 3]["container_share"] > 0.3 for k in range(0, 160, 4)) >= 36


# --- 5 ---


def test_secrets_against_re():
    rng = random.Random(10)
    rules = {k: secrets.RULES[k] for k in ("aws_access_key", "github_token", "npm_token", "json_web_token", "slack_token")}
    alnum = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    token = lambda n, s=alnum: "".join(rng.choice(s) for _ in range(n))
    texts = []
    for _ in range(80):
        parts = [prose(rng, rng.randint(0, 200))]
        for _ in range(rng.randint(0, 3)):
            parts.append(rng.choice([f"AKIA{token(16, alnum[:26] + alnum[52:])}", f"ghp_{token(36)}", f"npm_{token(35)}", f"npm_{token(36)}", f"eyJ{token(9)}.{token(12)}.{token(10)}", f"xoxb-{token(12)}", f"xghp_{token(36)}", "日本AKIA" + token(16, alnum[:26])]))
        texts.append(rng.choice([" ", "\n", ", "]).join(parts))
    found = {(r, secrets.scanner(rules).names[k], s, e) for r, k, s, e in secrets.scanner(rules).find(pa.array(texts))}
    wanted = set()
    for r, t in enumerate(texts):
        for name, rule in rules.items():
            for m in re.finditer(rb"(?<![A-Za-z0-9_-])(?:" + rule.encode() + rb")(?![A-Za-z0-9_-])", t.encode()):
                wanted.add((r, name, *m.span()))
    assert found == wanted and len(found) > 40


# --- 6 ---


def test_quality_held_out_accuracy(spark):
    rng = random.Random(11)
    texts, labels = [], []
    for k in range(600):
        good = k % 3 > 0
        words = [rng.choice(WORDS + quality.FUNCTION_WORDS * 2) for _ in range(rng.randint(20, 80))]
        texts.append(" ".join(words).capitalize() + "." if good else "!! ".join(w.upper() for w in words))
        labels.append((k, int(good)))
    docs = documents(spark, texts)
    out = {r["doc_id"]: r for r in quality.quality(docs, spark.createDataFrame(labels[:400], "doc_id long, quality int")).collect()}
    assert np.mean([out[k]["keep"] == bool(y) for k, y in labels[400:]]) > 0.95 and len(out) == 600


def test_fourier_features_approximate_the_kernel():
    rng = np.random.default_rng(12)
    d = len(quality.STATISTICS)
    f = quality.Features.make(np.zeros(d), np.ones(d), 4000, 3.0)
    x = rng.standard_normal((20, d))
    z = f.of(x)[:, :-1]
    gauss = np.exp(-((x[:, None] - x[None]) ** 2).sum(axis=2) / (2 * 9))
    assert np.abs(z @ z.T - gauss).max() < 0.1


# --- 7 ---


def test_matches_against_brute_force(spark):
    rng = random.Random(13)
    items = [prose(rng, n) for n in (20, 40, 9, 5, 30)]
    texts = [prose(rng, 60) for _ in range(12)]
    texts[1] += " " + items[0].upper()
    texts[2] = items[1][:150] + " " + texts[2]
    texts[3] += ". " + items[2] + " end"
    texts[4] += " " + items[3]
    words = lambda t: B.WORD.findall(t.lower())

    def longest(a, b):
        row, best = [0] * (len(b) + 1), 0
        for x in a:
            row = [0] + [row[j] + 1 if x == y else 0 for j, y in enumerate(b)]
            best = max(best, *row)
        return best

    wanted = {}
    for (d, t), (i, item) in itertools.product(enumerate(texts), enumerate(items)):
        n, need = longest(words(t), words(item)), min(decontaminate.MIN_WORDS, len(words(item)))
        if len(words(item)) >= decontaminate.LEAST_ITEM and n >= need:
            wanted[d, i] = n
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["words"] for r in decontaminate.matches(documents(spark, texts), bench).collect()}
    assert got == wanted and len(wanted) == 3
    assert sorted(r["doc_id"] for r in decontaminate.drop_contaminated(documents(spark, texts), bench).collect()) == [k for k in range(12) if k not in {d for d, _ in wanted}]


# --- 8 ---


def test_wrappers(spark):
    page = lambda items, body, extra="": f'<html><body><nav><a href="/x">Home</a></nav><ul>{"".join(f"<li>{i}</li>" for i in items)}</ul>{extra}<p>{body}</p><div class="ad">{body[:3]}</div><i>Copyright &amp; more</i></body></html>'
    rows = [(0, "http://a.org/1", page("ab", "First body")), (1, "http://A.org/2", page("cde", "Second <b>bold</b> body", "<h2>Only here</h2>")), (2, "http://a.org/3", page("f", "Third")), (3, "http://b.org/1", page("xy", "Alone")), (4, None, None), (5, "http://b.org/2", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    regex = {r["host"]: r["regex"] for r in wrappers.wrappers(pages).collect()}
    assert "( <li> #TEXT </li> )+" in regex["a.org"] and '"Copyright & more"' in regex["a.org"] and "( <h2> #TEXT </h2> )?" in regex["a.org"]
    out = {r["page_id"]: r for r in wrappers.extract(pages).collect()}
    assert out[1]["text"] == "c\nd\ne\nOnly here\nSecond bold body" and out[0]["text"] == "a\nb\nFirst body"
    assert "Home" in [f["text"] for f in out[3]["fields"]] and out[3]["text"].endswith("Copyright & more")
    assert out[4]["text"] == "" and out[5]["fields"] == [] and out[5]["wrapper"] is None


def test_fold_keeps_the_stream():
    rng = random.Random(14)
    for _ in range(200):
        keys = [rng.choice(["<a", "</a", "#", "<b"]) for _ in range(rng.randint(0, 40))]
        nodes = wrappers.fold(keys)
        assert sorted(i for s in wrappers._slots(nodes) for i in s) == [i for i, k in enumerate(keys) if k == "#"]
        pattern = " ".join(n[0] for n in nodes)
        regular = "".join("(?:" if w == "(" else ")+" if w == ")+" else re.escape(w + " ") for w in pattern.split())
        assert re.fullmatch(regular, "".join(k + " " for k in keys))


# --- 9 ---


def test_neighbours_are_exact():
    rng = random.Random(15)
    texts = [prose(rng, rng.randint(1, 40)) for _ in range(300)]
    vocabulary = np.sort(np.array([B.hash_text(w) for w in WORDS], np.uint64))
    row, term, count = toxicity.term_counts(pa.array(texts), vocabulary)
    idf = np.random.default_rng(1).uniform(0.5, 3, len(vocabulary))
    index = toxicity.BlockMaxIndex.build(vocabulary, idf, np.arange(300), np.zeros(300), row, term.astype(np.int64), count)
    dense = np.zeros((300, len(vocabulary)))
    dense[row, term.astype(np.int64)] = (1 + np.log(count)) * idf[term.astype(np.int64)]
    dense /= np.linalg.norm(dense, axis=1, keepdims=True)
    asked = texts[:40] + [texts[3] + " " + texts[4], "", "unknown"]
    for size in (300, 40, 1):  # some queries alone, some together
        for at in range(0, len(asked), size):
            some = asked[at : at + size]
            r, t, n = toxicity.term_counts(pa.array(some), vocabulary)
            w = index.weights(r, t.astype(np.int64), n, len(some))
            near, cosine = index.nearest(r, t.astype(np.int64), w, len(some), 10)
            q = np.zeros((len(some), len(vocabulary)))
            q[r, t.astype(np.int64)] = w
            full = np.round(q @ dense.T, 10)
            for k in range(len(some)):
                wanted = [i for i in np.lexsort((np.arange(300), -full[k]))[:10] if full[k, i] > 0]
                assert near[k][near[k] >= 0].tolist() == wanted and np.allclose(cosine[k][: len(wanted)], full[k, wanted])


def test_toxicity_against_brute_force(spark):
    rng = random.Random(18)
    bad = ["vilk", "snarf", "grolt", "drozz"]
    texts = [prose(rng, rng.randint(3, 25)) + (" " + " ".join(rng.choices(bad, k=3)) if k % 3 == 0 else "") for k in range(240)]
    texts[5:10], texts[50], texts[200] = [texts[6]] * 5, "", None  # ties between copies
    toxic = {k: int((k % 3 == 0) != (k % 17 == 0)) for k in range(180)}
    labels = spark.createDataFrame(list(toxic.items()), "doc_id long, toxic int")
    split = labels.select("doc_id", (F.pmod(F.xxhash64(F.lit(12), "doc_id"), F.lit(3)) == 0).alias("held")).collect()
    held, searched = [r["doc_id"] for r in split if r["held"]], sorted(r["doc_id"] for r in split if not r["held"])
    words = [(t or "").split() for t in texts]
    vocabulary = {w for d in searched for w in words[d]}
    df = {w: sum(w in ws for ws in words) for w in vocabulary}
    asked_of = [d for d in searched if texts[d]]

    def ratio(w):
        cells = [[sum((w in words[d]) == has and toxic[d] == y for d in asked_of) for y in (0, 1)] for has in (True, False)]
        return 2 * sum(n * np.log(n * len(asked_of) / (sum(row) * sum(r[y] for r in cells))) for row in cells for y, n in enumerate(row) if n)

    gain = {w: (1 + ratio(w) / toxicity.GAIN) ** 0.5 for w in vocabulary}

    def vector(d):
        v = {w: (1 + np.log(words[d].count(w))) * np.log((1 + len(texts)) / df[w]) * gain[w] for w in set(words[d]) & vocabulary}
        norm = sum(x * x for x in v.values()) ** 0.5
        return {w: x / norm for w, x in v.items()}

    vectors = [vector(d) for d in range(len(texts))]

    def ask(d):
        cosines = [(round(sum(x * vectors[e].get(w, 0) for w, x in vectors[d].items()), 10), -e) for e in searched if e != d]
        near = [(-e, c) for c, e in sorted(cosines, reverse=True)[: toxicity.NEIGHBOURS] if c > 0]
        return near, sum(c * toxic[e] for e, c in near) / sum(c for _, c in near) if near else -1.0

    asked = [(ask(d)[1], toxic[d]) for d in held]
    share = {y: sum(v == y for v in toxic.values()) / sum(y == t for _, t in asked) for y in (0, 1)}
    knots = sorted({v for v, _ in asked})
    mean = lambda i, j: (lambda w: sum(a * b for a, b in w) / sum(a for a, _ in w))([(share[t], t) for v, t in asked if knots[i] <= v <= knots[j]])
    fit = [max(min(mean(i, j) for j in range(k, len(knots))) for i in range(k + 1)) for k in range(len(knots))]
    out = {r["doc_id"]: r for r in toxicity.toxicity(documents(spark, texts), labels).collect()}
    for d in range(len(texts)):
        near, vote = ask(d)
        assert [(e["doc_id"], round(e["similarity"], 9), e["toxic"]) for e in out[d]["evidence"]] == [(e, pytest.approx(c, abs=2e-9), toxic[e] == 1) for e, c in near]
        score = np.interp(vote, knots, fit)
        assert out[d]["toxic_score"] == pytest.approx(score, abs=1e-6) and out[d]["toxic"] == (out[d]["toxic_score"] >= toxicity.THRESHOLD)
    assert {e["doc_id"] for e in out[6]["evidence"]} >= {x for x in range(5, 10) if x in searched and x != 6}


def test_toxicity_held_out(spark):
    rng = random.Random(16)
    bad = ["vilk", "snarf", "grolt", "drozz"]
    texts = [prose(rng, 30) + (" " + " ".join(rng.choices(bad, k=5)) if k % 4 == 0 else "") for k in range(400)]
    labels = spark.createDataFrame([(k, int(k % 4 == 0)) for k in range(300)], "doc_id long, toxic int")
    out = {r["doc_id"]: r["toxic"] for r in toxicity.toxicity(documents(spark, texts), labels).collect()}
    assert np.mean([out[k] == (k % 4 == 0) for k in range(300, 400)]) > 0.97


# --- 10 ---


def test_licenses_against_brute_force(spark):
    rng = random.Random(17)
    lines = [prose(rng, 8) for _ in range(4)]
    mit = license.TEMPLATES["MIT"][2].replace("granted", "given")
    texts = ["\n".join([lines[0], mit, lines[1]]), "\n".join([lines[2], "Released under the MIT License."]), "\n".join(lines), mit + "\n\n" + license.TEMPLATES["ISC"][0], lines[0] + " Released under the MIT License, see below. " + lines[1], "Copyright 2020 X. Licensed under the MIT License. All rights reserved.", license._BSD.replace("\n", " ") + " " + lines[0]]
    got = {(r["doc_id"], r["license"], r["first_line"], r["last_line"]): r["dice"] for r in license.licenses(documents(spark, texts)).collect()}
    for d, text in enumerate(texts):
        words = [(w, k) for k, x in enumerate(text.split("\n")) for w in license.tokens(x)]
        runs = []
        for n, ts in license.TEMPLATES.items():
            for t in ts:
                wanted = license.bigrams(license.tokens(t))
                for i in range(len(words)):
                    run, hits = set(), 0
                    for j in range(i + 1, min(len(words), i + 3 * len(wanted))):
                        pair = (words[j - 1][0], words[j][0])
                        hits += pair in wanted and pair not in run
                        run.add(pair)
                        score = 2 * hits / (len(run) + len(wanted))
                        if score >= license.LEAST:
                            runs.append((score, i, j, n))
        taken = []
        for score, i, j, name in sorted(runs, key=lambda r: (-r[0], r[2] - r[1], r[1], r[3])):
            if all(j < a or i > b for _, a, b, _ in taken):
                taken.append((name, i, j, score))
        assert {k[1:]: v for k, v in got.items() if k[0] == d} == pytest.approx({(n, words[i][1], words[j][1]): s for n, i, j, s in taken})
    assert {k[1] for k in got if k[0] in (4, 5)} == {"MIT"} and {k[1] for k in got if k[0] == 6} == {"BSD-2-Clause"}


def test_pii_digits_of_other_scripts(spark):
    assert not pii.luhn("") and pii.luhn("4539148803436467") and pii.luhn("0")
    assert not list(pii.candidates("card ４１１１１１１１１１１１１１１１ and 5"))
    texts = ["card ４５３９１４８８０３４３６４６７", "card 4539 1488 0343 6467 and ４１１１１１１１１１１１１１１１", "", None]
    assert {r["doc_id"] for r in pii.pii_spans(documents(spark, texts)).collect()} <= {1}


# --- awkward tables ---


def every_operator(spark, docs):
    labels = spark.createDataFrame([(0, 1, 0), (1, 0, 1), (1, 0, 1), (2, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([(0, "one two three four five six seven eight nine ten"), (None, None), (1, "")], "item_id long, text string")
    pages = docs.select(F.col("doc_id").alias("page_id"), F.lit("http://h.org/").alias("url"), F.col("text").alias("html"), "label")
    return {
        "pii": pii.pii_spans(docs),
        "simhash": simhash.near_duplicates(docs),
        "packing": packing.pack(docs),
        "chunking": chunking.fingerprints(docs),
        "secrets": secrets.secrets(docs),
        "quality": quality.quality(docs, labels),
        "matches": decontaminate.matches(docs, bench),
        "wrappers": wrappers.extract(pages),
        "toxicity": toxicity.toxicity(docs, labels),
        "licenses": license.licenses(docs),
        "drop_toxic": toxicity.drop_toxic(docs, labels),
        "drop_near": simhash.drop_near_duplicates(docs),
        "drop_contaminated": decontaminate.drop_contaminated(docs, bench),
        "redact": pii.redact(docs),
    }


def test_awkward_tables(spark):
    text = "one two three four five six seven eight nine ten. Mail a.b@example.com"
    rows = [(0, text, "x", "y"), (0, text, "x", "y"), (None, text, None, None), (1, None, None, None), (2, "", None, None), (3, " \n\t", None, None), (4, "日本語 " * 30000, None, None), (5, text, "", "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, label string, f0 string").withColumns({c: F.lit("clash") for c in ("_gone", "bucket", "score", "host", "digest", "head", "key", "n", "words", "group_id")})
    out = {k: v.collect() for k, v in every_operator(spark, docs).items()}
    assert sorted(r["doc_id"] for r in out["simhash"]) == [0, 5] and {r["group_id"] for r in out["simhash"]} == {0}
    assert len(out["quality"]) == len(out["toxicity"]) == len(out["wrappers"]) == len(rows)
    assert all(r["quality"] == 0 and not r["keep"] for r in out["quality"] if r["doc_id"] in (1, 2, 3))
    assert sum(r["length"] for r in out["packing"] if r["doc_id"] == 4) == 30000
    assert sorted((r["doc_id"] is None, r["doc_id"]) for r in out["matches"] if r["item_id"] == 0) == [(False, 0), (False, 0), (False, 5), (True, None)]
    assert sorted(r["doc_id"] for r in out["drop_contaminated"]) == [1, 2, 3, 4]
    assert [r["doc_id"] for r in out["drop_near"]].count(5) == 0 and len(out["drop_near"]) == 7
    assert len(out["redact"]) == len(rows) and out["redact"][0].asDict().keys() == out["drop_toxic"][0].asDict().keys()
    empty = {k: v.collect() for k, v in every_operator(spark, docs.where("false")).items()}
    assert all(not v for v in empty.values()), {k: v for k, v in empty.items() if v}
