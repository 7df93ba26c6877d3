"""The pipeline's stages after one another, and against the operators they call."""

from pathlib import Path

import pytest

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="needs the tables")


def test_stages(spark):
    import corpus_pipeline as p
    from metrilark.llm import decontaminate, packing, pii, simhash, toxicity

    read = lambda t: spark.read.parquet(f"{SF}/{t}.parquet")
    docs = read("documents")
    names = docs.columns
    toxic = {r["doc_id"] for r in toxicity.toxicity(docs, read("labels")).where("toxic").collect()}
    for k, (_, stage) in enumerate(p.STAGES[:4]):
        before = {r["doc_id"]: r["text"] for r in docs.collect()}
        if k == 1:
            gone = {r["doc_id"] for r in simhash.near_duplicates(docs).where("NOT kept").collect()}
        elif k == 2:
            gone = {r["doc_id"] for r in decontaminate.matches(docs, read("benchmark")).collect()}
        else:
            gone = toxic if k == 0 else set()
        model = pii.fit(docs) if k == 3 else None
        docs = stage(spark, docs, SF).cache()
        assert docs.columns == names
        after = {r["doc_id"]: r["text"] for r in docs.collect()}
        assert after.keys() == before.keys() - gone
        assert after == {d: pii.redacted(before[d], model) if model else before[d] for d in after}
    out = p.STAGES[4][1](spark, docs, SF)
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, packing.pack(docs).collect()))
    assert p.run(spark, SF).count() == out.count()


def test_near_duplicates_all_go(spark):
    import random

    import corpus_pipeline as p
    import numpy as np
    import pyarrow as pa
    from metrilark.llm import simhash

    rng = random.Random(9)
    word = lambda: f"w{rng.randrange(10**5)}"
    texts = []
    for _ in range(250):
        base = [word() for _ in range(120)]
        other = list(base)
        for k in rng.sample(range(120), rng.randint(6, 16)):
            other[k] = word()
        texts += [" ".join(base), " ".join(other)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = sorted(r["doc_id"] for r in p.STAGES[1][1](spark, docs, SF).collect())
    prints, _ = simhash.fingerprints(pa.array([texts[k] for k in kept]))
    distance = np.bitwise_count(prints[:, None] ^ prints[None]).sum(axis=2)
    assert len(kept) < 450 and not np.triu(distance <= simhash.MAX_DISTANCE, 1).any()


def test_few_links_need_no_rounds(spark, monkeypatch):
    from metrilark.llm import simhash

    cuts = []
    monkeypatch.setattr(simhash, "cut", lambda df, cut=simhash.cut: cuts.append(df) or cut(df))
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert simhash.near_duplicates(docs).count() > 2
    assert len(cuts) == 3
