"""Row ids over several files, and the readers' helpers."""

import json

import pytest
from metrilark.sources import readers


def test_row_ids_follow_files(spark, tmp_path):
    for name, n in (("a", 1), ("b", 50), ("c", 3000)):
        (tmp_path / f"{name}.jsonl").write_text("".join(json.dumps({"file": name, "k": k}) + "\n" for k in range(n)))
    rows = sorted((r["row_id"], r["file"], r["k"]) for r in readers.json_lines(spark, str(tmp_path)).collect())
    assert rows == list(zip(range(3051), ["a"] + ["b"] * 50 + ["c"] * 3000, [0, *range(50), *range(3000)]))


def test_row_ids_over_blocks_and_csv(spark, tmp_path):
    (tmp_path / "x.csv").write_text("".join(f"q{k},a{k},question\n" for k in range(2000)))
    (tmp_path / "w.csv").write_text("q,a,answer\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", 4096)
    try:
        rows = sorted((r["row_id"], r["subject"], r["question"], r["references"]) for r in readers.csv_folder(spark, str(tmp_path), ["question", "text", "answer"]).collect())
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [r[:3] for r in rows] == list(zip(range(2001), ["w"] + ["x"] * 2000, ["q", *(f"q{k}" for k in range(2000))]))
    assert rows[0][3] == ["answer"] and rows[5][3] == ["q4"]


def test_helpers(spark, tmp_path):
    (tmp_path / "known.jsonl").write_text("")
    assert readers.bundled_benchmark("known", [str(tmp_path)]).endswith("known.jsonl") == readers.bundled_benchmark(str(tmp_path / "known.jsonl")).endswith("known.jsonl")
    with pytest.raises(FileNotFoundError, match="known"):
        readers.bundled_benchmark("other", [str(tmp_path)])
    df = spark.createDataFrame([(1,)], "a int")
    assert readers.with_extra_info(df).first()["extra_info"] == "{}"
    assert [tuple(r) for r in readers.runs([df, df.selectExpr("a + 1 AS a", "'x' AS b")]).orderBy("run").collect()] == [(1, 0, None), (2, 1, "x")]
