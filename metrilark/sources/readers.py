"""Readers: JSON lines, Parquet mirrors, parallel texts, chat benchmarks, CSV folders and evaluation files, all with a ``row_id`` in dataset order.

``row_id`` counts from 0 over the lines of all files, in order of file name and place, without bringing the rows into one task.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.tokenizers import NotAvailable
from ..operators.chat import split_last_answer


def with_row_id(df: DataFrame) -> DataFrame:
    """``df``, a scan of files, with consecutive ids: by file, block of the file and place in it, in whatever order Spark reads the blocks. One narrow extra pass counts them."""
    tagged = df.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_at"))
    blocks = tagged.groupBy("_file", "_block").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))  # a row a block
    before = blocks.select("_file", "_block", (F.sum("_n").over(Window.orderBy("_file", "_block")) - F.col("_n") - F.col("_first")).alias("_before"))
    return tagged.join(before, ["_file", "_block"]).withColumn("row_id", F.col("_before") + F.col("_at")).drop("_file", "_block", "_at", "_before")


def json_lines(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    """An object a line; compressed files and remote paths are Spark's. A schema saves the pass that infers it."""
    reader = spark.read.schema(schema) if schema is not None else spark.read
    return with_row_id(reader.json(path, lineSep="\n"))


def parquet(spark: SparkSession, path: str) -> DataFrame:
    return with_row_id(spark.read.parquet(path))


def text_lines(spark: SparkSession, path: str, field: str = "text", prefix: Column | None = None) -> DataFrame:
    """``row_id, text, prefix`` of a field of JSON lines, for perplexity."""
    rows = json_lines(spark, path)
    return rows.select("row_id", F.col(field).cast("string").alias("text"), (prefix if prefix is not None else F.lit("")).alias("prefix"))


def parallel_texts(spark: SparkSession, source: str, *references: str) -> DataFrame:
    """``row_id, source, references`` of text files with a line for each other; they must be as long."""
    rows = with_row_id(spark.read.text(source)).select("row_id", F.col("value").alias("source"))
    n = rows.count()
    for k, path in enumerate(references):
        other = with_row_id(spark.read.text(path)).select("row_id", F.trim("value").alias(f"_r{k}"))
        if other.count() != n:
            raise ValueError(f"{path} doesn't have as many lines as {source}")
        rows = rows.join(other, "row_id")
    names = [f"_r{k}" for k in range(len(references))]
    return rows.select("row_id", "source", F.array(*names).alias("references"))


def chat_benchmark(spark: SparkSession, path: str, reference_path: str | None = None, need_references: tuple[str, ...] = ("math", "coding", "reasoning"), first_turns: int | None = None) -> DataFrame:
    """``row_id, messages, references, tools, question_id, category`` of JSON lines with ``turns``: the user's turns after an optional ``system_message``; ``first_turns`` counts that too. References are looked up by question and kept for the categories that need them."""
    rows = json_lines(spark, path)
    user = F.transform("turns", lambda t: F.struct(F.lit("user").alias("role"), t.alias("content")))
    if "system_message" in rows.columns:
        system = F.array(F.struct(F.lit("system").alias("role"), F.col("system_message").alias("content")))
        user = F.when(F.col("system_message").isNotNull(), F.concat(system, user)).otherwise(user)
    messages = F.slice(user, 1, first_turns) if first_turns else user
    none = F.array().cast("array<string>")
    if reference_path:
        known = spark.read.json(reference_path).select("question_id", F.col("choices")[0]["turns"].alias("_references"))
        rows = rows.join(known, "question_id", "left")
        references = F.when(F.col("category").isin(*need_references), F.coalesce("_references", none)).otherwise(none)
    else:
        references = none
    tools = F.to_json("tools") if "tools" in rows.columns else F.lit(None).cast("string")
    return rows.select("row_id", messages.alias("messages"), references.alias("references"), tools.alias("tools"), "question_id", "category")


def message_lines(spark: SparkSession, path: str, messages: str = "messages", tools: str | None = None, drop_last_answer: bool = True, references: str | None = None) -> DataFrame:
    """``row_id, messages, references, tools`` of JSON lines of conversations. A trailing answer becomes the reference unless a column has those."""
    rows = json_lines(spark, path)
    kept, answer = split_last_answer(F.col(messages))
    if references is not None:
        kind = dict(rows.dtypes)[references]
        if kind not in ("string", "array<string>"):
            raise ValueError(f"references must be a string or a list of strings, not {kind}")
        answer = F.array(references) if kind == "string" else F.col(references)
    return rows.select("row_id", (kept if drop_last_answer else F.col(messages)).alias("messages"), answer.alias("references"), (F.to_json(tools) if tools else F.lit(None).cast("string")).alias("tools"))


def csv_folder(spark: SparkSession, path: str, names: list[str], answer: str = "answer") -> DataFrame:
    """CSV files without a header as ``names``; ``subject`` is the file's stem and the reference the column that ``answer`` names."""
    rows = spark.read.schema(", ".join(f"`{n}` string" for n in names)).csv(path).withColumn("subject", F.regexp_extract(F.input_file_name(), r"([^/]+)\.csv$", 1))
    pairs = F.create_map(*[x for n in names for x in (F.lit(n), F.col(n))])
    return with_row_id(rows).withColumn("references", F.array(F.element_at(pairs, F.col(answer))))


#: Columns of EVAL rows besides row_id, and their types.
EVAL = {"lm_output": "string", "references": "array<string>", "finish_reason": "string", "tool_call_validation_result": "string", "reasoning_text": "string", "raw_lm_output": "string"}


def evaluation_file(spark: SparkSession, path: str) -> DataFrame:
    """EVAL rows of JSON lines; absent columns are null, and the old name ``task_inputs`` stands for ``extra_info``."""
    rows = json_lines(spark, path)
    if "task_inputs" in rows.columns:
        rows = rows.withColumn("extra_info", F.coalesce("extra_info", "task_inputs") if "extra_info" in rows.columns else F.col("task_inputs")).drop("task_inputs")
    if dict(rows.dtypes).get("lm_output", "").startswith("struct"):
        rows = rows.withColumn("lm_output", F.col("lm_output.text"))
    return rows.withColumns({c: F.lit(None).cast(t) for c, t in EVAL.items() if c not in rows.columns})


def bundled_benchmark(name: str, folders: Sequence[str] = ()) -> str:
    """The file of a chat benchmark: ``name`` itself if there is one, else ``<name>.jsonl`` in the first of ``folders`` that has it."""
    for path in (Path(name), *(Path(f) / f"{name}.jsonl" for f in folders)):
        if path.is_file():
            return str(path)
    raise FileNotFoundError(f"no chat benchmark {name!r}; there are {sorted(p.stem for f in folders for p in Path(f).glob('*.jsonl'))}")


def with_extra_info(df: DataFrame) -> DataFrame:
    """``df`` with ``extra_info``: an empty object where there is none."""
    if "extra_info" not in df.columns:
        return df.withColumn("extra_info", F.lit("{}"))
    text = F.col("extra_info") if dict(df.dtypes)["extra_info"] == "string" else F.to_json("extra_info")
    return df.withColumn("extra_info", F.coalesce(text, F.lit("{}")))


def runs(frames: Sequence[DataFrame]) -> DataFrame:
    """The results of repeated runs one after another, with their number in ``run``, from 0."""
    out = None
    for k, df in enumerate(frames):
        one = df.withColumn("run", F.lit(k))
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    if out is None:
        raise ValueError("there is no run")
    return out


def hub(*_: str) -> DataFrame:
    raise NotAvailable("dataset hubs need a network; read a local mirror with parquet() or json_lines()")


Loader = Callable[[SparkSession], DataFrame]
