"""Few-shot examples for every row of an evaluation: reproducible, and each row for itself.

The examples are numbered from 0 to n - 1 in the order of the MD5 of (seed, example). A row walks over these numbers from a start in steps of a
prime that doesn't divide n, both by the MD5 of (seed, row), so that it meets each example once before any twice. It takes only as many steps as it can
need, and the numbers are joined with the examples: the cost is rows times shots, whatever the number of examples.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Examples with at most so many bytes in all are broadcast; beyond, the pairs are made by a shuffled cross join.
BROADCAST_BYTES = 8 << 20


#: Steps of the walks; no number of examples has all of them as divisors.
PRIMES = (1009, 1013, 1019, 1021, 1031, 1033, 1039, 1049, 1051, 1061, 1063, 1069, 1087, 1091, 1093, 1097, 1103, 1109, 1117, 1123, 1129, 1151, 1153, 1163, 1171, 1181, 1187, 1193, 1201, 1213, 1217, 1223)


def _number(*parts: object) -> Column:
    """48 bits of the MD5 of the parts."""
    text = F.concat_ws(":", *[p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts])
    return F.conv(F.left(F.md5(text), F.lit(12)), 16, 10).cast("long")


def _walk(seed: int, what: str, key: Column, size: Column, at: Column) -> Column:
    """Where the walk of ``key`` over ``size`` numbers is after ``at`` steps."""
    steps = F.filter(F.array(*map(F.lit, PRIMES)), lambda p: size % p != 0)
    step = F.element_at(steps, (_number(seed, what, "step", key) % F.size(steps) + 1).cast("int"))
    return (_number(seed, what, "start", key) + at * step) % size


def numbered(df: DataFrame, order: Column, name: str, within: str | None = None) -> DataFrame:
    """``df`` numbered from 0 by ``order``, over range partitions; with ``within`` for each value of that column."""
    if within is not None:
        keys = df.withColumn("_order", order).repartitionByRange(within, "_order").sortWithinPartitions(within, "_order")
    else:
        keys = df.withColumn("_order", order).repartitionByRange("_order").sortWithinPartitions("_order")
    spread = keys.withColumns({"_part": F.spark_partition_id(), "_group": F.col(within).cast("string") if within else F.lit("")})
    spread = spread.withColumn("_in", F.row_number().over(Window.partitionBy("_part", "_group").orderBy("_order")))
    parts = spread.groupBy("_part", "_group").agg(F.count("*").alias("_n"))  # about a row a partition
    before = parts.select("_part", "_group", (F.sum("_n").over(Window.partitionBy("_group").orderBy("_part")) - F.col("_n")).alias("_before"))
    joined = spread.alias("s").join(before.alias("b"), (F.col("s._part") == F.col("b._part")) & F.col("s._group").eqNullSafe(F.col("b._group")))
    return joined.select(*[F.col(f"s.{c}") for c in df.columns], (F.col("_before") + F.col("_in") - 1).alias(name))


def _copies(pool: DataFrame, leak: list[str] | None) -> int:
    """How many examples can be equal to a row in the ``leak`` columns at most."""
    return (pool.groupBy(*leak).count().agg(F.max("count").alias("n")).first()["n"] or 0) if leak else 0


def _pool(pool: DataFrame) -> DataFrame:
    size = pool.agg(F.sum(F.octet_length(F.to_json(F.struct("*")))).alias("n")).first()["n"] or 0
    return F.broadcast(pool) if size <= BROADCAST_BYTES else pool


def _apart(drawn: DataFrame, leak: list[str] | None) -> DataFrame:
    """Draws whose example isn't the row itself (equal ``leak`` columns)."""
    if not leak:
        return drawn
    same = F.lit(True)
    for c in leak:
        same = same & F.col(c).eqNullSafe(F.col(f"shot_{c}"))
    return drawn.where(~same)


def _shots(pool: DataFrame) -> DataFrame:
    return pool.select(*[F.col(c).alias(f"shot_{c}" if not c.startswith("_") else c) for c in pool.columns])


def random_shots(rows: DataFrame, pool: DataFrame, k: int, seed: int = 42, row_key: str = "row_id", shot_key: str = "row_id", leak: list[str] | None = None) -> DataFrame:
    """``rows`` times ``k`` examples of ``pool`` as ``shot_*`` columns, with ``shot_rank`` from 1. Examples equal to the row in all ``leak`` columns aren't drawn. Fewer than ``k`` examples that may be drawn are an error."""
    n, copies = pool.count(), _copies(pool, leak)
    if n < k:
        raise ValueError("there are fewer examples than shots")
    order = F.concat_ws(":", F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(shot_key).cast("string"))), F.lpad(F.col(shot_key).cast("string"), 24, "0"))
    examples = _pool(_shots(numbered(pool, order, "_at")))
    walked = rows.withColumn("_step", F.explode(F.sequence(F.lit(0), F.lit(max(0, min(n, k + copies) - 1))))).where(F.lit(k > 0))
    drawn = _apart(walked.withColumn("_at", _walk(seed, "row", F.col(row_key), F.lit(n), F.col("_step"))).join(examples, "_at"), leak)
    if not leak:
        return drawn.withColumn("shot_rank", F.col("_step") + 1).drop("_at", "_step")
    ranked = drawn.withColumn("shot_rank", F.row_number().over(Window.partitionBy(row_key).orderBy("_step"))).where(F.col("shot_rank") <= k)
    enough = F.count("*").over(Window.partitionBy(row_key)) == k
    return ranked.withColumn("shot_rank", F.when(enough, F.col("shot_rank")).otherwise(F.raise_error(F.lit("there are fewer examples than shots that differ from the row")).cast("int"))).drop("_at", "_step")


def balanced_shots(rows: DataFrame, pool: DataFrame, k: int, label: str, seed: int = 42, row_key: str = "row_id", shot_key: str = "row_id", leak: list[str] | None = None) -> DataFrame:
    """As ``random_shots`` with an even share of each ``label``; what is left over goes to the labels that a walk of the row over the labels meets first. Examples are in the order of the walks' steps, then of the labels'."""
    if pool.count() < k:
        raise ValueError("there are fewer examples than shots")
    copies = _copies(pool, leak)
    order = F.concat_ws(":", F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(shot_key).cast("string"))), F.lpad(F.col(shot_key).cast("string"), 24, "0"))
    sizes = pool.groupBy(label).agg(F.count("*").alias("_size"))
    sizes = numbered(sizes, F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(label).cast("string"))), "_label")
    n = sizes.count()
    known = sizes.select("_label", "_size", F.col(label).alias("_l"))
    examples = numbered(pool, order, "_at", within=label)
    examples = _pool(_shots(examples.join(known, F.col(label).eqNullSafe(F.col("_l"))).drop("_l", "_size")))
    asked = rows.withColumn("_turn", F.explode(F.sequence(F.lit(0), F.lit(max(0, min(n, k) - 1))))).where(F.lit(k > 0))
    asked = asked.withColumns({"_label": _walk(seed, "label", F.col(row_key), F.lit(n), F.col("_turn")), "_quota": F.lit(k // n) + (F.col("_turn") < k % n).cast("int")}).join(_pool(known.drop("_l")), "_label")
    steps = asked.withColumn("_step", F.explode(F.sequence(F.lit(0), (F.least("_size", F.col("_quota") + copies) - 1).cast("int"))))
    drawn = _apart(steps.withColumn("_at", _walk(seed, "row", F.concat_ws(":", F.col(row_key).cast("string"), F.col("_label").cast("string")), F.col("_size"), F.col("_step"))).join(examples, ["_label", "_at"]), leak)
    kept = drawn.withColumn("_n", F.row_number().over(Window.partitionBy(row_key, "_label").orderBy("_step"))).where(F.col("_n") <= F.col("_quota"))
    rank = F.row_number().over(Window.partitionBy(row_key).orderBy("_n", "_turn"))
    return kept.withColumn("shot_rank", rank).drop("_label", "_at", "_turn", "_quota", "_size", "_step", "_n")


def fixed_shots(rows: DataFrame, shots: DataFrame) -> DataFrame:
    """Every row with all of ``shots``, in their ``row_id`` order."""
    return rows.crossJoin(_pool(shots.select(*[F.col(c).alias(f"shot_{c}") for c in shots.columns]))).withColumn("shot_rank", F.row_number().over(Window.partitionBy("row_id").orderBy("shot_row_id")))


def collected(shots: DataFrame, row_key: str, columns: list[str]) -> DataFrame:
    """``row_key, few_shot_data``: the examples of each row as an array of structs, by rank."""
    parts = F.collect_list(F.struct("shot_rank", *[F.col(f"shot_{c}").alias(c) for c in columns]))
    return shots.groupBy(row_key).agg(F.transform(F.array_sort(parts), lambda s: s.dropFields("shot_rank")).alias("few_shot_data"))
