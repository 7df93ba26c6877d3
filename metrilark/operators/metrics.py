"""Metrics over EVAL rows: ``row_id, lm_output, references, category, ...``.

A metric is a set of row columns and of aggregates over them. ``evaluate`` puts
the row columns of all metrics in one projection and all aggregates, overall and
by category, in one pass; later metrics replace earlier keys.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import kernels as K
from ..functions import parsing, tokenizers
from ..functions.processors import Processor, chain, lower
from ..session import bounded


@dataclass(frozen=True)
class Metric:
    """``rows``: row columns; ``overall`` and ``by_category``: aggregates of them by summary key; ``finish``: summary keys from overall values."""

    rows: dict[str, Column]
    overall: dict[str, Column]
    by_category: dict[str, Column] = field(default_factory=dict)
    finish: Callable[[dict], dict] | None = None


def _mean(name: str) -> Column:
    return F.coalesce(F.avg(F.col(name).cast("double")), F.lit(0.0))


def _texts(processor, reference_processor) -> tuple[Column, Column]:
    output = chain(processor)(F.coalesce(F.col("lm_output"), F.lit("")))
    references = F.coalesce(F.col("references"), F.array().cast("array<string>"))
    return output, (F.transform(references, chain(reference_processor)) if reference_processor else references)


def exact_match(processor=None, reference_processor=None, key: str = "exact_match") -> Metric:
    """Whether the output is one of the references."""
    output, references = _texts(processor, reference_processor)
    return Metric({key: F.exists(references, lambda r: r.eqNullSafe(output))}, {key: _mean(key)}, {key: _mean(key)})


def substring_match(mode: str = "any") -> Metric:
    """Whether any, or all, of the references are in the output."""
    output, references = _texts(None, None)
    key = f"substring_match-{mode}"
    test = {"any": F.exists, "all": F.forall}[mode](references, lambda r: F.coalesce(F.contains(output, r), F.lit(False)))
    return Metric({key: test}, {key: _mean(key)}, {key: _mean(key)})


def char_f1(processor=None, reference_processor=None) -> Metric:
    """Best similarity by characters with a reference."""
    return Metric({"char_f1": K.best_similarity()(*_texts(processor, reference_processor))}, {"char_f1": _mean("char_f1")}, {"char_f1": _mean("char_f1")})


def common_prefix_length() -> Metric:
    key = "common_prefix_length"
    return Metric({key: K.best_prefix()(*_texts(None, None))}, {f"average_{key}": _mean(key), f"longest_{key}": F.coalesce(F.max(key), F.lit(0)).cast("double")})


def common_string_length() -> Metric:
    key = "common_string_length"
    return Metric({key: K.best_substring()(*_texts(None, None))}, {f"average_{key}": _mean(key), f"longest_{key}": F.coalesce(F.max(key), F.lit(0)).cast("double")})


def output_length() -> Metric:
    """Characters of the output."""
    key = "output_length"
    return Metric({key: F.length(F.coalesce(F.col("lm_output"), F.lit("")))}, {f"{n}_{key}": f(key).cast("double") for n, f in (("avg", F.avg), ("max", F.max), ("min", F.min))})


def repetition_count(threshold: int = 30, length: int = 10, processor: Processor | Sequence[Processor] | None = None) -> Metric:
    """Share of outputs whose most frequent window of ``length`` characters occurs ``threshold`` times."""
    found = K.repeated(length)(_texts(processor, None)[0])
    return Metric({"repetition": found, "is_repetition": found["count"] >= threshold}, {"repetition_ratio": _mean("is_repetition")})


def repetition_n(n: int = 4, tokenizer: tokenizers.Tokenizer = tokenizers.whitespace, processor=None) -> Metric:
    """Share of the n-grams that repeat an earlier one."""
    key = f"repetition_{n}"
    share = lambda all_: F.when(F.size(all_) > 0, 1 - F.size(F.array_distinct(all_)) / F.size(all_)).otherwise(0.0)
    return Metric({key: tokenizers.once(tokenizers.written_ngrams(tokenizer(_texts(processor, None)[0]), n), share)}, {key: _mean(key)})


def bleu(tokenizer: tokenizers.Tokenizer = tokenizers.mteval, processor=None, reference_processor=None) -> Metric:
    """Corpus BLEU from summed counts, sentence BLEU by row and as mean by category."""
    output, references = _texts(processor, reference_processor)
    stats = K.bleu_statistics()(tokenizer(F.regexp_replace(output, r"(?U)^\s+|\s+\z", "")), F.transform(references, tokenizer))
    sums = {f"_bleu_{k}": F.coalesce(F.sum(F.col("bleu.counts")[k]), F.lit(0)).cast("double") for k in range(10)}

    def finish(values: dict) -> dict:
        score, penalty = K.bleu([values[f"_bleu_{k}"] for k in range(10)])
        return {"bleu_score": score, "bleu_bp": penalty}

    return Metric({"bleu": stats}, sums, {"sentence_bleu_score": F.avg("bleu.bleu_score")}, finish)


def rouge(tokenizer: tokenizers.Tokenizer = tokenizers.whitespace, max_output_tokens: int | None = None) -> Metric:
    """ROUGE-1, -2 and -L with the first reference."""
    output, references = _texts(None, None)
    mine = tokenizer(output)
    if max_output_tokens:
        mine = F.slice(mine, 1, max_output_tokens)
    scores = K.rouge_scores()(mine, tokenizer(F.coalesce(F.try_element_at(references, F.lit(1)), F.lit(""))))
    return Metric({"rouge": scores}, {k: _mean(f"rouge.{k}") for k in ("rouge1", "rouge2", "rougeL")})


def sari(source: Column, tokenizer: tokenizers.Tokenizer = tokenizers.mteval, max_ngrams: int = 4, source_processor=lower, processor=lower, reference_processor=lower) -> Metric:
    """SARI of rewriting ``source``."""
    output, references = _texts(processor, reference_processor)
    scores = K.sari_scores(max_ngrams)(tokenizer(chain(source_processor)(source)), tokenizer(output), F.transform(references, tokenizer))
    means = {k: _mean(f"sari.{k}") for k in ("sari_score", "sari_add", "sari_keep", "sari_del")}
    return Metric({"sari": scores}, means, means)


def error_rates(tokenizer: tokenizers.Tokenizer | None = None) -> Metric:
    """Character and word error rates with the first reference: all edits over all lengths. Rows have word rates of the raw text, the summary those of the tokenizer."""
    output, references = _texts(None, None)
    reference = F.coalesce(F.try_element_at(references, F.lit(1)), F.lit(""))
    raw = tokenizers.whitespace
    rate = lambda e, n: F.when(n > 0, e / n).otherwise((e > 0).cast("double"))
    rows = {"_chars": F.length(reference), "_char_edits": F.levenshtein(reference, output)}
    words, edits = F.size(raw(reference)), K.edits()(raw(reference), raw(output))
    rows |= {"_words": F.size(tokenizer(reference)), "_word_edits": K.edits()(tokenizer(reference), tokenizer(output))} if tokenizer else {"_words": words, "_word_edits": edits}
    rows |= {"cer_score": rate(rows["_char_edits"], rows["_chars"]), "wer_score": rate(edits, words)}
    return Metric(rows, {"cer_score": F.try_divide(F.sum("_char_edits").cast("double"), F.sum("_chars")), "wer_score": F.try_divide(F.sum("_word_edits").cast("double"), F.sum("_words"))})


def math_verify() -> Metric:
    """Whether the answer is the same number as one of the references'; numbers and fractions only."""
    return Metric({"math_verify_match": K.any_math()(*_texts(None, None)) > 0}, {"math_verify_accuracy": _mean("math_verify_match")})


def judge_score(answer: str, valid: tuple[int, int] | None = None, pattern: str = parsing.SCORE, prefix: str = "") -> Metric:
    """Mean of the scores in a judge's answers, and how many have none."""
    p = f"{prefix}-" if prefix else ""
    key = f"{p}llm_score"
    return Metric({key: parsing.judge_score(F.col(answer), valid, pattern)}, {key: F.avg(F.col(key).cast("double")), f"{p}num_failed_score_parses": F.count_if(F.col(key).isNull()).cast("double")}, {key: F.avg(F.col(key).cast("double"))})


def judge_label(answer: str, labels: Sequence[str], points: Sequence[float] | None = None, prefix: str = "") -> Metric:
    """Mean points of the labels in a judge's answers, their distribution with zeros, and the failures."""
    p = f"{prefix}-" if prefix else ""
    points = points or [1.0, *[0.0] * (len(labels) - 1)]
    found = parsing.judge_label(F.col(answer), labels)
    value = F.element_at(F.create_map(*[F.lit(x) for pair in zip(labels, map(float, points)) for x in pair]), found)
    means = {f"{p}llm_score": F.avg(f"{p}llm_label_points")} | {f"{p}llm_label_distribution-{x}": F.try_divide(F.count_if(F.col(f"{p}llm_label") == x), F.count(f"{p}llm_label")) for x in labels}
    return Metric({f"{p}llm_label": found, f"{p}llm_label_points": F.when(found.isNotNull(), value)}, means | {f"{p}num_failed_score_parses": F.count_if(F.col(f"{p}llm_label").isNull()).cast("double")}, means)


def judge_weighted_score(log_probs: str, valid: tuple[int, int], least: float = 0.0, prefix: str = "") -> Metric:
    """Mean of the probability-weighted scores."""
    p = f"{prefix}-" if prefix else ""
    key = f"{p}llm_geval_score"
    return Metric({key: parsing.weighted_score(F.col(log_probs), valid, least)}, {key: F.avg(key), f"{p}num_failed_score_parses": F.count_if(F.col(key).isNull()).cast("double")}, {key: F.avg(key)})


def attributes(scores: dict[str, Column]) -> Metric:
    """Means of scores that a service gave for each attribute; empty outputs count as zero."""
    empty = F.coalesce(F.col("lm_output"), F.lit("")) == ""
    return Metric({k: F.when(empty, 0.0).otherwise(c) for k, c in scores.items()}, {k: _mean(k) for k in scores})


def constraints(checks: str) -> Metric:
    """From a column array<struct<name, passed>>: share of rows that pass all checks, share of checks passed."""
    passed = F.filter(F.col(checks), lambda c: c["passed"])
    rows = {"format_all": F.forall(F.col(checks), lambda c: c["passed"]), "_passed": F.size(passed), "_checks": F.size(checks)}
    return Metric(rows, {"format_accuracy-macro": _mean("format_all"), "format_accuracy-micro": F.try_divide(F.sum("_passed").cast("double"), F.sum("_checks"))})


def checker_accuracies(df: DataFrame, checks: str) -> DataFrame:
    """``metric, value``: ``format_accuracy-<name>``, the share of each named check that is passed, over the rows that ask for it."""
    each = df.select(F.explode(checks).alias("c")).groupBy("c.name").agg(F.avg(F.col("c.passed").cast("double")).alias("value"))
    return each.select(F.concat(F.lit("format_accuracy-"), "name").alias("metric"), "value")


def details(df: DataFrame, metrics: Sequence[Metric]) -> DataFrame:
    """``df`` with the row columns of all metrics; of equal names the last counts. Texts and words go to the workers in bounded batches."""
    bounded(df.sparkSession)
    return df.withColumns({k: c for m in metrics for k, c in m.rows.items()})


def summarise(scored: DataFrame, metrics: Sequence[Metric], category: str | None = None) -> DataFrame:
    """``metric, category, value, n`` from ``details``: every aggregate in one pass, overall and, with ``category``, by it. An array-valued category counts a row under each of its values."""
    overall = {k: c for m in metrics for k, c in m.overall.items()}
    per = {k: c for m in metrics for k, c in m.by_category.items()}
    row = scored.agg(F.count("*").alias("_n"), *[c.cast("double").alias(k) for k, c in overall.items()])
    if any(m.finish for m in metrics):
        first = row.first().asDict()
        values = {k: v for k, v in first.items() if k != "_n" and not k.startswith("_")}
        for m in metrics:
            if m.finish:
                values |= m.finish(first)
        out = scored.sparkSession.createDataFrame([(k, None, None if v is None or math.isnan(v) else float(v), first["_n"]) for k, v in values.items()], "metric string, category string, value double, n long")
    else:
        out = _long(row.withColumn("category", F.lit(None).cast("string")), list(overall))
    if category is None or not per:
        return out
    by = scored.withColumn("_category", F.explode(category) if scored.schema[category].dataType.typeName() == "array" else F.col(category))
    grouped = by.groupBy(F.col("_category").cast("string").alias("category")).agg(F.count("*").alias("_n"), *[c.cast("double").alias(k) for k, c in per.items()])
    return out.unionByName(_long(grouped, list(per)))


def _long(df: DataFrame, keys: list[str]) -> DataFrame:
    cells = F.explode(F.array(*[F.struct(F.lit(k).alias("metric"), F.col(f"`{k}`").alias("value")) for k in keys])).alias("cell")
    return df.select("category", F.col("_n").alias("n"), cells).select("cell.metric", "category", "cell.value", "n")


def evaluate(df: DataFrame, metrics: Sequence[Metric], category: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(summary, details) of the metrics over EVAL rows."""
    scored = details(df, metrics)
    return summarise(scored, metrics, category), scored


def value_ratio(df: DataFrame, column: str, name: str) -> DataFrame:
    """``metric, value``: the share of each value, null as "None", under ``<name>_ratio-<value>``."""
    counts = df.groupBy(F.coalesce(F.col(column), F.lit("None")).alias("v")).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    return counts.crossJoin(F.broadcast(total)).select(F.concat(F.lit(f"{name}_ratio-"), "v").alias("metric"), (F.col("n") / F.col("total")).alias("value"))


def average_ranks(df: DataFrame, column: str) -> DataFrame:
    """``column, rank``: the average rank of each distinct value, from the counts of values; the running sum goes over range partitions, not one."""
    counts = df.groupBy(column).agg(F.count("*").alias("n"))
    spread = counts.repartitionByRange(column).sortWithinPartitions(column).select(column, "n", F.spark_partition_id().alias("part"))
    from pyspark.sql import Window

    within = F.sum("n").over(Window.partitionBy("part").orderBy(column))
    parts = spread.groupBy("part").agg(F.sum("n").alias("size"))
    before = parts.select("part", (F.sum("size").over(Window.orderBy("part")) - F.col("size")).alias("before"))  # a row a partition
    ranked = spread.withColumn("upto", within).join(F.broadcast(before), "part")
    return ranked.select(column, (F.col("before") + F.col("upto") - (F.col("n") - 1) / 2).alias("rank"))


def _numbers(df: DataFrame, x: str, y: str) -> DataFrame:
    """``x`` and ``y`` as numbers: an output ``x`` that isn't one counts as 0; of a reference ``y`` that is an error. Rows without a reference are left out."""
    return df.select(F.coalesce(F.col(x).try_cast("double"), F.lit(0.0)).alias("x"), F.col(y).cast("double").alias("y")).where("y IS NOT NULL")


def _corr(x: str, y: str) -> Column:
    """Null where one side doesn't vary."""
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def correlation(df: DataFrame, x: str, y: str, method: str = "pearson") -> DataFrame:
    """``metric, value``: correlation of the outputs ``x``, texts or numbers, with the references ``y``."""
    df = _numbers(df, x, y)
    name = F.lit(f"{method}_correlation").alias("metric")
    if method == "pearson":
        return df.agg(_corr("x", "y").alias("value")).select(name, "value")
    if method == "spearman":
        rx = average_ranks(df, "x").withColumnRenamed("rank", "rx")
        ry = average_ranks(df, "y").withColumnRenamed("rank", "ry")
        return df.join(rx, "x").join(ry, "y").agg(_corr("rx", "ry").alias("value")).select(name, "value")
    if method != "kendall":
        raise ValueError(f"no method {method!r}")
    return kendall(df).select(name, "value")


#: Buckets of each axis in which inversions are counted apart.
BUCKETS = 256


def _buckets(pairs: DataFrame, column: str) -> Column:
    """The bucket of a value; every quantile is a bucket of its own, of an odd number, so that a frequent value, with which nothing can be inverted, is alone."""
    cuts = sorted(set(pairs.approxQuantile(column, [k / BUCKETS for k in range(1, BUCKETS)], 1 / (4 * BUCKETS))))
    edges = F.array(*map(F.lit, cuts)).cast("array<double>")
    return F.size(F.filter(edges, lambda c: c < F.col(column))) + F.size(F.filter(edges, lambda c: c <= F.col(column)))


def kendall(df: DataFrame) -> DataFrame:
    """``value``: tau-b of ``x, y``. Equal pairs are counted first. Inversions within a bucket of ``x``, or of ``y`` across those of ``x``, are
    counted bucket by bucket, all others from the buckets' counts, of which there are at most (2 BUCKETS)² in all."""
    pairs = df.groupBy("x", "y").agg(F.count("*").alias("n"))
    pairs = pairs.withColumns({"bx": _buckets(pairs, "x"), "by": _buckets(pairs, "y")})

    def within(own: str, order: list[str]) -> DataFrame:
        def count(rows):
            import pandas as pd

            rows = rows.sort_values([*order, "y"])
            return pd.DataFrame({"d": [float(K.inversions(rows["y"].to_numpy(), rows["n"].to_numpy()))]})

        return pairs.where(F.col(own) % 2 == 0).groupBy(own).applyInPandas(count, "d double")

    def across(cells):
        import pandas as pd

        cells = cells.sort_values(["bx", "by"])
        return pd.DataFrame({"d": [float(K.inversions(cells["by"].to_numpy(), cells["n"].to_numpy()))]})

    cells = pairs.groupBy("bx", "by").agg(F.sum("n").alias("n"))
    found = within("bx", ["x"]).unionByName(within("by", ["bx"])).unionByName(cells.groupBy(F.lit(0).alias("one")).applyInPandas(across, "d double")).agg(F.coalesce(F.sum("d"), F.lit(0.0)).alias("d"))
    ties = lambda c, name: F.coalesce(F.sum(F.col(c).cast("double") * (F.col(c) - 1) / 2), F.lit(0.0)).alias(name)
    by = lambda c: pairs.groupBy(c).agg(F.sum("n").alias("n")).agg(ties("n", f"t{c}"))
    all_ = pairs.agg(F.sum("n").alias("n"), ties("n", "txy")).withColumn("n", F.coalesce("n", F.lit(0))).withColumn("all", F.col("n").cast("double") * (F.col("n") - 1) / 2)
    t = all_.crossJoin(by("x")).crossJoin(by("y")).crossJoin(found)  # a row each
    over = F.sqrt(F.col("all") - F.col("tx")) * F.sqrt(F.col("all") - F.col("ty"))
    return t.select(F.try_divide(F.col("all") - F.col("tx") - F.col("ty") + F.col("txy") - 2 * F.col("d"), over).alias("value"))


def correlation_summary(df: DataFrame, x: str, y: str, methods: Sequence[str] = ("pearson", "spearman", "kendall")) -> DataFrame:
    """``metric, value`` with ``<method>_correlation`` and ``<method>_pvalue`` of each method."""
    n = _numbers(df, x, y).count()
    rows = []
    for method in methods:
        value = correlation(df, x, y, method).first()["value"]
        p = p_value(method, math.nan if value is None else value, n)
        rows += [(f"{method}_correlation", value), (f"{method}_pvalue", None if math.isnan(p) else p)]
    return df.sparkSession.createDataFrame(rows, "metric string, value double")


def _beta_share(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function, by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - _beta_share(b, a, 1 - x)
    tiny, c = 1e-300, 1.0
    d = 1 / max(1 - (a + b) * x / (a + 1), tiny)
    out = d
    for m in range(1, 500):
        for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / ((1 + step * d) or tiny)
            c = (1 + step / c) or tiny
            out *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) * out / a


def p_value(method: str, value: float, n: int) -> float:
    """Two-sided p-value of a correlation: Student's t for Pearson and Spearman; for Kendall the normal approximation, with the variance without ties."""
    if n < 3 or math.isnan(value):
        return math.nan
    if method == "kendall":
        z = 3 * value * math.sqrt(n * (n - 1)) / math.sqrt(2 * (2 * n + 5))
        return math.erfc(abs(z) / math.sqrt(2))
    return _beta_share((n - 2) / 2, 0.5, 1 - min(value * value, 1.0))


def f1_scores(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """``macro_f1, micro_f1``: the mean F1 of all labels true or predicted, undefined ones as 0, and the accuracy."""
    stacked = df.select(F.explode(F.array(F.struct(F.col(truth).alias("label"), F.lit(1).alias("t"), F.lit(0).alias("p")), F.struct(F.col(predicted).alias("label"), F.lit(0).alias("t"), F.lit(1).alias("p")))).alias("e"), (F.col(truth) == F.col(predicted)).cast("int").alias("hit"))
    label = stacked.groupBy("e.label").agg(F.sum("e.t").alias("t"), F.sum("e.p").alias("p"), F.sum(F.col("hit") * F.col("e.t")).alias("hit"))
    return label.agg(F.avg(F.when(F.col("t") + F.col("p") > 0, 2 * F.col("hit") / (F.col("t") + F.col("p"))).otherwise(0.0)).alias("macro_f1"), (F.sum("hit") / F.sum("t")).alias("micro_f1"))


def multiple_choice(df: DataFrame, log_probs: str = "log_probs", choices: str = "choices", answer: str = "answer_index") -> DataFrame:
    """Rows with ``prediction`` and ``byte_norm_prediction``: the index of the largest log-probability, as is and by bytes of the choice; of ties the first."""
    norm = F.zip_with(F.col(log_probs), F.col(choices), lambda p, c: p / F.octet_length(c))
    first = lambda a: (F.array_position(a, F.array_max(a)) - 1).cast("int")
    return df.withColumns({"prediction": first(F.col(log_probs)), "byte_norm_prediction": first(norm)}).withColumns({"correct": F.col("prediction") == F.col(answer), "byte_norm_correct": F.col("byte_norm_prediction") == F.col(answer)})


def perplexity(df: DataFrame, log_prob: str = "log_prob", text: str = "text", tokens: str | None = None) -> DataFrame:
    """Perplexity by byte, by character and, with a token count, by token; prefixes aren't counted."""
    counts = {"byte": F.octet_length(text), "character": F.length(text)} | ({"token": F.col(tokens)} if tokens else {})
    return df.agg(F.sum(log_prob).alias("total_log_prob"), *[F.exp(-F.sum(log_prob) / F.sum(c)).alias(f"perplexity_per_{k}") for k, c in counts.items()])


def reward_accuracy(df: DataFrame, chosen: str, rejected: str, category: str) -> DataFrame:
    """``metric, value``: how often the chosen answer scores strictly more, overall (null categories too) and by category."""
    hit = (F.col(chosen) > F.col(rejected)).cast("double")
    sets = df.select(hit.alias("hit"), F.col(category).alias("c")).rollup("c").agg(F.avg("hit").alias("value"), F.grouping("c").alias("all"))
    return sets.where("all = 1 OR c IS NOT NULL").select(F.when(F.col("all") == 1, "accuracy").otherwise(F.concat(F.lit("accuracy-"), "c")).alias("metric"), "value")


def order_invariant_verdicts(df: DataFrame, ab: str, ba: str) -> DataFrame:
    """Verdicts on both orders (the gold label is [[A]] in the first, [[B]] in the second): correct only if both are, and whether they agree."""
    first, second = parsing.verdict_correct(F.col(ab), F.lit("[[A]]")), parsing.verdict_correct(F.col(ba), F.lit("[[B]]"))
    return df.withColumns({"is_correct": first & second, "consistent": first == second})


def pass_at_k(samples: Column, passed: Column, k: int) -> Column:
    """1 - C(n - c, k) / C(n, k), as a product."""
    terms = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: (samples - passed - i) / (samples - i))
    return F.when(samples - passed < k, 1.0).otherwise(1 - F.aggregate(terms, F.lit(1.0), lambda a, x: a * x))
