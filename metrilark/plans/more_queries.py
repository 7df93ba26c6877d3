"""Registered queries of readers, recorders, model seams, chat turns and the remaining processors, with their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import models
from ..functions import kernels as K
from ..functions import parsing, tokenizers
from ..functions import processors as P
from ..operators import chat, pairwise, sampling, shaping
from ..operators import metrics as M
from ..session import shared_folder
from ..sources import readers
from ..sources.recorders import FolderRecorder
from . import evaluations

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def _query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _path(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/metrilark-{uuid.uuid4().hex}"


def _in_order(df: DataFrame, *keys: str) -> DataFrame:
    """Files of ascending key ranges, so that the order of the files is that of the keys."""
    return df.repartitionByRange(*keys).sortWithinPartitions(*keys)


def _conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``conv_id, messages``, by turn."""
    turns = F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content"))))
    rows = _table(spark, sf_dir, "conversations").groupBy("conv_id").agg(turns.alias("t"))
    return rows.select("conv_id", F.transform("t", lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"))).alias("messages"))


_ROW = "row_number() OVER (ORDER BY doc_id) - 1 AS row_id"
_TALK = "c AS (SELECT conv_id, list(role ORDER BY turn) AS roles, list(text ORDER BY turn) AS texts FROM conversations GROUP BY conv_id)"


# --- readers and recorders: the tables are written as files of the kind first ---


@_query(f"SELECT {_ROW}, doc_id, text FROM documents")
def scan_json_lines(spark, sf_dir):
    path = _path(spark)
    _in_order(_table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id").write.json(path)
    return readers.json_lines(spark, path, "doc_id long, text string").select("row_id", "doc_id", "text")


@_query(f"SELECT {_ROW}, text, '' AS prefix FROM documents")
def scan_text_lines(spark, sf_dir):
    path = _path(spark)
    _in_order(_table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("body")), "doc_id").write.json(path)
    return readers.text_lines(spark, path, "body")


@_query(f"SELECT {_ROW}, text AS lm_output, [lang] AS refs, source AS origin, CAST(NULL AS VARCHAR) AS finish_reason FROM documents")
def scan_evaluation_file(spark, sf_dir):
    path = _path(spark)
    old = _table(spark, sf_dir, "documents").select("doc_id", F.struct("text").alias("lm_output"), F.array("lang").alias("references"), F.struct("source").alias("task_inputs"))
    _in_order(old, "doc_id").write.json(path)
    return readers.evaluation_file(spark, path).select("row_id", "lm_output", F.col("references").alias("refs"), F.col("extra_info.source").alias("origin"), "finish_reason")


@_query(f"SELECT {_ROW}, lang || ' ' || doc_id AS source, [upper(source), n_chars || ' chars'] AS refs FROM documents")
def scan_parallel_texts(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    paths = [_path(spark) for _ in range(3)]
    for path, text in zip(paths, (F.concat_ws(" ", "lang", "doc_id"), F.concat(F.lit(" "), F.upper("source")), F.concat("n_chars", F.lit(" chars")))):
        _in_order(docs.select("doc_id", text.alias("value")), "doc_id").select("value").write.text(path)
    return readers.parallel_texts(spark, *paths).select("row_id", "source", F.col("references").alias("refs"))


@_query(f"WITH {_TALK}, u AS (SELECT conv_id, list(text ORDER BY turn) AS turns FROM conversations WHERE role = 'user' GROUP BY conv_id) SELECT row_number() OVER (ORDER BY conv_id) - 1 AS row_id, conv_id AS question_id, conv_id % 3 = 0 AS judged, CAST(len(turns) + 1 AS INT) AS messages, turns[1] AS first_turn, turns[-1] AS last_turn, CASE WHEN conv_id % 3 = 0 THEN ['gold ' || conv_id] ELSE [] END AS refs FROM u")
def scan_chat_benchmark(spark, sf_dir):
    path, gold = _path(spark), _path(spark)
    turns = F.array_sort(F.collect_list(F.struct("turn", "text")))
    rows = _table(spark, sf_dir, "conversations").where("role = 'user'").groupBy("conv_id").agg(turns.alias("t")).select(F.col("conv_id").alias("question_id"), F.when(F.col("conv_id") % 3 == 0, "math").otherwise("writing").alias("category"), F.lit("be brief").alias("system_message"), F.col("t.text").alias("turns"))
    _in_order(rows, "question_id").write.json(path)
    rows.select("question_id", F.array(F.struct(F.array(F.concat(F.lit("gold "), "question_id")).alias("turns"))).alias("choices")).write.json(gold)
    m = F.col("messages")
    return readers.chat_benchmark(spark, path, gold).select("row_id", "question_id", (F.col("category") == "math").alias("judged"), F.size(m).alias("messages"), m[1]["content"].alias("first_turn"), F.element_at(m, -1)["content"].alias("last_turn"), F.col("references").alias("refs"))


@_query(f"WITH {_TALK} SELECT row_number() OVER (ORDER BY conv_id) - 1 AS row_id, CAST(len(roles) - CAST(roles[-1] = 'assistant' AS INT) AS INT) AS messages, CASE WHEN roles[-1] = 'assistant' THEN [texts[-1]] ELSE [] END AS refs FROM c")
def scan_messages(spark, sf_dir):
    path = _path(spark)
    _in_order(_conversations(spark, sf_dir), "conv_id").write.json(path)
    return readers.message_lines(spark, path).select("row_id", F.size("messages").alias("messages"), F.col("references").alias("refs"))


@_query(f"SELECT {_ROW}, doc_id || '' AS question, [CASE WHEN doc_id % 2 = 0 THEN lang ELSE source END] AS refs FROM documents")
def scan_csv_folder(spark, sf_dir):
    path = _path(spark)
    rows = _table(spark, sf_dir, "documents").select("doc_id", "lang", "source", F.when(F.col("doc_id") % 2 == 0, "a").otherwise("b").alias("answer"))
    _in_order(rows, "doc_id").write.csv(path)
    return readers.csv_folder(spark, path, ["question", "a", "b", "answer"]).select("row_id", "question", F.col("references").alias("refs"))


@_query("SELECT doc_id, CASE WHEN length(u) > 0 THEN left(u, 50) || '... [truncated, ' || length(u) || ' chars total]' END AS text, true AS saved, false AS other_saved FROM (SELECT doc_id, 'data:text/plain;base64,' || base64(encode(text)) AS u FROM documents)")
def recorded_outputs(spark, sf_dir):
    recorder = FolderRecorder(spark, _path(spark))
    url = F.concat(F.lit("data:text/plain;base64,"), F.regexp_replace(F.base64(F.encode("text", "utf-8")), r"\s", ""))
    rows = _table(spark, sf_dir, "documents").select("doc_id", url.alias("text"))
    recorder.record_outputs(rows, "g")
    recorder.record_metrics(rows.agg(F.count("*").alias("n")), "g")
    recorder.record_config({"a": 1}, "g")
    found = spark.read.schema("doc_id long, text string").json(recorder.folder + "/g/outputs")
    return found.withColumns({"saved": F.lit(recorder.is_metrics_saved("g")), "other_saved": F.lit(recorder.is_metrics_saved())})


# --- shaping ---


@_query("SELECT doc_id, 'Speak ' || lang AS system, text AS user_text, [source, lang] AS refs, '[]' AS tools FROM documents")
def chat_items(spark, sf_dir):
    items = _table(spark, sf_dir, "documents").withColumn("names", F.array("source", "lang"))
    m = shaping.chat(items, "{{ text }}", "Speak {{ lang }}", reference_list="{{ names }}", tools="[]")
    return m.select("doc_id", F.col("messages")[0]["content"].alias("system"), F.col("messages")[1]["content"].alias("user_text"), F.col("references").alias("refs"), "tools")


@_query("SELECT doc_id, 'user' AS role, text AS prompt, upper(source) AS chosen, lang AS rejected, lang AS category_key FROM documents")
def reward_items(spark, sf_dir):
    made = shaping.reward(_table(spark, sf_dir, "documents"), "{{ text }}", "{{ source | upper }}", "{{ lang }}", "{{ lang }}")
    one = lambda c: F.col(c)[0]["content"].alias(c)
    return made.select("doc_id", F.col("prompt")[0]["role"].alias("role"), one("prompt"), one("chosen"), one("rejected"), "category_key")


@_query("SELECT doc_id, [lang] AS refs, '{}' AS extra_info FROM documents")
def overridden_references(spark, sf_dir):
    rows = _table(spark, sf_dir, "documents").select("doc_id", F.col("doc_id").alias("row_id"), F.array("source").alias("references"))
    other = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("row_id"), F.array("lang").alias("references"))
    return readers.with_extra_info(shaping.override_references(rows, other)).select("doc_id", F.col("references").alias("refs"), "extra_info")


@_query("SELECT doc_id, source FROM documents ORDER BY doc_id LIMIT 25")
def first_items(spark, sf_dir):
    return shaping.first_rows(_table(spark, sf_dir, "documents").withColumn("row_id", F.col("doc_id")), 25).select("doc_id", "source")


@_query(f"WITH {_TALK} SELECT conv_id, CAST(len(list_filter(roles, lambda r: r NOT IN ('system', 'developer'))) AS INT) AS others, array_to_string(list_transform(range(1, len(roles) + 1), lambda k: CASE WHEN k = coalesce(list_position(list_transform(roles, lambda r: r NOT IN ('system', 'developer')), true), len(roles) + 1) THEN 'user,assistant,' || roles[k] ELSE roles[k] END), ',') AS roles FROM c WHERE len(list_filter(roles, lambda r: r NOT IN ('system', 'developer'))) > 0")
def inserted_examples(spark, sf_dir):
    shot = F.array(F.array(*[F.struct(F.lit(r).alias("role"), F.lit(t).alias("content")) for r, t in (("user", "q"), ("assistant", "a"))]))
    rows = _conversations(spark, sf_dir).where(chat.first_responding_turn(F.col("messages")) < F.size("messages"))
    others = F.size(F.filter("messages", lambda m: ~m["role"].isin("system", "developer")))
    return rows.select("conv_id", others.alias("others"), F.array_join(F.transform(chat.insert_examples(F.col("messages"), shot), lambda m: m["role"]), ",").alias("roles"))


# --- processors, parsers, tokenizers ---


@_query(r"SELECT doc_id, regexp_replace(text, '([aeiou])([^aeiou\s])', '\2\1', 'g') AS swapped, regexp_extract_all(text, '(?s)\b(\w+)\.', 1)[-1] AS content, regexp_extract_all(text, '(?s)(\d+)', 1)[-1] AS thought FROM (SELECT doc_id, regexp_replace(text, '[^\x00-\x7f]', '', 'g') AS text FROM documents)")
def regex_processors(spark, sf_dir):
    text = F.regexp_replace("text", r"[^\x00-\x7f]", "")
    made = _table(spark, sf_dir, "documents").select("doc_id", text.alias("x"))
    parts = P.separate_reasoning(r"\b(\w+)\.", r"(\d+)")(F.col("x"))
    return made.select("doc_id", P.regex_replace(F.col("x"), r"([aeiou])([^aeiou\s])", r"\2\1").alias("swapped"), parts["text"].alias("content"), parts["reasoning_text"].alias("thought"))


@_query("SELECT doc_id, a AND NOT b AS right_a, b AND NOT a AS right_b, a AND NOT b AND b AND NOT a AS is_correct, (a AND NOT b) = (b AND NOT a) AS consistent FROM (SELECT doc_id, contains(v, '[[A]]') AS a, contains(v, '[[B]]') AS b FROM (SELECT doc_id, replace(replace(text, 'ing', '[[A]]'), 'ung', '[[B]]') AS v FROM documents))")
def verdicts(spark, sf_dir):
    v = F.replace(F.replace("text", F.lit("ing"), F.lit("[[A]]")), F.lit("ung"), F.lit("[[B]]"))
    rows = _table(spark, sf_dir, "documents").select("doc_id", v.alias("ab"), v.alias("ba"))
    a, b = parsing.verdict_correct(F.col("ab"), F.lit("[[A]]")), parsing.verdict_correct(F.col("ba"), F.lit("[[B]]"))
    return M.order_invariant_verdicts(rows, "ab", "ba").select("doc_id", a.alias("right_a"), b.alias("right_b"), "is_correct", "consistent")


_MT = "replace(replace(replace(replace(replace(replace(replace(text, '<skipped>', ''), '-' || chr(10), ''), chr(10), ' '), '&quot;', '\"'), '&amp;', '&'), '&lt;', '<'), '&gt;', '>')"


@_query(r"SELECT doc_id, string_split(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(' ' || " + _MT + r" || ' ', '([\{-\~\[-\` -\&\(-\+\:-\@\/])', ' \1 ', 'g'), '([^0-9])([\.,])', '\1 \2 ', 'g'), '([\.,])([^0-9])', ' \1 \2', 'g'), '([0-9])(-)', '\1 \2 ', 'g'), '[\s\p{Z}]+', ' ', 'g')), ' ') AS tokens FROM documents")
def mteval_tokens(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", tokenizers.mteval(F.col("text")).alias("tokens"))


@_query("SELECT conv_id, turn, list_transform(generate_series(1, greatest(length(text) - 4, 1)), lambda k: substr(text, k, 5)) AS windows, list_filter(string_split(text, ''), lambda c: c <> '') AS characters FROM conversations")
def character_windows(spark, sf_dir):
    return _table(spark, sf_dir, "conversations").select("conv_id", "turn", tokenizers.windows(F.col("text"), 5).alias("windows"), tokenizers.characters(F.col("text")).alias("characters"))


# --- metrics ---

_GRAMS = r"""w AS (SELECT conv_id, turn, list_filter(string_split_regex(text, '\s+'), lambda t: t <> '') AS o, list_filter(string_split_regex(prev, '\s+'), lambda t: t <> '') AS r FROM (SELECT *, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS prev FROM conversations) WHERE role = 'assistant' AND prev IS NOT NULL), g AS (SELECT conv_id, turn, n, unnest(list_transform(generate_series(1, len(o) - n + 1), lambda i: array_to_string(o[i:i + n - 1], ' '))) AS g, 0 AS side FROM w, range(1, 5) x(n) WHERE len(o) >= n UNION ALL SELECT conv_id, turn, n, unnest(list_transform(generate_series(1, len(r) - n + 1), lambda i: array_to_string(r[i:i + n - 1], ' '))), 1 FROM w, range(1, 5) x(n) WHERE len(r) >= n), m AS (SELECT conv_id, turn, n, least(count(*) FILTER (side = 0), count(*) FILTER (side = 1)) AS hit FROM g GROUP BY conv_id, turn, n, g), h AS (SELECT conv_id, turn, n, CAST(sum(hit) AS INT) AS hit FROM m GROUP BY ALL)"""


def _answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .queries import ev_chat

    return ev_chat(spark, sf_dir).where(F.col("references")[0].isNotNull())


@_query(f"WITH {_GRAMS}, t AS (SELECT n, sum(hit) AS hit FROM h GROUP BY n), l AS (SELECT n, sum(greatest(len(o) - n + 1, 0)) AS total, sum(len(o)) AS mine, sum(len(r)) AS theirs FROM w, range(1, 5) x(n) GROUP BY n) SELECT round(100 * exp(least(0, 1 - max(theirs) / max(mine))) * exp(avg(ln(hit / total))), 4) AS bleu FROM t JOIN l USING (n)")
def corpus_bleu(spark, sf_dir):
    summary = M.evaluate(_answers(spark, sf_dir), [M.bleu(tokenizers.whitespace)])[0]
    return summary.where("metric = 'bleu_score'").select(F.round("value", 4).alias("bleu"))


_SETS = r"""w AS (SELECT list_filter(string_split_regex(replace(text, '.', ' '), '\s+'), lambda t: t <> '') AS o, list_filter(string_split_regex(replace(prev, '.', ' '), '\s+'), lambda t: t <> '') AS r FROM (SELECT *, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS prev FROM conversations) WHERE role = 'assistant' AND prev IS NOT NULL), s AS (SELECT n, list_distinct(list_transform(generate_series(1, len(o) - n + 1), lambda i: array_to_string(o[i:i + n - 1], ' '))) AS x, list_distinct(list_transform(generate_series(1, len(r) - n + 1), lambda i: array_to_string(r[i:i + n - 1], ' '))) AS y FROM w, range(1, 3) t(n)), p AS (SELECT n, coalesce(len(list_intersect(x, y)) / nullif(CAST(len(x) AS DOUBLE), 0), 0) AS p, coalesce(len(list_intersect(x, y)) / nullif(CAST(len(y) AS DOUBLE), 0), 0) AS q FROM s)"""


@_query(f"WITH {_SETS} SELECT 'rouge' || n AS metric, round(avg(2 * p * q / (p + q + 1e-8)), 6) AS value FROM p GROUP BY n")
def rouge_ngrams(spark, sf_dir):
    summary = M.evaluate(_answers(spark, sf_dir), [M.rouge()])[0]
    return summary.where("metric IN ('rouge1', 'rouge2')").select("metric", F.round("value", 6).alias("value"))


@_query("SELECT 'format_accuracy-' || k AS metric, round(avg(CAST(CASE k WHEN 'short' THEN length(text) < 500 WHEN 'no_comma' THEN NOT contains(text, ',') ELSE contains(lower(text), 'the') END AS INT)), 6) AS value FROM documents, (VALUES ('short'), ('no_comma'), ('the')) c(k) GROUP BY k")
def checker_accuracies(spark, sf_dir):
    from ..functions import constraints as C

    named = {"short": C.ja_length(500, "未満"), "no_comma": C.no_comma, "the": C.keywords(["the"])}
    rows = _table(spark, sf_dir, "documents").select(C.checks(F.col("text"), named).alias("checks"))
    return M.checker_accuracies(rows, "checks").withColumn("value", F.round("value", 6))


@_query("WITH v AS (SELECT coalesce(try_cast(coalesce(regexp_extract_all(text, '[0-9]+')[-1], 'none') AS DOUBLE), 0.0) AS x, CAST(n_chars AS DOUBLE) AS y FROM documents) SELECT 'pearson_correlation' AS metric, round(corr(x, y), 6) AS value FROM v")
def text_correlation(spark, sf_dir):
    """Outputs that are texts; what isn't a number counts as 0."""
    digits = P.last_match("[0-9]+")(F.col("text"))
    rows = _table(spark, sf_dir, "documents").select(F.when(digits == "", "none").otherwise(digits).alias("x"), "n_chars")
    return M.correlation(rows, "x", "n_chars").withColumn("value", F.round("value", 6))


@_query("WITH s AS (SELECT CAST(length(text) > 300 AS INT) AS hit, unnest([lang, source]) AS category FROM documents) SELECT category, round(avg(hit), 6) AS value, count(*) AS n FROM s GROUP BY category UNION ALL SELECT NULL, round(avg(CAST(length(text) > 300 AS INT)), 6), count(*) FROM documents")
def array_categories(spark, sf_dir):
    """A metric of one's own, by a category with several values a row."""
    metric = M.Metric({"long": F.length("lm_output") > 300}, {"long": F.avg(F.col("long").cast("double"))}, {"long": F.avg(F.col("long").cast("double"))})
    rows = _table(spark, sf_dir, "documents").select(F.col("text").alias("lm_output"), F.array("lang", "source").alias("category"))
    return M.evaluate(rows, [metric], "category")[0].select("category", F.round("value", 6).alias("value"), "n")


@_query("SELECT 'toxic' AS metric, round(avg(CASE WHEN text = '' THEN 0.0 ELSE n_chars / 1000.0 END), 6) AS value FROM documents")
def attribute_scores(spark, sf_dir):
    rows = _table(spark, sf_dir, "documents").select(F.col("text").alias("lm_output"), "n_chars")
    return M.evaluate(rows, [M.attributes({"toxic": F.col("n_chars") / 1000.0})])[0].select("metric", F.round("value", 6).alias("value"))


# --- models, rounds, rewards, comparisons ---


def _upper_client():
    class Upper:
        def complete(self, prompts, seed):
            return [(p.upper(), "stop") for p in prompts]

        def chat(self, conversations, tools, seed):
            return [(f"answer {len(m)}", "stop") for m in conversations]

        def log_probs(self, texts, prefixes):
            return [-float(len(t)) - 0.5 * len(p) for t, p in zip(texts, prefixes)]

    return Upper()


@_query("SELECT doc_id, upper(source) AS lm_output, 'stop' AS finish_reason, -length(text) - 0.5 * length(lang) AS log_prob FROM documents")
def model_calls(spark, sf_dir):
    """Distinct prompts answered once and joined back, and log-probabilities, through the batching seam."""
    model = models.BatchAdapter(_upper_client)
    rows = model.complete_distinct(_table(spark, sf_dir, "documents"), "source")
    return model.log_probs(rows, "text", "lang").select("doc_id", "lm_output", "finish_reason", "log_prob")


_ASKS = "SELECT conv_id, count(*) AS n, count(*) FILTER (role IN ('user', 'tool') AND coalesce(a, '') <> 'assistant') AS asks FROM (SELECT *, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS a FROM conversations) GROUP BY conv_id"


@_query(f"SELECT conv_id, CAST(n + asks - CASE WHEN asks > 0 AND l THEN 1 ELSE 0 END AS INT) AS messages, CASE WHEN asks > 0 AND l THEN 'answer ' || (n + asks - 1) ELSE '' END AS lm_output, CASE WHEN asks > 0 THEN 'stop' ELSE 'no_slot' END AS finish_reason FROM ({_ASKS}) JOIN (SELECT conv_id, arg_max(role, turn) IN ('user', 'tool', 'assistant') AS l FROM conversations GROUP BY conv_id) USING (conv_id)")
def chat_evaluation(spark, sf_dir):
    rows = _conversations(spark, sf_dir).withColumns({"row_id": F.col("conv_id"), "references": F.array().cast("array<string>")})
    _, out = evaluations.chat_evaluation(rows, models.BatchAdapter(_upper_client), [M.output_length()])
    return out.select("conv_id", F.size("messages").alias("messages"), F.when(F.startswith("lm_output", F.lit("answer ")), F.col("lm_output")).otherwise("").alias("lm_output"), "finish_reason")


@_query("SELECT 'accuracy' AS metric, round(avg(CAST(length(source) < length(lang || doc_id) AS INT)), 6) AS value FROM documents UNION ALL SELECT 'accuracy-' || lang, round(avg(CAST(length(source) < length(lang || doc_id) AS INT)), 6) FROM documents GROUP BY lang")
def reward_evaluation(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").withColumn("other", F.concat("lang", "doc_id"))
    rows = shaping.reward(docs, "{{ text }}", "{{ source }}", "{{ other }}", "{{ lang }}").withColumn("row_id", F.col("doc_id"))
    return evaluations.reward(rows, evaluations.log_prob_judge(models.BatchAdapter(_upper_client)))[0].withColumn("value", F.round("value", 6))


@_query("WITH i AS (SELECT 'm' || (doc_id % 5) AS model, doc_id // 5 AS item_id, n_chars AS n FROM documents), m AS (SELECT a.model AS one, b.model AS two, CASE WHEN a.n > b.n THEN 1.0 WHEN a.n < b.n THEN 0.0 ELSE 0.5 END AS p FROM i a JOIN i b USING (item_id) WHERE a.model <> b.model) SELECT winner, loser, CAST(sum(p) AS DOUBLE) AS wins FROM (SELECT one AS winner, two AS loser, p FROM m UNION ALL SELECT two, one, 1 - p FROM m) GROUP BY ALL")
def win_matrix(spark, sf_dir):
    from .queries import _matches

    return pairwise.win_matrix(_matches(spark, sf_dir))


@_query("SELECT lang, source, n, CAST(run AS INT) AS run FROM (SELECT lang, source, count(*) AS n, 0 AS run FROM documents GROUP BY ALL UNION ALL SELECT lang, NULL, count(*), 1 FROM documents GROUP BY ALL)")
def concatenated_runs(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    return readers.runs([docs.groupBy("lang", "source").agg(F.count("*").alias("n")), docs.groupBy("lang").agg(F.count("*").alias("n"))]).select("lang", "source", "n", "run")


@_query("SELECT d.doc_id, CAST(count(*) AS INT) AS shots, min(item_id) AS first_shot, max(item_id) AS last_shot FROM labels d, (SELECT item_id FROM benchmark ORDER BY item_id LIMIT 3) GROUP BY d.doc_id")
def few_shot_fixed(spark, sf_dir):
    shots = _table(spark, sf_dir, "benchmark").orderBy("item_id").limit(3).select(F.col("item_id").alias("row_id"), "item_id")
    rows = _table(spark, sf_dir, "labels").select(F.col("doc_id").alias("row_id"))
    got = sampling.collected(sampling.fixed_shots(rows, shots), "row_id", ["item_id"])
    return got.select(F.col("row_id").alias("doc_id"), F.size("few_shot_data").alias("shots"), F.array_min("few_shot_data.item_id").alias("first_shot"), F.array_max("few_shot_data.item_id").alias("last_shot"))


@_query()
def common_prefixes(spark, sf_dir):
    """Common prefixes and substrings, best similarity and edit rates of whole chat turns; kernels that SQL doesn't have."""
    ev = _answers(spark, sf_dir)
    return ev.select("row_id", K.best_prefix()(F.col("lm_output"), F.col("references")).alias("prefix"), K.best_substring()(F.col("lm_output"), F.col("references")).alias("substring"))


@_query()
def random_matches(spark, sf_dir):
    """A draw of matches that favours the model with the fewest, over all keys."""
    items = _table(spark, sf_dir, "documents").select(F.concat(F.lit("m"), F.col("doc_id") % 5).alias("model"), F.floor(F.col("doc_id") / 5).cast("long").alias("item_id"), F.col("n_chars").alias("item"))
    return pairwise.random_combinations(items, 100).select("model1", "model2", "item_id")
