"""The registered queries over the whole tables, and the same in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import constraints as C
from ..functions import kernels as K
from ..functions import parsing, tokenizers
from ..functions import processors as P
from ..operators import chat, pairwise, sampling, shaping
from ..operators import metrics as M
from ..operators.metrics import Metric
from . import checker_queries

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


def _rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c).cast("double"), digits) for c in columns or [c for c, t in df.dtypes if t == "double"]})


# --- views: EVAL rows made from the tables ---


def ev_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assistant turns against the turn before; the category tells whether the conversation has a system turn."""
    w = Window.partitionBy("conv_id")
    turns = _table(spark, sf_dir, "conversations").withColumns({"prev": F.lag("text").over(w.orderBy("turn")), "sys": F.max((F.col("role") == "system").cast("int")).over(w)})
    return turns.where("role = 'assistant'").select((F.col("conv_id") * 1000 + F.col("turn")).alias("row_id"), F.col("text").alias("lm_output"), F.array("prev").alias("references"), F.when(F.col("sys") == 1, "system").otherwise("plain").alias("category"))


_EV_CHAT = """ev AS (SELECT conv_id * 1000 + turn AS row_id, text AS lm_output, [prev] AS refs, CASE WHEN sys = 1 THEN 'system' ELSE 'plain' END AS category FROM (SELECT *, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS prev, max(CAST(role = 'system' AS INT)) OVER (PARTITION BY conv_id) AS sys FROM conversations) WHERE role = 'assistant')"""


def ev_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts against themselves in lower case and the text of the doc_id before, by language."""
    docs = _table(spark, sf_dir, "documents")
    before = docs.select((F.col("doc_id") + 1).alias("doc_id"), F.col("text").alias("_before"))
    return docs.join(before, "doc_id", "left").select(F.col("doc_id").alias("row_id"), F.col("text").alias("lm_output"), F.filter(F.array(F.lower("text"), "_before"), lambda r: r.isNotNull()).alias("references"), F.col("lang").alias("category"))


_EV_TEXTS = "ev AS (SELECT d.doc_id AS row_id, d.text AS lm_output, list_filter([lower(d.text), b.text], lambda r: r IS NOT NULL) AS refs, d.lang AS category FROM documents d LEFT JOIN documents b ON b.doc_id = d.doc_id - 1)"


def _summary(view: str, rows: str, overall: dict[str, str], per: dict[str, str] | None = None) -> str:
    """SQL of ``metric, category, value, n``."""
    parts = [f"SELECT '{k}' AS metric, CAST(NULL AS VARCHAR) AS category, round(CAST({e} AS DOUBLE), 6) AS value, count(*) AS n FROM s" for k, e in overall.items()]
    parts += [f"SELECT '{k}' AS metric, category, round(CAST({e} AS DOUBLE), 6) AS value, count(*) AS n FROM s GROUP BY category" for k, e in (per or {}).items()]
    return f"WITH {view}, s AS (SELECT category, {rows} FROM ev) " + " UNION ALL ".join(parts)


_STRIP = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"
_EM = f"CAST(coalesce(list_contains(list_transform(refs, lambda r: lower({_STRIP.format('r')})), lower({_STRIP.format('lm_output')})), false) AS INT) AS em"
_SUB = "CAST(coalesce(len(list_filter(refs, lambda r: r IS NOT NULL AND contains(lm_output, r))) > 0, false) AS INT) AS sub"
_OFFLINE = ({"exact_match": "avg(em)", "substring_match-any": "avg(sub)", "avg_output_length": "avg(len)", "max_output_length": "max(len)", "min_output_length": "min(len)"}, {"exact_match": "avg(em)", "substring_match-any": "avg(sub)"})


def _offline(ev: DataFrame) -> DataFrame:
    clean = [P.strip, P.lower]
    return _rounded(M.evaluate(ev, [M.exact_match(clean, clean), M.substring_match("any"), M.output_length()], "category")[0])


@_query(_summary(_EV_CHAT, f"{_EM}, {_SUB}, length(lm_output) AS len", *_OFFLINE))
def eval_offline_summary(spark, sf_dir):
    return _offline(ev_chat(spark, sf_dir))


@_query(_summary(_EV_TEXTS, f"{_EM}, {_SUB}, length(lm_output) AS len", *_OFFLINE))
def eval_short_summary(spark, sf_dir):
    return _offline(ev_texts(spark, sf_dir))


@_query(f"WITH {_EV_TEXTS} SELECT row_id, list_contains(refs, lm_output) AS exact_match, len(list_filter(refs, lambda r: contains(lm_output, r))) > 0 AS any_in, len(list_filter(refs, lambda r: contains(lm_output, r))) = len(refs) AS all_in FROM ev")
def match_details(spark, sf_dir):
    scored = M.details(ev_texts(spark, sf_dir), [M.exact_match(), M.substring_match("any"), M.substring_match("all")])
    return scored.select("row_id", "exact_match", F.col("substring_match-any").alias("any_in"), F.col("substring_match-all").alias("all_in"))


@_query(r"""SELECT doc_id, lower(regexp_replace(split_part(text, chr(10), -1), '^\s+|\s+$', '', 'g')) AS last_line, coalesce(regexp_extract_all(text, '(?s)\d+')[-1], '') AS last_digits, CASE WHEN contains(v, '.') THEN rtrim(rtrim(v, '0'), '.') ELSE v END AS number FROM (SELECT *, rtrim(coalesce(regexp_extract_all(replace(text, ',', ''), '-?\d+\.?\d*')[-1], ''), '.') AS v FROM documents)""")
def processor_chains(spark, sf_dir):
    text = F.col("text")
    return _table(spark, sf_dir, "documents").select("doc_id", P.chain([P.last_line, P.strip, P.lower])(text).alias("last_line"), P.last_match(r"[0-9]+")(text).alias("last_digits"), P.number()(text).alias("number"))


@_query(r"""WITH t AS (SELECT conv_id, turn, list_filter(string_split_regex(text, '\s+'), lambda t: t <> '') AS tok FROM conversations), g AS (SELECT conv_id, turn, len(tok) AS tokens, CASE WHEN len(tok) < 4 THEN [] ELSE list_transform(generate_series(1, len(tok) - 3), lambda i: array_to_string(tok[i:i + 3], '__')) END AS g FROM t) SELECT conv_id, turn, CAST(tokens AS INT) AS tokens, round(CASE WHEN len(g) = 0 THEN 0.0 ELSE 1 - len(list_distinct(g)) / CAST(len(g) AS DOUBLE) END, 6) AS repetition_4 FROM g""")
def ngram_repetition(spark, sf_dir):
    rows = _table(spark, sf_dir, "conversations").withColumnRenamed("text", "lm_output").withColumn("references", F.array().cast("array<string>"))
    return M.details(rows, [M.repetition_n(4)]).select("conv_id", "turn", F.size(tokenizers.whitespace(F.col("lm_output"))).alias("tokens"), F.round("repetition_4", 6).alias("repetition_4"))


@_query("""WITH w AS (SELECT conv_id, turn, k, substr(text, k, 10) AS w FROM (SELECT conv_id, turn, text, unnest(generate_series(1, greatest(length(text) - 9, 1))) AS k FROM conversations)), c AS (SELECT conv_id, turn, w, count(*) AS n, min(k) AS p FROM w WHERE left(w, 1) NOT IN (' ', '=', '-', '/') AND right(w, 1) NOT IN (' ', '=', '-', '/') GROUP BY ALL) SELECT v.conv_id, v.turn, coalesce(b.most, '') AS most_repeated, CAST(coalesce(b.n, 0) AS INT) AS count FROM conversations v LEFT JOIN (SELECT conv_id, turn, first(w ORDER BY n DESC, p) AS most, max(n) AS n FROM c GROUP BY ALL) b USING (conv_id, turn)""")
def window_repetition(spark, sf_dir):
    rows = _table(spark, sf_dir, "conversations")
    return rows.select("conv_id", "turn", K.repeated(10)(F.col("text")).alias("r")).select("conv_id", "turn", "r.most_repeated", "r.count")


@_query()
def text_similarity_summary(spark, sf_dir):
    """BLEU, ROUGE, SARI, error rates, character F1 and common strings of the chat turns."""
    ev = ev_chat(spark, sf_dir).withColumn("references", F.filter("references", lambda r: r.isNotNull()))
    ev = ev.withColumn("source", F.coalesce(F.try_element_at("references", F.lit(1)), F.lit("")))
    found: list[Metric] = [M.char_f1(), M.common_prefix_length(), M.common_string_length(), M.bleu(), M.rouge(), M.sari(F.col("source")), M.error_rates(), M.math_verify(), M.repetition_count()]
    return _rounded(M.evaluate(ev, found, "category")[0])


_SCORED = "v AS (SELECT d.doc_id AS id, CAST(n_chars AS DOUBLE) AS x, CAST(quality AS DOUBLE) + toxic AS y FROM documents d JOIN labels USING (doc_id))"


@_query(f"WITH {_SCORED}, r AS (SELECT rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0 AS rx, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0 AS ry FROM v), p AS (SELECT sign(a.x - b.x) * sign(a.y - b.y) AS s, CAST(a.x = b.x AS INT) AS tx, CAST(a.y = b.y AS INT) AS ty FROM v a JOIN v b ON a.id < b.id) SELECT 'pearson_correlation' AS metric, round(corr(x, y), 6) AS value FROM v UNION ALL SELECT 'spearman_correlation', round(corr(rx, ry), 6) FROM r UNION ALL SELECT 'kendall_correlation', round(sum(s) / (sqrt(CAST(count(*) - sum(tx) AS DOUBLE)) * sqrt(CAST(count(*) - sum(ty) AS DOUBLE))), 6) FROM p")
def correlations(spark, sf_dir):
    rows = _table(spark, sf_dir, "documents").select("doc_id", "n_chars").join(_table(spark, sf_dir, "labels"), "doc_id").select(F.col("n_chars").cast("double").alias("x"), (F.col("quality") + F.col("toxic")).cast("double").alias("y"))
    out = M.correlation(rows, "x", "y")
    for method in ("spearman", "kendall"):
        out = out.unionByName(M.correlation(rows, "x", "y", method))
    return _rounded(out)


@_query("SELECT 'finish_reason_ratio-' || event_type AS metric, round(count(*) / CAST((SELECT count(*) FROM events) AS DOUBLE), 6) AS value FROM events GROUP BY event_type")
def finish_reasons(spark, sf_dir):
    return _rounded(M.value_ratio(_table(spark, sf_dir, "events"), "event_type", "finish_reason"))


@_query("SELECT event_id, json_valid(props) AS valid, 'call_' || left(sha256(CAST(event_id AS VARCHAR)), 24) AS call_id FROM events")
def tool_calls(spark, sf_dir):
    return _table(spark, sf_dir, "events").select("event_id", P.tool_arguments_valid(F.col("props")).alias("valid"), P.tool_call_id(F.col("event_id").cast("string")).alias("call_id"))


_JUDGE = "ev AS (SELECT lang AS category, text AS answer FROM documents)"


@_query(_summary(_JUDGE, r"try_cast(regexp_extract_all(answer, '(\d+)', 1)[-1] AS INT) AS raw, CASE WHEN raw BETWEEN 1 AND 500 THEN raw END AS score", {"llm_score": "avg(score)", "num_failed_score_parses": "count(*) - count(score)"}, {"llm_score": "avg(score)"}))
def judge_scores(spark, sf_dir):
    ev = _table(spark, sf_dir, "documents").select(F.col("lang").alias("category"), F.col("text").alias("answer"))
    return _rounded(M.evaluate(ev, [M.judge_score("answer", (1, 500))], "category")[0])


_LABELS = ("the", "in", "an")
_DISTRIBUTION = {"llm_score": "avg(CASE label WHEN 'the' THEN 1.0 WHEN 'in' THEN 0.5 WHEN 'an' THEN 0.0 END)"} | {f"llm_label_distribution-{x}": f"count(*) FILTER (label = '{x}') / CAST(count(label) AS DOUBLE)" for x in _LABELS}


@_query(_summary(_JUDGE, "regexp_extract_all(answer, '(the|in|an)', 1)[-1] AS label", _DISTRIBUTION | {"num_failed_score_parses": "count(*) - count(label)"}, _DISTRIBUTION))
def judge_labels(spark, sf_dir):
    ev = _table(spark, sf_dir, "documents").select(F.col("lang").alias("category"), F.col("text").alias("answer"))
    return _rounded(M.evaluate(ev, [M.judge_label("answer", _LABELS, (1.0, 0.5, 0.0))], "category")[0])


@_query("SELECT vec_id, round(list_sum(list_transform(generate_series(1, 64), lambda k: k * exp(CAST(embedding[k] AS DOUBLE)))) / list_sum(list_transform(generate_series(1, 64), lambda k: exp(CAST(embedding[k] AS DOUBLE)))), 6) AS score FROM embeddings")
def judge_weighted_scores(spark, sf_dir):
    rows = _table(spark, sf_dir, "embeddings")
    log_probs = F.map_from_arrays(F.array(*[F.lit(str(k)) for k in range(1, 65)]), F.transform("embedding", lambda x: x.cast("double")))
    return rows.select("vec_id", F.round(parsing.weighted_score(log_probs, (1, 64)), 6).alias("score"))


@_query(r"SELECT doc_id, CASE n WHEN 1 THEN 'model1' WHEN 2 THEN 'model2' ELSE 'draw' END AS winner, CASE WHEN d IS NULL THEN 'Parsing failure: ' || text WHEN n BETWEEN 1 AND 3 THEN text ELSE 'Invalid judge ''' || d || ''': ' || text END AS rationale FROM (SELECT doc_id, text, regexp_extract_all(text, '(\d+)', 1)[-1] AS d, try_cast(d AS INT) AS n FROM documents)")
def judge_winners(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", parsing.judge_winner(F.col("text")).alias("w")).select("doc_id", "w.winner", "w.rationale")


def _choices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.multiple_choice(_table(spark, sf_dir, "embeddings").select("vec_id", F.col("label").alias("answer_index"), F.transform("embedding", lambda x: x.cast("double")).alias("log_probs"), F.array(*[F.lit("x" * (k + 1)) for k in range(64)]).alias("choices")))


_CHOICES = "m AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS p FROM embeddings), q AS (SELECT vec_id, label, CAST(list_position(p, list_max(p)) - 1 AS INT) AS prediction, list_transform(p, lambda x, i: x / i) AS b FROM m), r AS (SELECT vec_id, label, prediction, CAST(list_position(b, list_max(b)) - 1 AS INT) AS byte_norm_prediction FROM q)"


@_query(f"WITH {_CHOICES} SELECT vec_id, prediction, byte_norm_prediction, prediction = label AS correct, byte_norm_prediction = label AS byte_norm_correct FROM r")
def multiple_choice_details(spark, sf_dir):
    return _choices(spark, sf_dir).select("vec_id", "prediction", "byte_norm_prediction", "correct", "byte_norm_correct")


@_query(f"WITH {_CHOICES}, l AS (SELECT label AS y FROM r UNION SELECT prediction FROM r), f AS (SELECT y, (SELECT count(*) FROM r WHERE label = y AND prediction = y) AS hit, (SELECT count(*) FROM r WHERE label = y) + (SELECT count(*) FROM r WHERE prediction = y) AS n FROM l) SELECT round(avg(CAST(prediction = label AS INT)), 6) AS accuracy, round(avg(CAST(byte_norm_prediction = label AS INT)), 6) AS byte_norm_accuracy, (SELECT round(avg(2.0 * hit / n), 6) FROM f) AS macro_f1, round(avg(CAST(prediction = label AS INT)), 6) AS micro_f1 FROM r")
def multiple_choice_summary(spark, sf_dir):
    from .evaluations import multiple_choice

    rows = _table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("row_id"), F.col("label").alias("answer_index"), F.transform("embedding", lambda x: x.cast("double")).alias("log_probs"), F.array(*[F.lit("x" * (k + 1)) for k in range(64)]).alias("choices"))
    return _rounded(multiple_choice(rows)[0])


@_query("SELECT CAST(round(sum(-0.01 * n_chars), 2) AS DOUBLE) AS total_log_prob, round(exp(-sum(CAST(-0.01 AS DOUBLE) * n_chars) / sum(strlen(text))), 6) AS perplexity_per_byte, round(exp(-sum(CAST(-0.01 AS DOUBLE) * n_chars) / sum(length(text))), 6) AS perplexity_per_character FROM documents")
def perplexities(spark, sf_dir):
    rows = _table(spark, sf_dir, "documents").select("text", (F.col("n_chars") * -0.01).alias("log_prob"))
    out = M.perplexity(rows)
    return _rounded(_rounded(out, "total_log_prob", digits=2), "perplexity_per_byte", "perplexity_per_character")


@_query("SELECT 'accuracy' AS metric, round(avg(CAST(n_chars % 1000 > doc_id * 37 % 1000 AS INT)), 6) AS value FROM documents UNION ALL SELECT 'accuracy-' || lang, round(avg(CAST(n_chars % 1000 > doc_id * 37 % 1000 AS INT)), 6) FROM documents GROUP BY lang")
def reward_accuracies(spark, sf_dir):
    rows = _table(spark, sf_dir, "documents").select((F.col("n_chars") % 1000).alias("c"), (F.col("doc_id") * 37 % 1000).alias("r"), "lang")
    return _rounded(M.reward_accuracy(rows, "c", "r", "lang"))


_MATCHES = "i AS (SELECT 'm' || (doc_id % 5) AS model, doc_id // 5 AS item_id, n_chars AS n FROM documents), m AS (SELECT a.model AS model1, b.model AS model2, item_id, CASE WHEN a.n > b.n THEN 'model1' WHEN a.n < b.n THEN 'model2' ELSE 'draw' END AS winner FROM i a JOIN i b USING (item_id) WHERE a.model <> b.model)"


def _matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = _table(spark, sf_dir, "documents").select(F.concat(F.lit("m"), F.col("doc_id") % 5).alias("model"), F.floor(F.col("doc_id") / 5).cast("long").alias("item_id"), F.col("n_chars").alias("item"))
    judge = lambda df: df.withColumns({"winner": F.when(F.col("item1") > F.col("item2"), "model1").when(F.col("item1") < F.col("item2"), "model2").otherwise("draw"), "rationale": F.lit("length")})
    return pairwise.judged(pairwise.all_combinations(items), judge)


@_query(f"WITH {_MATCHES} SELECT model1, model2, item_id, winner FROM m")
def pairwise_matches(spark, sf_dir):
    return _matches(spark, sf_dir).select("model1", "model2", "item_id", "winner")


@_query(f"WITH {_MATCHES} SELECT model, round(100 * avg(p), 6) AS win_rate FROM (SELECT model1 AS model, CASE winner WHEN 'draw' THEN 0.5 WHEN 'model1' THEN 1.0 ELSE 0.0 END AS p FROM m UNION ALL SELECT model2, CASE winner WHEN 'draw' THEN 0.5 WHEN 'model2' THEN 1.0 ELSE 0.0 END FROM m) GROUP BY model")
def win_rates(spark, sf_dir):
    return _rounded(pairwise.win_rate(_matches(spark, sf_dir)))


@_query()
def bradley_terry_ratings(spark, sf_dir):
    return pairwise.bradley_terry(_matches(spark, sf_dir))


_MD5 = "CAST('0x' || left(md5({}), 12) AS BIGINT)"
_STEPS = f"list_filter({list(sampling.PRIMES)}, lambda p: {{n}} % p <> 0)"


def _walk(what: str, key: str, size: str, at: str) -> str:
    """SQL of where a walk is after some steps."""
    steps = _STEPS.format(n=size)
    start, step = (_MD5.format(f"'42:{what}:{x}:' || {key}") for x in ("start", "step"))
    return f"(({start} + {at} * {steps}[{step} % len({steps}) + 1]) % {size})"


_POOL = "b AS (SELECT item_id, label, row_number() OVER (PARTITION BY {by} ORDER BY md5('42:' || item_id), item_id) - 1 AS spot FROM (SELECT item_id, item_id % 3 AS label FROM benchmark))"


@_query(f"WITH {_POOL.format(by='1')}, n AS (SELECT count(*) AS n FROM b), r AS (SELECT doc_id, k, {_walk('row', 'doc_id', 'n', 'k')} AS spot FROM labels, n, range(3) s(k)) SELECT doc_id, item_id, CAST(k + 1 AS INT) AS shot_rank FROM r JOIN b USING (spot)")
def few_shot_random(spark, sf_dir):
    shots = sampling.random_shots(_table(spark, sf_dir, "labels").select("doc_id"), _table(spark, sf_dir, "benchmark").select("item_id"), 3, row_key="doc_id", shot_key="item_id")
    return shots.select("doc_id", F.col("shot_item_id").alias("item_id"), "shot_rank")


@_query(f"WITH {_POOL.format(by='label')}, l AS (SELECT label, count(*) AS size, row_number() OVER (ORDER BY md5('42:' || label)) - 1 AS l FROM b GROUP BY label), c AS (SELECT count(*) AS n FROM l), r AS (SELECT doc_id, t, 4 // n + CAST(t < 4 % n AS INT) AS quota, {_walk('label', 'doc_id', 'n', 't')} AS l FROM labels, c, range(64) s(t) WHERE t < least(n, 4)), q AS (SELECT doc_id, t, label, k, {_walk('row', "doc_id || ':' || l", 'size', 'k')} AS spot FROM r JOIN l USING (l), range(4) s(k) WHERE k < least(size, quota)) SELECT doc_id, item_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY k, t) AS INT) AS shot_rank FROM q JOIN b USING (label, spot)")
def few_shot_balanced(spark, sf_dir):
    pool = _table(spark, sf_dir, "benchmark").select("item_id", (F.col("item_id") % 3).alias("label"))
    shots = sampling.balanced_shots(_table(spark, sf_dir, "labels").select("doc_id"), pool, 4, "label", row_key="doc_id", shot_key="item_id")
    return shots.select("doc_id", F.col("shot_item_id").alias("item_id"), "shot_rank")


@_query("SELECT conv_id, min(CASE WHEN role IN ('user', 'tool') AND coalesce(a, '') <> 'assistant' THEN turn + 1 END) AS slot FROM (SELECT *, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS a FROM conversations) GROUP BY conv_id")
def response_slots(spark, sf_dir):
    return chat.turn_slots(_table(spark, sf_dir, "conversations"))


@_query("SELECT doc_id, CASE WHEN length(text) + 3 <= 80 THEN text ELSE left(text, 38) || '...' || right(text, 39) END AS prompt, [upper(lang) || ': ' || source] AS refs FROM documents")
def shaped_items(spark, sf_dir):
    items = _table(spark, sf_dir, "documents").withColumn("row_id", F.col("doc_id"))
    shaped = shaping.generation(items, reference="{{ lang | upper }}: {{ source }}", inputs={"prompt": "{{ text | truncate_middle(80) }}"})
    return shaped.select("doc_id", "prompt", F.col("references").alias("refs"))


@_query("WITH c AS (SELECT doc_id, list_filter([lang, CASE WHEN doc_id % 3 = 0 THEN '' ELSE source END, 'none'], lambda x: x <> '') AS c FROM documents) SELECT doc_id, list_transform(c, lambda x: ' ' || x) AS choices, CAST(doc_id % 2 AS INT) AS answer_index FROM c")
def choice_items(spark, sf_dir):
    items = _table(spark, sf_dir, "documents").select("doc_id", "lang", "source", (F.col("doc_id") % 3).alias("third"), (F.col("doc_id") % 2).alias("gold"))
    return shaping.choices(items, ["{{ lang }}", "{% if third == 0 %}{% else %}{{ source }}{% endif %}", "none"], "{{ gold }}", leading_blank=True).select("doc_id", "choices", "answer_index")


@_query(r"""WITH c AS (SELECT len(regexp_extract_all(text, '\[.*?\]')) >= 1 AS a, len(regexp_extract_all(text, '(?m)^\s*\*[^\*].*$')) + len(regexp_extract_all(text, '(?m)^\s*-.*$')) = 0 AS b, contains(lower(text), 'the') AS c, NOT contains(text, ',') AS d, length(lower(text)) - length(replace(lower(text), 'e', '')) >= 50 AS e, NOT contains(text, '。') AS f, length(text) >= 500 AS g FROM documents), l AS (SELECT [a, b, c, d, e, f, g] AS x FROM c) SELECT round(avg(CAST(len(list_filter(x, lambda y: y)) = 7 AS INT)), 6) AS macro, round(sum(len(list_filter(x, lambda y: y))) / CAST(sum(7) AS DOUBLE), 6) AS micro, count(*) FILTER (x[1]) AS placeholders, count(*) FILTER (x[2]) AS bullets, count(*) FILTER (x[4]) AS no_comma FROM l""")
def instruction_checks(spark, sf_dir):
    named = {"placeholders": C.placeholders(1), "bullets": C.bullets(0), "keywords": C.keywords(["the"]), "no_comma": C.no_comma, "letters": C.letter_frequency("e", 50), "no_period": C.ja_no_period, "length": C.ja_length(500)}
    rows = _table(spark, sf_dir, "documents").select(C.checks(F.col("text"), named).alias("checks"))
    metric = M.constraints("checks")
    one = lambda k: F.count_if(F.exists("checks", lambda c: (c["name"] == k) & c["passed"])).alias(k)
    return M.details(rows, [metric]).agg(F.round(metric.overall["format_accuracy-macro"], 6).alias("macro"), F.round(metric.overall["format_accuracy-micro"], 6).alias("micro"), one("placeholders"), one("bullets"), one("no_comma"))


@_query("SELECT item_id, lang, count(*) AS docs FROM benchmark b JOIN documents d ON contains(d.text, b.text) GROUP BY ALL")
def benchmark_containment(spark, sf_dir):
    items = _table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("needle"))
    size = items.agg(F.sum(F.octet_length("needle"))).first()[0] or 0
    if size <= sampling.BROADCAST_BYTES:
        items = F.broadcast(items)
    return _table(spark, sf_dir, "documents").join(items, F.contains("text", "needle")).groupBy("item_id", "lang").agg(F.count("*").alias("docs"))


@_query("SELECT doc_id, split_part(split_part(text, '.', 1), ' the', 1) AS text, CASE WHEN contains(text, '.') OR contains(split_part(text, '.', 1), ' the') THEN 'stop' ELSE 'length' END AS finish_reason FROM documents")
def stopped_outputs(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", P.stop_at(F.col("text"), [".", " the"]).alias("s")).select("doc_id", "s.text", "s.finish_reason")


@_query(r"SELECT doc_id, regexp_extract(text, '(?s)^(.*?)\.(.*)$', 1) AS reasoning_text, regexp_extract(text, '(?s)^(.*?)\.(.*)$', 2) AS lm_output FROM documents WHERE regexp_matches(text, '(?s)^(.*?)\.(.*)$')")
def reasoning_split(spark, sf_dir):
    made = P.postprocess(F.col("text"), parser=P.reasoning(r"^(?P<reasoning_content>.*?)\.(?P<content>.*)$"))
    return _table(spark, sf_dir, "documents").select("doc_id", made["reasoning_text"].alias("reasoning_text"), made["lm_output"].alias("lm_output")).where("reasoning_text IS NOT NULL")


@_query(checker_queries.ENGLISH_SQL)
def english_checkers(spark, sf_dir):
    return checker_queries.english(_table(spark, sf_dir, "documents"))


@_query(checker_queries.JAPANESE_SQL)
def japanese_checkers(spark, sf_dir):
    return checker_queries.japanese(_table(spark, sf_dir, "documents"))



from . import more_queries  # noqa: E402  these use the views above

QUERIES.update(more_queries.QUERIES)
ORACLE_SQL.update(more_queries.ORACLE_SQL)
