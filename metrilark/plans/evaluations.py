"""Whole evaluations: rows, a model, metrics, and a recorder; and setups read from JSON."""

from __future__ import annotations

import importlib
import json
from collections.abc import Callable, Sequence
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.templates import Template
from ..models import Adapter
from ..operators import metrics as M
from ..operators import chat, pairwise, shaping
from ..operators.sampling import collected, random_shots
from ..session import written
from ..sources.readers import with_extra_info


def offline(rows: DataFrame, metrics: Sequence[M.Metric], category: str | None = None, references: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(summary, details) of outputs that exist already."""
    return M.evaluate(shaping.override_references(rows, references) if references is not None else rows, metrics, category)


def generation(rows: DataFrame, prompt: str, model: Adapter, metrics: Sequence[M.Metric], shots: DataFrame | None = None, num_shots: int = 0, shot_columns: list[str] | None = None, leak: list[str] | None = None, max_instances: int | None = None, seed: int = 42, category: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Prompts from a template, which sees ``few_shot_data`` if there are shots; the model's answers; the metrics."""
    rows = shaping.first_rows(rows, max_instances)
    if shots is not None and num_shots:
        drawn = random_shots(rows.select("row_id", *(leak or [])), shots, num_shots, seed, leak=leak)
        rows = rows.join(collected(drawn, "row_id", shot_columns or [c for c in shots.columns if c != "row_id"]), "row_id")
    prompted = rows.withColumn("lm_prompt", Template(prompt)(rows))
    return M.evaluate(model.complete(prompted, "lm_prompt"), metrics, category)


def multiple_choice(scored: DataFrame, max_instances: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(summary, details) of rows with ``choices, log_probs, answer_index``: accuracies and F1."""
    rows = M.multiple_choice(shaping.first_rows(scored, max_instances))
    means = rows.agg(F.avg(F.col("correct").cast("double")).alias("accuracy"), F.avg(F.col("byte_norm_correct").cast("double")).alias("byte_norm_accuracy"))
    return means.crossJoin(M.f1_scores(rows, "answer_index", "prediction")), rows


def perplexity(rows: DataFrame, model: Adapter, tokens: str | None = None, max_instances: int | None = None) -> tuple[DataFrame, DataFrame]:
    scored = model.log_probs(shaping.first_rows(rows, max_instances), "text", "prefix")
    return M.perplexity(scored, tokens=tokens), scored


def chat_evaluation(rows: DataFrame, model: Adapter, metrics: Sequence[M.Metric], shots: Column | None = None, tools: str | None = None, max_instances: int | None = None, category: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Conversations ``row_id, messages, ...`` answered turn by turn, with the example conversations ``shots`` (array<array<message>>) before the first responding turn; then the metrics.

    ``lm_output`` is the last answer, which isn't among the ``messages`` that are kept; a conversation without an open turn has the output "" and the reason "no_slot".
    """
    rows = shaping.first_rows(rows, max_instances)
    if shots is not None:
        rows = rows.withColumn("messages", chat.insert_examples(F.col("messages"), shots))
    rows = rows.withColumns({"messages": F.transform("messages", lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"))), "_before": F.size("messages"), "finish_reason": F.lit(None).cast("string")})
    answered = chat.rounds(rows, lambda df: model.chat(df, "messages", tools).withColumnRenamed("lm_output", "answer"), written)
    last = F.element_at("messages", F.when(F.size("messages") > 0, F.lit(-1)))
    new = F.size("messages") > F.col("_before")
    said = last["role"] == "assistant"
    out = answered.withColumns({"lm_output": F.when(new & said, last["content"]).otherwise(""), "finish_reason": F.when(new, F.col("finish_reason")).otherwise("no_slot")})
    out = out.withColumn("messages", F.when(new & said, F.slice("messages", F.lit(1), F.size("messages") - 1)).otherwise(F.col("messages"))).drop("_before")
    return M.evaluate(out, metrics, category)


def _only(column: str) -> Column:
    """The text of a conversation of one message; any other is an error."""
    return F.when(F.size(column) == 1, F.col(column)[0]["content"]).otherwise(F.raise_error(F.lit(f"{column} must have exactly one message")).cast("string"))


def log_prob_judge(model: Adapter) -> Callable[[DataFrame], DataFrame]:
    """A judge of ``prompt, chosen, rejected``: right if the chosen answer has the strictly higher log-probability after the prompt."""

    def judge(rows: DataFrame) -> DataFrame:
        rows = rows.withColumn("_prompt", F.array_join(F.transform("prompt", lambda m: m["content"]), "\n"))
        for side in ("chosen", "rejected"):
            rows = model.log_probs(rows.withColumn("_text", _only(side)), "_text", "_prompt").withColumnRenamed("log_prob", f"log_prob_{side}")
        return rows.drop("_prompt", "_text").withColumn("is_correct", F.col("log_prob_chosen") > F.col("log_prob_rejected"))

    return judge


def both_orders_judge(model: Adapter, template: str) -> Callable[[DataFrame], DataFrame]:
    """A judge that asks ``model`` twice, with the answers in both orders: ``template`` sees ``prompt``, ``answer_a`` and ``answer_b``. Right only if both verdicts are."""

    def judge(rows: DataFrame) -> DataFrame:
        texts = {"_prompt_text": F.array_join(F.transform("prompt", lambda m: m["content"]), "\n"), "_chosen": _only("chosen"), "_rejected": _only("rejected")}
        rows = rows.withColumns(texts)
        for order, a, b in (("ab", "_chosen", "_rejected"), ("ba", "_rejected", "_chosen")):
            asked = rows.withColumn("_asked", Template(template)(prompt=F.col("_prompt_text"), answer_a=F.col(a), answer_b=F.col(b)))
            rows = model.complete(asked, "_asked").withColumnRenamed("lm_output", f"judge_{order}").drop("_asked", "finish_reason")
        return M.order_invariant_verdicts(rows, "judge_ab", "judge_ba").drop(*texts)

    return judge


def reward(rows: DataFrame, judge: Callable[[DataFrame], DataFrame], category: str = "category_key", max_instances: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(``metric, value`` with the accuracy overall and by category, rows with ``is_correct`` and what else the judge says) of ``prompt, chosen, rejected``. The columns of the rows win over the judge's of the same name."""
    rows = with_extra_info(shaping.first_rows(rows, max_instances))
    judged = judge(rows)
    return M.reward_accuracy(judged.withColumn("_zero", F.lit(0)).withColumn("_hit", F.col("is_correct").cast("int")), "_hit", "_zero", category), judged


def compared(items: DataFrame, judge: Callable[[DataFrame], DataFrame], match_maker: Callable[..., DataFrame] = pairwise.all_combinations, cached: DataFrame | None = None) -> tuple[dict[str, DataFrame], DataFrame]:
    """({scorer: scores}, matches): the matches made, those without a winner judged, then win rates and ratings."""
    matches = pairwise.judged(match_maker(items, cached=cached), judge)
    return {"win_rate": pairwise.win_rate(matches), "bradley_terry": pairwise.bradley_terry(matches)}, matches


def build(config: dict | list | str | int | float | bool | None):
    """Objects from nested ``{"class_path": "module.name", "init_args": {...}}``; names without a module are metrics."""
    if isinstance(config, list):
        return [build(c) for c in config]
    if not isinstance(config, dict):
        return config
    if "class_path" not in config:
        return {k: build(v) for k, v in config.items()}
    module, _, name = config["class_path"].rpartition(".")
    found = getattr(importlib.import_module(module) if module else M, name)
    return found(**{k: build(v) for k, v in (config.get("init_args") or {}).items()})


def load(path: str, overrides: dict[str, object] | None = None) -> dict:
    """A JSON configuration with values replaced at dotted paths."""
    config = json.loads(Path(path).read_text())
    for dotted, value in (overrides or {}).items():
        at = config
        *above, last = dotted.split(".")
        for k in above:
            at = at[int(k)] if isinstance(at, list) else at.setdefault(k, {})
        at[last] = value
    return config


def main(argv: Sequence[str] | None = None) -> int:
    """``python -m metrilark.plans.evaluations --eval-file rows.jsonl --metrics metrics.json --save-dir out``: offline scoring."""
    import argparse

    from ..session import session, ship
    from ..sources.readers import evaluation_file
    from ..sources.recorders import FolderRecorder

    p = argparse.ArgumentParser(description=main.__doc__)
    p.add_argument("--eval-file", required=True)
    p.add_argument("--metrics", required=True, help="JSON list of metrics")
    p.add_argument("--save-dir", required=True)
    p.add_argument("--category")
    p.add_argument("--force", action="store_true")
    args = p.parse_args(argv)
    spark: SparkSession = ship(session())
    recorder = FolderRecorder(spark, args.save_dir, args.force)
    if recorder.is_metrics_saved() and not args.force:
        return 0
    config = load(args.metrics)
    summary, scored = offline(evaluation_file(spark, args.eval_file), build(config), args.category)
    recorder.record_config({"metrics": config, "eval_file": args.eval_file})
    recorder.record_outputs(scored)
    recorder.record_metrics(summary)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
