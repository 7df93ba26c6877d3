"""Dataset shaping: slices, conditions, templates and references over raw items, which carry a ``row_id`` from 0 in dataset order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.templates import Template


def data_range(df: DataFrame, start: int | None = None, end: int | None = None) -> DataFrame:
    """Rows ``start`` to ``end`` - 1 of the dataset order; negative numbers count from the end."""
    if (start or 0) < 0 or (end or 0) < 0:
        n = df.count()
        start, end = (n + start if (start or 0) < 0 else start), (n + end if (end or 0) < 0 else end)
    if start:
        df = df.where(F.col("row_id") >= start)
    return df if end is None else df.where(F.col("row_id") < end)


def conditions(df: DataFrame, keep: dict[str, str] | None = None, remove: dict[str, str] | None = None) -> DataFrame:
    """Rows whose rendered ``keep`` templates all have, and ``remove`` templates all lack, the value given."""
    for source, value in (keep or {}).items():
        df = df.where(Template(source)(df) == value)
    for source, value in (remove or {}).items():
        df = df.where(~Template(source)(df).eqNullSafe(F.lit(value)))
    return df


def first_rows(df: DataFrame, n: int | None) -> DataFrame:
    """The first ``n`` rows in dataset order."""
    return df if n is None else df.orderBy("row_id").limit(n)


def project(df: DataFrame, templates: dict[str, str] | None) -> DataFrame:
    """New columns from templates, all over the columns that ``df`` has."""
    return df.withColumns({k: Template(t)(df) for k, t in (templates or {}).items()})


def references(df: DataFrame, template: str | None = None, list_template: str | None = None) -> Column:
    """The references: one rendered text, or a list rendered as JSON or named by its column."""
    if template is not None and list_template is not None:
        raise ValueError("only one of the two reference templates can be given")
    if template is not None:
        return F.array(Template(template)(df))
    if list_template is None:
        return F.array().cast("array<string>")
    name = list_template.strip("{} ")
    if dict(df.dtypes).get(name, "").startswith("array"):
        return F.transform(F.col(name), lambda x: x.cast("string"))
    text = F.trim(Template(list_template)(df))
    good = F.startswith(text, F.lit("[")) & F.endswith(text, F.lit("]"))
    return F.when(good, F.from_json(F.regexp_replace(text, r"(?<=[\[,] ?)'|'(?= ?[,\]])", '"'), "array<string>")).otherwise(F.raise_error(F.concat(F.lit("not a list: "), text)).cast("array<string>"))


def generation(items: DataFrame, reference: str | None = None, reference_list: str | None = None, inputs: dict[str, str] | None = None, rows: tuple[int | None, int | None] | None = None, keep: dict[str, str] | None = None, remove: dict[str, str] | None = None) -> DataFrame:
    """Items with ``references`` and templated inputs."""
    df = conditions(data_range(items, *rows) if rows else items, keep, remove)
    return df.withColumns({k: Template(t)(df) for k, t in (inputs or {}).items()} | {"references": references(df, reference, reference_list)})


def chat(items: DataFrame, user: str, system: str | None = None, reference: str | None = None, reference_list: str | None = None, extra: dict[str, str] | None = None, tools: str | None = None, rows: tuple[int | None, int | None] | None = None, keep: dict[str, str] | None = None, remove: dict[str, str] | None = None) -> DataFrame:
    """Items with ``messages`` of an optional system and a user turn, ``references`` and, without own ones, the default ``tools``."""
    df = conditions(data_range(items, *rows) if rows else items, keep, remove)
    turns = [message(F.lit(role), Template(t)(df)) for role, t in (("system", system), ("user", user)) if t is not None]
    own = F.when(F.size("tools") > 0, F.to_json("tools")) if dict(df.dtypes).get("tools", "").startswith("array") else F.col("tools").cast("string") if "tools" in df.columns else F.lit(None).cast("string")
    return df.withColumns({k: Template(t)(df) for k, t in (extra or {}).items()} | {"references": references(df, reference, reference_list), "messages": F.array(*turns), "tools": F.coalesce(own, F.lit(tools))})


def message(role: Column, content: Column) -> Column:
    return F.struct(role.alias("role"), content.alias("content"))


def choices(items: DataFrame, templates: Sequence[str], answer_index: str, inputs: dict[str, str] | None = None, leading_blank: bool = False) -> DataFrame:
    """Items with ``choices``, empty ones dropped, and ``answer_index``, which must be one of them."""
    all_ = F.filter(F.array(*[Template(t)(items) for t in templates]), lambda c: F.length(c) > 0)
    if leading_blank:
        all_ = F.transform(all_, lambda c: F.concat(F.lit(" "), c))
    index = Template(answer_index)(items).try_cast("int")
    checked = F.when((index >= 0) & (index < F.size(all_)), index).otherwise(F.raise_error(F.lit("answer_index is out of range")).cast("int"))
    return items.withColumns({k: Template(t)(items) for k, t in (inputs or {}).items()} | {"choices": all_, "answer_index": checked})


def reward(items: DataFrame, prompt: str = "{{ prompt }}", chosen: str = "{{ chosen }}", rejected: str = "{{ rejected }}", category: str | None = None) -> DataFrame:
    """Items with ``prompt``, ``chosen`` and ``rejected`` as one message each, and ``category_key``."""
    made = {k: F.array(message(F.lit(role), Template(t)(items))) for k, t, role in (("prompt", prompt, "user"), ("chosen", chosen, "assistant"), ("rejected", rejected, "assistant"))}
    return items.withColumns(made | {"category_key": Template(category)(items) if category else F.lit(None).cast("string")})


def override_references(df: DataFrame, other: DataFrame) -> DataFrame:
    """``df`` with the references of ``other`` by ``row_id``; both must have as many rows."""
    if df.count() != other.count():
        raise ValueError("both datasets must have as many rows")
    return df.drop("references").join(other.select("row_id", "references"), "row_id")
