"""String processors: ``Column -> Column``, chained from left to right."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

Processor = Callable[[Column], Column]
#: What Python counts as blank; Java's \s in Unicode mode lacks the four separators.
BLANK = r"[\s\x1c-\x1f]"
BLANKS = "".join(c for c in map(chr, range(0x3001)) if c.isspace())


def chain(processors: Processor | Sequence[Processor] | None) -> Processor:
    """One processor of none, one or several."""
    steps = [] if processors is None else [processors] if callable(processors) else list(processors)

    def run(text: Column) -> Column:
        for step in steps:
            text = step(text)
        return text

    return run


def lower(text: Column) -> Column:
    return F.lower(text)


def strip(text: Column) -> Column:
    """Without Unicode blanks at both ends; no pattern, which would try every run of blanks within the text."""
    return F.btrim(text, F.lit(BLANKS))


def last_line(text: Column) -> Column:
    return F.substring_index(text, "\n", -1)


def nfkc(text: Column) -> Column:
    """Unicode compatibility normalisation; Spark has no function for it."""

    @F.pandas_udf("string")
    def run(batch: pd.Series) -> pd.Series:
        return batch.map(lambda t: t if t is None else unicodedata.normalize("NFKC", t))

    return run(text)


def _java(pattern: str) -> tuple[str, int]:
    """(the pattern as Java reads it, without names of groups; group that stands for the match)."""
    return re.sub(r"\(\?P<\w+>", "(", pattern), 1 if re.compile(pattern).groups == 1 else 0


def last_match(pattern: str, default: str | None = "") -> Processor:
    """The last match of ``pattern`` (its group, if it has exactly one), a dot matching line ends; ``default`` without one."""
    java, group = _java(pattern)

    def run(text: Column) -> Column:
        found = F.regexp_extract_all(text, F.lit(f"(?s)(?U){java}"), F.lit(group))
        return F.coalesce(F.try_element_at(found, F.lit(-1)), F.lit(default)) if default is not None else F.try_element_at(found, F.lit(-1))

    return run


def remove_comma(text: Column) -> Column:
    return F.replace(text, F.lit(","), F.lit(""))


def number(answer_prefix: str | None = None) -> Processor:
    """The last number of a text, after the last ``answer_prefix`` if given: no commas, no trailing dot or zeros after one; "" without a number."""

    def run(text: Column) -> Column:
        if answer_prefix is not None:
            text = strip(F.substring_index(text, answer_prefix, -1))
        found = F.regexp_extract_all(remove_comma(text), F.lit(r"-?\d+\.?\d*"), F.lit(0))
        value = F.regexp_replace(F.coalesce(F.try_element_at(found, F.lit(-1)), F.lit("")), r"\.+$", "")
        return F.when(F.contains(value, F.lit(".")), F.regexp_replace(F.regexp_replace(value, "0+$", ""), r"\.$", "")).otherwise(value)

    return run


def quiz_answer(text: Column) -> Column:
    """Japanese quiz answers: one wave dash, NFKC, lower case, no quotation brackets, middle dots, equal signs, hyphens, blanks or parenthesised readings."""
    text = F.lower(nfkc(F.translate(text, "～", "〜")))
    for opening, closing in ("「」", "『』"):
        text = F.regexp_replace(text, f"{opening}(.*?){closing}", "$1")
    text = F.regexp_replace(F.translate(text, "・=-", ""), f"(?U){BLANK}+", "")
    return F.regexp_replace(text, r"\(.*?\)", "")


def truncate_middle(text: Column, length: int, filler: str = "...") -> Column:
    """At most ``length`` characters: the middle gives way to ``filler`` unless the text and the filler fit together."""
    rest = max(0, length - len(filler))
    head, tail = rest // 2, rest - rest // 2
    return F.when(F.length(text) + len(filler) <= length, text).otherwise(F.concat(F.left(text, F.lit(head)), F.lit(filler), F.right(text, F.lit(tail))))


def regex_replace(text: Column, pattern: str, replacement: str) -> Column:
    """As Python's re.sub; group references may be written with backslashes."""
    return F.regexp_replace(text, _java(pattern)[0], re.sub(r"\\(\d)", r"$\1", replacement))


def reasoning(pattern: str) -> Callable[[Column], Column]:
    """A struct (text, reasoning_text) of the named groups ``content`` and ``reasoning_content`` of the first match; nulls without one."""
    groups = re.compile(pattern).groupindex
    java = f"(?s)(?U){_java(pattern)[0]}"

    def run(text: Column) -> Column:
        parts = [F.when(F.rlike(text, F.lit(java)), F.regexp_extract(text, java, groups[g])).alias(n) for g, n in (("content", "text"), ("reasoning_content", "reasoning_text"))]
        return F.struct(*parts)

    return run


def separate_reasoning(content: str, thought: str) -> Callable[[Column], Column]:
    """As ``reasoning``, with the last match of a pattern for each part."""
    return lambda text: F.struct(last_match(content, None)(text).alias("text"), last_match(thought, None)(text).alias("reasoning_text"))


def stop_at(text: Column, stops: Sequence[str]) -> Column:
    """A struct (text, finish_reason): cut before the first occurrence of each stop sequence in turn; "stop" if any was cut, else "length"."""
    hit = F.lit(False)
    for stop in sorted(set(filter(None, stops))):
        hit = hit | F.contains(text, F.lit(stop))
        text = F.substring_index(text, stop, 1)
    return F.struct(text.alias("text"), F.when(hit, "stop").otherwise("length").alias("finish_reason"))


def shorten_base64(text: Column) -> Column:
    """Data URLs cut to 50 characters with a note of their length."""
    return F.when(F.rlike(text, F.lit(r"(?s)^data:\w+/\w+;base64,.+")), F.concat(F.left(text, F.lit(50)), F.lit("... [truncated, "), F.length(text).cast("string"), F.lit(" chars total]"))).otherwise(text)


def tool_arguments_valid(arguments: Column) -> Column:
    """Whether the arguments of a tool call are JSON."""
    return F.try_parse_json(arguments).isNotNull()


def tool_call_id(*key: Column) -> Column:
    """"call_" and 24 hexadecimal digits that follow from ``key``."""
    return F.concat(F.lit("call_"), F.left(F.sha2(F.concat_ws("\x1f", *key), 256), F.lit(24)))


def postprocess(text: Column, prefix: str | None = None, parser: Callable[[Column], Column] | None = None, processors: Processor | Sequence[Processor] | None = None) -> dict[str, Column]:
    """Model output in the engine's order: forced prefix, reasoning parser (no match: ""), processors; ``raw_lm_output`` only if something changed it."""
    raw = F.coalesce(text, F.lit(""))
    if prefix:
        raw = F.concat(F.lit(prefix), raw)
    now, thought = raw, F.lit(None).cast("string")
    if parser is not None:
        parsed = parser(raw)
        now, thought = F.coalesce(parsed["text"], F.lit("")), parsed["reasoning_text"]
    now = chain(processors)(now)
    return {"lm_output": now, "reasoning_text": thought, "raw_lm_output": F.when(~now.eqNullSafe(raw), raw)}
