"""Every instruction checker over all documents, as one query a language, and the same in DuckDB's SQL.

The Japanese checkers get the documents in Japanese script: ``translate`` turns letters into kana and kanji.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import constraints as C

_STRIP = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"
_S = _STRIP.format("t")
_WORD = r"[\p{L}\p{M}\p{N}\p{Pc}]"


def _n(pattern: str, of: str = "t") -> str:
    return f"len(regexp_extract_all({of}, '{pattern}'))"


def _filled(pattern: str) -> str:
    return f"len(list_filter(regexp_extract_all(t, '{pattern}', 1), lambda m: {_STRIP.format('m')} <> ''))"


def _times(word: str, of: str = "t") -> str:
    return f"(length({of}) - length(replace({of}, '{word}', ''))) // {len(word)}"


def _paragraphs(n: int) -> str:
    parts = rf"list_transform(string_split_regex(t, '\s?\*\*\*\s?'), lambda p: {_STRIP.format('p')})"
    return f"(SELECT len(list_filter(p, lambda q: q = '')) = CAST(p[1] = '' AS INT) + CASE WHEN len(p) > 1 THEN CAST(p[-1] = '' AS INT) ELSE 0 END AND len(list_filter(p, lambda q: q <> '')) = {n} FROM (SELECT {parts} AS p))"


#: name -> (check of a text column, given the language, and its SQL over t and lang).
ENGLISH: dict[str, tuple[Callable[[Column], C.Check], str]] = {
    "capital_words": (lambda _: C.capital_words(2), r"len(list_filter(regexp_extract_all(t, '[\p{L}\p{M}\p{N}\p{Pc}''-]+'), lambda w: w = upper(w) AND lower(w) <> w)) >= 2"),
    "all_capital": (lambda lang: C.all_capital(lang), "t = upper(t) AND lower(t) <> t AND lang = 'en'"),
    "all_lowercase": (lambda lang: C.all_lowercase(lang), "t = lower(t) AND upper(t) <> t AND lang = 'en'"),
    "repeats_prompt": (lambda _: C.repeats_prompt(" The "), f"starts_with(lower({_S}), 'the')"),
    "two_responses": (lambda _: lambda x: C.two_responses(F.replace(x, F.lit("\n"), F.lit("******"))), f"(SELECT len(p) = 2 AND p[1] <> p[2] FROM (SELECT list_filter(list_transform(string_split(replace(t, chr(10), '******'), '******'), lambda p: {_STRIP.format('p')}), lambda p: p <> '') AS p))"),
    "placeholders": (lambda _: C.placeholders(1), _n(r"\[.*?\]") + " >= 1"),
    "postscript": (lambda _: C.postscript("P.S."), r"regexp_matches(lower(t), '(?m)\s*p\.\s?s\..*$')"),
    "one_of": (lambda _: C.one_of(["license", "zu"]), "contains(t, 'license') OR contains(t, 'zu')"),
    "json_format": (lambda _: lambda x: C.json_format(F.concat(F.lit('```json\n["'), F.regexp_extract(x, r"^([^\\\x00-\x1f]*)", 1), F.lit('"]```'))), r"""json_valid('["' || regexp_extract(t, '^([^\\\x00-\x1f]*)', 1) || '"]')"""),
    "sections": (lambda _: C.sections("version", 1), _n(r"\s?version\s?\d+\s?") + " >= 1"),
    "bullets": (lambda _: C.bullets(0), _n(r"(?m)^\s*\*[^\*].*$") + " + " + _n(r"(?m)^\s*-.*$") + " = 0"),
    "highlights": (lambda _: C.highlights(2), _filled(r"\*([^\n\*]*)\*") + " + " + _filled(r"\*\*([^\n\*]*)\*\*") + " >= 2"),
    "title": (lambda _: lambda x: C.title(F.concat(F.lit("<<"), x, F.lit(">>"))), r"len(list_filter(regexp_extract_all('<<' || t || '>>', '<<([^\n]+?)>>', 1), lambda m: " + _STRIP.format("m") + " <> '')) > 0"),
    "keywords": (lambda _: C.keywords(["The", "and"]), "contains(lower(t), 'the') AND contains(lower(t), 'and')"),
    "forbidden": (lambda _: C.forbidden(["the", "die"]), rf"NOT regexp_matches(t, '(?i)(^|[^{_WORD[1:-1]}])(the|die)($|[^{_WORD[1:-1]}])')"),
    "keyword_frequency": (lambda _: C.keyword_frequency("an", 30), _n("(?i)an") + " >= 30"),
    "letter_frequency": (lambda _: C.letter_frequency("e", 300, "less than"), f"{_times('e', 'lower(t)')} < 300"),
    "language_is": (lambda lang: C.language_is("de", lang), "lang = 'de'"),
    "nth_paragraph_starts": (lambda _: lambda x: C.nth_paragraph_starts(3, 2, "and")(F.replace(x, F.lit("\n"), F.lit("\n\n"))), rf"(SELECT len(list_filter(p, lambda q: {_STRIP.format('q')} <> '')) = 3 AND lower(regexp_extract({_STRIP.format('p[2]')}, '^[" + r""""'']*([^\s.,?!''"]*)', 1)) = 'and' FROM (SELECT string_split(replace(t, chr(10), chr(10) || chr(10)), chr(10) || chr(10)) AS p))"""),
    "paragraphs": (lambda _: C.paragraphs(1), _paragraphs(1)),
    "sentence_count": (lambda _: C.sentence_count(5), _n(r"[^.!?\s][^.!?]*(?:[.!?]+|\z)") + " >= 5"),
    "word_count": (lambda _: C.word_count(200, "less than"), _n(_WORD + "+") + " < 200"),
    "no_comma": (lambda _: C.no_comma, "NOT contains(t, ',')"),
    "ends_with": (lambda _: C.ends_with("the."), f"""ends_with(lower(regexp_replace({_S}, '^"+|"+$', '', 'g')), 'the.')"""),
    "quoted": (lambda _: lambda x: C.quoted(F.concat(F.lit('"'), x)), f"""ends_with({_S}, '"')"""),
}

_FROM, _TO = "abcdefghijklmnopqrstuvwxyz.,-$", "あいうえおかきくけこ日本語文字学校人山アイウエオカキ。、・{"
_K, _H, _A = C.KANJI, C.HIRAGANA, C.KATAKANA
_JA_SPLIT = rf"list_filter(list_transform(string_split(t, chr(10)), lambda p: {_STRIP.format('p')}), lambda p: p <> '')"
_ORIGINAL = "{あ}と{い}"


def _letters(text: Column, old: str, new: str) -> Column:
    """``translate`` of a few rare letters to new ones that aren't among them, by searches for bytes."""
    for a, b in zip(old, new, strict=True):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


#: name -> (check, SQL over the translated text t).
JAPANESE: dict[str, tuple[C.Check, str]] = {
    "ja_sentences": (C.ja_sentences(5), f"len(list_filter(regexp_extract_all(t, '[^。！？!?\n]+[。！？!?]*'), lambda m: {_STRIP.format('m')} <> '')) >= 5"),
    "ja_bullets": (C.ja_bullets(0), _n(r"(?m)^\s*・[^・].*$") + " = 0"),
    "ja_numbered": (C.ja_numbered(0), _n(r"(?m)^\s*\d+\.\s.*$") + " = 0"),
    "ja_line_starts": (C.ja_line_starts("お"), r"regexp_matches(t, '(?m)^\s*お')"),
    "ja_highlights": (lambda x: C.ja_highlights(2)(_letters(x, "、。", "《》")), f"len(list_filter(regexp_extract_all(translate(t, '、。', '《》'), '《([^\n《》]*)》', 1), lambda m: {_STRIP.format('m')} <> '')) >= 2"),
    "ja_sections": (lambda x: C.ja_sections("日", 1)(F.replace(x, F.lit(" "), F.lit("第1"))), "len(regexp_extract_all(replace(t, ' ', '第1'), '第[0-9０-９]+日')) >= 1"),
    "ja_paragraphs": (C.ja_paragraphs(1), _paragraphs(1)),
    "ja_postscript": (C.ja_postscript("おえ"), r"regexp_matches(t, '(?im)\s*おえ.*$')"),
    "ja_rephrased": (lambda x: C.ja_rephrased(_ORIGINAL)(F.concat(F.lit("{"), F.substring(x, 1, 1), F.lit("}と{"), F.substring(x, 2, 1), F.lit("}"))), "left(t, 1) <> 'あ' AND substr(t, 2, 1) <> 'い' AND NOT contains(left(t, 2), chr(10)) AND NOT contains(left(t, 2), '}')"),
    "ja_keywords": (C.ja_keywords(["あい", "日"]), "contains(t, 'あい') AND contains(t, '日')"),
    "ja_keyword_frequency": (C.ja_keyword_frequency("おあ", 20), f"{_times('おあ')} >= 20"),
    "ja_length": (C.ja_length(500), "length(t) >= 500"),
    "ja_paragraph_starts": (lambda x: C.ja_paragraph_starts(3, 2, "T")(F.replace(x, F.lit("\n"), F.lit("\n\n"))), f"(SELECT len(p) = 3 AND starts_with(p[2], 'T') FROM (SELECT {_JA_SPLIT} AS p))"),
    "ja_key_sentences": (C.ja_key_sentences(["うお", "あ日"], 3), f"{_times('うお')} = 3 AND {_times('あ日')} = 3"),
    "ja_forbidden": (C.ja_forbidden(["日本", "おえ"]), "NOT contains(t, '日本') AND NOT contains(t, 'おえ')"),
    "ja_repeats_prompt": (C.ja_repeats_prompt(" T "), f"starts_with({_S}, 'T')"),
    "ja_ends_with": (C.ja_ends_with("え。"), f"ends_with(regexp_replace({_S}, '^[」』]+|[」』]+$', '', 'g'), 'え。')"),
    "ja_title": (lambda x: C.ja_title(_letters(x, "、。", "『』")), f"len(list_filter(regexp_extract_all(translate(t, '、。', '『』'), '『([^\n]+?)』', 1), lambda m: {_STRIP.format('m')} <> '')) > 0"),
    "ja_letter_frequency": (C.ja_letter_frequency("あ", 60), f"{_times('あ')} + {_times('ア')} >= 60"),
    "ja_no_period": (C.ja_no_period, "NOT contains(t, '。')"),
    "ja_no_comma": (C.ja_no_comma, "NOT contains(t, '、')"),
    "ja_quoted": (lambda x: C.ja_quoted(F.concat(F.lit("「"), _letters(x, "。", "」"))), f"ends_with({_STRIP.format('t')}, '。')"),
    "ja_furigana": (lambda x: C.ja_furigana(_letters(x, "。、", "（）")), f"len(regexp_extract_all(t, '[{_K}]+')) = len(regexp_extract_all(translate(t, '。、', '（）'), '[{_K}]+[（(][{_H}]+[）)]'))"),
    "ja_kanji_count": (C.ja_kanji_count(100), _n(f"[{_K}]") + " < 100"),
    "ja_no_hiragana": (C.ja_no_hiragana, f"NOT regexp_matches(t, '[{_H}]')"),
    "ja_hiragana_only": (C.ja_hiragana_only, rf"NOT regexp_matches(regexp_replace(t, '[{_H}ー]', '', 'g'), '\p{{L}}')"),
    "ja_no_katakana": (C.ja_no_katakana, f"NOT regexp_matches(regexp_replace(t, '[ー・]', '', 'g'), '[{_A}]')"),
    "ja_katakana_only": (C.ja_katakana_only, rf"NOT regexp_matches(regexp_replace(t, '[{_A}]', '', 'g'), '\p{{L}}')"),
    "ja_unified_endings": (lambda x: C.ja_unified_endings("え")(F.regexp_replace(x, C.without("え。\n") + "+", "え")), f"len(list_filter(regexp_extract_all(regexp_replace(t, '[^え。\n]+', 'え', 'g'), '[^。！？!?\n]+'), lambda s: {_STRIP.format('s')} <> '' AND NOT ends_with({_STRIP.format('s')}, 'え'))) = 0"),
    "ja_kanji_numbers": (C.ja_kanji_numbers, r"NOT regexp_matches(t, '\p{Nd}')"),
}


def _counted(docs: DataFrame, text: Column, named: dict[str, C.Check]) -> DataFrame:
    """``checker, passed``: how many texts pass each check, in one pass."""
    row = docs.select(text.alias("t"), "lang").agg(*[F.count(F.when(c(F.col("t")), True)).alias(k) for k, c in named.items()])
    return row.select(F.explode(F.array(*[F.struct(F.lit(k).alias("checker"), F.col(k).alias("passed")) for k in named])).alias("r")).select("r.checker", "r.passed")


def english(docs: DataFrame) -> DataFrame:
    return _counted(docs, F.col("text"), {k: make(F.col("lang")) for k, (make, _) in ENGLISH.items()})


def japanese(docs: DataFrame) -> DataFrame:
    return _counted(docs, F.translate("text", _FROM, _TO), {k: c for k, (c, _) in JAPANESE.items()})


def _sql(text: str, named: dict[str, str]) -> str:
    return f"WITH d AS (SELECT {text} AS t, lang FROM documents) " + " UNION ALL ".join(f"SELECT '{k}' AS checker, count(*) FILTER (coalesce({e}, false)) AS passed FROM d" for k, e in named.items())


ENGLISH_SQL = _sql("text", {k: e for k, (_, e) in ENGLISH.items()})
JAPANESE_SQL = _sql(f"translate(text, '{_FROM}', '{_TO}')", {k: e for k, (_, e) in JAPANESE.items()})
