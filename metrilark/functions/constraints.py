"""Checks of instructions in an answer: ``Column -> boolean Column``, English and Japanese.

Sentence and word splitting and the language test are rules of their own here, as the usual libraries aren't there:
sentences end at .!? (Japanese: 。！？ or a line end); the language is passed as a column.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .processors import BLANKS, strip
from .tokenizers import NotAvailable, once

Check = Callable[[Column], Column]
_RELATIONS = {"less than": lambda a, n: a < n, "at least": lambda a, n: a >= n, "未満": lambda a, n: a < n, "以上": lambda a, n: a >= n}


def _count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def _related(n: int, relation: str, count: Callable[[Column], Column]) -> Check:
    return lambda x: _RELATIONS[relation](count(x), n)


def _occurrences(x: Column, word: str) -> Column:
    return F.try_divide(F.length(x) - F.length(F.replace(x, F.lit(word), F.lit(""))), F.lit(len(word))).cast("int")


def _left(x: Column) -> Column:
    """Without blanks before it; it isn't empty if anything isn't blank, and only the blanks are looked at."""
    return F.ltrim(x, F.lit(BLANKS))


def _filled(x: Column, pattern: str, group: int = 1) -> Column:
    """How many matches aren't blank."""
    return F.size(F.filter(F.regexp_extract_all(x, F.lit(pattern), F.lit(group)), lambda m: _left(m) != ""))


# --- English ---


def capital_words(n: int, relation: str = "at least") -> Check:
    """Words with any of the common small letters aren't taken out of the text at all; the rest is compared with its capitals."""
    first = r"[[^a-zß-öø-ÿ]&&[\w'\-]]"
    words = rf"(?U){first}(?<![\w'\-𐀀]{first}){first}*+(?![\w'\-])"  # the letter beyond 16 bits lets the look behind see whole ones
    return _related(n, relation, lambda x: F.size(F.filter(F.regexp_extract_all(x, F.lit(words), F.lit(0)), lambda w: (w == F.upper(w)) & (F.lower(w) != w))))


def all_capital(language: Column | None = None) -> Check:
    return lambda x: ~F.rlike(x, F.lit("[a-z]")) & (x == F.upper(x)) & (F.lower(x) != x) & (F.coalesce(language == "en", F.lit(True)) if language is not None else F.lit(True))


def all_lowercase(language: Column | None = None) -> Check:
    return lambda x: ~F.rlike(x, F.lit("[A-Z]")) & (x == F.lower(x)) & (F.upper(x) != x) & (F.coalesce(language == "en", F.lit(True)) if language is not None else F.lit(True))


def repeats_prompt(prompt: str) -> Check:
    return lambda x: F.startswith(_left(F.lower(x)), F.lit(prompt.strip().lower()))


def two_responses(x: Column) -> Column:
    parts = F.filter(F.transform(F.split(x, r"\*{6}"), strip), lambda p: p != "")
    return once(parts, lambda p: (F.size(p) == 2) & ~F.coalesce(F.try_element_at(p, F.lit(1)) == F.try_element_at(p, F.lit(2)), F.lit(False)))


def placeholders(n: int) -> Check:
    return lambda x: _count(x, r"\[.*?\]") >= n


def postscript(marker: str) -> Check:
    """Blanks before the marker and the rest of its line are always there to match."""
    known = {"P.P.S": r"p\.\s?p\.\s?s", "P.S.": r"p\.\s?s\."}
    return lambda x: F.rlike(F.lower(x), F.lit("(?m)" + known.get(marker, marker.lower())))


def one_of(options: Sequence[str]) -> Check:
    def run(x: Column) -> Column:
        out = F.lit(False)
        for o in options:
            out = out | F.contains(x, F.lit(o))
        return out

    return run


def json_format(x: Column) -> Column:
    body = F.regexp_replace(strip(x), "^(?:```json)?(?:```Json)?(?:```JSON)?(?:```)?", "")
    return once(body, lambda b: F.try_parse_json(strip(F.when(F.endswith(b, F.lit("```")), F.left(b, F.length(b) - 3)).otherwise(b))).isNotNull())


def sections(keyword: str, n: int) -> Check:
    return lambda x: _count(x, rf"\s?{keyword}\s?\d+\s?") >= n


def bullets(n: int) -> Check:
    return lambda x: _count(x, r"(?m)^\s*\*[^\*].*$") + _count(x, r"(?m)^\s*-.*$") == n


def highlights(n: int) -> Check:
    return lambda x: _filled(x, r"\*([^\n\*]*)\*") + _filled(x, r"\*\*([^\n\*]*)\*\*") >= n


def title(x: Column) -> Column:
    return _filled(x, r"<<([^\n]+?)>>") > 0


def keywords(words: Sequence[str]) -> Check:
    def run(x: Column) -> Column:
        out = F.lit(True)
        for w in words:
            out = out & F.contains(F.lower(x), F.lit(w.lower()))
        return out

    return run


def forbidden(words: Sequence[str]) -> Check:
    return lambda x: ~F.rlike(x, F.lit(rf"(?iU)\b(?:{'|'.join(words)})\b")) if words else F.lit(True)


def keyword_frequency(word: str, n: int, relation: str = "at least") -> Check:
    return _related(n, relation, lambda x: _count(x, f"(?i){re.escape(word)}"))


def letter_frequency(letter: str, n: int, relation: str = "at least") -> Check:
    return _related(n, relation, lambda x: _occurrences(F.lower(x), letter.lower()))


def language_is(code: str, language: Column) -> Check:
    """Unknown languages pass."""
    return lambda x: F.coalesce(language == code, F.lit(True))


def nth_paragraph_starts(paragraphs: int, nth: int, word: str) -> Check:
    def run(parts: Column) -> Column:
        filled = F.filter(parts, lambda p: _left(p) != "")
        first = F.lower(F.regexp_extract(strip(F.coalesce(F.try_element_at(parts, F.lit(nth)), F.lit(""))), r"(?U)^[\"']*([^\s.,?!'\"]*)", 1))
        return (F.size(filled) == paragraphs) & (first == word.lower())

    return lambda x: once(F.split(x, "\n\n"), run)


def paragraphs(n: int) -> Check:
    """Parts between lines of ***; only the first and the last may be blank, and don't count then."""

    def run(parts: Column) -> Column:
        blank = F.size(F.filter(parts, lambda p: p == ""))
        ends = (F.element_at(parts, 1) == "").cast("int") + F.when(F.size(parts) > 1, (F.element_at(parts, -1) == "").cast("int")).otherwise(0)
        return (blank == ends) & (F.size(parts) - blank == n)

    return lambda x: once(F.transform(F.split(x, r"\*\*\*"), strip), run)


def sentence_count(n: int, relation: str = "at least") -> Check:
    return _related(n, relation, lambda x: _count(x, r"[^.!?\s][^.!?]*(?:[.!?]+|\z)"))


def word_count(n: int, relation: str = "at least") -> Check:
    return _related(n, relation, lambda x: _count(x, r"(?U)\w+"))


def no_comma(x: Column) -> Column:
    return ~F.contains(x, F.lit(","))


def ends_with(phrase: str) -> Check:
    return lambda x: F.endswith(F.btrim(strip(F.lower(x)), F.lit('"')), F.lit(phrase.strip().lower()))


def quoted(x: Column) -> Column:
    x = strip(x)
    return (F.length(x) > 1) & F.startswith(x, F.lit('"')) & F.endswith(x, F.lit('"'))


# --- Japanese ---

KANJI, HIRAGANA, KATAKANA = r"一-鿿㐀-䶿々", r"ぁ-ゟ", r"゠-ヿｦ-ﾟ"


def without(letters: str) -> str:
    """The class of all characters but ``letters``, as ranges: Java takes about five times as long for a negated class of letters from several alphabets."""
    out, at = "", 0
    for c in sorted(set(map(ord, letters))):
        if c > at:
            out += rf"\x{{{at:x}}}-\x{{{c - 1:x}}}"
        at = c + 1
    return rf"[{out}\x{{{at:x}}}-\x{{10ffff}}]"


_WITHIN = without("。！？!?\n") + "+"
_SENTENCE = _WITHIN + "[。！？!?]*"


def ja_sentences(n: int, relation: str = "以上") -> Check:
    return _related(n, relation, lambda x: _filled(x, f"({_SENTENCE})"))


def ja_bullets(n: int) -> Check:
    return lambda x: _count(x, r"(?m)^\s*・[^・].*$") == n


def ja_numbered(n: int) -> Check:
    return lambda x: _count(x, r"(?m)^\s*\d+\.\s.*$") == n


def ja_line_starts(starter: str) -> Check:
    return lambda x: F.rlike(x, F.lit(rf"(?m)^\s*{starter}"))


def ja_highlights(n: int) -> Check:
    return lambda x: _filled(x, f"《({without('\n《》')}*)》") >= n


def ja_sections(keyword: str, n: int) -> Check:
    return lambda x: _count(x, f"第[0-9０-９]+{keyword}") >= n


def ja_paragraphs(n: int) -> Check:
    return paragraphs(n)


def ja_postscript(marker: str) -> Check:
    return lambda x: F.rlike(x, F.lit(rf"(?i){re.escape(marker)}"))


def ja_rephrased(original: str) -> Check:
    """As many {parts} as the original, all different from its own, and the same text around them."""
    own, rest = re.findall(r"\{.*?\}", original), re.sub(r"\{.*\}", "", original)

    def run(x: Column) -> Column:
        parts = F.regexp_extract_all(x, F.lit(r"\{.*?\}"), F.lit(0))
        same = F.exists(F.arrays_zip(parts.alias("a"), F.array(*map(F.lit, own)).cast("array<string>").alias("b")), lambda p: p["a"] == p["b"])
        return (F.size(parts) == len(own)) & ~same & (F.regexp_replace(x, r"\{.*\}", "") == rest)

    return run


def ja_keywords(words: Sequence[str]) -> Check:
    def run(x: Column) -> Column:
        out = F.lit(True)
        for w in words:
            out = out & F.contains(x, F.lit(w))
        return out

    return run


def ja_keyword_frequency(word: str, n: int, relation: str = "以上") -> Check:
    return _related(n, relation, lambda x: _occurrences(x, word))


def ja_length(n: int, relation: str = "以上") -> Check:
    return _related(n, relation, F.length)


def ja_paragraph_starts(count: int, nth: int, word: str) -> Check:
    def run(parts: Column) -> Column:
        return (F.size(parts) == count) & F.coalesce(F.startswith(F.regexp_replace(F.try_element_at(parts, F.lit(nth)), "^[「『]+", ""), F.lit(word)), F.lit(False))

    return lambda x: once(F.filter(F.transform(F.split(x, "\n\n"), strip), lambda p: p != ""), run)


def ja_key_sentences(sentences: Sequence[str], n: int) -> Check:
    def run(x: Column) -> Column:
        out = F.lit(True)
        for s in sentences:
            out = out & (_occurrences(x, s) == n)
        return out

    return run


def ja_forbidden(words: Sequence[str]) -> Check:
    def run(x: Column) -> Column:
        out = F.lit(True)
        for w in words:
            out = out & ~F.contains(x, F.lit(w))
        return out

    return run


def ja_repeats_prompt(prompt: str) -> Check:
    return lambda x: F.startswith(_left(x), F.lit(prompt.strip()))


def ja_ends_with(phrase: str) -> Check:
    return lambda x: F.endswith(F.btrim(strip(x), F.lit("」』")), F.lit(phrase))


def ja_title(x: Column) -> Column:
    return _filled(x, f"『([^\n]{without('\n』')}*)』") > 0


def ja_letter_frequency(letter: str, n: int, relation: str = "以上") -> Check:
    """A hiragana letter counts with its katakana twin."""
    twin = chr(ord(letter) + 96) if "ぁ" <= letter <= "ゖ" else letter
    return _related(n, relation, lambda x: _occurrences(x, letter) + (_occurrences(x, twin) if twin != letter else F.lit(0)))


def ja_no_period(x: Column) -> Column:
    return ~F.contains(x, F.lit("。"))


def ja_no_comma(x: Column) -> Column:
    return ~F.contains(x, F.lit("、"))


def ja_quoted(x: Column) -> Column:
    x = strip(x)
    return F.startswith(x, F.lit("「")) & F.endswith(x, F.lit("」"))


def ja_furigana(x: Column) -> Column:
    """Every run of kanji is followed by its reading in parentheses."""
    return _count(x, f"[{KANJI}]+") == _count(x, f"[{KANJI}]+[（(][{HIRAGANA}]+[）)]")


def ja_kanji_count(n: int, relation: str = "未満") -> Check:
    return _related(n, relation, lambda x: F.length(x) - F.length(F.regexp_replace(x, f"[{KANJI}]+", "")))


def ja_no_hiragana(x: Column) -> Column:
    return ~F.rlike(x, F.lit(f"[{HIRAGANA}]"))


def ja_hiragana_only(x: Column) -> Column:
    return ~F.rlike(x, F.lit(rf"[\p{{L}}&&[^{HIRAGANA}ー]]"))


def ja_no_katakana(x: Column) -> Column:
    return ~F.rlike(x, F.lit(f"[{KATAKANA}&&[^ー・]]"))


def ja_katakana_only(x: Column) -> Column:
    return ~F.rlike(x, F.lit(rf"[\p{{L}}&&[^{KATAKANA}]]"))


def ja_unified_endings(ending: str) -> Check:
    """Outside quotations every sentence ends with ``ending``."""

    def run(x: Column) -> Column:
        plain = F.regexp_replace(x, "「.*?」|『.*?』", "")
        parts = F.transform(F.regexp_extract_all(plain, F.lit(_WITHIN), F.lit(0)), strip)
        return F.forall(parts, lambda s: (s == "") | F.endswith(s, F.lit(ending)))

    return run


def ja_kanji_numbers(x: Column) -> Column:
    return ~F.rlike(x, F.lit(r"(?U)\d"))


def ja_nominal_endings(n: int) -> Check:
    raise NotAvailable("noun endings need a morphological analyser")


def ja_rephrased_paragraph(original: str, low: int, high: int) -> Check:
    raise NotAvailable("content words need a morphological analyser")


def checks(text: Column, named: dict[str, Check]) -> Column:
    """array<struct<name, passed>> for ``operators.metrics.constraints``; a null text passes nothing."""
    return F.array(*[F.struct(F.lit(k).alias("name"), F.coalesce(c(text), F.lit(False)).alias("passed")) for k, c in named.items()])
