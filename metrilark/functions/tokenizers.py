"""Tokenizers and n-grams: ``Column -> array<string>``."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

Tokenizer = Callable[[Column], Column]


class NotAvailable(RuntimeError):
    """A part that needs software or a service which isn't there."""


def whitespace(text: Column) -> Column:
    """Split at Unicode blanks; no empty tokens."""
    return F.filter(F.split(text, r"(?U)[\s\x1c-\x1f]+"), lambda t: t != "")


def mteval(text: Column) -> Column:
    """The 13a rules of machine-translation scoring: entities decoded, punctuation set apart, blanks collapsed; empty text is one empty token."""
    for a, b in (("<skipped>", ""), ("-\n", ""), ("\n", " "), ("&quot;", '"'), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">")):
        text = F.replace(text, F.lit(a), F.lit(b))
    text = F.concat(F.lit(" "), text, F.lit(" "))
    for pattern, to in ((r"([\{-\~\[-\` -\&\(-\+\:-\@\/])", " $1 "), (r"([^0-9])([\.,])", "$1 $2 "), (r"([\.,])([^0-9])", " $1 $2"), (r"([0-9])(-)", "$1 $2 ")):
        text = F.regexp_replace(text, pattern, to)
    return F.split(F.trim(F.regexp_replace(text, r"(?U)\s+", " ")), " ")


def characters(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda t: t != "")


def byte_pairs(path: str) -> Tokenizer:
    """Tokens of a public byte-pair vocabulary file in tiktoken's format at ``path``, each decoded by itself."""

    @F.pandas_udf("array<string>")
    def run(text: pd.Series) -> pd.Series:
        import tiktoken
        from tiktoken.load import load_tiktoken_bpe

        coder = tiktoken.Encoding("file", pat_str=r"\s?\p{L}+|\s?\p{N}+|\s?[^\s\p{L}\p{N}]+|\s+", mergeable_ranks=load_tiktoken_bpe(path), special_tokens={})
        return text.map(lambda t: None if t is None else [coder.decode([i]) for i in coder.encode(t, disallowed_special=())])

    return run


def vocabulary(path: str) -> Tokenizer:
    """Tokens of a tokenizer.json file at ``path``."""

    @F.pandas_udf("array<string>")
    def run(text: pd.Series) -> pd.Series:
        from tokenizers import Tokenizer as Loaded

        loaded = Loaded.from_file(path)
        return text.map(lambda t: None if t is None else loaded.encode(t, add_special_tokens=False).tokens)

    return run


def morphemes(text: Column) -> Column:
    raise NotAvailable("a morphological analyser isn't installed; pass a pandas UDF that returns array<string>")


def once(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)`` with ``value`` computed once, however often it is used: it becomes a variable of a function over an array of one."""
    return F.element_at(F.transform(F.array(value), then), 1)


def ngrams(tokens: Column, n: int) -> Column:
    """All runs of ``n`` tokens; none if there are fewer."""
    return once(tokens, lambda t: _ngrams(t, n))


def written_ngrams(tokens: Column, n: int) -> Column:
    """The n-grams as texts, each token after its length, so that different ones are different texts, which can be hashed."""
    written = F.transform(tokens, lambda t: F.concat(F.length(t).cast("string"), F.lit(":"), t))
    return once(written, lambda w: F.transform(_ngrams(w, n), lambda g: F.array_join(g, "")))


def _ngrams(tokens: Column, n: int) -> Column:
    return F.when(F.size(tokens) >= n, F.transform(F.sequence(F.lit(1), F.size(tokens) - (n - 1)), lambda i: F.slice(tokens, i, n))).otherwise(F.array().cast("array<array<string>>"))


def joined_ngrams(tokens: Column, n: int, mark: str = "__") -> Column:
    return F.transform(ngrams(tokens, n), lambda g: F.array_join(g, mark))


def windows(text: Column, length: int) -> Column:
    """Every window of ``length`` characters; a shorter text is its own."""
    return F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - (length - 1), F.lit(1))), lambda i: F.substring(text, i, F.lit(length)))
