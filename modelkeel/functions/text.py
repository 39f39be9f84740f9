"""Text expressions: length, slugs, names, word n-grams, label matching."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A word is two or more word characters; slug separators.
WORD = r"[\p{L}\p{N}_]{2,}"
SLUG_SEPARATORS = r"__|[_:+.T]"


def text_length(text: Column | str) -> Column:
    """Characters, not bytes."""
    return F.length(text)


def words(text: Column | str) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), 0)


def bigrams(tokens: Column) -> Column:
    """Neighbouring pairs in linear time: the list zipped with itself shifted by one."""
    pairs = F.arrays_zip(
        F.slice(tokens, F.lit(1), F.greatest(F.size(tokens) - 1, F.lit(0))).alias("a"),
        F.slice(tokens, F.lit(2), F.greatest(F.size(tokens) - 1, F.lit(0))).alias("b"),
    )
    return F.transform(pairs, lambda p: F.concat_ws(" ", p["a"], p["b"]))


def with_bigrams(tokens: Column | str) -> Column:
    """A column of words and their neighbouring pairs; made by a ``select`` before, the words are searched once."""
    tokens = F.col(tokens) if isinstance(tokens, str) else tokens
    return F.concat(tokens, bigrams(tokens))


def unigrams_and_bigrams(text: Column | str) -> Column:
    return with_bigrams(words(text))


def run_id_slug(run_id: Column | str) -> Column:
    """Run ids become lower-case names with dashes for separators."""
    return F.lower(F.regexp_replace(run_id, SLUG_SEPARATORS, "-"))


def registered_name(use_case: Column | str, model: Column | str) -> Column:
    return F.concat_ws("-", use_case, model)


def experiment_name(use_case: Column | str, model: Column | str) -> Column:
    return F.concat_ws("/", use_case, model)


def matches_label(label: Column, pattern: str) -> Column:
    """Fully anchored match, the way label matchers of time-series queries work."""
    return label.rlike(f"^(?:{pattern})$")


def contains_any(text: Column | str, keywords: tuple[str, ...]) -> Column:
    lowered = F.lower(text)
    return F.exists(F.array(*[F.lit(k) for k in keywords]), lambda k: F.contains(lowered, k))
