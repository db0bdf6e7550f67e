"""Scores of a candidate that need nothing but its own row."""

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

MIN_ENTROPY = 1.5
NGRAM_SIZES = (3, 4, 5)


def shannon_entropy(s: Column) -> Column:
    """Entropy of the character distribution, natural logarithm."""
    chars = F.array_distinct(F.filter(F.split(s, ""), lambda c: c != ""))
    # Counted first, as a lambda computes what it names twice twice.
    shares = F.transform(
        chars, lambda c: (F.length(s) - F.length(F.replace(s, c, F.lit("")))) / F.length(s)
    )
    return F.aggregate(shares, F.lit(0.0), lambda total, p: total - p * F.ln(p))


def occurrences(text: Column, word: Column) -> Column:
    """Non-overlapping occurrences of a non-empty word; bytes are known without counting."""
    rest = F.octet_length(F.replace(text, word, F.lit("")))
    return ((F.octet_length(text) - rest) / F.octet_length(word)).cast("int")


def keyword_count(content: Column, keyword: Column) -> Column:
    """Case-insensitive occurrences of a keyword in a file."""
    return occurrences(F.lower(content), F.lower(keyword))


def count_score(n: Column) -> Column:
    return F.lit(math.log2(50)) / (F.log2(n + F.lit(1)) + F.lit(1.0))


def dictionary_score(match: Column) -> Column:
    return F.lit(math.log2(100)) / (F.log2(match + F.lit(1.0)) + F.lit(1.0))


def ngram_text(s: Column) -> Column:
    """The text that ``char_ngrams`` cuts into pieces."""
    return F.regexp_replace(F.lower(s), r"(?U)\s\s+", " ")


def char_ngrams(s: Column) -> Column:
    """All 3, 4 and 5 character pieces of the lower-cased text, with repeats."""
    text = ngram_text(s)

    def pieces(t, n):
        return F.when(
            F.length(t) >= n,
            F.transform(
                F.sequence(F.lit(1), F.length(t) - F.lit(n - 1)),
                lambda i: F.substring(t, i, F.lit(n)),
            ),
        ).otherwise(F.array().cast("array<string>"))

    return F.get(
        F.transform(
            F.array(text), lambda t: F.concat(*[pieces(t, n) for n in NGRAM_SIZES])
        ),
        F.lit(0),
    )
