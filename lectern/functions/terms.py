"""Term and similarity expressions for retrieval; all stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words: letters, digits, underscore, apostrophe and hyphen.  Han runs also give their bigrams.
WORD = r"[\p{L}\p{N}_'-]+"
HAN_RUN = r"[\x{3400}-\x{9FFF}]+"


def search_terms(text: Column) -> Column:
    """Lower-case words with, for each run of Han characters, its bigrams (a lone one itself)."""
    lowered = F.lower(text)
    runs = F.regexp_extract_all(lowered, F.lit(HAN_RUN), F.lit(0))
    bigrams = F.transform(
        runs,
        lambda r: F.when(F.length(r) == 1, F.array(r)).otherwise(
            F.transform(F.sequence(F.lit(1), F.greatest(F.length(r) - 1, F.lit(1))), lambda i: F.substring(r, i, F.lit(2)))
        ),
    )
    return F.concat(F.regexp_extract_all(lowered, F.lit(WORD), F.lit(0)), F.flatten(bigrams))


def token_set(text: Column) -> Column:
    """Distinct lower-case ASCII words and single Han characters."""
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[a-z0-9]+|[\x{3400}-\x{9FFF}]"), F.lit(0)))


def set_cosine(left: Column, right: Column) -> Column:
    """|A and B| / sqrt(|A| |B|) of two distinct arrays; 0 where one is empty."""
    size = F.size(left) * F.size(right)
    return F.when(size > 0, F.size(F.array_intersect(left, right)) / F.sqrt(size)).otherwise(0.0)


def bigrams(text: Column) -> Column:
    return F.when(F.length(text) < 2, F.array(text)).otherwise(
        F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - 1, F.lit(1))), lambda i: F.substring(text, i, F.lit(2))))
    )


def title_similarity(left: Column, right: Column) -> Column:
    """1 for equal titles; by the ratio of lengths if one contains the other; else Jaccard of bigrams."""
    shorter, longer = F.least(F.length(left), F.length(right)), F.greatest(F.length(left), F.length(right))
    a, b = bigrams(left), bigrams(right)
    both = F.size(F.array_intersect(a, b))
    return (
        F.when(longer == 0, 0.0)
        .when(shorter == 0, 0.0)
        .when(left == right, 1.0)
        .when(left.contains(right) | right.contains(left), shorter / longer * 0.35 + 0.65)
        .otherwise(both / (F.size(a) + F.size(b) - both))
    )
