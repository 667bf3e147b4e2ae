"""Text expressions; all built in, so they stay inside the JVM."""

from __future__ import annotations

import fnmatch

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as str.split() sees it, and line breaks as str.splitlines() sees them.
SPACE = "(?U)[\\s\\x1c-\\x1f]+"
EDGE_SPACE = "(?U)\\A[\\s\\x1c-\\x1f]+|[\\s\\x1c-\\x1f]+\\z"
BREAK = "\\r\\n|[\\n\\r\\x0B\\x0C\\x1C-\\x1E\\x85\\u2028\\u2029]"


def text_of(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def collapsed(c: Column | str) -> Column:
    """White space runs become one space; none at the ends."""
    return F.array_join(F.filter(F.split(text_of(c), SPACE), lambda x: x != ""), " ")


def norm_ws(c: Column | str) -> Column:
    return collapsed(F.lower(text_of(c)))


def strip(c: Column | str) -> Column:
    return F.regexp_replace(text_of(c), EDGE_SPACE, "")


def lines(c: Column | str) -> Column:
    t = text_of(c)
    return F.when(F.length(t) == 0, F.array().cast("array<string>")).otherwise(F.split(F.regexp_replace(t, f"(?:{BREAK})\\z", ""), BREAK, -1))


def tokens(c: Column | str) -> Column:
    """Runs of a-z and 0-9 of the lower-cased text."""
    return F.regexp_extract_all(F.lower(text_of(c)), F.lit("[a-z0-9]+"), 0)


def match_tokens(c: Column | str) -> Column:
    """Runs of ASCII letters and digits, lower-cased after matching."""
    return F.transform(F.regexp_extract_all(text_of(c), F.lit("[A-Za-z0-9]+"), 0), F.lower)


def norm_tokens(c: Column | str) -> Column:
    return F.array_join(tokens(c), " ")


def words(c: Column | str) -> Column:
    """Runs of anything but white space."""
    return F.regexp_extract_all(text_of(c), F.lit("\\S+"), 0)


def ngrams(array: Column, n: int) -> Column:
    """All runs of n elements, joined by a space; none if there are fewer."""
    size = F.size(array)
    return F.when(size >= n, F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), size - n + 1)), lambda i: F.array_join(F.slice(array, i, n), " "))).otherwise(F.array().cast("array<string>"))


def distinct_ngrams(array: Column, n: int) -> Column:
    return F.array_distinct(ngrams(array, n))


def set_jaccard(a: Column, b: Column) -> Column:
    """Jaccard of two arrays as sets; 0 if either is empty."""
    union = F.size(F.array_union(a, b))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / union).otherwise(F.lit(0.0))


def can_reach(a: Column, b: Column, threshold: float) -> Column:
    """Whether the lengths allow a matching ratio of ``threshold``."""
    la, lb = F.length(a), F.length(b)
    return F.when((la > 0) & (lb > 0), 2 * F.least(la, lb) / (la + lb) >= threshold).otherwise(F.lit(False))


def padded_contains(text: Column, phrase: Column) -> Column:
    """Whether a normalised phrase stands in a normalised text between word borders."""
    return F.concat(F.lit(" "), text, F.lit(" ")).contains(F.concat(F.lit(" "), phrase, F.lit(" ")))


def n_non_ascii(c: Column | str) -> Column:
    return F.length(F.regexp_replace(text_of(c), "[\\x00-\\x7F]", ""))


def slug(c: Column | str) -> Column:
    cut = F.regexp_replace(F.regexp_replace(F.lower(text_of(c)), "[^a-z0-9]+", "_"), "\\A_+|_+\\z", "")
    return F.when(cut == "", F.lit("general")).otherwise(cut)


def preview(c: Column | str, most: int = 120) -> Column:
    short = collapsed(c)
    return F.when(F.length(short) <= most, short).otherwise(F.concat(F.regexp_replace(F.substring(short, 1, most - 1), "\\s+\\z", ""), F.lit("...")))


def glob(c: Column | str, patterns: list[str]) -> Column:
    """Whether a value fits one of the shell patterns, upper and lower case apart."""
    fits = F.lit(False)
    for pattern in patterns:
        fits = fits | text_of(c).rlike("^" + fnmatch.translate(pattern))
    return fits


def flags(*named: tuple[Column, str]) -> Column:
    """Names of the conditions that hold, in order."""
    return F.filter(F.array(*[F.when(condition, F.lit(name)) for condition, name in named]), lambda x: x.isNotNull())
