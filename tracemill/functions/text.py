"""Text expressions built from JVM functions only."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracemill.functions import fixed_values as fixed


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    """Trim Unicode whitespace at both ends."""
    return F.btrim(col(c), F.lit(fixed.WHITESPACE))


def clean(c: Column | str, default: str | None = None) -> Column:
    """Trimmed text; blank and null become ``default``."""
    value = F.nullif(strip(c), F.lit(""))
    return value if default is None else F.coalesce(value, F.lit(default))


def collapse(c: Column | str) -> Column:
    """Trim and fold every whitespace run to one space; null becomes ''."""
    spaced = F.regexp_replace(F.coalesce(col(c), F.lit("")), r"(?U)[\s\x1c-\x1f]+", " ")
    return F.trim(spaced)


def contains_any(c: Column | str, needles: list[str]) -> Column:
    """True when any fixed needle occurs in the text (case-sensitive)."""
    return reduce(lambda a, b: a | b, [F.contains(col(c), F.lit(n)) for n in needles])


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and hand it to ``body`` (lambdas re-evaluate outer expressions)."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def before(c: Column, mark: str) -> Column:
    """Text before the first ``mark`` (all of it when absent)."""
    return F.substring_index(c, mark, 1)


def part_after(c: Column, mark: str) -> Column:
    """Second piece of a split on ``mark``; null when ``mark`` is absent."""
    return F.get(F.split(c, re.escape(mark)), F.lit(1))


def clean_task_text(c: Column | str) -> Column:
    """Strip, peel matching outer quotes one level at a time, strip edge quotes and stars."""
    start = strip(c)

    def peel(s: Column) -> Column:
        first, size = F.substring(s, 1, 1), F.length(s)
        quoted = (size >= 2) & first.isin('"', "'") & (first == F.substring(s, -1, 1))
        return F.when(quoted, strip(F.substr(s, F.lit(2), size - 2))).otherwise(s)

    opening = F.length(F.regexp_extract(start, r"""^((?U)["'\s]+)""", 1))
    peeled = F.when(
        start.rlike("""^["']"""),
        F.aggregate(F.sequence(F.lit(1), opening), start, lambda acc, _: peel(acc)),
    ).otherwise(start)
    return F.nullif(F.btrim(peeled, F.lit(fixed.TASK_EDGE_CHARS)), F.lit(""))


# White space of any script counts as white space, separators \x1c-\x1f included.
_ALLOWED = "(?U)" + fixed.ALLOWED_TASK_CHARS.replace(r"\s", r"\s\x1c-\x1f", 1).removesuffix("$") + r"\z"


def is_allowed_charset(c: Column | str) -> Column:
    return col(c).rlike(_ALLOWED)


def mentions_media(c: Column | str) -> Column:
    return F.lower(col(c)).rlike("|".join(fixed.MEDIA_WORDS))


def has_blocked_term(c: Column | str) -> Column:
    return contains_any(c, fixed.BLOCKED_TERMS)


def reject_reason(c: Column | str) -> Column:
    """First curation rule a cleaned task breaks; null when it is accepted."""
    c = col(c)
    return (
        F.when(c.isNull(), "empty")
        .when(~is_allowed_charset(c), "charset")
        .when(mentions_media(c), "media")
        .when(has_blocked_term(c), "blocked_term")
    )


def looks_like_identifier(c: Column | str) -> Column:
    """Leak-check heuristic: underscore, hyphen or any digit."""
    return strip(c).rlike(r"(?U)[_\-\d]")


def looks_like_hidden_identifier(c: Column | str) -> Column:
    """Trace heuristic: underscore, or a letter together with a digit."""
    s = strip(c)
    return F.contains(s, F.lit("_")) | (s.rlike(r"\p{L}") & s.rlike(r"(?U)\d"))


def safe_score(c: Column | str) -> Column:
    """Number from any scalar text, 0 when it cannot be read."""
    return F.coalesce(col(c).cast("string").try_cast("double"), F.lit(0.0))


def conflict_codes(c: Column | str) -> Column:
    """Known conflict codes in a comma-separated answer, in order."""
    codes = F.transform(F.split(col(c), ","), strip)
    known = F.filter(codes, lambda x: x.isin(fixed.CONFLICT_CODES))
    return F.when(F.lower(strip(c)) == "none", F.array().cast("array<string>")).otherwise(known)
