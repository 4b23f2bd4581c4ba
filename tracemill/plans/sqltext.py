"""SQL fragments shared by the twins."""

from __future__ import annotations

from tracemill.functions import fixed_values as fixed


def quote(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


WS = "concat(" + ", ".join(
    quote(c) if c.isprintable() and ord(c) < 128 else f"chr({ord(c)})" for c in fixed.WHITESPACE
) + ")"


def strip(expr: str) -> str:
    return f"trim({expr}, {WS})"


def clean_task(expr: str, levels: int = 3) -> str:
    """Nested peel of outer quotes (the data never nests deeper than ``levels``)."""
    out = strip(expr)
    for _ in range(levels):
        out = (
            f"list_transform([{out}], lambda s: CASE WHEN length(s) >= 2 AND left(s, 1) IN ('\"', '''') "
            f"AND left(s, 1) = right(s, 1) THEN {strip('substr(s, 2, length(s) - 2)')} ELSE s END)[1]"
        )
    edge = "concat(' ', chr(9), chr(10), chr(13), '\"', '''', '`', '*')"
    return f"nullif(trim({out}, {edge}), '')"


MEDIA = " OR ".join(f"contains(lower(task), {quote(w)})" for w in fixed.MEDIA_WORDS)
BLOCKED = " OR ".join(f"contains(task, {quote(w)})" for w in fixed.BLOCKED_TERMS)
# RE2's \\s is ASCII only and lacks \\x0b.
SPACES = r"\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
CHARSET = f"regexp_full_match(task, {quote(fixed.ALLOWED_TASK_CHARS[1:-1].replace(chr(92) + 's', SPACES, 1))})"
REJECT = (
    f"CASE WHEN task IS NULL THEN 'empty' WHEN NOT {CHARSET} THEN 'charset' "
    f"WHEN {MEDIA} THEN 'media' WHEN {BLOCKED} THEN 'blocked_term' END"
)
CODES = ", ".join(quote(c) for c in fixed.CONFLICT_CODES)
