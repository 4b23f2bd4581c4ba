"""Model output text to columns, over a table of completions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracemill.functions import text as tx

# --- fixed values: text patterns of the tool-call encodings and fenced blocks ---
THINK = r"(?s)<think>.*?</think>"
TAGGED_CALL = r"(?s)<tool_call>(.*?)</tool_call>"
PYTHON_TAG = r"(?s)<\|python_tag\|>(.*?)(?:<\|eom_id\|>|$)"
FENCE = r"(?s)```(?:json)?\s*\n?(.*?)\n?```"
CONFIG_WRAPPERS = ["init_config", "config", "data"]

CALLS_TYPE = "array<struct<name:string,arguments:string>>"


def extract_sections(
    df: DataFrame, text: str, sections: Mapping[str, str], optional: Mapping[str, str] | None = None
) -> DataFrame:
    """Text between consecutive headings; all null and ``parsed_ok`` false when one is missing.

    ``sections`` maps output column to heading, in the order the headings are expected.  ``optional``
    gives, for sections at the end that may be absent, the value they then have.
    """
    headings, optional = list(sections.values()), dict(optional or {})
    ok = F.lit(True)
    for name, h in sections.items():
        if name not in optional:
            ok = ok & F.contains(F.col(text), F.lit(h))
    out = df.withColumn("parsed_ok", F.coalesce(ok, F.lit(False)))
    for i, (name, heading) in enumerate(sections.items()):
        body = tx.part_after(F.col(text), heading)
        if i + 1 < len(headings):
            body = tx.before(body, headings[i + 1])
        body = tx.strip(body)
        if name in optional:
            body = F.when(F.contains(F.col(text), F.lit(heading)), body).otherwise(optional[name])
        out = out.withColumn(name, F.when(F.col("parsed_ok"), body))
    return out


def yes_no(answer: Column | str, ignore_case: bool = False) -> Column:
    """True for YES, false for NO, null for neither."""
    body = F.upper(tx.col(answer)) if ignore_case else tx.col(answer)
    return F.when(F.contains(body, F.lit("YES")), True).when(F.contains(body, F.lit("NO")), False)


def extract_score(text: Column | str, name: str) -> Column:
    """Digits after ``name:``, or null."""
    return F.nullif(F.regexp_extract(tx.col(text), name + r":\s*(\d+)", 1), F.lit("")).try_cast("int")


def state_bullets(df: DataFrame, keys: Sequence[str], text: str) -> DataFrame:
    """Entity blocks with attributes and description, one row each; short blocks are dropped."""
    blocks = F.slice(F.split(text, "- Entity: "), F.lit(2), F.greatest(F.size(F.split(text, "- Entity: ")) - 1, F.lit(0)))
    rows = df.select(*keys, F.posexplode(blocks).alias("position", "_b"))
    lines = F.filter(F.transform(F.split("_b", "\n"), tx.strip), lambda x: x != "")
    rows = rows.withColumn("_l", lines).filter(F.size("_l") >= 3)
    bare = lambda i, mark: tx.strip(F.replace(F.get("_l", F.lit(i)), F.lit(mark), F.lit("")))
    return rows.select(
        *keys, "position", F.get("_l", F.lit(0)).alias("entity"), bare(1, "- Attributes: ").alias("attributes"),
        bare(2, "- Description: ").alias("description"),
    )


def constraint_bullets(text: Column | str) -> Column:
    """Non-blank ``- `` items."""
    parts = F.split(tx.col(text), "- ")
    return F.filter(F.transform(F.slice(parts, F.lit(2), F.size(parts)), tx.strip), lambda x: x != "")


def operation_bullets(df: DataFrame, keys: Sequence[str], text: str, kind: str) -> DataFrame:
    """``- Operation: name`` / ``Description: text`` pairs as rows."""
    rows = df.select(*keys, F.posexplode(F.split(text, "- Operation: ")).alias("position", "_b"))
    parts = F.split("_b", "Description: ")
    return rows.withColumn("_p", parts).filter((F.size("_p") >= 2) & (tx.strip("_b") != "")).select(
        *keys, "position", tx.strip(F.get("_p", F.lit(0))).alias("operation_name"),
        tx.strip(F.get("_p", F.lit(1))).alias("operation_description"), F.lit(kind).alias("operation_type"),
    )


#: Pieces of a JSON-like text: strings in double quotes, single-quoted strings in a JSON position, brackets,
#: commas with the blanks behind them, and what lies between.
JSON_PIECES = r"""(?s)"(?:[^"\\]|\\.)*+"|'[^'\\\n]*'(?=\s*[:,}\]])|[{\[]|[}\]]|,\s*|[^"'{}\[\],]++|."""


def _value_from(text: Column, opening: str) -> Column:
    """Canonical JSON of the value that starts at the first ``opening`` bracket, or null.

    One pass cuts the text into pieces and one more counts brackets outside strings up to the closing one, so the
    work is linear in the text.  A value that does not parse is tried again without commas before closing
    brackets and with its single-quoted strings in double quotes.
    """
    at = F.instr(text, opening)
    pieces = F.regexp_extract_all(F.substr(text, at, F.length(text)), F.lit(JSON_PIECES), F.lit(0))

    def closing(all_: Column) -> Column:
        def step(acc: Column, x: Column) -> Column:
            depth = acc["depth"] + F.when(x.isin("{", "["), 1).when(x.isin("}", "]"), -1).otherwise(0)
            seen = acc["seen"] + 1
            end = F.coalesce(acc["end"], F.when(depth == 0, seen))
            return F.struct(depth.alias("depth"), seen.alias("seen"), end.alias("end"))

        start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("seen"), F.lit(None).cast("int").alias("end"))
        return F.slice(all_, F.lit(1), F.aggregate(all_, start, step)["end"])

    def double_quoted(x: Column) -> Column:
        inner = F.replace(F.substr(x, F.lit(2), F.length(x) - 2), F.lit('"'), F.lit('\\"'))
        return F.when(F.startswith(x, F.lit("'")) & (F.length(x) > 1), F.concat(F.lit('"'), inner, F.lit('"'))).otherwise(x)

    def parsed(own: Column) -> Column:
        stray = lambda x, i: F.startswith(x, F.lit(",")) & F.coalesce(F.get(own, i + 1).isin("}", "]"), F.lit(False))
        tidy = F.transform(F.filter(own, lambda x, i: ~stray(x, i)), double_quoted)
        read = lambda parts: F.to_json(F.try_parse_json(F.array_join(parts, "")))
        return F.coalesce(read(own), read(tidy))

    return F.when(at > 0, tx.let(tx.let(pieces, closing), parsed))


def _json_in(text: Column) -> Column:
    """First JSON object in a text, else the first array."""
    return F.coalesce(_value_from(text, "{"), _value_from(text, "["))


def extract_json(text: Column | str) -> Column:
    """Canonical JSON of the first value in a fenced block, else anywhere in the text."""
    c = tx.col(text)
    fenced = tx.strip(F.regexp_extract(c, FENCE, 1))
    return F.coalesce(F.when(c.rlike(FENCE), _json_in(fenced)), _json_in(c))


def extract_config(text: Column | str) -> Column:
    """JSON object of an answer, unwrapped from a single wrapper key or a one-element list."""
    found = extract_json(text)
    is_object = lambda c: F.when(F.startswith(c, F.lit("{")), c)
    part = lambda v, path: F.to_json(F.try_variant_get(v, path, "variant"))

    def unwrap(raw: Column) -> Column:
        v = F.try_parse_json(raw)
        inner = [is_object(part(v, f"$.{k}")) for k in CONFIG_WRAPPERS]
        head = F.when(F.startswith(raw, F.lit("[")), is_object(part(v, "$[0]")))
        return F.coalesce(F.when(F.startswith(raw, F.lit("{")), F.coalesce(*inner, raw)), head)

    return tx.let(found, unwrap)


def strip_thinking(text: Column | str) -> Column:
    return tx.strip(F.regexp_replace(tx.col(text), THINK, ""))


def _get(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "variant")


def _call(raw: Column, names: Sequence[str], strict: bool) -> Column:
    """(name, arguments) of one encoded call, or null.  ``strict`` wants an object as arguments."""

    # With two possible fields an empty value falls through to the next one.
    empty = ["null", "{}", "[]", '""', "0", "false"]

    def field(v: Column, n: str) -> Column:
        given = F.to_json(_get(v, f"$.{n}"))
        return given if len(names) == 1 else tx.let(given, lambda g: F.when(~g.isin(empty), g))

    def build(v: Column) -> Column:
        name = tx.clean(F.try_variant_get(v, "$.name", "string"))
        arguments = F.coalesce(*[field(v, n) for n in names], F.lit("{}"))
        if not strict:  # arguments are often encoded as a string: that text is passed on as it is
            as_text = F.try_variant_get(F.try_parse_json(arguments), "$", "string")
            arguments = F.when(F.startswith(arguments, F.lit('"')), as_text).otherwise(arguments)
        return F.struct(name.alias("name"), arguments.alias("arguments"))

    def usable(call: Column) -> Column:
        ok = call["name"].isNotNull()
        if strict:
            ok = ok & F.startswith(call["arguments"], F.lit("{"))
        return F.when(ok, call)

    # Only objects have a name, so anything else is dropped with the nameless calls.
    return tx.let(tx.let(F.try_parse_json(tx.strip(raw)), build), usable)


def _calls(raws: Column, names: Sequence[str], strict: bool = False) -> Column:
    made = F.filter(F.transform(raws, lambda r: _call(r, names, strict)), lambda x: x.isNotNull())
    return F.when(F.size(made) > 0, made)


def extract_tool_calls(df: DataFrame, text: str) -> DataFrame:
    """Add ``tool_calls`` (array of name and arguments JSON), ``call_format`` and ``remaining_text``.

    Encodings by priority: tagged blocks, python-tag blocks, one JSON call, a JSON list of calls.
    """
    body = F.col(text)
    either = ["parameters", "arguments"]
    whole = tx.strip(body)
    items = F.transform(
        F.coalesce(F.try_variant_get(F.try_parse_json(whole), "$", "array<variant>"), F.array().cast("array<variant>")),
        lambda v: F.to_json(v),
    )
    # Each encoding is only parsed where the one before it found nothing and its mark is present.
    has = lambda mark: F.contains(body, F.lit(mark))
    starts = lambda mark: F.startswith(whole, F.lit(mark))
    one = F.when(has("<tool_call>"), _calls(F.regexp_extract_all(body, F.lit(TAGGED_CALL), 1), ["arguments"]))
    two = F.when(has("<|python_tag|>"), _calls(F.regexp_extract_all(body, F.lit(PYTHON_TAG), 1), either))
    staged = (
        df.withColumn("_1", one)
        .withColumn("_2", F.when(F.col("_1").isNull(), two))
        .withColumn("_3", F.when(F.coalesce("_1", "_2").isNull() & starts("{"), _calls(F.array(whole), either, strict=True)))
        .withColumn("_4", F.when(F.coalesce("_1", "_2").isNull() & starts("["), _calls(items, either, strict=True)))
    )
    found = [F.col(c).isNotNull() for c in ("_1", "_2", "_3", "_4")]
    chosen = F.when(found[0], "tagged").when(found[1], "python_tag").when(found[2], "json").when(found[3], "json_list").otherwise("none")
    rest = (
        F.when(found[0], tx.strip(F.regexp_replace(body, TAGGED_CALL, "")))
        .when(found[1], tx.strip(F.regexp_replace(body, PYTHON_TAG, "")))
        .when(found[2] | found[3], "")
        .otherwise(body)
    )
    out = staged.withColumn("tool_calls", F.coalesce("_1", "_2", "_3", "_4", F.array().cast(CALLS_TYPE)))
    return out.withColumn("call_format", chosen).withColumn("remaining_text", rest).drop("_1", "_2", "_3", "_4")
