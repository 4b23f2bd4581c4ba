"""File readers: JSON lines, item documents, Parquet trees and dialogue files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CORRUPT = "_corrupt"


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """JSON lines; blank lines are skipped and broken ones kept in ``_corrupt``."""
    parsed = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    full = T.StructType([*parsed.fields, T.StructField(CORRUPT, T.StringType())])
    return spark.read.schema(full).option("columnNameOfCorruptRecord", CORRUPT).json(path)


def _entries(value: Column, text: Column) -> Column:
    """(source_key, source_index, record) entries of a list or mapping variant, in the order of ``text``."""
    items = F.try_variant_get(value, "$", "array<variant>")
    pairs = F.try_variant_get(value, "$", "map<string,variant>")
    listed = F.transform(items, lambda v, i: F.struct(i.cast("string").alias("source_key"), i.alias("source_index"), v.alias("record")))
    # A parsed mapping is sorted by key; the document's own order comes from its text.
    order = F.json_object_keys(text)
    mapped = F.transform(
        F.map_entries(pairs),
        lambda e, i: F.struct(
            e["key"].alias("source_key"),
            F.coalesce(F.array_position(order, e["key"]).cast("int") - 1, i).alias("source_index"),
            e["value"].alias("record"),
        ),
    )
    return F.coalesce(listed, F.array_sort(mapped, lambda a, b: a["source_index"] - b["source_index"]))


def read_items(spark: SparkSession, path: str) -> DataFrame:
    """Item documents: a list, a mapping ``{id: record}`` or ``{"items": [...]}`` per file.

    One row per record with its key, index and JSON text; records that are not objects keep
    ``is_object`` false so a filtered copy can pass them through.  A file is one JSON document, so
    parallelism comes from the number of files; large collections belong in JSON lines.  A file above
    2 GB cannot be one row and fails the read.
    """
    docs = spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("source_file"), F.try_parse_json("value").alias("_v"), F.col("value").alias("_text")
    )
    inner = F.try_variant_get("_v", "$.items", "array<variant>")
    wrapped = F.transform(
        inner, lambda v, i: F.struct(i.cast("string").alias("source_key"), i.alias("source_index"), v.alias("record"))
    )
    rows = docs.select("source_file", F.explode(F.coalesce(wrapped, _entries(F.col("_v"), F.col("_text")))).alias("_e"))
    text = F.to_json("_e.record")
    return rows.select(
        "source_file",
        "_e.source_key",
        "_e.source_index",
        text.alias("record"),
        F.startswith(text, F.lit("{")).alias("is_object"),
    )


def read_parquet_tree(spark: SparkSession, folder: str) -> DataFrame:
    """All Parquet files below a folder."""
    return spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").parquet(folder)


def read_dialogues(items: DataFrame, current: str, legacy: str, per_item: bool = False) -> DataFrame:
    """Dialogues nested in item records under the current field name.

    The legacy name is used only when no item holds a dialogue under the current one; with ``per_item`` by
    each item whose current list is missing or empty.
    """
    if per_item:
        listed = lambda field: F.try_variant_get(F.try_parse_json("record"), f"$.{field}", "array<variant>")
        chosen = F.when(F.size(listed(current)) > 0, listed(current)).otherwise(listed(legacy))
        return items.filter("is_object").select(
            "source_key",
            "source_index",
            F.get_json_object("record", "$.env_id").alias("env_id"),
            F.posexplode(F.transform(chosen, lambda v: F.to_json(v))).alias("position", "dialogue"),
        ).filter(F.startswith("dialogue", F.lit("{")))

    def exploded(field: str) -> DataFrame:
        listed = F.try_variant_get(F.try_parse_json("record"), f"$.{field}", "array<variant>")
        return items.filter("is_object").select(
            "source_key",
            "source_index",
            F.get_json_object("record", "$.env_id").alias("env_id"),
            F.posexplode(F.transform(listed, lambda v: F.to_json(v))).alias("position", "dialogue"),
        ).filter(F.startswith("dialogue", F.lit("{")))

    now, old = exploded(current), exploded(legacy)
    used = now.limit(1).agg(F.count(F.lit(1))).scalar()
    return now.unionByName(old.filter(used == 0))


def read_packaged(spark: SparkSession, path: str, part: str, schema: str) -> DataFrame:
    """One part of packaged samples: ``sample_id`` and the columns of ``schema``.  Only the folder of the part is read."""
    rows = spark.read.parquet(path).filter(F.col("part") == part)
    return rows.select("sample_id", F.from_json("content", schema).alias("_c")).select("sample_id", "_c.*")
