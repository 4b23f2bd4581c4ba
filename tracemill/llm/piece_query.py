"""Query of the SentencePiece operator."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from tracemill.llm.pieces import encode_texts
from tracemill.llm.queries import query, read


@query("op13_prefix_table_pieces")
def op13(spark, folder):
    """Digests of the ids of every text and of what they decode to."""
    rows = encode_texts(read(spark, folder, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
    ids = F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256)
    return rows.select(F.col("id").alias("doc_id"), F.size("ids").cast("long").alias("n_tokens"), ids.alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
