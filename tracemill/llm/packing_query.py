"""Query of the packing operator."""

from __future__ import annotations

import public_tokenizers

from tracemill.llm.packing import pack_documents
from tracemill.llm.queries import query, read


@query("op1_hierarchical_packing")
def op1(spark, folder):
    """All documents in sequences of at most 2048 tokens."""
    return pack_documents(read(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=1)
