import hashlib
import random

import pandas as pd
import pytest
import public_tokenizers
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.conftest import SMALL
from tests.llm.util import ODD_TEXTS, empty_documents, odd_documents
from tracemill.llm.pieces import Coder, decode_ids, encode_texts

MODEL = public_tokenizers.path("piece_bpe_32k.model")
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=MODEL)
with open(MODEL, "rb") as _file:
    CODER = Coder(_file.read())
PIECES = sorted(p for p in CODER.ids if len(p) > 1)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=120))
def test_ids_are_those_of_the_library(text):
    ids = CODER.encode(text)
    assert ids.tolist() == LIBRARY.encode(text)
    assert CODER.decode(ids) == LIBRARY.decode(LIBRARY.encode(text))


def test_joined_pieces_and_spaces():
    rng = random.Random(3)
    texts = ["".join(rng.choice(PIECES) for _ in range(rng.randrange(1, 6))).replace("▁", " ") for _ in range(5000)]
    texts += [" " * n + tail for n in range(1, 70) for tail in ("", "a", "thing", "\n", "é", "\U0001f600z", "▁")]
    assert [CODER.encode(t).tolist() for t in texts] == [LIBRARY.encode(t) for t in texts]


@pytest.mark.parametrize("text", ["", " " * 200_000, "\ue000" * 9, "a\ue000b \ue000", "\n" * 200_000, "a" * 100_000, "漢字かな" * 20_000, "x \U0001f600" * 50_000])
def test_long_units(text):
    assert CODER.encode(text).tolist() == LIBRARY.encode(text)


def test_pair_test_is_the_merges():
    """The pair test against merging the joined text, on pairs that occur and on random ones."""
    rng = random.Random(5)
    pairs = [(rng.choice(PIECES), rng.choice(PIECES)) for _ in range(3000)]
    pairs += [(p[:i], p[i:]) for p in PIECES[::7] for i in range(1, len(p))]
    for a, b in pairs:
        if CODER.history(a) is not None and b in CODER.score:
            assert CODER.compatible(a, b) == (CODER.merges(a + b)[1] == [a, b]), (a, b)


def test_bounded_stores(monkeypatch):
    monkeypatch.setattr("tracemill.llm.pieces.UNITS", 3)
    monkeypatch.setattr("tracemill.llm.pieces.PAIRS", 5)
    text = "one two three four five six seven eight nine ten"
    assert CODER.encode(text).tolist() == LIBRARY.encode(text)
    assert CODER.held <= 5
    for text in ("eleven twelve", "thirteen", "fourteen one", "thirteen fifteen"):
        assert CODER.encode(text).tolist() == LIBRARY.encode(text)
    assert len(CODER.memo) <= 6 and len(CODER.old) <= 6


def test_odd_documents(spark):
    docs = odd_documents(spark)
    rows = encode_texts(docs, MODEL)
    want = sorted(((r["doc_id"], LIBRARY.encode(r["text"] or "")) for r in docs.select("doc_id", "text").collect()), key=str)
    got = rows.collect()
    assert sorted(((r["id"], r["ids"]) for r in got), key=str) == want
    assert all(r["decoded"] == LIBRARY.decode(r["ids"]) for r in got)
    assert [r["decoded"] for r in got if r["id"] == 0] == [ODD_TEXTS[0] or ""]
    back = {r["id"]: r["text"] for r in decode_ids(rows.filter("id > 5"), MODEL).collect()}
    assert back == {r["id"]: r["decoded"] for r in got if (r["id"] or 0) > 5}
    assert decode_ids(spark.createDataFrame([(1, None)], "id long, ids array<int>"), MODEL).first()["text"] is None
    assert encode_texts(empty_documents(spark), MODEL).count() == 0


def test_query_digests(spark):
    from tracemill.llm.catalog import QUERIES

    got = {r["doc_id"]: tuple(r)[1:] for r in QUERIES["op13_prefix_table_pieces"](spark, SMALL).collect()}
    table = pd.read_parquet(f"{SMALL}/documents.parquet")
    assert len(got) == len(table)
    for key, text in zip(table["doc_id"], table["text"], strict=True):
        ids = LIBRARY.encode(text or "")
        digest = hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[key] == (len(ids), digest, hashlib.sha256(LIBRARY.decode(ids).encode()).hexdigest())
