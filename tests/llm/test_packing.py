import zlib
from collections import Counter

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tests.llm.util import ODD_TEXTS, empty_documents, odd_documents
from tracemill.llm import packing as pk

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def tokenizer():
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return t


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=200))
def test_ids_are_those_of_the_tokenizer_file(text):
    assert pk.token_ids(text, RANKS, 1).tolist() == tokenizer_ids(text)


_T = tokenizer()


def tokenizer_ids(text):
    return [*_T.encode(text, add_special_tokens=False).ids, 1]


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 2048), st.integers(1, 3000), min_size=1, max_size=40))
def test_layout_places_every_rank_once(histogram):
    rows = pk.layout(histogram)
    cover, windows = {}, {}
    for r in rows:
        cover.setdefault((r["length"], r["part"]), []).append((r["first"], r["count"]))
        size = r["length"] if r["part"] < 0 else pk.parts_of(r["length"])[r["part"]]
        windows.setdefault((r["sequence"], r["count"]), []).append((r["offset"], size))
    for n, count in histogram.items():
        parts = pk.parts_of(n)
        for part in range(len(parts)):
            spans = sorted(cover.get((n, -1), []) + cover.get((n, part), []))
            at = 0
            for first, many in spans:
                assert first == at
                at += many
            assert at == count
    starts = sorted(windows)
    assert [s for s, _ in starts] == np.cumsum([0, *[c for _, c in starts]])[:-1].tolist()
    for own in windows.values():
        at = 0
        for offset, size in sorted(own):
            assert offset == at
            at += size
        assert at <= pk.TIERS[-1]


def test_little_padding():
    rng = np.random.default_rng(0)
    for mean in (80, 300, 900):
        lengths = Counter(np.clip(rng.lognormal(np.log(mean), 0.7, 20_000).astype(int) + 1, 1, 2048).tolist())
        padding = 0
        fills = {}
        for r in pk.layout(lengths):
            fills[r["sequence"]] = (r["used"], r["count"])
        for used, count in fills.values():
            padding += count * (0 if used & (used - 1) == 0 else 2048 - used)
        assert padding <= 0.005 * sum(n * c for n, c in lengths.items())


def test_pieces_cover_all_documents(spark):
    docs = odd_documents(spark)
    packed = pk.pack_documents(docs, RANKS, 1)
    rows = packed.collect()
    by = {}
    for r in rows:
        by.setdefault(r["doc_id"], []).append(r)
    times = Counter(r["doc_id"] for r in docs.select("doc_id").collect())
    assert set(by) == set(times)
    for i, text in enumerate(ODD_TEXTS):
        ids = np.array(tokenizer_ids(text or ""), "<u4")
        spans = Counter((r["start"], r["length"]) for r in by[i])
        assert set(spans.values()) == {times[i]}
        at = 0
        for start, length in sorted(spans):
            assert start == at
            at += length
        assert at == len(ids)
        for r in by[i]:
            assert r["doc_tokens"] == len(ids)
            assert r["ids_crc32"] == zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes())
    sequences = {}
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append(r)
    for own in sequences.values():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 2048 and len({(r["tier"], r["step_group"]) for r in own}) == 1
    full = pk.with_ids(packed.filter("doc_id = 6"), docs, RANKS, 1).orderBy("sequence_id", "offset").collect()
    assert Counter(x for r in full for x in r["ids"]) == Counter(tokenizer_ids(ODD_TEXTS[6]))
    assert pk.pack_documents(empty_documents(spark), RANKS, 1).count() == 0
    again = pk.pack_documents(docs.repartition(7), RANKS, 1)
    assert sorted(map(tuple, again.filter("doc_id is not null").collect())) == sorted(tuple(r) for r in rows if r["doc_id"] is not None)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=20), st.sampled_from(["<|endoftext|>", "<|endoftext", "|>", " ", "\n", "'s"])), max_size=12))
def test_added_tokens_are_those_of_the_tokenizer_as_loaded(parts):
    text = "".join(parts)
    assert pk.token_ids(text, JSON, 1).tolist() == [*_LOADED.encode(text, add_special_tokens=False).ids, 1]


JSON = public_tokenizers.path("byte_bpe_50k.json")
_LOADED = Tokenizer.from_file(JSON)


def test_query_matches_added_tokens(spark, tmp_path):
    from tracemill.llm.catalog import QUERIES

    text = "it's <|endoftext|> 12% $5"
    spark.createDataFrame([(1, text, "en", "s")], "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    ids = np.array([*_LOADED.encode(text, add_special_tokens=False).ids, 1], "<u4")
    rows = QUERIES["op1_hierarchical_packing"](spark, str(tmp_path)).collect()
    assert [(r["doc_tokens"], r["length"]) for r in rows] == [(9, 9)] and 50256 in ids
    assert rows[0]["ids_crc32"] == zlib.crc32(ids.tobytes())


def test_very_long_white_space():
    for text in (" " * 1_000_000 + "x", "a" + "\n" * 1_000_000, "a" + " " * 1_200_000 + "<|endoftext|>", "\t \n" * 400_000, "a " * 500_000):
        assert pk.token_ids(text, JSON, 1).tolist() == [*_LOADED.encode(text, add_special_tokens=False).ids, 1]
        assert pk.token_ids(text, RANKS, 1).tolist() == tokenizer_ids(text)


def test_long_white_space_is_packed(spark):
    docs = spark.createDataFrame([(1, " " * 1_000_000), (2, "a" + "\n" * 1_000_000), (3, "b")], "doc_id long, text string")
    rows = pk.pack_documents(docs, JSON, 1).collect()
    sums = {i: sum(r["length"] for r in rows if r["doc_id"] == i) for i in (1, 2, 3)}
    assert sums == {i: len(pk.token_ids(t, JSON, 1)) for i, t in docs.collect()}
