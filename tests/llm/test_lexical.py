import math
import random
import re
from collections import Counter

import pytest

from tests.llm.util import LONG, empty_documents, odd_documents, prose
from tracemill.llm import lexical as lx

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(queries, docs, k):
    """Every document scored for every query, by the definition: ``(query, rank, id, score)``."""
    held = [(i, t, Counter(t)) for i, t in ((i, terms(x)) for i, x in docs) if t]
    n_docs, n_terms = len(held), sum(len(t) for _, t, _ in held)
    df = Counter(w for _, _, c in held for w in c)
    out = []
    for q, text in queries:
        scores = []
        for i, own, counts in held:
            m = 25 + (75 * len(own) * n_docs) // n_terms
            score = 0
            for w, times in Counter(terms(text)).items():
                if counts[w]:
                    weight = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1)))
                    score += times * weight * ((10**9 * counts[w]) // (1000 * counts[w] + 8 * m))
            if score > 0:
                scores.append((-score, i is None, i if i is not None else 0, i))
        out += [(q, r + 1, s[3], -s[0]) for r, s in enumerate(sorted(scores, key=lambda s: s[:3])[:k])]
    return sorted(out, key=str)


def found(df):
    return sorted(((r["query"], r["rank"], r["id"], r["score"]) for r in df.collect()), key=str)


@pytest.fixture()
def small_classes(monkeypatch):
    monkeypatch.setattr(lx, "RARE", 4)
    monkeypatch.setattr(lx, "STEP", 3)


def frame(spark, rows, key):
    return spark.createDataFrame(rows, f"{key} long, text string")


def test_terms_are_those_of_the_pattern():
    rng = random.Random(1)
    alphabet = [*map(chr, range(0x100)), "é", "İ", "ſ", " ", "漢", "\U0001f600", "A", "z", "0"]
    for _ in range(500):
        text = "".join(rng.choice(alphabet) for _ in range(80))
        assert [t.decode() for t in lx.terms_of(text)] == terms(text)


def test_matches_brute_force(spark, small_classes):
    """Zipf words, planted passages, groups of copies and ties, several classes, queries that close early and late."""
    rng = random.Random(2)
    words = [f"t{i}" for i in range(400)]
    weights = [1 / (i + 1) for i in range(400)]
    docs = [(i, " ".join(rng.choices(words, weights, k=rng.randrange(1, 60)))) for i in range(400)]
    queries = [(j, " ".join(rng.choices(words, weights if j % 2 else None, k=rng.randrange(1, 25)))) for j in range(20)]
    queries += [(100, "t0"), (101, "t0 t0 t1"), (102, "nothing known"), (103, "T399 t0, t1; t2")]
    docs += [(1000 + i, queries[i % 7][1] + " " + prose_of(rng)) for i in range(60)]
    docs += [(2000 + i, queries[3][1]) for i in range(150)]
    rng.shuffle(docs)
    got = found(lx.search(frame(spark, queries, "item_id"), frame(spark, docs, "doc_id").repartition(5), 10))
    assert got == brute(queries, docs, 10)
    assert found(lx.search(frame(spark, queries, "item_id"), frame(spark, docs, "doc_id"), 3)) == brute(queries, docs, 3)


def prose_of(rng):
    return " ".join(prose(rng, rng.randrange(30), 50))


def test_large_vocabulary_takes_the_join(spark, small_classes, monkeypatch):
    monkeypatch.setattr(lx, "VOCABULARY", 0)
    rng = random.Random(4)
    docs = [(i, " ".join(prose(rng, 30, 200))) for i in range(200)]
    queries = [(j, " ".join(prose(rng, 8, 300))) for j in range(12)]
    assert found(lx.search(frame(spark, queries, "item_id"), frame(spark, docs, "doc_id"))) == brute(queries, docs, 10)


def test_closed_queries_take_no_new_accumulators(spark, small_classes, monkeypatch):
    """A query whose rare terms settle it does not read the postings of its common terms."""
    seen = []
    keep = lx.materialize

    def watch(df, name="step", *folders):
        out = keep(df, name, *folders)
        if name in ("sums", "survivors"):
            seen.append((name, out.count()))
        return out

    monkeypatch.setattr(lx, "materialize", watch)
    docs = [(i, f"common word{i % 3} filler") for i in range(300)] + [(900 + i, "rare1 rare2 rare3 common") for i in range(3)]
    queries = [(1, "rare1 rare2 rare3 common")]
    assert found(lx.search(frame(spark, queries, "item_id"), frame(spark, docs, "doc_id"), 3)) == brute(queries, docs, 3)
    assert seen == [("sums", 3), ("survivors", 3)]


def test_odd_rows(spark):
    docs = odd_documents(spark)
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    asked = [(0, "one two words"), (1, None), (2, ""), (None, "a b c"), (3, "A b C café naïve endoftext"), (3, "id at all"), (4, LONG), (5, "a b c")]
    queries = frame(spark, asked, "item_id").selectExpr("*", "'clash' AS q", "'clash' AS key", "'clash' AS term", "'clash' AS score")
    assert found(lx.search(queries, docs)) == brute(asked, rows, 10)
    assert lx.search(queries, empty_documents(spark)).count() == 0
    assert lx.search(queries.limit(0), docs).count() == 0
    # Equal queries are answered apart.
    twice = frame(spark, [(7, "one"), (7, "one")], "item_id")
    assert lx.search(twice, docs).count() == 2 * lx.search(twice.limit(1), docs).count()
