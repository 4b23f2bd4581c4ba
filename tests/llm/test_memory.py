"""What a Python worker of the corpus operators holds at one time."""

import random
import tracemalloc

import numpy as np
import pyarrow as pa

from tests.llm.util import prose
from tracemill.llm import setsketch as ss
from tracemill.llm.common import rows_of


def peak_mb(run):
    tracemalloc.start()
    try:
        out = run()
        return out, tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def test_rows_of_a_batch_are_not_held_at_once():
    texts = [None if i % 9 == 0 else b"x" * 4000 + b"%d" % i for i in range(5000)]
    batch = pa.record_batch({"id": range(5000), "text": pa.array(texts, pa.binary())})
    for some in (batch, batch.slice(11, 700), batch.slice(0, 0)):
        assert list(rows_of(iter([some]), "id", "text")) == [(r["id"], r["text"]) for r in some.to_pylist()]
    n, mb = peak_mb(lambda: sum(1 for _ in rows_of(iter([batch, batch]), "id", "text")))
    assert n == 10000 and mb < 4  # 20 MB of texts


def block(first, texts):
    ids = pa.array(range(first, first + len(texts)), pa.int64())
    return pa.table({"id": ids, "component": ids, "text": pa.array(texts, pa.binary())})


def test_matrices_of_two_blocks_are_made_in_parts():
    texts = [b" ".join(b"w%d-%d" % (i, j) for j in range(60)) for i in range(512)]
    one, two = block(0, texts), block(512, [t + b" end" for t in texts])
    found, mb = peak_mb(lambda: ss._block_links(one, two, False, 3, 85))
    assert sorted(found) == [(i, 512 + i) for i in range(512)]
    assert mb < 25, mb  # one matrix of 8192 columns takes 17 MB
    assert ss._block_links(one, one, True, 3, 85) == [] == ss._block_links(one, block(512, [b"a b c"]), False, 3, 85)
    assert ss._block_links(one, two.slice(0, 0), False, 3, 85) == []


def test_blocks_hold_a_bounded_number_of_shingles(spark, monkeypatch):
    rng = random.Random(5)
    base = prose(rng, 80)
    rows = []
    for i in range(40):
        words = list(base)
        for _ in range(i % 7):
            words[rng.randrange(len(words))] = f"e{rng.randrange(99999)}"
        rows.append((i, " ".join(words)))
    sets = [ss.shingle_set(t.encode().lower().split(), 3) for _, t in rows]
    calls, plain = spark.sparkContext.accumulator(0), ss._block_links

    def counted(one, two, same, k, percent):
        calls.add(1)
        return plain(one, two, same, k, percent)

    monkeypatch.setattr(ss, "_block_links", counted)
    monkeypatch.setattr(ss, "WEIGHT", 500)
    members = spark.createDataFrame([(0, i, len(sets[i]), 40, i) for i in range(40)], "leader long, id long, n long, size long, component long")
    docs = spark.createDataFrame(rows, "id long, text string")
    got = {tuple(sorted((r["a"], r["b"]))) for r in ss._large_links(members, docs, 3, 85).collect()}
    both = lambda i, j: len(np.intersect1d(sets[i], sets[j]))
    assert got == {(i, j) for j in range(40) for i in range(j) if 100 * both(i, j) >= 85 * (len(sets[i]) + len(sets[j]) - both(i, j))}
    assert calls.value > 10  # by the number of documents alone it would be 2: fewer than BLOCK
