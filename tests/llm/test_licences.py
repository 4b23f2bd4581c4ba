import random
import textwrap

from tests.llm.util import empty_documents, odd_documents, prose
from tracemill.llm import licences as lc


def test_held_out_accuracy():
    rng = random.Random(1)
    background = [[w.encode() for w in prose(rng, rng.randrange(5, 40))] for _ in range(800)]
    model = lc.fit(background[:600])
    right = total = 0
    for family in lc.TEMPLATES:
        for words in lc.variants(family, background[600:], 999)[::7]:
            if lc.overlap(words, family) < lc.LEAST_OVERLAP:
                continue
            p = model.probabilities([words])[0]
            right += model.families[p.argmax()] == family
            total += 1
    assert total > 200 and right >= 0.95 * total
    unknown = model.probabilities(background[600:])
    assert (unknown.argmax(axis=1) == len(model.families) - 1).mean() >= 0.99
    # Calibrated: the mean probability of the winner is near the share that is right.
    assert abs(unknown.max(axis=1).mean() - 1) < 0.1


def test_scan(spark):
    rng = random.Random(2)
    text = lambda n=30: " ".join(prose(rng, n))
    rows = [(i, text() + "\n" + text(), "en", "s") for i in range(300)]
    rows += [
        (1000, text() + "\nReleased under the MIT License.\n" + text(), "en", "s"), (1001, "All rights reserved.\n" + text(), "en", "s"),
        (1002, text(300) + "\nThis work is licensed under the GNU General Public License, version 3.", "en", "s"), (1003, text() + "\nLicensed under CC BY-NC 4.0.\nLicensed under the Apache License, Version 2.0.", "en", "s"),
        (1004, text(60) + " licensed under the GNU General Public License version 2 " + text(60), "en", "s"), (1005, "He lost the licence to drive.", "en", "s"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = {r["id"]: r for r in lc.scan(docs, lc.train(docs)).collect()}
    assert [got[i]["families"] for i in range(1000, 1006)] == [["mit"], ["proprietary"], ["gpl"], ["apache", "cc-by-nc"], ["gpl"], []]
    assert [got[i]["restricted"] for i in range(1000, 1006)] == [False, True, True, True, True, False]
    assert not any(got[i]["families"] for i in range(300)) and got[0]["n_paragraphs"] == 2


def test_odd_rows(spark):
    docs = odd_documents(spark)
    model = lc.train(docs)
    out = lc.scan(docs, model).collect()
    assert len(out) == docs.count() and not any(r["families"] for r in out)
    assert {r["n_paragraphs"] for r in out if r["id"] in (0, 1, 2)} == {0}
    assert lc.scan(empty_documents(spark), lc.train(empty_documents(spark))).count() == 0


def test_wrapped_notices(spark):
    """Each template wrapped as in files, behind comment signs and amid other text."""
    rng = random.Random(3)
    rows, want = [(i, " ".join(prose(rng, 30)), "en", "s") for i in range(300)], {}
    for family, own in lc.TEMPLATES.items():
        for template in own:
            for width in (72, 30):
                around = [" ".join(prose(rng, 9)) for _ in range(2)]
                lines = textwrap.wrap(f"{around[0]}. {template}. {around[1]}", width)
                want[1000 + len(want)] = family
                rows.append((999 + len(want), "\n".join(["Title", "", *(f" * {x}" for x in lines), " *", " * more"]), "en", "s"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = {r["id"]: r for r in lc.scan(docs, lc.train(docs)).collect()}
    assert [(f, got[i]["families"], rows[i - 700][1]) for i, f in want.items() if got[i]["families"] != [f]] == []
    assert all(got[i]["restricted"] == (f in lc.RESTRICTED) for i, f in want.items())
    assert not any(got[i]["families"] for i in range(300))
