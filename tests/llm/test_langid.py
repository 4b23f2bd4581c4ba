import random

from pyspark.sql import functions as F

from tests.llm.util import empty_documents, odd_documents
from tracemill.llm import langid as li

SYLLABLES = {"aa": ["ka", "lo", "mi", "tu"], "bb": ["sch", "ein", "ung", "ge"], "cc": ["tion", "eau", "que", "oi"]}


def text(rng, lang, n=60):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(n))


def test_held_out_accuracy_and_rejection(spark):
    rng = random.Random(1)
    rows = [(i, text(rng, lang := list(SYLLABLES)[i % 3]), lang, f"s{i % 4}") for i in range(900)]
    truth = {i: lang for i, _, lang, _ in rows}
    # Some declare the wrong language, some nothing; foreign text has none of the trigrams.
    rows = [(i, t, "bb" if i % 50 == 0 else None if i % 7 == 0 else lang, s) for i, t, lang, s in rows]
    rows += [(5000 + i, " ".join("".join(rng.choice("zxwvyjq#") for _ in range(6)) for _ in range(50)), None, "s0") for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = {r["id"]: r for r in li.identify_documents(df).collect()}
    right = sum(got[i]["language"] == lang and got[i]["kept"] for i, lang in truth.items())
    assert right >= 0.99 * len(truth)
    assert not any(got[i]["kept"] for i in got if i >= 5000)
    kept = {r["doc_id"] for r in li.keep_identified(df).collect()}
    assert kept == {i for i, r in got.items() if r["kept"]}


def test_pages_fuse_declaration_suffix_and_host(spark):
    rng = random.Random(2)
    labelled = spark.createDataFrame([(lang, text(rng, lang)) for lang in SYLLABLES for _ in range(80)], "label string, text string")
    rows = []
    for i in range(240):
        lang = "aa" if i % 4 else "bb"
        host = f"h{i % 6}.{'xa' if lang == 'aa' else 'xb'}"
        rows.append((i, f"http://{host}/p{i}", f'<html lang="{lang}"><body><p>{text(rng, lang)}</p></body></html>'))
    # Hardly any text: the other evidence decides.
    rows += [(1000, "http://h1.xa/q", "<html lang='aa'><p>zz</p>"), (1001, "http://new.xb/q", "<html lang=bb><p>zz</p>"), (1002, "http://h4.xb/q", "<p>zz</p>")]
    # A wrong declaration does not win against text.
    rows += [(1003, "http://h1.xa/r", f'<html lang="bb"><p>{text(rng, "aa")}</p>')]
    rows += [(1004, None, None), (None, "x", "<p>"), (1005, "http://h1.xa/", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["id"]: r for r in li.identify_pages(pages, labelled).collect()}
    assert sum(got[i]["language"] == ("aa" if i % 4 else "bb") for i in range(240)) == 240
    assert [got[i]["language"] for i in (1000, 1001, 1002, 1003)] == ["aa", "bb", "bb", "aa"]
    assert not got[1004]["kept"] and not got[1005]["kept"] and None in got and len(got) == 247


def test_odd_rows(spark):
    docs = odd_documents(spark)
    out = li.identify_documents(docs).collect()
    assert len(out) == docs.count()
    assert all(not r["kept"] for r in out if r["id"] in (0, 1, 2))
    assert li.keep_identified(docs).columns == docs.columns
    assert li.identify_documents(empty_documents(spark)).count() == 0


def test_every_label_is_a_language(spark):
    """Rarer languages beyond the first 64 are learned and kept too."""
    rng = random.Random(5)
    letters = "bcdfghjklmnprstvz"
    own = {f"l{k:02}": [rng.choice(letters) + rng.choice("aeiou") + rng.choice(letters) for _ in range(6)] for k in range(70)}
    rows = [(100 * k + i, " ".join(rng.choice(own[lang]) for _ in range(80)), lang, "s") for k, lang in enumerate(own) for i in range(12 - (k > 63) * 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    assert li.fit_text_model(df.select(F.col("lang").alias("label"), "text"))["names"] == sorted(own)
    got = {r["id"]: r for r in li.identify_documents(df).collect()}
    assert all(got[i]["language"] == lang and got[i]["kept"] for i, _, lang, _ in rows)
