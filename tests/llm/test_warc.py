import base64
import hashlib
import random

import pyarrow.fs as pafs
import pytest

from tracemill.llm import warc as wa


def pages():
    rng = random.Random(1)
    rows = [(i, f"http://{rng.choice('abc')}.example.com/{rng.randrange(40)}?q={i % 3}", f"<p>{rng.randrange(60)} é\r\n\r\n") for i in range(300)]
    rows += [(900, None, None), (901, "", ""), (902, "no scheme", "x"), (903, "http://h/\r\nX: y\0\ud7ff", "WARC/1.1\r\n\r\n"), (904, "http://h/" + "p" * 9000, "z" * 3_000_000), (905, "http://h/" + "p" * 9000, "z" * 3_000_000)]
    return rows


def slow(rows, least):
    body = {i: (h or "").encode() for i, _, h in rows}
    keeper = {}
    for i, b in body.items():
        if len(b) >= least:
            keeper[b] = max(keeper.get(b, i), i)
    out = []
    for i, b in body.items():
        k = keeper.get(b, i)
        out.append((i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "response" if k == i else "revisit", None if k == i else k))
    return sorted(out)


@pytest.mark.parametrize("least", [0, 9])
def test_round_trip(spark, monkeypatch, least):
    monkeypatch.setattr(wa, "BLOCK_LINES", 16)
    rows = pages()
    df = spark.createDataFrame([(*r, "c", "c") for r in rows], "page_id long, url string, html string, payload string, id string")
    got = sorted(tuple(r) for r in wa.round_trip(df.repartition(5), least=least).collect())
    assert got == slow(rows, least)


def test_odd_tables(spark):
    df = spark.createDataFrame([(1, "u", "a"), (1, "u", "a"), (None, "u", "a"), (2, None, "a")], "page_id long, url string, html string")
    got = sorted(tuple(r)[0::3] for r in wa.round_trip(df).collect())
    assert got == [(1, "revisit"), (1, "revisit"), (2, "response")]
    assert wa.round_trip(df.limit(0)).count() == 0


def test_lookup_by_url_and_damage(spark):
    rows = [(i, "http://same.example.com/x", f"body {i}") for i in range(50)]
    lines, folder, index = wa.archive(spark.createDataFrame(rows, "page_id long, url string, html string"))
    asked = spark.createDataFrame([("com,example,same)/x", 7), ("com,example,same)/y", 7), ("zz", 1), ("", 1)], "url_key string, id long")
    found = wa.lookup(index, asked).collect()
    assert [r["id"] for r in found] == [7]
    store, root = pafs.FileSystem.from_uri(folder)
    with store.open_input_file(f"{root}/{found[0]['file']}") as source:
        source.seek(found[0]["start"])
        data = source.read(found[0]["size"])
    headers, body = wa.parse(data)
    assert body == b"body 7" and headers["WARC-Type"] == "response"
    with pytest.raises(Exception):  # noqa: B017
        wa.parse(data[: len(data) // 2])
    assert wa.url_key("http://User.Example.com:80/a?b#c") == "com,example,user:80)/a?b#c" and wa.url_key(None) == ""
