import random
import re
from collections import Counter

from tests.llm.util import ODD_TEXTS, empty_documents, odd_documents
from tracemill.llm import quality as ql


def slow(text):
    """Base measures straight from their definition."""
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = {j for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines), len(lines) - len(set(lines)), len(covered)


def test_measures():
    rng = random.Random(1)
    texts = [t for t in ODD_TEXTS if t is None or len(t) < 10_000]
    for _ in range(200):
        words = [rng.choice("a b c dé # <x>| \U0001f600".split()) for _ in range(rng.randrange(120))]
        texts.append("".join(w + rng.choice([" ", "\n", "\t", "\n\n", " ", "\x1c"]) for w in words))
    for text in texts:
        assert ql.measure(text.encode() if text is not None else None) == slow(text)


def clean(rng, n):
    return " ".join("x" * rng.randrange(3, 8) + str(rng.randrange(10**6)) for _ in range(n))


def test_verdicts_match_a_slow_version(spark):
    """Fences from exact quartiles of small whole numbers; small groups borrow from their parents."""
    rng = random.Random(2)
    rows = []
    for i in range(1500):
        lang, source = ("en", f"s{i % 3}") if i % 5 else ("de", f"t{i % 40}")
        text = clean(rng, rng.randrange(15, 90))
        if i % 17 == 0:
            text = re.sub(" ", "%%% ", text)
        if i % 23 == 0:
            text = "\n".join(["same line here again"] * 6 + [text])
        rows.append((i, text, lang if i % 31 else None, source))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = {r["id"]: r for r in ql.judge(df).collect()}
    facts = {}
    for i, text, lang, source in rows:
        n, chars, symbols, lines, dup, repeated = slow(text)
        values = {"word_length": 100 * chars // max(n, 1), "symbol_share": 1000 * symbols // max(chars, 1), "line_share": 1000 * dup // max(lines, 1), "repeat_share": 1000 * repeated // max(n, 1)}
        facts[i] = (lang, source, n < 20 or 100 * repeated > 30 * n, values)

    def group(keys):
        return [f for f in facts.values() if f[: len(keys)] == keys and not f[2]]

    def quartile(own, name, share):
        values = sorted(v[3][name] - (v[3][name] % 2 ** max(0, v[3][name].bit_length() - ql.BITS)) for v in own)
        return next(v for n, v in enumerate(values, 1) if n >= share * len(values))

    fences = {}
    for i, (lang, source, failed, values) in facts.items():
        if (lang, source) not in fences:
            own = next(g for keys in ((lang, source), (lang,), ()) if len(g := group(keys)) >= (ql.LEAST_ROWS if keys else 0))
            fence = {}
            for name, least in ql.LEAST_DISTANCE.items():
                q1, q3 = quartile(own, name, 0.25), quartile(own, name, 0.75)
                reach = max(least, ql.FENCE * (q3 - q1))
                fence[name] = (q1 - reach if name in ql.TWO_SIDED else None, q3 + reach)
            fences[lang, source] = fence
        fence = fences[lang, source]
        bad = [s for s, v in values.items() if v > fence[s][1] or fence[s][0] is not None and v < fence[s][0]]
        assert got[i]["base_failed"] == failed
        assert got[i]["kept"] == (not failed and not bad), (i, bad, got[i])
        if not failed:
            assert sorted(got[i]["reasons"]) == sorted(bad)
    assert 50 < sum(not r["kept"] for r in got.values()) < 400


def test_odd_rows(spark):
    docs = odd_documents(spark)
    out = ql.judge(docs).collect()
    assert len(out) == docs.count() and all(r["base_failed"] and not r["kept"] for r in out if r["id"] in (None, 0, 1, 2, 3, 5))
    kept = ql.keep_good(docs)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {6}
    assert ql.judge(empty_documents(spark)).count() == 0
