import random

import xxhash

from tracemill.llm import url_filter as uf

RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", ""), ("allow", "net", "")]


def slow(url, rules=RULES):
    rest = (url or "").partition("://")[2] if "://" in (url or "") else ""
    end = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:end])
    path = rest[end:]
    path = path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]
    best = None
    for verdict, h, p in rules:
        if (host == h or host.endswith("." + h)) and path.startswith(p) and (best is None or len(h + p) > len(best[0])):
            best = (h + p, verdict)
    return host, path, best[0] if best else None, best[1] if best else "allow"


def urls():
    rng = random.Random(1)
    out = [None, "", "no scheme", "://", "http://", "http://com", "HTTP://WWW.Example.COM/en/x?y#z", "a://b://c/d", "http://x.net?q", "http://example.com.evil/en/", "http://notexample.com/en/", "http://ü.net/es/é"]
    for _ in range(300):
        host = ".".join(rng.choice(["www", "example", "com", "net", "EN", "x"]) for _ in range(rng.randrange(1, 5)))
        out.append(f"http://{host}{rng.choice(['', '/', '/en', '/en/', '/es/q', '/fr/x/y', '?/en/', '#a'])}{rng.choice(['', '?p=/en/', '#t'])}")
    return out + ["http://" + "a." * 3000 + "net/es/" + "p" * 20_000, "http://x.net\n/es/"]


def test_verdicts(spark):
    rows = list(enumerate(urls())) + [(None, "http://a.com/"), (0, None)]
    df = spark.createDataFrame([(*r, "c", "c") for r in rows], "page_id long, url string, host string, rule string")
    got = sorted((tuple(r) for r in uf.judge_urls(df, RULES, "page_id").collect()), key=repr)
    assert got == sorted(((i, *slow(u)) for i, u in rows), key=repr)
    assert uf.judge_urls(df.limit(0), RULES, "page_id").count() == 0
    assert {r["verdict"] for r in uf.judge_urls(df, [], "page_id", otherwise="block").collect()} == {"block"}


def test_collisions_are_told_apart(tmp_path, monkeypatch):
    """With digests of two bits nearly all keys collide; the stored strings still decide."""
    weak = lambda data: xxhash.xxh3_64_intdigest(data) & 3
    monkeypatch.setattr(uf.xxhash, "xxh64_intdigest", weak)
    rules = [("block" if i % 2 else "allow", f"h{i}.org", "/p/") for i in range(200)]
    uf.write_index(str(tmp_path / "rules"), rules)
    index = uf.Index(str(tmp_path / "rules"))
    keys = [f"h{i}.org\0/p/".encode() for i in range(300)]
    assert index.find(keys) == ["block" if i % 2 else "allow" for i in range(200)] + [None] * 100
