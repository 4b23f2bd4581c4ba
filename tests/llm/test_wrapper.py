import numpy as np

from tracemill.llm import wrapper as wr

ARTICLE = (
    '<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><nav><ul><li><a href="/a">Home</a></li></ul></nav>'
    '<!-- x > y --><div class="ad">Buy</div><header>Site</header><article><header><h1>Head&amp;line</h1></header><p><b>First  part<br><p>Second &lt;b&gt;&nbsp;é &#x41;\n end</p>'
    '<ul><li>one<li>two</ul><form><input value="a>b">Sign</form><aside>Side</aside><div id="comments"><p>Nice!</p></div></article>'
    '<div class="cookie-notice">Cookies</div><footer>&copy; me</footer></body></html>'
)


def text_of(source):
    return "\n".join(t for _, t, _ in wr.Page(source).main_blocks())


def test_article():
    assert text_of(ARTICLE) == "Head&line\nFirst part\nSecond <b> é A end\none\ntwo"


def test_broken_markup_ends():
    for source in ("", "<", "<p", "a < b & c", "<p>x</div></p>y", "<!-- open", "<script>never closed", "<a title='x>y", "<p>" * 3000 + "x" + "</p>" * 10, "<div>" * 500 + "deep", '<p class="x>y">z'):
        wr.Page(source).skeleton()
    assert text_of("a < b &amp; c") == "a < b & c"
    assert text_of("<p>x</div></p>y") == "x\ny"
    assert text_of("<div style='display:none'>no</div><p hidden>no</p><p>yes <span class='ad'>no</span> more</p>").replace("\n", " ") == "yes more"


def slow_match(a, b, x=0, y=0):
    """Size of the largest alignment, by plain recursion."""
    if a[x, 1] != b[y, 1]:
        return 0.0
    left, right = ([i for i in range(1, len(t)) if t[i, 0] == p] for t, p in ((a, x), (b, y)))
    table = np.zeros((len(left) + 1, len(right) + 1))
    for i, p in enumerate(left):
        for j, q in enumerate(right):
            score = slow_match(a, b, p, q)
            if score and not (any(a[1:, 0] == p) and any(b[1:, 0] == q)):
                score = 1.0 + 0.5 * (a[p, 2] == b[q, 2] != 0)
            table[i + 1, j + 1] = max(table[i, j + 1], table[i + 1, j], table[i, j] + score)
    return 1.0 + table[-1, -1]


def test_simple_tree_matching():
    rng = np.random.default_rng(3)
    for _ in range(60):
        trees = []
        for _ in range(2):
            n = int(rng.integers(2, 14))
            rows = np.zeros((n, 4), np.int64)
            rows[0, 0] = -1
            for i in range(1, n):
                rows[i, 0] = rng.integers(0, i)
                rows[i, 1] = rng.integers(0, 3)
            leaf = ~np.isin(np.arange(n), rows[:, 0])
            rows[leaf, 2] = rng.integers(1, 4, leaf.sum())
            trees.append(rows)
        a, b = trees
        pairs = wr.match(a, b)
        assert len({p for p, _ in pairs}) == len(pairs) == len({q for _, q in pairs})
        assert all(a[p, 1] == b[q, 1] and a[p, 2] and b[q, 2] for p, q in pairs)
        assert slow_match(a, b) == wr.align(a, b)[0]


def test_long_odd_markup_is_linear():
    import time

    start = time.process_time()
    for source in ("<a " * 60_000, "<div>" * 30_000 + "</x>" * 30_000, "<p>" * 30_000, "<x>" * 20_000 + "<p>" * 20_000, '<a "' * 40_000 + ">", "<!--" * 40_000, "<" * 200_000, "</p>" * 50_000):
        wr.Page(source).skeleton()
    assert time.process_time() - start < 20
    assert text_of("<p>x</p> a < b <a ") == "x\na < b"


def test_deep_pages(spark):
    rows = [(i, f"http://deep.example.com/{i}", "<div>" * 1200 + f"<p>text {i}</p><p>same</p>" + "</div>" * 1200) for i in range(5)]
    got = wr.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert sorted((r["id"], r["text"]) for r in got) == [(i, f"text {i}") for i in range(5)]


def test_links_within_text_and_teasers():
    assert text_of("<p>Read <a>the very long link text of this one</a> now</p><ul><li><a>Home</a></li></ul>") == "Read the very long link text of this one now"
    long = "It was a dark night and the rain fell in torrents on the town."
    assert text_of(f"<article>teaser</article><div><p>{long}</p></div>") == f"teaser\n{long}"
    assert text_of(f'<article><p>{long}</p></article><div class="user-feedback">Great</div><div class="comment-list">x</div><p>Some notice</p>') == long
    assert text_of(f'<p>{long}</p><div class="user-feedback">Great</div><section id="reader-comments">x</section>') == long


def page(i, body):
    return (i, f"http://news.example.com/{i}", f"<html><body><div>Daily Bugle</div><div><ul><li><a href=x>Home</a></li></ul></div><div><h2>Title {i}</h2>{body}</div><div>Contact us today</div></body></html>")


def test_constant_nodes_are_template(spark):
    rows = [page(i, f"<p>Story {i} begins.</p><p>It ends {i * 7}.</p>") for i in range(8)]
    rows += [(100, "http://alone.example.com/", "<div>Only page</div>"), (101, None, "<p>no url</p>"), (102, "http://news.example.com/e", None), (None, "x", "<p>k</p>")]
    rows += [(200 + i, f"http://copies.example.com/{i}", "<div>same</div><p>copy</p>") for i in range(5)]
    rows += [(300 + i, f"http://inner.example.com/{i}", f"<article><h1>N{i}</h1><p>text {i}</p><p>Share this story</p></article>") for i in range(12)]
    df = spark.createDataFrame([(*r, "c", "c") for r in rows], "page_id long, url string, html string, text string, host string")
    got = {r["id"]: (r["text"], r["n_chars"]) for r in wr.extract(df).collect()}
    for i in range(8):
        want = f"Title {i}\nStory {i} begins.\nIt ends {i * 7}."
        assert got[i] == (want, len(want))
    assert got[100][0] == "Only page" and got[101][0] == "no url" and got[102] == ("", 0) and got[None][0] == "k"
    assert all(got[200 + i][0] == "same\ncopy" for i in range(5))
    assert got[303][0] == "N3\ntext 3"
    assert wr.extract(df.limit(0)).count() == 0


def test_layouts_of_a_host_are_learned_apart(spark):
    """An empty page or one of another layout with the smallest id does not cost the host its template."""
    rows = [(0, "http://news.example.com/0", None), (1, "http://news.example.com/1", "<html><body><table><tr><td>Not found</table></body></html>")]
    rows += [page(i, f"<p>Story {i} begins.</p>") for i in range(2, 10)]
    other = "<html><body><section><p>Index of all</p></section><section><p>List {0} of the {1}.</p></section></body></html>"
    rows += [(i, f"http://news.example.com/{i}", other.format(i, i * 3)) for i in range(20, 26)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["id"]: r["text"] for r in wr.extract(df).collect()}
    assert [got[i] for i in range(2, 10)] == [f"Title {i}\nStory {i} begins." for i in range(2, 10)]
    assert [got[i] for i in range(20, 26)] == [f"List {i} of the {i * 3}." for i in range(20, 26)]
    assert got[0] == "" and got[1] == "Not found"


def test_marks_do_not_drop_the_main_text():
    long = "It was a dark night and the rain fell in torrents on the town."
    for mark in ('div class="content has-sidebar"', 'article class="post no-comments"', 'div id="main" class="ad-free"', 'section class="related-work"', 'div class="search-results"', 'div id="search"', 'main class="widget"'):
        tag = mark.split()[0]
        assert text_of(f'<body><div class="ad">Buy now</div><{mark}><h1>Head</h1><p>{long}</p></{tag}><div class="cookie-notice">Cookies</div></body>') == f"Head\n{long}"
    # Marked as a whole, and not most of the page: no main text.
    assert text_of(f'<div class="site sidebar">a b c</div><p>{long}</p><div class="share"><div>x</div></div>') == long
    # Nothing but marked elements, none of which holds most of the text: they are the candidates.
    assert text_of('<div class="comment">one two</div><div class="comment">six ten</div><footer>foot</footer>') == "one two\nsix ten"
