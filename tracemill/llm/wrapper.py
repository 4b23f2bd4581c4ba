"""Main text of web pages by wrapper induction over pages of one host."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill.llm.common import Emitter, materialize, rows_of

#: Elements that do not break a block of text.
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: Elements without an end tag.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is not markup.
RAW = frozenset("script style textarea title noscript iframe noembed noframes xmp".split())
#: Elements that never hold main text.  A ``header`` does so only outside an article.
ASIDE = frozenset("head script style noscript template iframe noembed noframes object svg canvas map nav footer aside form button select option textarea input fieldset dialog menu title".split())
ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
#: Words that make up a class or id that marks boilerplate.
MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar nav navbar navigation menu breadcrumb breadcrumbs footer "
    "cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe share sharing social related recommended comment comments respond reply "
    "replies disqus widget toolbar pagination pager login signup search masthead feedback".split()
)
#: Words that may stand beside those in a class or id.
BESIDE = frozenset("user users reader readers visitor site page top bottom left right section list item items area box block container wrapper inner outer panel thread".split())
#: Elements that no class or id marks.
UNMARKED = frozenset("html body article main".split())
#: An end tag is implied when one of these follows an open element of the kind.
BREAKS_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split()
)
SAME = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}

#: Elements that make the frame of a page; pages of a host with the same paths of these, up to a depth, are one layout.
FRAMES, TOP = frozenset("html body div section main article header footer nav aside table form center frameset".split()), 3
#: A layout of fewer pages is aligned with the most frequent one of its host.
LEAST_PAGES = 3

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>", re.S)
_OPENS = re.compile(r"<[/!?a-zA-Z]")
_NAMES = re.compile(r"(?:^|\s)(class|id|role|style|hidden|aria-hidden)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?", re.I)
_WORD = re.compile(r"[a-z]+")

#: Pages that must share a text at one place before it counts as template: (share, pages), outside and inside an article.
OUTSIDE, INSIDE = (0.5, 3), (0.9, 10)


def _hash(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text) >> 1


def _boiler(tag: str, attributes: str, in_article: bool) -> bool:
    """Whether an element is no part of the main text, by tag, role or being hidden."""
    if tag in ASIDE or tag == "header" and not in_article:
        return True
    if not attributes or "=" not in attributes and "hidden" not in attributes:
        return False
    for name, value in _NAMES.findall(attributes):
        name, value = name.lower(), value.strip("\"'").lower()
        if name == "role" and value in ROLES or name == "hidden" or name == "aria-hidden" and value == "true":
            return True
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return True
    return False


def _marked(tag: str, attributes: str) -> bool:
    """Whether a class or id marks an element: a whole one that is made of ``MARKS`` and words beside them only."""
    if not attributes or tag in UNMARKED or "=" not in attributes:
        return False
    for name, value in _NAMES.findall(attributes):
        if name.lower() in ("class", "id"):
            for token in value.strip("\"'").lower().split():
                words = _WORD.findall(token)
                if any(w in MARKS for w in words) and all(w in MARKS or w in BESIDE for w in words):
                    return True
    return False


class Page:
    """Block-level tree of a page: parent, label and text hash of each node, and its blocks of text."""

    def __init__(self, source: str):
        self.parent: list[int] = [-1]
        self.label: list[str] = [""]
        self.chain: list[int] = [0]  # hash of the tags from the root
        self.frames: list[str | None] = [""]  # those tags, near the root and while all are frames
        self.blocks: list[tuple[int, str, bool, bool, bool]] = []  # node, text, boilerplate, in article, nothing but links
        self.by_mark: list[int] = []  # places of blocks that are boilerplate by a class or id only
        self._stack: list[list] = [["", 0, False, False, -1]]  # tag, node, boilerplate, in article, innermost mark
        self._marks: list[list[int]] = []  # of each marked element the mark around it and the length of its text
        self._at: list[int] = []  # innermost mark of each block
        self._text: list[str] = []
        self._open: dict[str, int] = {}  # how often each tag is on the stack
        self._linked = 0
        self._link = self._plain = False  # whether the block so far has words inside and outside of links
        self._read(source)

    def _read(self, source: str) -> None:
        at = 0
        # A tag needs its end; what looks like one behind the last end is no text either.
        size = source.rfind(">") + 1
        if source.startswith("<!--") or "<!--" in source[size:]:
            size = len(source)
        tail = source[size:]
        cut = _OPENS.search(tail)
        tail = tail[: cut.start()] if cut else tail
        while at < size:
            found = _TOKEN.search(source, at, size)
            if found is None:
                self._add(source[at:size])
                break
            if found.start() > at:
                self._add(source[at : found.start()])
            at = found.end()
            tag = found.group(2) or found.group(5)
            if not tag:
                continue
            tag, end = tag.lower(), found.group(1) or found.group(4)
            if end:
                self._end(tag)
                continue
            attributes = found.group(3) or found.group(6) or ""
            if tag in RAW:
                close = re.compile(f"</{tag}", re.I).search(source, at)
                if close is None:
                    tail = ""
                at = close.start() if close else size
                continue
            self._start(tag, attributes)
        self._add(tail)
        self._flush()
        self._settle()

    def _settle(self) -> None:
        """Take blocks of marked elements as boilerplate, except of those that hold most of the page's text."""
        total = sum(len(b[1]) for b in self.blocks if not b[2])
        for (_, text, boiler, *_), mark in zip(self.blocks, self._at, strict=True):
            if mark >= 0 and not boiler:
                self._marks[mark][1] += len(text)
        for above, own in reversed(self._marks):  # marks around come first
            if above >= 0:
                self._marks[above][1] += own
        dropped: list[bool] = []
        for above, own in self._marks:
            dropped.append(2 * own <= total or above >= 0 and dropped[above])
        for i, mark in enumerate(self._at):
            if mark >= 0 and dropped[mark] and not self.blocks[i][2]:
                node, text, _, inside, links = self.blocks[i]
                self.blocks[i] = (node, text, True, inside, links)
                self.by_mark.append(i)

    def _mark(self, tag: str, attributes: str, above: int) -> int:
        """The innermost mark within an element."""
        if not _marked(tag, attributes):
            return above
        self._marks.append([above, 0])
        return len(self._marks) - 1

    def _add(self, text: str) -> None:
        self._text.append(text)
        if re.search(r"\w", text):
            self._link, self._plain = self._link or bool(self._linked), self._plain or not self._linked

    def _flush(self) -> None:
        if not self._text:
            return
        raw = "".join(self._text)
        links = self._link and not self._plain
        self._text, self._link, self._plain = [], False, False
        text = " ".join((html.unescape(raw) if "&" in raw else raw).split())
        if text:
            _, node, boiler, inside, mark = self._stack[-1]
            self.parent.append(node)
            self.label.append("#")
            self.chain.append(self.chain[node])
            self.frames.append(None)
            self.blocks.append((len(self.parent) - 1, text, boiler, inside, links))
            self._at.append(mark)

    def _start(self, tag: str, attributes: str) -> None:
        if tag in INLINE:
            if tag == "br":
                self._text.append(" ")
            elif tag == "a":
                self._linked = 1
            top = self._stack[-1]
            if attributes and not top[2] and tag not in VOID:
                boiler, mark = _boiler(tag, attributes, top[3]), self._mark(tag, attributes, top[4])
                if boiler or mark != top[4]:
                    self._flush()
                    self._push([tag, top[1], boiler, top[3], mark])
            return
        self._flush()
        self._linked = 0
        if tag in BREAKS_P:
            self._close(("p",), ("table", "td", "th", "article", "section", "div", "body"))
        if tag in SAME:
            self._close(SAME[tag], ("ul", "ol", "dl", "table", "select") if tag != "tr" else ("table",))
        if tag in VOID:
            return
        _, parent, boiler, inside, mark = self._stack[-1]
        boiler = boiler or _boiler(tag, attributes, inside)
        inside = not boiler and (inside or tag in ("article", "main") or "main" in attributes and bool(re.search(r"role\s*=\s*[\"']?main\b", attributes, re.I)))
        self.parent.append(parent)
        self.label.append(tag)
        above = self.frames[parent]
        self.chain.append(_hash(f"{self.chain[parent]}/{tag}"))
        self.frames.append(f"{above}/{tag}" if above is not None and tag in FRAMES and above.count("/") < TOP else None)
        self._push([tag, len(self.parent) - 1, boiler, inside, self._mark(tag, attributes, mark)])

    def _push(self, entry: list) -> None:
        self._stack.append(entry)
        self._open[entry[0]] = self._open.get(entry[0], 0) + 1

    def _drop(self, start: int) -> None:
        for entry in self._stack[start:]:
            self._open[entry[0]] -= 1
        del self._stack[start:]

    def _close(self, tags: tuple, stops: tuple) -> None:
        if not any(self._open.get(t) for t in tags):
            return
        for i in range(len(self._stack) - 1, 0, -1):
            if self._stack[i][0] in tags:
                self._drop(i)
                return
            if self._stack[i][0] in stops:
                return

    def _end(self, tag: str) -> None:
        if tag in INLINE:
            if tag == "a":
                self._linked = 0
            if self._stack[-1][0] == tag:
                self._flush()
                self._drop(len(self._stack) - 1)
            return
        self._flush()
        self._linked = 0
        if not self._open.get(tag):
            return
        for i in range(len(self._stack) - 1, 0, -1):
            if self._stack[i][0] == tag:
                self._drop(i)
                return

    def skeleton(self) -> np.ndarray:
        """Rows (parent, label, text hash, place): what alignment needs.  ``place`` hashes tag path and text together.

        An element that holds nothing but one run of text is a leaf with that text.
        """
        n = len(self.parent)
        kids = np.bincount(np.array(self.parent[1:], np.int64), minlength=n)
        texts = {node: text for node, text, *_ in self.blocks}
        fold = {i: self.parent[i] for i in texts if kids[self.parent[i]] == 1 and self.parent[i]}
        owner = {fold.get(i, i): (i, t) for i, t in texts.items()}
        keep = [i for i in range(n) if i not in fold]
        index = {i: k for k, i in enumerate(keep)}
        seen: dict[str, int] = {}
        rows = np.zeros((len(keep), 4), np.int64)
        for k, i in enumerate(keep):
            tag = self.label[i]
            rows[k, 0] = index[self.parent[i]] if i else -1
            rows[k, 1] = seen[tag] if tag in seen else seen.setdefault(tag, _hash(tag))
            if i in owner:
                node, text = owner[i]
                rows[k, 2], rows[k, 3] = _hash(text), self.place(node, text)
        return rows

    def layout(self) -> int:
        """Hash of the paths of frames near the root, without what articles are made of."""
        return _hash("\n".join(sorted({f for f in self.frames if f is not None})))

    def place(self, node: int, text: str) -> int:
        return _hash(f"{self.chain[node]}\n{text}")

    def main_blocks(self) -> list[tuple[int, str, bool]]:
        """``(node, text, in article)`` of what may be main text: all but boilerplate and blocks that are nothing but links.

        Articles stand for the page unless the text outside is more than ten times as long: those are teasers.  If there is no
        such text, what only a class or id marks may be main text.
        """
        inside = [(n, t, True) for n, t, boiler, article, _ in self.blocks if article and not boiler]
        plain = [(n, t, article) for n, t, boiler, article, links in self.blocks if not boiler and not links]
        outside = sum(len(t) for _, t, article in plain if not article)
        if inside and 10 * sum(len(t) for _, t, _ in inside) >= outside:
            return inside
        return [(n, t, False) for n, t, _ in plain] or self.marked_blocks()

    def marked_blocks(self) -> list[tuple[int, str, bool]]:
        """Blocks in page order that are boilerplate by a class or id only, without link lists."""
        return [(n, t, False) for n, t, _, _, links in (self.blocks[i] for i in self.by_mark) if not links]


def align(a: np.ndarray, b: np.ndarray) -> tuple[float, list[tuple[int, int]]]:
    """Simple tree matching of two skeletons: the score of the roots, and the aligned nodes below them.

    Roots match if their labels do; the children of matched nodes are aligned in order so that the number of
    matched nodes below is largest (equal texts count a little more).  Pairs of nodes wait on a stack until those below
    them are solved, so depth is no limit.
    """
    if a[0, 1] != b[0, 1]:
        return 0.0, []
    below = []
    for rows in (a, b):
        own: list[list[int]] = [[] for _ in range(len(rows))]
        for i, p in enumerate(rows[1:, 0].tolist(), 1):
            own[p].append(i)
        below.append(own)
    kids_a, kids_b = below
    known: dict[tuple[int, int], tuple[float, list]] = {}
    scores: dict[tuple[int, int], tuple[np.ndarray, list]] = {}
    waiting = [(0, 0)]
    while waiting:
        x, y = waiting[-1]
        left, right = kids_a[x], kids_b[y]
        if (x, y) in known or not left or not right:
            known.setdefault((x, y), (1.0, []))
            waiting.pop()
            continue
        if (x, y) not in scores:
            score = (a[left, 1][:, None] == b[right, 1]) * (1.0 + 0.5 * ((a[left, 2][:, None] == b[right, 2]) & (a[left, 2][:, None] != 0)))
            inner = [(i, j) for i, j in zip(*map(np.ndarray.tolist, np.nonzero(score)), strict=True) if kids_a[left[i]] and kids_b[right[j]]]
            scores[x, y] = score, inner
            waiting += [p for p in ((left[i], right[j]) for i, j in inner) if p not in known]
            continue
        score, inner = scores.pop((x, y))
        for i, j in inner:
            score[i, j] = known[left[i], right[j]][0]
        table = np.zeros((len(left) + 1, len(right) + 1))
        for i in range(len(left)):
            table[i + 1, 1:] = np.maximum.accumulate(np.maximum(table[i, 1:], table[i, :-1] + score[i]))
        pairs, i, j = [], len(left), len(right)
        while i and j:
            if table[i, j] == table[i - 1, j]:
                i -= 1
            elif table[i, j] == table[i, j - 1]:
                j -= 1
            else:
                i, j = i - 1, j - 1
                pairs.append((left[i], right[j]))
        known[x, y] = 1.0 + float(table[-1, -1]), pairs
        waiting.pop()
    score, out = known[0, 0][0], []
    todo = list(known[0, 0][1])
    while todo:
        pair = todo.pop()
        out.append(pair)
        todo += known.get(pair, (0.0, []))[1]
    return score, out


def match(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Aligned text nodes of two skeletons."""
    return [(p, q) for p, q in align(a, b)[1] if a[p, 2] and b[q, 2]]


def _parsed(pages: DataFrame) -> DataFrame:
    """``(id, url, host, print, layout, nodes, skeleton, inside, texts, places)`` of every page."""
    schema = pa.schema(
        [("id", pa.int64()), ("url", pa.string()), ("host", pa.string()), ("print", pa.int64()), ("layout", pa.int64()), ("nodes", pa.int64()), ("skeleton", pa.binary())]
        + [("inside", pa.bool_()), ("texts", pa.list_(pa.string())), ("places", pa.list_(pa.int64()))]
    )

    def run(batches: Iterator[pa.RecordBatch]):
        out = Emitter(schema)
        for key, url, host, source in rows_of(batches, "id", "url", "host", "html"):
            page = Page(source or "")
            blocks = page.main_blocks()
            places = [page.place(n, t) for n, t, _ in blocks]
            mark = _hash("\n".join(t for _, t, _ in blocks))
            inside = bool(blocks) and blocks[0][2]
            skeleton = page.skeleton()
            yield from out.add((key, url, host, mark, page.layout(), len(skeleton), skeleton.tobytes(), inside, [t for _, t, _ in blocks], places), len(source or ""))
        yield from out.flush()

    names = "id long, url string, host string, print long, layout long, nodes long, skeleton binary, inside boolean, texts array<string>, places array<long>"
    return pages.mapInArrow(run, names)


def templates(parsed: DataFrame) -> DataFrame:
    """``(host, outer, inner)``: places with text that are template on a host, for blocks outside and inside an article.

    Each distinct page is aligned with one page of its host and layout, the one of the median number of nodes;
    pages without a node are left out.  A text that enough of the pages aligned at a node share is template; nodes
    where texts vary are content.  Counts add up over tasks, so a host with very many pages is aligned in many.
    """
    pages = parsed.select("host", "print", "id", "layout", "nodes", "skeleton").filter("host <> '' AND nodes > 1")
    groups = pages.groupBy("host", "layout").agg(F.count("*").alias("all"), F.percentile_approx("nodes", 0.5).alias("usual"))
    first = F.max(F.struct("all", "layout"))
    hosts = groups.groupBy("host").agg(F.sum("all").alias("total"), first["layout"].alias("main")).filter("total > 2")
    groups = groups.join(hosts, "host").withColumn("group", F.when(F.col("all") >= LEAST_PAGES, F.col("layout")).otherwise(F.col("main")))
    groups = materialize(groups.select("host", "layout", "group", "usual"), "layouts")
    # The page nearest to the usual size of each layout that others are aligned with.
    near = F.struct(F.abs(F.col("nodes") - F.col("usual")), "id", "print", "skeleton")
    model = pages.join(groups.filter("group = layout"), ["host", "layout"]).groupBy("host", "group").agg(F.min(near)["skeleton"].alias("model"))
    model = materialize(model, "models")
    pairs = pages.join(groups.select("host", "layout", "group"), ["host", "layout"]).join(model, ["host", "group"])
    schema = pa.schema([("host", pa.string()), ("group", pa.int64()), ("print", pa.int64()), ("slot", pa.int64()), ("place", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]):
        out = Emitter(schema, rows=16384)
        for host, group, mark, skeleton, model_ in rows_of(batches, "host", "group", "print", "skeleton", "model"):
            a, b = (np.frombuffer(x, np.int64).reshape(-1, 4) for x in (skeleton, model_))
            for p, q in match(a, b):
                yield from out.add((host, group, mark, q, int(a[p, 3])))
        yield from out.flush()

    aligned = pairs.select("host", "group", "print", "skeleton", "model").mapInArrow(run, "host string, group long, print long, slot long, place long")
    # Copies of one article count once.
    counts = aligned.distinct().groupBy("host", "group", "slot", "place").agg(F.count("*").alias("n"))
    slots = counts.groupBy("host", "group", "slot").agg(F.sum("n").alias("pages"), F.max(F.struct("n", "place")).alias("top"))
    share = F.col("top.n") / F.col("pages")
    outer = (share >= OUTSIDE[0]) & (F.col("top.n") >= OUTSIDE[1])
    inner = (share >= INSIDE[0]) & (F.col("top.n") >= INSIDE[1])
    place = F.col("top.place")
    # At most one place per node of the host's model pages.
    return slots.filter(outer).groupBy("host").agg(F.collect_set(place).alias("outer"), F.collect_set(F.when(inner, place)).alias("inner"))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``(id, url, text, n_chars)`` per page: blocks of main text in page order, joined by a line feed.

    Inside an article (or ``main``) all blocks but marked boilerplate are main text; pages without one, or with little
    more than teasers in it, give all blocks that are no marked boilerplate and hold words outside of links.  Then blocks go that are template on the host;
    should none remain the page keeps them, as pages that agree in everything are copies and no template.

    Null or empty html: empty text.  Null URLs and hosts with fewer than three pages have no template.  Rows
    repeat as they are; null ids are carried through; an empty table gives no row.
    """
    host = F.lower(F.regexp_extract(F.coalesce(F.col(url_col), F.lit("")), r"(?s)^.*?://([^/?#]*)", 1))
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), host.alias("host"), F.col(html_col).alias("html"))
    parsed = materialize(_parsed(rows), "parsed")
    known = materialize(templates(parsed), "templates")
    joined = parsed.select("id", "url", "host", "inside", "texts", "places").join(known, "host", "left")
    drop = F.coalesce(F.when(F.col("inside"), F.col("inner")).otherwise(F.col("outer")), F.array().cast("array<bigint>"))
    kept = F.filter(F.arrays_zip("texts", "places"), lambda x: ~F.array_contains(drop, x["places"]))
    kept = F.transform(kept, lambda x: x["texts"])
    text = F.array_join(F.when(F.size(kept) > 0, kept).otherwise(F.col("texts")), "\n")
    return joined.select("id", "url", text.alias("text")).withColumn("n_chars", F.length("text").cast("long"))
