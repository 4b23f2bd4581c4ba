"""Hierarchical multi-length packing of token pieces."""

from __future__ import annotations

import base64
import json
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracemill.llm.common import Emitter, cached, materialize, rows_of

#: Context sizes; a piece belongs to the smallest tier that holds it.
TIERS = (256, 512, 1024, 2048)
#: Tokens of one training step; a step group holds sequences of one tier.
STEP_TOKENS = 1 << 16
#: A window with a gap of at most this share counts as full.
SLACK = 1 / 256
#: Pieces of one length are ranked in so many parts, which bounds the rows of one ranking window.
PARTS = 1024


def coder(path: str):
    """The byte-level BPE of a tokenizer file (``.json``) or of a rank file.

    A tokenizer file gives the added tokens, which are matched in plain text as ``tokenizers`` does; its merges
    are read from the rank file beside it.  A rank file alone has no added tokens.
    """
    import public_tokenizers
    import tiktoken

    added = {}
    if path.endswith(".json"):
        with open(path, encoding="utf-8") as file:
            for token in json.load(file)["added_tokens"]:
                if token["single_word"] or token["lstrip"] or token["rstrip"]:
                    raise ValueError(f"added token {token['content']!r} is matched with its surroundings")
                added[token["content"]] = token["id"]
        path = path.removesuffix(".json") + ".tiktoken"
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=added)


def slow_coder(path: str):
    """The tokenizer file itself, for texts that ``coder`` refuses: its pattern cannot hold a million spaces in a row."""
    from tokenizers import Tokenizer

    bpe = Tokenizer.from_file(path.removesuffix(".tiktoken") + ".json" if path.endswith(".tiktoken") else path)
    bpe.encode_special_tokens = path.endswith(".tiktoken")
    return bpe


def token_ids(text: str | None, path: str, end_id: int) -> np.ndarray:
    """Ids of a text (null: none) and ``end_id`` as little-endian unsigned 32-bit numbers."""
    bpe = cached(("bpe", path), lambda: coder(path))
    try:
        ids = bpe.encode(text or "", allowed_special="all")
    except ValueError:
        ids = cached(("slow bpe", path), lambda: slow_coder(path)).encode(text, add_special_tokens=False).ids
    return np.array([*ids, end_id], "<u4")


def parts_of(length: int, tiers: tuple[int, ...] = TIERS) -> list[int]:
    """Cuts of a piece that does not fit whole: context sizes from the largest down, then the tail."""
    out = []
    for tier in reversed(tiers):
        while length >= tier:
            out.append(tier)
            length -= tier
    return out + [length] * (length > 0)


def pieces(docs: DataFrame, bpe_path: str, end_id: int, tiers: tuple[int, ...] = TIERS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, start, length, crcs, doc_tokens)``: each document cut at multiples of the largest tier.

    ``crcs`` holds the CRC-32 of the piece's ids and then those of its ``parts_of``.
    """
    schema = pa.schema(
        [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("crcs", pa.list_(pa.int64())), ("doc_tokens", pa.int64())]
    )

    def run(batches: Iterator[pa.RecordBatch]):
        out = Emitter(schema)
        for key, text in rows_of(batches, "id", "text"):
            ids = token_ids(text, bpe_path, end_id)
            for start in range(0, len(ids), tiers[-1]):
                piece = ids[start : start + tiers[-1]]
                edges = np.cumsum([0, *parts_of(len(piece), tiers)])
                crcs = [zlib.crc32(piece)] + [zlib.crc32(piece[a:b]) for a, b in zip(edges, edges[1:], strict=False)]
                yield from out.add((key, start, len(piece), crcs, len(ids)))
        yield from out.flush()

    names = "doc_id long, start long, length long, crcs array<long>, doc_tokens long"
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, names)


class _Stock:
    """Unplaced pieces by length: takes the next ranks of a length, finds the longest that fits."""

    def __init__(self, counts: dict):
        self.left = {k: c for k, c in counts.items() if c}
        self.next = dict.fromkeys(self.left, 0)
        self.order = sorted(self.left)

    def longest(self, room: int):
        at = bisect_right(self.order, room)
        return self.order[at - 1] if at else None

    def take(self, length: int, count: int) -> int:
        first = self.next[length]
        self.next[length] += count
        self.left[length] -= count
        if not self.left[length]:
            self.order.remove(length)
        return first


def _fill(stock: _Stock, window: int, length: int) -> list[tuple[list[tuple], int, int]]:
    """Windows opened by all pieces of ``length``, gaps filled with the longest pieces that fit.

    Windows of equal content are one class ``(placed, fill, count)``, placed being ``(length, first rank,
    offset)``; a class splits when a length runs out.
    """
    count = stock.left[length]
    # Windows that would take pieces of their own length open only as many as that leaves.
    count = -(-count // (window // length))
    open_, full = [([(length, stock.take(length, count), 0)], length, count)], []
    while open_:
        placed, used, count = open_.pop()
        best = stock.longest(window - used)
        if best is None:
            full.append((placed, used, count))
            continue
        take = min(count, stock.left[best])
        if take < count:
            open_.append(([(n, first + take, at) for n, first, at in placed], used, count - take))
        open_.append((placed + [(best, stock.take(best, take), used)], used + best, take))
    return full


def layout(histogram: dict[int, int], tiers: tuple[int, ...] = TIERS, slack: float = SLACK) -> list[dict]:
    """Plan of all sequences from a histogram of piece lengths.

    1. From the longest tier down, the pieces of a tier open windows of its size and their gaps are filled
       with the longest shorter pieces that fit.  Windows that are full, or nearly so in the largest tier,
       are settled.
    2. Pieces of other windows are cut into ``parts_of``: parts of a tier's size are sequences of that
       tier, and the tails share windows of the largest tier.

    Rows say that the pieces of ``length`` with ranks ``first .. first + count - 1`` (``part`` -1: whole,
    else that part) go to sequences ``sequence + rank - first`` at ``offset``.  The work and the number of
    rows depend on the number of distinct lengths, at most the largest tier, not on the number of pieces.
    """
    settled, spare = [], []
    stock = _Stock(histogram)
    for window in reversed(tiers):
        low = max((t for t in tiers if t < window), default=0)
        for length in [n for n in reversed(stock.order) if low < n <= window]:
            while stock.left[length]:
                for placed, used, count in _fill(stock, window, length):
                    whole = [(n, -1, first, at) for n, first, at in placed]
                    if used == window or window == tiers[-1] and window - used <= slack * window:
                        settled.append((whole, used, window, count))
                    else:
                        spare += [(n, first, count) for n, _, first, _ in whole]
    tails: dict[tuple, int] = {}
    for n, first, count in spare:
        edges = parts_of(n, tiers)
        for i, size in enumerate(edges):
            if size in tiers:
                settled.append(([(n, i, first, 0)], size, size, count))
            else:
                tails[(size, n, i, first)] = count
    settled += _tails(tails, tiers[-1])
    return _numbered(settled, tiers)


def _tails(tails: dict[tuple, int], window: int) -> list[tuple]:
    """Tails in windows of the largest tier; spans of equal size are one stock."""
    spans: dict[int, list] = {}
    for (size, n, part, first), count in sorted(tails.items()):
        spans.setdefault(size, []).append((n, part, first, count))
    stock = _Stock({size: sum(s[3] for s in own) for size, own in spans.items()})
    classes = []
    while stock.order:
        classes += _fill(stock, window, stock.order[-1])
    out = []
    for placed, used, count in classes:
        # A class may run over several spans of a size: cut it where one ends.
        cuts = {0, count}
        at_ranks = []
        for size, rank, offset in placed:
            start, own = 0, []
            for n, part, first, many in spans[size]:
                lo, hi = max(rank, start), min(rank + count, start + many)
                if lo < hi:
                    own.append((lo - rank, hi - rank, n, part, first + lo - start))
                    cuts |= {lo - rank, hi - rank}
                start += many
            at_ranks.append((offset, own))
        edges = sorted(cuts)
        for a, b in zip(edges, edges[1:], strict=False):
            rows = []
            for offset, own in at_ranks:
                lo, _, n, part, first = next(x for x in own if x[0] <= a < x[1])
                rows.append((n, part, first + a - lo, offset))
            out.append((rows, used, window, b - a))
    return out


def _numbered(settled: list[tuple], tiers: tuple[int, ...]) -> list[dict]:
    """Sequence numbers and step groups: by tier, and within it in the order of attention cost.

    Sequences of a tier are dealt to its step groups in turn, so each group gets the same number (give or
    take one) of every cost.
    """
    rows, sequence, group = [], 0, 0
    for tier in tiers:
        own = [s for s in settled if s[2] == tier]
        own.sort(key=lambda s: (sum(_size(n, part, tiers) ** 2 for n, part, _, _ in s[0]), s[0]))
        total = sum(s[3] for s in own)
        groups = max(1, -(-total * tier // STEP_TOKENS))
        index = 0
        for placed, used, _, count in own:
            for n, part, first, offset in placed:
                rows.append(
                    {"length": n, "part": part, "first": first, "count": count, "sequence": sequence, "offset": offset}
                    | {"tier": tier, "index": index, "groups": groups, "group": group, "used": used}
                )
            sequence += count
            index += count
        group += groups * (total > 0)
    return rows


def _size(n: int, part: int, tiers: tuple[int, ...]) -> int:
    return n if part < 0 else parts_of(n, tiers)[part]


def pack(rows: DataFrame, tiers: tuple[int, ...] = TIERS) -> DataFrame:
    """Place ``pieces`` rows: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, tier, step_group``.

    Only the histogram of lengths (at most the largest tier's number of rows) reaches the driver.  A piece
    finds its place by its rank among pieces of equal length; ranks come from counts per (length, part) and
    row numbers within, so a length that most pieces share is ranked in many tasks.  The same rows give
    the same result in any partitioning.
    """
    rows = materialize(rows.withColumn("_part", F.pmod(F.xxhash64("doc_id", "start"), F.lit(PARTS))), "pieces")
    counts = materialize(rows.groupBy("length", "_part").count(), "lengths")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("count").alias("n")).collect()}
    plan = layout(histogram, tiers)
    before = Window.partitionBy("length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("length", "_part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_before"))
    number = F.row_number().over(Window.partitionBy("length", "_part").orderBy("doc_id", "start"))
    ranked = rows.withColumn("_number", number).join(counts, ["length", "_part"]).withColumn("rank", F.col("_before") + F.col("_number") - 1)

    by_length: dict[int, list[dict]] = {}
    for row in plan:
        by_length.setdefault(row["length"], []).append(row)
    tables = {}
    for n, own in by_length.items():
        for part in {r["part"] for r in own}:
            mine = sorted((r for r in own if r["part"] == part), key=lambda r: r["first"])
            tables.setdefault(n, {})[part] = (
                {k: np.array([r[k] for r in mine]) for k in ("first", "count", "sequence", "offset", "tier", "index", "groups", "group")}
            )
    edges = {n: np.cumsum([0, *parts_of(n, tiers)]) for n in by_length}
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "tier", "step_group"]
    schema = pa.schema([(n, pa.int64()) for n in names])

    def run(batches: Iterator[pa.RecordBatch]):
        out = Emitter(schema, rows=16384)
        for key, start, length, crcs, total, rank in rows_of(batches, "doc_id", "start", "length", "crcs", "doc_tokens", "rank"):
            for part, t in tables[length].items():
                i = int(np.searchsorted(t["first"], rank, "right")) - 1
                if i < 0 or rank >= t["first"][i] + t["count"][i]:
                    continue
                step = rank - int(t["first"][i])
                at, size = (start, length) if part < 0 else (start + int(edges[length][part]), int(edges[length][part + 1] - edges[length][part]))
                group = int(t["group"][i]) + (int(t["index"][i]) + step) % int(t["groups"][i])
                place = (int(t["sequence"][i]) + step, int(t["offset"][i]), int(t["tier"][i]), group)
                yield from out.add((key, at, size, crcs[part + 1], total, *place))
        yield from out.flush()

    slim = ranked.select("doc_id", "start", "length", "crcs", "doc_tokens", "rank")
    return slim.mapInArrow(run, ", ".join(f"{n} long" for n in names))


def pack_documents(docs: DataFrame, bpe_path: str, end_id: int, tiers: tuple[int, ...] = TIERS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pack all rows of ``docs``: see ``pieces`` and ``pack``.

    A null or empty text is its end id alone.  A repeated row is packed as often as it occurs; a null id is
    carried through.  An empty table gives no row.  Other columns are ignored.
    """
    return pack(pieces(docs, bpe_path, end_id, tiers, id_col, text_col), tiers)


def with_ids(packed: DataFrame, docs: DataFrame, bpe_path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``packed`` with the token ids of each piece as ``ids array<int>``, for writing training shards."""
    spans = packed.groupBy("doc_id").agg(F.collect_list(F.struct("start", "length", "sequence_id", "offset")).alias("spans"))
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).dropDuplicates(["doc_id"])
    schema = pa.schema([("doc_id", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("ids", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]):
        out = Emitter(schema)
        for key, text, own in rows_of(batches, "doc_id", "text", "spans"):
            ids = token_ids(text, bpe_path, end_id)
            for s in own:
                cut = ids[s["start"] : s["start"] + s["length"]]
                yield from out.add((key, s["sequence_id"], s["offset"], cut.astype(np.int32)), cut.nbytes)
        yield from out.flush()

    return spans.join(texts, "doc_id").select("doc_id", "text", "spans").mapInArrow(run, "doc_id long, sequence_id long, offset long, ids array<int>")
