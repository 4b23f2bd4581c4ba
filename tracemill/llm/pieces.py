"""SentencePiece ids by a prefix table: the last token of every prefix, then ids from the end."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill.llm.common import Emitter, cached, rows_of

#: Stands for a space in normalised text.
SPACE = "▁"
#: Units of text up to this length are remembered, in two generations of so many, and so many answers of the pair test.
UNIT, UNITS, PAIRS = 48, 400_000, 1_000_000
#: A model of more bytes than this is refused: it is sent to every executor.
MODEL_BYTES = 64 << 20


class Coder:
    """Ids of texts under a BPE model with byte fallback, and texts of ids.

    A sequence of tokens is what the merges make of a text just if each two neighbours are what the merges
    make of their own text.  So every prefix has one last token: the piece that ends there, found by an
    automaton over all pieces, and is compatible with the last token of the prefix before it.  The table of
    last tokens is filled from left to right, and the ids are read from its end.  Where no longer piece fits, the
    last token is the last character.

    Text is cut first between characters that are neighbours in no piece, so that units (words, mostly) can be
    remembered.
    """

    def __init__(self, model: bytes):
        import ahocorasick
        import sentencepiece

        self.library = sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        every = range(sp.get_piece_size())
        if any(sp.is_unused(i) for i in every):
            raise ValueError("models with unused pieces are not supported")
        self.byte = {int(sp.id_to_piece(i)[3:5], 16): i for i in every if sp.is_byte(i)}
        if len(self.byte) < 256:
            raise ValueError("the model has no byte fallback")
        own = [i for i in every if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i))]
        self.ids = {sp.id_to_piece(i): i for i in own}
        #: Merges make a piece of two neighbours: the highest score first, the leftmost of equal ones.
        self.score = {p: sp.get_score(i) for p, i in self.ids.items() if len(p) > 1}
        #: Each piece comes with its answers of the pair test, by the token before it.
        self.automaton = ahocorasick.Automaton()
        self.answers: dict[str, dict[str, bool]] = {p: {} for p in self.score}
        for piece, answers in self.answers.items():
            self.automaton.add_word(piece, (len(piece), piece, answers))
        self.automaton.make_automaton()
        # Row and column of a character in the table of neighbours; 0 for one that no longer piece holds.
        inner = sorted({c for p in self.score for c in p})
        self.place = np.zeros(ord(inner[-1]) + 2 if inner else 1, np.int32)
        self.place[[ord(c) for c in inner]] = np.arange(1, len(inner) + 1)
        self.joined = np.zeros((len(inner) + 1, len(inner) + 1), bool)
        for p in self.score:
            at = self.place[[ord(c) for c in p]]
            self.joined[at[:-1], at[1:]] = True
        #: Stands between units whose tables are filled together: no piece holds it.
        self.barrier = next(c for c in map(chr, range(0xE000, 0xF8FF)) if c not in self.ids)
        #: Histories of pieces, at most one per piece or unknown character; how many answers are held; ids of units.
        self.histories: dict[str, list | None] = {}
        self.held = 0
        self.memo: dict[str, tuple[int, ...]] = {}
        self.old: dict[str, tuple[int, ...]] = {}

    def merges(self, text: str) -> tuple[list[tuple[float, str, str]], list[str]]:
        """The merges of a short text, one at a time: score, first and last token after each; and the tokens left."""
        symbols, score, steps = list(text), self.score, []
        while len(symbols) > 1:
            best, at = None, -1
            for i in range(len(symbols) - 1):
                found = score.get(symbols[i] + symbols[i + 1])
                if found is not None and (best is None or found > best):
                    best, at = found, i
            if at < 0:
                break
            symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]
            steps.append((best, symbols[0], symbols[-1]))
        return steps, symbols

    def history(self, token: str) -> list[tuple[float, str, str]] | None:
        """``merges`` of a token; None if they do not make the token of its own text."""
        if token not in self.histories:
            steps, left = self.merges(token)
            self.histories[token] = steps if left == [token] else None
        return self.histories[token]

    def compatible(self, before: str, token: str) -> bool:
        """Whether the merges leave ``token`` whole after ``before`` (nothing, at the start of a unit).

        The merges of both are played in the order of their scores; the two are incompatible if at any time
        the tokens that meet at the cut would merge first: scores as high on its right, or higher than on its left.
        """
        own = self.history(token)
        whole = own is not None and (not before or not self._crossed(before, token, self.history(before), own))
        if self.held >= PAIRS:
            self.held = 0
            for answers in self.answers.values():
                answers.clear()
        self.held += 1
        self.answers[token][before] = whole
        return whole

    def _crossed(self, before: str, token: str, left: list, right: list) -> bool:
        score, none = self.score, float("-inf")
        i, j, last, first = 0, 0, before[-1], token[0]
        cross = score.get(last + first)
        while True:
            a = left[i][0] if i < len(left) else none
            b = right[j][0] if j < len(right) else none
            if cross is not None and cross > a and cross >= b:
                return True
            if a == b == none:
                return False
            if a >= b:
                now, i = left[i][2], i + 1
                if now == last:
                    continue
                last = now
            else:
                now, j = right[j][1], j + 1
                if now == first:
                    continue
                first = now
            cross = score.get(last + first)

    def tokens(self, units: list[str]) -> list[list[str]]:
        """Tokens of each unit: fill one table of last tokens for all, then walk it from the end."""
        text = self.barrier.join(units)
        last = ["", *text]
        at = 0
        for unit in units[:-1]:
            at += len(unit) + 1
            last[at] = ""
        settled = -1
        for end, (length, token, answers) in self.automaton.iter(text):
            if end != settled:
                before = last[end + 1 - length]
                whole = answers.get(before)
                if whole or whole is None and self.compatible(before, token):
                    last[end + 1] = token
                    settled = end
        out, end = [], len(text)
        for unit in reversed(units):
            start, own = end - len(unit), []
            while end > start:
                own.append(last[end])
                end -= len(last[end])
            out.append(own[::-1])
            end -= 1
        return out[::-1]

    def ids_of(self, tokens: list[str]) -> tuple[int, ...]:
        """Ids of tokens; a character that the model does not know has those of its bytes."""
        try:
            return tuple([self.ids[t] for t in tokens])
        except KeyError:
            return tuple(chain.from_iterable([self.ids[t]] if t in self.ids else [self.byte[b] for b in t.encode()] for t in tokens))

    def cut(self, text: str) -> list[str]:
        """Units of normalised text."""
        at = self.place[np.minimum(np.frombuffer(text.encode("utf-32-le"), "<u4"), len(self.place) - 1)]
        edges = np.flatnonzero(~self.joined[at[:-1], at[1:]]) + 1
        edges = [0, *edges.tolist(), len(text)]
        return [text[a:b] for a, b in zip(edges, edges[1:], strict=False)]

    def encode(self, text: str) -> np.ndarray:
        """Ids of a whole text, without begin or end."""
        units = self.cut(self.library.normalize(text))
        found = list(map(self.memo.get, units))
        if None in found:
            new: dict[str, tuple[int, ...] | None] = {u: self.old.get(u) for u, ids in zip(units, found, strict=True) if ids is None}
            novel = [u for u, ids in new.items() if ids is None]
            for unit, own in zip(novel, self.tokens(novel), strict=True):
                new[unit] = self.ids_of(own)
            if len(self.memo) >= UNITS:
                self.old, self.memo = self.memo, {}
            self.memo.update((u, ids) for u, ids in new.items() if len(u) <= UNIT)
            found = [new[u] if ids is None else ids for u, ids in zip(units, found, strict=True)]
        return np.fromiter(chain.from_iterable(found), np.int32)

    def decode(self, ids: np.ndarray) -> str:
        return self.library.decode(ids.tolist())


def encode_texts(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", decoded: bool = True) -> DataFrame:
    """``(id, ids array<int>, decoded)`` per row: ids of the whole text and, if asked for, the text of those ids.

    The model is a BPE model with byte fallback and without user-defined pieces.  Its file is read by the
    driver and sent to the executors.  A null or empty text has no ids and decodes to an empty text.
    Repeated rows and null ids are kept as they are; an empty table gives no row; other columns are ignored.
    """
    with open(model_path, "rb") as file:
        model = file.read(MODEL_BYTES + 1)
    if len(model) > MODEL_BYTES:
        raise ValueError(f"the model has more than {MODEL_BYTES} bytes")
    spark = docs.sparkSession
    shared, key = spark.sparkContext.broadcast(model), ("pieces", hash(model))
    schema = pa.schema([("id", pa.int64()), ("ids", pa.list_(pa.int32())), ("decoded", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]):
        coder = cached(key, lambda: Coder(shared.value))
        out = Emitter(schema)
        for doc, text in rows_of(batches, "id", "text"):
            ids = coder.encode(text or "")
            back = coder.decode(ids) if decoded else None
            yield from out.add((doc, ids, back), ids.nbytes + len(text or ""))
        yield from out.flush()

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "id long, ids array<int>, decoded string")


def decode_ids(rows: DataFrame, model_path: str, id_col: str = "id", ids_col: str = "ids") -> DataFrame:
    """``(id, text)`` per row of ids; null ids give a null text."""
    with open(model_path, "rb") as file:
        model = file.read(MODEL_BYTES + 1)
    if len(model) > MODEL_BYTES:
        raise ValueError(f"the model has more than {MODEL_BYTES} bytes")
    shared, key = rows.sparkSession.sparkContext.broadcast(model), ("pieces", hash(model))
    schema = pa.schema([("id", pa.int64()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]):
        coder = cached(key, lambda: Coder(shared.value))
        out = Emitter(schema)
        for doc, ids in rows_of(batches, "id", "ids"):
            text = None if ids is None else coder.library.decode(ids)
            yield from out.add((doc, text), len(text or ""))
        yield from out.flush()

    slim = rows.select(F.col(id_col).cast("long").alias("id"), F.col(ids_col).cast("array<int>").alias("ids"))
    return slim.mapInArrow(run, "id long, text string")
