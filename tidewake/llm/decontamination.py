"""Benchmark decontamination by pigeonhole edit matching (operator 2).

A test item of n words may be met with ``errors`` edits (a share of n, rounded
down). It is split into ``errors + 1`` pieces: whatever the edits, one piece
is left untouched, so exact hits of pieces find every candidate. Each is
verified with Myers' bit-parallel edit distance, over words, between the item
and the text around the hit.

Items are a bounded broadcast: they are taken in blocks of at most
``BLOCK_BYTES`` of text, and every block passes over all documents, which stay
where they are. Several blocks run one after the other, each written and
released before the next is sent out.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewake.llm.common import cut, discard, ship, table

ERRORS = 0.15
BLOCK_BYTES = 16 << 20
#: Ranges of scripts that are written without spaces; each of their characters is a word.
UNSPACED = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff"
WORD = re.compile(rf"[^\W_{UNSPACED}]+|[{UNSPACED}]")
MIX = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[str]:
    """Runs of letters and digits, in lower case; single characters in scripts without spaces."""
    return WORD.findall((text or "").lower())


def myers(pattern: list, text: list, limit: int) -> tuple[int, int] | None:
    """Smallest edit distance of the pattern to any stretch of the text and that stretch's end; None beyond ``limit``.

    Bit-parallel: one column of the distance matrix is two bit vectors (of any
    length, as Python's integers have no word size).
    """
    m = len(pattern)
    if not m:
        return None
    peq: dict = {}
    for i, w in enumerate(pattern):
        peq[w] = peq.get(w, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best = full, 0, m, None
    for j, w in enumerate(text):
        eq = peq.get(w, 0)
        xv = eq | mv
        xh = ((((eq & pv) + pv) ^ pv) | eq) & full
        ph, mh = mv | (full & ~(xh | pv)), pv & xh
        score += 1 if ph & top else -1 if mh & top else 0
        ph, mh = ph << 1 & full, mh << 1 & full
        pv, mv = mh | (full & ~(xv | ph)), ph & xv
        if score <= limit and (best is None or score < best[0]):
            best = (score, j + 1)
    return best


#: Bits of the table that tells at once that a run of words begins no piece.
FILTER_BITS = 20


@dataclass
class Index:
    """Pieces of a block of items: word numbers, and for each length of piece its (item, offset) by words."""

    items: list[tuple[int, list[str], int]]
    vocabulary: dict[str, int] = field(default_factory=dict)
    pieces: dict[int, dict[tuple, list[tuple[int, int]]]] = field(default_factory=dict)
    filters: dict[int, tuple[np.ndarray, np.ndarray]] = field(default_factory=dict)

    @staticmethod
    def of(rows: list[tuple[int, str]], errors: float = ERRORS) -> Index:
        out = Index([])
        for item_id, text in rows:
            if w := words_of(text):
                out.items.append((item_id, w, int(errors * len(w))))
        for k, (_, w, e) in enumerate(out.items):
            edges = [len(w) * i // (e + 1) for i in range(e + 2)]
            for a, b in zip(edges, edges[1:], strict=False):
                ids = tuple(out.vocabulary.setdefault(x, len(out.vocabulary)) for x in w[a:b])
                out.pieces.setdefault(b - a, {}).setdefault(ids, []).append((k, a))
        for length, found in out.pieces.items():
            hashes = next(_rolled(np.array(list(found), np.int64).ravel(), {length}))[1][::length]
            marked = np.zeros(1 << FILTER_BITS, bool)
            marked[hashes >> np.uint64(64 - FILTER_BITS)] = True
            out.filters[length] = marked, np.unique(hashes)
        return out

    def candidates(self, texts: list[list[str]]) -> Iterator[tuple[int, int, int, int]]:
        """(text, item, where the item would start, piece offset) of every exact hit of a piece."""
        if not self.pieces:
            return
        get = self.vocabulary.get
        ids = [x for w in texts for x in (*[get(v, -1) for v in w], -1)]
        starts = np.cumsum([0] + [len(w) + 1 for w in texts])
        for length, hashes in _rolled(np.array(ids, np.int64), set(self.pieces)):
            marked, known = self.filters[length]
            maybe = np.flatnonzero(marked[hashes >> np.uint64(64 - FILTER_BITS)])
            at = np.searchsorted(known, hashes[maybe])
            at[at == len(known)] = 0
            for p in maybe[known[at] == hashes[maybe]].tolist():
                for k, a in self.pieces[length].get(tuple(ids[p : p + length]), ()):
                    t = int(np.searchsorted(starts, p, "right")) - 1
                    yield t, k, p - int(starts[t]) - a, a


def _rolled(ids: np.ndarray, lengths: set[int]) -> Iterator[tuple[int, np.ndarray]]:
    """For each wanted length the hashes of all runs of so many words, each length from the one before."""
    out = np.zeros(len(ids), np.uint64)
    for k in range(min(max(lengths), len(ids))):
        out = (out[: len(ids) - k] ^ (ids[k:].astype(np.uint64) + np.uint64(1))) * MIX
        out ^= out >> np.uint64(29)
        if k + 1 in lengths:
            yield k + 1, out * MIX


def matches(index: Index, texts: list[str | None]) -> Iterator[tuple[int, int, int, int, int]]:
    """(text, item_id, distance, first word, end word) of the best match of each item in each text."""
    cut_texts = [words_of(t) for t in texts]
    spots: dict[tuple[int, int], set[int]] = {}
    for t, k, start, _ in index.candidates(cut_texts):
        spots.setdefault((t, k), set()).add(start)
    for (t, k), starts in sorted(spots.items()):
        item_id, pattern, limit = index.items[k]
        best, reached = None, None
        for s in sorted(starts):
            low, high = max(0, s - limit), s + len(pattern) + limit
            if reached is not None and high <= reached:
                continue
            found = myers(pattern, cut_texts[t][low:high], limit)
            reached = high
            if found and (best is None or found[0] < best[0]):
                best = (found[0], low + found[1])
                if not found[0]:
                    break
        if best:
            back = myers(pattern[::-1], cut_texts[t][max(0, best[1] - len(pattern) - limit) : best[1]][::-1], limit)
            yield t, item_id, best[0], best[1] - (back[1] if back else len(pattern)), best[1]


def _blocks(benchmark: DataFrame, errors: float) -> Iterator[tuple[Broadcast, bool]]:
    """Broadcast indexes of the items, in blocks of about ``BLOCK_BYTES`` of text at most, and whether there are several."""
    items = benchmark.where("text IS NOT NULL").select(F.col("item_id").cast("long").alias("item_id"), "text")
    size = items.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    n_blocks = max(1, -(-2 * size // BLOCK_BYTES))
    block = F.pmod(F.xxhash64("item_id", "text"), F.lit(n_blocks))
    for k in range(n_blocks):
        rows = [(r["item_id"], r["text"]) for r in items.where(block == k).collect()]
        yield benchmark.sparkSession.sparkContext.broadcast(Index.of(sorted(rows, key=lambda r: (r[0] is None, r)), errors)), n_blocks > 1


def leaks(docs: DataFrame, benchmark: DataFrame, errors: float = ERRORS) -> DataFrame:
    """Documents that hold a benchmark item: doc_id, item_id, distance, first_word and end_word of its best place.

    An item is held if some stretch of the document's words is within
    ``errors`` times the item's words (rounded down) of it; items of few words
    allow no errors and are sought as they are. Case, punctuation and line
    breaks do not count. Null and empty texts hold nothing; items without any
    letter or digit are held nowhere (see :func:`unsought`); of places equally
    near the first counts; repeated documents or items each give their rows;
    other columns are ignored; empty tables give an empty result.
    """
    ship(docs.sparkSession)
    schema = "doc_id long, item_id long, distance int, first_word int, end_word int"
    found = None
    for index, several in _blocks(benchmark, errors):

        def run(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
                for low in range(0, len(ids), 256):
                    hits = [(ids[low + t], *rest) for t, *rest in matches(index.value, texts[low : low + 256])]
                    if hits:
                        yield pa.RecordBatch.from_pylist([dict(zip(("doc_id", "item_id", "distance", "first_word", "end_word"), h, strict=True)) for h in hits], schema=ARROW)

        part = docs.where("text IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)
        if several:
            part = cut(part, "leaks")
            index.unpersist()
        found = part if found is None else found.unionByName(part)
    return found


def unsought(benchmark: DataFrame) -> DataFrame:
    """item_id of the items that no search can find: null ones and those without any letter or digit."""
    return benchmark.where(~F.coalesce(F.col("text").rlike(r"[\p{L}\p{N}]"), F.lit(False))).select(F.col("item_id").cast("long").alias("item_id"))


def without_leaks(docs: DataFrame, benchmark: DataFrame, errors: float = ERRORS) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item; rows are dropped where they are, without a shuffle.

    Null and empty texts, repeated rows and all other columns stay; an empty
    table of documents or items is returned as it is.
    """
    ship(docs.sparkSession)
    at, own = docs.columns.index("text"), []
    for index, several in _blocks(benchmark, errors):

        def run(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                texts, clean = batch.column(at).to_pylist(), np.ones(batch.num_rows, bool)
                for low in range(0, len(texts), 256):
                    for t, *_ in matches(index.value, texts[low : low + 256]):
                        clean[low + t] = False
                yield batch.filter(pa.array(clean))

        left = docs.mapInArrow(run, docs.schema)
        if several:
            left = cut(left, "without-leaks")
            index.unpersist()
            discard(*own)
            own = [left]
        docs = left
    return docs


ARROW = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("distance", pa.int32()), ("first_word", pa.int32()), ("end_word", pa.int32())])


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
