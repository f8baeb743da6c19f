"""Packing of token sequences by cutting-stock column generation (operator 13).

Documents become pieces of at most ``SIZE`` tokens: whole sequences first, then
a rest. The number of pieces of each length, a histogram of at most ``SIZE``
rows whatever the corpus, is all that reaches the driver. There a linear program over patterns
(lengths that share a sequence) is solved by column generation: its prices go
to a knapsack over the sequence's tokens, which proposes patterns that cost less
than they are worth. Patterns are taken a whole number of times; pieces are
ranked within their length by a distributed sort, and a piece's rank says which
pattern, sequence and offset it has. What rounding leaves, and what would pad
more than ``SLACK`` tokens, is laid end to end and cut where a sequence is full.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewake.llm.common import cut, in_order, places, ship, table
from tidewake.llm.token_counts import _ALPHABET, _is_byte_level

SIZE = 2048
END = 1
#: Most padding of a sequence of whole pieces; beyond it pieces are cut instead.
SLACK = 16
#: The program ends when its padding is below this share, or after so many rounds of at most so many new patterns.
GAP, ROUNDS, COLUMNS = 0.0005, 40, 24
#: Texts are encoded in stretches of about so many bytes; a longer text is one by itself.
STRETCH = 16 << 20
MARK = "\x01"
#: Fixed: characters with Unicode's property White_Space.
_SPACE = r"\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
#: A run of white space before a word loses its last character to what follows; then every other pre-token is one match.
_SPLIT_SPACE = rf"([{_SPACE}])([{_SPACE}][^{_SPACE}\x01])"
_SPLIT_REST = rf"'(?:[sdmt]|ll|ve|re)| ?\p{{L}}+| ?\p{{N}}+| ?[^{_SPACE}\p{{L}}\p{{N}}\x01]+|[{_SPACE}]+"


# ---------------------------------------------------------------- tokens


class Encoder:
    """Ids of texts as the tokenizer's library gives them, without special tokens.

    Byte-level BPE files in which every token of the vocabulary encodes to
    itself are merged by ``tiktoken``, once for each different pre-token of a
    stretch. It gives the library's ids: two neighbours whose
    bytes together make token t stand as if t were encoded alone, so
    they are the pair that t's own merge names. Texts with a special token's
    string or the separator, and all texts of other files, go to the library whole.
    """

    def __init__(self, spec: bytes) -> None:
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_buffer(spec)
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.merge = self._merger(json.loads(spec)) if _is_byte_level(self.library) else None

    def _merger(self, spec: dict):
        import tiktoken

        model = spec["model"]
        letters = [chr(_ALPHABET.get(b, b)) for b in range(256)]
        byte_of = {c: b for b, c in enumerate(letters)}
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        tokens = letters + [a + b for a, b in pairs]
        alone = all([x.value for x in self.library.model.tokenize(t)] == [t] for t in tokens)
        if not alone or len(set(tokens)) < len(tokens) or model.get("ignore_merges"):
            return None
        ranks = {bytes(byte_of[c] for c in t): k for k, t in enumerate(tokens)}
        self.ids = np.array([model["vocab"][t] for t in tokens], "<u4")
        return tiktoken.Encoding("file", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece

    def __call__(self, texts: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray]:
        """All ids, each text's followed by ``END``, and where each text ends."""
        whole = np.ones(len(texts), bool)
        if self.merge:
            hard = pc.match_substring(texts, MARK)
            for s in self.special:
                hard = pc.or_(hard, pc.match_substring(texts, s))
            whole = hard.to_numpy(zero_copy_only=False)
        easy = texts.filter(pa.array(~whole))
        parts = [None] * len(texts)
        for k, e in zip(np.flatnonzero(whole), self.library.encode_batch_fast(texts.filter(pa.array(whole)).to_pylist(), add_special_tokens=False) if whole.any() else [], strict=True):
            parts[k] = np.array([*e.ids, END], "<u4")
        if len(easy):
            ids, ends = self._fast(easy)
            if not whole.any():
                return ids, ends
            for k, x in zip(np.flatnonzero(~whole), np.split(ids, ends[:-1]), strict=True):
                parts[k] = x
        ends = np.cumsum([len(p) for p in parts])
        return np.concatenate(parts) if parts else np.empty(0, "<u4"), ends

    def _fast(self, texts: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray]:
        marked = pc.replace_substring_regex(pc.replace_substring_regex(texts, _SPLIT_SPACE, rf"\1{MARK}\2"), _SPLIT_REST, rf"\0{MARK}")
        pieces = pc.split_pattern(marked, MARK)
        coded = pieces.values.dictionary_encode()
        merge = self.merge
        encoded = [merge(p.encode()) if p else [] for p in coded.dictionary.to_pylist()]
        lengths = np.fromiter(map(len, encoded), np.int64, len(encoded))
        flat = self.ids[np.fromiter((i for e in encoded for i in e), np.int64, int(lengths.sum()))]
        codes = coded.indices.to_numpy()
        sizes = lengths[codes]
        upto = np.concatenate([[0], np.cumsum(sizes)])
        bounds = upto[pieces.offsets.to_numpy()]
        source = np.arange(upto[-1]) - np.repeat(upto[:-1] - (np.cumsum(lengths) - lengths)[codes], sizes)
        tokens = np.diff(bounds)
        out = np.full(int(upto[-1]) + len(texts), END, "<u4")
        out[np.arange(upto[-1]) + np.repeat(np.arange(len(texts)), tokens)] = flat[source]
        return out, np.cumsum(tokens + 1)


@lru_cache(maxsize=2)
def _encoder(spec: bytes) -> Encoder:
    return Encoder(spec)


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, ids binary"


def _pieces(spec: Broadcast, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(spec.value)
        for batch in batches:
            texts = pc.fill_null(batch.column(1).cast(pa.large_string()), "")
            upto = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False)) // STRETCH
            edges = [0, *(np.flatnonzero(np.diff(upto)) + 1), len(texts)]
            for a, b in zip(edges, edges[1:], strict=False):
                if a < b:
                    yield from _cut_texts(batch.column(0).slice(a, b - a).to_pylist(), *encode(texts.slice(a, b - a)), size)

    return run


def _cut_texts(doc_ids: list, ids: np.ndarray, ends: np.ndarray, size: int) -> Iterator[pa.RecordBatch]:
    """Rows of ``PIECES``; ids are kept of rests only, which may be cut again."""
    data, first, rows = memoryview(ids).cast("B"), 0, []
    for doc, end in zip(doc_ids, ends.tolist(), strict=True):
        for at in range(first, end, size):
            part = data[4 * at : 4 * min(at + size, end)]
            rows.append((doc, at - first, len(part) // 4, zlib.crc32(part), end - first, None if len(part) == 4 * size else bytes(part)))
        first = end
    columns = list(zip(*rows, strict=True))
    kinds = [*[pa.int64()] * 5, pa.binary()]
    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [c.split()[0] for c in PIECES.split(", ")])


# ---------------------------------------------------------------- the program


def padded(total: int, size: int = SIZE) -> int:
    """Length of a sequence of ``total`` tokens: itself at a power of two, else the full size."""
    return total if total & (total - 1) == 0 else size


Pattern = tuple[tuple[int, int], ...]  # (length, times), longest first


def _total(pattern: Pattern) -> int:
    return sum(n * k for n, k in pattern)


def _largest_first(left: dict[int, float], size: int) -> Pattern:
    """A pattern that takes the longest lengths there are, as often as they fit and are left."""
    room, out = size, []
    for n in sorted(left, reverse=True):
        if k := min(room // n, max(1, int(left[n]))):
            out.append((n, k))
            room -= n * k
            if not room:
                break
    return tuple(out)


class Program:
    """Least padded tokens over patterns that take every length exactly as often as it occurs; a revised simplex with an explicit inverse.

    It starts from patterns of the longest lengths first. Each of them uses up
    one length, so they form a triangular basis, which is inverted row by row.
    Sums go through ``einsum``, since threads of a BLAS library may wait for
    ever in a process that has started a JVM.
    """

    def __init__(self, demand: dict[int, int], size: int = SIZE) -> None:
        self.size, self.lengths = size, np.array(sorted(demand, reverse=True), np.int64)
        self.row = {int(n): k for k, n in enumerate(self.lengths)}
        self.demand = np.array([demand[int(n)] for n in self.lengths], float)
        left, self.basis = {int(n): float(demand[int(n)]) for n in self.lengths}, []
        uses: list[list[tuple[int, int]]] = [[] for _ in self.lengths]  # of each length: patterns so far and how often it is in them
        self.inverse = np.zeros((len(left), len(left)))
        while left:
            pattern = _largest_first(left, size)
            times, used_up = min((left[n] / k, n) for n, k in pattern)
            for n, k in pattern:
                left[n] -= times * k
                uses[self.row[n]].append((len(self.basis), k))
            del left[used_up]
            (*before, (here, own)) = uses[self.row[used_up]]
            row = np.zeros(len(self.lengths))
            row[self.row[used_up]] = 1
            for k, n in before:
                row -= n * self.inverse[k]
            self.inverse[here] = row / own
            self.basis.append(pattern)
        self.costs = np.array([self.cost(p) for p in self.basis])
        self.times = np.maximum(np.einsum("ij,j->i", self.inverse, self.demand), 0)
        self.prices = np.einsum("i,ij->j", self.costs, self.inverse)

    def cost(self, pattern: Pattern) -> float:
        """Padded tokens, and a token for each sequence, so that long ones are preferred."""
        return padded(_total(pattern), self.size) + 1.0

    def padding(self) -> float:
        """Share of padding in the present solution."""
        spent = np.array([padded(_total(p), self.size) for p in self.basis]) * self.times
        return float(spent.sum() / (self.lengths * self.demand).sum()) - 1

    def proposals(self) -> list[Pattern]:
        """Patterns that are worth more than they cost at the present prices, by an exact-fill knapsack; best first."""
        best, last = np.full(self.size + 1, -np.inf), np.zeros(self.size + 1, np.int64)
        best[0] = 0
        lengths, prices = self.lengths[::-1], self.prices[::-1]
        counts = np.searchsorted(lengths, np.arange(self.size + 1), "right")
        for fill in range(1, self.size + 1):
            k = counts[fill]
            if k:
                worth = best[fill - lengths[:k]] + prices[:k]
                j = int(worth.argmax())
                best[fill], last[fill] = worth[j], j

        def pattern(fill: int, first: int | None = None) -> Pattern:
            taken: dict[int, int] = {} if first is None else {first: 1}
            while fill > 0:
                n = int(lengths[last[fill]])
                taken[n] = taken.get(n, 0) + 1
                fill -= n
            return tuple(sorted(taken.items(), reverse=True))

        found: dict[Pattern, float] = {}
        fills = np.arange(1, self.size + 1)
        price = np.array([padded(int(f), self.size) + 1.0 for f in fills])
        gains = best[1:] - price
        for f in np.argsort(-gains, kind="stable")[: 2 * COLUMNS]:
            if gains[f] > 1e-6:
                found[pattern(int(fills[f]))] = gains[f]
        around = prices + best[self.size - lengths] - (self.size + 1.0)  # the best full sequence with each length in it
        for j in np.argsort(-around, kind="stable")[: 2 * COLUMNS]:
            if around[j] > 1e-6:
                found[pattern(self.size - int(lengths[j]), int(lengths[j]))] = around[j]
        return sorted(found, key=lambda p: (-found[p], p))[:COLUMNS]

    def enter(self, pattern: Pattern) -> bool:
        """Exchange a pattern of the basis for this one, if it still gains."""
        gain = self.cost(pattern) - sum(k * self.prices[self.row[n]] for n, k in pattern)
        if gain >= -1e-6:
            return False
        change = sum(k * self.inverse[:, self.row[n]] for n, k in pattern)
        rising = change > 1e-9
        if not rising.any():
            return False
        ratio = np.full(len(change), np.inf)
        ratio[rising] = self.times[rising] / change[rising]
        out = int(ratio.argmin())
        step = self.inverse[out] / change[out]
        self.times = np.maximum(self.times - ratio[out] * change, 0)
        self.times[out] = ratio[out]
        self.inverse -= np.outer(change, step)
        self.inverse[out] = step
        self.prices = self.prices + gain * step
        self.basis[out], self.costs[out] = pattern, self.cost(pattern)
        return True

    def solve(self, gap: float = GAP, rounds: int = ROUNDS) -> list[tuple[Pattern, float]]:
        for _ in range(rounds):
            if self.padding() <= gap or not sum([self.enter(p) for p in self.proposals()]):
                break
        return list(zip(self.basis, self.times.tolist(), strict=True))


def plan(demand: dict[int, int], size: int = SIZE, slack: int = SLACK) -> tuple[list[tuple[Pattern, int]], dict[int, int]]:
    """Patterns with how often they are used, and how many pieces of each length are left to be cut.

    Fractions are rounded down; what they leave is packed longest first. Neither uses a pattern that pads more than ``slack`` tokens.
    """
    left, chosen = dict(demand), []
    if size in left:
        chosen.append((((size, 1),), left.pop(size)))

    def use(pattern: Pattern, times: int) -> None:
        times = min([times, *(left[n] // k for n, k in pattern)])
        if times > 0 and padded(_total(pattern), size) - _total(pattern) <= slack:
            chosen.append((pattern, times))
            for n, k in pattern:
                left[n] -= times * k

    if left:
        solved = Program(left, size).solve()
        for pattern, times in sorted(solved, key=lambda x: (padded(_total(x[0]), size) - _total(x[0]), x[0])):
            use(pattern, int(times + 1e-6))
    rest = {n: k for n, k in left.items() if k}
    while rest:
        pattern = _largest_first(rest, size)
        use(pattern, min(rest[n] // k for n, k in pattern))
        longest = pattern[0][0]
        rest = {n: left[n] for n in rest if left[n] and (n != longest or left[n] < rest[n])}
    return chosen, {n: k for n, k in left.items() if k}


# ---------------------------------------------------------------- Spark


def _assignment(chosen: list[tuple[Pattern, int]]) -> tuple[list[tuple], dict[int, int], int]:
    """Rows (length, first and last rank, times in the pattern, first sequence, first offset), ranks used of each length, and sequences used."""
    rows, used, sequences = [], {}, 0
    for pattern, times in chosen:
        offset = 0
        for n, k in pattern:
            base = used.get(n, 0)
            used[n] = base + times * k
            rows.append((n, base, used[n], k, sequences, offset))
            offset += n * k
        sequences += times
    return rows, used, sequences


def pack(docs: DataFrame, spec: bytes, size: int = SIZE, slack: int = SLACK) -> DataFrame:
    """A row a piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    ``spec`` is the content of a tokenizer file. A document is its ids and then
    ``END``; a null or empty text is ``END`` alone. Very long texts are encoded
    whole and give as many full sequences as they fill. Repeated rows are
    documents of their own; other columns are ignored; an empty table gives an
    empty result. Pieces of equal length are ranked by (doc_id, start,
    checksum), so reruns agree. What is broadcast has a row for each length of
    a pattern, at most ``size`` patterns of at most 2 * sqrt(size) different lengths.
    """
    spark = docs.sparkSession
    ship(spark)
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_pieces(spark.sparkContext.broadcast(spec), size), PIECES)
    pieces = cut(found.withColumn("piece", F.monotonically_increasing_id()), "packing-pieces")
    demand = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    chosen, left = plan(demand, size, slack)
    rows, used, sequences = _assignment(chosen)

    ordered = in_order(pieces.select("length", "doc_id", "start", "ids_crc32", "piece", "doc_tokens"), ["length", "doc_id", "start", "ids_crc32", "piece"], "packing-order")
    ranked = places(ordered, ["length"])
    slots = spark.createDataFrame(rows, "length long, low long, high long, times long, first_sequence long, first_offset long")
    here = F.col("place") - F.col("low")
    whole = ranked.join(F.broadcast(slots), "length").where("place >= low AND place < high").select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens",
        (F.col("first_sequence") + F.floor(here / F.col("times"))).cast("long").alias("sequence_id"), (F.col("first_offset") + here % F.col("times") * F.col("length")).cast("long").alias("offset"),
    )
    if not left:
        return whole
    return whole.unionByName(_cut_line(ranked, pieces, left, used, sequences, size))


def _cut_line(ranked: DataFrame, pieces: DataFrame, left: dict[int, int], used: dict[int, int], sequences: int, size: int) -> DataFrame:
    """The pieces that no pattern takes, laid end to end by length and rank, and cut at full sequences; the end is cut into powers of two."""
    bases, total = [], 0
    for n in sorted(left):
        bases.append((n, used.get(n, 0), total))
        total += n * left[n]
    full = total // size
    ends = [full * size]
    while ends[-1] < total:
        ends.append(ends[-1] + (1 << ((total - ends[-1]).bit_length() - 1)))
    base = ranked.sparkSession.createDataFrame(bases, "length long, from_place long, line_base long")
    line = ranked.join(F.broadcast(base), "length").where("place >= from_place").withColumn("low", F.col("line_base") + (F.col("place") - F.col("from_place")) * F.col("length"))
    line = line.join(pieces.select("piece", "ids"), "piece").withColumn("high", F.col("low") + F.col("length"))
    marks = F.array(*(F.lit(e).cast("long") for e in ends))
    inner = F.filter(F.array_union(F.transform(F.sequence(F.floor(F.col("low") / size), F.floor(F.col("high") / size)), lambda k: k * size), marks), lambda m: (m > F.col("low")) & (m < F.col("high")) & ((m % size == 0) & (m <= full * size) | F.array_contains(marks, m)))
    starts = F.array_sort(F.concat(F.array("low"), inner))
    line = line.withColumn("bounds", F.concat(starts, F.array("high"))).withColumn("k", F.explode(F.sequence(F.lit(0), F.size("bounds") - 2)))
    a, b = F.get("bounds", F.col("k")), F.get("bounds", F.col("k") + 1)
    line = line.withColumns({"a": a, "b": b})
    own = (F.col("a") - F.col("low")).cast("int")
    part = F.substring("ids", own * 4 + 1, ((F.col("b") - F.col("a")) * 4).cast("int"))
    in_end = F.col("a") >= full * size
    place: Column = F.size(F.filter(marks, lambda m: m <= F.col("a"))) - 1
    sequence = F.when(in_end, full + place).otherwise(F.floor(F.col("a") / size))
    offset = F.when(in_end, F.col("a") - F.get(marks, place)).otherwise(F.col("a") % size)
    return line.select(
        "doc_id", (F.col("start") + own).cast("long").alias("start"), (F.col("b") - F.col("a")).cast("long").alias("length"), F.crc32(part).alias("ids_crc32"), "doc_tokens",
        (F.lit(sequences) + sequence).cast("long").alias("sequence_id"), offset.cast("long").alias("offset"),
    )


def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_50k.json"), "rb") as f:
        return pack(table(spark, sf_dir, "documents"), f.read())
