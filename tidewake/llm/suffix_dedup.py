"""Exact substring deduplication with suffix arrays over shards (operator 9).

Every 400-byte string holds one anchor: the smallest hash of its 128-byte
strings (the leftmost of equal ones). Equal strings have equal anchors at
equal places, so the windows of a text fall into contexts, one for each
anchor, and only contexts of one anchor can share a string. Equal contexts are
merged and counted; those of one anchor meet in a shard, whose suffix array is
built by induced sorting. A window repeats if the permuted common prefix with
a neighbour reaches 400 bytes, or if its context was counted twice.

An anchor of more than ``CAP`` different contexts (a passage inside very many
texts) is split: its contexts are cut into ranges of ``RANGE`` windows, which
meet by the bytes that all windows of a range share; should more than ``CAP``
still meet, their windows meet one by one, as counts. No shard grows with the
corpus. Texts are shuffled only if a bounded bitmap says that they take part.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewake.llm.common import bitmap, cut, marked, row_key, ship, table
from tidewake.llm.suffix_array import permuted_prefixes, suffix_array

LENGTH = 400
ANCHOR = 128
CAP = 96
RANGE = 16
#: Bytes that are hashed, and that are sorted, at a time.
SLAB = 1 << 18
SHARD = 3 << 20
#: Longer texts are taken in overlapping stretches of so many bytes.
STRETCH = 1 << 22
WHOLE = 1 << 30

_POSITION = np.uint64((1 << 24) - 1)
_BASE = 0x9E3779B97F4A7C15
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """Powers 0 to n-1 of an odd number, modulo 2**64."""
    out = _powers.get(base)
    if out is None or len(out) < n:
        out = np.ones(max(n, 2 * SLAB), np.uint64)
        done = 1
        while done < len(out):
            more = min(done, len(out) - done)
            out[done : done + more] = out[:more] * np.uint64(pow(base, done, 1 << 64))
            done += more
        _powers[base] = out
    return out[:n]


def _anchor_hashes(data: np.ndarray) -> np.ndarray:
    """Mixed polynomial hashes of all strings of ``ANCHOR`` bytes."""
    n = len(data)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _power(_BASE, n), out=sums[1:])
    h = (sums[ANCHOR:] - sums[:-ANCHOR]) * _power(pow(_BASE, -1, 1 << 64), n - ANCHOR + 1)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ h >> np.uint64(32)


def _leftmost_minima(h: np.ndarray, width: int) -> np.ndarray:
    """Position of the smallest hash (by its high 40 bits, leftmost of equal ones) of every run of ``width``."""
    n = len(h)
    keyed = np.full(-(-n // width) * width, ~np.uint64(0))
    keyed[:n] = (h & ~_POSITION) | np.arange(n, dtype=np.uint64)
    blocks = keyed.reshape(-1, width)
    forward = np.minimum.accumulate(blocks, axis=1).ravel()
    backward = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return (np.minimum(backward[: n - width + 1], forward[width - 1 : n]) & _POSITION).astype(np.int64)


def contexts(data: np.ndarray, bounds: list[tuple[int, int, int]]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each text (number, start, end in ``data``): start, number of windows, anchor's place and hash of its contexts."""
    pieces = []
    for k, low, high in bounds:
        while high - low >= LENGTH:
            pieces.append((k, low, min(high, low + STRETCH)))
            low += STRETCH - LENGTH + 1
    at = 0
    while at < len(pieces):
        end, size = at, 0
        while end < len(pieces) and (end == at or size + pieces[end][2] - pieces[end][1] <= SLAB):
            size += pieces[end][2] - pieces[end][1]
            end += 1
        slab = np.concatenate([data[low:high] for _, low, high in pieces[at:end]])
        h = _anchor_hashes(slab)
        minima = _leftmost_minima(h, LENGTH - ANCHOR + 1)
        base = 0
        for k, low, high in pieces[at:end]:
            mine = minima[base : base + high - low - LENGTH + 1]
            starts = np.flatnonzero(np.r_[True, mine[1:] != mine[:-1]])
            anchors = mine[starts]
            yield k, starts + low, np.diff(np.r_[starts, len(mine)]), anchors - base + low, h[anchors]
            base += high - low
        at = end


def _utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of a string or binary column, without decoding."""
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    _, offsets, data = column.buffers()
    if not len(column):
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    ends = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return ends, np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)


def _signed(x: np.ndarray | list) -> pa.Array:
    return pa.array(np.asarray(x, np.uint64).view(np.int64))


def _occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, h, ctx, n): how often each text has each context."""
    from xxhash import xxh3_64_intdigest

    for batch in batches:
        keys = batch.column(0).to_pylist()
        ends, data = _utf8(batch.column(1))
        view = memoryview(data)
        found: dict[tuple[int, int, int], int] = {}
        for k, starts, windows, _, h in contexts(data, [(k, int(a), int(b)) for k, (a, b) in enumerate(zip(ends, ends[1:], strict=False))]):
            key = keys[k]
            for s, e, x in zip(starts.tolist(), (starts + windows + LENGTH - 1).tolist(), h.tolist(), strict=True):
                item = (key, x, xxh3_64_intdigest(view[s:e]))
                found[item] = found.get(item, 0) + 1
        if found:
            key, h, ctx = zip(*found, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), _signed(h), _signed(ctx), pa.array(list(found.values()), pa.int32())], ["key", "h", "ctx", "n"])


PIECES = "h long, ctx long, off int, grp long, id long, n long, piece binary"
_PIECES = pa.schema([("h", pa.int64()), ("ctx", pa.int64()), ("off", pa.int32()), ("grp", pa.int64()), ("id", pa.int64()), ("n", pa.int64()), ("piece", pa.binary())])


def _fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bytes of the wanted contexts of each text; those of split anchors as ranges of windows."""
    from xxhash import xxh3_64_intdigest

    for batch in batches:
        ends, data = _utf8(batch.column(0))
        view = memoryview(data)
        lists = batch.column(1)
        at, want = lists.offsets.to_numpy(), lists.values
        h, ctx, n, split = (want.field(i).to_numpy(zero_copy_only=False) for i in range(4))
        wanted = [dict(zip(zip(h[a:b].view(np.uint64).tolist(), ctx[a:b].view(np.uint64).tolist(), strict=True), zip(n[a:b].tolist(), split[a:b].tolist(), strict=True), strict=True)) for a, b in zip(at, at[1:], strict=False)]
        rows: list[tuple] = []
        for k, starts, windows, anchors, hs in contexts(data, [(k, int(a), int(b)) for k, (a, b) in enumerate(zip(ends, ends[1:], strict=False))]):
            mine = wanted[k]
            for s, m, a, x in zip(starts.tolist(), windows.tolist(), anchors.tolist(), hs.tolist(), strict=True):
                c = xxh3_64_intdigest(view[s : s + m + LENGTH - 1])
                found = mine.pop((x, c), None)
                if found is None:
                    continue
                if not found[1]:
                    rows.append((x, c, 0, x, c, found[0], bytes(view[s : s + m + LENGTH - 1])))
                    continue
                p = s
                while p < s + m:
                    j = (a - p) // RANGE
                    last = min(a - RANGE * j, s + m - 1)
                    core = xxh3_64_intdigest(view[a - RANGE * j : a - RANGE * (j + 1) + 1 + LENGTH], seed=j)
                    piece = bytes(view[p : last + LENGTH])
                    rows.append((x, c, p - s, core, xxh3_64_intdigest(piece), found[0], piece))
                    p = last + 1
            if len(rows) > 20_000:
                yield _piece_batch(rows)
                rows = []
        if rows:
            yield _piece_batch(rows)


def _piece_batch(rows: list[tuple]) -> pa.RecordBatch:
    h, ctx, off, grp, one, n, piece = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([_signed(h), _signed(ctx), pa.array(off, pa.int32()), _signed(grp), _signed(one), pa.array(n, pa.int64()), pa.array(piece, pa.binary())], schema=_PIECES)


def repeats(pieces: list[bytes], counts: list[int]) -> list[list[int]]:
    """Repeated bytes of each piece as start, end, start, end ...; a piece counted twice repeats as a whole."""
    text = np.frombuffer(b"\0".join(pieces) + b"\0", np.uint8).astype(np.uint16) + np.uint16(1)
    ends = np.cumsum([len(p) + 1 for p in pieces])
    text[ends - 1] = 1
    text = np.r_[text, np.uint16(0)]
    phi, common = permuted_prefixes(text, suffix_array(text))
    again = common >= LENGTH
    twice = again.copy()
    twice[phi[again]] = True
    out = []
    for p, n, end in zip(pieces, counts, ends.tolist(), strict=True):
        if n > 1:
            out.append([0, len(p)])
            continue
        start = end - 1 - len(p)
        flags = np.r_[False, twice[start : start + max(0, len(p) - LENGTH + 1)], False]
        edges = np.flatnonzero(flags[1:] != flags[:-1])
        edges[1::2] += LENGTH - 1
        out.append(edges.tolist())
    return out


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(grp, id, spans) of pieces sorted by group; whole groups are sorted together, up to ``SHARD`` bytes."""
    held: list[tuple[int, int, int, bytes]] = []
    size = 0

    def emit(rows):
        spans = repeats([r[3] for r in rows], [r[2] for r in rows])
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array(spans, pa.list_(pa.int32()))], ["grp", "id", "spans"])

    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if size >= SHARD and held and row[0] != held[-1][0]:
                yield emit(held)
                held, size = [], 0
            held.append(row)
            size += len(row[3]) + 1
    if held:
        yield emit(held)


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(grp, id, at, w1, w2, n): every window of a range, by its hash."""
    from xxhash import xxh3_128_intdigest

    for batch in batches:
        rows = []
        for grp, one, n, piece in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            for at in range(len(piece) - LENGTH + 1):
                w = xxh3_128_intdigest(piece[at : at + LENGTH])
                rows.append((grp, one, at, w >> 64, w & (1 << 64) - 1, n))
        if rows:
            grp, one, at, w1, w2, n = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(grp, pa.int64()), pa.array(one, pa.int64()), pa.array(at, pa.int32()), _signed(w1), _signed(w2), pa.array(n, pa.int64())], ["grp", "id", "at", "w1", "w2", "n"])


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The digest of each text, given the repeated spans of its contexts."""
    from xxhash import xxh3_64_intdigest

    for batch in batches:
        ids, (ends, data), lists = batch.column(0), _utf8(batch.column(1)), batch.column(2)
        view = memoryview(data)
        values, at = lists.values, lists.offsets.to_numpy()
        ctx = values.field(0).to_numpy().view(np.uint64)
        off = values.field(1).to_numpy()
        spans = values.field(2)
        span_at, span = spans.offsets.to_numpy(), spans.values.to_numpy()
        listed = np.diff(at) > 0
        marks: dict[int, np.ndarray] = {}
        own: dict[int, dict[int, list[int]]] = {}
        for k in np.flatnonzero(listed).tolist():
            mine: dict[int, list[int]] = {}
            for r, c in enumerate(ctx[at[k] : at[k + 1]].tolist(), int(at[k])):
                mine.setdefault(c, []).append(r)
            own[k] = mine
            marks[k] = np.zeros(int(ends[k + 1] - ends[k]) + 1, np.int32)
        for k, starts, windows, _, _ in contexts(data, [(k, int(ends[k]), int(ends[k + 1])) for k in own]):
            mine, mark, base = own[k], marks[k], int(ends[k])
            for s, m in zip(starts.tolist(), windows.tolist(), strict=True):
                for r in mine.get(xxh3_64_intdigest(view[s : s + m + LENGTH - 1]), ()):
                    here = s - base + int(off[r])
                    for i in range(int(span_at[r]), int(span_at[r + 1]), 2):
                        mark[here + span[i]] += 1
                        mark[min(here + span[i + 1], s - base + m + LENGTH - 1)] -= 1
        n, removed, runs, digest = [], [], [], []
        for k, (a, b) in enumerate(zip(ends.tolist(), ends.tolist()[1:], strict=False)):
            text = data[a:b]
            gone = np.cumsum(marks[k][:-1]) > 0 if k in marks else None
            n.append(b - a)
            removed.append(int(gone.sum()) if gone is not None else 0)
            runs.append(int((gone & ~np.r_[False, gone[:-1]]).sum()) if gone is not None else 0)
            digest.append(sha256(text[~gone].tobytes() if gone is not None else text.tobytes()).hexdigest())
        yield pa.RecordBatch.from_arrays([ids, pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array(digest, pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def repeated_spans(docs: DataFrame) -> DataFrame:
    """(key, found): for each text with repeats, its contexts and their repeated bytes.

    A key names a row's content. Should different rows share one, they get
    each other's contexts too, which do no harm, as they are looked up by hash.
    Equal rows are made one before their contexts are fetched, so that no
    context comes to its shard more than once.
    """
    texts = docs.select(row_key("doc_id", "text").alias("key"), "text").where(F.octet_length("text") >= LENGTH)
    occurs = cut(texts.mapInArrow(_occurrences, "key long, h long, ctx long, n int"), "occurrences")
    merged = occurs.groupBy("h", "ctx").agg(F.sum("n").alias("n"), F.min("key").alias("key"))
    anchors = merged.groupBy("h").agg(F.sum("n").alias("total"), F.count("*").alias("kinds")).where("total > 1")
    repeated = cut(merged.join(anchors, "h").select("h", "ctx", "n", "key", "kinds"), "contexts")

    wanted = repeated.where("kinds > 1").groupBy("key").agg(F.collect_list(F.struct("h", "ctx", "n", (F.col("kinds") > CAP).alias("split"))).alias("wanted"))
    holders = marked(texts, bitmap(repeated.where("kinds > 1").select("key"))).where("marked").select("key", "text").distinct()
    pieces = cut(holders.join(wanted, "key").select("text", "wanted").mapInArrow(_fetch, PIECES), "pieces")

    contexts_ = pieces.where("grp = h AND id = ctx").select("grp", "id", "n", "piece")
    ranges = pieces.where("NOT (grp = h AND id = ctx)")
    merged_ranges = ranges.groupBy("grp", "id").agg(F.sum("n").alias("n"), F.min("piece").alias("piece"))
    sizes = merged_ranges.groupBy("grp").agg(F.count("*").alias("kinds"), F.sum("n").alias("total")).where("total > 1")
    met = cut(merged_ranges.join(sizes, "grp").select("grp", "id", "n", "piece", "kinds"), "ranges")

    shards = contexts_.unionByName(met.where(F.col("kinds") <= CAP).drop("kinds"))
    sorted_ = shards.repartition("grp").sortWithinPartitions("grp").mapInArrow(_shards, "grp long, id long, spans array<int>")
    windows = met.where(F.col("kinds") > CAP).select("grp", "id", "n", "piece").mapInArrow(_windows, "grp long, id long, at int, w1 long, w2 long, n long")
    twice = windows.groupBy("w1", "w2").agg(F.sum("n").alias("n")).where("n > 1").select("w1", "w2")
    single = windows.join(twice, ["w1", "w2"]).groupBy("grp", "id").agg(F.flatten(F.collect_list(F.array(F.col("at"), F.col("at") + LENGTH))).alias("spans"))
    spans = cut(sorted_.unionByName(single).where("size(spans) > 0"), "spans")

    every = repeated.where("n > 1").select("h", "ctx", F.lit(0).alias("off"), F.array(F.lit(0), F.lit(WHOLE)).alias("spans"))
    parts = pieces.where("n = 1").select("h", "ctx", "off", "grp", "id").join(spans, ["grp", "id"]).select("h", "ctx", "off", "spans")
    found = occurs.select("key", "h", "ctx").join(every.unionByName(parts), ["h", "ctx"])
    return found.groupBy("key").agg(F.collect_list(F.struct("ctx", "off", "spans")).alias("found"))


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every document.

    Every byte covered by a 400-byte string that starts at two places or more,
    of one document or of several, is removed; strings are judged on the
    input, so no copy is spared. Null texts count as empty; texts under 400
    bytes stay whole. Repeated rows are places of their own, so a text that is
    there twice loses all its bytes from 400 on up. Other columns are ignored;
    an empty table gives an empty result.
    """
    ship(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = cut(repeated_spans(docs), "found")
    rows = marked(docs.withColumn("key", row_key("doc_id", "text")), bitmap(found.select("key")))
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    hit = rows.where("marked").select("key", "doc_id", "text").join(found, "key", "left").select("doc_id", "text", "found").mapInArrow(_remove, schema)
    text = F.coalesce("text", F.lit(""))
    clean = rows.where("NOT marked").select("doc_id", F.octet_length(text).cast("long").alias("n_bytes"), *(F.lit(0).cast("long").alias(c) for c in ("n_removed", "n_spans")), F.sha2(text.cast("binary"), 256).alias("kept_sha256"))
    return hit.unionByName(clean)


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).withColumn("repeated", F.col("n_removed") > 0)
