"""SimHash near-duplicate groups by bit-sliced comparison (operator 6).

Equal fingerprints are merged first. The different ones meet in buckets: the
64 bits are cut into five blocks, and two fingerprints that differ in at most
two bits agree on at least three whole blocks, so ten tables of three blocks
miss no pair. The prints of a crowded bucket meet once more in the same way, by
blocks of the bits that its table leaves free; ten or eleven bits are free then,
so no bucket has more than 2,048 different prints. Within a bucket fingerprints are stored vertically, one machine
word for each bit of 64 of them; one step then updates 64 distances with
carry-save counters, and 64 fingerprints are abandoned together once all are
beyond the radius. A bucket's links leave its task as a forest, never as all
pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewake.llm.common import cut, discard, row_name, ship, table
from tidewake.llm.components import connected_components

SEED = 42
SHINGLE = 3
RADIUS = 2
BLOCKS = 5
#: Buckets of more fingerprints meet again by blocks of their free bits; buckets of more texts are compared in parts of about this size.
PART = 256


def fingerprint(text: str | None) -> int:
    """64-bit SimHash of a whole text over its 3-word shingles; 0 without words."""
    from xxhash import xxh64_intdigest

    w = (text or "").encode().lower().split()
    if not w:
        return 0
    shingles = map(b" ".join, zip(*(w[k:] for k in range(SHINGLE)), strict=False)) if len(w) >= SHINGLE else [b" ".join(w)]
    n = max(1, len(w) - SHINGLE + 1)
    hashes = np.fromiter(map(xxh64_intdigest, shingles, repeat(SEED)), np.uint64, n)
    bits = np.unpackbits(hashes.view(np.uint8).reshape(n, 8), axis=1, bitorder="little")
    return int(np.packbits(2 * bits.sum(axis=0, dtype=np.int64) > n, bitorder="little").view(np.uint64)[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = np.array([fingerprint(t) for t in batch.column(1).to_pylist()], np.uint64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints.view(np.int64))], ["doc_id", "fp"])


def near(values: np.ndarray, group: np.ndarray, radius: int = RADIUS, slab: int = 1 << 16) -> tuple[np.ndarray, np.ndarray]:
    """Row pairs (i > j) of one group (rows sorted by group) whose values differ in at most ``radius`` bits."""
    n = len(values)
    starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]]) if n else np.zeros(0, np.int64)
    sizes = np.diff(np.r_[starts, n])
    place = np.arange(n) - np.repeat(starts, sizes)
    words = (sizes + 63) // 64
    first_word = np.cumsum(words) - words
    word = np.repeat(first_word, sizes) + place // 64
    lane = (place % 64).astype(np.uint64)
    heads = np.flatnonzero(np.r_[True, word[1:] != word[:-1]]) if n else starts
    one = np.uint64(1)
    planes = [np.bitwise_or.reduceat(((values >> np.uint64(b)) & one) << lane, heads) for b in range(64)]
    valid = np.bitwise_or.reduceat(one << lane, heads)
    todo = np.repeat(words, sizes)
    ends = np.cumsum(todo)
    found: list[tuple[np.ndarray, np.ndarray]] = []
    low = 0
    while low < n:
        high = max(low + 1, int(np.searchsorted(ends, (ends[low - 1] if low else 0) + slab, "right")))
        q = np.repeat(np.arange(low, high), todo[low:high])
        w = np.repeat(np.repeat(first_word, sizes)[low:high], todo[low:high]) + np.arange(len(q)) - np.repeat(np.cumsum(todo[low:high]) - todo[low:high], todo[low:high])
        found.append(_compare(values, planes, valid, heads, q, w, radius))
        low = high
    return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 2


def _compare(values, planes, valid, heads, q, w, radius):
    """Distances of each query to 64 lanes at once. The counters start so that they overflow beyond the radius."""
    width = (radius + 1).bit_length()
    begin = (1 << width) - (radius + 1)
    counters = [np.full(len(q), ~np.uint64(0) if begin >> k & 1 else np.uint64(0), np.uint64) for k in range(width)]
    over, mine = ~valid[w], values[q]
    for b in range(64):
        carry = planes[b][w] ^ (np.uint64(0) - ((mine >> np.uint64(b)) & np.uint64(1)))
        for k in range(width):
            counters[k], carry = counters[k] ^ carry, counters[k] & carry
        over |= carry
        if b % 8 == 7:
            alive = ~over != 0
            if not alive.all():
                q, w, over, mine = q[alive], w[alive], over[alive], mine[alive]
                counters = [c[alive] for c in counters]
    hits = np.unpackbits((~over).view(np.uint8).reshape(len(q), 8), axis=1, bitorder="little")
    pair, lane = np.nonzero(hits)
    i, j = q[pair], heads[w[pair]] + lane
    return i[i > j], j[i > j]


def forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest row of the component of each of ``n`` rows linked by pairs (i, j)."""
    label = np.arange(n)
    while True:
        new = label.copy()
        np.minimum.at(new, i, label[j])
        np.minimum.at(new, j, label[i])
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of (bucket, fp) rows sorted by bucket; a bucket may span batches."""
    held_b, held_v = np.zeros(0, np.int64), np.zeros(0, np.uint64)

    def emit(b, v):
        root = forest(len(v), *near(v, b))
        linked = root != np.arange(len(v))
        return pa.RecordBatch.from_arrays([pa.array(v[linked].view(np.int64)), pa.array(v[root[linked]].view(np.int64))], ["a", "b"])

    for batch in batches:
        b = np.concatenate([held_b, batch.column(0).to_numpy()])
        v = np.concatenate([held_v, batch.column(1).to_numpy().view(np.uint64)])
        keep = int(np.searchsorted(b, b[-1])) if len(b) else 0
        held_b, held_v = b[keep:], v[keep:]
        if keep:
            yield emit(b[:keep], v[:keep])
    if len(held_b):
        yield emit(held_b, held_v)


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _masks(free: list[int], kept: int = 0) -> list[int]:
    """Masks of ``kept`` with all but ``RADIUS`` of the ``BLOCKS`` blocks that the free bits are cut into."""
    edges = [len(free) * k // BLOCKS for k in range(BLOCKS + 1)]
    blocks = [sum(1 << bit for bit in free[a:b]) for a, b in zip(edges, edges[1:], strict=False)]
    return [kept | sum(c) for c in combinations(blocks, BLOCKS - RADIUS)]


#: The masks of the tables, and for each those by which the prints of a crowded bucket meet again.
MASKS = _masks(list(range(64)))
FINER_MASKS = [_masks([b for b in range(64) if not m >> b & 1], m) for m in MASKS]


def links(prints: DataFrame) -> DataFrame:
    """Links (a, b) that connect all different fingerprints within the radius, as forests of their buckets.

    A print has ten rows, and ten for each of its buckets that is crowded, so
    rows and comparisons grow with the prints however many share a bucket.
    """
    tables: list[Column] = [F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for t, m in enumerate(MASKS)]
    rows = prints.select("fp", F.explode(F.array(*tables)).alias("k")).select("fp", "k.t", F.xxhash64("k.t", "k.key").alias("bucket"))
    rows = cut(rows, "fingerprint-tables")
    counts = rows.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    finer = F.element_at(F.array(*(F.array(*(F.lit(_signed(m)) for m in masks)) for masks in FINER_MASKS)), F.col("t") + 1)
    again = F.transform(finer, lambda m, k: F.xxhash64(F.col("t"), k, F.col("fp").bitwiseAND(m)))
    met = rows.join(counts, "bucket").select("fp", F.explode(F.when(F.col("n") > PART, again).otherwise(F.array("bucket"))).alias("bucket"))
    return met.repartition("bucket").sortWithinPartitions("bucket").select("bucket", "fp").mapInArrow(_links, "a long, b long")


def _grouped(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, fp) of every row, and (fp, component_id) of every fingerprint."""
    ship(docs.sparkSession)
    prints = cut(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_fingerprints, "doc_id long, fp long"), "fingerprints")
    different = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    grouped = cut(connected_components(links(different)), "fingerprint-groups")
    members = different.join(grouped, different["fp"] == grouped["node"], "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    names = members.groupBy("component").agg(F.min("least").alias("component_id"))
    return prints, members.join(names, "component").select("fp", "component_id")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fp (as a signed long) and component_id of every document.

    Texts whose fingerprints differ in at most two bits are linked, and
    component_id is the smallest doc_id that can be reached. Null, empty and
    wordless texts have fingerprint 0 and are linked like any other. Null ids
    are never the name of a component unless it has no other. Repeated rows
    and copies share a fingerprint and so never meet as pairs. An empty table
    gives an empty result.
    """
    prints, groups = _grouped(docs)
    return prints.join(groups, "fp").select("doc_id", "fp", "component_id")


# ---------------------------------------------------------------- near copies by similarity

#: Shingle similarity of near copies, and what is asked of the sketches, whose error is about 0.035, of pairs to be compared exactly.
SIMILARITY, SKETCH_SIMILARITY = 0.8, 0.65
#: Bits in which fingerprints of near copies differ at most: up to 12 on average at that similarity (sets of 4 and 5), with a deviation of 3.
WIDE_RADIUS = 26
WIDE_SHINGLE, HASHES, BANDS, BAND = 5, 128, 20, 4
_MULTIPLIERS = np.random.default_rng(SEED).integers(0, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_hashes(text: str | None) -> np.ndarray:
    """Different hashes of the 5-word shingles of a whole text, sorted; none without words."""
    from xxhash import xxh64_intdigest

    w = (text or "").encode().lower().split()
    if not w:
        return np.zeros(0, np.uint64)
    shingles = map(b" ".join, zip(*(w[k:] for k in range(WIDE_SHINGLE)), strict=False)) if len(w) >= WIDE_SHINGLE else [b" ".join(w)]
    return np.unique(np.fromiter(map(xxh64_intdigest, shingles, repeat(SEED)), np.uint64, max(1, len(w) - WIDE_SHINGLE + 1)))


def sketch(h: np.ndarray) -> tuple[int, np.ndarray]:
    """64-bit SimHash of different shingle hashes, and the least of each of 128 hashes of them (all ones without words)."""
    n = len(h)
    if not n:
        return 0, np.full(HASHES, ~np.uint64(0))
    bits = np.unpackbits(h.view(np.uint8).reshape(n, 8), axis=1, bitorder="little")
    print_ = int(np.packbits(2 * bits.sum(axis=0, dtype=np.int64) > n, bitorder="little").view(np.uint64)[0])
    least = np.full(HASHES, ~np.uint64(0))
    for low in range(0, n, 1024):
        mixed = h[low : low + 1024, None] * _MULTIPLIERS
        np.minimum(least, (mixed ^ mixed >> np.uint64(31)).min(axis=0), out=least)
    return print_, least


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, doc_id, item, fp, sketch, bands): an item is named by its set of shingles; a band joins four hashes."""
    from xxhash import xxh64_intdigest

    for batch in batches:
        items, prints, sketches, bands = [], [], [], []
        for text in batch.column(2).to_pylist():
            h = shingle_hashes(text)
            fp, least = sketch(h)
            small = least.astype(np.uint16).tobytes()
            items.append(xxh64_intdigest(h.tobytes(), SEED))
            prints.append(fp)
            sketches.append(small)
            bands.append([xxh64_intdigest(least[BAND * k : BAND * (k + 1)].tobytes(), k) for k in range(BANDS)])
        bands_ = pa.ListArray.from_arrays(np.arange(0, BANDS * len(items) + 1, BANDS, dtype=np.int32), pa.array(np.array(bands, np.uint64).reshape(-1).view(np.int64)))
        numbers = [pa.array(np.array(x, np.uint64).view(np.int64)) for x in (items, prints)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *numbers, pa.array(sketches, pa.binary()), bands_], ["key", "doc_id", "item", "fp", "sketch", "bands"])


def _similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of (bucket, item, fp, sketch) rows sorted by bucket: near prints whose sketches agree, as forests."""

    def emit(t: pa.Table) -> pa.RecordBatch:
        b, item, fp = (t.column(k).to_numpy() for k in range(3))
        s = np.frombuffer(b"".join(t.column(3).to_pylist()), np.uint16).reshape(-1, HASHES)
        i, j = near(fp.view(np.uint64), b, WIDE_RADIUS)
        good = [np.flatnonzero((s[i[k : k + 50_000]] == s[j[k : k + 50_000]]).mean(axis=1) >= SKETCH_SIMILARITY) + k for k in range(0, len(i), 50_000)]
        good = np.concatenate(good) if good else np.zeros(0, np.int64)
        root = forest(len(b), i[good], j[good])
        linked = root != np.arange(len(b))
        return pa.RecordBatch.from_arrays([pa.array(item[linked]), pa.array(item[root[linked]])], ["a", "b"])

    return map(emit, _whole_buckets(batches))


def _whole_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows sorted by their first column, in tables that cut no bucket."""
    held: pa.Table | None = None
    for batch in batches:
        t = pa.Table.from_batches([batch])
        held = t if held is None else pa.concat_tables([held, t])
        buckets = held.column(0).to_numpy()
        keep = int(np.searchsorted(buckets, buckets[-1])) if len(buckets) else 0
        if keep:
            yield held.slice(0, keep)
            held = held.slice(keep)
    if held is not None and held.num_rows:
        yield held


def similar_sets(sets: list[np.ndarray]) -> np.ndarray:
    """Smallest row of the component of each of the sets, linked at a Jaccard similarity of 0.8 or more, counted exactly.

    A set is compared with all later ones at once, other than those it is
    already linked with and those whose size rules the similarity out.
    """
    sizes, label = np.array([len(x) for x in sets]), np.arange(len(sets))
    names = np.unique(np.concatenate(sets), return_inverse=True)[1]
    own = np.split(names, np.cumsum(sizes)[:-1])
    mine = np.zeros(len(names), bool)
    for i in range(len(sets)):
        j = np.flatnonzero(label[i + 1 :] != label[i]) + i + 1
        j = j[np.minimum(sizes[j], sizes[i]) / np.maximum(np.maximum(sizes[j], sizes[i]), 1) >= SIMILARITY]
        if len(j):
            mine[own[i]] = True
            shared = np.add.reduceat(mine[np.concatenate([own[k] for k in j])], np.r_[0, np.cumsum(sizes[j])[:-1]], dtype=np.int64)
            mine[own[i]] = False
            joined = np.r_[label[i], label[j[shared / (sizes[i] + sizes[j] - shared) >= SIMILARITY]]]
            label[np.isin(label, joined)] = joined.min()
    return label


def _hash_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(item, hashes) of (item, text): the different shingle hashes, as bytes."""
    for batch in batches:
        hashes = [shingle_hashes(t).tobytes() for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(hashes, pa.binary())], ["item", "hashes"])


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of (bucket, item, hashes) rows sorted by bucket: items of one bucket that are similar, as forests."""
    for t in _whole_buckets(batches):
        b, item = t.column(0).to_numpy(), t.column(1).to_numpy()
        sets = [np.frombuffer(x, np.uint64) for x in t.column(2).to_pylist()]
        edges = np.r_[np.flatnonzero(np.r_[True, b[1:] != b[:-1]]), len(b)]
        root = np.concatenate([similar_sets(sets[low:high]) + low for low, high in zip(edges, edges[1:], strict=False)])
        linked = root != np.arange(len(b))
        yield pa.RecordBatch.from_arrays([pa.array(item[linked]), pa.array(item[root[linked]])], ["a", "b"])


def _settled(rows: DataFrame, name: str, compared: Callable[[DataFrame], DataFrame], what: str) -> DataFrame:
    """(node, component) of different rows (bucket, name); ``compared`` gives the links (a, b) within buckets of a few parts.

    A bucket of one part is compared as it is. Of a larger one every part first
    meets the first part alone, which links the members of large families. Two
    members of one component need not meet again, so the largest component of
    the bucket then meets only the rows outside it: a family of any size costs
    work in proportion to its size, and every pair of different components is
    still compared.
    """
    rows = cut(rows, what)
    counts = rows.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    sizes = cut(counts.select("bucket", F.ceil(F.col("n") / PART).cast("int").alias("parts")), what)

    def place(parts: str) -> Column:
        return F.pmod(F.xxhash64(name), F.col(parts)).cast("int")

    parts = F.when(place("parts") == 0, F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.array(place("parts")))
    first = rows.join(sizes, "bucket").select(name, "bucket", F.explode(parts).alias("part")).select(F.xxhash64("bucket", "part").alias("bucket"), name)
    found = cut(connected_components(compared(first)), what)
    crowded = sizes.where("parts > 1").select("bucket")
    if not crowded.isEmpty():
        joined = rows.join(crowded, "bucket").join(found, F.col(name) == F.col("node"), "left")
        named = cut(joined.select("bucket", name, F.coalesce("component", name).alias("family")), what)
        families = named.groupBy("bucket", "family").agg(F.count("*").alias("n")).groupBy("bucket").agg(F.max(F.struct("n", "family")).alias("main"), F.sum("n").alias("n"))
        others = F.ceil((F.col("n") - F.col("main.n")) / PART).cast("int").alias("others")
        main = cut(families.select("bucket", F.col("main.family").alias("main"), others, F.ceil(F.col("main.n") / PART).cast("int").alias("mains")).where("others > 0"), what)
        inside = F.col("family") == F.col("main")
        if not main.isEmpty():
            met = named.join(main, "bucket").select(
                name, "bucket", F.when(inside, F.col("others") + place("mains")).otherwise(place("others")).alias("i"),
                F.explode(F.sequence(F.lit(0), F.col("others") - 1 + F.when(inside, 0).otherwise(F.col("mains")))).alias("j"),
            )
            again = compared(met.select(F.xxhash64("bucket", F.least("i", "j"), F.greatest("i", "j")).alias("bucket"), name))
            old, found = found, cut(connected_components(again.unionByName(found.select(F.col("node").alias("a"), F.col("component").alias("b")))), what)
            discard(old)
        discard(named, main)
    discard(rows, sizes)
    return found


def _sets(docs: DataFrame, items: DataFrame, maybe: DataFrame) -> DataFrame:
    """(item, hashes) of all items of ``maybe``, from one of the texts of each."""
    wanted = items.join(maybe, items["item"] == maybe["node"]).groupBy("item").agg(F.min("key").alias("wanted_key"))
    texts = docs.select(row_name("doc_id", "text").alias("wanted_key"), "text").join(wanted, "wanted_key").select("item", "text")
    return cut(texts.dropDuplicates(["item"]).mapInArrow(_hash_sets, "item long, hashes binary"), "shingles")


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, one of each group of near copies: that of the smallest doc_id (null last; ties: any fixed one).

    Near copies have 5-word shingle similarity of 0.8 or more. At that
    similarity fingerprints differ in too many bits for whole blocks of them to
    agree, so texts meet by bands of four minimal shingle hashes (twenty bands
    miss a pair at 0.8 in 1 of 38,000, and let one at 0.3 meet in 1 of 7); the bit-sliced comparison then finds
    near fingerprints, and sketches of 128 minimal hashes that agree in 0.65
    join texts to groups. These only say who may be alike: within a group the
    sets of shingle hashes are compared exactly, other than those already linked
    (see ``_settled``), and links of 0.8 decide. Texts
    without words are copies of each other. Rows keep all their columns, of
    whatever name; of rows with equal doc_id and text one stays; an empty table
    gives an empty one.
    """
    ship(docs.sparkSession)
    rows = docs.select(row_name("doc_id", "text").alias("key"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    items = cut(rows.mapInArrow(_sketches, "key string, doc_id long, item long, fp long, sketch binary, bands array<long>"), "sketches")
    info = items.groupBy("item").agg(F.min("fp").alias("fp"), F.min("sketch").alias("sketch"))

    def alike(met: DataFrame) -> DataFrame:
        return met.join(info, "item").select("bucket", "item", "fp", "sketch").repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_similar, "a long, b long")

    maybe = _settled(items.select("item", F.explode("bands").alias("bucket")).distinct(), "item", alike, "maybe-groups")
    sets = _sets(docs, items, maybe)

    def similar(met: DataFrame) -> DataFrame:
        return met.join(sets, "item").select("bucket", "item", "hashes").repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_verified, "a long, b long")

    grouped = _settled(maybe.select(F.col("node").alias("item"), F.col("component").alias("bucket")), "item", similar, "copy-groups")
    discard(maybe, sets)
    named = items.select("key", "doc_id", "item").join(grouped, items["item"] == grouped["node"], "left").withColumn("component", F.coalesce("component", "item"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "key")).alias("first")
    chosen = named.groupBy("component").agg(first).select(F.col("first.key").alias("name"))
    met = docs.select(F.struct("*").alias("row"), row_name("doc_id", "text").alias("name"), F.col("doc_id").alias("id")).join(chosen, "name")
    return met.withColumn("place", F.row_number().over(W.partitionBy("name").orderBy("id"))).where("place = 1").select("row.*")


def op6_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
