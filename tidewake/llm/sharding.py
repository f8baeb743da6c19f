"""Sharding by best-fit-decreasing bin packing of indivisible groups (operator 10).

A group is all documents of one text. Groups of one size are interchangeable, so
the driver packs the histogram of sizes instead of the groups: a size's groups
enter the tightest bin as a run, until it has no room for one more. Sizes of
more than ``DIGITS`` binary digits share a class with those of equal leading
digits, and a class is packed at its mean, so the histogram has at most 2^13
rows for each binary digit of the largest size (below 300,000 rows up to a
petabyte) whatever the corpus. Groups then take the places of their class by
their rank within it, which is counted over all tasks.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewake.llm.common import cut, in_order, places, table

#: Sizes of up to so many binary digits are packed exactly, larger ones by their leading digits (to 1 in 8,192).
DIGITS = 14
#: Groups of over this share of all rows get their shard from a broadcast table (of fewer rows than this number), so that no join deals such a group to one task.
HOT = 4096
#: A size class's groups and the runs (shard, number of groups) that they fill, in order.
Run = tuple[int, int]


class CapacityTree:
    """Balanced (AA) tree of (remaining capacity, bin), for best-fit lookups in logarithmic time."""

    class _Node:
        __slots__ = ("key", "left", "level", "right")

        def __init__(self, key):
            self.key, self.level, self.left, self.right = key, 1, None, None

    def __init__(self) -> None:
        self._root = None

    @staticmethod
    def _skew(n):
        if n and n.left and n.left.level == n.level:
            child = n.left
            n.left, child.right = child.right, n
            return child
        return n

    @staticmethod
    def _split(n):
        if n and n.right and n.right.right and n.right.right.level == n.level:
            child = n.right
            n.right, child.left = child.left, n
            child.level += 1
            return child
        return n

    def insert(self, key) -> None:
        def put(n):
            if n is None:
                return self._Node(key)
            if key < n.key:
                n.left = put(n.left)
            else:
                n.right = put(n.right)
            return self._split(self._skew(n))

        self._root = put(self._root)

    def remove(self, key) -> None:
        def level(n):
            return n.level if n else 0

        def take(n, key):
            if n is None:
                return None
            if key < n.key:
                n.left = take(n.left, key)
            elif n.key < key:
                n.right = take(n.right, key)
            elif n.left is None and n.right is None:
                return None
            elif n.left is None:
                heir = n.right
                while heir.left:
                    heir = heir.left
                n.key = heir.key
                n.right = take(n.right, heir.key)
            else:
                heir = n.left
                while heir.right:
                    heir = heir.right
                n.key = heir.key
                n.left = take(n.left, heir.key)
            should = min(level(n.left), level(n.right)) + 1
            if should < n.level:
                n.level = should
                if n.right and n.right.level > should:
                    n.right.level = should
            n = self._skew(n)
            n.right = self._skew(n.right)
            if n.right:
                n.right.right = self._skew(n.right.right)
            n = self._split(n)
            n.right = self._split(n.right)
            return n

        self._root = take(self._root, key)

    def at_least(self, size):
        """The smallest key whose remaining capacity is ``size`` or more; None if there is none."""
        n, best = self._root, None
        while n:
            if n.key[0] >= size:
                best, n = n.key, n.left
            else:
                n = n.right
        return best


def best_fit_decreasing(sizes: Iterable[tuple[int, int]], capacity: int, max_bins: int | None = None) -> dict[int, list[Run]] | None:
    """Runs (bin, number of items) of each size of a histogram (size, number of items), largest first, each item into the bin it fits most tightly.

    The tightest bin stays the tightest while it has room for items of the same
    size, so they enter it as one run. A bin is opened only when no open one has
    room, which keeps their number low. Ties go to the lower bin. None if more
    than ``max_bins`` are needed or an item exceeds the capacity.
    """
    tree, bins, runs = CapacityTree(), 0, {}
    for size, left in sorted(sizes, reverse=True):
        if size > capacity:
            return None
        runs[size] = []
        while left:
            room = tree.at_least(size)
            if room is None:
                if max_bins is not None and bins == max_bins:
                    return None
                room, bins = (capacity, bins), bins + 1
            else:
                tree.remove(room)
            n = min(left, room[0] // size)
            tree.insert((room[0] - n * size, room[1]))
            runs[size].append((room[1], n))
            left -= n
    return runs


def pack(sizes: list[tuple[int, int]], n_shards: int) -> dict[int, list[Run]]:
    """Best-fit-decreasing of a histogram under the smallest capacity found (to 1/10,000 of a shard) that needs ``n_shards`` bins at most."""
    total = sum(s * n for s, n in sizes)
    low = max([-(-total // n_shards), *(s for s, _ in sizes)])
    found = best_fit_decreasing(sizes, low, n_shards)
    if found is not None:
        return found
    high, step = low, max(1, low // 10_000)
    while (found := best_fit_decreasing(sizes, high, n_shards)) is None:
        low, high = high, high + step
        step *= 2
    while high - low > max(1, low // 10_000):
        middle = (low + high) // 2
        packed = best_fit_decreasing(sizes, middle, n_shards)
        if packed is None:
            low = middle
        else:
            high, found = middle, packed
    return found


def size_class(size: Column) -> Column:
    """The smallest size with the same leading ``DIGITS`` binary digits and as many digits in all."""
    shift = F.greatest(F.length(F.bin(size)) - DIGITS, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", size, shift), shift)


def shard_documents(docs: DataFrame, n_shards: int = 16, n_ranges: int = 1024) -> DataFrame:
    """Put every document into one of ``n_shards`` shards of near-equal bytes; documents of equal text stay together.

    Returns doc_id, size (UTF-8 bytes plus 1), text_crc32, law, shard, slot and
    grown_shard (null, as the law is ``bytes``). Null texts form one group of
    their own with size 1 and checksum 0, apart from empty texts. Repeated rows
    each take a slot. A null doc_id sorts first. An empty table gives an empty
    result. Other columns are ignored. Very long texts are only measured and
    hashed. Groups of equal size are told apart by their digests, so reruns
    agree. Slots count documents of a shard by (hash range of doc_id, doc_id),
    so no task numbers a whole shard.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = cut(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            (F.octet_length(text) + 1).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.coalesce(F.md5(F.col("text").cast("binary")), F.lit("-")).alias("group"),
        ),
        "shard-rows",
    )
    groups = rows.groupBy("group").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")).withColumn("class", size_class(F.col("bytes")))
    ranked = in_order(groups, ["class", "bytes", "group"], "shard-groups")
    histogram = ranked.groupBy("class").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"), F.sum("rows").alias("rows")).collect()
    means = [(r["class"], -(-r["bytes"] // r["n"]), r["n"]) for r in histogram]
    packed = pack([(mean, n) for _, mean, n in means], n_shards)
    ends = []
    for name, mean, _ in means:
        end, of = 0, []
        for shard, n in packed[mean]:
            end += n
            of.append((end, shard))
        ends.append((name, of))
    runs = spark.createDataFrame(ends, "class long, runs array<struct<end: long, shard: int>>")
    shard = F.element_at(F.filter("runs", lambda r: r["end"] > F.col("place")), 1)["shard"]
    homes = cut(places(ranked, ["class"]).join(F.broadcast(runs), "class").select("group", "rows", shard.alias("shard")), "shard-homes")
    n_rows = sum(r["rows"] for r in histogram)
    hot = homes.where(F.col("rows") > n_rows // HOT).select("group", "shard")
    cold = homes.where(F.col("rows") <= n_rows // HOT).select("group", "shard")
    named = rows.join(F.broadcast(hot), "group").unionByName(rows.join(F.broadcast(hot), "group", "left_anti").join(cold, "group"))
    placed = named.select("doc_id", "size", "text_crc32", "shard", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(n_ranges)).cast("int").alias("range"))
    before = W.partitionBy("shard").orderBy("range")
    counts = placed.groupBy("shard", "range").agg(F.count("*").alias("n"))
    offsets = counts.select("shard", "range", (F.sum("n").over(before) - F.col("n")).alias("offset"))
    here = W.partitionBy("shard", "range").orderBy("doc_id", "size", "text_crc32")
    return (
        placed.withColumn("rank", F.row_number().over(here))
        .join(F.broadcast(offsets), ["shard", "range"])
        .select(
            "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
            (F.col("offset") + F.col("rank") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
        )
    )


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"))
