"""Mixing sources to target weights by a low-discrepancy schedule (operator 4).

Every source's documents are shuffled by a hash and laid end to end as one
line of words. Slots of the
mix are golden-ratio points (Fibonacci hashing in 32-bit fixed point, so both
ends of a comparison are integers); the cumulative target shares map each
point to a source, and the r-th slot of a source takes its r-th block, round
after round over the line. A source's target is cut into equal blocks, one for
each of its slots, so every source meets its target to a word, however few
slots it has; a source that no point falls to gets one slot. Because the points
have low discrepancy, blocks of all sources are about as long, and any prefix
of the schedule holds the target mix.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewake.llm.common import cut, row_name, table, words

#: 2**32 divided by the golden ratio, odd.
GOLDEN = 2_654_435_769
SPAN = 1 << 32
CELL_BITS = 20


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_repeats: int = 3) -> DataFrame:
    """One row per source: sid (rank by code point, null last), source_size, target, and bounds of its share of the points.

    The water-filling of the repeat limit is solved in closed form: sources
    saturate in order of limit / weight. The table has one row per source, so
    its windows without partition see sources, never documents.
    """
    by_name, by_ratio = W.orderBy(F.col("source").asc_nulls_last()), W.orderBy("ratio", "sid")
    earlier, later = by_ratio.rowsBetween(W.unboundedPreceding, -1), by_ratio.rowsBetween(0, W.unboundedFollowing)
    everything = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    s = sizes.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("sid", F.row_number().over(by_name))
    weight = F.element_at(F.array(*map(F.lit, weights)), F.pmod(F.col("sid") - 1, F.lit(len(weights))).cast("int") + 1)
    s = s.withColumns({"weight": weight.cast("long"), "limit": F.col("source_size") * max_repeats})
    s = s.withColumns({"ratio": F.col("limit") / F.col("weight"), "total": F.sum("source_size").over(everything)})
    s = s.withColumns({"used": F.coalesce(F.sum("limit").over(earlier), F.lit(0)), "left": F.sum("weight").over(later)})
    s = s.withColumn("full", F.col("limit") * F.col("left") <= (F.col("total") - F.col("used")) * F.col("weight"))
    s = s.withColumns({
        "spent": F.coalesce(F.sum(F.when(F.col("full"), F.col("limit"))).over(everything), F.lit(0)),
        "open": F.sum(F.when(~F.col("full"), F.col("weight"))).over(everything),
    })
    share = ((F.col("total") - F.col("spent")) * F.col("weight")).cast("double") / F.col("open")
    s = s.withColumn("target", F.when(F.col("full"), F.col("limit").cast("double")).otherwise(share))
    up_to = F.sum("target").over(W.orderBy("sid").rowsBetween(W.unboundedPreceding, 0))
    high = F.least(F.lit(SPAN), F.floor(F.try_divide(up_to, F.col("total").cast("double")) * SPAN))
    s = s.withColumn("high", high.cast("long"))
    return s.select("sid", "source", "source_size", "target", "total", F.coalesce(F.lag("high").over(W.orderBy("sid")), F.lit(0)).alias("low"), "high")


def schedule(sources: DataFrame, n_slots: int) -> DataFrame:
    """The slots of the mix: slot, sid, rank among the source's slots and their number (``slots``).

    Points meet shares by an equality join on cells of the point range. Slots
    of one source are ranked in chunks of consecutive slots, so a source with
    most of the mix is not ranked in one task. A source with a target that no
    point falls to has one slot without a place in the order (null).
    """
    cells = sources.where("high > low").select(
        "*", F.explode(F.sequence(F.shiftright("low", CELL_BITS), F.shiftright(F.col("high") - 1, CELL_BITS))).alias("cell")
    )
    slots = sources.sparkSession.range(n_slots).select(F.col("id").alias("slot"), F.pmod(F.col("id") * F.lit(GOLDEN), F.lit(SPAN)).alias("point"))
    slots = slots.withColumns({"cell": F.shiftright("point", CELL_BITS), "chunk": F.shiftright("slot", 12)})
    slots = slots.join(cells, "cell").where("point >= low AND point < high").select("slot", "chunk", "sid")
    counts = slots.groupBy("sid", "chunk").agg(F.count("*").alias("n"))
    offsets = counts.select("sid", "chunk", (F.sum("n").over(W.partitionBy("sid").orderBy("chunk")) - F.col("n")).alias("offset"), F.sum("n").over(W.partitionBy("sid")).alias("slots"))
    here = W.partitionBy("sid", "chunk").orderBy("slot")
    ranked = slots.withColumn("rank", F.row_number().over(here)).join(offsets, ["sid", "chunk"]).select("slot", "sid", (F.col("offset") + F.col("rank") - 1).alias("rank"), "slots")
    missed = sources.where("target >= 1").join(counts.select("sid").distinct(), "sid", "left_anti")
    return ranked.unionByName(missed.select(F.lit(None).cast("long").alias("slot"), "sid", F.lit(0).cast("long").alias("rank"), F.lit(1).cast("long").alias("slots")))


def _blocks(slots: DataFrame, sources: DataFrame) -> DataFrame:
    """(sid, cell, takes): the stretches (from, to) of a source's line that its slots take within a cell of the line, at most a few a round.

    The r-th of n slots takes the r-th n-th of the target's words, counted round
    after round over the line; the first ones take the word more that division
    leaves. A cell is as long as a block, so a stretch lies in two at most.
    """
    t = slots.join(sources.select("sid", "source_size", F.floor("target").cast("long").alias("words")), "sid").where("words > 0")
    t = t.withColumns({"each": F.expr("words div slots"), "more": F.col("words") % F.col("slots")})

    def edge(rank: Column) -> Column:
        return rank * F.col("each") + F.least(rank, F.col("more"))

    t = t.withColumns({"a": edge(F.col("rank")), "b": edge(F.col("rank") + 1), "width": _width(F.col("each"), F.col("more"))}).where("b > a")
    t = t.withColumn("round", F.explode(F.expr("sequence(a div source_size, (b - 1) div source_size)")))
    origin = F.col("round") * F.col("source_size")
    t = t.withColumns({"a": F.greatest(F.col("a") - origin, F.lit(0)), "b": F.least(F.col("b") - origin, F.col("source_size"))})
    t = t.withColumn("cell", F.explode(F.expr("sequence(a div width, (b - 1) div width)")))
    return t.groupBy("sid", "cell").agg(F.collect_list(F.struct("a", "b")).alias("takes"))


def _width(each: Column, more: Column) -> Column:
    """Length of a source's longest block."""
    return each + (more > 0).cast("long")


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_repeats: int = 3, max_slots: int = 1 << 20, name: Column | None = None) -> DataFrame:
    """Words that the mix takes from each document: doc_id, source, size, source_size, target, taken.

    The mix has as many words as the corpus. The schedule has ``max_slots``
    rows at most, at any corpus size, and one for each source that gets none of
    them; a block has about ``ceil(all words / max_slots)`` words. Every source
    meets its target to a word. No document is taken more than ``max_repeats`` times.
    Null and empty texts have size 0 and give nothing; a null source is a
    source of its own; repeated rows are documents of their own; an empty
    table gives an empty result. Reruns agree, since the shuffle is a hash of
    doc_id (ties: doc_id, size). ``name`` may stand in for doc_id.
    """
    by_row = ["doc_id", "source", "size"]
    sizes = cut(
        docs.select((F.col("doc_id").cast("long") if name is None else name).alias("doc_id"), F.col("source").cast("string").alias("source"), F.size(words(F.col("text"))).cast("long").alias("size")),
        "mix-sizes",
    )
    sources = cut(source_targets(sizes, weights, max_repeats), "mix-sources")
    total = sources.agg(F.coalesce(F.max("total"), F.lit(0)).alias("n")).first()["n"]
    block = max(1, -(-total // max_slots))
    slots = cut(schedule(sources, -(-total // block)), "mix-slots")
    takes = _blocks(slots, sources)
    per = slots.groupBy("sid").agg(F.max("slots").alias("slots"))
    words_ = F.floor("target").cast("long")
    blocks = sources.join(per, "sid", "left").withColumns({"each": F.expr("CAST(floor(target) AS BIGINT) div slots"), "more": words_ % F.col("slots")})
    blocks = blocks.select("source", "sid", "source_size", "target", F.greatest(F.coalesce(_width(F.col("each"), F.col("more")), F.lit(1)), F.lit(1)).alias("width"))

    line = sizes.join(blocks, sizes["source"].eqNullSafe(blocks["source"]), "left").drop(blocks["source"])
    line = line.withColumn("order", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")))
    line = line.withColumn("bin", F.substring("order", 1, 3))
    bins = line.groupBy("sid", "bin").agg(F.sum("size").alias("n"))
    offsets = bins.select("sid", "bin", (F.sum("n").over(W.partitionBy("sid").orderBy("bin")) - F.col("n")).alias("offset"))
    so_far = F.sum("size").over(W.partitionBy("sid", "bin").orderBy("order", "doc_id", "size").rowsBetween(W.unboundedPreceding, 0))
    line = line.withColumn("so_far", so_far).join(offsets, ["sid", "bin"])
    line = line.withColumn("start", F.col("offset") + F.col("so_far") - F.col("size"))

    kept = ["sid", *by_row, "source_size", "target", "start"]
    cells = F.expr("sequence(start div width, (start + size - 1) div width)")
    pieces = line.where("size > 0").select(*kept, "width", F.explode(cells).alias("cell"))
    low, high = F.greatest(F.col("start"), F.col("cell") * F.col("width")), F.least(F.col("start") + F.col("size"), (F.col("cell") + 1) * F.col("width"))
    pieces = pieces.withColumns({"low": low, "high": high}).join(takes, ["sid", "cell"], "left")
    overlap = F.aggregate(F.coalesce("takes", F.array()), F.lit(0).cast("long"), lambda n, t: n + F.greatest(F.least(t["b"], F.col("high")) - F.greatest(t["a"], F.col("low")), F.lit(0)))
    taken = pieces.groupBy(*kept).agg(F.sum(overlap).alias("taken"))
    nothing = line.where("size = 0").select(*kept, F.lit(0).cast("long").alias("taken"))
    return taken.unionByName(nothing).select(*by_row, "source_size", "target", "taken")


def mixed(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` as the mix takes them: each as often as its words are taken, rounded; not at all below half.

    Rows keep all their columns, of whatever name. Rows of equal doc_id, text
    and source are taken together: one of them stands for all, as often as all
    are taken. Texts without words are never taken; an empty table gives an
    empty one.
    """
    name = row_name("doc_id", "text", "source")
    copies = mix(docs, name=name).where("taken > 0")
    copies = copies.groupBy(F.col("doc_id").alias("name")).agg(F.sum(F.round(F.col("taken") / F.col("size"))).cast("int").alias("copies")).where("copies > 0")
    one = docs.select(F.struct("*").alias("row"), name.alias("name")).join(copies, "name")
    first = F.row_number().over(W.partitionBy("name").orderBy(F.lit(1)))
    return one.withColumn("place", first).where("place = 1").select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")


def op4_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


OP4_SQL = r"""
WITH sizes AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents
), s0 AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS sid FROM sizes GROUP BY source
), s1 AS (
  SELECT *, (sid - 1) % 3 + 1 AS weight, source_size * 3 AS lim, CAST(sum(source_size) OVER () AS BIGINT) AS total FROM s0
), s2 AS (
  SELECT *, coalesce(sum(lim) OVER (ORDER BY lim / weight, sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used,
         sum(weight) OVER (ORDER BY lim / weight, sid ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest FROM s1
), s3 AS (SELECT *, lim * rest <= (total - used) * weight AS is_full FROM s2),
s4 AS (
  SELECT *, coalesce(sum(CASE WHEN is_full THEN lim END) OVER (), 0) AS spent, sum(CASE WHEN NOT is_full THEN weight END) OVER () AS wide FROM s3
), s5 AS (
  SELECT *, CASE WHEN is_full THEN CAST(lim AS DOUBLE) ELSE CAST((total - spent) * weight AS DOUBLE) / CAST(wide AS DOUBLE) END AS target FROM s4
), s6 AS (
  SELECT *, CAST(least(4294967296, floor(sum(target) OVER (ORDER BY sid) / CAST(total AS DOUBLE) * 4294967296)) AS BIGINT) AS high FROM s5
), s AS (
  SELECT *, coalesce(lag(high) OVER (ORDER BY sid), 0) AS low, CAST(floor(target) AS BIGINT) AS words,
         greatest(1, (total + 1048575) // 1048576) AS block FROM s6
), slots AS (
  SELECT slot, (slot * 2654435769) % 4294967296 AS point
  FROM (SELECT unnest(range((SELECT (max(total) + max(block) - 1) // max(block) FROM s))) AS slot)
), hits AS (
  SELECT sid, row_number() OVER (PARTITION BY sid ORDER BY slot) - 1 AS r, count(*) OVER (PARTITION BY sid) AS k FROM slots JOIN s ON point >= low AND point < high
), ranked AS (
  SELECT * FROM hits UNION ALL SELECT sid, 0, 1 FROM s WHERE words > 0 AND sid NOT IN (SELECT sid FROM hits)
), cut AS (
  SELECT sid, source_size, r * (words // k) + least(r, words % k) AS a, (r + 1) * (words // k) + least(r + 1, words % k) AS b FROM ranked JOIN s USING (sid) WHERE words > 0
), rounds AS (SELECT *, unnest(range(a // source_size, (b - 1) // source_size + 1)) AS round FROM cut WHERE b > a),
takes AS (
  SELECT sid, greatest(a - round * source_size, 0) AS a, least(b - round * source_size, source_size) AS b FROM rounds
), taken_cells AS (SELECT *, unnest(range(a // 256, (b - 1) // 256 + 1)) AS cell FROM takes),
line AS (
  SELECT d.*, s.sid, s.source_size, s.target,
         CAST(sum(d.size) OVER (PARTITION BY s.sid ORDER BY md5(CAST(d.doc_id AS VARCHAR)), d.doc_id, d.size ROWS UNBOUNDED PRECEDING) - d.size AS BIGINT) AS start
  FROM sizes d JOIN s ON d.source IS NOT DISTINCT FROM s.source
), pieces AS (
  SELECT *, unnest(range(start // 256, (start + size - 1) // 256 + 1)) AS cell FROM line WHERE size > 0
)
SELECT p.doc_id, p.size, p.source_size, p.target,
       CAST(coalesce(sum(greatest(least(p.start + p.size, t.b, (p.cell + 1) * 256) - greatest(p.start, t.a, p.cell * 256), 0)) FILTER (t.sid IS NOT NULL), 0) AS BIGINT) AS taken
FROM pieces p LEFT JOIN taken_cells t ON t.sid = p.sid AND t.cell = p.cell GROUP BY p.sid, p.doc_id, p.size, p.source_size, p.target, p.start
UNION ALL
SELECT doc_id, size, source_size, target, 0 FROM line WHERE size = 0
"""
