"""Port visits from positions: islands of equal eligible ports, scanned by vessel and day."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewake.functions.expressions import MAX_MMSI, haversine_m, visit_id
from tidewake.operators.joins import port_circles, ports_within_radius
from tidewake.operators.segments import DAY_MICROS, across, inside, segment_of
from tidewake.operators.versioned import latest_by_key
from tidewake.shared import written

#: Speeds outside [0, this) are no reports.
NO_SPEED_KN = 102.3


def valid_positions(df: DataFrame) -> DataFrame:
    """Positions with a possible identity, time and place; impossible speeds become null."""
    ok = F.col("mmsi").between(1, MAX_MMSI) & F.col("msgtime").isNotNull() & F.col("latitude").between(-90, 90) & F.col("longitude").between(-180, 180)
    speed = F.col("speed_over_ground")
    return df.where(ok).withColumn("speed_over_ground", F.when((speed >= 0) & (speed < NO_SPEED_KN), speed))


def collapse_positions(df: DataFrame) -> DataFrame:
    """One observation per vessel and time with its number of ``rows``; differing ones become one whose place and speed are unknown (``conflict``)."""
    keys, seen = _keys(df), F.struct("latitude", "longitude", "speed_over_ground")
    one = df.groupBy(*keys).agg(F.min(seen).alias("low"), F.max(seen).alias("high"), F.count("*").alias("rows"))
    conflict = ~F.col("low").eqNullSafe(F.col("high"))
    known = F.when(~conflict, F.col("low"))
    return one.select(*keys, *(known[c].alias(c) for c in ("latitude", "longitude", "speed_over_ground")), conflict.alias("conflict"), "rows")


def assign_ports(observations: DataFrame, ports: DataFrame, max_speed: float = 3.0) -> DataFrame:
    """Each observation with the number of ports around it (``n_inside``), the nearest (ties: smaller id), and that one if it is slow (``eligible``).

    Ports of one circle are met as one, and no observation carries a list of
    ports, so rows do not grow with the number of ports.
    """
    keys = _keys(observations)
    met = ports_within_radius(observations, port_circles(ports), carried=("ports",), how="left")
    nearest = F.min(F.when(F.col("port_id").isNotNull(), F.struct("distance_m", "port_id")))["port_id"]
    others = [c for c in observations.columns if c not in keys]
    out = met.groupBy(*keys).agg(*(F.any_value(c).alias(c) for c in others), nearest.alias("nearest"), F.coalesce(F.sum("ports"), F.lit(0)).alias("n_inside"))
    return out.withColumn("eligible", F.when(F.col("speed_over_ground") <= max_speed, F.col("nearest")))


def _keys(df: DataFrame) -> list[str]:
    """What an observation is known by; the day stands before the time where rows have been dealt by it."""
    return ["mmsi", "segment", "msgtime"] if "segment" in df.columns else ["mmsi", "msgtime"]


def _observations(positions: DataFrame, version: list[str]) -> DataFrame:
    """Valid positions as observations, dealt by vessel and day once: versions, ports and islands are then found without moving or sorting rows again."""
    needed = ["mmsi", "msgtime", "latitude", "longitude", "speed_over_ground"]
    p = positions.select(*needed, *(c for c in version if c not in needed)).withColumn("segment", segment_of("msgtime")).repartition("mmsi", "segment")
    return collapse_positions(valid_positions(latest_by_key(p, _keys(p), version) if version else p))


def _seconds(start: Column, end: Column) -> Column:
    return (F.unix_micros(end) - F.unix_micros(start)) / 1e6


def _breaks(before: Column, here: Column, max_gap: float) -> Column:
    """Whether an island ends between two neighbours: after a gap, or where the eligible port changes."""
    return F.coalesce(_seconds(before["msgtime"], here["msgtime"]) > max_gap, F.lit(False)) | ~before["eligible"].eqNullSafe(here["eligible"])


def _runs(events: DataFrame, max_gap: float, carry: tuple[str, ...] = ()) -> DataFrame:
    """Observations with their neighbours and their island's number within the vessel's day, from 0."""
    day = inside("mmsi", "msgtime")
    e = events if "segment" in events.columns else events.withColumn("segment", segment_of("msgtime"))
    e = e.withColumn("here", F.struct("msgtime", "eligible", *carry))
    e = e.withColumns({"before": F.lag("here").over(day), "after": F.lead("here").over(day)})
    fresh = F.col("before").isNotNull() & _breaks(F.col("before"), F.col("here"), max_gap)
    return e.withColumn("run", F.sum(fresh.cast("long")).over(day.rowsBetween(W.unboundedPreceding, 0)))


def _numbered(days: DataFrame, max_gap: float) -> DataFrame:
    """Vessel-days (mmsi, segment, first, last, last_run) with ``base``, which makes a day's runs islands of the vessel, and with the observations around the day."""
    c = across(days, "mmsi")
    opens = (F.col("previous").isNull() | F.col("first").isNull() | _breaks(F.col("previous"), F.col("first"), max_gap)).cast("long")
    c = c.withColumn("opens", opens)
    earlier = F.sum(F.col("last_run") + F.col("opens")).over(W.partitionBy("mmsi").orderBy("segment").rowsBetween(W.unboundedPreceding, -1))
    return c.select("mmsi", "segment", "previous", "following", (F.coalesce(earlier, F.lit(0)) + F.col("opens")).alias("base"))


def visit_islands(events: DataFrame, max_gap: float = 900) -> DataFrame:
    """Observations numbered by island: a maximal run of one eligible port (or none) without a gap.

    A vessel's rows are never in one task: they are scanned by day, and one row a day carries the number on.
    """
    rows = written(_runs(events, max_gap).drop("before", "after"), "visit-runs")
    days = rows.groupBy("mmsi", "segment").agg(F.min_by("here", "msgtime").alias("first"), F.max_by("here", "msgtime").alias("last"), F.max("run").alias("last_run"))
    numbered = _numbered(days, max_gap).select("mmsi", "segment", "base")
    return rows.join(numbered, ["mmsi", "segment"]).withColumn("island", F.col("base") + F.col("run")).select(*events.columns, "island")


def _open(max_gap: float) -> Column:
    """Whether an observation of another day may lie within ``max_gap`` of a piece: it begins or ends its vessel's day, so near midnight."""
    start = F.col("segment") * F.lit(DAY_MICROS)
    since, left = F.unix_micros("head.here.msgtime") - start, start + DAY_MICROS - F.unix_micros("tail.here.msgtime")
    return F.col("head.before").isNull() & (since / 1e6 <= max_gap) | F.col("tail.after").isNull() & (left / 1e6 <= max_gap)


def _pieces(events: DataFrame, max_gap: float, counts: dict[str, Column], carry: tuple[str, ...]) -> DataFrame:
    """The islands of each vessel's day: mmsi, segment, run, eligible, head, tail and the counts."""
    head, tail = F.struct("here", "before"), F.struct("here", "after")
    return _runs(events, max_gap, carry).groupBy("mmsi", "segment", "run").agg(
        F.any_value("eligible").alias("eligible"), F.min_by(head, "msgtime").alias("head"), F.max_by(tail, "msgtime").alias("tail"), *(c.alias(n) for n, c in counts.items())
    )


def _over_midnight(pieces: DataFrame, max_gap: float, counts: list[str]) -> DataFrame:
    """Pieces put together to islands of the vessel. Some may be missing, but none that is :func:`_open`: the others' neighbours are over ``max_gap`` away or in their day."""
    first, last = F.when(F.col("head.before").isNull(), F.col("head.here")), F.when(F.col("tail.after").isNull(), F.col("tail.here"))
    days = pieces.groupBy("mmsi", "segment").agg(F.min_by(first, "run").alias("first"), F.max_by(last, "run").alias("last"), F.max("run").alias("last_run"))
    p = pieces.join(_numbered(days, max_gap), ["mmsi", "segment"]).withColumn("island", F.col("base") + F.col("run"))
    p = p.withColumns({
        "head": F.struct(F.col("head.here").alias("here"), F.coalesce("head.before", "previous").alias("before")),
        "tail": F.struct(F.col("tail.here").alias("here"), F.coalesce("tail.after", "following").alias("after")),
    })
    return p.groupBy("mmsi", "island").agg(
        F.any_value("eligible").alias("eligible"), F.min_by("head", "head.here.msgtime").alias("head"), F.max_by("tail", "tail.here.msgtime").alias("tail"), *(F.sum(n).alias(n) for n in counts)
    )


def island_table(events: DataFrame, max_gap: float = 900, sums: dict[str, Column] | None = None, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row an island: mmsi, island, eligible, seen, ``head`` and ``tail`` (first and last observation with the one before or after), and sums of what is counted.

    Days are reduced to their islands first; the pieces of an island that
    passes midnight are put together afterwards. Observations show the columns
    of ``carry`` besides their time and port.
    """
    counts = {"seen": F.count("*")} | (sums or {})
    return _over_midnight(written(_pieces(events, max_gap, counts, carry), "visit-pieces"), max_gap, list(counts))


def chosen_islands(events: DataFrame, chosen: Column, max_gap: float = 900, carry: tuple[str, ...] = ()) -> DataFrame:
    """The islands of :func:`island_table` for which ``chosen`` holds, and whether their vessel has been seen ``later``.

    Only what may pass midnight, or is chosen within its day, is written and
    moved by vessel, so work and disk after the day's scan grow with these.
    Numbers tell islands apart but have gaps; neighbours over ``max_gap`` away
    in other days are others or missing.
    """
    pieces, counts = _pieces(events, max_gap, {"seen": F.count("*")}, carry), ["seen"]
    mine, ending = _open(max_gap) | chosen, F.col("tail.after").isNull()
    slim = {c: F.when(mine, F.col(c)) for c in ("run", "eligible", "head", "tail", *counts)}
    pieces = written(pieces.where(mine | ending).withColumns(slim | {"latest": F.when(ending, F.col("tail.here.msgtime"))}), "visit-pieces")
    latest = pieces.where("latest IS NOT NULL").groupBy("mmsi").agg(F.max("latest").alias("latest"))
    islands = _over_midnight(pieces.where("run IS NOT NULL").drop("latest"), max_gap, counts).where(chosen)
    return islands.join(latest, "mmsi").withColumn("later", F.col("latest") > F.col("tail.here.msgtime")).drop("latest")


def _long_enough(min_stay: float) -> Column:
    return (F.col("seen") >= 2) & (_seconds(F.col("head.here.msgtime"), F.col("tail.here.msgtime")) >= min_stay)


def _inside(seen: Column, circles: Column) -> Column:
    """Whether an observation lies in one of the circles; null if its place is unknown."""
    def near(c: Column) -> Column:
        return F.coalesce(haversine_m(seen["latitude"], seen["longitude"], c["latitude"], c["longitude"]) <= c["radius_m"], F.lit(False))

    return F.when(seen["latitude"].isNotNull(), F.exists(circles, near))


def _stays(positions: DataFrame, ports: DataFrame, min_stay: float, max_gap: float, max_speed: float, version: list[str]) -> DataFrame:
    """Islands at a port that are long enough, with what came before and after; only these few look up their port's circle."""
    e = assign_ports(_observations(positions, version), ports, max_speed).select("mmsi", "segment", "msgtime", "eligible", "latitude", "longitude")
    stays = F.col("eligible").isNotNull() & _long_enough(min_stay)
    i = chosen_islands(e, stays, max_gap, ("latitude", "longitude"))
    circles = ports.groupBy("port_id").agg(F.collect_set(F.struct("latitude", "longitude", "radius_m")).alias("circles"))
    i = i.withColumnRenamed("eligible", "port_id").join(circles, "port_id")
    before, first, last, after = F.col("head.before"), F.col("head.here.msgtime"), F.col("tail.here.msgtime"), F.col("tail.after")
    was_inside, is_inside = _inside(before, F.col("circles")), _inside(after, F.col("circles"))
    unsure = before.isNull() | (_seconds(before["msgtime"], first) > max_gap) | was_inside.isNull() | was_inside
    reason = (
        F.when(~F.col("later"), "window_end").when(after.isNull() | (_seconds(last, after["msgtime"]) > max_gap), "data_gap")
        .when(F.coalesce(~is_inside, F.lit(False)), "observed_exit").otherwise("movement_or_unknown")
    )
    s = i.select(
        "mmsi", "port_id", first.alias("arrival_at"), last.alias("last_observed_at"), after["msgtime"].alias("next_time"), F.coalesce(unsure, F.lit(True)).cast("int").alias("arrival_censored"),
        reason.alias("end_reason"), F.col("seen").alias("observation_count"), _seconds(first, last).alias("observed_stay_seconds"),
    )
    s = s.withColumn("departure_at", F.when(F.col("end_reason") == "observed_exit", F.col("next_time"))).drop("next_time")
    return s.withColumn("visit_id", visit_id(F.col("mmsi"), F.col("port_id"), F.col("arrival_at")))


VISIT_COLUMNS = ["visit_id", "mmsi", "port_id", "arrival_at", "last_observed_at", "departure_at", "arrival_censored", "end_reason", "observation_count", "observed_stay_seconds"]


def detect_visits(positions: DataFrame, ports: DataFrame, min_stay: float = 1200, max_gap: float = 900, max_speed: float = 3.0, version: list[str] = ()) -> DataFrame:
    """Stays of at least ``min_stay`` seconds and two slow observations in one port's circle.

    A gap, a fast or unknown observation, or another port ends a stay. A
    departure is given only if the next observation is in time and outside the
    circle. An arrival is certain only if the one before was. With ``version``,
    of the rows of a vessel and time only the newest by these columns counts.
    """
    if min_stay <= 0 or max_gap <= 0 or not max_speed >= 0:
        raise ValueError("thresholds must be positive numbers")
    return _stays(positions, ports, min_stay, max_gap, max_speed, version).select(*VISIT_COLUMNS)


def visit_stats(positions: DataFrame, ports: DataFrame, min_stay: float = 1200, max_gap: float = 900, max_speed: float = 3.0, version: list[str] = ()) -> DataFrame:
    """One row of run statistics: the observations are numbered by island once, and everything is counted from the islands.

    Islands that cannot pass midnight are counted within their day, so only the others are moved by vessel.
    """
    e = assign_ports(_observations(positions, version), ports, max_speed)
    counts = {"rows": F.sum("rows"), "seen": F.count("*"), "conflicts": F.count_if("conflict"), "inside": F.count("nearest")}
    at_port, split = F.col("eligible").isNotNull(), _open(max_gap)
    kinds = {"visits": at_port & _long_enough(min_stay), "short_candidates": at_port & ~_long_enough(min_stay)}
    days = _pieces(e, max_gap, counts, ()).groupBy("mmsi", "segment", F.when(split, F.col("run")).alias("run")).agg(
        *(F.any_value(F.when(split, F.col(c))).alias(c) for c in ("eligible", "head", "tail")), *(F.sum(c).alias(c) for c in counts), *(F.count_if(~split & k).alias(n) for n, k in kinds.items())
    )
    days = written(days, "visit-days")
    parts = _over_midnight(days.where("run IS NOT NULL"), max_gap, list(counts))
    i = days.where("run IS NULL").select(*counts, *kinds).unionByName(parts.select(*counts, *(k.cast("long").alias(n) for n, k in kinds.items())))

    def total(c: str) -> Column:
        return F.coalesce(F.sum(c), F.lit(0))

    one = i.agg(
        total("rows").alias("valid_rows"), total("seen").alias("unique_timestamps"), total("conflicts").alias("conflicting_timestamps"), total("inside").alias("positions_inside_ports"),
        total("visits").alias("visits"), total("short_candidates").alias("short_candidates"),
    )
    source = positions.select("mmsi", "msgtime").distinct() if version else positions
    one = one.withColumn("source_rows", source.agg(F.count("*").alias("n")).scalar())
    return one.withColumn("invalid_rows", F.col("source_rows") - F.col("valid_rows")).drop("valid_rows")


def visit_summaries(visits: DataFrame) -> DataFrame:
    return visits.groupBy("mmsi", "port_id").agg(F.count("*").alias("visit_count"))
