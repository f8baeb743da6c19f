"""The directed port network: routes, weighted PageRank, Louvain communities, labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewake.operators.segments import across, ends, inside, segment_of
from tidewake.shared import discard, written


def consecutive_visits(visits: DataFrame) -> DataFrame:
    """Moves between consecutive visits of a vessel (order: arrival, visit id), to the same port too.

    Moves within a day come from a window over vessel and day, those over
    midnight from each day's first and last visit.
    """
    here, order = F.struct("port_id", "arrival_at"), F.struct("arrival_at", "visit_id")
    v = visits.select("mmsi", "port_id", "arrival_at", "visit_id", segment_of("arrival_at").alias("segment"))
    within = v.select("mmsi", F.lag(here).over(inside("mmsi", "arrival_at", "visit_id")).alias("a"), here.alias("b"))
    over = across(ends(v, "mmsi", here, order), "mmsi").select("mmsi", F.col("previous").alias("a"), F.col("first").alias("b"))
    moves = within.unionByName(over).where("a IS NOT NULL")
    return moves.select("mmsi", F.col("a.port_id").alias("from_port_id"), F.col("b.port_id").alias("to_port_id"), F.col("a.arrival_at").alias("from_arrival_at"), F.col("b.arrival_at").alias("arrival_at"))


def port_connections(visits: DataFrame) -> DataFrame:
    """Directed routes between different ports; first seen at the source, last seen at the destination."""
    moves = consecutive_visits(visits).where("from_port_id <> to_port_id")
    return moves.groupBy("from_port_id", "to_port_id").agg(
        F.count("*").alias("movement_count"), F.count_distinct("mmsi").alias("vessel_count"), F.min("from_arrival_at").alias("first_seen"), F.max("arrival_at").alias("last_seen")
    )


def connection_stats(visits: DataFrame) -> DataFrame:
    """One row: visits, movements, relationships and moving vessels."""
    moves = consecutive_visits(visits).where("from_port_id <> to_port_id")
    m = moves.agg(F.count("*").alias("movements"), F.count_distinct("from_port_id", "to_port_id").alias("relationships"), F.count_distinct("mmsi").alias("vessels"))
    return m.select(visits.agg(F.count("*").alias("n")).scalar().alias("visits"), "movements", "relationships", "vessels")


def validate_edges(edges: DataFrame, ports: DataFrame, expected: int | None = None) -> DataFrame:
    """``edges``, or an error: endpoints must be known ports, weights positive and the number as published."""
    ends = edges.select(F.explode(F.array("from_port_id", "to_port_id")).alias("port_id")).distinct()
    unknown = ends.join(ports.select("port_id"), "port_id", "left_anti").count()
    row = edges.agg(F.count("*").alias("n"), F.count_if(F.col("movement_count").isNull() | (F.col("movement_count") <= 0)).alias("bad")).first()
    if unknown or row["bad"] or (expected is not None and row["n"] != expected):
        raise ValueError(f"{unknown} unknown ports, {row['bad']} bad weights, {row['n']} edges (expected {expected})")
    return edges


def project(edges: DataFrame, undirected: bool = False) -> DataFrame:
    """(src, dst, weight) with weights of equal pairs added up; undirected gives both directions, each with both weights."""
    e = edges.select(F.col("from_port_id").alias("src"), F.col("to_port_id").alias("dst"), F.col("movement_count").cast("double").alias("weight"))
    if undirected:
        e = e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))
    return e.groupBy("src", "dst").agg(F.sum("weight").alias("weight"))


def pagerank(edges: DataFrame, damping: float = 0.85, max_iter: int = 20, tol: float = 0.0, cut_every: int = 5) -> DataFrame:
    """(node, page_rank) of a weighted graph, not normalised; nodes without outgoing edges pass nothing on.

    Ranks and edges meet by an equality join on the source and are added up by
    destination, so both shuffles are of edge size; the lineage is cut every
    few rounds, when the change is also looked at.
    """
    total = edges.groupBy("src").agg(F.sum("weight").alias("total"))
    e = written(edges.join(total, "src").select("src", "dst", (F.col("weight") / F.col("total")).alias("share")), "pagerank-edges")
    nodes = written(e.select(F.col("src").alias("node")).union(e.select("dst")).distinct(), "pagerank-nodes")
    ranks, base = nodes.withColumn("page_rank", F.lit(1 - damping)), nodes.withColumn("page_rank", F.lit(1 - damping))
    for i in range(1, max_iter + 1):
        given = e.join(ranks, e["src"] == ranks["node"]).groupBy("dst").agg(F.sum(F.col("page_rank") * F.col("share")).alias("got"))
        new = nodes.join(given, nodes["node"] == given["dst"], "left").select("node", ((1 - damping) + damping * F.coalesce("got", F.lit(0.0))).alias("page_rank"))
        if i % cut_every == 0 or i == max_iter:
            new = written(new, "ranks")
            if tol > 0:
                change = new.join(base.select("node", F.col("page_rank").alias("old")), "node").agg(F.max(F.abs(F.col("page_rank") - F.col("old"))).alias("d")).first()["d"]
                if change is None or change < tol:
                    return new
            base = new
        ranks = new
    return ranks


def modularity(edges: DataFrame, membership: DataFrame) -> DataFrame:
    """One row: modularity of (node, community) on an undirected projection (both directions present)."""
    m = membership.select("node", "community")
    a = edges.join(m.select(F.col("node").alias("src"), F.col("community").alias("c_src")), "src").join(m.select(F.col("node").alias("dst"), F.col("community").alias("c_dst")), "dst")
    whole = edges.agg(F.sum("weight").alias("w")).scalar()
    per = a.groupBy(F.col("c_src").alias("community")).agg(F.sum("weight").alias("degree"), F.sum(F.when(F.col("c_src") == F.col("c_dst"), F.col("weight")).otherwise(0.0)).alias("inner_weight"))
    return per.agg(F.coalesce(F.sum(F.col("inner_weight") / whole - F.pow(F.col("degree") / whole, 2)), F.lit(0.0)).alias("modularity"))


def louvain(edges: DataFrame, max_levels: int = 10, max_rounds: int = 10) -> DataFrame:
    """(node, community) of an undirected projection; a community is named by its smallest member.

    Per level, nodes move to the neighbouring community of greatest gain (ties:
    the smaller name); only nodes of one hash parity move at a time, and a
    round is kept only if modularity rises, which rules out swaps. Then
    communities are contracted, with their inner weight as a loop. Every step is
    a join and an aggregation of edge size.
    """
    e = written(edges.where("weight > 0"), "louvain-edges")
    member = written(e.select(F.col("src").alias("node")).union(e.select("dst")).distinct(), "louvain-nodes").withColumn("community", F.col("node"))
    whole = e.agg(F.sum("weight").alias("w")).first()["w"]
    for _ in range(max_levels if whole else 0):
        degrees = e.groupBy(F.col("src").alias("node")).agg(F.sum("weight").alias("degree"))
        level = written(degrees.select("node", F.col("node").alias("community"), "degree"), "louvain-level")
        best, moved = _quality(e, level, whole), False
        for r in range(max_rounds):
            gained = False
            for parity in (0, 1):
                tried = written(_moved(e, level, whole, parity, r), "louvain-level")
                value = _quality(e, tried, whole)
                if value > best + 1e-12:
                    discard(level)
                    level, best, gained, moved = tried, value, True, True
                else:
                    discard(tried)
            if not gained:
                break
        if not moved:
            break
        names = level.groupBy("community").agg(F.min("node").alias("name"))
        named = written(level.join(names, "community").select("node", F.col("name").alias("community")), "louvain-level")
        step = named.select(F.col("node").alias("community"), F.col("community").alias("next"))
        member, old = written(member.join(step, "community").select("node", F.col("next").alias("community")), "louvain-members"), member
        a = e.join(named.select(F.col("node").alias("src"), F.col("community").alias("s")), "src").join(named.select(F.col("node").alias("dst"), F.col("community").alias("d")), "dst")
        smaller = written(a.groupBy(F.col("s").alias("src"), F.col("d").alias("dst")).agg(F.sum("weight").alias("weight")), "louvain-edges")
        discard(e, level, named, old)
        e = smaller
    smallest = member.groupBy("community").agg(F.min("node").alias("name"))
    return member.join(smallest, "community").select("node", F.col("name").alias("community"))


def _quality(e: DataFrame, level: DataFrame, whole: float) -> float:
    """Modularity of a level of which the degrees are known: only the inner weights need the edges."""
    inner = e.join(level.select(F.col("node").alias("src"), F.col("community").alias("a")), "src").join(level.select(F.col("node").alias("dst"), F.col("community").alias("b")), "dst")
    weight = inner.where("a = b").agg(F.coalesce(F.sum("weight"), F.lit(0.0)).alias("w")).scalar()
    sizes = level.groupBy("community").agg(F.sum("degree").alias("degree"))
    return sizes.agg((weight / whole - F.sum(F.pow(F.col("degree") / whole, 2))).alias("q")).first()["q"]


def _moved(e: DataFrame, level: DataFrame, whole: float, parity: int, salt: int) -> DataFrame:
    """``level`` (node, community, degree) after the nodes of one parity have moved where they gain."""
    size = level.groupBy("community").agg(F.sum("degree").alias("size"))
    near = e.where("src <> dst").join(level.select(F.col("node").alias("dst"), F.col("community").alias("to")), "dst").groupBy(F.col("src").alias("node"), "to").agg(F.sum("weight").alias("link"))
    own = level.select("node", F.col("community").alias("to"), F.lit(0.0).alias("link"))
    links = near.unionByName(own).groupBy("node", "to").agg(F.sum("link").alias("link"))
    met = links.join(level, "node").join(size.select(F.col("community").alias("to"), "size"), "to")
    rest = F.col("size") - F.when(F.col("to") == F.col("community"), F.col("degree")).otherwise(0.0)
    gain = F.col("link") - F.col("degree") * rest / whole
    choice = met.withColumn("gain", gain).groupBy("node", "community", "degree").agg(F.min(F.struct((-F.col("gain")).alias("loss"), F.col("to"))).alias("best"), F.max(F.when(F.col("to") == F.col("community"), F.col("gain"))).alias("stay"))
    turn = F.pmod(F.xxhash64("node", F.lit(salt)), F.lit(2)) == parity
    better = turn & (-F.col("best.loss") > F.col("stay") + 1e-12)
    return choice.select("node", F.when(better, F.col("best.to")).otherwise(F.col("community")).alias("community"), "degree")


def community_stats(edges: DataFrame, membership: DataFrame) -> DataFrame:
    """One row: number of communities, modularity, and smallest, mean and largest size."""
    sizes = membership.groupBy("community").agg(F.count("*").alias("n"))
    return sizes.agg(F.count("*").alias("communities"), F.min("n").alias("smallest"), F.avg("n").alias("mean_size"), F.max("n").alias("largest")).withColumn("modularity", modularity(edges, membership).scalar())


def metric_rows(ranks: DataFrame, membership: DataFrame, run: str, start: Column, end: Column) -> DataFrame:
    """Rows to publish: every ranked port with its community number (by order of community name), dated by the window's start.

    A negative or undefined rank, or a port without community, raises an error
    when computed.
    """
    named = membership.select("community").distinct().withColumn("community_id", F.row_number().over(W.orderBy("community")) - 1)
    m = ranks.join(membership, "node", "left").join(named, "community", "left")
    bad = F.col("page_rank").isNull() | F.isnan("page_rank") | (F.col("page_rank") < 0) | F.col("community_id").isNull() | (F.trim("node") == "")
    rank = F.when(bad, F.raise_error(F.concat(F.lit("bad metric row of port "), F.col("node"))).cast("double")).otherwise(F.col("page_rank"))
    return m.select(F.lit(run).alias("run_id"), start.alias("window_start"), end.alias("window_end"), F.to_date(start).alias("snapshot_date"), F.col("node").alias("port_id"), rank.alias("page_rank"), F.col("community_id").cast("long").alias("community_id"))


def community_labels(metrics: DataFrame, ports: DataFrame) -> DataFrame:
    """Name and label of each community of a run: its best-ranked port, and the best three joined; blank names give the id."""
    p = metrics.join(ports.select("port_id", "name"), "port_id", "left").withColumn("shown", F.coalesce(F.nullif(F.trim("name"), F.lit("")), F.col("port_id")))
    place = F.row_number().over(W.partitionBy("run_id", "community_id").orderBy(F.desc("page_rank"), "port_id"))
    ranked = p.withColumn("place", place)
    top = F.transform(F.array_sort(F.collect_list(F.when(F.col("place") <= 3, F.struct("place", "shown")))), lambda x: x["shown"])
    out = ranked.groupBy("run_id", "community_id").agg(top.alias("top"), F.count("*").alias("port_count"))
    return out.select("run_id", "community_id", F.col("top")[0].alias("community_name"), F.array_join("top", " / ").alias("community_label"), "port_count")


def check_memberships(metrics: DataFrame, communities: DataFrame) -> DataFrame:
    """Offending runs: ports in several communities, or totals that differ."""
    ports = metrics.groupBy("run_id", "port_id").agg(F.count_distinct("community_id").alias("n")).groupBy("run_id").agg(F.count("*").alias("ports"), F.count_if(F.col("n") != 1).alias("several"))
    totals = communities.groupBy("run_id").agg(F.sum("port_count").alias("members"))
    return ports.join(totals, "run_id", "full").where("NOT (several <=> 0 AND ports <=> members)").select("run_id", "ports", "several", "members")


def check_known_ports(rows: DataFrame, ports: DataFrame) -> DataFrame:
    """Exported rows whose port is not known."""
    return rows.join(ports.select("port_id"), "port_id", "left_anti")


def edge_fingerprint(edges: DataFrame) -> DataFrame:
    """One row that tells states of an edge list apart: numbers of edges and movements and an order-independent hash."""
    line = F.concat_ws("|", "from_port_id", "to_port_id", F.col("movement_count").cast("string"))
    part = F.conv(F.substring(F.sha2(line, 256), 1, 12), 16, 10).cast("decimal(38,0)")
    return edges.agg(F.count("*").alias("edges"), F.coalesce(F.sum("movement_count"), F.lit(0)).alias("movements"), F.coalesce(F.sum(part), F.lit(0)).cast("string").alias("fingerprint"))
