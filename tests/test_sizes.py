"""What queries shuffle on tables with many ports of equal place."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from tidewake import registry, registry_sources  # noqa: F401

VISITS = [
    "distinct_per", "report_top_ports", "report_bottom_ports", "report_port_map", "port_graph_communities", "report_community_traffic", "visit_stats", "port_graph_metrics_enriched", "report_communities_list", "completed_visits", "active_versions", "check_community_port_counts",
]


@pytest.fixture(scope="module")
def many_ports(spark, small, tmp_path_factory):
    """The smallest tables with every supplier 400 times, all at its place."""
    folder = tmp_path_factory.mktemp("ports")
    for t in os.listdir(small):
        if t != "supplier.parquet":
            os.symlink(f"{small}/{t}", folder / t)
    s = spark.read.parquet(f"{small}/supplier.parquet")
    copies = s.crossJoin(spark.range(400)).withColumn("s_suppkey", (F.col("s_suppkey") + 250 * F.col("id")).cast(s.schema["s_suppkey"].dataType)).drop("id")
    copies.write.parquet(f"{folder}/supplier.parquet")
    return str(folder)


def stages(spark) -> dict[int, int]:
    """Bytes that each stage so far has shuffled."""
    sc = spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    found = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
    return {s.stageId(): s.shuffleWriteBytes() for s in (found.apply(k) for k in range(found.size()))}


@pytest.mark.parametrize("name", VISITS)
def test_shuffles_do_not_grow_with_ports_of_one_place(spark, small, many_ports, name):
    def of(folder):
        before = max(stages(spark), default=-1)
        registry.QUERIES[name](spark, folder).collect()
        return sum(n for k, n in stages(spark).items() if k > before)

    assert of(many_ports) < 3 * of(small)
