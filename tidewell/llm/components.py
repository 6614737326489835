"""Connected components by alternating large-star and small-star rounds (Kiveris et al., 2014)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.session import stored


def _merged(batches):
    """The components of few links: each node takes the smallest name among its neighbours and their names' names, until
    nothing changes."""
    tables = [pa.Table.from_batches([b]) for b in batches]
    if not tables:
        return
    got = pa.concat_tables(tables)
    nodes, place = np.unique(np.concatenate([got["u"].to_numpy(), got["v"].to_numpy()]), return_inverse=True)
    u, v, name = place[: len(got)], place[len(got) :], np.arange(len(nodes))
    while True:
        low = np.minimum(name[u], name[v])
        new = name.copy()
        for side in (u, v, name[u], name[v]):
            np.minimum.at(new, side, low)
        new = new[new]
        if (new == name).all():
            break
        name = new
    yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[name])], ["node", "component"])


def connected_components(links: DataFrame, max_rounds: int = 60, in_one_task: int = 50_000) -> DataFrame:
    """node, component (the smallest node reachable) for the nodes of links (columns a, b: long).

    Up to in_one_task links a single task settles them; beyond that the rounds do, with the same result.

    Every round is two aggregations and two joins over the links, written to the shared folder; a node with very many
    links is a row of the pre-aggregated side of each join, and its links are dealt out by the skew join of the planner.
    Nothing but the sums that tell the end comes to the driver.
    """
    edges = stored(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    if edges.count() <= in_one_task:
        return stored(edges.coalesce(1).mapInArrow(_merged, "node long, component long"), "components")
    before = None
    for _ in range(max_rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, F.col("u") == F.col("w")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = stored(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "links")
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
