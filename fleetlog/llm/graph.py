"""Connected components, and pieces of work for all pairs of a group."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) for edges (a, b) of long ids; the component is its smallest node.

    Alternates large and small stars until nothing changes. Each step is an
    aggregation and a join, so a node with many edges is never held whole.
    Nodes without an edge to another have no row.
    """
    edges = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = None
    for _ in range(rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        edges = cut(small.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components don't settle in {rounds} rounds")
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def tile_pairs(rows: DataFrame, tile: Column, tiles: Column) -> DataFrame:
    """Each row once for each pair of tiles that its tile takes part in: adds ti <= tj and tile."""
    other = F.explode(F.sequence(F.lit(0), tiles - 1))
    spread = rows.withColumn("tile", tile.cast("int")).withColumn("_o", other)
    return spread.withColumn("ti", F.least("tile", "_o")).withColumn("tj", F.greatest("tile", "_o")).drop("_o")


def forest(first: np.ndarray, second: np.ndarray, ids: np.ndarray) -> list[tuple[int, int]]:
    """Edges from each row to its root, the smallest id it reaches, for links between positions of `ids`."""
    label = np.argsort(np.argsort(ids, kind="stable"), kind="stable").astype(np.int64)
    by_rank = np.sort(ids, kind="stable")
    if not len(first):
        return []
    while True:
        low = np.minimum(label[first], label[second])
        fresh = label.copy()
        np.minimum.at(fresh, first, low)
        np.minimum.at(fresh, second, low)
        # A label is the rank of some row; jump to that row's own label.
        at = np.argsort(ids, kind="stable")
        fresh = np.minimum(fresh, fresh[at[fresh]])
        if (fresh == label).all():
            break
        label = fresh
    return [(int(ids[i]), int(by_rank[label[i]])) for i in range(len(ids)) if ids[i] != by_rank[label[i]]]


def sorted_groups(batches, key: str):
    """Tables of the rows of one key each, from batches that come sorted by it."""
    import pyarrow as pa
    import pyarrow.compute as pc

    held: list = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(key).to_numpy(zero_copy_only=False)
        bounds = [0, *(np.flatnonzero(np.diff(keys)) + 1).tolist(), len(keys)]
        if held and held[-1].column(key)[0].as_py() != keys[0]:
            yield pa.Table.from_batches(held)
            held = []
        for a, b in zip(bounds[:-2], bounds[1:-1]):
            yield pa.Table.from_batches([*held, batch.slice(a, b - a)])
            held = []
        held.append(batch.slice(bounds[-2]))
    if held:
        yield pa.Table.from_batches(held)
