"""Exact metric range join of unit vectors under pivots.

A cosine of at least c is a distance of at most eps = sqrt(2 - 2c) on the unit
sphere. Each vector has its home in the cell of the nearest pivot. It is on the
boundary of an earlier cell where the triangle inequality leaves room for a
partner there (its distance to that pivot exceeds the one to its own by at most
2 eps) and the bisector of the two pivots is within eps. Each pair then meets in
exactly one cell, as two of its home vectors or one of them and one of its
boundary, and cells join independently. The vectors are written once, sorted by
label, dimension and cell; a cell's home vectors are held in pieces, and each
piece reads what comes after it of its label, takes what is on its boundary, and
is multiplied with that tile by tile. No vector is copied for a tile or a
boundary. Labels of few vectors are one cell each, and are dealt out whole.
Equal vectors are one class with a weight beforehand.
"""

from __future__ import annotations

import math
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut_table, shared_dir, small_batches
from .graph import components, forest, sorted_groups

CELL = 2048
MOST_PIVOTS = 512
SLACK = 1e-9
#: Numbers in the home vectors that are held at once are CELL times this at most.
WIDE = 4096
#: Bytes of a row group of the vectors' files, the least that a piece reads.
ROW_GROUP = 4 << 20
MOST_UNITS = 10_000


def unit_rows(column) -> np.ndarray:
    """Vectors of one length, as rows of unit length."""
    parts = column.chunks if isinstance(column, pa.ChunkedArray) else [column]
    made = np.concatenate([np.asarray(x.flatten(), np.float64) for x in parts]).reshape(len(column), -1)
    made = made / np.abs(made).max(1, keepdims=True)
    return made / np.sqrt((made * made).sum(1, keepdims=True))


def valid(vector: str) -> str:
    """SQL for a vector with finite components that are not all zero."""
    finite = f"forall({vector}, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))"
    return f"coalesce({vector} is not null and {finite} and exists({vector}, x -> x <> 0), false)"


def pivots_of(rows: DataFrame, classes: DataFrame, large: DataFrame) -> dict[int, np.ndarray]:
    """Unit pivots by dimension: for each, one for about CELL vectors of the largest label, MOST_PIVOTS at most, by a hash of the vector."""
    most = large.groupBy("dim").agg(F.max("n").alias("most")).orderBy(F.desc("most"), "dim").limit(64).collect()
    out = {}
    for r in most:
        if r["most"] > 1:
            taken = classes.where(F.col("dim") == r["dim"]).select("k1", "k2").distinct().orderBy("k2", "k1").limit(r["most"])
            chosen = rows.join(F.broadcast(taken), ["k1", "k2"]).groupBy("k2", "k1").agg(F.first("vector").alias("vector")).orderBy("k2", "k1")
            out[r["dim"]] = unit_rows(chosen.select("vector").toArrow().column(0))
    return out


def placed(rows: DataFrame, pivots: dict[int, np.ndarray]) -> DataFrame:
    """(label, dim, cell, k1, k2, id, weight, vector) of rows with `n`, the number of pivots of their label: each vector in its home cell, once for a batch of rows."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            # Copies of a vector that are many meet here first.
            keyed = pa.Table.from_batches([batch.select(["label", "k1", "k2", "id"])]).append_column("at", pa.array(np.arange(batch.num_rows)))
            once = keyed.group_by(["label", "k1", "k2"]).aggregate([("id", "min"), ("id", "count"), ("at", "min")])
            batch = batch.take(once.column("at_min").combine_chunks())
            dims, n = batch.column("dim").to_numpy(), batch.column("n").to_numpy()
            cell = np.zeros(len(dims), np.int32)
            for dim in np.unique(dims):
                at = np.flatnonzero((dims == dim) & (n > 1))
                if len(at) and int(dim) in pivots:
                    own = pivots[int(dim)]
                    near = unit_rows(batch.column("vector").take(pa.array(at))) @ own.T
                    near[np.arange(len(own))[None, :] >= n[at][:, None]] = -2
                    cell[at] = near.argmax(1)
            columns = [batch.column(c) for c in ("label", "dim")] + [pa.array(cell)] + [batch.column(c) for c in ("k1", "k2")]
            columns += [once.column(c).combine_chunks() for c in ("id_min", "id_count")] + [batch.column("vector")]
            yield pa.RecordBatch.from_arrays(columns, names=["label", "dim", "cell", "k1", "k2", "id", "weight", "vector"])

    vector = rows.schema["vector"].dataType.simpleString()
    return rows.mapInArrow(run, f"label string, dim int, cell int, k1 long, k2 long, id long, weight long, vector {vector}")


def merged(dealt: DataFrame) -> DataFrame:
    """Copies of a vector, which lie in one partition, as one row."""
    return dealt.groupBy("label", "dim", "cell", "k1", "k2").agg(F.min("id").alias("id"), F.sum("weight").alias("weight"), F.first("vector").alias("vector"))


def linked(a: np.ndarray, b: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Positions (i, j) of the unit rows of `a` and `b` with at least this cosine. A product in single precision leaves out rows whose cosines are less by more than its error; the others' are taken in double."""
    error = (a.shape[1] + 8) * 2.0**-22
    i, j = np.nonzero(a.astype(np.float32) @ b.astype(np.float32).T >= np.float32(cosine - error))
    if len(i):
        rows, cols = np.unique(i), np.unique(j)
        i, j = np.nonzero(a[rows] @ b[cols].T >= cosine)
        i, j = rows[i], cols[j]
    return i, j


def spanning(first: np.ndarray, second: np.ndarray) -> list[tuple[int, int]]:
    """Edges that reach as far as the links between these ids, one for an id at most."""
    ids, at = np.unique(np.concatenate([first, second]), return_inverse=True)
    return forest(at[: len(first)], at[len(first) :], ids)


def piece_links(home, after, cosine: float, tile: int):
    """Batches of (kind, a, b) for the pairs among the rows of `home`, and those between them and the tables of `after`: kind 0 a spanning edge of links, kind 1 the weight b of a's links."""
    ids, weights = (home.column(c).to_numpy() for c in ("id", "weight"))
    vectors, sums, edges = unit_rows(home.column("vector")), np.zeros(len(ids), np.int64), []
    for at in range(0, len(ids), tile):
        i, j = linked(vectors[: at + tile], vectors[at : at + tile], cosine)
        i, j = i[i < j + at], j[i < j + at] + at
        np.add.at(sums, i, weights[j])
        np.add.at(sums, j, weights[i])
        edges += spanning(ids[i], ids[j])
    for own, heavy, rows in after:
        for at in range(0, len(own), tile):
            i, j = linked(vectors, rows[at : at + tile], cosine)
            if not len(i):
                continue
            j = j + at
            np.add.at(sums, i, heavy[j])
            theirs = np.zeros(len(own), np.int64)
            np.add.at(theirs, j, weights[i])
            yield _rows([(1, int(own[k]), int(theirs[k])) for k in np.flatnonzero(theirs)])
            edges += spanning(ids[i], own[j])
            if len(edges) > 100_000:
                edges = spanning(*np.array(edges, np.int64).T)
                if len(edges) > 50_000:
                    yield _rows([(0, *e) for e in edges])
                    edges = []
    if edges:
        edges = spanning(*np.array(edges, np.int64).T)
    yield _rows([(0, *e) for e in edges] + [(1, int(ids[k]), int(sums[k])) for k in np.flatnonzero(sums)])


def small_links(groups: DataFrame, cosine: float, tile: int) -> DataFrame:
    """Rows (kind, a, b) as of piece_links(), of labels that lie in one partition each."""
    work = groups.select("id", "weight", "vector", F.xxhash64("label", "dim").alias("unit")).sortWithinPartitions("unit")

    def run(batches):
        for group in sorted_groups(batches, "unit"):
            if group.num_rows > 1:
                yield from piece_links(group, (), cosine, tile)

    return work.mapInArrow(run, "kind int, a long, b long")


def cell_links(folder: str, units: DataFrame, pivots: dict[int, np.ndarray], cosine: float, tile: int) -> DataFrame:
    """Rows (kind, a, b) as of piece_links(), of units (label, dim, cell, piece, pieces) of the vectors in the files of `folder`; a cell's pieces are ranges of k1."""
    eps = math.sqrt(2 - 2 * cosine)
    between = lambda x, y: np.sqrt(np.maximum(0, 2 - 2 * np.einsum("...j,...j->...", x, y)))

    def after(table, unit, own):
        """The rows after a piece that are in its cell or on its boundary."""
        for batch in table:
            if not batch.num_rows:
                continue
            rows, cells = unit_rows(batch.column("vector")), batch.column("cell").to_numpy()
            needs = np.ones(len(rows), bool)
            if own is not None:
                far, near, apart = between(rows, own[unit["cell"]]), between(rows, own[cells]), np.maximum(between(own[unit["cell"]], own[cells]), 1e-12)
                needs = (far - near <= 2 * eps + SLACK) & (far * far - near * near <= 2 * apart * (eps + SLACK))
                needs |= cells == unit["cell"]
            yield (*(batch.column(c).to_numpy()[needs] for c in ("id", "weight")), rows[needs])

    def run(batches):
        import pyarrow.dataset as ds
        from pyarrow import fs

        files, top = fs.FileSystem.from_uri(folder)
        there, columns, cell, k1 = ds.dataset(top, filesystem=files, format="parquet"), ["id", "weight", "cell", "vector"], ds.field("cell"), ds.field("k1")
        for batch in batches:
            for unit in batch.to_pylist():
                low, high = (-(1 << 63) + (1 << 64) * k // unit["pieces"] for k in (unit["piece"], unit["piece"] + 1))
                label, same = (ds.field("label") == unit["label"]) & (ds.field("dim") == unit["dim"]), cell == unit["cell"]
                last = same & (k1 <= high - 1)
                home = there.to_table(columns, filter=label & last & (k1 >= low), use_threads=False)
                rest = there.to_batches(columns=columns, filter=label & (cell >= unit["cell"]) & ~last, batch_size=8 * tile, batch_readahead=1, fragment_readahead=1, use_threads=False)
                if home.num_rows:
                    yield from piece_links(home, after(rest, unit, pivots.get(unit["dim"])), cosine, tile)

    return units.repartition(max(1, min(MOST_UNITS, units.count()))).mapInArrow(run, "kind int, a long, b long")


def links(rows: DataFrame, classes: DataFrame, cosine: float, tile: int) -> DataFrame:
    """Rows (kind, a, b): kind 0 a spanning edge of links, kind 1 a part of the weight of a's links."""
    # At most one for CELL vectors, so they may be broadcast.
    large = classes.groupBy("label", "dim").count().where(F.col("count") > CELL).select("label", "dim", F.least(F.ceil(F.col("count") / CELL), F.lit(MOST_PIVOTS)).cast("int").alias("n"))
    told = rows.join(F.broadcast(large), ["label", "dim"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    found = small_links(merged(placed(told.where("n = 0"), {}).repartition("label", "dim")), cosine, tile)
    if large.isEmpty():
        return found
    pivots = pivots_of(rows, classes, large)
    folder = f"{shared_dir(rows.sparkSession)}/vectors-{uuid.uuid4().hex}"
    order = ["label", "dim", "cell", "k1", "k2"]
    homes = merged(placed(told.where("n > 0"), pivots).repartitionByRange(*order)).sortWithinPartitions(*order)
    homes.write.options(**{"compression": "zstd", "parquet.block.size": str(ROW_GROUP), "parquet.enable.dictionary#vector.list.element": "false"}).parquet(folder)
    homes = rows.sparkSession.read.schema(homes.schema).parquet(folder)
    units = homes.groupBy("label", "dim", "cell").agg(F.ceil(F.count("*") * F.greatest(F.lit(1), F.col("dim") / WIDE) / CELL).cast("int").alias("pieces"))
    units = units.withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
    return found.unionByName(cell_links(folder, units, pivots, cosine, tile))


def _rows(rows) -> pa.RecordBatch:
    made = np.array(rows, np.int64).reshape(-1, 3)
    return pa.RecordBatch.from_arrays([pa.array(made[:, 0].astype(np.int32)), pa.array(made[:, 1]), pa.array(made[:, 2])], names=["kind", "a", "b"])


def near_vectors(frame: DataFrame, cosine: float = 0.93, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", tile: int = 1024) -> DataFrame:
    """One row per row of `frame`: id, n_links, component_id, kept.

    Two vectors are linked when their labels are equal and not null, their
    lengths are equal, and their cosine is at least `cosine`. A vector that is
    null, zero, or has a null or non-finite component has no link, and is its
    own component. Ids are unique. An empty table gives none; other columns are
    not read. The frame is read some times over, and gives the same rows each time.
    """
    kind = frame.select(vector_col).schema[0].dataType
    kind = "array<float>" if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.FloatType) else "array<double>"
    rows = small_batches(frame).select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).cast(kind).alias("vector"))
    rows = rows.withColumns({"dim": F.size("vector"), "k1": F.xxhash64("vector"), "k2": F.xxhash64(F.lit(1), "vector"), "ok": F.expr(valid("vector")) & F.col("label").isNotNull() & F.col("id").isNotNull()})
    keyed = cut_table(rows.drop("vector"))
    classes = cut_table(keyed.where("ok").groupBy("label", "dim", "k1", "k2").agg(F.min("id").alias("own"), F.count("*").alias("weight")))
    found = cut_table(links(rows.where("ok").drop("ok"), classes, cosine, tile))
    grouped = components(found.where("kind = 0").select("a", "b"))
    near = found.where("kind = 1").groupBy(F.col("a").alias("own")).agg(F.sum("b").alias("near"))
    known = classes.join(grouped.withColumnRenamed("node", "own"), "own", "left").join(near, "own", "left")
    known = known.select("label", "k1", "k2", F.coalesce("component", "own").alias("component"), (F.col("weight") - 1 + F.coalesce("near", F.lit(0))).alias("n"))
    out = keyed.where("ok").join(known, ["label", "k1", "k2"]).select("id", "n", "component")
    out = out.unionByName(keyed.where("not ok").select("id", F.lit(0).cast("long").alias("n"), F.col("id").alias("component")))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_links"), F.col("component").alias("component_id"), F.col("id").eqNullSafe(F.col("component")).alias("kept"))
