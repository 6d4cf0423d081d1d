"""Shards of near-equal bytes by sampled splitters, in DataFrame operations only.

The key of a row is a hash of its text, so equal texts are one group. A sample of
groups drawn in proportion to their bytes gives quantile boundaries, and groups
are dealt to the ranges between them. A range with more than `part_rows` groups
is subdivided by further bits of the key, and a group with more than `part_rows`
rows by the row's id. Sums of the parts put every row on one line of bytes that
is cut into `n_shards` equal lengths. A group lies in one shard, that of its
middle, unless it holds more than a share `together` of a shard's bytes; such a
group is cut where the line is.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import MOST_HOT, crc32_text, cut


def _between(splitters: list[int], key: Column) -> Column:
    """How many of the splitters are at most the key."""
    if not splitters:
        return F.lit(0)
    return F.size(F.filter(F.array(*map(F.lit, splitters)), lambda x: x <= key))


def shard(docs: DataFrame, n_shards: int = 16, id_col: str = "doc_id", text_col: str = "text", ranges: int = 256, sample: int = 20_000, part_rows: int = 1000, together: float = 0.02) -> DataFrame:
    """One row per row of `docs`: id, size, text_crc32, law, shard, slot, grown_shard.

    size is the bytes of the text (null: none) plus 1; a shard's sum differs from
    the mean by at most a share `together` and a row. Equal texts lie in one
    shard unless they hold more than that share of it. slot counts from 0 inside
    a shard without gaps. The law is `bytes`; grown_shard belongs to another law
    and is null. Rows with equal id and text are interchangeable; null ids are
    ids like any other. An empty table gives none; other columns are not read.
    """
    text, given = F.col(text_col).cast("string"), F.col(id_col)
    slim = docs.select(
        given.alias(id_col),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.coalesce(crc32_text(text), F.lit(0)).cast("long").alias("text_crc32"),
        F.xxhash64(F.coalesce(text, F.lit(""))).alias("key"),
    )
    classes = cut(slim.groupBy(id_col, "size", "text_crc32", "key").agg(F.count("*").alias("rows")))
    groups = cut(classes.groupBy("key").agg(F.sum(F.col("size") * F.col("rows")).alias("group_bytes"), F.sum("rows").alias("group_rows")))
    total, n_rows = (x or 0 for x in groups.agg(F.sum("group_bytes"), F.sum("group_rows")).first())

    # Drawn in proportion to bytes, so about `sample` groups at most; they become at most `ranges` splitters.
    weight = F.col("group_bytes") * F.lit(sample / max(1, total))
    drawn = groups.where(F.pmod(F.xxhash64("key", F.lit(6)), F.lit(1 << 30)) / F.lit(float(1 << 30)) < weight)
    steps = [i / ranges for i in range(1, ranges)]
    quantiles = drawn.agg(F.percentile(F.col("key").cast("double"), steps, F.greatest(F.lit(1), F.round(weight)).cast("long"))).first()[0]
    ranged = groups.withColumn("range", _between(sorted({int(x) for x in quantiles or []}), F.col("key")))

    # A group with many rows is several units of about `part_rows`, or of a MOST_HOT-th of all rows if that is more, so at most MOST_HOT groups are. Ids are dealt to them by a hash.
    ranged = ranged.withColumn("units", F.ceil(F.col("group_rows") / max(part_rows, n_rows // MOST_HOT)).cast("int"))
    hot = F.broadcast(ranged.where("units > 1").select("key", "units"))
    classes = classes.join(hot, "key", "left").withColumn("unit", F.pmod(F.xxhash64(id_col, F.lit(7)), F.coalesce("units", F.lit(1))).cast("int")).drop("units")
    several = classes.join(hot.select("key"), "key", "left_semi").groupBy("key", "unit").agg(F.sum(F.col("size") * F.col("rows")).alias("unit_bytes"), F.sum("rows").alias("unit_rows"))
    single = ranged.where("units = 1").select("key", F.lit(0).alias("unit"), F.col("group_bytes").alias("unit_bytes"), F.col("group_rows").alias("unit_rows"))

    # Where each group starts: sums over at most `ranges` ranges, over the parts of a range, over the groups of a part.
    spans = ranged.groupBy("range").agg(F.count("*").alias("groups"))
    ranged = ranged.join(F.broadcast(spans), "range").withColumn("part", F.pmod(F.xxhash64("key", F.lit(8)), F.ceil(F.col("groups") / part_rows)).cast("int")).drop("groups", "units")
    before = lambda column, by: F.coalesce(F.sum(column).over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = ranged.groupBy("range", "part").agg(F.sum("group_bytes").alias("b"), F.sum("group_rows").alias("r"))
    starts = parts.groupBy("range").agg(F.sum("b").alias("b"), F.sum("r").alias("r"))
    starts = starts.select("range", before("b", Window.orderBy("range")).alias("b0"), before("r", Window.orderBy("range")).alias("r0"))
    in_range = Window.partitionBy("range").orderBy("part")
    parts = parts.join(F.broadcast(starts), "range").select("range", "part", (F.col("b0") + before("b", in_range)).alias("b0"), (F.col("r0") + before("r", in_range)).alias("r0"))
    in_part = Window.partitionBy("range", "part").orderBy("key")
    groups = ranged.join(parts, ["range", "part"]).select("key", "group_bytes", (F.col("b0") + before("group_bytes", in_part)).alias("group_byte"), (F.col("r0") + before("group_rows", in_part)).alias("group_row"))

    in_group = Window.partitionBy("key").orderBy("unit")
    units = several.unionByName(single).join(groups, "key").select(
        "key", "unit", "group_bytes", "group_byte",
        (F.col("group_byte") + before("unit_bytes", in_group)).alias("byte"), (F.col("group_row") + before("unit_rows", in_group)).alias("row"),
    )
    in_unit = Window.partitionBy("key", "unit").orderBy(id_col, "size", "text_crc32")
    whole = F.col("group_bytes") <= F.lit(together * total / n_shards)
    each = classes.join(units, ["key", "unit"]).withColumn("byte", F.col("byte") + before(F.col("size") * F.col("rows"), in_unit)).withColumn("row", F.col("row") + before("rows", in_unit))
    each = each.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("rows") - 1)))
    middle = F.when(whole, F.col("group_byte") + F.col("group_bytes") / 2).otherwise(F.col("byte") + (F.col("k") + 0.5) * F.col("size"))
    placed = cut(each.select(id_col, "size", "text_crc32", F.least(F.lit(n_shards - 1), F.floor(middle * n_shards / F.lit(max(1, total)))).cast("int").alias("shard"), (F.col("row") + F.col("k")).alias("row")))
    # At most `n_shards` rows.
    first = placed.groupBy("shard").agg(F.min("row").alias("first"))
    return placed.join(F.broadcast(first), "shard").select(
        id_col, "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("row") - F.col("first")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )


def imbalance(shards: DataFrame) -> float:
    """Largest shard over the mean, by bytes."""
    sums = [r[0] for r in shards.groupBy("shard").agg(F.sum("size")).select("sum(size)").collect()]
    return max(sums) * len(sums) / math.fsum(sums) if sums else 1.0
