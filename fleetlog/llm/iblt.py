"""Document fingerprints as invertible Bloom lookup tables, in SQL functions only.

A paragraph is a line that is not blank; its digest is a 64-bit hash. A text's
fingerprint is a table of CELLS cells, in three parts: each distinct digest is
added to one cell of each part, which keeps a count, the xor of the digests and
the xor of their checks. The tables of two texts subtract cell by cell, what
they share cancels, and peeling takes out the digests that differ: a cell with
count 1 or -1 whose check fits holds one digest alone. Where cells remain, the
pair is retried with a larger table: a number of blocks, four times as many each
time, each a small table that peels by itself. So no row holds more than one
block, however many paragraphs a text has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, cut_table

CELLS = 12
BLOCK_CELLS = 48
SMALL = 40
SMALL_CELLS = 48
PARTS = 3
ROUNDS = 12
LEVELS = 14
DIGESTS = "array_distinct(transform(filter(split({0}, '\\n'), p -> trim(p) <> ''), p -> xxhash64(p)))"


def digests(text: str) -> str:
    """SQL for the distinct paragraph digests of a text column."""
    return DIGESTS.format(text)


def _element(cells: int, seed: str) -> str:
    """A digest d with its check and its cell in each part."""
    part = cells // PARTS
    places = ", ".join(f"cast({j * part} + pmod(xxhash64(d, {seed}, {j}), {part}) as int)" for j in range(PARTS))
    return f"named_struct('d', d, 'x', xxhash64(d, {seed}, 99), 'at', array({places}))"


def build(values: str, cells: int = CELLS, seed: str = "0") -> str:
    """SQL for the table of an array of digests: cells of (n, k, x)."""
    return (
        f"transform(array(transform({values}, d -> {_element(cells, seed)})), es -> transform(sequence(0, {cells - 1}), c -> "
        "aggregate(filter(es, e -> array_contains(e.at, c)), named_struct('n', 0, 'k', 0L, 'x', 0L), (a, e) -> named_struct('n', a.n + 1, 'k', a.k ^ e.d, 'x', a.x ^ e.x))))[0]"
    )


def subtract(one: str, other: str) -> str:
    return f"zip_with({one}, {other}, (a, b) -> named_struct('n', a.n - b.n, 'k', a.k ^ b.k, 'x', a.x ^ b.x))"


def peel(table: str, cells: int = CELLS, seed: str = "0") -> str:
    """SQL for (number of digests taken out, whether the table is empty then)."""
    part = cells // PARTS
    pure = f"filter(transform(s.cells, (z, i) -> named_struct('z', z, 'i', i)), e -> abs(e.z.n) = 1 and e.z.x = xxhash64(e.z.k, {seed}, 99) and e.i = (e.i div {part}) * {part} + pmod(xxhash64(e.z.k, {seed}, cast(e.i div {part} as int)), {part}))"
    taken = f"array_distinct(transform({pure}, p -> named_struct('s', p.z.n, 'd', p.z.k)))"
    elements = f"transform({taken}, t -> transform(array(t.d), d -> named_struct('s', t.s, 'e', {_element(cells, seed)}))[0])"
    step = (
        f"transform(array({elements}), ts -> named_struct('cells', transform(s.cells, (z, i) -> aggregate(ts, z, (a, t) -> if(array_contains(t.e.at, i), named_struct('n', a.n - t.s, 'k', a.k ^ t.e.d, 'x', a.x ^ t.e.x), a))), "
        "'found', s.found + size(ts), 'going', size(ts) > 0))[0]"
    )
    return (
        f"aggregate(sequence(1, {ROUNDS}), named_struct('cells', {table}, 'found', 0, 'going', true), (s, r) -> if(s.going, {step}, s), "
        "s -> named_struct('found', s.found, 'clean', not exists(s.cells, z -> z.n <> 0 or z.k <> 0L or z.x <> 0L)))"
    )


def text_of(table: str) -> str:
    """SQL for a table as a string."""
    return f"concat_ws(' ', transform({table}, z -> concat_ws(':', z.n, lower(hex(z.k)), lower(hex(z.x)))))"


def _likeness(own: str, other: str, found: str) -> str:
    """Shared over all distinct paragraphs, from the two numbers and what differs; 1 for two texts without any."""
    return f"if({own} + {other} = 0, 1.0D, ({own} + {other} - {found}) / cast({own} + {other} + {found} as double))"


def differences(pairs: DataFrame) -> DataFrame:
    """(pair, found) from rows (pair, one, other) of digest arrays: how many digests only one side has.

    A small pair is tried with a table of 48 cells in its own row; for the others,
    and where that fails, the digests are dealt to blocks, four times as many in
    each round, until every block of a pair peels.
    """
    small = F.size("one") + F.size("other") <= SMALL
    tried = cut_table(
        pairs.withColumn("small", small).withColumn("p", F.when(F.col("small"), F.expr(peel(subtract(build("one", SMALL_CELLS, "1"), build("other", SMALL_CELLS, "1")), SMALL_CELLS, "1"))))
        .select("pair", F.when(~F.coalesce("p.clean", F.lit(False)), F.col("one")).alias("one"), F.when(~F.coalesce("p.clean", F.lit(False)), F.col("other")).alias("other"), F.when(F.col("p.clean"), F.col("p.found")).cast("long").alias("found"))
    )
    out, left = tried.where("found is not null").select("pair", "found"), tried.where("found is null").select("pair", "one", "other")
    for level in range(1, LEVELS + 1):
        if left.isEmpty():
            return out
        sides = left.select("pair", F.expr(f"ceil((size(one) + size(other)) / {SMALL}) * {4 ** (level - 1)}").alias("blocks"), F.explode(F.expr("concat(transform(one, d -> named_struct('s', 1, 'd', d)), transform(other, d -> named_struct('s', -1, 'd', d)))")).alias("e"))
        dealt = sides.groupBy("pair", F.expr(f"cast(pmod(xxhash64(e.d, {level}, 55), blocks) as int)").alias("block")).agg(F.collect_list("e").alias("es"))
        tables = [build(f"transform(filter(es, e -> e.s = {s}), e -> e.d)", BLOCK_CELLS, str(level + 1)) for s in (1, -1)]
        peeled = dealt.select("pair", F.expr(peel(subtract(*tables), BLOCK_CELLS, str(level + 1))).alias("p")).groupBy("pair").agg(F.sum("p.found").alias("found"), F.bool_and("p.clean").alias("clean"))
        peeled = cut(peeled)
        out = out.unionByName(peeled.where("clean").select("pair", "found"))
        left = left.join(peeled.where("not clean").select("pair"), "pair", "left_semi")
    raise RuntimeError(f"a pair of fingerprints doesn't peel in {LEVELS} rounds")


def _ranges(rows: DataFrame, column: str, range_rows: int) -> Column:
    """The quantile range of a numeric column that a row is in, -1 for null. Two levels keep the lists that a row is compared with short."""
    n, low = rows.agg(F.count(column), F.min(column)).first()
    wide = max(1, min(256, round((n / range_rows) ** 0.5)))
    value = F.col(column).cast("double")
    if low is None or wide == 1:
        return F.when(value.isNull(), -1).otherwise(0)
    steps = [i / (wide * wide) for i in range(1, wide * wide)]
    cuts = rows.agg(F.percentile_approx(value, steps, 20 * wide * wide)).first()[0]
    coarse = F.array(*map(F.lit, cuts[wide - 1 :: wide]))
    fine = F.array(*[F.array(*map(F.lit, cuts[i * wide : (i + 1) * wide - 1])) for i in range(wide)])
    outer = F.size(F.filter(coarse, lambda x: x <= value))
    return F.when(value.isNull(), -1).otherwise(outer * wide + F.size(F.filter(F.get(fine, outer), lambda x: x <= value)))


def with_next(docs: DataFrame, range_rows: int = 400) -> DataFrame:
    """`docs` (doc_id numeric, text without nulls, own digests) with text and digests of the
    next row by descending doc_id; the first follows the last. Nulls come last, equal ids by
    descending text. Each range is sorted by itself; its last row gets the head of the next."""
    ranged = docs.withColumn("range", _ranges(docs.select("doc_id"), "doc_id", range_rows))
    # A row for each range: bounded by the number of ranges, at most 65,537.
    tops = ranged.groupBy("range").agg(F.max("doc_id").alias("top"))
    order = Window.orderBy(F.desc("range"))
    follows = tops.select("range", "top", F.coalesce(F.lag("range").over(order), F.min("range").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("before"))
    heads = (
        ranged.join(F.broadcast(follows.withColumnRenamed("range", "r")), F.col("range").eqNullSafe(F.col("r")) & F.col("doc_id").eqNullSafe(F.col("top")))
        .groupBy("before").agg(F.max(F.struct("text", "own")).alias("head"))
        .select(F.col("before").alias("range"), "head")
    )
    line = Window.partitionBy("range").orderBy(F.desc_nulls_last("doc_id"), F.desc("text"))
    after = F.lead(F.struct("text", "own")).over(line)
    return ranged.withColumn("after", after).join(heads, "range", "left").withColumn("after", F.coalesce("after", "head")).drop("head", "range")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text is the text with its last floor(n/2) code points replaced by
    the first as many of the next row's text. A null text is empty; a text
    without paragraphs has an empty table, and two such are alike (1). Equal
    texts have equal fingerprints. A table of one row follows itself. An empty
    table gives none; other columns are not read.
    """
    own = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    own = own.withColumn("own", F.expr(digests("text")))
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - half), F.substring("after.text", F.lit(1), half))
    both = with_next(own).withColumn("edited", edited).withColumn("changed", F.expr(digests("edited")))
    both = both.withColumn("cells", F.expr(build("own"))).withColumn("changed_cells", F.expr(build("changed")))
    first = cut_table(
        both.select(
            F.monotonically_increasing_id().alias("row"), "doc_id", n.cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
            F.expr(text_of("cells")).alias("fingerprint"), F.expr(text_of("changed_cells")).alias("edited_fingerprint"),
            "own", "changed", F.col("after.own").alias("next"),
            F.expr(peel(subtract("cells", "changed_cells"))).alias("to_edited"), F.expr(peel(subtract("cells", build("after.own")))).alias("to_next"),
        )
    )
    failed = [first.where(f"not {p}.clean").select(F.expr(f"row * 2 + {i}").alias("pair"), F.col("own").alias("one"), F.col(side).alias("other")) for i, (p, side) in enumerate((("to_edited", "changed"), ("to_next", "next")))]
    found = differences(failed[0].unionByName(failed[1]))
    found = found.groupBy(F.expr("pair div 2").alias("row")).agg(F.max(F.expr("if(pair % 2 = 0, found, null)")).alias("edited_found"), F.max(F.expr("if(pair % 2 = 1, found, null)")).alias("next_found"))
    return first.join(found, "row", "left").select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        F.expr(_likeness("size(own)", "size(changed)", "if(to_edited.clean, to_edited.found, edited_found)")).alias("near_edited"),
        F.expr(_likeness("size(own)", "size(next)", "if(to_next.clean, to_next.found, next_found)")).alias("near_next"),
    )
