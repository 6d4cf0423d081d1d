"""Mixing sources to target weights through a tree of domain, language, source.

The budget of tokens goes down the tree by weight. A child that cannot use its
share (its supply times `epochs`) leaves the rest to its siblings in proportion
to their weights; only what all siblings together cannot use was already kept
from their parent by the same rule one level up. Sorted by supply over weight,
the children of a node that are short come first, so the water level of each
node is one window over its children.

A leaf gives whole epochs and, of the last, the documents with the smallest
seeded hashes as long as their tokens fit. Documents are dealt to hash bins, bins
to shelves; sums over shelves and bins find where the prefix ends, and only inside
a bin is there a running sum over documents, so no leaf is held by one task. Equal
rows are one class with a number beforehand, so repeated ids don't fill a bin.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, packed, unpacked

LEVELS = ("domain", "lang", "source")
BIN_ROWS = 1000


def n_tokens(text: str) -> str:
    """SQL for the number of words of a text, none for null."""
    return f"cast(coalesce(size(filter(split({text}, '\\\\s+'), w -> w <> '')), 0) as long)"


def domain_of(source: str, domains: int = 4) -> str:
    """SQL for the domain that a source belongs to: its number modulo `domains`, `d?` without one."""
    return f"concat('d', coalesce(cast(try_cast(regexp_extract({source}, '([0-9]+)$', 1) as bigint) % {domains} as string), '?'))"


def _share(nodes: DataFrame, parent: list[str]) -> DataFrame:
    """Adds `given` to children (weight, supply, budget of the parent): the parent's budget poured over them."""
    by = Window.partitionBy(*parent)
    rising = by.orderBy(F.col("supply") / F.col("weight"), "name")
    before = rising.rowsBetween(Window.unboundedPreceding, -1)
    spent = F.coalesce(F.sum("supply").over(before), F.lit(0))
    weights = F.sum("weight").over(by) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    level = (F.least("budget", F.sum("supply").over(by)) - spent) / weights
    short = F.col("supply") <= F.col("weight") * level + 1e-6
    # The first child that is not short sets the level of all that follow.
    nodes = nodes.withColumn("level", F.when(~short, level)).withColumn("level", F.first("level", ignorenulls=True).over(rising.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return nodes.withColumn("given", F.when(F.col("level").isNull(), F.col("supply").cast("double")).otherwise(F.col("weight") * F.col("level"))).drop("level")


def budgets(leaves: DataFrame, total, weights: DataFrame | None = None, epochs: int = 4) -> DataFrame:
    """(domain, lang, source, tokens, budget) for leaves with their supply in `tokens`.

    `weights` has rows (level, name, weight) with level one of LEVELS and positive
    weights; a name without a row weighs 1. Budgets are whole tokens, rounded down.
    """
    leaves = leaves.withColumn("supply", F.col("tokens") * epochs)
    tree = None
    for depth in range(1, len(LEVELS) + 1):
        keys, parent = list(LEVELS[:depth]), list(LEVELS[: depth - 1])
        nodes = leaves.groupBy(*keys).agg(F.sum("supply").alias("supply")).withColumn("name", F.col(keys[-1]))
        if weights is not None:
            own = weights.where(F.col("level") == keys[-1]).select(F.col("name").alias("w_name"), F.col("weight").cast("double").alias("weight"))
            nodes = nodes.join(own, F.col("name") == F.col("w_name"), "left").drop("w_name").withColumn("weight", F.coalesce("weight", F.lit(1.0)))
        else:
            nodes = nodes.withColumn("weight", F.lit(1.0))
        nodes = nodes.withColumn("budget", F.lit(float(total))) if tree is None else nodes.join(tree, parent)
        tree = _share(nodes, parent).select(*keys, F.col("given").alias("budget"))
    return leaves.select(*LEVELS, "tokens").join(tree, list(LEVELS)).withColumn("budget", F.floor(F.col("budget") + 1e-6).cast("long"))


def plan(docs: DataFrame, fraction: float, weights: DataFrame | None = None, epochs: int = 4, seed: int = 3, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", domains: int = 4) -> DataFrame:
    """One row for each class of rows with equal id, text, language and source: id, digest (md5 of the text), domain, lang, source, n_tokens, rows,
    whole (copies of each row), more (how many of its rows get one more), tokens and budget of its leaf."""
    text = F.col(text_col).cast("string")
    slim = docs.select(
        F.col(id_col).alias("id"), F.coalesce(F.col(lang_col).cast("string"), F.lit("none")).alias("lang"), F.coalesce(F.col(source_col).cast("string"), F.lit("none")).alias("source"),
        text.alias("text"), F.md5(F.coalesce(text, F.lit(""))).alias("digest"),
    ).selectExpr("id", "digest", f"{domain_of('source', domains)} as domain", "lang", "source", f"{n_tokens('text')} as n_tokens")
    classes = cut(slim.groupBy(*slim.columns).agg(F.count("*").alias("rows")))
    leaves = cut(classes.groupBy(*LEVELS).agg(F.sum(F.col("n_tokens") * F.col("rows")).alias("tokens"), F.count("*").alias("classes")))
    total = leaves.agg(F.sum("tokens")).first()[0] or 0
    leaf = budgets(leaves.drop("classes"), int(total * fraction), weights, epochs).join(leaves.drop("tokens"), list(LEVELS))
    leaf = cut(
        leaf.withColumn("whole", F.when(F.col("tokens") > 0, F.floor(F.col("budget") / F.col("tokens"))).otherwise(0).cast("long"))
        .withColumn("rest", F.when(F.col("tokens") > 0, F.col("budget") - F.col("whole") * F.col("tokens")).otherwise(0))
        .withColumn("bins", F.ceil(F.col("classes") / BIN_ROWS)).drop("classes")
    )
    # The seeded order of the last epoch, as an md5 so that other engines can follow it.
    order = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("whole").cast("string"), F.coalesce(F.col("id").cast("string"), F.lit("")), "digest")), 1, 15), 16, 10).cast("long")
    dealt = classes.join(leaf, list(LEVELS)).withColumn("order", order).withColumn("bin", F.floor(F.col("order") / F.lit(float(1 << 60)) * F.col("bins")))
    # Sums of bins, in shelves of BIN_ROWS bins, so that no window has all bins of a leaf.
    shelf = F.floor(F.col("bin") / BIN_ROWS).alias("shelf")
    bins = dealt.groupBy(*LEVELS, shelf, "bin").agg(F.sum(F.col("n_tokens") * F.col("rows")).alias("in_bin"))
    below = lambda *by: Window.partitionBy(*LEVELS, *by[:-1]).orderBy(by[-1]).rowsBetween(Window.unboundedPreceding, -1)
    shelves = bins.groupBy(*LEVELS, "shelf").agg(F.sum("in_bin").alias("in_shelf"))
    shelves = shelves.select(*LEVELS, "shelf", F.coalesce(F.sum("in_shelf").over(below("shelf")), F.lit(0)).alias("base"))
    bins = bins.join(shelves, [*LEVELS, "shelf"]).select(*LEVELS, "bin", (F.col("base") + F.coalesce(F.sum("in_bin").over(below("shelf", "bin")), F.lit(0))).alias("before"))
    dealt = dealt.join(bins, [*LEVELS, "bin"])
    inside = Window.partitionBy(*LEVELS, "bin").orderBy("order", "id", "digest").rowsBetween(Window.unboundedPreceding, -1)
    left = F.col("rest") - F.col("before") - F.coalesce(F.sum(F.col("n_tokens") * F.col("rows")).over(inside), F.lit(0))
    fits = F.when((F.col("rest") <= 0) | (left < 0), 0).when(F.col("n_tokens") == 0, F.col("rows")).otherwise(F.least("rows", F.floor(left / F.col("n_tokens"))))
    return dealt.select("id", "digest", *LEVELS, "n_tokens", "rows", "whole", fits.cast("long").alias("more"), "tokens", "budget")


def mix(docs: DataFrame, fraction: float = 0.5, id_col: str = "doc_id", **how) -> DataFrame:
    """One row per row of `docs`: id, domain, lang, source, n_tokens, copies, leaf_tokens, leaf_budget.

    The budget is `fraction` of all tokens. copies is how often the mixture has
    the row: whole epochs of its leaf, plus one where it is in the prefix of the
    last. Null language, source or text count as 'none', 'none' and no tokens;
    rows without tokens come with the prefix that they lie in. The order of the
    prefix is a hash of seed, epoch, id and text, so it is the same however the
    rows are dealt, also for repeated and null ids; rows equal in all of these
    are interchangeable, and as many of them are drawn as fit. A token is a word
    between blanks. An empty table gives none; other columns are not read. `how`
    has the other parameters of plan().
    """
    classes = plan(docs, fraction, id_col=id_col, **how)
    each = classes.withColumn("k", F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows"))))
    return each.select(
        F.col("id").alias(id_col), "domain", "lang", "source", "n_tokens", (F.col("whole") + (F.col("k") <= F.col("more")).cast("long")).alias("copies"),
        F.col("tokens").alias("leaf_tokens"), F.col("budget").alias("leaf_budget"),
    )


def draw(docs: DataFrame, fraction: float = 0.8, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The rows of `docs`, all columns, that a mixture of `fraction` of the tokens has with each row once at most. Rows equal in id, text, language and source come together or not at all."""
    classes = plan(docs, fraction, epochs=1, id_col=id_col, text_col=text_col, **how).where("whole > 0 or more = rows").select("id", "digest", "lang", "source")
    row = lambda c: F.col("row")[c]
    lang, source = (F.coalesce(row(how.get(f"{c}_col", c)).cast("string"), F.lit("none")) for c in ("lang", "source"))
    digest = F.md5(F.coalesce(row(text_col).cast("string"), F.lit("")))
    same = row(id_col).eqNullSafe(F.col("id")) & (digest == F.col("digest")) & (lang == F.col("lang")) & (source == F.col("source"))
    return unpacked(docs.select(packed(docs).alias("row")).join(classes, same, "left_semi"), docs.columns, "row")
