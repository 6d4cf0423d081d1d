"""Jaccard join of word n-grams by chosen paths.

A text's set holds its word 5-grams; its signature has TOKENS sampled tokens
(minwise hashes, so two sets share each token with the probability of their
similarity). Sets with equal signatures are joined at once and go on as one. A run
starts with all sets in one bucket and splits: each bucket samples one of the
tokens by a hash of its path (a quarter of the buckets two), and sets that share
the token go on together until a bucket has at most `small` sets, or, after `usual`
splits, at most `large`. Such buckets are compared by brute force, in tiles: pairs
that agree in fewer than `agree` tokens are far below the threshold. Runs are
repeated until a pair at the threshold that passes `usual` splits is found with
probability `recall`; sets that came into buckets which needed more splits get as
many more runs as the deepest needs. A larger bucket of which a share ALIKE stays
together in a split is a group of near copies, which more splits would only
multiply; its tiles are compared too, as are those of what is still large after
`depth` splits.

What runs find joins sets to candidate groups, by spanning edges and never as
all pairs. Inside each group every pair of tiles is compared once on the whole
sets, which decides the links exactly.
"""

from __future__ import annotations

import hashlib
import math
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import MOST_HOT, batches_of, cut, packed, small_batches, unpacked
from .graph import components, forest, sorted_groups, tile_pairs

TOKENS = 64
TILE = 512
ALIKE = 0.7


class WordHashes(dict):
    def __missing__(self, word: str) -> int:
        value = xxhash.xxh64_intdigest(word.encode())
        if len(self) < 200_000:
            self[word] = value
        return value


def shingles(text: str | None, hashes: WordHashes, words: int = 5) -> np.ndarray:
    """Distinct hashes of the lower-cased text's word n-grams; a shorter text is one n-gram, one without words none."""
    found = np.fromiter((hashes[w] for w in (text or "").lower().split()), np.uint64)
    if not len(found):
        return found
    n = max(1, len(found) - words + 1)
    gram = np.full(n, len(found) if len(found) < words else words, np.uint64)
    for k in range(min(words, len(found))):
        gram = (gram ^ found[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
        gram ^= gram >> np.uint64(29)
    return np.unique(gram)


def signature(grams: np.ndarray, odd: np.ndarray, piece: int = 4096) -> np.ndarray:
    least = np.full(TOKENS, 0xFFFFFFFF, np.uint32)
    for low in range(0, len(grams), piece):
        part = grams[low : low + piece]
        for k in range(TOKENS):
            least[k] = min(least[k], int((part * odd[k]).max() >> np.uint64(32)) ^ 0xFFFFFFFF)
    return least


def text_hash(text_col: str):
    """The md5 of a text, null as empty, as bytes."""
    return F.unhex(F.md5(F.coalesce(F.col(text_col).cast("string"), F.lit(""))))


def sketches(docs: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """(id, text_hash, n, tokens array<int>) for each row."""

    def run(batches):
        hashes = WordHashes()
        odd = np.random.default_rng(10).integers(1, 1 << 63, TOKENS, np.uint64) | np.uint64(1)
        for batch in batches:
            for start, part in batches_of(batch.column(1), 8 << 20):
                texts = part.to_pylist()
                sizes, tokens = [], []
                for text in texts:
                    grams = shingles(text, hashes, words)
                    sizes.append(len(grams))
                    tokens.append(signature(grams, odd).view(np.int32))
                digests = [hashlib.md5((t or "").encode()).digest() for t in texts]
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1, dtype=np.int32) * TOKENS), pa.array(np.concatenate(tokens)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, len(part)), pa.array(digests, pa.binary()), pa.array(sizes, pa.int64()), lists], names=["id", "text_hash", "n", "tokens"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "id long, text_hash binary, n long, tokens array<int>")


def found_in(share: float, depth: int) -> float:
    """Probability that a run finds a pair that agrees in a share of its tokens, if it has to pass `depth` splits."""
    alive = 1.0
    for _ in range(depth - 1):
        one = share * alive
        alive = one + 0.25 * (1 - 1 / TOKENS) * (1 - one) * one
    return share * alive


def runs_for(recall: float, threshold: float, depth: int) -> int:
    """Runs after which a pair at the threshold that has to pass `depth` splits is found with that probability. All runs draw from the same tokens, of which a binomial number agrees."""
    chances = [(math.comb(TOKENS, k) * threshold**k * (1 - threshold) ** (TOKENS - k), found_in(k / TOKENS, depth)) for k in range(TOKENS + 1)]
    runs = 1
    while sum(p * (1 - found) ** runs for p, found in chances) > 1 - recall:
        runs += 1
    return runs


def buckets(sets: DataFrame, first: int, last: int, small: int, large: int, depth: int, usual: int) -> tuple[DataFrame, DataFrame, int]:
    """The buckets (path, id, n) of the runs from first to last that are to be compared, the ids in buckets that need more than `usual` splits, and the most splits made."""
    node = sets.select("id", "tokens", F.explode(F.sequence(F.lit(first), F.lit(last))).alias("run")).select("id", "tokens", F.xxhash64("run").alias("path"), F.lit(None).cast("long").alias("whole"))
    leaves, dense, level = [], [], 0
    while True:
        level += 1
        sampled = F.array(*[F.pmod(F.xxhash64("path", F.lit(k)), F.lit(TOKENS)).cast("int") for k in (0, 1)])
        sampled = F.array_distinct(F.slice(sampled, 1, F.when(F.lit(level > 1) & (F.pmod(F.xxhash64("path", F.lit(2)), F.lit(4)) == 0), 2).otherwise(1)))
        child = node.withColumn("at", F.explode(sampled)).select("id", "whole", F.xxhash64("path", "at", F.expr("tokens[at]")).alias("path"))
        sizes = cut(child.groupBy("path").agg(F.count("*").alias("n")).where("n > 1"))
        # A path of more than this many rows is dealt out in salts; there are at most MOST_HOT such paths.
        most = max(TILE, (sizes.agg(F.sum("n")).first()[0] or 0) // MOST_HOT)
        salts = F.ceil(F.col("n") / most).cast("int")
        hot = F.broadcast(sizes.where(F.col("n") > most).select("path", salts.alias("salts")))
        salted = sizes.select("path", "n", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"))
        salt = F.pmod(F.xxhash64("id", F.lit(5)), F.coalesce("salts", F.lit(1))).cast("int")
        placed = cut(child.join(hot, "path", "left").withColumn("salt", salt).join(salted, ["path", "salt"]).drop("salt", "salts"))
        # Of sets that are alike most go on together, and splitting them further only makes copies.
        alike = F.coalesce(F.col("n") >= ALIKE * F.col("whole"), F.lit(False))
        done = (F.col("n") <= small) | (F.lit(level >= usual) & (alike | (F.col("n") <= large))) | F.lit(level == depth)
        leaves.append(placed.where(done).select("path", "id", "n"))
        deeper = placed.where(~done).select("id", "path", F.col("n").alias("whole"))
        if level >= usual:
            dense.append(deeper.select("id"))
        if level == depth or deeper.isEmpty():
            break
        node = deeper.join(sets.select("id", "tokens"), "id")
    none = sets.select("id").where("false")
    return reduce(DataFrame.unionByName, leaves), reduce(DataFrame.unionByName, dense, none).distinct(), level


def candidates(sets: DataFrame, recall: float, threshold: float, small: int, large: int, depth: int, usual: int, agree: int) -> DataFrame:
    """Spanning edges (a, b) of the pairs of sets that the runs find."""
    signed = sets.select("id", "tokens", F.xxhash64("tokens").alias("sign"))
    leads = cut(signed.groupBy("sign").agg(F.min("id").alias("id"), F.first("tokens").alias("tokens"), F.count("*").alias("k")))
    equal = signed.select("id", "sign").join(leads.where("k > 1").select("sign", F.col("id").alias("lead")), "sign").where("id <> lead").select(F.col("lead").alias("a"), F.col("id").alias("b"))
    runs = runs_for(recall, threshold, usual)
    found, dense, deepest = buckets(leads, 1, runs, small, large, depth, usual)
    edges = candidate_edges(leads, found, agree)
    if deepest > usual:
        among = cut(leads.join(dense, "id", "left_semi").select("id", "tokens"))
        found, _, _ = buckets(among, runs + 1, runs_for(recall, threshold, deepest), small, large, depth, usual)
        edges = edges.unionByName(candidate_edges(among, found, agree))
    return edges.unionByName(equal)


def candidate_edges(sets: DataFrame, found: DataFrame, agree: int) -> DataFrame:
    """Spanning edges (a, b) of the pairs of a bucket that agree in at least `agree` tokens."""
    tiles = F.ceil(F.col("n") / TILE).cast("int")
    rows = tile_pairs(found, F.pmod(F.xxhash64("id", F.lit(3)), tiles), tiles).select("id", "tile", F.xxhash64("path", "ti", "tj").alias("unit"), "ti")
    low = F.transform("tokens", lambda x: (F.pmod(x, F.lit(256)) - 128).cast("tinyint"))
    rows = rows.join(sets.select("id", low.alias("low")), "id").repartition("unit").sortWithinPartitions("unit")

    def run(batches):
        pairs: list = []
        for group in sorted_groups(batches, "unit"):
            if group.num_rows < 2:
                continue
            group = group.combine_chunks()
            ids = group.column("id").to_numpy()
            marks = np.asarray(group.column("low").chunk(0).flatten()).reshape(len(ids), TOKENS)
            left = group.column("tile").to_numpy() == group.column("ti").to_numpy()
            right = ~left if not left.all() else left
            a, b = np.flatnonzero(left), np.flatnonzero(right)
            firsts, seconds = [], []
            for low_at in range(0, len(a), 64):
                part = a[low_at : low_at + 64]
                same = (marks[part][:, None, :] == marks[b][None, :, :]).sum(2)
                i, j = np.nonzero(same >= agree)
                keep = part[i] != b[j]
                firsts.append(part[i[keep]])
                seconds.append(b[j[keep]])
            if firsts:
                pairs += forest(np.concatenate(firsts), np.concatenate(seconds), ids)
            if len(pairs) > 100_000:
                yield _pairs(pairs)
                pairs = []
        yield _pairs(pairs)

    return rows.mapInArrow(run, "a long, b long").distinct()


def _pairs(pairs) -> pa.RecordBatch:
    made = np.array(pairs, np.int64).reshape(-1, 2)
    return pa.RecordBatch.from_arrays([pa.array(made[:, 0]), pa.array(made[:, 1])], names=["a", "b"])


def overlaps(one: list[np.ndarray], other: list[np.ndarray], columns: int = 8192) -> np.ndarray:
    """Sizes of the intersections of all sets of two lists, by products of incidence matrices."""
    vocabulary, at = np.unique(np.concatenate([*one, *other]), return_inverse=True)
    bounds = np.cumsum([0, *map(len, one), *map(len, other)])
    owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    # Only what both lists have can be shared.
    on_left = owner < len(one)
    shared = np.zeros(len(vocabulary), np.uint8)
    shared[at[on_left]] |= 1
    shared[at[~on_left]] |= 2
    dense = np.cumsum(shared == 3) - 1
    keep = shared[at] == 3
    owner, at = owner[keep], dense[at[keep]]
    out = np.zeros((len(one), len(other)), np.float32)
    for low in range(0, int((shared == 3).sum()), columns):
        inside = (at >= low) & (at < low + columns)
        matrix = np.zeros((len(one) + len(other), min(columns, int((shared == 3).sum()) - low)), np.float32)
        matrix[owner[inside], at[inside] - low] = 1
        out += matrix[: len(one)] @ matrix[len(one) :].T
    return out.astype(np.int64)


def exact_links(docs: DataFrame, groups: DataFrame, id_col: str, text_col: str, words: int, threshold: float):
    """Rows (kind, a, b): kind 0 a spanning edge of links, kind 1 the weight b of a's links, from groups (id, component, weight, n, and own and text_hash of a row with the set's text)."""
    sizes = groups.groupBy("component").agg(F.count("*").alias("sets"), F.sum("n").alias("grams"))
    tiles = F.greatest(F.ceil(F.col("sets") / TILE), F.ceil(F.col("grams") / 500_000)).cast("int")
    sized = groups.join(sizes, "component").select("id", "own", "text_hash", "component", "weight", tiles.alias("tiles"))
    given = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("string").alias("text"), text_hash(text_col).alias("hash"))
    rows = given.join(sized, (F.col("hash") == F.col("text_hash")) & F.col("doc").eqNullSafe(F.col("own"))).dropDuplicates(["id"])

    def grams(batches):
        hashes = WordHashes()
        for batch in batches:
            for start, part in batches_of(batch.column("text"), 4 << 20):
                made = [shingles(text, hashes, words).tobytes() for text in part.to_pylist()]
                rest = batch.slice(start, len(part))
                yield pa.RecordBatch.from_arrays([rest.column("id"), rest.column("component"), rest.column("weight"), rest.column("tiles"), pa.array(made, pa.binary())], names=["id", "component", "weight", "tiles", "grams"])

    sets = rows.select("id", "text", "component", "weight", "tiles").mapInArrow(grams, "id long, component long, weight long, tiles int, grams binary")
    work = tile_pairs(sets, F.pmod(F.xxhash64("id", F.lit(4)), F.col("tiles")), F.col("tiles"))
    work = work.select("id", "weight", "grams", "tile", "ti", F.xxhash64("component", "ti", "tj").alias("unit")).repartition("unit").sortWithinPartitions("unit")

    def compare(batches):
        edges: list = []
        for group in sorted_groups(batches, "unit"):
            if group.num_rows < 2:
                continue
            ids, weights = group.column("id").to_numpy(), group.column("weight").to_numpy()
            sets = [np.frombuffer(x, np.uint64) for x in group.column("grams").to_pylist()]
            size = np.array([len(x) for x in sets])
            left = group.column("tile").to_numpy() == group.column("ti").to_numpy()
            one_tile = bool(left.all())
            a = np.flatnonzero(left)
            b = a if one_tile else np.flatnonzero(~left)
            if not len(a) or not len(b):
                continue
            links = np.zeros(len(ids), np.int64)
            firsts, seconds = [], []
            for low in range(0, len(a), 128):
                part = a[low : low + 128]
                both = overlaps([sets[i] for i in part], [sets[j] for j in b])
                union = size[part][:, None] + size[b][None, :] - both
                linked = (both >= threshold * union - 1e-9) & (both > 0)
                if one_tile:
                    linked &= part[:, None] != b[None, :]
                links[part] += linked @ weights[b]
                if not one_tile:
                    links[b] += weights[part] @ linked
                i, j = np.nonzero(linked)
                firsts.append(part[i])
                seconds.append(b[j])
            edges += [(0, *e) for e in forest(np.concatenate(firsts), np.concatenate(seconds), ids)]
            edges += [(1, int(ids[i]), int(links[i])) for i in np.flatnonzero(links)]
            if len(edges) > 100_000:
                yield _kinds(edges)
                edges = []
        yield _kinds(edges)

    return cut(work.mapInArrow(compare, "kind int, a long, b long"))


def _kinds(rows) -> pa.RecordBatch:
    made = np.array(rows, np.int64).reshape(-1, 3)
    return pa.RecordBatch.from_arrays([pa.array(made[:, 0].astype(np.int32)), pa.array(made[:, 1]), pa.array(made[:, 2])], names=["kind", "a", "b"])


def classified(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8, words: int = 5, recall: float = 0.9999, small: int = 64, large: int = 8 * TILE, depth: int = 12, usual: int = 3, agree: int = 36) -> tuple[DataFrame, DataFrame]:
    """The rows (id, text_hash) and each distinct text: text_hash, own (its smallest id), class_id (its group's smallest id), n_links, leads (whether it is the one text of its group that has the smallest id, then the smallest hash; a missing id comes last)."""
    slim = cut(sketches(small_batches(docs), id_col, text_col, words))
    classes = cut(slim.groupBy("text_hash").agg(F.min("id").alias("own"), F.count("*").alias("weight"), F.first("n").alias("n"), F.first("tokens").alias("tokens")))
    # Numbers of the rows of the checkpoint, which don't change.
    classes = classes.withColumn("id", F.monotonically_increasing_id())
    sets = classes.where("n > 0").select("id", "weight", "n", "tokens", "own", "text_hash")
    groups = components(candidates(sets, recall, threshold, small, large, depth, usual, agree)).withColumnRenamed("node", "id")
    groups = cut(sets.drop("tokens").join(groups, "id"))
    exact = exact_links(docs, groups, id_col, text_col, words, threshold)
    classed = components(exact.where("kind = 0").select("a", "b")).withColumnRenamed("node", "id")
    linked = exact.where("kind = 1").groupBy(F.col("a").alias("id")).agg(F.sum("b").alias("similar"))
    known = classes.select("text_hash", "id", "own", "weight").join(classed, "id", "left").join(linked, "id", "left")
    best = groups.select("id", "own", "text_hash").join(classed, "id").groupBy("component").agg(F.min(F.struct(F.col("own").isNull().alias("none"), "own", "text_hash")).alias("best"))
    known = known.join(best, "component", "left").select(
        "text_hash", "own", F.when(F.col("best").isNull(), F.col("own")).otherwise(F.col("best.own")).alias("class_id"),
        (F.col("weight") - 1 + F.coalesce("similar", F.lit(0))).alias("n_links"), F.coalesce(F.col("best.text_hash") == F.col("text_hash"), F.lit(True)).alias("leads"),
    )
    return slim.select("id", "text_hash"), known


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", **how) -> DataFrame:
    """One row per row of `docs`: id, class_id (smallest id of its group), n_links (other rows with an equal or similar text).

    Groups follow links transitively. Equal texts are linked whatever their
    length; a null text counts as empty, and a text without words is like none
    but its equals. Ids may repeat or be null; class_id is null where the whole
    group has none. Very long texts are compared whole. An empty table gives
    none; other columns are not read. `how` has the other parameters of classified().
    """
    rows, known = classified(docs, id_col, **how)
    return rows.join(known, "text_hash").select(F.col("id").alias(id_col), "class_id", "n_links")


def without_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The rows of `docs`, all columns, less near duplicates: of each group one row stays, of the text with the smallest id; rows without an id come last.

    Rows that agree in id and text count as one document, and any one of them stays.
    """
    rows, known = classified(docs, id_col, text_col, **how)
    given = rows.join(known, "text_hash").withColumn("stays", F.col("leads") & F.col("id").eqNullSafe(F.col("own")))
    # One row for each id and text that goes.
    gone = given.where("not stays").select("id", "text_hash").distinct()
    keyed = docs.select(packed(docs).alias("row"), text_hash(text_col).alias("hash"))
    kept = keyed.join(gone, (F.col("hash") == F.col("text_hash")) & F.col("row")[id_col].cast("long").eqNullSafe(F.col("id")), "left_anti")
    repeated = given.where("stays").groupBy("id", "text_hash").count().where("count > 1").select("text_hash")
    if not repeated.isEmpty():
        same = F.col("hash") == F.col("text_hash")
        kept = kept.join(repeated, same, "left_anti").unionByName(kept.join(repeated, same, "left_semi").dropDuplicates(["hash"]))
    return unpacked(kept, docs.columns, "row")
