"""Prefix trie of conversations: who shares which first turns, and what sharing them saves.

Conversations become sequences of turn digests. Equal sequences are one path with
the number of its members; their ids, hashed in order, are first joined in pieces
by range, so a group of any size is a stream of pieces. Paths are range-partitioned
in the order of their digests. Each shard encodes its digests as small numbers and
inserts its paths, medians first, into a ternary search tree; one iterative
traversal lists the nodes, and sums run up from the last to the first.

Only nodes on the first and last path of a shard can lie in other shards too. These
boundary nodes, two paths a shard, are merged by the hash of their prefix. What each
adds to its ancestors is added up along the boundary paths of the shard that owns it.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import crc32_text, cut_table, lists_of

SHARD_TURNS = 50_000
LEAST_SHARDS = 4
NO_ENDS = hashlib.sha256(b"").hexdigest()


def _short(digest: Column) -> Column:
    return F.substring(F.unhex(digest), 1, 16)


def sequences(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, turns): the turns of each conversation as structs (turn, digest, words), by turn, null first, and by digest where turns tie.

    The digest stands for role and text, null as empty. Rows without a conv_id belong to no conversation and are left out.
    A conversation is one row, 40 bytes a turn; its texts are never gathered.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    turns = conversations.where(F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("conv_id"),
        F.struct(
            F.col(turn_col).alias("turn"),
            _short(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)).alias("digest"),
            F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")).cast("long").alias("words"),
        ).alias("turn"),
    )
    return turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("turn")).alias("turns"))


def rebuilt(sequences: DataFrame, family: int = 20, most: int = 4) -> DataFrame:
    """Conversations of which the first h turns, h = crc32 of the id modulo `most`, are those of the first of their family of `family` ids."""
    base = F.col("conv_id") - F.col("conv_id") % family
    heads = sequences.where(F.col("conv_id") % family == 0).select(F.col("conv_id").alias("base"), F.slice("turns", 1, most - 1).alias("head"))
    h = F.pmod(crc32_text(F.col("conv_id")), F.lit(most)).cast("int")
    given = sequences.withColumn("base", base).join(heads, "base", "left")
    head = F.slice(F.coalesce("head", F.slice("turns", 1, 0)), F.lit(1), h)
    return given.select("conv_id", F.concat(head, F.slice("turns", h + 1, F.greatest(F.size("turns") - h, F.lit(0)))).alias("turns"))


def members(paths: DataFrame) -> DataFrame:
    """(path, conv_id, n, ends): of the conversations with one path the smallest, their number, and the SHA-256 of their ids, ascending, with commas between."""

    def join(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            path, ids = batch.column("path"), batch.column("conv_id")
            fresh = np.concatenate([[True], pc.not_equal(path.slice(1), path.slice(0, len(path) - 1)).to_numpy(zero_copy_only=False).astype(bool)])
            run = pa.array(np.cumsum(fresh) - 1)
            heads = pa.array(np.flatnonzero(fresh))
            lists = lists_of(ids.cast(pa.string()), run, len(heads))
            yield pa.RecordBatch.from_arrays([path.take(heads), ids.take(heads), pc.list_value_length(lists).cast(pa.int64()), pc.binary_join(lists, ",")], names=["path", "first", "n", "ids"])

    def hash_up(batches):
        path, done = None, []
        for batch in batches:
            for own, first, n, ids in zip(*(batch.column(c).to_pylist() for c in ("path", "first", "n", "ids"))):
                if own != path:
                    if path is not None:
                        done.append((path, least, count, state.hexdigest()))
                    path, least, count, state = own, first, n, hashlib.sha256(ids.encode())
                else:
                    count += n
                    state.update(b"," + ids.encode())
            if len(done) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*done)], names=["path", "conv_id", "n", "ends"])
                done = []
        if path is not None:
            done.append((path, least, count, state.hexdigest()))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*done)], names=["path", "conv_id", "n", "ends"])

    slim = paths.select("path", "conv_id")
    pieces = slim.repartitionByRange("path", "conv_id").sortWithinPartitions("path", "conv_id").mapInArrow(join, "path binary, first long, n long, ids string")
    return pieces.repartition("path").sortWithinPartitions("path", "first").mapInArrow(hash_up, "path binary, conv_id long, n long, ends string")


class Tree:
    """A ternary search tree over sequences of small numbers. Node 0 is the empty prefix; `below` leads to the first child found, `less` and `more` to its siblings."""

    def __init__(self):
        self.mark, self.less, self.below, self.more = [-1], [-1], [-1], [-1]

    def _new(self, mark: int) -> int:
        self.mark.append(mark)
        for links in (self.less, self.below, self.more):
            links.append(-1)
        return len(self.mark) - 1

    def insert(self, path: list[int]) -> int:
        """The node of the whole path."""
        at = 0
        for mark in path:
            links, here = self.below, at
            while links[here] >= 0:
                here = links[here]
                if mark == self.mark[here]:
                    break
                links = self.less if mark < self.mark[here] else self.more
            else:
                new = self._new(mark)
                links[here] = new
                here = new
            at = here
        return at

    def insert_medians(self, paths: list[list[int]]) -> list[int]:
        """The node of each path; of sorted paths the median goes in first, then those of the halves, which keeps the siblings' trees low."""
        nodes, ranges = [0] * len(paths), [(0, len(paths))]
        while ranges:
            low, high = ranges.pop()
            if low < high:
                middle = (low + high) // 2
                nodes[middle] = self.insert(paths[middle])
                ranges += [(low, middle), (middle + 1, high)]
        return nodes

    def traverse(self) -> tuple[list[int], list[int], list[int]]:
        """All nodes, parents before children, and the parent and depth of each by number."""
        parent, depth, order = [-1] * len(self.mark), [0] * len(self.mark), [0]
        stack = [(self.below[0], 0)]
        while stack:
            at, above = stack.pop()
            if at < 0:
                continue
            parent[at], depth[at] = above, depth[above] + 1
            order.append(at)
            stack += [(self.less[at], above), (self.more[at], above), (self.below[at], at)]
        return order, parent, depth


SHARD = "shard int, slot int, parent_slot int, key binary, parent_key binary, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, words long, ends_sha256 string"


def shard_nodes(shard: int, table: pa.Table) -> pa.Table:
    """The nodes of a shard's paths, in the columns of SHARD. Boundary nodes have a slot; their children, leaves and savings leave out boundary nodes, their own included."""
    digests = table.column("digests").combine_chunks()
    encoded = digests.flatten().dictionary_encode()
    named = encoded.dictionary.to_pylist()
    rank = np.empty(len(named), np.int64)
    rank[sorted(range(len(named)), key=named.__getitem__)] = np.arange(len(named))
    marks = rank[encoded.indices.to_numpy()] if len(named) else np.empty(0, np.int64)
    words = table.column("words").combine_chunks().flatten().to_numpy(zero_copy_only=False)
    starts = np.concatenate([[0], np.cumsum(pc.list_value_length(digests).to_numpy())]).tolist()
    paths = [marks[a:b].tolist() for a, b in zip(starts, starts[1:])]
    # The rows come in any order; the paths are sorted by the ranks of their digests, which is the order of the shards.
    rows = sorted(range(len(paths)), key=paths.__getitem__)
    tree = Tree()
    ends_at = dict(zip(rows, tree.insert_medians([paths[r] for r in rows])))
    order, parent, depth = tree.traverse()
    size = len(order)
    n, least, ends, word, kids, leaves, saved = [0] * size, [1 << 63] * size, [None] * size, [0] * size, [0] * size, [0] * size, [0] * size
    sums, conv, done = table.column("n").to_pylist(), table.column("conv_id").to_pylist(), table.column("ends").to_pylist()
    for r, node in ends_at.items():
        n[node], least[node], ends[node] = sums[r], conv[r], done[r]
        # The words of every node on the way, once.
        at, k = node, len(paths[r]) - 1
        while k >= 0 and not word[at]:
            word[at] = int(words[starts[r] + k]) + 1
            at, k = parent[at], k - 1
    word = [max(0, w - 1) for w in word]
    slots, keys = {0: 0}, {0: b""}
    for r in (rows[0], rows[-1]):
        at, line = ends_at[r], []
        while at:
            line.append(at)
            at = parent[at]
        for k, node in enumerate(reversed(line)):
            if node not in slots:
                slots[node] = len(slots)
                keys[node] = hashlib.sha256(keys[parent[node]] + named_of(encoded, starts[r] + k)).digest()[:16]
    for at in reversed(order):
        if at not in slots:
            leaves[at] += not kids[at]
            saved[at] += (n[at] - 1) * word[at]
        above = parent[at]
        if above >= 0:
            n[above] += n[at]
            least[above] = min(least[above], least[at])
            leaves[above] += leaves[at]
            saved[above] += saved[at]
            kids[above] += at not in slots
    known = [None if p < 0 or p in slots else least[p] for p in parent]
    columns = [
        [shard] * size, [slots.get(i) for i in range(size)], [slots.get(p) for p in parent], [keys.get(i) for i in range(size)], [keys.get(p) if i in slots else None for i, p in enumerate(parent)],
        least, depth, known, n, kids, leaves, saved, word, ends,
    ]
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "string": pa.string()}
    fields = [x.split(" ") for x in SHARD.split(", ")]
    return pa.table({name: pa.array(values, kinds[kind]) for (name, kind), values in zip(fields, columns)})


def named_of(encoded: pa.DictionaryArray, at: int) -> bytes:
    return encoded.dictionary[encoded.indices[at].as_py()].as_py()


def _merged(parts: DataFrame) -> DataFrame:
    """The boundary nodes of all shards: key, what its parts add up to, and the shard and slot that own it."""
    merged = parts.groupBy("key").agg(
        F.max("parent_key").alias("parent_key"), F.max("depth").alias("depth"), F.max("words").alias("words"), F.min("conv_id").alias("conv_id"), F.sum("n_convs").alias("n_convs"),
        F.sum("n_children").alias("inner"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"), F.max("ends_sha256").alias("ends_sha256"), F.min(F.struct("shard", "slot")).alias("owner"),
    )
    kids = parts.where("parent_key is not null").groupBy(F.col("parent_key").alias("key")).agg(F.countDistinct("key").alias("outer"))
    return merged.join(kids, "key", "left").withColumn("n_children", F.col("inner") + F.coalesce("outer", F.lit(0))).drop("inner", "outer")


def _summed_up(parts: DataFrame, merged: DataFrame) -> DataFrame:
    """(key, leaves, saved): what boundary nodes add to themselves and the boundary nodes above them; each counts in the shard that owns it."""
    owned = F.struct("shard", "slot") == F.col("owner")
    given = parts.select("shard", "slot", "parent_slot", "key").join(merged.select("key", "owner", "n_children", ((F.col("n_convs") - 1) * F.col("words")).alias("own")), "key")
    given = given.select("shard", "slot", "parent_slot", "key", F.when(owned & (F.col("n_children") == 0), 1).otherwise(0).alias("leaves"), F.when(owned, F.col("own")).otherwise(0).alias("saved"))

    def up(key, table):
        table = table.sort_by("slot")
        above, leaves, saved = (table.column(c).to_pylist() for c in ("parent_slot", "leaves", "saved"))
        for slot in range(len(above) - 1, 0, -1):
            leaves[above[slot]] += leaves[slot]
            saved[above[slot]] += saved[slot]
        return pa.table({"key": table.column("key"), "leaves": pa.array(leaves, pa.int64()), "saved": pa.array(saved, pa.int64())})

    sums = given.groupBy("shard").applyInArrow(up, "key binary, leaves long, saved long")
    return sums.groupBy("key").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))


def prefix_nodes(sequences: DataFrame, shard_turns: int = SHARD_TURNS, least_shards: int = LEAST_SHARDS) -> DataFrame:
    """One row per distinct prefix of the conversations (conv_id, turns): conv_id (smallest member), depth, parent_conv_id (null for the empty prefix),
    n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    A member starts with the prefix. n_leaves and saved_tokens are over the
    prefix and all that continue it: those that nothing continues, and the
    members but one times the words of the last turn. ends_sha256 is of the ids of
    the conversations that are the prefix, ascending, with commas between. conv_id
    is unique. A conversation without turns is a member of the empty prefix alone;
    without conversations there is no row. A shard has about `shard_turns` turns of
    distinct paths, or one path; there are `least_shards` at least.
    """
    digests = F.transform("turns", lambda t: t.digest)
    path = _short(F.sha2(F.array_join(F.transform("turns", lambda t: F.hex(t.digest)), ""), 256))
    paths = cut_table(sequences.select("conv_id", path.alias("path"), digests.alias("digests"), F.transform("turns", lambda t: t.words).alias("words")))
    distinct = cut_table(members(paths).drop("path").join(paths.drop("path"), "conv_id"))
    turns = distinct.agg(F.sum(F.size("digests"))).first()[0] or 0
    shards = max(least_shards, math.ceil(turns / shard_turns))

    def run(batches):
        from pyspark import TaskContext

        table = pa.Table.from_batches(held) if (held := [b for b in batches if b.num_rows]) else None
        if table is not None:
            yield from shard_nodes(TaskContext.get().partitionId(), table).to_batches(max_chunksize=10_000)

    nodes = cut_table(distinct.repartitionByRange(shards, "digests").mapInArrow(run, SHARD))
    parts = nodes.where("slot is not null")
    merged = cut_table(_merged(parts))
    sums = _summed_up(parts, merged)
    above = merged.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("parent_conv_id"))
    outer = merged.join(sums, "key").join(above, "parent_key", "left").withColumns({"n_leaves": F.col("n_leaves") + F.col("leaves"), "saved_tokens": F.col("saved_tokens") + F.col("saved")})
    inner = nodes.where("slot is null")
    heads = parts.select("shard", F.col("slot").alias("parent_slot"), "key").join(merged.select("key", "conv_id"), "key").select("shard", "parent_slot", F.col("conv_id").alias("parent_conv_id"))
    under = inner.where("parent_slot is not null").drop("parent_conv_id").join(heads, ["shard", "parent_slot"])
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(NO_ENDS)).alias("ends_sha256")]
    return inner.where("parent_slot is null").select(columns).unionByName(under.select(columns)).unionByName(outer.select(columns))
