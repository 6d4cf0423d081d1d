"""The prefix trie against a dictionary of all prefixes."""

import hashlib
import math
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from fleetlog.llm import prefix_trie, queries


def digest(role, text):
    return hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()[:16]


def want(rows, rebuild=True):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, digest(role or "", text or ""), role or "", text or ""))
    own = {c: [t[3:] for t in sorted(v)] for c, v in own.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        built[c] = own.get(c - int(math.fmod(c, 20)), [])[:h] + turns[h:] if rebuild else turns
    nodes = {}
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(tuple(turns[:d]), []).append(c)
    ends = {}
    for c, turns in built.items():
        ends.setdefault(tuple(turns), []).append(c)
    kids = {}
    for p in nodes:
        if p:
            kids.setdefault(p[:-1], []).append(p)
    leaves, saved = dict.fromkeys(nodes, 0), dict.fromkeys(nodes, 0)
    for p, held in nodes.items():
        words = len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        for d in range(len(p) + 1):
            leaves[p[:d]] += p not in kids
            saved[p[:d]] += (len(held) - 1) * words
    return sorted(
        (min(held), len(p), min(nodes[p[:-1]]) if p else -99, len(held), len(kids.get(p, [])), leaves[p], saved[p], hashlib.sha256(",".join(map(str, sorted(ends.get(p, [])))).encode()).hexdigest())
        for p, held in nodes.items()
    )


def got(nodes):
    return sorted((r.conv_id, r.depth, -99 if r.parent_conv_id is None else r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in nodes.collect())


def talks(seed, n):
    rng = random.Random(seed)
    said = [None, "", "one two", "\x0bthree \x85four\x1c", "häßlich 漢字", *(" ".join(["w"] * k) for k in range(9))]
    rows = [(None, 0, "user", "nobody's"), (7, None, None, None), (7, 3, "user", None)]
    for c in range(-30, n):
        if c % 9:
            turns = [(rng.choice(["user", "assistant", None]), rng.choice(said)) for _ in range(rng.choice([1, 2, 3, 5, 8]))] if rng.random() < 0.6 else [("user", "hot first"), ("assistant", "copy")] * rng.randrange(1, 4)
            turn = 0
            for role, text in turns:
                rows.append((c, turn if rng.random() < 0.9 else None, role, text))
                turn += rng.randrange(3)
    rows += [(400, t, "user", "deep") for t in range(600)] + [(401, t, "user", "deep") for t in range(500)] + [(5, 1, "user", "twice")] * 2
    return rows


@pytest.fixture(scope="module")
def rows():
    return talks(6, 200)


@pytest.fixture(scope="module")
def given(spark, rows):
    return spark.createDataFrame([(*r, 1, b"x") for r in rows], "conv_id long, turn long, role string, text string, depth int, digest binary").repartition(5)


@pytest.mark.parametrize("how", [{}, {"shard_turns": 30}, {"shard_turns": 1}, {"least_shards": 1}])
def test_nodes(given, rows, how):
    built = prefix_trie.rebuilt(prefix_trie.sequences(given))
    assert got(prefix_trie.prefix_nodes(built, **how)) == want(rows)


def test_nodes_as_they_are(given, rows):
    assert got(prefix_trie.prefix_nodes(prefix_trie.sequences(given), shard_turns=100)) == want(rows, rebuild=False)


def test_no_conversations(spark, given):
    none = prefix_trie.rebuilt(prefix_trie.sequences(given.where("false")))
    assert prefix_trie.prefix_nodes(none).count() == 0
    # A conversation that has no turn of its own after the shared ones, and no first of its family.
    c = next(c for c in range(1, 20) if zlib.crc32(str(c).encode()) % 4 > 1)
    one = spark.createDataFrame([(c, 0, "user", "gone")], "conv_id long, turn long, role string, text string")
    assert got(prefix_trie.prefix_nodes(prefix_trie.rebuilt(prefix_trie.sequences(one)))) == [(c, 0, -99, 1, 0, 1, 0, hashlib.sha256(str(c).encode()).hexdigest())]


def test_a_large_group_is_hashed_in_pieces(spark):
    same = spark.range(30_000).select(F.col("id").alias("conv_id"), F.lit(0).cast("long").alias("turn"), F.lit("user").alias("role"), F.lit("a b").alias("text"))
    nodes = got(prefix_trie.prefix_nodes(prefix_trie.sequences(same)))
    whole = hashlib.sha256(",".join(map(str, range(30_000))).encode()).hexdigest()
    assert nodes == [(0, 0, -99, 30_000, 1, 1, 29_999 * 2, hashlib.sha256(b"").hexdigest()), (0, 1, 0, 30_000, 0, 1, 29_999 * 2, whole)]


def test_trees_are_low():
    tree = prefix_trie.Tree()
    tree.insert_medians([[k] for k in range(1000)])
    low, stack = 0, [(tree.below[0], 1)]
    while stack:
        at, deep = stack.pop()
        if at >= 0:
            low = max(low, deep)
            stack += [(tree.less[at], deep + 1), (tree.more[at], deep + 1)]
    assert low == 10


def test_registered(spark, sf):
    assert queries.op12_prefix_trie(spark, sf).where("depth = 0").count() == 1
