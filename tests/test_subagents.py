"""Calls and their child sessions: the joins by key against trying all pairs."""

import random
import re

from pyspark.sql import functions as F

from fleetlog.operators import catalog

CALLS = "call_id long, parent_id string, agent_id string, nickname string, description string"


def want(calls, children):
    out = []
    for call, parent, agent, nickname, description in calls:
        agent = None if agent is None else re.sub("^agent-", "", re.sub("@session-.*$", "", agent))
        best = None
        for child, of, title in children:
            if of != parent or parent is None:
                continue
            cut = re.sub(r"(\.\.\.|…)$", "", title) if title is not None else None
            if agent is not None and (child in (agent, "agent-" + agent) or title == agent):
                rule = 1
            elif nickname is not None and nickname == title:
                rule = 2
            elif description and title is not None and (title.startswith(description) or (cut != title and description.startswith(cut))):
                rule = 3
            else:
                continue
            best = min(best or (9, ""), (rule, child))
        if best:
            out.append((call, best[1], best[0]))
    return sorted(out)


def test_all_rules_against_all_pairs(spark):
    rng = random.Random(4)
    word = lambda: rng.choice(["fix", "fix the", "fix the bug", "é", "", "run", "run all", None])
    children = [(f"{rng.choice(['', 'agent-'])}k{i}", rng.choice(["p", "q", None]), rng.choice([word(), f"k{rng.randrange(60)}", (word() or "") + rng.choice(["...", "…", " and more"])])) for i in range(80)]
    calls = [(i, rng.choice(["p", "q", "none", None]), rng.choice([None, f"k{rng.randrange(90)}", f"agent-k{rng.randrange(90)}@session-1"]), word(), rng.choice([word(), (word() or "") + " and so on"])) for i in range(300)]
    got = catalog.match_subagent(spark.createDataFrame(calls, CALLS), spark.createDataFrame(children, "id string, parent_id string, title string"))
    assert sorted(map(tuple, got.collect())) == want(calls, children)


def test_a_parent_of_very_many_children(spark):
    n = 100_000
    children = spark.range(n).select(F.concat(F.lit("c"), "id").alias("id"), F.lit("p").alias("parent_id"), F.concat(F.lit("task "), F.col("id") % 1000, F.lit(" of all")).alias("title"))
    calls = spark.range(n).select(F.col("id").alias("call_id"), F.lit("p").alias("parent_id"), F.when(F.col("id") % 2 == 0, F.concat(F.lit("agent-c"), "id")).alias("agent_id"), F.lit("x").alias("nickname"), F.concat(F.lit("task "), F.col("id") % 1000, F.lit(" of")).alias("description"))
    got = catalog.match_subagent(calls, children)
    assert got.groupBy("rule").count().orderBy("rule").collect() == [(1, n // 2), (3, n // 2)]
