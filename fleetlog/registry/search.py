"""Search queries over documents, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import search
from ..sources import tables as T

QUERIES, ORACLES = {}, {}
DOCS = f"WITH {T.DOCS_SQL}, folded AS (SELECT *, translate(coalesce(title, ''), '{search.UPPER}', '{search.LOWER}') AS t, translate(coalesce(content_text, ''), '{search.UPPER}', '{search.LOWER}') AS c, translate(coalesce(project_name, ''), '{search.UPPER}', '{search.LOWER}') AS p FROM docs)"
Q, Q2 = "the an", "Él"
Q2_FOLDED = search.fold_text(Q2)
HIT = f"(contains(t, '{Q}') OR contains(c, '{Q}') OR contains(p, '{Q}'))"


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def docs(spark, sf):
    return T.search_docs(spark, sf)


@query("srch_2_phrase_search", f"{DOCS} SELECT id, title FROM folded WHERE {HIT}")
def srch_2(spark, sf):
    return search.phrase_search(docs(spark, sf), "The AN ").select("id", "title")


@query("srch_2_phrase_search_accents", f"{DOCS} SELECT id FROM folded WHERE contains(t, '{Q2_FOLDED}') OR contains(c, '{Q2_FOLDED}') OR contains(p, '{Q2_FOLDED}')")
def srch_2_accents(spark, sf):
    return search.phrase_search(docs(spark, sf), Q2).select("id")


@query("srch_3_like_search", f"{DOCS} SELECT id FROM folded WHERE t LIKE '%e_t%q%' OR c LIKE '%e_t%q%' OR p LIKE '%e_t%q%'")
def srch_3(spark, sf):
    return search.like_search(docs(spark, sf), "E_t%q", literal=False).select("id")


@query("srch_4_relevance_tiers", f"{DOCS} SELECT id, CASE WHEN contains(t, '{Q}') THEN 0 WHEN contains(p, '{Q}') THEN 1 ELSE 2 END AS tier FROM folded WHERE {HIT} ORDER BY tier, created_at DESC, id LIMIT 100")
def srch_4(spark, sf):
    return search.search(docs(spark, sf), Q).select("id", "tier")


@query("srch_5_bm25", f"""{DOCS}, s AS (SELECT id, 10.0 * ((length(t) - length(replace(t, '{Q}', ''))) / {len(Q)}) + 1.0 * ((length(c) - length(replace(c, '{Q}', ''))) / {len(Q)}) + 5.0 * ((length(p) - length(replace(p, '{Q}', ''))) / {len(Q)}) AS tf, length(c) AS len FROM folded),
  a AS (SELECT count(*) AS n, count(*) FILTER (tf > 0) AS df, avg(len) AS al FROM s) SELECT id, round(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * len / al)), 6) AS score FROM s, a WHERE tf > 0 ORDER BY score DESC, id LIMIT 100""")
def srch_5(spark, sf):
    return search.bm25(docs(spark, sf), Q)


@query("srch_6_filters", f"{DOCS} SELECT id FROM folded WHERE provider = 'en' AND contains(project_name, 'c1') AND created_at > 100 AND created_at < 800 ORDER BY created_at DESC, id LIMIT 100")
def srch_6(spark, sf):
    return search.search(docs(spark, sf), "", provider="en", project="c1", after=100, before=800).select("id")


@query("srch_7_cap", f"{DOCS} SELECT id FROM folded WHERE contains(t, 'e') OR contains(c, 'e') OR contains(p, 'e') ORDER BY CASE WHEN contains(t, 'e') THEN 0 WHEN contains(p, 'e') THEN 1 ELSE 2 END, created_at DESC, id LIMIT 100")
def srch_7(spark, sf):
    return search.search(docs(spark, sf), "e").select("id")


@query("srch_8_snippet", f"""{DOCS}, f AS (SELECT id, CASE WHEN contains(t, '{Q}') THEN title WHEN contains(c, '{Q}') THEN content_text ELSE project_name END AS x, CASE WHEN contains(t, '{Q}') THEN t WHEN contains(c, '{Q}') THEN c ELSE p END AS y FROM folded WHERE {HIT}),
  g AS (SELECT id, x, length(x) AS n, greatest(0, least(greatest(0, strpos(y, '{Q}') - 1 - 80), length(x) - 200)) AS st FROM f)
  SELECT id, CASE WHEN n <= 200 THEN x ELSE concat(CASE WHEN st > 0 THEN '...' ELSE '' END, substr(x, st + 1, 200), CASE WHEN st + 200 < n THEN '...' ELSE '' END) END AS snippet FROM g""")
def srch_8(spark, sf):
    return search.snippet(docs(spark, sf), Q)


@query("srch_9_highlight", f"{DOCS} SELECT id, regexp_replace(title, '(ti)', '<mark>\\1</mark>', 'gi') AS marked FROM folded WHERE contains(t, 'ti')")
def srch_9(spark, sf):
    return docs(spark, sf).where(search.contains("title", "ti")).select("id", search.highlight("title", "ti").alias("marked"))


@query("srch_10_trigram_postings", f"{DOCS}, g AS (SELECT id, 'title' AS field, t AS x FROM folded UNION ALL SELECT id, 'project_name', p FROM folded) SELECT DISTINCT substr(x, CAST(i AS INTEGER), 3) AS trigram, id, field FROM (SELECT id, field, x, unnest(range(1, length(x) - 1)) AS i FROM g WHERE length(x) >= 3)")
def srch_10(spark, sf):
    return search.trigram_postings(docs(spark, sf), ("title", "project_name"))


@query("srch_10_trigram_candidates", f"{DOCS} SELECT id FROM folded WHERE (contains(t, 'the') AND contains(t, 'he ') AND contains(t, 'e a') AND contains(t, ' an')) OR (contains(c, 'the') AND contains(c, 'he ') AND contains(c, 'e a') AND contains(c, ' an'))")
def srch_10_candidates(spark, sf):
    return search.candidates(search.trigram_postings(docs(spark, sf)), Q)


_SAID = (
    "session_id", "msg_index", "CASE WHEN session_id % 10 = 3 THEN 'system' ELSE role END AS role", "tool_name", """CASE WHEN role = 'tool' THEN repeat(concat('{"k":', msg_index, '} '), CAST(msg_index % 60 AS INT)) END AS tool_input""",
    """CASE WHEN session_id % 10 = 3 THEN content WHEN role = 'system' AND msg_index % 2 = 0 THEN concat('[thinking]  ', repeat(content, 90)) WHEN msg_index % 4 = 0 THEN '  '
      WHEN msg_index % 4 = 1 THEN repeat(concat(' ', content), 40) ELSE content END AS content""",
)


@query("srch_1_indexable_text", f"""WITH {T.event_messages_sql()}, said AS (SELECT {", ".join(_SAID)} FROM messages), p AS (SELECT session_id, msg_index, CASE role
    WHEN 'tool' THEN array_to_string(list_filter([tool_name, CASE WHEN trim(tool_input) <> '' THEN substr(tool_input, 1, 300) END, substr(trim(content), 1, 300)], lambda x: x <> ''), chr(10))
    WHEN 'system' THEN CASE WHEN starts_with(content, '[thinking]') THEN substr(ltrim(substr(content, 11)), 1, 1000) END ELSE CASE WHEN trim(content) <> '' THEN content END END AS part FROM said)
  SELECT session_id, coalesce(string_agg(part, chr(10) ORDER BY msg_index) FILTER (part <> ''), concat('session ', session_id)) AS text FROM p GROUP BY 1""")
def srch_1(spark, sf):
    """Whole dialogue, with thinking, tools and sessions that have none of it."""
    said = T.event_messages(spark, sf).selectExpr(*_SAID)
    return search.indexable_text(said, said.select("session_id").distinct().withColumn("content_text", F.concat(F.lit("session "), "session_id")))
