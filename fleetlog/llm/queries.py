"""The numbered queries: each applies its operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fill_middle, iblt, langid, line_runs, mixing, path_join, piece_table, prefix_trie, range_join, sharding, suffix_dedup, token_counts, warc
from .common import crc32_text, shared_dir, table


def fold(id_col: str = "doc_id"):
    """crc32 of the id as text, mod 4; the fold 2 is held out."""
    return F.pmod(crc32_text(F.col(id_col)), F.lit(4))


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return iblt.fingerprints(table(spark, sf_dir, "documents"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(fold() == 2, F.lit(False))
    predicted = langid.predict(docs, langid.fit(docs, ~held_out))
    return predicted.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    indexed = warc.archive_pages(table(spark, sf_dir, "pages"))
    return warc.read_records(indexed, shared_dir(spark)).drop("payload")


def op5_range_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return range_join.near_vectors(table(spark, sf_dir, "embeddings"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"))


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = piece_table.encode(table(spark, sf_dir, "documents"))
    return encoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = token_counts.count_tokens(table(spark, sf_dir, "documents"))
    return counted.withColumn("over_limit", F.col("n_tokens") > 4096)


def op10_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return path_join.near_duplicates(table(spark, sf_dir, "documents"))


def op11_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_middle.fill_in_middle(table(spark, sf_dir, "documents"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(fill_middle.restored(), 256).alias("restored_sha256"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = prefix_trie.sequences(table(spark, sf_dir, "conversations"))
    return prefix_trie.prefix_nodes(prefix_trie.rebuilt(given))


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_runs.drop_repeated_lines(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


QUERIES = {
    "op1_fingerprints": op1_fingerprints,
    "op2_language_id": op2_language_id,
    "op3_mixing": op3_mixing,
    "op4_warc": op4_warc,
    "op5_range_join": op5_range_join,
    "op6_sharding": op6_sharding,
    "op7_sentencepiece": op7_sentencepiece,
    "op8_suffix_dedup": op8_suffix_dedup,
    "op9_token_counts": op9_token_counts,
    "op10_ngram_jaccard": op10_ngram_jaccard,
    "op11_fill_middle": op11_fill_middle,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_line_dedup": op13_line_dedup,
}

#: Groups by following links from the smallest id of each.
_REACH = "reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)"




def _poured(level: str, nodes: str, parent: str) -> str:
    """SQL of one level of the tree: the parents' budgets poured over their children of weight 1, in the order of supply."""
    by = f"PARTITION BY {parent}" if parent else ""
    return f"""{level}_level AS (SELECT *, (least(budget, sum(supply) OVER ({by})) - coalesce(sum(supply) OVER ({by} ORDER BY supply, name ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
      / (count(*) OVER ({by}) - coalesce(count(*) OVER ({by} ORDER BY supply, name ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level FROM ({nodes})),
    {level}_first AS (SELECT *, first(CASE WHEN supply > level + 1e-6 THEN level END IGNORE NULLS) OVER ({by} ORDER BY supply, name ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS water FROM {level}_level),
    {level}_given AS (SELECT *, coalesce(water, supply) AS given FROM {level}_first)"""


ORACLES: dict[str, str] = {
    "op3_mixing": f"""WITH rows AS (SELECT doc_id, row_number() OVER () AS r, md5(coalesce(text, '')) AS digest, coalesce(lang, 'none') AS lang, coalesce(source, 'none') AS source,
      CAST(len(list_filter(regexp_split_to_array(coalesce(text, ''), '[ \\t\\n\\x0B\\f\\r]+'), lambda w: w <> '')) AS BIGINT) AS n_tokens,
      'd' || coalesce(CAST(TRY_CAST(nullif(regexp_extract(coalesce(source, 'none'), '([0-9]+)$', 1), '') AS BIGINT) % 4 AS VARCHAR), '?') AS domain FROM documents),
    leaf AS (SELECT domain, lang, source, CAST(sum(n_tokens) AS BIGINT) AS tokens, CAST(sum(n_tokens) AS DOUBLE) * 4 AS supply FROM rows GROUP BY ALL),
    {_poured('a', "SELECT domain AS name, domain, sum(supply) AS supply, (SELECT floor(sum(tokens) * 0.5) FROM leaf) AS budget FROM leaf GROUP BY ALL", "")},
    {_poured('b', "SELECT l.lang AS name, l.domain, l.lang, sum(l.supply) AS supply, any_value(a.given) AS budget FROM leaf l JOIN a_given a USING (domain) GROUP BY ALL", "domain")},
    {_poured('c', "SELECT l.source AS name, l.domain, l.lang, l.source, l.tokens, l.supply, b.given AS budget FROM leaf l JOIN b_given b USING (domain, lang)", "domain, lang")},
    plan AS (SELECT domain, lang, source, tokens, CAST(floor(given + 1e-6) AS BIGINT) AS leaf_budget FROM c_given),
    part AS (SELECT *, CASE WHEN tokens > 0 THEN leaf_budget // tokens ELSE 0 END AS whole, CASE WHEN tokens > 0 THEN leaf_budget % tokens ELSE 0 END AS rest FROM plan),
    line AS (SELECT *, sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY md5(concat_ws(':', '3', whole, coalesce(CAST(doc_id AS VARCHAR), ''), digest))[:15], doc_id, digest, r) AS upto FROM rows JOIN part USING (domain, lang, source))
    SELECT doc_id, domain, lang, source, n_tokens, CAST(whole + CASE WHEN rest > 0 AND upto <= rest THEN 1 ELSE 0 END AS BIGINT) AS copies, tokens AS leaf_tokens, leaf_budget FROM line""",
    "op5_range_join": f"""WITH RECURSIVE ok AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings WHERE label IS NOT NULL AND len(embedding) > 0
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
    links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
    {_REACH}, low AS (SELECT a, min(b) AS b FROM reach GROUP BY a), n AS (SELECT a, count(*) AS n FROM links GROUP BY a)
    SELECT vec_id, coalesce(n.n, 0) AS n_links, least(vec_id, coalesce(low.b, vec_id)) AS component_id, least(vec_id, coalesce(low.b, vec_id)) = vec_id AS kept
    FROM embeddings LEFT JOIN low ON low.a = vec_id LEFT JOIN n ON n.a = vec_id""",
    "op10_ngram_jaccard": f"""WITH RECURSIVE words AS (SELECT doc_id, text, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '\\s+'), lambda w: w <> '') AS w FROM documents),
    grams AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g FROM words),
    sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY 1),
    shared AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM grams x JOIN grams y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2),
    links AS (SELECT a, b FROM shared JOIN sizes s ON s.doc_id = a JOIN sizes t ON t.doc_id = b WHERE c >= 0.8 * (s.n + t.n - c)
      UNION SELECT x.doc_id, y.doc_id FROM words x JOIN words y ON coalesce(x.text, '') = coalesce(y.text, '') AND x.doc_id <> y.doc_id),
    {_REACH}, low AS (SELECT a, min(b) AS b FROM reach GROUP BY a), n AS (SELECT a, count(*) AS n FROM links GROUP BY a)
    SELECT doc_id, least(doc_id, coalesce(low.b, doc_id)) AS class_id, coalesce(n.n, 0) AS n_links FROM documents LEFT JOIN low ON low.a = doc_id LEFT JOIN n ON n.a = doc_id""",
    "op11_fill_middle": """WITH drawn AS (SELECT doc_id, coalesce(text, '') AS text, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS x FROM documents),
    cut AS (SELECT doc_id, text, regexp_extract_all(text, '[^\\n]*\\n|[^\\n]+') AS u, list_transform([1, 9, 17, 25], lambda i: CAST('0x' || x[i:i + 7] AS BIGINT)) AS h FROM drawn),
    placed AS (SELECT *, len(u) AS n, least(h[1] % (len(u) + 1), h[2] % (len(u) + 1)) AS a, greatest(h[1] % (len(u) + 1), h[2] % (len(u) + 1)) AS b,
      CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h[3] % 100 >= 100 THEN 'plain' WHEN h[4] % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM cut),
    parts AS (SELECT *, array_to_string(u[1:a], '') AS p, array_to_string(u[a + 1:b], '') AS m, array_to_string(u[b + 1:], '') AS s FROM placed)
    SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
      sha256(CASE form WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m WHEN 'spm' THEN '<S>' || s || '<P>' || p || '<M>' || m ELSE text END) AS output_sha256, sha256(text) AS restored_sha256 FROM parts""",
    # crc32 bit by bit, as DuckDB has no function for it.
    "op12_prefix_trie": """WITH turns AS (SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS x FROM conversations WHERE conv_id IS NOT NULL),
    own AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, d) AS pos FROM
      (SELECT conv_id, turn, sha256(strlen(r) || ':' || r || x)[1:32] AS d, len(regexp_extract_all(x, '[^\\x20\\x09-\\x0D]+')) AS w FROM turns)),
    convs AS (SELECT conv_id, conv_id - conv_id % 20 AS base, xor(list_reduce([4294967295::BIGINT] || list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda c: ord(c)::BIGINT),
      lambda a, b: list_reduce([xor(a, b)] || [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[], lambda v, i: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END)), 4294967295) % 4 AS h FROM (SELECT DISTINCT conv_id FROM turns)),
    built AS (SELECT c.conv_id, 0 AS part, pos, d, w FROM convs c JOIN own o ON o.conv_id = c.base AND pos <= h UNION ALL SELECT conv_id, 1, pos, d, w FROM convs JOIN own USING (conv_id) WHERE pos > h),
    prefix AS (SELECT conv_id, row_number() OVER line AS depth, w, string_agg(d, '') OVER line AS p FROM built WINDOW line AS (PARTITION BY conv_id ORDER BY part, pos) UNION ALL SELECT conv_id, 0, 0, '' FROM convs),
    node AS (SELECT p, min(depth) AS depth, min(conv_id) AS conv_id, count(*) AS n, min(w) AS w FROM prefix GROUP BY p),
    ends AS (SELECT p, string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) AS ids FROM (SELECT conv_id, arg_max(p, depth) AS p FROM prefix GROUP BY conv_id) GROUP BY p),
    kids AS (SELECT left(p, length(p) - 32) AS p, count(*) AS k FROM node WHERE depth > 0 GROUP BY 1),
    up AS (SELECT left(p, 32 * CAST(a AS INTEGER)) AS p, count(*) FILTER (k IS NULL) AS leaves, sum((n - 1) * w) AS saved FROM (SELECT p, n, w, k, unnest(range(0, depth + 1)) AS a FROM node LEFT JOIN kids USING (p)) GROUP BY 1)
    SELECT n.conv_id, n.depth, a.conv_id AS parent_conv_id, n.n AS n_convs, coalesce(k, 0) AS n_children, leaves AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
    FROM node n JOIN up USING (p) LEFT JOIN kids USING (p) LEFT JOIN ends USING (p) LEFT JOIN node a ON n.depth > 0 AND a.p = left(n.p, length(n.p) - 32)""",
    "op13_line_dedup": """WITH rows AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
    keyed AS (SELECT r, doc_id, lines, list_transform(lines, lambda x: translate(trim(x, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS keys FROM rows),
    repeated AS (SELECT k FROM (SELECT DISTINCT r, unnest(keys) AS k FROM keyed) GROUP BY k HAVING length(k) >= 1 AND count(*) >= 10),
    held AS (SELECT coalesce(list(k), []) AS ks FROM repeated)
    SELECT doc_id, CAST(len(lines) AS BIGINT) AS n_lines, CAST(len(list_filter(keys, lambda k: list_contains(ks, k))) AS BIGINT) AS n_dropped,
      sha256(coalesce(array_to_string(list_filter(lines, lambda x, i: NOT list_contains(ks, keys[i])), chr(10)), '')) AS kept_sha256 FROM keyed, held""",
}
