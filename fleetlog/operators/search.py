"""Text search over sessions."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FIELDS = ("title", "content_text", "project_name")
WEIGHTS = {"title": 10.0, "content_text": 1.0, "project_name": 5.0}
CAP = 100
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


#: How thinking is marked, and how much of it and of a tool's input or result is searched.
THINKING, THINKING_CHARS, TOOL_CHARS = "[thinking]", 1000, 300


def indexable_text(messages: DataFrame, fallback: DataFrame | None = None) -> DataFrame:
    """(session_id, text): what of a session is searched, a line break between parts, in message order.

    User and assistant texts that aren't blank are whole; of a system row marked as thinking the first THINKING_CHARS; of a tool row its name, input
    and result, TOOL_CHARS each of the last two. A session without such a part has its content_text from `fallback` (session_id, content_text), else an
    empty text. messages have session_id, msg_index, role, content, tool_name and tool_input. The text of a session is one value.
    """
    stripped = lambda c, where: F.regexp_replace(c, where, "")
    content, both, left = F.coalesce("content", F.lit("")), "(?U)^\\s+|\\s+$", "(?U)^\\s+"
    blank = stripped(content, both) == ""
    given = F.coalesce("tool_input", F.lit(""))
    tool = F.array("tool_name", F.when(stripped(given, both) != "", F.substring(given, 1, TOOL_CHARS)), F.substring(stripped(content, both), 1, TOOL_CHARS))
    thought = F.when(F.startswith(content, F.lit(THINKING)), F.substring(stripped(F.substring(content, len(THINKING) + 1, 1 << 30), left), 1, THINKING_CHARS))
    part = (
        F.when(F.col("role").isin("user", "assistant"), F.when(~blank, content)).when(F.col("role") == "system", thought)
        .when(F.col("role") == "tool", F.array_join(F.filter(tool, lambda x: x != ""), "\n"))
    )
    ordered = F.sort_array(F.collect_list(F.when(F.length(part) > 0, F.struct("msg_index", part.alias("part")))))
    made = messages.groupBy("session_id").agg(F.array_join(F.transform(ordered, lambda x: x["part"]), "\n").alias("text"))
    if fallback is None:
        return made
    own = fallback.select(F.col("session_id").alias("_of"), "content_text")
    return made.join(own, F.col("session_id") == F.col("_of"), "left").select("session_id", F.when(F.col("text") == "", F.coalesce("content_text", F.lit(""))).otherwise(F.col("text")).alias("text"))


def ascii_fold(column) -> Column:
    return F.translate(column, UPPER, LOWER)


def fold_text(text: str) -> str:
    return text.translate(str.maketrans(UPPER, LOWER))


def contains(column: str, q: str) -> Column:
    """Whether the text has the query in it, ASCII letters in any case; Java's (?i) without (?u) folds just these, and no folded copy of the text is made."""
    return F.rlike(F.coalesce(column, F.lit("")), F.lit("(?i)" + re.sub(r"([!-/:-@\[-`{-~])", r"\\\1", q)))


def phrase_search(docs: DataFrame, q: str) -> DataFrame:
    """Rows with the whole trimmed query as one phrase in some field, ASCII letters in any case."""
    q = q.strip()
    hit = contains(FIELDS[0], q) | contains(FIELDS[1], q) | contains(FIELDS[2], q)
    return docs.where(hit)


def like_search(docs: DataFrame, q: str, literal: bool = True) -> DataFrame:
    """As phrase_search() for short queries; with literal=False `%` and `_` of the query are wildcards."""
    if literal:
        return phrase_search(docs, q)
    pattern = "%" + fold_text(q.strip()).replace("\\", "\\\\") + "%"
    hits = [ascii_fold(F.coalesce(F.col(f), F.lit(""))).like(pattern) for f in FIELDS]
    return docs.where(hits[0] | hits[1] | hits[2])


def relevance(docs: DataFrame, q: str) -> DataFrame:
    """Adds tier: 0 in the title, 1 in the project name, 2 else."""
    return docs.withColumn("tier", F.when(contains("title", q), 0).when(contains("project_name", q), 1).otherwise(2))


def ranked(docs: DataFrame, q: str) -> DataFrame:
    return relevance(docs, q).orderBy("tier", F.desc("created_at"), "id").limit(CAP)


def frequency(column: str, q: str) -> Column:
    folded = ascii_fold(F.coalesce(F.col(column), F.lit("")))
    return (F.length(folded) - F.length(F.replace(folded, F.lit(fold_text(q)), F.lit("")))) / len(q)


def bm25(docs: DataFrame, q: str, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """The phrase as one term: weighted frequencies over the fields, lengths in characters, best first."""
    tf = sum((frequency(f, q) * WEIGHTS[f] for f in FIELDS[1:]), frequency(FIELDS[0], q) * WEIGHTS[FIELDS[0]])
    scored = docs.select("id", tf.alias("tf"), F.char_length(F.coalesce("content_text", F.lit(""))).alias("len"))
    # One row.
    stats = scored.agg(F.count("*").alias("n"), F.count_if(F.col("tf") > 0).alias("df"), F.avg("len").alias("avg_len"))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    score = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("avg_len")))
    return scored.where("tf > 0").join(F.broadcast(stats)).select("id", F.round(score, 6).alias("score")).orderBy(F.desc("score"), "id").limit(CAP)


def filtered(docs: DataFrame, provider: str | None = None, project: str | None = None, after: int | None = None, before: int | None = None) -> DataFrame:
    if provider is not None:
        docs = docs.where(F.col("provider") == provider)
    if project is not None:
        docs = docs.where(F.contains("project_name", F.lit(project)))
    if after is not None:
        docs = docs.where(F.col("created_at") > after)
    return docs if before is None else docs.where(F.col("created_at") < before)


def search(docs: DataFrame, q: str = "", **filters) -> DataFrame:
    """Filters, phrase, tiers and the cap of 100 rows; nothing for neither query nor filter."""
    kept = filtered(docs, **filters)
    q = q.strip()
    if not q:
        return kept.orderBy(F.desc("created_at"), "id").limit(CAP if any(v is not None for v in filters.values()) else 0)
    return ranked(phrase_search(kept, q), q)


def snippet(docs: DataFrame, q: str, length: int = 200, lead: int = 80) -> DataFrame:
    """(id, snippet) around the first hit in the first field that has one; `...` where a side is cut."""
    text = F.coalesce(*[F.when(contains(f, q), F.col(f)) for f in FIELDS])
    at = F.locate(fold_text(q), ascii_fold(F.col("_text"))) - 1
    start = F.greatest(F.lit(0), F.least(F.greatest(F.lit(0), at - lead), F.char_length("_text") - length))
    cut = F.substr("_text", F.col("_start") + 1, F.lit(length))
    marked = docs.withColumn("_text", text).where("_text is not null").withColumn("_start", start)
    left = F.when(F.col("_start") > 0, "...").otherwise("")
    right = F.when(F.col("_start") + length < F.char_length("_text"), "...").otherwise("")
    return marked.select("id", F.when(F.char_length("_text") <= length, F.col("_text")).otherwise(F.concat(left, cut, right)).alias("snippet"))


def highlight(column: str, q: str) -> Column:
    """Hits in <mark>, from the left and not overlapping; an ASCII query in any case, another exactly."""
    quoted = "(" + re.sub(r"([^\w\s])", r"\\\1", q) + ")"
    return F.regexp_replace(column, F.lit(("(?i)" if q.isascii() else "") + quoted), F.lit("<mark>$1</mark>"))


def _trigrams(text: Column) -> Column:
    """Distinct code-point trigrams; characters are taken apart once, so long texts cost in proportion."""
    chars = F.array(F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0)))
    return F.array_distinct(F.transform(chars, lambda cs: F.transform(F.sequence(F.lit(0), F.size(cs) - 3), lambda i: F.concat(F.get(cs, i), F.get(cs, i + 1), F.get(cs, i + 2))))[0])


def trigram_postings(docs: DataFrame, fields=FIELDS) -> DataFrame:
    """(trigram, id, field) once each."""
    out = None
    for f in fields:
        grams = _trigrams(ascii_fold(F.coalesce(F.col(f), F.lit(""))))
        rows = docs.where(F.char_length(f) >= 3).select(F.explode(grams).alias("trigram"), "id", F.lit(f).alias("field"))
        out = rows if out is None else out.unionByName(rows)
    return out


def candidates(postings: DataFrame, q: str) -> DataFrame:
    """Ids with all trigrams of the query in one field; a superset of the phrase's hits."""
    q = fold_text(q.strip())
    grams = sorted({q[i : i + 3] for i in range(len(q) - 2)})
    return postings.where(F.col("trigram").isin(grams)).groupBy("id", "field").agg(F.count("*").alias("n")).where(F.col("n") == len(grams)).select("id").distinct()


def parse_query(text: str) -> tuple[str, dict]:
    """Takes the first provider:, project:, after: and before: out of a query; dates that aren't are ignored."""
    import datetime

    filters: dict = {}
    for key in ("provider", "project", "after", "before"):
        m = re.search(rf"(?:^|\s){key}:(\S+)", text, re.I)
        if m:
            text = text[: m.start()] + text[m.end() :]
            value = m[1]
            if key in ("after", "before"):
                try:
                    value = int(datetime.datetime.fromisoformat(value).replace(tzinfo=datetime.timezone.utc).timestamp())
                except ValueError:
                    continue
            filters[key] = value
    return text.strip(), filters
