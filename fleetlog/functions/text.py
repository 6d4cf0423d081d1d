"""Expressions over message texts, paths and JSON parts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# How system content starts, and what only it contains.
SYSTEM_PREFIXES = ["<environment_context", "<permissions", "<INSTRUCTIONS>", "<system", "<local-command-stdout>", "<local-command-caveat>"]
SYSTEM_PARTS = ["<observation>", "</observation>", "<command-message>", "</command-message>", "</facts>", "</narrative>", "<INSTRUCTIONS>", "<environment_context>", "<permissions instructions>", "sandbox_mode"]
NO_PROJECT = "(No Project)"


def is_system_content(text: str) -> Column:
    """A known prefix or part, or a text over 200 bytes that starts with `<` and has no code fence."""
    t = F.trim(F.coalesce(text, F.lit("")))
    hit = F.startswith(t, F.lit("<")) & (F.octet_length(t) > 200) & ~F.contains(t, F.lit("```"))
    for p in SYSTEM_PREFIXES:
        hit = hit | F.startswith(t, F.lit(p))
    for p in SYSTEM_PARTS:
        hit = hit | F.contains(t, F.lit(p))
    return hit


def project_name(path: str) -> Column:
    last = F.element_at(F.filter(F.split(path, "/"), lambda x: x != ""), -1)
    return F.when(F.coalesce(path, F.lit("")).isin("", NO_PROJECT), NO_PROJECT).when(F.regexp_like(path, F.lit("^/+$")), F.col(path)).otherwise(last)


def session_title(text: str) -> Column:
    """The first user text without image markers; `Untitled` if nothing is left."""
    left = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\[Image[^\]]*\]", ""))
    return F.coalesce(F.nullif(left, F.lit("")), F.lit("Untitled"))


def redact_home(path: str) -> Column:
    """Home folders as `~`, slashes forward; a path that starts with `~` stays."""
    p = F.replace(path, F.lit("\\"), F.lit("/"))
    for pattern in (r"[A-Za-z]:/Users/[^/]+", r"/Users/[^/]+", r"/home/[^/]+"):
        p = F.regexp_replace(p, pattern, "~")
    return F.when(F.startswith(path, F.lit("~")), F.col(path)).otherwise(p)


def fmt_tokens(n: str) -> Column:
    """1.2M, 3.4k or the digits; one decimal, rounded by the exact binary value."""
    c = F.col(n)
    short = lambda x: F.replace(F.format_number(x, 1), F.lit(","), F.lit(""))
    return F.when(c >= 1_000_000, F.concat(short(c / 1e6), F.lit("M"))).when(c >= 1000, F.concat(short(c / 1e3), F.lit("k"))).otherwise(c.cast("string"))


def image_sources(text: str) -> Column:
    """Sources of `[Image: source: p]` and `[Image source: p]`, in order."""
    return F.regexp_extract_all(text, F.lit(r"\[Image:? source: ([^\]]+)\]"), F.lit(1))


def persisted_paths(text: str) -> Column:
    """Distinct `saved to:` paths inside persisted-output tags."""
    blocks = F.regexp_extract_all(text, F.lit(r"(?s)<persisted-output>(.*?)</persisted-output>"), F.lit(1))
    return F.array_distinct(F.flatten(F.transform(blocks, lambda b: F.regexp_extract_all(b, F.lit(r"saved to: *([^\s<]+)"), F.lit(1)))))


def strip_ansi(text: str) -> Column:
    """Without terminal codes; trimmed lines that aren't blank, joined by a space."""
    plain = F.regexp_replace(text, "\u001b\\[[0-9;?]*[ -/]*[@-~]", "")
    return F.array_join(F.filter(F.transform(F.split(plain, "\n"), lambda x: F.trim(F.regexp_replace(x, r"[\r\t]+", " "))), lambda x: x != ""), " ")


def content_segments(text: str) -> Column:
    """Array of (kind, lang, body): fenced code, images and what is between, in order."""
    piece = r"(?s)```[^\n]*\n.*?(?:```|\z)|\[Image:? source: [^\]]+\]|(?:(?!```[^\n]*\n|\[Image:? source: ).)+"
    pieces = F.regexp_extract_all(text, F.lit(piece), F.lit(0))

    def segment(p):
        code, image = F.startswith(p, F.lit("```")), F.startswith(p, F.lit("[Image"))
        return F.struct(
            F.when(code, "code").when(image, "image").otherwise("text").alias("kind"), F.when(code, F.regexp_extract(p, r"^```([^\n]*)", 1)).alias("lang"),
            F.when(code, F.regexp_replace(F.regexp_replace(p, r"^```[^\n]*\n", ""), r"\n?```$", "")).when(image, F.regexp_extract(p, r"source: ([^\]]+)\]", 1)).otherwise(p).alias("body"),
        )

    return F.transform(pieces, segment)


def display_key(provider: str, variant: str) -> Column:
    """Mirror variants count as providers of their own."""
    return F.when((F.col(provider) == "cc-mirror") & (F.coalesce(variant, F.lit("")) != ""), F.concat_ws(":", provider, variant)).otherwise(F.col(provider))


def user_text_range(text: str, start: str, end: str) -> Column:
    """Code points from start to end, ends clamped."""
    a = F.greatest(F.lit(0), F.least(F.col(start), F.col(end)))
    return F.substr(text, (a + 1).cast("int"), F.greatest(F.lit(0), F.col(end) - a).cast("int"))


def parent_from_path(path: str) -> Column:
    """Id of the session whose folder holds the nearest `subagents` folder above; null without one."""
    return F.nullif(F.regexp_extract(path, r"([^/]+)/subagents/(?!.*/subagents/)", 1), F.lit(""))


def content_parts_text(parts: str) -> Column:
    """Text of an array of (type, text, url): a tagged image, audio or video takes the URL part that follows; unknown types are named."""
    folded = f"""aggregate({parts}, named_struct('out', cast(array() as array<string>), 'tag', ''), (s, p) -> case
        when p.type = 'text' and p.text rlike '^<(image|audio|video)>$' then named_struct('out', s.out, 'tag', regexp_extract(p.text, '^<(.*)>$', 1))
        when p.type = 'text' then named_struct('out', array_append(s.out, p.text), 'tag', '')
        when p.type rlike '^(image|audio|video)_url$' then named_struct('out', array_append(s.out, concat('[', initcap(if(s.tag <> '', s.tag, substring_index(p.type, '_', 1))), ': source: ', coalesce(p.url, ''), ']')), 'tag', '')
        else named_struct('out', array_append(s.out, concat('[unsupported ', p.type, ']')), 'tag', '') end, s -> array_join(s.out, '\\n'))"""
    return F.expr(folded)


def agent_mail(text: str) -> Column:
    """One `[agent_mail] sender: summary` for each message block; the whole text as one mail without a block."""
    blocks = F.regexp_extract_all(text, F.lit(r'(?s)<teammate-message[^>]*teammate_id="[^"]+"[^>]*>.*?</teammate-message>'), F.lit(0))
    made = F.transform(blocks, lambda b: F.concat(F.lit("[agent_mail] "), F.regexp_extract(b, r'teammate_id="([^"]+)"', 1), F.lit(": "), F.coalesce(F.nullif(F.regexp_extract(b, r'summary="([^"]*)"', 1), F.lit("")), F.regexp_extract(b, r"(?s)>\s*(.*?)\s*</teammate-message>", 1))))
    return F.when(F.size(made) > 0, made).otherwise(F.array(F.concat(F.lit("[agent_mail] "), F.trim(text))))
