"""Model names to prices, and tokens to dollars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

THRESHOLD = 200_000

# Providers whose models get short aliases first, in order.
ALIAS_PROVIDERS = ["anthropic", "openai", "google", "xai", "deepseek", "moonshotai", "minimax", "zai", "alibaba", "stepfun", "xiaomi", "mistral", "cohere"]
# A model with one of these words gets no short alias.
NO_ALIAS_WORDS = ["speech", "embedding", "image", "tts", "asr", "video", "ocr", "audio", "realtime", "vision"]
# Variant suffixes, tried in order.
VARIANT_SUFFIXES = ["-fast", "-mini", "-turbo", "-pro", "-lite", "-plus", "-preview", "-latest", "-build"]

RATES = ("input", "output", "cache_read", "cache_write")
CATALOG = "map<string, struct<models: map<string, struct<cost: struct<input: double, output: double, cache_read: double, cache_write: double>>>>>"


def flatten_catalog(catalog: DataFrame, json_col: str = "json") -> DataFrame:
    """(model_key, provider_id, model_id, four rates per token) from provider -> models -> cost per million.

    Rates that are not positive are absent; a model without input and output rates is left out.
    """
    providers = catalog.select(F.explode(F.from_json(json_col, CATALOG)).alias("provider_id", "p"))
    models = providers.select("provider_id", F.explode("p.models").alias("model_id", "m"))
    rates = [F.when(F.col(f"m.cost.{r}") > 0, F.col(f"m.cost.{r}") / 1e6).alias(r) for r in RATES]
    return models.select(F.lower(F.trim(F.concat_ws("/", "provider_id", "model_id"))).alias("model_key"), "provider_id", "model_id", *rates).where("input is not null or output is not null")


def short_aliases(flat: DataFrame) -> DataFrame:
    """`flat` and the models by their short names: the preferred providers' first, then by provider and model; full keys win."""
    rank = F.coalesce(F.array_position(F.array(*map(F.lit, ALIAS_PROVIDERS)), F.col("provider_id")), F.lit(0))
    short = flat.withColumn("model_key", F.lower(F.trim("model_id"))).withColumn("rank", F.when(rank > 0, rank).otherwise(len(ALIAS_PROVIDERS) + 1))
    short = short.where(~F.col("model_key").rlike("|".join(NO_ALIAS_WORDS)))
    first = Window.partitionBy("model_key").orderBy("rank", "provider_id", "model_id")
    short = short.withColumn("n", F.row_number().over(first)).where("n = 1").join(flat.select("model_key"), "model_key", "left_anti")
    return flat.unionByName(short.drop("n", "rank"))


def cached_aliases(rows: DataFrame) -> DataFrame:
    """A prefixed key also stands for what follows its first slash, unless that key is there itself."""
    more = rows.withColumn("alias", F.expr("substring(model_key, instr(model_key, '/') + 1)")).where("instr(model_key, '/') > 0 and alias <> ''")
    first = Window.partitionBy("alias").orderBy("model_key")
    more = more.withColumn("n", F.row_number().over(first)).where("n = 1").drop("n", "model_key").withColumnRenamed("alias", "model_key")
    return rows.unionByName(more.join(rows.select("model_key"), "model_key", "left_anti"))


def _stripped(name: str) -> str:
    """SQL: a name without a last version part (-dddd or .d), the name itself if it has none."""
    return f"case when {name} rlike '-[0-9]{{4,}}$' then regexp_replace({name}, '-[0-9]{{4,}}$', '') when {name} rlike '^.+[.][0-9]*$' then regexp_replace({name}, '[.][0-9]*$', '') else {name} end"


def model_candidates(model: str) -> Column:
    """Names to look a model up by: as given, after its last slash, without version parts, then without a variant suffix and the same again."""
    base = f"lower(trim({model}))"
    # No name has more version parts than dashes and dots.
    parts = f"size(split({base}, '[-.]'))"
    step = f"(a, i) -> array_distinct(concat(a, transform(a, x -> {_stripped('x')})))"
    named = f"aggregate(sequence(1, {parts}), array_distinct(array({base}, substring_index({base}, '/', -1))), {step})"
    suffix = "|".join(VARIANT_SUFFIXES)
    bare = f"transform(array({named}), a -> concat(a, aggregate(sequence(1, {parts}), array_distinct(transform(filter(a, x -> x rlike '^.+({suffix})$'), x -> regexp_replace(x, '({suffix})$', ''))), {step})))[0]"
    return F.expr(f"array_distinct({bare})")


def lookup(models: DataFrame, prices: DataFrame, model_col: str = "model") -> DataFrame:
    """Prices of distinct models: of the candidates that have an input and an output rate, the first. Models without one are absent."""
    usable = prices.where("input is not null and output is not null")
    tried = models.select(model_col).distinct().select(model_col, F.posexplode(model_candidates(model_col)).alias("at", "model_key"))
    found = tried.join(usable, "model_key").groupBy(model_col).agg(F.min_by(F.struct(*[c for c in usable.columns if c != "model_key"]), "at").alias("p"))
    return found.select(model_col, "p.*")


def estimate_cost(above: bool = True) -> Column:
    """Dollars of the four counters under the price columns; above THRESHOLD tokens a counter's excess has its own rate if there is one. No price, no cost."""
    total = None
    for rate, counter in (("input", "input_tokens"), ("output", "output_tokens"), ("cache_read", "cache_read_tokens"), ("cache_write", "cache_write_tokens")):
        base, own = F.coalesce(F.col(rate), F.lit(0.0)), F.col(counter)
        part = own * base
        if above and rate in ("input", "output"):
            more = F.col(f"{rate}_above")
            part = F.when(more.isNotNull() & (own > THRESHOLD), F.lit(THRESHOLD) * base + (own - THRESHOLD) * more).otherwise(part)
        total = part if total is None else total + part
    return total


def resolve_cost(wire: str = "cost_usd") -> Column:
    """The cost on the wire, even if 0; else the estimate."""
    return F.coalesce(F.col(wire), estimate_cost())
