"""Bounded logs, keyed upserts and usage accounting, as pure functions of append-only tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Prices in USD for a million prompt and completion tokens.
PRICING = (
    ("gpt-4o", 2.50, 10.00), ("gpt-4o-mini", 0.15, 0.60), ("o1", 15.00, 60.00),
    ("claude-sonnet-4-20250514", 3.00, 15.00), ("claude-haiku-4-5-20251001", 0.25, 1.25), ("claude-opus-4-6", 15.00, 75.00),
    ("gemini-1.5-flash", 0.075, 0.30), ("gemini-1.5-pro", 1.25, 5.00), ("gemini-2.0-flash", 0.10, 0.40),
    ("deepseek-chat", 0.14, 0.28), ("deepseek-reasoner", 0.55, 2.19),
    ("llama-3.3-70b-versatile", 0.59, 0.79), ("llama-3.1-8b-instant", 0.05, 0.08),
    ("mistral-small-2506", 0.20, 0.60), ("mistral-large-latest", 2.00, 6.00), ("pixtral-large-2411", 2.00, 6.00),
)
HISTORY, EXPORTS = 30, 40


def pricing(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PRICING, "model string, prompt_price double, completion_price double")


def newest(log: DataFrame, most: int, order: list[Column], by: list[str] | None = None) -> DataFrame:
    """The newest ``most`` rows of a log (of each ``by`` group), ``place`` 1 the newest.

    Without groups the limit is taken in every partition before the rows meet.
    """
    if not by:
        top = log.orderBy(*order).limit(most)
        return top.withColumn("place", F.row_number().over(Window.orderBy(*order)))
    w = Window.partitionBy(*by).orderBy(*order)
    return log.withColumn("place", F.row_number().over(w)).where(F.col("place") <= most)


def cost(prompt: Column, completion: Column, prompt_price: Column, completion_price: Column) -> Column:
    zero = F.lit(0.0)
    return F.coalesce(prompt, F.lit(0)) / 1_000_000 * F.coalesce(prompt_price, zero) + F.coalesce(completion, F.lit(0)) / 1_000_000 * F.coalesce(completion_price, zero)


def priced(usage: DataFrame, prices: DataFrame) -> DataFrame:
    """Usage rows (model, prompt_tokens, completion_tokens) with their cost; unknown models cost nothing."""
    out = usage.join(prices, "model", "left")  # broadcast by size, which Spark checks
    return out.withColumn("cost", cost(F.col("prompt_tokens"), F.col("completion_tokens"), F.col("prompt_price"), F.col("completion_price")))


def usage_by_model(usage: DataFrame, prices: DataFrame) -> DataFrame:
    """Tokens and cost by model, from an append-only log (no updates can be lost).

    Tokens are summed before prices are joined, so one row a model is priced.
    """
    sums = usage.groupBy("model").agg(F.sum("prompt_tokens").alias("prompt_tokens"), F.sum("completion_tokens").alias("completion_tokens"))
    return priced(sums, prices).select("model", "prompt_tokens", "completion_tokens", (F.col("prompt_tokens") + F.col("completion_tokens")).alias("total_tokens"), "cost")


def upserted(stored: DataFrame, changes: DataFrame, key: str = "id", pos: str = "pos") -> DataFrame:
    """Rows of ``stored`` replaced in place by changes with their key; new keys come first, the latest foremost.

    Of several changes of a key the one with the largest ``pos`` counts; a new
    key's place is that of its first change.
    """
    names = [c for c in stored.columns if c != pos]
    w = Window.partitionBy(key)
    last = changes.withColumn("__last", F.max(pos).over(w)).withColumn("__first", F.min(pos).over(w)).where(F.col(pos) == F.col("__last"))
    kept = stored.join(last.select(key), key, "left_anti").select(*names, F.col(pos).cast("bigint").alias("place"))
    hit = last.select(*names, "__first").join(stored.select(key, F.col(pos).alias("__at")), key, "left")
    return kept.unionByName(hit.select(*names, F.coalesce(F.col("__at").cast("bigint"), -F.col("__first").cast("bigint") - 1).alias("place")))


def with_defaults(stored: DataFrame, defaults: DataFrame, key: str = "key", value: str = "value") -> DataFrame:
    """Every setting once: the stored value, where there is none the default; settings without a default stay."""
    mine, usual = stored.select(key, F.col(value).alias("__mine"), F.lit(True).alias("__has")), defaults.select(key, F.col(value).alias("__usual"))
    return usual.join(mine, key, "full").select(key, F.when(F.col("__has"), F.col("__mine")).otherwise(F.col("__usual")).alias(value))


# The search services in the order in which a configured one is chosen.
SEARCH_SERVICES = ("tavily", "langsearch", "brave", "serper")


def search_service(keys: dict[str, Column]) -> Column:
    """The first search service that has a key (null: none)."""
    return F.coalesce(*[F.when(F.coalesce(keys[s], F.lit("")) != "", F.lit(s)) for s in SEARCH_SERVICES])
