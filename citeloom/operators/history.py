"""Ordered logs: turns, token windows over the newest turns, usage totals, caches and resumption."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def turns(log: DataFrame, key: str, order: list[str], starts: Column) -> DataFrame:
    """``log`` with the number of the turn each row belongs to; rows before the first start are turn 0."""
    return log.withColumn("turn", F.sum(starts.cast("int")).over(Window.partitionBy(key).orderBy(*order)).cast("bigint"))


def recent_turns(log: DataFrame, key: str, size: Column, budget: int) -> DataFrame:
    """The newest whole turns that fit the budget; the current one always stays, and nothing older than a turn that did not fit."""
    per = log.groupBy(key, "turn").agg(F.sum(size).alias("turn_size"))
    newest_first = Window.partitionBy(key).orderBy(F.col("turn").desc())
    per = per.withColumn("upto", F.sum("turn_size").over(newest_first)).withColumn("age", F.row_number().over(newest_first))
    over = F.max(((F.col("upto") > budget) & (F.col("age") > 1)).cast("int")).over(newest_first)
    kept = per.withColumn("cut", over).filter((F.col("cut") == 0) | (F.col("age") == 1)).select(key, "turn", "turn_size")
    return log.join(kept, [key, "turn"])


def prune_earlier(log: DataFrame, key: str, stub: dict[str, str], kind: str, content: str) -> DataFrame:
    """Contents of earlier turns replaced by a stub where their kind has one; the current turn stays as it is."""
    current = F.max("turn").over(Window.partitionBy(key))
    replaced = F.coalesce(*[F.when(F.col(kind) == k, F.lit(v)) for k, v in stub.items()], F.col(content))
    return log.withColumn(content, F.when(F.col("turn") < current, replaced).otherwise(F.col(content)))


def usage(log: DataFrame, by: str, amounts: list[str], price: str | None = None) -> DataFrame:
    """Sums per ``by`` that stay null until something was reported; the cost is null if any row has no price."""
    sums = [F.sum(c).alias(f"sum_{c}") for c in amounts]
    if price:
        sums.append(F.when(F.count(F.lit(1)) == F.count(price), F.sum(price)).alias("cost"))
    return log.groupBy(by).agg(F.count(F.lit(1)).alias("n"), *sums)


def cache_lookup(requests: DataFrame, cache: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(hits with their values, distinct misses): each missing key is worked on once."""
    hit = requests.join(cache, key)
    missing = requests.join(cache.select(key), key, "left_anti").dropDuplicates([key])
    return hit, missing


def resume(todo: DataFrame, done: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(results that can be used again, what is left to do)."""
    return done.join(todo.select(key).distinct(), key, "left_semi"), todo.join(done.select(key), key, "left_anti")
