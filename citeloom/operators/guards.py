"""Checks that a result must pass before it is used: preconditions of calls, and counts of what contradicts them in the data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rounds that may be lost, probed claims that may be unknown, settings that a caller may add.
MOST_DROPPED, MOST_STRAY = 0.01, 0.05
EXTRA_SETTINGS = frozenset(["thinking_effort", "max_tokens", "temperature", "seed"])


def require(condition: bool, message: str) -> None:
    """Refuses with ``ValueError``."""
    if not condition:
        raise ValueError(message)


def check_funnel_inputs(adjudication: str, gate: str) -> None:
    """A funnel is only defined over sets of quotes whose gate kept the compliant ones."""
    require(adjudication == "set", f"the funnel needs set adjudication, not {adjudication!r}")
    require(gate == "compliant", f"the funnel needs the compliant gate, not {gate!r}")


def check_rounds(rounds: int) -> None:
    """A majority of an even number of rounds can tie."""
    require(rounds > 0 and rounds % 2 == 1, "the number of rounds must be odd")


def check_settings(extra: dict) -> None:
    unknown = sorted(set(extra) - EXTRA_SETTINGS)
    require(not unknown, f"unknown settings: {', '.join(unknown)}")


def check_seeds(seeds: list) -> None:
    """Rounds are independent only if their seeds are there and differ."""
    require(None not in seeds and len(set(seeds)) == len(seeds), "voting rounds need seeds of their own")


def check_labels(given: tuple[str, ...], known: tuple[str, ...]) -> None:
    """The labels a judge may give are those that the metrics count."""
    require(set(given) == set(known), f"labels differ: {sorted(set(given) ^ set(known))}")


def check_lookup_report(kind: str, judge: str, bucket_judge: str, models: list[str], model: str) -> None:
    """A lookup report fits if it is of the read sets, of the same judge, and knows the model."""
    require(kind == "readset", f"the report is of {kind!r}, not of read sets")
    require(judge == bucket_judge, "the report's bucket was drawn by another judge")
    require(model in models, f"the report does not know {model!r}")


def dropped_share(rows: DataFrame, votes: Column, dropped: Column) -> DataFrame:
    """One row: rounds asked for, rounds lost, their share, and whether the report is to be rejected."""
    lost = F.coalesce(dropped, F.lit(0))
    out = rows.agg(F.sum(F.size(F.coalesce(votes, F.array().cast("array<boolean>"))) + lost).cast("bigint").alias("n_rounds"), F.sum(lost).cast("bigint").alias("n_dropped"))
    share = F.coalesce(F.try_divide(F.col("n_dropped").cast("double"), F.col("n_rounds").cast("double")), F.lit(0.0))
    return out.select("n_rounds", "n_dropped", share.alias("share"), (share > MOST_DROPPED).alias("rejected"))


def stray_share(probed: DataFrame, seen: DataFrame, keys: list[str]) -> DataFrame:
    """One row: probed keys, those that nothing else knows, and whether there are too many."""
    one = probed.select(*keys).distinct()
    stray = one.join(seen.select(*keys).distinct(), keys, "left_anti").agg(F.count(F.lit(1)).alias("n_stray"))
    out = one.agg(F.count(F.lit(1)).alias("n_probed")).crossJoin(stray)
    return out.withColumn("rejected", F.col("n_stray") > F.col("n_probed") * MOST_STRAY)


def must_have(rows: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """``rows`` of which each must have its ``key`` among ``known``; the first one without it ends the job with an error."""
    marked = rows.join(known.select(key).distinct().withColumn("known_", F.lit(True)), key, "left")
    missing = F.raise_error(F.concat(F.lit(f"{key} is not known: "), F.coalesce(F.col(key).cast("string"), F.lit("null")))).cast("boolean")
    return marked.filter(F.when(F.col("known_"), True).otherwise(missing)).drop("known_")


def asked(rows: DataFrame, questions: DataFrame, keys: list[str], question: str) -> DataFrame:
    """``rows`` with their question by several keys; a blank question ends the job with an error."""
    joined = rows.join(questions.select(*keys, question), keys)
    blank = F.raise_error(F.lit("a question is blank")).cast("string")
    return joined.withColumn(question, F.when(F.length(F.btrim(question)) > 0, F.col(question)).otherwise(blank))
