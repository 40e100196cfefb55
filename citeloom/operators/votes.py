"""Votes of several judge rounds: majority, adaptive plurality and its tie-breaks, agreement between rounds.

Rounds are ordered; a round that could not be read never votes. Three rounds decide if one label is the most frequent;
else a fourth and a fifth are drawn; if none decides, the most conservative label that was given counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values, from the most conservative verdict on, and from the most severe shortfall on.
VERDICTS = ("contradicted", "not_supported", "partially_supported", "fully_supported")
SHORTFALLS = ("causal_upgrade", "scope_inflation", "strength_inflation", "unsupported_addition")
AXES = {"unsupported_addition": "unsupported_addition", "strength_inflation": "overstatement", "scope_inflation": "overstatement", "causal_upgrade": "overstatement"}


def clean_label(raw: Column, labels: tuple[str, ...]) -> Column:
    """The label that a spelling stands for, null for sentinels, blanks and unknown words."""
    plain = F.lower(F.regexp_replace(raw, "[^A-Za-z]+", ""))
    return F.coalesce(*[F.when(plain == x.replace("_", ""), x) for x in labels])


def _is(value: str, field: str | None = None):
    return lambda x: (x[field] if field else x) == value


def plurality(labels: Column) -> Column:
    """The one most frequent label of an array (nulls don't count), null if there is none or a tie."""
    counts = F.array(*[F.struct(F.size(F.filter(labels, _is(v))).alias("n"), F.lit(v).alias("v")) for v in VERDICTS])
    most = F.array_max(F.transform(counts, lambda c: c["n"]))
    best = F.filter(counts, lambda c: (c["n"] == most) & (most > 0))
    return F.when(F.size(best) == 1, F.element_at(best, 1)["v"])


def ordered_rounds(labels: DataFrame) -> DataFrame:
    """(item, rounds) with the rounds of each item as an array of (verdict, shortfall) in their order."""
    packed = labels.groupBy("item").agg(F.array_sort(F.collect_list(F.struct("rank", "verdict", "shortfall"))).alias("r"))
    return packed.select("item", F.transform("r", lambda x: F.struct(x["verdict"].alias("verdict"), x["shortfall"].alias("shortfall"))).alias("rounds"))


def adaptive_vote(items: DataFrame) -> DataFrame:
    """(item, verdict, rounds_used, unanimous, no_majority, bloc_size, shortfall) of items with an array ``rounds``.

    ``unanimous`` is about the first three rounds and null unless all three could be read. The shortfall is the most
    frequent one of the winning bloc, ties go to the more severe; full support has none.
    """
    seen = F.transform("rounds", lambda r: r["verdict"])
    out = items.select("item", "rounds", seen.alias("v"))
    at = {n: plurality(F.slice("v", 1, n)) for n in (3, 4, 5)}
    given = F.filter(F.slice("v", 1, 5), lambda x: x.isNotNull())
    cautious = F.coalesce(*[F.when(F.array_contains(given, v), v) for v in VERDICTS])
    decided = F.coalesce(at[3], at[4], at[5])
    n = F.size("v")
    used = F.when(at[3].isNotNull(), F.least(n, F.lit(3))).when(at[4].isNotNull(), F.least(n, F.lit(4))).otherwise(F.least(n, F.lit(5)))
    first = F.slice("v", 1, 3)
    complete = (F.size(first) == 3) & ~F.exists(first, lambda x: x.isNull())
    out = out.withColumn("verdict", F.coalesce(decided, cautious)).withColumn("rounds_used", used.cast("bigint"))
    out = out.withColumn("unanimous", F.when(complete, F.size(F.array_distinct(first)) == 1)).withColumn("no_majority", decided.isNull() & (F.size(given) > 0))
    bloc = F.filter(F.slice("rounds", F.lit(1), F.col("rounds_used").cast("int")), lambda r: r["verdict"] == F.col("verdict"))
    out = out.withColumn("bloc", bloc).withColumn("bloc_size", F.size("bloc").cast("bigint"))
    types = F.array(*[F.struct(F.size(F.filter("bloc", _is(t, "shortfall"))).alias("n"), F.lit(-i).alias("rank"), F.lit(t).alias("t")) for i, t in enumerate(SHORTFALLS)])
    top = F.array_max(types)
    shortfall = F.when((F.col("verdict") != "fully_supported") & (top["n"] > 0), top["t"])
    return out.withColumn("shortfall", shortfall).select("item", "verdict", "rounds_used", "unanimous", "no_majority", "bloc_size", "shortfall")


def strict_majority(votes: Column) -> Column:
    """Whether more than half of the surviving booleans are true; null if none survived."""
    alive = F.filter(votes, lambda x: x.isNotNull())
    return F.when(F.size(alive) > 0, F.size(F.filter(alive, lambda x: x)) * 2 > F.size(alive))


def support_rates(verdicts: DataFrame, column: str = "verdict", by: list[str] | None = None) -> DataFrame:
    """Counts by verdict with the strict, lenient and contradiction rates over the four verdicts; sentinels are left out."""
    judged = verdicts.filter(F.col(column).isin(*VERDICTS))
    agg = judged.groupBy(*(by or [])).agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col(column) == v).alias(f"n_{v}") for v in VERDICTS])
    d = lambda c: F.try_divide(c.cast("double"), F.col("n").cast("double"))
    return agg.withColumns({"strict_rate": d(F.col("n_fully_supported")), "lenient_rate": d(F.col("n_fully_supported") + F.col("n_partially_supported")), "contradiction_rate": d(F.col("n_contradicted"))})


def axis_of(shortfall: Column) -> Column:
    """The axis a shortfall type belongs to."""
    return F.coalesce(*[F.when(shortfall == k, v) for k, v in AXES.items()])
