"""Territorial citation windows: which claims a group of markers reaches.

Consecutive markers of one sentence form a group. A group at sentence s reaches the claims after every earlier group's
sentence up to s; a window of k keeps the last k of them, k = 0 only the claim of its own sentence.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


#: Names of windows: the nearest claim, and a block of claims.
ALIASES = {"nearest": 1, "block": 5}


def pairing_size(window: int | str) -> int:
    """The number of claims that a window reaches, by number or name; 0 is no window to pair claims with."""
    size = ALIASES.get(window, window)
    if not isinstance(size, int) and str(size).isdigit():
        size = int(size)
    if not isinstance(size, int) or size < 1:
        raise ValueError(f"no window to pair with: {window!r}")
    return size


def marker_groups(placed: DataFrame, key: str = "answer_id") -> DataFrame:
    """(key, marker_idx, sent_idx, grp, reached): ``reached`` is the furthest sentence of the earlier groups, -1 if none."""
    order = Window.partitionBy(key).orderBy("marker_idx")
    placed = placed.filter("sent_idx is not null").withColumn("fresh", F.coalesce((F.col("sent_idx") != F.lag("sent_idx").over(order)).cast("int"), F.lit(1)))
    placed = placed.withColumn("grp", F.sum("fresh").over(order))
    earlier = Window.partitionBy(key).orderBy("grp").rangeBetween(Window.unboundedPreceding, -1)
    return placed.withColumn("reached", F.coalesce(F.max("sent_idx").over(earlier), F.lit(-1))).drop("fresh")


def window_pairs(claims: DataFrame, placed: DataFrame, windows: tuple[int, ...], key: str = "answer_id") -> DataFrame:
    """(key, k, claim_idx, marker_idx) for every k of ``windows``; ``claims`` has (key, idx) of the claims only."""
    groups = marker_groups(placed, key)
    heads = groups.select(key, "grp", "sent_idx", "reached").distinct()
    reach = heads.filter("reached < sent_idx").select(key, "grp", F.explode(F.sequence(F.col("reached") + 1, F.col("sent_idx"))).alias("idx"))
    ranked = reach.join(claims.select(key, "idx"), [key, "idx"]).withColumn("r", F.row_number().over(Window.partitionBy(key, "grp").orderBy(F.col("idx").desc())))
    territory = groups.join(ranked, [key, "grp"]).select(key, "r", F.col("idx").alias("claim_idx"), "marker_idx")
    sizes = F.array(*[F.lit(k) for k in windows if k > 0])
    out = territory.select("*", F.explode(sizes).alias("k")).filter("r <= k").select(key, F.col("k").cast("bigint").alias("k"), "claim_idx", "marker_idx")
    if 0 in windows:
        own = groups.join(claims.select(key, F.col("idx").alias("sent_idx")), [key, "sent_idx"])
        out = out.unionByName(own.select(key, F.lit(0).cast("bigint").alias("k"), F.col("sent_idx").alias("claim_idx"), "marker_idx"))
    return out


def coverage(answers: DataFrame, claims: DataFrame, pairs: DataFrame, windows: tuple[int, ...], key: str = "answer_id") -> DataFrame:
    """(key, k, n_claims, n_covered, coverage) of every answer and k; the coverage of an answer without claims is null."""
    sizes = F.array(*[F.lit(k).cast("bigint") for k in windows])
    spine = answers.select(key).distinct().select(key, F.explode(sizes).alias("k"))
    counted = claims.groupBy(key).agg(F.count(F.lit(1)).alias("n_claims"))
    covered = pairs.groupBy(key, "k").agg(F.countDistinct("claim_idx").alias("n_covered"))
    out = spine.join(counted, key, "left").join(covered, [key, "k"], "left")
    n, c = F.coalesce("n_claims", F.lit(0)), F.coalesce("n_covered", F.lit(0))
    return out.select(key, "k", n.alias("n_claims"), c.alias("n_covered"), F.try_divide(c.cast("double"), n.cast("double")).alias("coverage"))


def coverage_summary(per_answer: DataFrame) -> DataFrame:
    """(k, n_answers, n_without_claims, macro, micro): mean of the ratios and ratio of the sums, null over nothing."""
    return per_answer.groupBy("k").agg(
        F.count(F.lit(1)).alias("n_answers"),
        F.count_if(F.col("n_claims") == 0).alias("n_without_claims"),
        F.avg("coverage").alias("macro"),
        F.try_divide(F.sum("n_covered").cast("double"), F.sum("n_claims").cast("double")).alias("micro"),
    )
