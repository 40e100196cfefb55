"""Claim funnels: how many sentences are claims, cited, compliant and certified, and what a lookup recovers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STAGES = ("n_sentences", "n_claims", "n_cited", "n_compliant", "n_certified", "n_lenient")


def is_counted_claim() -> Column:
    """The shared denominator: over the length floor, a claim, and not malformed. Unknown flags don't count."""
    return F.coalesce(F.col("is_claim"), F.lit(False)) & F.coalesce(F.col("over_floor"), F.lit(False)) & ~F.coalesce(F.col("malformed"), F.lit(False))


def claim_states(claims: DataFrame) -> DataFrame:
    """``claims`` with the flags claim, cited, compliant, certified, lenient and in_scope."""
    verdict = lambda p: p["verdict"]
    some = F.size(F.coalesce("pairs", F.array())) > 0
    gated = F.coalesce(F.col("gated_out"), F.lit(False))
    full = F.forall("pairs", lambda p: F.coalesce(verdict(p) == "fully_supported", F.lit(False)))
    soft = F.forall("pairs", lambda p: F.coalesce(verdict(p).isin("fully_supported", "partially_supported"), F.lit(False)))
    bad = F.exists("pairs", lambda p: F.coalesce(verdict(p).isin("not_supported", "contradicted"), F.lit(False)))
    added = F.exists("pairs", lambda p: F.coalesce((verdict(p) == "partially_supported") & (p["shortfall"] == "unsupported_addition"), F.lit(False)))
    claim = is_counted_claim()
    cited = claim & (some | gated)
    compliant = claim & some & ~gated
    return claims.withColumns({"claim": claim, "cited": cited, "compliant": compliant, "certified": compliant & full, "lenient": compliant & soft, "in_scope": compliant & ~bad & added})


def funnel(states: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Counts of each stage with the rate over the stage before; rates over nothing are null."""
    c = lambda x: F.count_if(F.col(x))
    out = states.groupBy(*(by or [])).agg(F.count(F.lit(1)).alias("n_sentences"), c("claim").alias("n_claims"), c("cited").alias("n_cited"), c("compliant").alias("n_compliant"), c("certified").alias("n_certified"), c("lenient").alias("n_lenient"))
    rate = lambda a, b: F.try_divide(F.col(a).cast("double"), F.col(b).cast("double"))
    return out.withColumns({"cited_rate": rate("n_cited", "n_claims"), "compliant_rate": rate("n_compliant", "n_cited"), "certified_rate": rate("n_certified", "n_compliant"), "headline": rate("n_certified", "n_claims")})


def recovery_branch(states: DataFrame, lookups: DataFrame) -> DataFrame:
    """One row: in-scope claims, those probed, found and verified by a lookup of the same question and claim text, and those never probed."""
    seen = lookups.groupBy("question_id", F.col("claim").alias("text")).agg(F.max(F.coalesce("found", F.lit(False))).alias("found"), F.max(F.coalesce(F.col("found") & F.col("span_tier").isin("exact", "normalized", "elided"), F.lit(False))).alias("verified"), F.lit(True).alias("probed"))
    scoped = states.filter("in_scope").join(seen, ["question_id", "text"], "left")
    c = lambda x: F.count_if(F.coalesce(F.col(x), F.lit(False)))
    out = scoped.agg(F.count(F.lit(1)).alias("n_in_scope"), c("probed").alias("n_probed"), c("found").alias("n_found"), c("verified").alias("n_verified"))
    return out.withColumn("n_unprobed", F.col("n_in_scope") - F.col("n_probed"))
