"""Whether a quote stands in the section it cites, by categories and without any similarity threshold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeloom.functions.text import BOUNDARY, ELLIPSIS, FULL, WRAPPING, Criteria, normalize

PASSING = ("exact", "normalized", "elided")


def elided(quote: Column, source: Column, criteria: Criteria) -> Column:
    """Ellipsis fragments of some length, at least two, in order. Both sides are normalised."""
    pieces = F.filter(F.transform(F.split(quote, ELLIPSIS, -1), F.btrim), lambda f: F.length(f) >= criteria.least_fragment)
    position = lambda f, at: F.call_function("locate", f, source, at + 1)
    step = lambda at, f: F.when(at < 0, at).otherwise(F.when(position(f, at) > 0, position(f, at) + F.length(f) - 1).otherwise(-1))
    return (F.size(pieces) >= criteria.least_fragments) & (F.aggregate(pieces, F.lit(0), step) >= 0)


def tier(quote: Column, raw: Column, source: Column, normalised: Column, criteria: Criteria = FULL) -> Column:
    """exact, normalized, elided or fail. ``normalised`` is the quote's and ``source`` the section's normal form."""
    unwrapped = F.btrim(quote, F.lit(WRAPPING + " "))
    nq = F.btrim(normalised, F.lit("'\""))
    bare = F.btrim(nq, F.lit(BOUNDARY + " "))
    edge_left = F.regexp_extract(nq, r"^([.,;:!?\"'()\[\] ]*)", 1)
    edge_right = F.regexp_extract(nq, r"([.,;:!?\"'()\[\] ]*)$", 1)
    bounded = (F.length(bare) > 0) & (bare != nq) & ~F.rlike(F.concat(edge_left, edge_right), F.lit(ELLIPSIS)) & F.contains(source, bare)
    return (
        F.when((F.length(quote) == 0) | quote.isNull() | (F.length(raw) == 0) | raw.isNull(), "fail")
        .when(F.contains(raw, quote), "exact")
        .when((F.length(unwrapped) > 0) & (unwrapped != quote) & F.contains(raw, unwrapped), "exact")
        .when((F.length(nq) > 0) & F.contains(source, nq), "normalized")
        .when(bounded, "normalized")
        .when((F.length(nq) > 0) & elided(nq, source, criteria), "elided")
        .otherwise("fail")
    )


def probes(quote: Column, normalised: Column, criteria: Criteria = FULL) -> tuple[Column, Column, Column]:
    """Parts of a quote one of which a text must hold for ``tier`` to pass: the first as it stands, or the second or the third in normal form; null where there is none."""
    nq = F.btrim(normalised, F.lit("'\""))
    pieces = F.filter(F.transform(F.split(nq, ELLIPSIS, -1), F.btrim), lambda f: F.length(f) >= criteria.least_fragment)
    filled = lambda c: F.when(F.length(c) > 0, c)
    longest = F.reduce(pieces, F.lit(""), lambda a, f: F.when(F.length(f) > F.length(a), f).otherwise(a))
    return (
        F.coalesce(filled(F.btrim(quote, F.lit(WRAPPING + " "))), filled(quote)),
        F.coalesce(filled(F.btrim(nq, F.lit(BOUNDARY + " "))), filled(nq)),
        F.when((F.length(nq) > 0) & (F.contains(nq, F.lit("...")) | F.lit(criteria.least_fragments < 2)) & (F.size(pieces) >= criteria.least_fragments), longest),
    )


def quote_tiers(quotes: DataFrame, sections: DataFrame, criteria: Criteria = FULL, salts: int = 4) -> DataFrame:
    """``quotes`` (… doc_id, quote) with the added column tier; ``sections`` has doc_id (unique) and text.

    Each section and each distinct quote is normalised once, before the join; the tiers come back to the rows by a 128-bit
    digest of the pair. The quotes of one section are dealt over ``salts`` tasks, to each of which its text goes once, so that
    a section that a third of all rows cites is no single task's. A quote whose section is not there is unresolved; a null or
    empty quote or section text fails.
    """
    digest = F.md5(F.concat_ws("\x01", F.coalesce("doc_id", F.lit("\x02")), F.coalesce("quote", F.lit("\x02"))))
    known = sections.select("doc_id", F.col("text").alias("raw"), normalize(F.col("text"), criteria).alias("source"), F.lit(True).alias("resolved")).select("*", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    pairs = quotes.select("doc_id", "quote", digest.alias("pair")).distinct().select("*", normalize(F.col("quote"), criteria).alias("normalised"), F.pmod(F.crc32("pair"), F.lit(salts)).cast("int").alias("salt"))
    made = pairs.join(known, ["doc_id", "salt"], "left").select("pair", F.when(F.col("resolved").isNull(), "unresolved").otherwise(tier(F.col("quote"), F.col("raw"), F.col("source"), F.col("normalised"), criteria)).alias("tier"))
    return quotes.withColumn("pair", digest).join(made, "pair", "left").select(*quotes.columns, "tier")


def passes(tier_column: Column) -> Column:
    return tier_column.isin(*PASSING)


def compliance(tiered: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Counts by tier and the verbatim and non-compliant rates; rates of nothing are null."""
    counts = [F.count_if(F.col("tier") == t).alias(f"n_{t}") for t in (*PASSING, "fail", "unresolved")]
    total, passed = F.count(F.lit(1)), F.count_if(passes(F.col("tier")))
    agg = tiered.groupBy(*(by or [])).agg(total.alias("n"), passed.alias("n_passed"), *counts)
    rate = F.try_divide(F.col("n_passed").cast("double"), F.col("n").cast("double"))
    return agg.withColumn("verbatim_rate", rate).withColumn("failing_rate", 1 - rate)
