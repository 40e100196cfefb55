"""Recovery of evidence: where a passage stands, which rung a finding is on, and controls."""

from __future__ import annotations

import re
from functools import reduce
from operator import and_

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from citeloom.functions.text import FULL, Criteria, normalize
from citeloom.operators.tree import KEY
from citeloom.operators.verbatim import PASSING, passes, probes, quote_tiers, tier
from citeloom.session import materialise

RUNGS = ("node", "sectionrest", "othersection", "unattributed", "nowhere", "error")
#: Numbers of 64 bits in a signature: a text of some pages sets about half of them.
SIGNATURE = 4
#: Words of a quote that are looked up there before its text is compared.
INNER_WORDS = 8


def rung(tier_column: Column, in_node: Column, in_cited: Column) -> Column:
    """error, nowhere, node, unattributed, sectionrest or othersection; an unread tier is nowhere."""
    return (
        F.when(tier_column == "error", "error")
        .when(~F.coalesce(tier_column.isin(*PASSING), F.lit(False)), "nowhere")
        .when(F.coalesce(in_node, F.lit(False)), "node")
        .when(in_cited.isNull(), "unattributed")
        .when(in_cited, "sectionrest")
        .otherwise("othersection")
    )


def rung_table(rows: DataFrame, by: str) -> DataFrame:
    """Counts of each rung per ``by``, zero where there is none, with the located share over all but errors."""
    counts = rows.groupBy(by).agg(*[F.count_if(F.col("rung") == r).alias(f"n_{r}") for r in RUNGS], F.count(F.lit(1)).alias("n"))
    located = sum((F.col(f"n_{r}") for r in RUNGS[:4]), F.lit(0))
    # The rungs must part the rows: one that is on none or on two is an error of the data.
    counts = counts.withColumn("n", F.when(sum((F.col(f"n_{r}") for r in RUNGS), F.lit(0)) == F.col("n"), F.col("n")).otherwise(F.raise_error(F.lit("the rungs do not part the rows")).cast("bigint")))
    return counts.withColumn("located_share", F.try_divide(located.cast("double"), (F.col("n") - F.col("n_error")).cast("double")))


def place_spans(rows: DataFrame, sections: DataFrame, criteria: Criteria = FULL) -> DataFrame:
    """(row_id, span_idx, doc_id, tier): the first section of the row's read set in which each span passes, nulls if none.

    ``rows`` has row_id, spans and read_set. Pairs are made within a row only.
    """
    spans = rows.select("row_id", F.posexplode("spans").alias("span_idx", "quote"), "read_set").filter(F.length(F.btrim("quote")) > 0)
    pairs = spans.select("row_id", "span_idx", "quote", F.posexplode_outer("read_set").alias("pos", "doc_id"))
    tiered = quote_tiers(pairs, sections, criteria)
    first = tiered.groupBy("row_id", "span_idx").agg(F.min(F.when(passes(F.col("tier")), F.struct("pos", "doc_id", "tier"))).alias("x"))
    return first.select("row_id", F.col("span_idx").cast("bigint").alias("span_idx"), "x.doc_id", "x.tier")


def overlap_kind(spans: Column, quote: Column) -> Column:
    """echo if every span is inside the quote, disjoint if none overlaps it either way, else quotectx."""
    usable = (F.size(spans) > 0) & (F.length(quote) > 0)
    inside = F.forall(spans, lambda s: F.contains(quote, s))
    touching = F.exists(spans, lambda s: F.contains(quote, s) | F.contains(s, quote))
    return F.when(usable & inside, "echo").when(usable & touching, "quotectx").otherwise("disjoint")


def span_tiers(rows: DataFrame, texts: DataFrame, criteria: Criteria = FULL) -> DataFrame:
    """(row_id, span_idx, tier) of each span of ``rows`` (row_id, spans) against the text of its row in ``texts`` (row_id, text)."""
    known = texts.select("row_id", F.col("text").alias("raw"), normalize(F.col("text"), criteria).alias("source"))
    each = rows.select("row_id", F.posexplode("spans").alias("span_idx", "quote")).join(known, "row_id", "left")
    return each.select("row_id", F.col("span_idx").cast("bigint").alias("span_idx"), tier(F.col("quote"), F.col("raw"), F.col("source"), normalize(F.col("quote"), criteria), criteria).alias("tier"))


def row_tiers(rows: DataFrame, tiers: DataFrame) -> DataFrame:
    """(row_id, tier): the first tier of a row's spans that fails, else the weakest; error without an answer, n/a if nothing was found, empty without spans.

    ``rows`` has row_id and found, ``tiers`` is that of ``span_tiers``.
    """
    failing = F.min_by(F.when(~passes(F.col("tier")), F.col("tier")), F.when(~passes(F.col("tier")), F.col("span_idx")))
    weakest = F.max(F.coalesce(*[F.when(F.col("tier") == t, i) for i, t in enumerate(PASSING)]))
    per = tiers.groupBy("row_id").agg(failing.alias("bad"), weakest.alias("weakest"))
    found = F.coalesce("bad", F.get(F.array(*map(F.lit, PASSING)), "weakest"), F.lit("empty"))
    return rows.join(per, "row_id", "left").select("row_id", F.when(F.col("found").isNull(), "error").when(~F.col("found"), "n/a").otherwise(found).alias("tier"))


def row_places(placed: DataFrame, in_node: DataFrame, cited: DataFrame) -> DataFrame:
    """(row_id, n_spans, evidence_in_node, evidence_is_cited_section, evidence_section) of the rows all of whose spans were placed, nulls for the others.

    ``placed`` has (row_id, span_idx, doc_id), ``in_node`` (row_id, span_idx, tier) against the node's text, ``cited`` (row_id,
    cited_doc_id array). The section is the first one that is not cited, if there is one, else that of the first span.
    """
    each = placed.join(in_node.select("row_id", "span_idx", passes(F.col("tier")).alias("here")), ["row_id", "span_idx"], "left").join(cited, "row_id")
    outside = ~F.array_contains(F.coalesce("cited_doc_id", F.array().cast("array<string>")), F.col("doc_id"))
    per = each.groupBy("row_id").agg(
        F.count(F.lit(1)).alias("n_spans"),
        F.max(F.col("doc_id").isNull()).alias("lost"),
        F.min(F.coalesce("here", F.lit(False))).alias("in_node"),
        F.min(~outside).alias("in_cited"),
        F.min_by(F.when(outside, F.col("doc_id")), F.when(outside, F.col("span_idx"))).alias("elsewhere"),
        F.min_by("doc_id", "span_idx").alias("first"),
    )
    whole = lambda c: F.when(~F.col("lost"), c)
    return per.select("row_id", "n_spans", whole(F.col("in_node")).alias("evidence_in_node"), whole(F.col("in_cited")).alias("evidence_is_cited_section"), whole(F.coalesce("elsewhere", "first")).alias("evidence_section"))


def is_own_quote(spans: Column, quote: Column) -> Column:
    """Whether a span holds the quote or stands in it; both are normalised, an empty one counts for nothing."""
    return F.exists(spans, lambda s: (F.length(s) > 0) & (F.length(quote) > 0) & (F.contains(quote, s) | F.contains(s, quote)))


def probe_report(rows: DataFrame, by: str) -> DataFrame:
    """Counts and rates of lookups, in all and by ``by``: rates over those judged (without errors), the split rate over complete rounds.

    ``rows`` has found, tier, votes, dropped and ``by``; unanimity is null if a round was dropped or there was one only.
    """
    alive = F.filter("votes", lambda v: v.isNotNull())
    unanimous = F.when((F.coalesce("dropped", F.lit(0)) == 0) & (F.size(alive) > 1), F.size(F.array_distinct(alive)) == 1)
    judged = F.col("tier") != "error"
    out = rows.withColumns({"u": unanimous, "j": judged, "v": passes(F.col("tier"))}).groupingSets([[], [by]], by).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if("j").alias("n_judged"),
        F.count_if(~F.col("j")).alias("n_errors"),
        F.count_if(F.col("j") & F.coalesce("found", F.lit(False))).alias("n_found"),
        F.count_if("v").alias("n_verified"),
        F.count_if(~F.col("u")).alias("n_vote_split"),
        F.count("u").alias("n_complete"),
        F.sum(F.coalesce("dropped", F.lit(0)).cast("bigint")).alias("n_rounds_dropped"),
    )
    rate = lambda a, b: F.try_divide(F.col(a).cast("double"), F.col(b).cast("double"))
    return out.select(F.coalesce(F.col(by), F.lit("*")).alias(by), *[c for c in out.columns if c != by], rate("n_verified", "n_judged").alias("verified_rate"), rate("n_vote_split", "n_complete").alias("vote_split_rate"))


def _place(word: Column) -> Column:
    return F.pmod(F.xxhash64(word), F.lit(64 * SIGNATURE)).cast("int")


def _with_words(rows: DataFrame, name: str, *texts: str) -> DataFrame:
    """``rows`` with the words of the texts as the bits of a few numbers, in the array ``name``."""
    places = F.array_distinct(F.transform(F.array_distinct(F.concat(*[F.split(t, " ", -1) for t in texts])), _place))
    own = lambda i: F.filter(name, lambda p: F.shiftright(p, 6) == i)
    number = lambda i: F.reduce(own(i), F.lit(0).cast("bigint"), lambda x, p: x.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), p % 64)))
    # A step of its own, so that the places are made once for all numbers.
    return rows.withColumn(name, places).withColumn(name, F.array(*[number(i) for i in range(SIGNATURE)]))


def _with_inner_words(rows: DataFrame, name: str) -> DataFrame:
    """``rows`` with the bits of the first whole words of the text part ``name``, name_1 and so on: its own first and last word may be cut."""
    words = f"{name}_words"
    return rows.withColumn(words, F.split(name, " ", INNER_WORDS + 2)).withColumns({f"{name}_{j}": F.when(F.size(words) > j + 1, _place(F.get(words, F.lit(j)))) for j in range(1, INNER_WORDS + 1)}).drop(words)


def _may_hold(words: str, name: str) -> Column:
    """Whether a text with these words may hold the part ``name``."""
    places = [F.col(f"{name}_{j}") for j in range(1, INNER_WORDS + 1)]
    return reduce(and_, [p.isNull() | (F.getbit(F.get(words, F.shiftright(p, 6)), p % 64) == 1) for p in places])


def smallest_holder(quotes: DataFrame, nodes: DataFrame, texts: DataFrame, criteria: Criteria = FULL) -> DataFrame:
    """(quote_id, section_id, tier): the shortest node text in or below the cited one that holds the quote.

    ``quotes`` has quote_id, guideline_id, section_id and quote, ``nodes`` guideline_id, section_id and path, ``texts``
    guideline_id, section_id and text. Quotes meet the nodes below what they cite in one join, to which each text goes once
    for each cited node above it and there gets its normal form. A pair is compared if the text has the bits of the quote's
    words, and leaves the join if the text holds a probe of the quote; only then is its tier made.
    """
    quotes = materialise(quotes.filter(F.length("quote") > 0).select("quote_id", *KEY, "quote"), "held-quotes")
    above = nodes.select("guideline_id", F.col("section_id").alias("node"), F.explode(F.array_distinct("path")).alias("section_id")).join(quotes.select(*KEY).distinct(), list(KEY), "left_semi")
    held = above.join(texts.filter(F.length("text") > 0).select("guideline_id", F.col("section_id").alias("node"), F.col("text").alias("raw")), ["guideline_id", "node"])
    # Normal forms and bits are made behind the exchange, so that they are not sent.
    held = _with_words(held.repartition(*KEY).withColumn("source", normalize(F.col("raw"), criteria)), "has", "raw", "source")
    asked = quotes.repartition(*KEY).withColumn("normalised", normalize(F.col("quote"), criteria))
    asked = asked.withColumns(dict(zip(("as_is", "normal", "fragment"), probes(F.col("quote"), F.col("normalised"), criteria))))
    for form in ("as_is", "normal"):
        asked = _with_inner_words(asked, form)
    meets = (_may_hold("has", "as_is") & F.contains("raw", "as_is")) | (_may_hold("has", "normal") & F.contains("source", "normal")) | F.contains("source", "fragment")
    pairs = asked.alias("q").join(held.alias("n"), reduce(and_, [F.col(f"q.{c}") == F.col(f"n.{c}") for c in KEY]) & meets)
    tiered = pairs.select("quote_id", "node", F.length("raw").alias("n"), tier(F.col("quote"), F.col("raw"), F.col("source"), F.col("normalised"), criteria).alias("tier"))
    # Not a filter: that would be moved into the join, and the tiers of all its pairs be made.
    least = tiered.groupBy("quote_id").agg(F.min(F.when(passes(F.col("tier")), F.struct("n", F.col("node").alias("section_id"), "tier"))).alias("x"))
    return least.filter("x is not null").select("quote_id", "x.section_id", "x.tier")


def dense_places(rows: DataFrame, order: str) -> DataFrame:
    """``rows`` with their place from 0 in an order, without one task that sorts them all: places inside ranges and the sizes of those before."""
    rows = materialise(rows.repartitionByRange(order).withColumn("range_", F.spark_partition_id()), "placed-rows")
    sizes = rows.groupBy("range_").agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("first"))
    # One row for each partition of the range exchange.
    offsets = sizes.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("first").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("range_", "before")
    inside = F.row_number().over(Window.partitionBy("range_").orderBy(order)) - 1
    return rows.withColumn("inside_", inside).join(F.broadcast(offsets), "range_").withColumn("place", F.col("inside_") + F.col("before")).drop("range_", "inside_", "before")


def partial_ratio(short: str, long: str) -> float:
    """Best similarity (0 to 100) of the shorter text to a stretch of the longer one, by matching blocks."""
    from difflib import SequenceMatcher

    if len(short) > len(long):
        short, long = long, short
    if not short:
        return 0.0
    if short in long:
        return 100.0
    best = 0.0
    for block in SequenceMatcher(None, short, long, autojunk=False).get_matching_blocks():
        start = max(0, block.b - block.a)
        best = max(best, SequenceMatcher(None, short, long[start : start + len(short)], autojunk=False).ratio())
    return 100.0 * best


@F.pandas_udf(T.DoubleType())
def partial_ratio_of(short: pd.Series, long: pd.Series) -> pd.Series:
    return pd.Series([None if a is None or b is None else partial_ratio(a, b) for a, b in zip(short, long)], dtype="float64")


def unrelated_partners(rows: DataFrame, block: int = 64) -> DataFrame:
    """(row_id, partner_id): for each row the next one in cyclic order whose read set shares nothing with its own.

    Candidates are looked at by blocks of distances, each for the rows still without a partner, up to every other row;
    rows that every other row overlaps have no partner. Meant for the bounded set of rejected rows: ``rows`` has row_id,
    read_set and a dense place from 0.
    """
    rows = materialise(rows, "partner-rows")
    n = rows.count()
    b = rows.select(F.col("row_id").alias("partner_id"), F.col("read_set").alias("partner_set"), F.col("place").alias("other"))
    left, out, start = rows, None, 1
    while True:
        end = min(n - 1, start + block - 1)
        steps = left.select("row_id", "read_set", "place", F.explode(F.sequence(F.lit(start), F.lit(max(start, end)))).alias("j")).withColumn("other", F.pmod(F.col("place") + F.col("j"), F.lit(max(1, n))))
        fits = steps.join(b, "other").filter((F.col("row_id") != F.col("partner_id")) & ~F.coalesce(F.arrays_overlap("read_set", "partner_set"), F.lit(False)))
        found = materialise(fits.groupBy("row_id").agg(F.min_by("partner_id", "j").alias("partner_id")), "partners")
        out = found if out is None else out.unionByName(found)
        if end >= n - 1:
            return out
        left = materialise(left.join(found, "row_id", "left_anti"), "partner-rows")
        if left.isEmpty():
            return out
        start, block = end + 1, 2 * block
