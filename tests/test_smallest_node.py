"""The smallest node that holds a quote: against the tier of every pair, and without a plan that outgrows the driver."""

import re

import pytest
from pyspark.sql import functions as F

from citeloom.functions.text import FULL, PLAIN, Criteria, normalize
from citeloom.operators import recovery, verbatim
from citeloom.plans import registry

NODES = [
    ("c1", ["root", "c1"], "Overview of treatment s1.1-2"),
    ("c1-s1", ["root", "c1", "c1-s1"], ", 3.4-5 Adults With raised pressure take one dose daily and return after twelve weeks"),
    ("c1-s2", ["root", "c1", "c1-s2"], "Adults With raised pressure take one dose daily"),
    ("c1-s3", ["root", "c1", "c1-s3"], "ΟΔΟΣ Größe*, “measured” at 8 a.m.; 血压应当每天测量并记录结果，然后复查。 Children take half of it - see below"),
    ("c1-s4", ["root", "c1", "c1-s4"], None),
    ("c1-s5", ["root", "c1", "c1-s5"], ""),
    ("c2", ["root", "c2"], "Adults With raised pressure"),
    ("gone", ["root", "gone"], "in no tree"),
]
QUOTES = [
    # Alone, its node has the numbers; behind the text before, they would be read as further references and left out.
    ("c1", "3.4-5 ADULTS with raised"),
    ("c1", "dults With raised pressure take one dose d"),
    ("c1", "take one dose"),
    ("root", "Adults With raised pressure"),
    ("c2", "take one dose"),
    ("c1", "adults with raised pressure ... after twelve weeks"),
    ("c1", "after twelve weeks [...] adults with raised pressure"),
    ("c1", "\"Children take half of it.\""),
    ("c1", "\"'"),
    ("c1", "“measured”"),
    ("c1", "每天测量并记录"),
    ("c1", "ΔΟΣ Größe, measured at 8"),
    ("c1-s3", "δος GRÖSSE"),
    ("c1", "a"),
    ("c1", " "),
    ("c1", ""),
    ("c1", None),
    (None, "take one dose"),
    ("nowhere", "take one dose"),
    ("c1-s4", "anything at all"),
]


@pytest.mark.parametrize("criteria", [PLAIN, FULL, Criteria(least_fragment=1, least_fragments=1), Criteria(least_fragment=50, least_fragments=0)])
def test_equals_the_tier_of_every_pair(spark, criteria):
    trees = spark.createDataFrame([(g, *n) for g in ("g", "h") for n in NODES], "guideline_id string, section_id string, path array<string>, text string")
    quotes = spark.createDataFrame([(100 * k + i, g, *q) for k, g in enumerate(("g", "h")) for i, q in enumerate(QUOTES)], "quote_id bigint, guideline_id string, section_id string, quote string")
    nodes, texts = trees.filter("section_id <> 'gone'").drop("text"), trees.drop("path")
    got = sorted(map(tuple, recovery.smallest_holder(quotes, nodes, texts, criteria).select("quote_id", "section_id", "tier").collect()))
    pairs = quotes.join(trees.filter("section_id <> 'gone'").withColumnsRenamed({"guideline_id": "g", "section_id": "node"}), F.expr("g = guideline_id and array_contains(path, section_id)"))
    pairs = pairs.withColumns({"source": normalize(F.col("text"), criteria), "normalised": normalize(F.col("quote"), criteria)})
    tiers = pairs.select("quote_id", "node", F.length("text").alias("n"), verbatim.tier(F.col("quote"), F.col("text"), F.col("source"), F.col("normalised"), criteria).alias("tier"))
    want = {}
    for r in sorted(tiers.filter(verbatim.passes(F.col("tier"))).collect(), key=lambda r: (r.n, r.node)):
        want.setdefault(r.quote_id, (r.quote_id, r.node, r.tier))
    assert got == sorted(want.values())
    if criteria.least_fragments > 0:
        assert (0, "c1-s1", "normalized") in got and (2, "c1-s2", "exact") in got


def test_plan_fits_the_driver(spark, sf_dir):
    plan = registry.QUERIES["smallest_node"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"\bExchange\b", plan)) <= 15
