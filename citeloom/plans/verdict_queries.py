"""Queries about verdicts: adaptive votes, agreement between rounds, support rates, claim funnels, and their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from citeloom.operators import funnels, votes
from citeloom.session import sf_table


def rounds_once(spark, sf_dir):
    """(item, annotator, round, verdict, shortfall, is_numeric_claim, rank), the one loaded last of each round."""
    v = sf_table(spark, sf_dir, "verdicts").groupBy("atom_id", "judge_id", "round_no").agg(F.max(F.struct("loaded_at", "support_verdict", "shortfall_type", "is_numeric_claim")).alias("x"))
    order = Window.partitionBy("atom_id").orderBy("judge_id", "round_no")
    return v.select(F.col("atom_id").alias("item"), "judge_id", votes.clean_label(F.col("x.support_verdict"), votes.VERDICTS).alias("verdict"), votes.clean_label(F.col("x.shortfall_type"), votes.SHORTFALLS).alias("shortfall"), F.col("x.is_numeric_claim").alias("is_numeric_claim"), F.row_number().over(order).cast("bigint").alias("rank"))


def vote_adaptive(spark, sf_dir):
    return votes.adaptive_vote(votes.ordered_rounds(rounds_once(spark, sf_dir)))


def vote_statistics(spark, sf_dir):
    v = vote_adaptive(spark, sf_dir)
    return v.agg(F.count(F.lit(1)).alias("n_items"), F.count_if("unanimous").alias("n_unanimous"), F.count_if(~F.col("unanimous")).alias("n_split"), F.count_if(F.col("unanimous").isNull()).alias("n_undecidable"), F.count_if("no_majority").alias("n_no_majority"), F.count_if(F.col("rounds_used") > 3).alias("n_extra_rounds"))


def verdict_spellings(spark, sf_dir):
    r = sf_table(spark, sf_dir, "verdicts").select(votes.clean_label(F.col("support_verdict"), votes.VERDICTS).alias("verdict"))
    return r.groupBy("verdict").agg(F.count(F.lit(1)).alias("n"))


def support_rates(spark, sf_dir):
    return votes.support_rates(rounds_once(spark, sf_dir))


def support_rates_numeric(spark, sf_dir):
    return votes.support_rates(rounds_once(spark, sf_dir).filter("is_numeric_claim"))


def support_rates_by_judge(spark, sf_dir):
    return votes.support_rates(rounds_once(spark, sf_dir), by=["judge_id"])


def per_round_band(spark, sf_dir):
    per = votes.support_rates(rounds_once(spark, sf_dir).filter("rank <= 3"), by=["rank"])
    return per.agg(F.min("strict_rate").alias("strict_low"), F.max("strict_rate").alias("strict_high"), F.min("lenient_rate").alias("lenient_low"), F.max("lenient_rate").alias("lenient_high"))


def shortfall_rollup(spark, sf_dir):
    """Types and axes in one pass of grouping sets; contradicted atoms are left out."""
    v = vote_adaptive(spark, sf_dir).filter("verdict in ('partially_supported', 'not_supported')")
    typed = v.select(F.coalesce("shortfall", F.lit("unnamed")).alias("shortfall"), F.coalesce(votes.axis_of(F.col("shortfall")), F.lit("unnamed")).alias("axis"))
    return typed.groupingSets([["axis"], ["axis", "shortfall"]], "axis", "shortfall").agg(F.count(F.lit(1)).alias("n")).select("axis", F.coalesce("shortfall", F.lit("(all)")).alias("shortfall"), "n")


def claims_once(spark, sf_dir):
    pair = lambda p: F.struct(votes.clean_label(p["support_verdict"], votes.VERDICTS).alias("verdict"), votes.clean_label(p["shortfall_type"], votes.SHORTFALLS).alias("shortfall"))
    rows = sf_table(spark, sf_dir, "claim_rows").groupBy("claim_id").agg(*[F.max(c).alias(c) for c in ("answer_id", "question_id", "text", "is_claim", "over_floor", "malformed", "gated_out", "pairs")])
    return rows.withColumn("pairs", F.transform("pairs", pair))


def claim_funnel(spark, sf_dir):
    return funnels.funnel(funnels.claim_states(claims_once(spark, sf_dir)))


def claim_funnel_by_question(spark, sf_dir):
    return funnels.funnel(funnels.claim_states(claims_once(spark, sf_dir)), ["question_id"])


def funnel_recovery(spark, sf_dir):
    return funnels.recovery_branch(funnels.claim_states(claims_once(spark, sf_dir)), sf_table(spark, sf_dir, "readset_lookups"))


_CLEAN = lambda c, names: f"CASE regexp_replace(lower({c}), '[^a-z]+', '', 'g') " + " ".join(f"WHEN '{n.replace('_', '')}' THEN '{n}'" for n in names) + " END"
_V, _T = _CLEAN("support_verdict", votes.VERDICTS), _CLEAN("shortfall_type", votes.SHORTFALLS)
_R = f"""d AS (SELECT atom_id, judge_id, round_no, (arg_max({{v: support_verdict, t: shortfall_type, c: is_numeric_claim}}, loaded_at)) AS x FROM verdicts GROUP BY 1, 2, 3),
r AS (SELECT atom_id AS item, judge_id, {_CLEAN("x.v", votes.VERDICTS)} AS verdict, {_CLEAN("x.t", votes.SHORTFALLS)} AS shortfall, x.c AS is_numeric_claim, row_number() OVER (PARTITION BY atom_id ORDER BY judge_id, round_no) AS rank FROM d)"""
_RANK_V = "CASE verdict WHEN 'contradicted' THEN 1 WHEN 'not_supported' THEN 2 WHEN 'partially_supported' THEN 3 WHEN 'fully_supported' THEN 4 END"
_RANK_T = "CASE shortfall WHEN 'causal_upgrade' THEN 1 WHEN 'scope_inflation' THEN 2 WHEN 'strength_inflation' THEN 3 WHEN 'unsupported_addition' THEN 4 END"
_PLUR = lambda n: f"p{n} AS (SELECT item, CASE WHEN count(*) FILTER (c = m) = 1 THEN any_value(verdict) FILTER (c = m) END AS v FROM (SELECT *, max(c) OVER (PARTITION BY item) AS m FROM (SELECT item, verdict, count(*) AS c FROM r WHERE rank <= {n} AND verdict IS NOT NULL GROUP BY 1, 2)) GROUP BY 1)"
_VOTE = f"""{_R}, {_PLUR(3)}, {_PLUR(4)}, {_PLUR(5)},
z AS (SELECT item, count(*) AS n, count(*) FILTER (rank <= 3) AS n3, count(verdict) FILTER (rank <= 3) AS g3, count(DISTINCT verdict) FILTER (rank <= 3) AS d3, count(verdict) FILTER (rank <= 5) AS g5, arg_min(verdict, {_RANK_V}) FILTER (rank <= 5 AND verdict IS NOT NULL) AS cautious FROM r GROUP BY 1),
w AS (SELECT z.item, coalesce(p3.v, p4.v, p5.v, z.cautious) AS verdict, CASE WHEN p3.v IS NOT NULL THEN least(n, 3) WHEN p4.v IS NOT NULL THEN least(n, 4) ELSE least(n, 5) END::BIGINT AS rounds_used,
      CASE WHEN n3 = 3 AND g3 = 3 THEN d3 = 1 END AS unanimous, coalesce(p3.v, p4.v, p5.v) IS NULL AND g5 > 0 AS no_majority FROM z LEFT JOIN p3 USING (item) LEFT JOIN p4 USING (item) LEFT JOIN p5 USING (item)),
b AS (SELECT w.item, count(*) AS bloc_size FROM w JOIN r ON r.item = w.item AND r.rank <= w.rounds_used AND r.verdict = w.verdict GROUP BY 1),
t0 AS (SELECT w.item, r.shortfall, count(*) AS c, any_value({_RANK_T.replace("shortfall WHEN", "r.shortfall WHEN")}) AS k FROM w JOIN r ON r.item = w.item AND r.rank <= w.rounds_used AND r.verdict = w.verdict WHERE r.shortfall IS NOT NULL GROUP BY 1, 2),
t1 AS (SELECT item, shortfall FROM (SELECT *, row_number() OVER (PARTITION BY item ORDER BY c DESC, k) AS q FROM t0) WHERE q = 1),
vote AS (SELECT w.item, w.verdict, w.rounds_used, w.unanimous, w.no_majority, coalesce(b.bloc_size, 0)::BIGINT AS bloc_size, CASE WHEN w.verdict <> 'fully_supported' THEN t1.shortfall END AS shortfall FROM w LEFT JOIN b USING (item) LEFT JOIN t1 USING (item))"""
_COUNTS = "count(*)::BIGINT AS n, " + ", ".join(f"count(*) FILTER (verdict = '{v}')::BIGINT AS n_{v}" for v in votes.VERDICTS) + ", count(*) FILTER (verdict = 'fully_supported')::DOUBLE / count(*) AS strict_rate, count(*) FILTER (verdict IN ('fully_supported', 'partially_supported'))::DOUBLE / count(*) AS lenient_rate, count(*) FILTER (verdict = 'contradicted')::DOUBLE / count(*) AS contradiction_rate"
_CLAIMS = f"""c0 AS (SELECT claim_id, max(question_id) AS question_id, max(text) AS text, max(is_claim) AS is_claim, max(over_floor) AS over_floor, max(malformed) AS malformed, max(gated_out) AS gated_out, max(pairs) AS pairs FROM claim_rows GROUP BY 1),
c1 AS (SELECT *, list_transform(pairs, lambda p: {_CLEAN("p.support_verdict", votes.VERDICTS)}) AS vs, list_transform(pairs, lambda p: {_CLEAN("p.support_verdict", votes.VERDICTS)} || '/' || {_CLEAN("p.shortfall_type", votes.SHORTFALLS)}) AS vt, coalesce(is_claim, false) AND coalesce(over_floor, false) AND NOT coalesce(malformed, false) AS claim, coalesce(len(pairs), 0) > 0 AS paired, coalesce(gated_out, false) AS gated FROM c0),
c2 AS (SELECT *, claim AND (paired OR gated) AS cited, claim AND paired AND NOT gated AS compliant, len(list_filter(vs, lambda v: v = 'fully_supported')) = len(vs) AS allfull, len(list_filter(vs, lambda v: v IN ('fully_supported', 'partially_supported'))) = len(vs) AS allsoft, len(list_filter(vs, lambda v: v IN ('not_supported', 'contradicted'))) > 0 AS bad, len(list_filter(vt, lambda v: v = 'partially_supported/unsupported_addition')) > 0 AS added FROM c1)"""
_FUNNEL = "count(*)::BIGINT AS n_sentences, count(*) FILTER (claim)::BIGINT AS n_claims, count(*) FILTER (cited)::BIGINT AS n_cited, count(*) FILTER (compliant)::BIGINT AS n_compliant, count(*) FILTER (compliant AND allfull)::BIGINT AS n_certified, count(*) FILTER (compliant AND allsoft)::BIGINT AS n_lenient"
_FRATES = "*, n_cited::DOUBLE / nullif(n_claims, 0) AS cited_rate, n_compliant::DOUBLE / nullif(n_cited, 0) AS compliant_rate, n_certified::DOUBLE / nullif(n_compliant, 0) AS certified_rate, n_certified::DOUBLE / nullif(n_claims, 0) AS headline"

QUERIES = {f.__name__: f for f in (vote_adaptive, vote_statistics, verdict_spellings, support_rates, support_rates_numeric, support_rates_by_judge, per_round_band, shortfall_rollup, claim_funnel, claim_funnel_by_question, funnel_recovery)}

ORACLE_SQL = {
    "vote_adaptive": f"WITH {_VOTE} SELECT item, verdict, rounds_used, unanimous, no_majority, bloc_size, shortfall FROM vote",
    "vote_statistics": f"WITH {_VOTE} SELECT count(*)::BIGINT AS n_items, count(*) FILTER (unanimous)::BIGINT AS n_unanimous, count(*) FILTER (NOT unanimous)::BIGINT AS n_split, count(*) FILTER (unanimous IS NULL)::BIGINT AS n_undecidable, count(*) FILTER (no_majority)::BIGINT AS n_no_majority, count(*) FILTER (rounds_used > 3)::BIGINT AS n_extra_rounds FROM vote",
    "verdict_spellings": f"SELECT {_V} AS verdict, count(*)::BIGINT AS n FROM verdicts GROUP BY 1",
    "support_rates": f"WITH {_R} SELECT {_COUNTS} FROM r WHERE verdict IS NOT NULL",
    "support_rates_numeric": f"WITH {_R} SELECT {_COUNTS} FROM r WHERE verdict IS NOT NULL AND is_numeric_claim",
    "support_rates_by_judge": f"WITH {_R} SELECT judge_id, {_COUNTS} FROM r WHERE verdict IS NOT NULL GROUP BY 1",
    "per_round_band": f"WITH {_R}, q AS (SELECT rank, {_COUNTS} FROM r WHERE verdict IS NOT NULL AND rank <= 3 GROUP BY 1) SELECT min(strict_rate) AS strict_low, max(strict_rate) AS strict_high, min(lenient_rate) AS lenient_low, max(lenient_rate) AS lenient_high FROM q",
    "shortfall_rollup": f"WITH {_VOTE}, y AS (SELECT coalesce(shortfall, 'unnamed') AS shortfall, CASE WHEN shortfall IS NULL THEN 'unnamed' WHEN shortfall = 'unsupported_addition' THEN shortfall ELSE 'overstatement' END AS axis FROM vote WHERE verdict IN ('partially_supported', 'not_supported')) SELECT axis, coalesce(shortfall, '(all)') AS shortfall, count(*)::BIGINT AS n FROM y GROUP BY GROUPING SETS ((axis), (axis, shortfall))",
    "claim_funnel": f"WITH {_CLAIMS} SELECT {_FRATES} FROM (SELECT {_FUNNEL} FROM c2)",
    "claim_funnel_by_question": f"WITH {_CLAIMS} SELECT {_FRATES} FROM (SELECT question_id, {_FUNNEL} FROM c2 GROUP BY 1)",
    "funnel_recovery": f"WITH {_CLAIMS}, k AS (SELECT question_id, claim AS text, bool_or(coalesce(found, false)) AS found, bool_or(coalesce(found AND span_tier IN ('exact', 'normalized', 'elided'), false)) AS verified FROM readset_lookups GROUP BY 1, 2), j AS (SELECT k.found IS NOT NULL AS probed, k.found, k.verified FROM c2 LEFT JOIN k ON k.question_id = c2.question_id AND k.text = c2.text WHERE compliant AND NOT bad AND added) SELECT count(*)::BIGINT AS n_in_scope, count(*) FILTER (probed)::BIGINT AS n_probed, count(*) FILTER (found)::BIGINT AS n_found, count(*) FILTER (verified)::BIGINT AS n_verified, count(*) FILTER (NOT probed)::BIGINT AS n_unprobed FROM j",
}
