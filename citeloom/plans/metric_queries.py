"""Queries that read verdicts, votes and coverage together, guards over the tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from citeloom.functions.text import PLAIN, percentage, strip_markers
from citeloom.operators import citations, guards, models, verbatim, votes, windows
from citeloom.plans import citation_queries as cq
from citeloom.plans import retrieval_queries as rq
from citeloom.plans import verdict_queries as vq
from citeloom.session import sf_table

LADDER = (1, 3, 5)


def _norm_claim(c):
    return F.btrim(F.lower(F.regexp_replace(c, r"\s+", " ")))


def verbatim_claim_rate(spark, sf_dir):
    """The share of an answer's claims that stand in it, without regard to case, white space and closing punctuation; null without claims."""
    claims = vq.claims_once(spark, sf_dir).select("answer_id", "text")
    answers = cq.answers_once(spark, sf_dir).select("answer_id", _norm_claim(strip_markers(F.coalesce("answer", F.lit("")))).alias("said"))
    each = answers.join(claims.filter("text is not null"), "answer_id", "left")
    inside = F.contains("said", F.rtrim(_norm_claim(F.col("text")), F.lit(" .,;:")))
    per = each.groupBy("answer_id").agg(F.count("text").alias("n_claims"), F.count_if(F.col("text").isNotNull() & inside).alias("n_verbatim"))
    return per.withColumn("rate", F.try_divide(F.col("n_verbatim").cast("double"), F.col("n_claims").cast("double")))


def claim_vote_stats(spark, sf_dir):
    """Rounds that survived for how many items, and how many were unanimous or split; the share of splits rounded to 4 places."""
    alive = F.filter("votes", lambda v: v.isNotNull())
    l = rq.lookups_once(spark, sf_dir).select(F.size(F.coalesce(alive, F.array().cast("array<boolean>"))).cast("bigint").alias("rounds"), F.size(F.filter(F.coalesce(alive, F.array().cast("array<boolean>")), lambda v: v)).alias("yes")).filter("rounds > 0")
    one = l.withColumn("unanimous", (F.col("yes") == 0) | (F.col("yes") == F.col("rounds")))
    out = one.groupingSets([[], ["rounds"]], "rounds").agg(F.count(F.lit(1)).alias("n"), F.count_if("unanimous").alias("n_unanimous"), F.count_if(~F.col("unanimous")).alias("n_split"))
    return out.select(F.coalesce(F.col("rounds").cast("string"), F.lit("*")).alias("rounds"), "n", "n_unanimous", "n_split", F.bround(F.col("n_split") / F.greatest(F.col("n"), F.lit(1)), 4).alias("split_rate"))


def claim_majority(spark, sf_dir):
    """What the surviving rounds of an item decide: half of them and one more; without any round it is kept."""
    l = rq.lookups_once(spark, sf_dir).select(F.col("lookup_id").alias("item"), F.explode_outer("votes").alias("vote"))
    return models.keep_claims(l)


def _marker_verdicts(spark, sf_dir):
    """(answer_id, marker_idx, verdict): the voted verdict of the first atom of each citation."""
    v = sf_table(spark, sf_dir, "verdicts").select("atom_id", "citation_id").groupBy("citation_id").agg(F.min("atom_id").alias("item"))
    c = citations.latest(sf_table(spark, sf_dir, "citations"), "citation_id", ["answer_id", "marker_idx"])
    voted = vq.vote_adaptive(spark, sf_dir).select("item", "verdict")
    return c.join(v, "citation_id").join(voted, "item").groupBy("answer_id", F.col("marker_idx").cast("bigint").alias("marker_idx")).agg(F.min("verdict").alias("verdict"))


def support_ladder(spark, sf_dir):
    """For windows of 1, 3 and 5: claims with markers, and those that a marker's verdict supports, over all claims and over the paired ones."""
    _, claims, placed = cq._claims_and_marks(spark, sf_dir)
    pairs = windows.window_pairs(claims, placed, LADDER).join(_marker_verdicts(spark, sf_dir), ["answer_id", "marker_idx"], "left")
    full, part = F.col("verdict") == "fully_supported", F.col("verdict").isin("fully_supported", "partially_supported")
    per = pairs.groupBy("k", "answer_id", "claim_idx").agg(F.coalesce(F.max(full), F.lit(False)).alias("strict"), F.coalesce(F.max(part), F.lit(False)).alias("lenient"))
    counts = per.groupBy("k").agg(F.count(F.lit(1)).alias("n_paired"), F.count_if("strict").alias("n_strict"), F.count_if("lenient").alias("n_lenient"))
    out = counts.crossJoin(claims.agg(F.count(F.lit(1)).alias("n_claims")))
    rate = lambda a, b: F.try_divide(F.col(a).cast("double"), F.col(b).cast("double"))
    return out.select("k", "n_claims", "n_paired", "n_strict", "n_lenient", rate("n_strict", "n_claims").alias("all_strict"), rate("n_lenient", "n_claims").alias("all_lenient"), rate("n_strict", "n_paired").alias("paired_strict"), rate("n_lenient", "n_paired").alias("paired_lenient"))


def unpaired_markers(spark, sf_dir):
    """Markers of each answer that no window of 5 pairs with a claim."""
    _, claims, placed = cq._claims_and_marks(spark, sf_dir)
    paired = windows.window_pairs(claims, placed, (5,)).select("answer_id", "marker_idx").distinct()
    per = placed.join(paired.withColumn("paired", F.lit(True)), ["answer_id", "marker_idx"], "left")
    return per.groupBy("answer_id").agg(F.count(F.lit(1)).alias("n_markers"), F.count_if(F.col("paired").isNull()).alias("n_unpaired"))


def _compliant(spark, sf_dir, answers):
    marked = verbatim.quote_tiers(citations.markers(answers).select("answer_id", "marker_idx", "doc_id", "quote"), cq.sections_once(spark, sf_dir), PLAIN)
    return marked.filter(verbatim.passes(F.col("tier"))).select("answer_id", "marker_idx")


def coverage_compliant(spark, sf_dir):
    """Coverage by the markers alone whose quote is verbatim, for every window."""
    answers, claims, placed = cq._claims_and_marks(spark, sf_dir)
    pairs = windows.window_pairs(claims, placed, cq.WINDOWS).join(_compliant(spark, sf_dir, answers), ["answer_id", "marker_idx"], "left_semi")
    return windows.coverage_summary(windows.coverage(answers, claims, pairs, cq.WINDOWS))


def gated_markers(spark, sf_dir):
    """The markers of each claim at a window of 1 that the gate drops, in order."""
    answers, claims, placed = cq._claims_and_marks(spark, sf_dir)
    pairs = windows.window_pairs(claims, placed, (1,)).join(_compliant(spark, sf_dir, answers).withColumn("ok", F.lit(True)), ["answer_id", "marker_idx"], "left")
    sets = pairs.groupBy("answer_id", "claim_idx").agg(F.array_sort(F.collect_set("marker_idx")).alias("head"), F.array_sort(F.collect_set(F.when(F.col("ok"), F.col("marker_idx")))).alias("allowed"))
    gone = F.array_except("head", "allowed")
    return sets.filter(F.size(gone) > 0).select("answer_id", "claim_idx", F.array_join(F.transform(gone, lambda x: x.cast("string")), " ").alias("gated"), (F.size("allowed") == 0).alias("gated_out"))


def served_models(spark, sf_dir):
    """The models that served each model's answers, in the order in which they were first seen."""
    a = citations.latest(sf_table(spark, sf_dir, "answers"), "answer_id", ["model", "served_model", "answered_at"])
    first = a.filter(F.length("served_model") > 0).groupBy("model", "served_model").agg(F.min(F.struct("answered_at", "answer_id")).alias("at"))
    return first.groupBy("model").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "served_model"))), lambda x: x["served_model"]), " | ").alias("served"), (F.count(F.lit(1)) > 1).alias("changed"))


def formatted_rates(spark, sf_dir):
    """Verbatim rates of answers as shown: a percentage, or n/a."""
    rate = F.col("verbatim_rate")
    return cq.verbatim_per_answer(spark, sf_dir).select("answer_id", percentage(rate).alias("shown"))


def shortfall_counts(spark, sf_dir):
    """Voted labels, those with a named shortfall, and partial or missing support without one."""
    v = vq.vote_adaptive(spark, sf_dir)
    short = F.col("verdict").isin("partially_supported", "not_supported")
    return v.groupBy("verdict").agg(F.count(F.lit(1)).alias("n"), F.count_if(short & F.col("shortfall").isNotNull()).alias("n_named"), F.count_if(short & F.col("shortfall").isNull()).alias("n_unnamed"))


def guard_rounds(spark, sf_dir):
    return guards.dropped_share(rq.lookups_once(spark, sf_dir), F.col("votes"), F.col("vote_rounds_dropped"))


def guard_strays(spark, sf_dir):
    """Probed claims that no claim row knows."""
    claims = vq.claims_once(spark, sf_dir).select("question_id", "text")
    return guards.stray_share(rq.lookups_once(spark, sf_dir).select("question_id", F.col("claim").alias("text")).filter("text is not null"), claims, ["question_id", "text"])


def guard_answers(spark, sf_dir):
    """Claims by answer, of which each must be known: a claim without its answer ends the query."""
    claims = vq.claims_once(spark, sf_dir).select("claim_id", "answer_id")
    return guards.must_have(claims, cq.answers_once(spark, sf_dir), "answer_id").groupBy("answer_id").agg(F.count(F.lit(1)).alias("n_claims"))


def guard_questions(spark, sf_dir):
    """Lookups with their question; a blank one ends the query."""
    from citeloom.plans.tree_queries import questions_once

    found = guards.asked(rq.lookups_once(spark, sf_dir).select("lookup_id", "question_id"), questions_once(spark, sf_dir), ["question_id"], "question")
    return found.select("lookup_id", F.length("question").cast("bigint").alias("n_chars"))


_RATE = lambda a, b: f"{a}::DOUBLE / nullif({b}, 0)"
_NC = lambda c: f"trim(lower(regexp_replace({c}, '\\s+', ' ', 'g')), ' ')"
_MV = "mv0 AS (SELECT citation_id, min(atom_id) AS item FROM verdicts GROUP BY 1), mc AS (SELECT citation_id, arg_max(answer_id, loaded_at) AS answer_id, arg_max(marker_idx, loaded_at)::BIGINT AS marker_idx FROM citations GROUP BY 1), mv AS (SELECT answer_id, marker_idx, min(vote.verdict) AS verdict FROM mc JOIN mv0 USING (citation_id) JOIN vote USING (item) GROUP BY 1, 2)"
_OK = f"q AS (SELECT answer_id, marker_idx, doc_id, quote FROM m), ss AS ({cq._S}), {cq._TIERED}, okm AS (SELECT answer_id, marker_idx FROM t WHERE tier IN ('exact', 'normalized', 'elided'))"

QUERIES = {f.__name__: f for f in (verbatim_claim_rate, claim_vote_stats, claim_majority, support_ladder, unpaired_markers, coverage_compliant, gated_markers, served_models, formatted_rates, shortfall_counts, guard_rounds, guard_strays, guard_answers, guard_questions)}

ORACLE_SQL = {
    "verbatim_claim_rate": f"WITH a AS ({cq._A}), c AS (SELECT claim_id, max(answer_id) AS answer_id, max(text) AS text FROM claim_rows GROUP BY 1), e AS (SELECT a.answer_id, {_NC(f'''regexp_replace(coalesce(a.answer, ''), '{cq._RE}', '', 'g')''')} AS said, c.text FROM a LEFT JOIN c ON c.answer_id = a.answer_id AND c.text IS NOT NULL), g AS (SELECT answer_id, count(text)::BIGINT AS n_claims, count(*) FILTER (text IS NOT NULL AND contains(said, rtrim({_NC('text')}, ' .,;:')))::BIGINT AS n_verbatim FROM e GROUP BY 1) SELECT *, {_RATE('n_verbatim', 'n_claims')} AS rate FROM g",
    "claim_vote_stats": f"WITH {rq._LK}, v AS (SELECT list_filter(votes, lambda b: b IS NOT NULL) AS a FROM lk), w AS (SELECT len(a) AS rounds, len(list_filter(a, lambda b: b)) AS yes FROM v WHERE len(a) > 0), u AS (SELECT rounds, yes = 0 OR yes = rounds AS u FROM w) SELECT coalesce(rounds::VARCHAR, '*') AS rounds, count(*)::BIGINT AS n, count(*) FILTER (u)::BIGINT AS n_unanimous, count(*) FILTER (NOT u)::BIGINT AS n_split, round_even(count(*) FILTER (NOT u)::DOUBLE / greatest(count(*), 1), 4) AS split_rate FROM u GROUP BY GROUPING SETS ((), (rounds))",
    "claim_majority": f"WITH {rq._LK}, v AS (SELECT lookup_id, list_filter(votes, lambda b: b IS NOT NULL) AS a FROM lk) SELECT lookup_id AS item, CASE WHEN coalesce(len(a), 0) = 0 THEN true ELSE len(list_filter(a, lambda b: b)) >= len(a) // 2 + 1 END AS is_claim FROM v",
    "support_ladder": f"{cq._ALL}, {vq._VOTE}, {_MV}, pc AS (SELECT pr.k, pr.answer_id, pr.claim_idx, coalesce(bool_or(mv.verdict = 'fully_supported'), false) AS st, coalesce(bool_or(mv.verdict IN ('fully_supported', 'partially_supported')), false) AS le FROM pr LEFT JOIN mv USING (answer_id, marker_idx) WHERE pr.k IN (1, 3, 5) GROUP BY 1, 2, 3), kk AS (SELECT k, (SELECT count(*) FROM cl)::BIGINT AS n_claims, count(*)::BIGINT AS n_paired, count(*) FILTER (st)::BIGINT AS n_strict, count(*) FILTER (le)::BIGINT AS n_lenient FROM pc GROUP BY 1) SELECT *, {_RATE('n_strict', 'n_claims')} AS all_strict, {_RATE('n_lenient', 'n_claims')} AS all_lenient, {_RATE('n_strict', 'n_paired')} AS paired_strict, {_RATE('n_lenient', 'n_paired')} AS paired_lenient FROM kk",
    "unpaired_markers": f"{cq._ALL}, u AS (SELECT DISTINCT answer_id, marker_idx FROM pr WHERE k = 5) SELECT pl.answer_id, count(*)::BIGINT AS n_markers, count(*) FILTER (u.marker_idx IS NULL)::BIGINT AS n_unpaired FROM pl LEFT JOIN u USING (answer_id, marker_idx) GROUP BY 1",
    "coverage_compliant": f"{cq._ALL}, {_OK}, pk AS (SELECT pr.* FROM pr JOIN okm USING (answer_id, marker_idx)) {cq._COVER.replace('FROM pr GROUP BY', 'FROM pk GROUP BY')} SELECT k, count(*)::BIGINT AS n_answers, count(*) FILTER (n_claims = 0)::BIGINT AS n_without_claims, avg(coverage) AS macro, sum(n_covered)::DOUBLE / sum(n_claims) AS micro FROM cv GROUP BY 1",
    "gated_markers": f"{cq._ALL}, {_OK}, e AS (SELECT pr.answer_id, pr.claim_idx, pr.marker_idx, okm.marker_idx IS NOT NULL AS ok FROM pr LEFT JOIN okm USING (answer_id, marker_idx) WHERE pr.k = 1) SELECT answer_id, claim_idx, string_agg(marker_idx::VARCHAR, ' ' ORDER BY marker_idx) FILTER (NOT ok) AS gated, NOT bool_or(ok) AS gated_out FROM e GROUP BY 1, 2 HAVING count(*) FILTER (NOT ok) > 0",
    "served_models": f"WITH {rq._AN(['model', 'served_model', 'answered_at'])}, f AS (SELECT x.model AS model, x.served_model AS s, min({{a: x.answered_at, b: answer_id}}) AS seen FROM an WHERE length(x.served_model) > 0 GROUP BY 1, 2) SELECT model, string_agg(s, ' | ' ORDER BY seen) AS served, count(*) > 1 AS changed FROM f GROUP BY 1",
    "formatted_rates": f"WITH v AS ({cq.ORACLE_SQL['verbatim_per_answer']}) SELECT answer_id, coalesce(printf('%.1f%%', verbatim_rate * 100), 'n/a') AS shown FROM v",
    "shortfall_counts": f"WITH {vq._VOTE} SELECT verdict, count(*)::BIGINT AS n, count(*) FILTER (verdict IN ('partially_supported', 'not_supported') AND shortfall IS NOT NULL)::BIGINT AS n_named, count(*) FILTER (verdict IN ('partially_supported', 'not_supported') AND shortfall IS NULL)::BIGINT AS n_unnamed FROM vote GROUP BY 1",
    "guard_rounds": f"WITH {rq._LK}, g AS (SELECT sum(coalesce(len(votes), 0) + coalesce(vote_rounds_dropped, 0))::BIGINT AS n_rounds, sum(coalesce(vote_rounds_dropped, 0))::BIGINT AS n_dropped FROM lk) SELECT *, coalesce(n_dropped::DOUBLE / nullif(n_rounds, 0), 0) AS share, coalesce(n_dropped::DOUBLE / nullif(n_rounds, 0), 0) > {guards.MOST_DROPPED} AS rejected FROM g",
    "guard_strays": f"WITH {rq._LK}, c AS (SELECT DISTINCT question_id, max(text) AS text FROM claim_rows GROUP BY claim_id, question_id), p AS (SELECT DISTINCT question_id, claim AS text FROM lk WHERE claim IS NOT NULL) SELECT count(*)::BIGINT AS n_probed, count(*) FILTER (NOT EXISTS (SELECT 1 FROM c WHERE c.question_id = p.question_id AND c.text = p.text))::BIGINT AS n_stray, count(*) FILTER (NOT EXISTS (SELECT 1 FROM c WHERE c.question_id = p.question_id AND c.text = p.text)) > count(*) * {guards.MOST_STRAY} AS rejected FROM p",
    "guard_answers": "WITH c AS (SELECT claim_id, max(answer_id) AS answer_id FROM claim_rows GROUP BY 1) SELECT answer_id, count(*)::BIGINT AS n_claims FROM c GROUP BY 1",
    "guard_questions": f"WITH {rq._LK}, {rq._QS} SELECT lk.lookup_id, length(qs.x.a)::BIGINT AS n_chars FROM lk JOIN qs USING (question_id)",
}
