"""Queries about citations: parsing, verbatim tiers, quote lengths, coverage windows, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from citeloom.functions.text import FULL, PLAIN, nearest_rank, strip_markers
from citeloom.operators import citations, verbatim, windows
from citeloom.session import sf_table

BANDS = ((100, "1-100"), (200, "101-200"), (300, "201-300"), (400, "301-400"))
WINDOWS = (0, 1, 2, 3, 4, 5)


def answers_once(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    return citations.latest(sf_table(spark, sf_dir, "answers"), "answer_id", ["answer", *more])


def citations_once(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    return citations.latest(sf_table(spark, sf_dir, "citations"), "citation_id", ["answer_id", "doc_id", "quote", *more])


def sections_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    return citations.latest(sf_table(spark, sf_dir, "candidate_units"), "doc_id", ["text"])


def citation_parse(spark, sf_dir):
    return citations.markers(answers_once(spark, sf_dir)).select("answer_id", "marker_idx", "doc_id", "quote", "pos")


def cited_docs_distinct(spark, sf_dir):
    return citations.cited_docs(answers_once(spark, sf_dir))


def marker_free_text(spark, sf_dir):
    plain = strip_markers(F.col("answer"))
    return answers_once(spark, sf_dir).select("answer_id", F.length("answer").cast("bigint").alias("n_chars"), F.length(plain).cast("bigint").alias("n_plain"), F.sha2(plain, 256).alias("plain_digest"))


def line_units(spark, sf_dir):
    return citations.line_spans(answers_once(spark, sf_dir))


def marker_line_attribution(spark, sf_dir):
    answers = answers_once(spark, sf_dir)
    return citations.attribute(citations.markers(answers), citations.line_spans(answers))


def _tiers(spark, sf_dir, criteria):
    return verbatim.quote_tiers(citations_once(spark, sf_dir, "guideline_id"), sections_once(spark, sf_dir), criteria)


def verbatim_tiers_plain(spark, sf_dir):
    return _tiers(spark, sf_dir, PLAIN).select("citation_id", "tier")


def verbatim_compliance(spark, sf_dir):
    return verbatim.compliance(_tiers(spark, sf_dir, PLAIN))


def verbatim_by_guideline(spark, sf_dir):
    return verbatim.compliance(_tiers(spark, sf_dir, PLAIN), ["guideline_id"])


def verbatim_per_answer(spark, sf_dir):
    per = verbatim.compliance(_tiers(spark, sf_dir, PLAIN), ["answer_id"]).select("answer_id", "n", "n_passed", "verbatim_rate")
    every = answers_once(spark, sf_dir).select("answer_id").join(per, "answer_id", "left")
    return every.select("answer_id", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("n_passed", F.lit(0)).alias("n_passed"), "verbatim_rate")


def verbatim_tiers_full(spark, sf_dir):
    return _tiers(spark, sf_dir, FULL).select("citation_id", "tier")


def unresolved_citations(spark, sf_dir):
    known = sections_once(spark, sf_dir).select("doc_id")
    return citations_once(spark, sf_dir).join(known, "doc_id", "left_anti").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))


def _lengths(spark, sf_dir):
    return citations_once(spark, sf_dir).filter("quote is not null").select("citation_id", "answer_id", F.length("quote").cast("bigint").alias("n"))


def quote_length_profile(spark, sf_dir):
    """Quantiles by rank over sorted lengths: two passes of counts per length, no gathered list."""
    by = _lengths(spark, sf_dir).groupBy("n").agg(F.count(F.lit(1)).alias("c"))
    cum = by.withColumn("upto", F.sum("c").over(Window.orderBy("n")))
    total = by.agg(F.sum("c").alias("total"))
    ranks = cum.crossJoin(F.broadcast(total))
    at = lambda q: F.min(F.when(F.col("upto") > F.least(F.col("total") - 1, F.floor(F.lit(q) * F.col("total"))), F.col("n")))
    low = F.min(F.when(F.col("upto") > F.floor((F.col("total") - 1) / 2), F.col("n")))
    high = F.min(F.when(F.col("upto") > F.floor(F.col("total") / 2), F.col("n")))
    return ranks.agg(F.max("total").alias("n"), ((low + high) / 2.0).alias("median"), (F.sum(F.col("n") * F.col("c")) / F.max("total")).alias("mean"), at(0.9).alias("p90"), at(0.99).alias("p99"), F.min("n").alias("shortest"), F.max("n").alias("longest"))


def quote_length_bands(spark, sf_dir):
    band = F.lit("401+")
    for top, name in reversed(BANDS):
        band = F.when(F.col("n") <= top, name).otherwise(band)
    spine = spark.createDataFrame([(name,) for _, name in BANDS] + [("401+",)], "band string")
    counted = _lengths(spark, sf_dir).groupBy(band.alias("band")).agg(F.count(F.lit(1)).alias("c"))
    out = spine.join(counted, "band", "left").withColumn("n", F.coalesce("c", F.lit(0)))
    total = out.agg(F.sum("n").alias("total"))
    return out.crossJoin(F.broadcast(total)).select("band", "n", F.try_divide(F.col("n").cast("double"), F.col("total").cast("double")).alias("share"))


def quote_length_per_answer(spark, sf_dir):
    return _lengths(spark, sf_dir).groupBy("answer_id").agg(F.count(F.lit(1)).alias("n_quotes"), F.max("n").alias("longest"), nearest_rank(F.collect_list("n"), 0.9).alias("p90"))


def _claims_and_marks(spark, sf_dir):
    answers = answers_once(spark, sf_dir)
    spans = citations.line_spans(answers)
    claims = spans.filter(F.length("text") >= 15).select("answer_id", F.col("sent_idx").alias("idx"))
    placed = citations.attribute(citations.markers(answers), spans)
    return answers, claims, placed


def coverage_by_window(spark, sf_dir):
    answers, claims, placed = _claims_and_marks(spark, sf_dir)
    return windows.coverage(answers, claims, windows.window_pairs(claims, placed, WINDOWS), WINDOWS)


def coverage_macro_micro(spark, sf_dir):
    return windows.coverage_summary(coverage_by_window(spark, sf_dir))


def claim_pairing_ladder(spark, sf_dir):
    answers, claims, placed = _claims_and_marks(spark, sf_dir)
    pairs = windows.window_pairs(claims, placed, (1, 3, 5))
    per = pairs.groupBy("k").agg(F.count(F.lit(1)).alias("n_pairs"), F.countDistinct("answer_id", "claim_idx").alias("n_paired_claims"), F.countDistinct("answer_id", "marker_idx").alias("n_paired_markers"))
    return per.select("k", "n_pairs", "n_paired_claims", "n_paired_markers")


def quote_gate_effect(spark, sf_dir):
    """Claims covered with and without the markers whose quote is not verbatim, for every window."""
    answers, claims, placed = _claims_and_marks(spark, sf_dir)
    pairs = windows.window_pairs(claims, placed, WINDOWS)
    marked = verbatim.quote_tiers(citations.markers(answers).select("answer_id", "marker_idx", "doc_id", "quote"), sections_once(spark, sf_dir), PLAIN)
    gated = pairs.join(marked.select("answer_id", "marker_idx", verbatim.passes(F.col("tier")).alias("ok")), ["answer_id", "marker_idx"])
    per = gated.groupBy("answer_id", "k", "claim_idx").agg(F.count(F.lit(1)).alias("n_markers"), F.count_if("ok").alias("n_ok"))
    return per.groupBy("answer_id", "k").agg(F.count(F.lit(1)).alias("n_covered"), F.count_if(F.col("n_ok") > 0).alias("n_covered_compliant"), F.count_if((F.col("n_ok") > 0) & (F.col("n_ok") < F.col("n_markers"))).alias("n_partly_gated"), F.count_if(F.col("n_ok") == 0).alias("n_gated_out"))


def claim_quote_text(spark, sf_dir):
    """The distinct quotes of each claim in marker order, as one digest."""
    answers, claims, placed = _claims_and_marks(spark, sf_dir)
    pairs = windows.window_pairs(claims, placed, (5,)).join(citations.markers(answers).select("answer_id", "marker_idx", "quote"), ["answer_id", "marker_idx"])
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("marker_idx", "quote"))), lambda x: x["quote"])
    return pairs.groupBy("answer_id", "claim_idx").agg(F.sha2(F.array_join(F.array_distinct(ordered), "\n\n"), 256).alias("quotes_digest"))


_ANSWERS = "(SELECT answer_id, max({answer: answer, loaded_at: loaded_at}) AS _, arg_max(answer, loaded_at) AS answer FROM answers GROUP BY 1)"
_A = "SELECT answer_id, arg_max(answer, loaded_at) AS answer FROM answers GROUP BY 1"
_C = "SELECT citation_id, arg_max(answer_id, loaded_at) AS answer_id, arg_max(doc_id, loaded_at) AS doc_id, (arg_max({q: quote}, loaded_at)).q AS quote, arg_max(guideline_id, loaded_at) AS guideline_id FROM citations GROUP BY 1"
_S = "SELECT doc_id, (arg_max({t: text}, loaded_at)).t AS text FROM candidate_units GROUP BY 1"
_RE = r"\{\{cite:([^|}]+)\|([^}]*)\}\}"
_MARKS = f"""
a AS ({_A}),
p AS (SELECT answer_id, regexp_extract_all(answer, '{_RE}', 1) AS docs, regexp_extract_all(answer, '{_RE}', 2) AS quotes, string_split_regex(answer, '{_RE}') AS chunks FROM a WHERE answer IS NOT NULL),
m AS (SELECT answer_id, (i - 1)::BIGINT AS marker_idx, trim(docs[i], ' ') AS doc_id, quotes[i] AS quote, length(array_to_string(chunks[1:i], ''))::BIGINT AS pos
      FROM (SELECT *, unnest(range(1, len(docs) + 1)) AS i FROM p))"""
_LINES = """
l0 AS (SELECT answer_id, string_split(array_to_string(chunks, ''), chr(10)) AS lines FROM p),
l1 AS (SELECT answer_id, i, lines[i] AS raw, CASE WHEN i > 1 THEN length(array_to_string(lines[1:i-1], chr(10))) + 1 ELSE 0 END AS off FROM (SELECT *, unnest(range(1, len(lines) + 1)) AS i FROM l0)),
s AS (SELECT answer_id, (row_number() OVER (PARTITION BY answer_id ORDER BY i) - 1)::BIGINT AS sent_idx, (off + length(raw) - length(ltrim(raw, ' ')))::BIGINT AS start_pos,
      (off + length(raw) - length(ltrim(raw, ' ')) + length(trim(raw, ' ')))::BIGINT AS end_pos, trim(raw, ' ') AS text FROM l1 WHERE length(trim(raw, ' ')) > 0)"""
_PLACED = """
pl AS (SELECT m.answer_id, m.marker_idx, coalesce(min(CASE WHEN s.start_pos <= m.pos AND m.pos < s.end_pos THEN s.sent_idx END), max(CASE WHEN s.end_pos <= m.pos THEN s.sent_idx END), min(s.sent_idx)) AS sent_idx
       FROM m LEFT JOIN s USING (answer_id) GROUP BY 1, 2)"""
_PAIRS = """
cl AS (SELECT answer_id, sent_idx AS idx FROM s WHERE length(text) >= 15),
g0 AS (SELECT *, CASE WHEN sent_idx = lag(sent_idx) OVER (PARTITION BY answer_id ORDER BY marker_idx) THEN 0 ELSE 1 END AS fresh FROM pl WHERE sent_idx IS NOT NULL),
g1 AS (SELECT *, sum(fresh) OVER (PARTITION BY answer_id ORDER BY marker_idx) AS grp FROM g0),
g2 AS (SELECT answer_id, grp, any_value(sent_idx) AS sent_idx FROM g1 GROUP BY 1, 2),
g3 AS (SELECT *, coalesce(max(sent_idx) OVER (PARTITION BY answer_id ORDER BY grp ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS reached FROM g2),
tr AS (SELECT g3.answer_id, g3.grp, cl.idx, row_number() OVER (PARTITION BY g3.answer_id, g3.grp ORDER BY cl.idx DESC) AS r FROM g3 JOIN cl ON cl.answer_id = g3.answer_id AND cl.idx > g3.reached AND cl.idx <= g3.sent_idx),
pr AS (SELECT tr.answer_id, k.k::BIGINT AS k, tr.idx AS claim_idx, g1.marker_idx FROM tr JOIN g1 USING (answer_id, grp) JOIN (VALUES (1), (2), (3), (4), (5)) k(k) ON tr.r <= k.k
       UNION ALL SELECT g1.answer_id, 0::BIGINT, g1.sent_idx, g1.marker_idx FROM g1 JOIN cl ON cl.answer_id = g1.answer_id AND cl.idx = g1.sent_idx)"""
_ALL = f"WITH {_MARKS}, {_LINES}, {_PLACED}, {_PAIRS}"
_COVER = """,
cv AS (SELECT a.answer_id, k.k::BIGINT AS k, coalesce(n.n, 0)::BIGINT AS n_claims, coalesce(c.n, 0)::BIGINT AS n_covered, c0.v AS coverage FROM a CROSS JOIN (VALUES (0), (1), (2), (3), (4), (5)) k(k)
       LEFT JOIN (SELECT answer_id, count(*) AS n FROM cl GROUP BY 1) n ON n.answer_id = a.answer_id
       LEFT JOIN (SELECT answer_id, k, count(DISTINCT claim_idx) AS n FROM pr GROUP BY 1, 2) c ON c.answer_id = a.answer_id AND c.k = k.k,
       LATERAL (SELECT CASE WHEN coalesce(n.n, 0) > 0 THEN coalesce(c.n, 0)::DOUBLE / n.n END AS v) c0)"""


def _norm(c: str) -> str:
    folded = f"translate(lower({c}), '‘’“”‐‑‒–—', '''''\"\"-----')"
    a = f"regexp_replace({folded}, '\\^[0-9]+', '', 'g')"
    a = f"regexp_replace({a}, '(?m)^[ \\t]*[-*•][ \\t]+', '', 'g')"
    a = f"regexp_replace({a}, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g')"
    a = f"regexp_replace({a}, '[†‡§¶*]|s[0-9]+\\.[0-9]+-[0-9]+(?:[ ]*[-,][ ]*s?[0-9]+\\.[0-9]+-[0-9]+)*|\\||\"', ' ', 'g')"
    a = f"regexp_replace({a}, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g')"
    return f"trim(regexp_replace({a}, '[ ]+([,.;:)\\]}}])', '\\1', 'g'), ' ')"


_TIERED = f"""
n0 AS (SELECT q.*, s.text AS raw, {_norm("s.text")} AS ns, s.doc_id IS NOT NULL AS resolved, trim({_norm("q.quote")}, '''"') AS nq, trim(q.quote, '“”‘’"'' ') AS uq FROM q LEFT JOIN ss s ON s.doc_id = q.doc_id),
n1 AS (SELECT *, trim(nq, '.,;:!?"''()[] ') AS bare, regexp_extract(nq, '^([.,;:!?"''()\\[\\] ]*)', 1) || regexp_extract(nq, '([.,;:!?"''()\\[\\] ]*)$', 1) AS edges,
       list_filter(list_transform(string_split_regex(nq, '[ ]*(?:\\[[.]{{3,}}\\]|[.]{{3,}})[ ]*'), lambda x: trim(x, ' ')), lambda x: length(x) >= 10) AS frags FROM n0),
t AS (SELECT *, CASE WHEN NOT resolved THEN 'unresolved' WHEN coalesce(quote, '') = '' OR coalesce(raw, '') = '' THEN 'fail' WHEN contains(raw, quote) THEN 'exact'
      WHEN uq <> '' AND uq <> quote AND contains(raw, uq) THEN 'exact' WHEN nq <> '' AND contains(ns, nq) THEN 'normalized'
      WHEN bare <> '' AND bare <> nq AND NOT regexp_matches(edges, '[ ]*(?:\\[[.]{{3,}}\\]|[.]{{3,}})[ ]*') AND contains(ns, bare) THEN 'normalized'
      WHEN nq <> '' AND len(frags) >= 2 AND ns LIKE '%' || array_to_string(list_transform(frags, lambda x: replace(replace(replace(x, '\\', '\\\\'), '%', '\\%'), '_', '\\_')), '%') || '%' ESCAPE '\\' THEN 'elided' ELSE 'fail' END AS tier FROM n1)"""
_TIERS = f"WITH q AS ({_C}), ss AS ({_S}), {_TIERED}"
_RATES = "count(*)::BIGINT AS n, count(*) FILTER (tier IN ('exact', 'normalized', 'elided'))::BIGINT AS n_passed, count(*) FILTER (tier = 'exact')::BIGINT AS n_exact, count(*) FILTER (tier = 'normalized')::BIGINT AS n_normalized, count(*) FILTER (tier = 'elided')::BIGINT AS n_elided, count(*) FILTER (tier = 'fail')::BIGINT AS n_fail, count(*) FILTER (tier = 'unresolved')::BIGINT AS n_unresolved"
_RATED = "*, CASE WHEN n > 0 THEN n_passed::DOUBLE / n END AS verbatim_rate, 1 - CASE WHEN n > 0 THEN n_passed::DOUBLE / n END AS failing_rate"
_LEN = f"l AS (SELECT citation_id, answer_id, length(quote)::BIGINT AS n FROM ({_C}) WHERE quote IS NOT NULL)"

QUERIES = {f.__name__: f for f in (citation_parse, cited_docs_distinct, marker_free_text, line_units, marker_line_attribution, verbatim_tiers_plain, verbatim_compliance, verbatim_by_guideline, verbatim_per_answer, verbatim_tiers_full, unresolved_citations, quote_length_profile, quote_length_bands, quote_length_per_answer, coverage_by_window, coverage_macro_micro, claim_pairing_ladder, quote_gate_effect, claim_quote_text)}

ORACLE_SQL = {
    "citation_parse": f"WITH {_MARKS} SELECT answer_id, marker_idx, doc_id, quote, pos FROM m",
    "cited_docs_distinct": f"WITH {_MARKS}, f AS (SELECT answer_id, doc_id, min(marker_idx) AS first FROM m GROUP BY 1, 2) SELECT answer_id, (row_number() OVER (PARTITION BY answer_id ORDER BY first) - 1)::BIGINT AS pos, doc_id FROM f",
    "marker_free_text": f"WITH a AS ({_A}) SELECT answer_id, length(answer)::BIGINT AS n_chars, length(regexp_replace(answer, '{_RE}', '', 'g'))::BIGINT AS n_plain, sha256(regexp_replace(answer, '{_RE}', '', 'g')) AS plain_digest FROM a",
    "line_units": f"WITH {_MARKS}, {_LINES} SELECT answer_id, sent_idx, start_pos, end_pos, text FROM s",
    "marker_line_attribution": f"WITH {_MARKS}, {_LINES}, {_PLACED} SELECT answer_id, marker_idx, sent_idx FROM pl",
    "verbatim_tiers_plain": f"{_TIERS} SELECT citation_id, tier FROM t",
    "verbatim_compliance": f"{_TIERS} SELECT {_RATED} FROM (SELECT {_RATES} FROM t)",
    "verbatim_by_guideline": f"{_TIERS} SELECT {_RATED} FROM (SELECT guideline_id, {_RATES} FROM t GROUP BY 1)",
    "verbatim_per_answer": f"{_TIERS}, a AS ({_A}), r AS (SELECT answer_id, {_RATES} FROM t GROUP BY 1) SELECT a.answer_id, coalesce(r.n, 0)::BIGINT AS n, coalesce(r.n_passed, 0)::BIGINT AS n_passed, r.n_passed::DOUBLE / r.n AS verbatim_rate FROM a LEFT JOIN r USING (answer_id)",
    "unresolved_citations": f"SELECT doc_id, count(*)::BIGINT AS n FROM ({_C}) c WHERE doc_id NOT IN (SELECT doc_id FROM candidate_units WHERE doc_id IS NOT NULL) GROUP BY 1",
    "quote_length_profile": f"WITH {_LEN}, o AS (SELECT list(n ORDER BY n) AS v, count(*) AS c FROM l) SELECT c::BIGINT AS n, (v[((c - 1) // 2 + 1)::INT] + v[(c // 2 + 1)::INT]) / 2.0 AS median, list_sum(v)::DOUBLE / c AS mean, v[least(c - 1, floor(0.9 * c))::INT + 1]::BIGINT AS p90, v[least(c - 1, floor(0.99 * c))::INT + 1]::BIGINT AS p99, v[1]::BIGINT AS shortest, v[c::INT]::BIGINT AS longest FROM o",
    "quote_length_bands": f"WITH {_LEN}, b AS (SELECT CASE WHEN n <= 100 THEN '1-100' WHEN n <= 200 THEN '101-200' WHEN n <= 300 THEN '201-300' WHEN n <= 400 THEN '301-400' ELSE '401+' END AS band FROM l), c AS (SELECT s.band, count(b.band)::BIGINT AS n FROM (VALUES ('1-100'), ('101-200'), ('201-300'), ('301-400'), ('401+')) s(band) LEFT JOIN b USING (band) GROUP BY 1) SELECT band, n, n::DOUBLE / (SELECT sum(n) FROM c) AS share FROM c",
    "quote_length_per_answer": f"WITH {_LEN}, o AS (SELECT answer_id, list(n ORDER BY n) AS v, count(*) AS c FROM l GROUP BY 1) SELECT answer_id, c::BIGINT AS n_quotes, v[c::INT]::BIGINT AS longest, v[least(c - 1, floor(0.9 * c))::INT + 1]::BIGINT AS p90 FROM o",
    "coverage_by_window": f"{_ALL}{_COVER} SELECT answer_id, k, n_claims, n_covered, coverage FROM cv",
    "coverage_macro_micro": f"{_ALL}{_COVER} SELECT k, count(*)::BIGINT AS n_answers, count(*) FILTER (n_claims = 0)::BIGINT AS n_without_claims, avg(coverage) AS macro, sum(n_covered)::DOUBLE / sum(n_claims) AS micro FROM cv GROUP BY 1",
    "claim_pairing_ladder": f"{_ALL} SELECT k, count(*)::BIGINT AS n_pairs, count(DISTINCT (answer_id, claim_idx))::BIGINT AS n_paired_claims, count(DISTINCT (answer_id, marker_idx))::BIGINT AS n_paired_markers FROM pr WHERE k IN (1, 3, 5) GROUP BY 1",
    "quote_gate_effect": f"{_ALL}, q AS (SELECT answer_id, marker_idx, doc_id, quote FROM m), ss AS ({_S}), {_TIERED}, j AS (SELECT pr.answer_id, pr.k, pr.claim_idx, count(*) AS n, count(*) FILTER (t.tier IN ('exact', 'normalized', 'elided')) AS ok FROM pr JOIN t USING (answer_id, marker_idx) GROUP BY 1, 2, 3) SELECT answer_id, k, count(*)::BIGINT AS n_covered, count(*) FILTER (ok > 0)::BIGINT AS n_covered_compliant, count(*) FILTER (ok > 0 AND ok < n)::BIGINT AS n_partly_gated, count(*) FILTER (ok = 0)::BIGINT AS n_gated_out FROM j GROUP BY 1, 2",
    "claim_quote_text": f"{_ALL}, d AS (SELECT pr.answer_id, pr.claim_idx, m.quote, min(m.marker_idx) AS first FROM pr JOIN m USING (answer_id, marker_idx) WHERE pr.k = 5 GROUP BY 1, 2, 3) SELECT answer_id, claim_idx, sha256(string_agg(quote, chr(10) || chr(10) ORDER BY first)) AS quotes_digest FROM d GROUP BY 1, 2",
}
