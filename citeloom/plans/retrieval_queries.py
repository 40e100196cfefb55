"""Queries about retrieval, recovery, logs and caches, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from citeloom.functions.stemming import STOPWORDS
from citeloom.functions.text import PLAIN, cache_key, model_slug, normalize
from citeloom.operators import citations, corpus, history, recovery, retrieval, tree, verbatim, votes
from citeloom.plans.citation_queries import citations_once, sections_once
from citeloom.plans.tree_queries import nodes_once, questions_once, unit_texts
from citeloom.session import materialise, sf_table

KS = (1, 3, 5, 10)


def _pool(spark, sf_dir):
    return citations.latest(sf_table(spark, sf_dir, "candidate_units"), "doc_id", ["text", "summary", "chapter_id", "guideline_id", "title_path"])


def _documents(spark, sf_dir):
    return _pool(spark, sf_dir).select("doc_id", retrieval.document_text(F.col("text"), F.col("summary"), F.array_join("title_path", " > ")).alias("text"))


def _asked(spark, sf_dir):
    return questions_once(spark, sf_dir).select(F.col("question_id").alias("query_id"), F.col("question").alias("text"))


def bm25_rank(spark, sf_dir):
    return retrieval.bm25_top(_asked(spark, sf_dir), _documents(spark, sf_dir), 10, stemmed=False)


def bm25_stemmed(spark, sf_dir):
    return retrieval.bm25_top(_asked(spark, sf_dir), _documents(spark, sf_dir), 10)


def _hits(spark, sf_dir):
    chapters = _pool(spark, sf_dir).select("doc_id", F.concat_ws(":", "guideline_id", "chapter_id").alias("chapter"))
    ranked = bm25_rank(spark, sf_dir).join(chapters, "doc_id")
    q = questions_once(spark, sf_dir)
    truth = q.select(F.col("question_id").alias("query_id"), F.concat_ws(":", "guideline_id", F.col("source.node_id")).alias("doc_id"), F.concat_ws(":", "guideline_id", F.col("source.chapter_id")).alias("chapter"))
    facets = q.select(F.col("question_id").alias("query_id"), "guideline_id", "question_style")
    return retrieval.hits(ranked, truth, KS), facets


def hit_at_k(spark, sf_dir):
    hit, _ = _hits(spark, sf_dir)
    return hit


def hit_breakdowns(spark, sf_dir):
    hit, facets = _hits(spark, sf_dir)
    return retrieval.hit_breakdowns(hit.join(facets, "query_id"), ["guideline_id", "question_style"])


def truth_missing_from_pool(spark, sf_dir):
    truth = questions_once(spark, sf_dir).select("question_id", F.concat_ws(":", "guideline_id", F.col("source.node_id")).alias("doc_id"))
    return truth.join(_pool(spark, sf_dir).select("doc_id"), "doc_id", "left_anti").select("question_id", "doc_id")


def _selection_runs(spark, sf_dir):
    """(query_id, ids): the list that the last answer of a question retrieved; null where it failed."""
    a = citations.latest(sf_table(spark, sf_dir, "answers"), "answer_id", ["question_id", "retrieved_set"])
    per = a.groupBy("question_id").agg(F.max_by("retrieved_set", "answer_id").alias("ids"))
    return questions_once(spark, sf_dir).select("question_id").join(per, "question_id", "left").select(F.col("question_id").alias("query_id"), "ids")


def retrieval_results(spark, sf_dir):
    """Rates of the lists that answers retrieved, overall and by guideline, style and chapter."""
    runs = _selection_runs(spark, sf_dir)
    chapters = _pool(spark, sf_dir).select("doc_id", F.concat_ws(":", "guideline_id", "chapter_id").alias("chapter"))
    ranked = runs.select("query_id", F.posexplode("ids").alias("place", "doc_id")).join(chapters, "doc_id", "left").select("query_id", "doc_id", "chapter", (F.col("place") + 1).cast("bigint").alias("rank"))
    q = questions_once(spark, sf_dir).select(F.col("question_id").alias("query_id"), F.concat_ws(":", "guideline_id", F.col("source.node_id")).alias("doc_id"), F.concat_ws(":", "guideline_id", F.col("source.chapter_id")).alias("chapter"), "guideline_id", "question_style")
    return retrieval.results(retrieval.set_hits(ranked, q.select("query_id", "doc_id", "chapter"), KS).join(q.drop("doc_id"), "query_id"), ["guideline_id", "question_style", "chapter"])


def rank_failures(spark, sf_dir):
    runs = _selection_runs(spark, sf_dir)
    return retrieval.rank_failures(runs.select("query_id", F.when(F.col("ids").isNull(), "no ranking").alias("error"), F.coalesce(F.size("ids"), F.lit(0)).alias("n_returned")))


def text_chunks(spark, sf_dir):
    t = _documents(spark, sf_dir)
    return retrieval.text_chunks(t, "doc_id", 1000).select("doc_id", "chunk_no", F.sha2("chunk", 256).alias("digest"))


def request_batches(spark, sf_dir):
    """Requests of each guideline's texts, up to 5,000 characters or 8 texts."""
    t = _pool(spark, sf_dir).select("guideline_id", "doc_id", F.length(F.coalesce("text", F.lit(""))).alias("n"))
    return retrieval.request_batches(t, "guideline_id", "doc_id", F.col("n"), 5_000, 8)


def cosine_topk(spark, sf_dir):
    return retrieval.cosine_top(sf_table(spark, sf_dir, "embeddings"), 10).select("query_id", "vec_id", "rank")


def mean_pool(spark, sf_dir):
    e = sf_table(spark, sf_dir, "embeddings").withColumn("label", F.col("label").cast("bigint"))
    return retrieval.mean_pooled(e, "label", "embedding").select("label", "place", F.round("value", 6).alias("value"))


def lookups_once(spark, sf_dir):
    l = sf_table(spark, sf_dir, "readset_lookups")
    rest = [c for c in l.columns if c not in ("lookup_id", "loaded_at")]
    return citations.latest(l, "lookup_id", rest)


def lookup_vote(spark, sf_dir):
    l = lookups_once(spark, sf_dir)
    decided = votes.strict_majority(F.col("votes"))
    alive = F.filter("votes", lambda v: v.isNotNull())
    full = (F.coalesce("vote_rounds_dropped", F.lit(0)) == 0) & (F.size(alive) > 1)
    return l.select("lookup_id", decided.alias("found"), F.when(full, F.size(F.array_distinct(alive)) == 1).alias("unanimous"), F.size(alive).cast("bigint").alias("n_rounds"))


def rung_partition(spark, sf_dir):
    l = lookups_once(spark, sf_dir).withColumn("rung", recovery.rung(F.col("span_tier"), F.col("evidence_in_node"), F.col("evidence_is_cited_section")))
    return recovery.rung_table(l, "gen_model")


def span_placement(spark, sf_dir):
    rows = lookups_once(spark, sf_dir).select(F.col("lookup_id").alias("row_id"), F.col("evidence_spans").alias("spans"), "read_set")
    return recovery.place_spans(rows, sections_once(spark, sf_dir), PLAIN).withColumnRenamed("row_id", "lookup_id")


def _spans(spark, sf_dir):
    return lookups_once(spark, sf_dir).select(F.col("lookup_id").alias("row_id"), F.coalesce("evidence_spans", F.array().cast("array<string>")).alias("spans"), "read_set", "found", "node_id", "cited_doc_id")


def row_tiers(spark, sf_dir):
    """The tier of every lookup by its spans in all that was read."""
    rows = _spans(spark, sf_dir)
    blobs = corpus.evidence(rows, "row_id", sections_once(spark, sf_dir)).select("row_id", F.col("evidence").alias("text"))
    return recovery.row_tiers(rows, recovery.span_tiers(rows, blobs, PLAIN)).withColumnRenamed("row_id", "lookup_id")


def row_places(spark, sf_dir):
    """Where the spans of every lookup stand: in its node, in the cited section or elsewhere."""
    rows, sections = _spans(spark, sf_dir), sections_once(spark, sf_dir)
    nodes = rows.select("row_id", F.posexplode("node_id").alias("i", "doc_id")).join(sections, "doc_id").groupBy("row_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "text"))), lambda x: x["text"]), "\n\n").alias("text"))
    placed = recovery.place_spans(rows, sections, PLAIN).select("row_id", "span_idx", "doc_id")
    return recovery.row_places(placed, recovery.span_tiers(rows, nodes, PLAIN), rows.select("row_id", "cited_doc_id")).withColumnRenamed("row_id", "lookup_id")


def span_is_quote(spark, sf_dir):
    """Whether a lookup only gave back the quote it began with."""
    l = lookups_once(spark, sf_dir).select("lookup_id", F.explode_outer("evidence_spans").alias("span"), "quote")
    per = l.select("lookup_id", normalize(F.col("span"), PLAIN).alias("span"), normalize(F.col("quote"), PLAIN).alias("quote")).groupBy("lookup_id").agg(F.collect_list("span").alias("spans"), F.max("quote").alias("quote"))
    return per.select("lookup_id", F.coalesce(recovery.is_own_quote(F.col("spans"), F.coalesce("quote", F.lit(""))), F.lit(False)).alias("is_quote"))


def probe_report(spark, sf_dir):
    l = lookups_once(spark, sf_dir).select("gen_model", "found", F.coalesce("span_tier", F.lit("error")).alias("tier"), "votes", F.col("vote_rounds_dropped").alias("dropped"))
    return recovery.probe_report(l, "gen_model")


def span_overlap(spark, sf_dir):
    l = lookups_once(spark, sf_dir).filter(verbatim.passes(F.col("span_tier")) & F.col("evidence_in_node"))
    spans = l.select("lookup_id", "gen_model", "quote", F.explode_outer("evidence_spans").alias("span"))
    normal = spans.select("lookup_id", "gen_model", normalize(F.col("quote"), PLAIN).alias("quote"), normalize(F.btrim("span"), PLAIN).alias("span"))
    per = normal.groupBy("lookup_id", "gen_model", "quote").agg(F.collect_list(F.when(F.length("span") > 0, F.col("span"))).alias("spans"))
    kind = recovery.overlap_kind(F.col("spans"), F.coalesce("quote", F.lit("")))
    return per.groupBy("gen_model", kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"))


def claim_dedupe(spark, sf_dir):
    """The first lookup of each (question, claim, node set)."""
    l = lookups_once(spark, sf_dir).select("lookup_id", "question_id", "claim", F.array_join(F.array_sort("node_id"), ",").alias("nodes"))
    return l.groupBy("question_id", "claim", "nodes").agg(F.min("lookup_id").alias("lookup_id"), F.count(F.lit(1)).alias("n")).select("lookup_id", "n")


def smallest_node(spark, sf_dir):
    nodes = materialise(nodes_once(spark, sf_dir).select("guideline_id", "section_id", "path", "section_type"), "tree-nodes")
    c = citations.latest(sf_table(spark, sf_dir, "citations"), "citation_id", ["guideline_id", "section_id", "quote"]).withColumnRenamed("citation_id", "quote_id")
    # The chapter that a cited section stands in, from the tree; a section of no chapter is looked for in itself.
    c = c.join(tree.chapter_of(nodes), ["guideline_id", "section_id"]).withColumn("section_id", F.coalesce(F.nullif("chapter_id", F.lit("")), "section_id")).drop("chapter_id")
    return recovery.smallest_holder(c, nodes, unit_texts(spark, sf_dir), PLAIN).withColumnRenamed("quote_id", "citation_id")


def null_control(spark, sf_dir):
    """Median similarity of rejected spans to their own read set and to an unrelated one, and of verified ones to their own; Python text matching, no SQL form.

    A row scores as its weakest span; its spans have at least 30 characters in all.
    """
    l = lookups_once(spark, sf_dir)
    trimmed = F.filter(F.transform("evidence_spans", lambda x: F.btrim(x)), lambda x: F.length(x) > 0)
    whole = F.btrim(F.coalesce("evidence", F.lit("")))
    spans = F.when(F.col("evidence_spans").isNotNull(), trimmed).when(F.length(whole) > 0, F.array(whole)).otherwise(F.array().cast("array<string>"))
    l = l.select(F.col("lookup_id").alias("row_id"), F.coalesce("read_set", F.array().cast("array<string>")).alias("read_set"), spans.alias("spans"), F.coalesce(verbatim.passes(F.col("span_tier")), F.lit(False)).alias("passed"))
    l = l.filter(F.aggregate("spans", F.lit(0), lambda n, x: n + F.length(x)) >= 30)
    rows = recovery.dense_places(l.filter(~F.col("passed")).select("row_id", "read_set"), "row_id")
    own = l.select("row_id", F.when(F.col("passed"), "verified").otherwise("own").alias("which"), F.col("row_id").alias("from_id"))
    pairs = own.unionByName(recovery.unrelated_partners(rows).select("row_id", F.lit("unrelated").alias("which"), F.col("partner_id").alias("from_id")))
    texts = l.select(F.col("row_id").alias("from_id"), F.posexplode("read_set").alias("pos", "doc_id")).join(sections_once(spark, sf_dir).filter(F.length("text") > 0), "doc_id")
    parts = F.transform(F.array_sort(F.collect_list(F.struct("pos", F.concat(F.lit("["), "doc_id", F.lit("]\n"), "text").alias("part")))), lambda x: x["part"])
    sets = texts.groupBy("from_id").agg(F.array_join(parts, "\n\n---\n\n").alias("blob"))
    sets = pairs.join(sets, "from_id", "left").select("row_id", "which", normalize(F.coalesce("blob", F.lit(""))).alias("blob"))
    each = sets.join(l.select("row_id", F.explode("spans").alias("span")), "row_id").withColumn("score", recovery.partial_ratio_of(normalize(F.col("span")), F.col("blob")))
    scored = each.groupBy("which", "row_id").agg(F.min("score").alias("score"))
    return scored.groupBy("which").agg(F.count(F.lit(1)).alias("n"), F.median("score").alias("median_ratio"))


def history_window(spark, sf_dir):
    """Turns begin with a view; the newest turns of each user within 100 units of value."""
    log = history.turns(sf_table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], F.col("event_type") == "view")
    kept = history.recent_turns(log, "user_id", F.col("value"), 100)
    return kept.select("event_id", "user_id", "turn")


def history_prune(spark, sf_dir):
    log = history.turns(sf_table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], F.col("event_type") == "view")
    return history.prune_earlier(log, "user_id", {"click": "[left out]", "error": "[failed]"}, "event_type", "props").select("event_id", "turn", "props")


def usage_rollup(spark, sf_dir):
    a = citations.latest(sf_table(spark, sf_dir, "answers"), "answer_id", ["model", "n_read", "n_citations", "max_tokens"])
    return history.usage(a, "model", ["n_read", "n_citations", "max_tokens"]).select("model", "n", "sum_n_read", "sum_n_citations", "sum_max_tokens")


def truncation_count(spark, sf_dir):
    a = citations.latest(sf_table(spark, sf_dir, "answers"), "answer_id", ["model", "finish_reasons"])
    cut = F.exists("finish_reasons", lambda r: F.lower(r).isin("length", "max_tokens"))
    return a.groupBy(model_slug(F.col("model")).alias("model")).agg(F.count(F.lit(1)).alias("n"), F.count_if(cut).alias("n_truncated"))


def retrieved_union(spark, sf_dir):
    """What each question's answers read or retrieved, each document once."""
    a = citations.latest(sf_table(spark, sf_dir, "answers"), "answer_id", ["question_id", "read_set", "retrieved_set"])
    each = a.select("question_id", F.explode(F.concat(F.coalesce("read_set", F.array()), F.coalesce("retrieved_set", F.array()))).alias("doc_id"))
    return each.groupBy("question_id").agg(F.countDistinct("doc_id").alias("n_docs"), F.count(F.lit(1)).alias("n_mentions"))


def cache_hit_miss(spark, sf_dir):
    """Question texts by content key: those that an answer already covers, and the distinct ones still to be done."""
    requests = questions_once(spark, sf_dir).select("question_id", cache_key(F.col("guideline_id"), F.col("question")).alias("key"))
    a = citations.latest(sf_table(spark, sf_dir, "answers"), "answer_id", ["guideline_id", "question"])
    cache = a.filter("question is not null").select(cache_key(F.col("guideline_id"), F.col("question")).alias("key")).distinct()
    hit, missing = history.cache_lookup(requests, cache, "key")
    return hit.select("key", F.lit("hit").alias("state")).distinct().unionByName(missing.select("key", F.lit("miss").alias("state")))


def resume_antijoin(spark, sf_dir):
    todo = questions_once(spark, sf_dir).select("question_id")
    done = citations.latest(sf_table(spark, sf_dir, "answers"), "answer_id", ["question_id"]).select("question_id").distinct()
    reused, left = history.resume(todo, done, "question_id")
    return reused.select("question_id", F.lit("reused").alias("state")).unionByName(left.select("question_id", F.lit("todo").alias("state")))


def session_windows(spark, sf_dir):
    """Sessions of each user with gaps of at most 30 minutes, the batch form of the stream in ``citeloom.streaming``."""
    e = sf_table(spark, sf_dir, "events")
    s = e.groupBy("user_id", F.session_window("ts", "30 minutes").alias("w")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("value"))
    return s.select("user_id", F.unix_micros(F.col("w.start").cast("timestamp_ltz")).alias("start_us"), "n", "value")


_POOL = "pool AS (SELECT doc_id, coalesce(nullif(x.text, ''), nullif(x.summary, ''), nullif(array_to_string(x.title_path, ' > '), ''), '') AS text, x.chapter_id AS chapter_id, x.guideline_id AS guideline_id FROM (SELECT doc_id, arg_max({text: text, summary: summary, chapter_id: chapter_id, guideline_id: guideline_id, title_path: title_path}, loaded_at) AS x FROM candidate_units GROUP BY 1))"
_QS = "qs AS (SELECT question_id, (max({a: question, b: question_style, c: guideline_id, d: source})) AS x FROM questions GROUP BY 1)"
_STOP = "[" + ", ".join(f"'{w}'" for w in sorted(STOPWORDS)) + "]"
_TOK = lambda c: f"list_filter(regexp_extract_all(lower({c}), '[a-z0-9]+'), lambda t: NOT list_contains({_STOP}, t))"
_BM = f"""{_POOL}, {_QS}, dt AS (SELECT doc_id, {_TOK("text")} AS t FROM pool), le AS (SELECT doc_id, len(t) AS dl FROM dt), po AS (SELECT term, doc_id, count(*) AS tf FROM (SELECT doc_id, unnest(t) AS term FROM dt) GROUP BY 1, 2),
tot AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM le), df AS (SELECT term, ln(n - count(*) + 0.5) - ln(count(*) + 0.5) AS raw FROM po, tot GROUP BY term, n), idf AS (SELECT term, CASE WHEN raw < 0 THEN (SELECT avg(raw) * 0.25 FROM df) ELSE raw END AS idf FROM df),
qt AS (SELECT query_id, term, count(*) AS q FROM (SELECT question_id AS query_id, unnest({_TOK("x.a")}) AS term FROM qs) GROUP BY 1, 2),
s1 AS (SELECT query_id, doc_id, round(sum(q * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS score FROM qt JOIN idf USING (term) JOIN po USING (term) JOIN le USING (doc_id), tot GROUP BY 1, 2),
sc AS (SELECT qs.question_id AS query_id, pool.doc_id, coalesce(s1.score, 0) AS score FROM qs CROSS JOIN pool LEFT JOIN s1 ON s1.query_id = qs.question_id AND s1.doc_id = pool.doc_id),
rk AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM sc) WHERE rank <= 10)"""
_HIT = f"""{_BM}, tr AS (SELECT question_id AS query_id, x.c || ':' || x.d.node_id AS doc_id, x.c || ':' || x.d.chapter_id AS chapter, x.c AS guideline_id, x.b AS question_style FROM qs),
f AS (SELECT tr.query_id, any_value(tr.guideline_id) AS guideline_id, any_value(tr.question_style) AS question_style, min(rk.rank) FILTER (rk.doc_id = tr.doc_id) AS a, min(rk.rank) FILTER (p.guideline_id || ':' || p.chapter_id = tr.chapter) AS c FROM tr LEFT JOIN rk ON rk.query_id = tr.query_id LEFT JOIN pool p ON p.doc_id = rk.doc_id GROUP BY 1),
h AS (SELECT f.*, k.k::BIGINT AS k, coalesce(a <= k.k, false) AS hit, coalesce(c <= k.k, false) AS chapter_hit FROM f, (VALUES (1), (3), (5), (10)) k(k))"""
_LK = "lk AS (SELECT x.* FROM (SELECT arg_max(l, loaded_at) AS x FROM readset_lookups l GROUP BY lookup_id))"
_PASS = "('exact', 'normalized', 'elided')"
_RUNG = f"CASE WHEN span_tier = 'error' THEN 'error' WHEN NOT coalesce(span_tier IN {_PASS}, false) THEN 'nowhere' WHEN coalesce(evidence_in_node, false) THEN 'node' WHEN evidence_is_cited_section IS NULL THEN 'unattributed' WHEN evidence_is_cited_section THEN 'sectionrest' ELSE 'othersection' END"
_AN = lambda cols: "an AS (SELECT answer_id, arg_max({" + ", ".join(f"{c}: {c}" for c in cols) + "}, loaded_at) AS x FROM answers GROUP BY 1)"
_TURN = "t AS (SELECT *, sum((event_type = 'view')::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS turn FROM events)"


def _span_sql() -> tuple[str, str]:
    from citeloom.plans.citation_queries import _S, _TIERED, _norm

    place = f"WITH {_LK}, e AS (SELECT lookup_id, i - 1 AS span_idx, evidence_spans[i] AS quote, read_set FROM (SELECT *, unnest(range(1, len(evidence_spans) + 1)) AS i FROM lk)), q AS (SELECT lookup_id, span_idx, quote, j AS pos, read_set[j] AS doc_id FROM (SELECT *, unnest(CASE WHEN len(read_set) > 0 THEN range(1, len(read_set) + 1) ELSE [NULL] END) AS j FROM e WHERE trim(quote, ' ') <> '')), ss AS ({_S}), {_TIERED}, w AS (SELECT lookup_id, span_idx, arg_min({{d: doc_id, t: tier}}, pos) FILTER (tier IN {_PASS}) AS x FROM t GROUP BY 1, 2) SELECT lookup_id, span_idx::BIGINT AS span_idx, x.d AS doc_id, x.t AS tier FROM w"
    overlap = f"""WITH {_LK}, e AS (SELECT lookup_id, gen_model, {_norm("quote")} AS quote, list_filter(list_transform(coalesce(evidence_spans, []), lambda s: {_norm("trim(s, ' ')")}), lambda s: length(s) > 0) AS spans FROM lk WHERE span_tier IN {_PASS} AND evidence_in_node),
k AS (SELECT gen_model, CASE WHEN len(spans) > 0 AND length(coalesce(quote, '')) > 0 AND len(list_filter(spans, lambda s: contains(quote, s))) = len(spans) THEN 'echo' WHEN len(spans) > 0 AND length(coalesce(quote, '')) > 0 AND len(list_filter(spans, lambda s: contains(quote, s) OR contains(s, quote))) > 0 THEN 'quotectx' ELSE 'disjoint' END AS kind FROM e) SELECT gen_model, kind, count(*)::BIGINT AS n FROM k GROUP BY 1, 2"""
    return place, overlap


def _row_sql() -> tuple[str, str, str]:
    from citeloom.plans.citation_queries import _S, _TIERED, _norm

    spans = "sp AS (SELECT lookup_id, i - 1 AS span_idx, evidence_spans[i] AS quote, read_set, node_id, cited_doc_id FROM (SELECT *, unnest(range(1, len(evidence_spans) + 1)) AS i FROM lk))"
    rn = "rn AS (SELECT lookup_id, i, read_set[i] AS doc_id FROM (SELECT *, unnest(range(1, len(read_set) + 1)) AS i FROM lk))"
    tiers = f"""WITH {_LK}, {spans}, {rn}, se AS ({_S}), ss AS (SELECT lk.lookup_id::VARCHAR AS doc_id, coalesce(string_agg('[' || rn.doc_id || ']' || chr(10) || se.text, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rn.i) FILTER (length(se.text) > 0), '') AS text FROM lk LEFT JOIN rn USING (lookup_id) LEFT JOIN se ON se.doc_id = rn.doc_id GROUP BY 1),
q AS (SELECT lookup_id, span_idx, quote, lookup_id::VARCHAR AS doc_id FROM sp), {_TIERED}, g AS (SELECT lookup_id, arg_min(tier, span_idx) FILTER (tier NOT IN {_PASS}) AS bad, max(CASE tier WHEN 'exact' THEN 0 WHEN 'normalized' THEN 1 WHEN 'elided' THEN 2 END) AS weak FROM t GROUP BY 1)
SELECT lk.lookup_id, CASE WHEN lk.found IS NULL THEN 'error' WHEN NOT lk.found THEN 'n/a' ELSE coalesce(g.bad, CASE g.weak WHEN 0 THEN 'exact' WHEN 1 THEN 'normalized' WHEN 2 THEN 'elided' END, 'empty') END AS tier FROM lk LEFT JOIN g USING (lookup_id)"""
    node = f"""WITH {_LK}, {spans}, se AS ({_S}), nn AS (SELECT lookup_id, i, node_id[i] AS doc_id FROM (SELECT *, unnest(range(1, len(node_id) + 1)) AS i FROM lk)), ss AS (SELECT nn.lookup_id::VARCHAR AS doc_id, string_agg(se.text, chr(10) || chr(10) ORDER BY nn.i) AS text FROM nn JOIN se USING (doc_id) GROUP BY 1),
q AS (SELECT lookup_id, span_idx, quote, lookup_id::VARCHAR AS doc_id FROM sp), {_TIERED} SELECT lookup_id, span_idx, tier IN {_PASS} AS here FROM t"""
    places = f"""WITH pp AS ({_span_sql()[0]}), hh AS ({node}), {_LK}, e AS (SELECT pp.lookup_id, pp.span_idx, pp.doc_id, coalesce(hh.here, false) AS here, coalesce(list_contains(coalesce(lk.cited_doc_id, []), pp.doc_id), pp.doc_id IS NOT NULL AND false) AS cited FROM pp LEFT JOIN hh USING (lookup_id, span_idx) JOIN lk USING (lookup_id))
SELECT lookup_id, count(*)::BIGINT AS n_spans, CASE WHEN count(doc_id) = count(*) THEN bool_and(here) END AS evidence_in_node, CASE WHEN count(doc_id) = count(*) THEN bool_and(cited) END AS evidence_is_cited_section, CASE WHEN count(doc_id) = count(*) THEN coalesce(arg_min(doc_id, span_idx) FILTER (NOT cited), arg_min(doc_id, span_idx)) END AS evidence_section FROM e GROUP BY 1"""
    own = f"""WITH {_LK}, e AS (SELECT lookup_id, {_norm("quote")} AS quote, list_filter(list_transform(coalesce(evidence_spans, []), lambda s: {_norm("s")}), lambda s: length(s) > 0) AS spans FROM lk) SELECT lookup_id, coalesce(length(coalesce(quote, '')) > 0 AND len(list_filter(spans, lambda s: contains(quote, s) OR contains(s, quote))) > 0, false) AS is_quote FROM e"""
    return tiers, places, own


def _smallest_sql() -> str:
    from citeloom.plans.citation_queries import _S, _TIERED
    from citeloom.plans.tree_queries import _N, _U

    return f"""WITH {_N}, {_U}, ch AS (SELECT n.guideline_id, n.section_id, coalesce((SELECT arg_min(ap.ancestor_id, ap.depth) FROM ap JOIN n a ON a.guideline_id = ap.guideline_id AND a.section_id = ap.ancestor_id WHERE a.section_type = 'chapter' AND ap.guideline_id = n.guideline_id AND ap.section_id = n.section_id), n.section_id) AS chapter FROM n),
c AS (SELECT citation_id, x.guideline_id AS guideline_id, x.section_id AS section_id, x.quote AS quote FROM (SELECT citation_id, arg_max({{guideline_id: guideline_id, section_id: section_id, quote: quote}}, loaded_at) AS x FROM citations GROUP BY 1)),
ss AS (SELECT guideline_id || ':' || section_id AS doc_id, text FROM u JOIN n USING (guideline_id, section_id)),
q AS (SELECT c.citation_id, ap.section_id AS node, c.guideline_id || ':' || ap.section_id AS doc_id, c.quote FROM c JOIN ch USING (guideline_id, section_id) JOIN ap ON ap.guideline_id = c.guideline_id AND ap.ancestor_id = ch.chapter JOIN u ON u.guideline_id = ap.guideline_id AND u.section_id = ap.section_id), {_TIERED},
w AS (SELECT citation_id, min({{n: length(raw), s: node, t: tier}}) AS x FROM t WHERE tier IN {_PASS} GROUP BY 1) SELECT citation_id, x.s AS section_id, x.t AS tier FROM w"""


_PLACE, _OVERLAP = _span_sql()
_ROW_TIERS, _ROW_PLACES, _OWN = _row_sql()
_RUNS = "ru AS (SELECT qs.question_id AS query_id, y.ids FROM qs LEFT JOIN (SELECT x.question_id AS question_id, arg_max({i: x.retrieved_set}, answer_id).i AS ids FROM an GROUP BY 1) y USING (question_id))"

QUERIES = {f.__name__: f for f in (bm25_rank, bm25_stemmed, hit_at_k, hit_breakdowns, retrieval_results, rank_failures, text_chunks, request_batches, truth_missing_from_pool, cosine_topk, mean_pool, lookup_vote, rung_partition, span_placement, row_tiers, row_places, span_is_quote, probe_report, span_overlap, claim_dedupe, smallest_node, null_control, history_window, history_prune, usage_rollup, truncation_count, retrieved_union, cache_hit_miss, resume_antijoin, session_windows)}

ORACLE_SQL = {
    "bm25_rank": f"WITH {_BM} SELECT query_id, doc_id, score, rank::BIGINT AS rank FROM rk",
    "hit_at_k": f"WITH {_HIT} SELECT query_id, k, hit, chapter_hit FROM h",
    "hit_breakdowns": f"WITH {_HIT} SELECT k, coalesce(guideline_id, '*') AS guideline_id, coalesce(question_style, '*') AS question_style, count(*)::BIGINT AS n, avg(hit::INT)::DOUBLE AS hit_rate, avg(chapter_hit::INT)::DOUBLE AS chapter_rate FROM h GROUP BY GROUPING SETS ((k), (k, guideline_id), (k, question_style))",
    "retrieval_results": f"""WITH {_POOL}, {_QS}, {_AN(['question_id', 'retrieved_set'])}, {_RUNS}, tr AS (SELECT question_id AS query_id, x.c || ':' || x.d.node_id AS doc_id, x.c || ':' || x.d.chapter_id AS chapter, x.c AS guideline_id, x.b AS question_style FROM qs),
rk AS (SELECT query_id, i AS rank, ids[i] AS doc_id FROM (SELECT *, unnest(range(1, len(ids) + 1)) AS i FROM ru)), f AS (SELECT tr.query_id, any_value(tr.guideline_id) AS guideline_id, any_value(tr.question_style) AS question_style, any_value(tr.chapter) AS chapter, count(rk.rank) AS n_returned, min(rk.rank) FILTER (rk.doc_id = tr.doc_id) AS a, min(rk.rank) FILTER (p.guideline_id || ':' || p.chapter_id = tr.chapter) AS c FROM tr LEFT JOIN rk USING (query_id) LEFT JOIN pool p ON p.doc_id = rk.doc_id GROUP BY 1),
h AS (SELECT f.*, k.k::BIGINT AS k, coalesce(a <= k.k, false) AS hit, coalesce(c <= k.k, false) AS chit, a IS NOT NULL AS sh, c IS NOT NULL AS sc FROM f, (VALUES (1), (3), (5), (10)) k(k))
SELECT k, coalesce(guideline_id, '*') AS guideline_id, coalesce(question_style, '*') AS question_style, coalesce(chapter, '*') AS chapter, count(*)::BIGINT AS n, round_even(avg(n_returned), 2) AS avg_returned, round_even(avg(hit::INT)::DOUBLE, 4) AS hit_rate, round_even(avg(chit::INT)::DOUBLE, 4) AS chapter_rate, round_even(avg(sh::INT)::DOUBLE, 4) AS set_rate, round_even(avg(sc::INT)::DOUBLE, 4) AS set_chapter_rate FROM h GROUP BY GROUPING SETS ((k), (k, guideline_id), (k, question_style), (k, chapter))""",
    "rank_failures": f"WITH {_QS}, {_AN(['question_id', 'retrieved_set'])}, {_RUNS} SELECT count(*)::BIGINT AS n, count(*) FILTER (ids IS NULL)::BIGINT AS n_failed, count(*) FILTER (len(ids) = 0)::BIGINT AS n_empty, coalesce((SELECT string_agg(query_id, ' ' ORDER BY query_id) FROM (SELECT query_id FROM ru WHERE ids IS NULL ORDER BY query_id LIMIT 20)), '') AS failures FROM ru",
    "text_chunks": f"WITH {_POOL} SELECT doc_id, i AS chunk_no, sha256(substr(text, i * 1000 + 1, 1000)) AS digest FROM (SELECT doc_id, text, unnest(range(0, ceil(length(text) / 1000.0)::BIGINT)) AS i FROM pool WHERE length(text) > 0)",
    "request_batches": "WITH RECURSIVE p AS (SELECT doc_id, x.g AS guideline_id, length(coalesce(x.t, '')) AS n, row_number() OVER (PARTITION BY x.g ORDER BY doc_id) AS r FROM (SELECT doc_id, arg_max({g: guideline_id, t: text}, loaded_at) AS x FROM candidate_units GROUP BY 1)), w AS (SELECT guideline_id, doc_id, r, 0::BIGINT AS request_no, 1::BIGINT AS k, n::BIGINT AS total FROM p WHERE r = 1 UNION ALL SELECT p.guideline_id, p.doc_id, p.r, CASE WHEN w.total + p.n > 5000 OR w.k >= 8 THEN w.request_no + 1 ELSE w.request_no END, CASE WHEN w.total + p.n > 5000 OR w.k >= 8 THEN 1 ELSE w.k + 1 END, CASE WHEN w.total + p.n > 5000 OR w.k >= 8 THEN p.n ELSE w.total + p.n END FROM w JOIN p ON p.guideline_id = w.guideline_id AND p.r = w.r + 1) SELECT guideline_id, doc_id, request_no FROM w",
    "smallest_node": _smallest_sql(),
    "row_tiers": _ROW_TIERS,
    "row_places": _ROW_PLACES,
    "span_is_quote": _OWN,
    "probe_report": f"WITH {_LK}, v AS (SELECT gen_model, found, coalesce(span_tier, 'error') AS tier, coalesce(vote_rounds_dropped, 0) AS dropped, list_filter(votes, lambda b: b IS NOT NULL) AS a FROM lk), u AS (SELECT *, CASE WHEN dropped = 0 AND len(a) > 1 THEN len(list_distinct(a)) = 1 END AS u FROM v), c AS (SELECT coalesce(gen_model, '*') AS gen_model, count(*)::BIGINT AS n_rows, count(*) FILTER (tier <> 'error')::BIGINT AS n_judged, count(*) FILTER (tier = 'error')::BIGINT AS n_errors, count(*) FILTER (tier <> 'error' AND coalesce(found, false))::BIGINT AS n_found, count(*) FILTER (tier IN {_PASS})::BIGINT AS n_verified, count(*) FILTER (NOT u)::BIGINT AS n_vote_split, count(u)::BIGINT AS n_complete, sum(dropped)::BIGINT AS n_rounds_dropped FROM u GROUP BY GROUPING SETS ((), (gen_model))) SELECT *, n_verified::DOUBLE / nullif(n_judged, 0) AS verified_rate, n_vote_split::DOUBLE / nullif(n_complete, 0) AS vote_split_rate FROM c",
    "truth_missing_from_pool": f"WITH {_POOL}, {_QS} SELECT question_id, x.c || ':' || x.d.node_id AS doc_id FROM qs WHERE x.c || ':' || x.d.node_id NOT IN (SELECT doc_id FROM pool WHERE doc_id IS NOT NULL)",
    "cosine_topk": "WITH e AS (SELECT vec_id::BIGINT AS vec_id, embedding::DOUBLE[] AS v FROM embeddings), s AS (SELECT a.vec_id AS query_id, b.vec_id, round(list_cosine_similarity(a.v, b.v), 9) AS score FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::BIGINT AS rank FROM s) SELECT query_id, vec_id, rank FROM r WHERE rank <= 10",
    "mean_pool": "WITH e AS (SELECT label::BIGINT AS label, embedding::DOUBLE[] AS v FROM embeddings), u AS (SELECT label, i - 1 AS place, v[i] / (sqrt(list_sum(list_transform(v, lambda x: x * x))) + 1e-9) AS x FROM (SELECT *, unnest(range(1, len(v) + 1)) AS i FROM e)), m AS (SELECT label, place, avg(x) AS m FROM u GROUP BY 1, 2) SELECT label, place::BIGINT AS place, round(m / (sqrt(sum(m * m) OVER (PARTITION BY label)) + 1e-9), 6) AS value FROM m",
    "lookup_vote": f"WITH {_LK}, v AS (SELECT lookup_id, list_filter(votes, lambda b: b IS NOT NULL) AS a, coalesce(vote_rounds_dropped, 0) AS dropped, votes FROM lk) SELECT lookup_id, CASE WHEN len(a) > 0 THEN len(list_filter(a, lambda b: b)) * 2 > len(a) END AS found, CASE WHEN dropped = 0 AND len(a) > 1 THEN len(list_distinct(a)) = 1 END AS unanimous, CASE WHEN votes IS NULL THEN -1 ELSE len(a) END::BIGINT AS n_rounds FROM v",
    "rung_partition": f"WITH {_LK}, r AS (SELECT gen_model, {_RUNG} AS rung FROM lk), c AS (SELECT gen_model, " + ", ".join(f"count(*) FILTER (rung = '{r}')::BIGINT AS n_{r}" for r in recovery.RUNGS) + ", count(*)::BIGINT AS n FROM r GROUP BY 1) SELECT *, (n_node + n_sectionrest + n_othersection + n_unattributed)::DOUBLE / nullif(n - n_error, 0) AS located_share FROM c",
    "span_placement": _PLACE,
    "span_overlap": _OVERLAP,
    "claim_dedupe": f"WITH {_LK} SELECT min(lookup_id) AS lookup_id, count(*)::BIGINT AS n FROM lk GROUP BY question_id, claim, array_to_string(list_sort(node_id), ',')",
    "history_window": f"WITH {_TURN}, p AS (SELECT user_id, turn, sum(value) AS s FROM t GROUP BY 1, 2), u AS (SELECT *, sum(s) OVER w AS upto, row_number() OVER w AS age FROM p WINDOW w AS (PARTITION BY user_id ORDER BY turn DESC)), c AS (SELECT user_id, turn FROM u a WHERE age = 1 OR NOT EXISTS (SELECT 1 FROM u b WHERE b.user_id = a.user_id AND b.age > 1 AND b.age <= a.age AND b.upto > 100)) SELECT event_id, user_id, turn::BIGINT AS turn FROM t JOIN c USING (user_id, turn)",
    "history_prune": f"WITH {_TURN}, m AS (SELECT *, max(turn) OVER (PARTITION BY user_id) AS cur FROM t) SELECT event_id, turn::BIGINT AS turn, CASE WHEN turn < cur AND event_type = 'click' THEN '[left out]' WHEN turn < cur AND event_type = 'error' THEN '[failed]' ELSE props END AS props FROM m",
    "usage_rollup": f"WITH {_AN(['model', 'n_read', 'n_citations', 'max_tokens'])} SELECT x.model AS model, count(*)::BIGINT AS n, sum(x.n_read)::BIGINT AS sum_n_read, sum(x.n_citations)::BIGINT AS sum_n_citations, sum(x.max_tokens)::BIGINT AS sum_max_tokens FROM an GROUP BY 1",
    "truncation_count": f"WITH {_AN(['model', 'finish_reasons'])} SELECT regexp_replace(regexp_replace(x.model, '^.*[:/]', ''), '\\.', 'pt', 'g') AS model, count(*)::BIGINT AS n, count(*) FILTER (len(list_filter(x.finish_reasons, lambda r: lower(r) IN ('length', 'max_tokens'))) > 0)::BIGINT AS n_truncated FROM an GROUP BY 1",
    "retrieved_union": f"WITH {_AN(['question_id', 'read_set', 'retrieved_set'])} SELECT x.question_id AS question_id, count(DISTINCT d)::BIGINT AS n_docs, count(*)::BIGINT AS n_mentions FROM (SELECT x, unnest(list_concat(coalesce(x.read_set, []), coalesce(x.retrieved_set, []))) AS d FROM an) GROUP BY 1",
    "cache_hit_miss": f"WITH {_QS}, {_AN(['guideline_id', 'question'])}, r AS (SELECT DISTINCT sha256(coalesce(x.c, '') || chr(1) || coalesce(x.a, '')) AS key FROM qs), c AS (SELECT DISTINCT sha256(coalesce(x.guideline_id, '') || chr(1) || x.question) AS key FROM an WHERE x.question IS NOT NULL) SELECT key, CASE WHEN key IN (SELECT key FROM c) THEN 'hit' ELSE 'miss' END AS state FROM r",
    "resume_antijoin": f"WITH {_QS}, {_AN(['question_id'])} SELECT question_id, CASE WHEN question_id IN (SELECT x.question_id FROM an WHERE x.question_id IS NOT NULL) THEN 'reused' ELSE 'todo' END AS state FROM qs",
    "session_windows": "WITH g AS (SELECT *, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events), s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS w FROM g) SELECT user_id, epoch_us(min(ts)) AS start_us, count(*)::BIGINT AS n, round(sum(value), 4) AS value FROM s GROUP BY user_id, w",
}
