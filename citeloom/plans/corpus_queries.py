"""Queries about the corpus as retrieval units, what is shown to a model, and question sets; with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from citeloom.operators import citations, corpus, extract, tree
from citeloom.plans.citation_queries import sections_once
from citeloom.plans.tree_queries import _H, _N, _Q, _TU, _U, nodes_once, questions_once, unit_texts
from citeloom.session import sf_table

RULES = corpus.Exclusions(ids=("v0",), subtrees=("v1-c1", "v2-c2"), id_prefixes=("bib", "v3-c"), titles=("Contents", "References"))
SKIPPED = ("evidence", "monitoring")
BUDGETS = (4_000, 16_000, 128_000)


def rag_eligible(spark, sf_dir):
    """Eligibility by rules, beside the flag of the table."""
    return nodes_once(spark, sf_dir).select("guideline_id", "section_id", corpus.is_eligible(RULES).alias("by_rules"), "rag_eligible")


def node_roots(spark, sf_dir):
    return corpus.roots(nodes_once(spark, sf_dir)).select("guideline_id", "section_id", "title")


def ancestor_level_two(spark, sf_dir):
    return corpus.ancestor_at_level(nodes_once(spark, sf_dir), 2)


def chapter_labels(spark, sf_dir):
    return corpus.chapters_above(nodes_once(spark, sf_dir))


def target_units_chosen(spark, sf_dir):
    """Target units of the chapters whose title has none of some words."""
    return tree.target_units(nodes_once(spark, sf_dir), skipped=SKIPPED).select("guideline_id", "section_id", F.col("ord").cast("bigint").alias("ord"), "kind")


def corpus_sections(spark, sf_dir):
    return corpus.listed_sections(nodes_once(spark, sf_dir)).withColumn("subsections", F.array_join("subsections", " | "))


def scope_sections(spark, sf_dir):
    """The default guidelines are selected, the enabled ones requested."""
    registry = sf_table(spark, sf_dir, "guideline_registry")
    found = corpus.in_scope(corpus.listed_sections(nodes_once(spark, sf_dir)), registry.filter("is_default").select("guideline_id"), registry.filter("enabled").select("guideline_id"))
    return found.select("guideline_id", "section_number", "section_id")


def read_section(spark, sf_dir):
    """Cited sections by id, and the same places by their numbers."""
    nodes = nodes_once(spark, sf_dir)
    cited = sf_table(spark, sf_dir, "citations").filter("guideline_id is not null and section_id is not null").select("guideline_id", F.col("section_id").alias("asked")).distinct()
    numbers = sf_table(spark, sf_dir, "guideline_registry").select("guideline_id", F.explode(F.array(F.lit("1"), F.lit("02"), F.lit("999"), F.lit("x"))).alias("asked"))
    read = corpus.read_sections(cited.unionByName(numbers), corpus.listed_sections(nodes), tree.assemble(nodes, unit_texts(spark, sf_dir)))
    return read.select("guideline_id", "asked", "section_number", "section_id", "title", F.sha2("text", 256).alias("digest"))


def section_full_text(spark, sf_dir):
    """The assembled text of every cited section, whatever its level; null if there is none."""
    cited = sf_table(spark, sf_dir, "citations").select("guideline_id", "section_id").distinct()
    made = tree.assemble(nodes_once(spark, sf_dir), unit_texts(spark, sf_dir))
    return cited.join(made, ["guideline_id", "section_id"], "left").select("guideline_id", "section_id", F.length("text").cast("bigint").alias("n_chars"), F.sha2("text", 256).alias("digest"))


def candidate_pool(spark, sf_dir):
    """All units of level 3 and chapters without one, eligible or not, with their assembled text; '' where there is none."""
    nodes = nodes_once(spark, sf_dir)
    units = tree.target_units(nodes.withColumn("rag_eligible", F.lit(True)), left_out=())
    made = units.join(tree.assemble(nodes, unit_texts(spark, sf_dir)), ["guideline_id", "section_id"], "left").join(tree.breadcrumbs(nodes), ["guideline_id", "section_id"])
    return made.select(F.concat_ws(":", "guideline_id", "section_id").alias("doc_id"), "kind", "breadcrumb", F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest"))


def candidate_listing(spark, sf_dir):
    named = corpus.listed_sections(nodes_once(spark, sf_dir)).join(sf_table(spark, sf_dir, "guideline_registry").select("guideline_id", "guideline_name"), "guideline_id")
    line = corpus.listing_line(F.concat_ws(":", "guideline_id", "section_id"), F.concat_ws(" › ", "guideline_name", "title"), F.col("summary"))
    return named.select("guideline_id", "section_number", line.alias("line"))


def _reads(spark, sf_dir):
    return citations.latest(sf_table(spark, sf_dir, "answers"), "answer_id", ["read_set"])


def frozen_context(spark, sf_dir):
    titled = sections_once(spark, sf_dir).withColumn("title", F.concat(F.lit("Section "), F.substring_index("doc_id", ":", -1)))
    packed = corpus.frozen(_reads(spark, sf_dir), "answer_id", titled)
    return packed.select("answer_id", F.size("sections").cast("bigint").alias("n_sections"), F.sha2(corpus.prompt(F.col("sections")), 256).alias("digest"))


def evidence_blob(spark, sf_dir):
    """The evidence of every lookup, with a bound that some of it passes."""
    from citeloom.plans.retrieval_queries import lookups_once

    made = corpus.evidence(lookups_once(spark, sf_dir).select("lookup_id", "read_set"), "lookup_id", sections_once(spark, sf_dir), most=20_000)
    return made.select("lookup_id", F.length("evidence").cast("bigint").alias("n_chars"), F.sha2("evidence", 256).alias("digest"), "truncated")


def retrieved_order(spark, sf_dir):
    """What an answer read and then retrieved, each document once, in order."""
    a = citations.latest(sf_table(spark, sf_dir, "answers"), "answer_id", ["read_set", "retrieved_set"])
    both = F.array_distinct(F.concat(F.coalesce("read_set", F.array().cast("array<string>")), F.coalesce("retrieved_set", F.array().cast("array<string>"))))
    return a.select("answer_id", F.array_join(both, " ").alias("doc_ids"))


def question_set(spark, sf_dir):
    """Questions of units with enough text, at most one of each unit and style, in order, the first 50 (a question set of stated size)."""
    q = questions_once(spark, sf_dir).filter("source.char_count >= 400").select("question_id", "guideline_id", F.col("source.node_id").alias("node_id"), "question_style")
    return corpus.limited(corpus.capped_per_node(q, ["guideline_id", "node_id", "question_style"], ["question_id"], 1), ["question_id"], 50)


def search_selection(spark, sf_dir):
    """Retrieved ids that are candidates of the answer's guideline; a null selection is a failed search and gives all of them."""
    a = citations.latest(sf_table(spark, sf_dir, "answers"), "answer_id", ["guideline_id", "retrieved_set"])
    pool = citations.latest(sf_table(spark, sf_dir, "candidate_units"), "doc_id", ["guideline_id"]).groupBy("guideline_id").agg(F.array_sort(F.collect_list("doc_id")).alias("pool"))
    both = a.join(pool, "guideline_id", "left").withColumn("pool", F.coalesce("pool", F.array().cast("array<string>")))
    return both.select("answer_id", F.array_join(corpus.searched(F.col("retrieved_set"), F.col("pool")), " ").alias("selected"))


def summary_budgets(spark, sf_dir):
    """Every unit text under the budgets of some models."""
    t = unit_texts(spark, sf_dir)
    out = None
    for tokens in BUDGETS:
        b = corpus.text_budgets(tokens)
        one = t.select("guideline_id", "section_id", F.lit(tokens).cast("bigint").alias("tokens"), F.length(tree.shortened(F.col("text"), b["full"])).cast("bigint").alias("n_chars"))
        out = one if out is None else out.unionByName(one)
    return out


def resource_sorting(spark, sf_dir):
    """Resources of each guideline in their natural order."""
    from pyspark.sql import Window

    owned = tree.resource_owners(nodes_once(spark, sf_dir)).select("guideline_id", "kind", "resource_id")
    order = Window.partitionBy("guideline_id", "kind").orderBy(*extract.natural_order(F.col("resource_id")))
    return owned.withColumn("place", F.row_number().over(order).cast("bigint"))


def kept_texts(spark, sf_dir):
    """Section texts with their line break, null under a floor of 600 characters."""
    kept = extract.kept_text(F.col("text"), 600)
    return unit_texts(spark, sf_dir).select("guideline_id", "section_id", F.coalesce(F.length(kept), F.lit(0)).cast("bigint").alias("content_length"), kept.isNotNull().alias("has_text"))


def _markup(spark, sf_dir):
    """A page for each guideline, made of its nodes: sections nested as in the tree, with a heading, the summary and links to their tables."""
    n = nodes_once(spark, sf_dir)
    escape = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    head = F.concat(F.lit("<h2>"), F.coalesce(F.concat("number", F.lit(". ")), F.lit("")), escape(F.coalesce("title", F.lit(""))), F.lit("</h2><p>"), escape(F.coalesce("summary", F.lit(""))), F.lit("</p>"))
    links = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(2)), lambda i: F.concat(F.lit('<p>see <a href="t'), (F.col("ord") * 2 + i).cast("string"), F.lit('.xhtml">it</a></p>'))), "")
    opened = n.select("guideline_id", "ord", "level", F.concat(F.lit('<section id="'), "section_id", F.lit('">'), head, links).alias("open"))
    # Before a section opens, those that are not above it close.
    from pyspark.sql import Window

    before = F.coalesce(F.lag("level").over(Window.partitionBy("guideline_id").orderBy("ord")), F.lit(0))
    closed = opened.withColumn("open", F.concat(F.repeat(F.lit("</section>"), F.greatest(before - F.col("level") + 1, F.lit(0))), "open"))
    pages = closed.groupBy("guideline_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "open"))), lambda x: x["open"]), "\n").alias("body"))
    return pages.select(F.col("guideline_id").alias("path"), F.concat(F.lit("<html><body>"), "body", F.lit("</body></html>")).alias("value"))


def extracted_sections(spark, sf_dir):
    """The tree extracted from pages that were made of the tree: a round trip through the markup."""
    found = extract.with_children(extract.markup_sections(_markup(spark, sf_dir)))
    return found.select(F.col("source").alias("guideline_id"), F.col("ord").cast("bigint").alias("ord"), "section_id", "number", "title", F.col("level").cast("bigint").alias("level"), "parent_id", F.array_join("path", "/").alias("path"), F.array_join("children", "/").alias("children"), F.array_join("tables", "/").alias("tables"), F.regexp_replace("text", r"\s+", " ").alias("text"))


def resolved_placeholders(spark, sf_dir):
    """Summaries with placeholders for the tables of their section, resolved where the table has a caption."""
    n = nodes_once(spark, sf_dir)
    marks = F.array_join(F.transform("tables", lambda t: F.concat(F.lit(" [[table:"), t, F.lit("]]"))), "")
    texts = n.select(F.concat_ws(":", "guideline_id", "section_id").alias("text_id"), F.concat(F.coalesce("summary", F.lit("")), marks).alias("text"))
    known = tree.resource_owners(n).filter("kind = 'table'").groupBy("resource_id", "kind").agg(F.min("primary_section").alias("caption")).filter("resource_id not like '%1'")
    resources = known.select("resource_id", "kind", F.concat(F.lit("Table of "), "caption").alias("caption"), F.lit(None).cast("string").alias("markdown"), F.lit("described").alias("description"))
    return tree.placeholders(texts, resources).select("text_id", "text")


_RULE = "NOT (section_id IN ('v0') OR list_has_any(path, ['v1-c1', 'v2-c2']) OR starts_with(section_id, 'bib') OR starts_with(section_id, 'v3-c') OR coalesce(title IN ('Contents', 'References'), false))"
_LAB = "coalesce(number || '. ', '') || title"
_CA = f"""ca0 AS (SELECT ap.guideline_id, ap.section_id, arg_min({_LAB.replace('number', 'c.number').replace('title', 'c.title')}, ap.depth) AS chapter_label, arg_min(ap.ancestor_id, ap.depth) FILTER (c.section_type = 'chapter') AS above_id FROM ap JOIN n c ON c.guideline_id = ap.guideline_id AND c.section_id = ap.ancestor_id WHERE c.level = 2 AND ap.ancestor_id <> ap.section_id GROUP BY 1, 2),
ca AS (SELECT n.guideline_id, n.section_id, ca0.chapter_label, CASE WHEN n.section_type = 'chapter' THEN n.section_id ELSE ca0.above_id END AS chapter_id FROM n LEFT JOIN ca0 USING (guideline_id, section_id))"""
_LS = f"""{_CA}, un AS (SELECT * FROM n WHERE rag_eligible AND level = 3), ex AS (SELECT * FROM n WHERE rag_eligible AND section_type = 'chapter' AND (text_file IS NOT NULL OR len(children) > 0) AND (guideline_id, section_id) NOT IN (SELECT (un.guideline_id, ca.chapter_id) FROM un JOIN ca USING (guideline_id, section_id) WHERE ca.chapter_id IS NOT NULL)),
al AS (SELECT *, (row_number() OVER (PARTITION BY guideline_id ORDER BY ord, section_id))::BIGINT AS section_number FROM (SELECT * FROM un UNION ALL SELECT * FROM ex)),
ls AS (SELECT al.guideline_id, al.section_number, al.section_id, coalesce(al.number || '. ', '') || al.title || CASE WHEN al.level > 2 THEN coalesce(' < ' || ca.chapter_label, '') ELSE '' END AS title, coalesce(al.summary, '') AS summary, array_to_string(list_filter(list_transform(al.children, lambda c: (SELECT k.title FROM n k WHERE k.guideline_id = al.guideline_id AND k.section_id = c AND k.rag_eligible)), lambda t: t IS NOT NULL), ' | ') AS subsections FROM al LEFT JOIN ca USING (guideline_id, section_id))"""
_LS_PLAIN = _LS[: _LS.rindex(", array_to_string(list_filter(")] + " FROM al LEFT JOIN ca USING (guideline_id, section_id))"
_KIDS = "kd AS (SELECT al.guideline_id, al.section_id, string_agg(k.title, ' | ' ORDER BY c.i) AS subsections FROM (SELECT guideline_id, section_id, children, unnest(range(1, len(children) + 1)) AS i FROM al) c JOIN al USING (guideline_id, section_id) JOIN n k ON k.guideline_id = c.guideline_id AND k.section_id = c.children[c.i] AND k.rag_eligible GROUP BY 1, 2)"
_ASM = f"p AS (SELECT n.guideline_id, n.section_id, n.ord, concat_ws(chr(10), {_H}, trim(u.text, ' '), '') AS part FROM n LEFT JOIN u USING (guideline_id, section_id)), m AS (SELECT ap.guideline_id, ap.ancestor_id AS section_id, string_agg(p.part, chr(10) ORDER BY p.ord, p.part) AS text FROM ap JOIN p USING (guideline_id, section_id) GROUP BY 1, 2)"
_SEC = "ss AS (SELECT doc_id, (arg_max({t: text}, loaded_at)).t AS text FROM candidate_units GROUP BY 1)"
_AR = lambda cols: "an AS (SELECT answer_id, arg_max({" + ", ".join(f"{c}: {c}" for c in cols) + "}, loaded_at) AS x FROM answers GROUP BY 1)"
_BUDGET = " UNION ALL ".join(
    f"SELECT guideline_id, section_id, {t}::BIGINT AS tokens, (CASE WHEN text IS NULL THEN NULL WHEN length(text) <= {b['full']} THEN length(text) WHEN length(text) <= {2 * b['full']} THEN least(length(text), {b['head']}) + {len('..[... content truncated for summary generation ...]')} ELSE {b['long_head']} + {b['long_tail']} + {len('..[... middle content truncated ...]..')} END)::BIGINT AS n_chars FROM u"
    for t, b in ((t, corpus.text_budgets(t)) for t in BUDGETS)
)

QUERIES = {f.__name__: f for f in (rag_eligible, node_roots, ancestor_level_two, chapter_labels, target_units_chosen, corpus_sections, scope_sections, read_section, section_full_text, candidate_pool, candidate_listing, frozen_context, evidence_blob, retrieved_order, question_set, search_selection, summary_budgets, resource_sorting, kept_texts, extracted_sections, resolved_placeholders)}

_CHOSEN = _TU.replace("c.rag_eligible UNION", "c.rag_eligible AND NOT (contains(lower(c.title), 'evidence') OR contains(lower(c.title), 'monitoring')) UNION").replace("AND rag_eligible AND NOT EXISTS", "AND rag_eligible AND NOT (contains(lower(title), 'evidence') OR contains(lower(title), 'monitoring')) AND NOT EXISTS")
_POOLED = "tp AS (SELECT DISTINCT d.guideline_id, d.section_id, 'unit' AS kind FROM n d JOIN n c ON c.guideline_id = d.guideline_id AND list_contains(d.path, c.section_id) WHERE d.level = 3 AND c.level = 2 AND c.section_type = 'chapter' UNION ALL SELECT guideline_id, section_id, 'chapter' FROM n c WHERE level = 2 AND section_type = 'chapter' AND NOT EXISTS (SELECT 1 FROM n d WHERE d.level = 3 AND d.guideline_id = c.guideline_id AND list_contains(d.path, c.section_id)))"
_TIDY = "trim(regexp_replace({}, '\\s+', ' ', 'g'))"

ORACLE_SQL = {
    "rag_eligible": f"WITH {_N} SELECT guideline_id, section_id, {_RULE} AS by_rules, rag_eligible FROM n",
    "node_roots": f"WITH {_N} SELECT guideline_id, section_id, title FROM n WHERE parent_id IS NULL",
    "ancestor_level_two": f"WITH {_N} SELECT n.guideline_id, n.section_id, coalesce(x.a, '') AS ancestor_id FROM n LEFT JOIN (SELECT ap.guideline_id, ap.section_id, arg_min(ap.ancestor_id, ap.depth) AS a FROM ap JOIN n c ON c.guideline_id = ap.guideline_id AND c.section_id = ap.ancestor_id WHERE c.level = 2 GROUP BY 1, 2) x USING (guideline_id, section_id)",
    "chapter_labels": f"WITH {_N}, {_CA} SELECT * FROM ca",
    "target_units_chosen": f"WITH {_N}, {_CHOSEN} SELECT guideline_id, section_id, ord, kind FROM tu",
    "corpus_sections": f"WITH {_N}, {_LS_PLAIN}, {_KIDS} SELECT ls.guideline_id, ls.section_number, ls.section_id, ls.title, ls.summary, coalesce(kd.subsections, '') AS subsections FROM ls LEFT JOIN kd USING (guideline_id, section_id)",
    "scope_sections": f"WITH {_N}, {_LS_PLAIN}, w AS (SELECT guideline_id FROM guideline_registry WHERE enabled AND (is_default OR NOT EXISTS (SELECT 1 FROM guideline_registry WHERE is_default))) SELECT guideline_id, section_number, section_id FROM ls WHERE guideline_id IN (SELECT guideline_id FROM w)",
    "read_section": f"WITH {_N}, {_U}, {_LS_PLAIN}, {_ASM}, r AS (SELECT DISTINCT guideline_id, section_id AS asked FROM citations WHERE guideline_id IS NOT NULL AND section_id IS NOT NULL UNION ALL SELECT guideline_id, unnest(['1', '02', '999', 'x']) FROM guideline_registry) SELECT r.guideline_id, r.asked, ls.section_number, ls.section_id, ls.title, sha256(m.text) AS digest FROM r LEFT JOIN ls ON ls.guideline_id = r.guideline_id AND CASE WHEN regexp_full_match(r.asked, '[0-9]+') THEN ls.section_number = try_cast(r.asked AS BIGINT) ELSE ls.section_id = r.asked END LEFT JOIN m ON m.guideline_id = ls.guideline_id AND m.section_id = ls.section_id",
    "section_full_text": f"WITH {_N}, {_U}, {_ASM}, c AS (SELECT DISTINCT guideline_id, section_id FROM citations) SELECT c.guideline_id, c.section_id, length(m.text)::BIGINT AS n_chars, sha256(m.text) AS digest FROM c LEFT JOIN m USING (guideline_id, section_id)",
    "candidate_pool": f"WITH {_N}, {_U}, {_ASM}, {_POOLED}, b AS (SELECT ap.guideline_id, ap.section_id, string_agg(a.title, ' > ' ORDER BY ap.depth) AS t FROM ap JOIN n a ON a.guideline_id = ap.guideline_id AND a.section_id = ap.ancestor_id WHERE a.section_type <> 'root' GROUP BY 1, 2) SELECT tp.guideline_id || ':' || tp.section_id AS doc_id, tp.kind, coalesce(b.t, '') AS breadcrumb, sha256(coalesce(m.text, '')) AS digest FROM tp LEFT JOIN m USING (guideline_id, section_id) LEFT JOIN b USING (guideline_id, section_id)",
    "candidate_listing": f"WITH {_N}, {_LS_PLAIN} SELECT ls.guideline_id, ls.section_number, '[' || ls.guideline_id || ':' || ls.section_id || '] ' || r.guideline_name || ' › ' || ls.title || ' — ' || CASE WHEN ls.summary = '' THEN '(no summary)' ELSE ls.summary END AS line FROM ls JOIN guideline_registry r USING (guideline_id)",
    "frozen_context": f"WITH {_SEC}, {_AR(['read_set'])}, e AS (SELECT answer_id, i, x.read_set[i] AS doc_id FROM (SELECT answer_id, x, unnest(range(1, len(x.read_set) + 1)) AS i FROM an)) SELECT e.answer_id, count(*)::BIGINT AS n_sections, sha256(string_agg('[' || e.doc_id || '] Section ' || split_part(e.doc_id, ':', -1) || chr(10) || coalesce(ss.text, ''), chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY e.i)) AS digest FROM e JOIN ss USING (doc_id) GROUP BY 1",
    "evidence_blob": f"WITH {_SEC}, lk AS (SELECT x.* FROM (SELECT arg_max(l, loaded_at) AS x FROM readset_lookups l GROUP BY lookup_id)), e AS (SELECT lookup_id, i, read_set[i] AS doc_id FROM (SELECT *, unnest(range(1, len(read_set) + 1)) AS i FROM lk)), b AS (SELECT e.lookup_id, string_agg('[' || e.doc_id || ']' || chr(10) || ss.text, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY e.i) AS t FROM e JOIN ss USING (doc_id) WHERE length(ss.text) > 0 GROUP BY 1) SELECT lk.lookup_id, length(left(coalesce(b.t, ''), 20000))::BIGINT AS n_chars, sha256(left(coalesce(b.t, ''), 20000)) AS digest, length(coalesce(b.t, '')) > 20000 AS truncated FROM lk LEFT JOIN b USING (lookup_id)",
    "retrieved_order": f"WITH {_AR(['read_set', 'retrieved_set'])}, e AS (SELECT answer_id, list_concat(coalesce(x.read_set, []), coalesce(x.retrieved_set, [])) AS l FROM an), f AS (SELECT answer_id, l[i] AS d, min(i) AS i FROM (SELECT *, unnest(range(1, len(l) + 1)) AS i FROM e) GROUP BY 1, 2) SELECT e.answer_id, coalesce((SELECT string_agg(f.d, ' ' ORDER BY f.i) FROM f WHERE f.answer_id = e.answer_id), '') AS doc_ids FROM e",
    "question_set": f"WITH {_Q}, y AS (SELECT question_id, x.c AS guideline_id, x.d.node_id AS node_id, x.b AS question_style, row_number() OVER (PARTITION BY x.c, x.d.node_id, x.b ORDER BY question_id) AS r FROM q WHERE x.d.char_count >= 400) SELECT question_id, guideline_id, node_id, question_style FROM y WHERE r = 1 ORDER BY question_id LIMIT 50",
    "search_selection": f"WITH {_AR(['guideline_id', 'retrieved_set'])}, po AS (SELECT g AS guideline_id, list(doc_id ORDER BY doc_id) AS pool FROM (SELECT doc_id, arg_max(guideline_id, loaded_at) AS g FROM candidate_units WHERE doc_id IS NOT NULL GROUP BY 1) GROUP BY 1), b AS (SELECT answer_id, x.retrieved_set AS s, coalesce(po.pool, []) AS pool FROM an LEFT JOIN po ON po.guideline_id = x.guideline_id), f AS (SELECT answer_id, s[i] AS d, min(i) AS i FROM (SELECT *, unnest(range(1, len(s) + 1)) AS i FROM b WHERE s IS NOT NULL) WHERE list_contains(pool, s[i]) GROUP BY 1, 2) SELECT b.answer_id, CASE WHEN s IS NULL THEN array_to_string(pool, ' ') ELSE coalesce((SELECT string_agg(f.d, ' ' ORDER BY f.i) FROM f WHERE f.answer_id = b.answer_id), '') END AS selected FROM b",
    "summary_budgets": f"WITH {_U} {_BUDGET}",
    "resource_sorting": f"WITH {_N}, e AS (SELECT DISTINCT guideline_id, resource_id, kind FROM (SELECT guideline_id, unnest(figures) AS resource_id, 'figure' AS kind FROM n UNION ALL SELECT guideline_id, unnest(tables), 'table' FROM n)) SELECT guideline_id, kind, resource_id, (row_number() OVER (PARTITION BY guideline_id, kind ORDER BY regexp_extract(resource_id, '^([^0-9]*)', 1), try_cast(regexp_extract(resource_id, '([0-9]+)', 1) AS BIGINT) NULLS FIRST, resource_id))::BIGINT AS place FROM e",
    "kept_texts": f"WITH {_U}, k AS (SELECT *, length(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) AS c FROM u) SELECT guideline_id, section_id, (CASE WHEN c >= 600 THEN c + 1 ELSE 0 END)::BIGINT AS content_length, coalesce(c >= 600, false) AS has_text FROM k",
    "extracted_sections": f"WITH {_N} SELECT n.guideline_id, n.ord::BIGINT AS ord, n.section_id, n.number, n.title, n.level::BIGINT AS level, n.parent_id, array_to_string(n.path, '/') AS path, coalesce((SELECT string_agg(k.section_id, '/' ORDER BY k.ord) FROM n k WHERE k.guideline_id = n.guideline_id AND k.parent_id = n.section_id), '') AS children, 't' || (n.ord * 2 + 1)::VARCHAR || '/t' || (n.ord * 2 + 2)::VARCHAR AS tables, {_TIDY.format("coalesce(n.summary, '')" + " || ' see [[table:t' || (n.ord * 2 + 1)::VARCHAR || ']] see [[table:t' || (n.ord * 2 + 2)::VARCHAR || ']]'")} AS text FROM n",
    "resolved_placeholders": f"WITH {_N}, rs AS (SELECT t AS resource_id, min(section_id) AS caption FROM (SELECT guideline_id, t, arg_min(section_id, ord) AS section_id FROM (SELECT guideline_id, ord, section_id, unnest(tables) AS t FROM n) GROUP BY 1, 2) WHERE t NOT LIKE '%1' GROUP BY 1), e AS (SELECT guideline_id, section_id, i, tables[i] AS t FROM (SELECT *, unnest(range(1, len(tables) + 1)) AS i FROM n)), f AS (SELECT guideline_id, section_id, string_agg(CASE WHEN rs.caption IS NULL THEN ' [[table:' || t || ']]' ELSE ' [TABLE ' || t || '] Table of ' || rs.caption || chr(10) || 'described' END, '' ORDER BY i) AS x FROM e LEFT JOIN rs ON rs.resource_id = e.t GROUP BY 1, 2) SELECT n.guideline_id || ':' || n.section_id AS text_id, coalesce(n.summary, '') || coalesce(f.x, '') AS text FROM n LEFT JOIN f USING (guideline_id, section_id)",
}
