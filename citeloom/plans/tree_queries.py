"""Queries about section trees and questions, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from citeloom.operators import citations, tree
from citeloom.session import sf_table


def nodes_once(spark, sf_dir):
    return tree.unique_nodes(sf_table(spark, sf_dir, "section_nodes"))


def unit_texts(spark, sf_dir):
    return citations.latest(sf_table(spark, sf_dir, "candidate_units"), "doc_id", ["guideline_id", "node_id", "text"]).select("guideline_id", F.col("node_id").alias("section_id"), "text")


def questions_once(spark, sf_dir):
    q = sf_table(spark, sf_dir, "questions")
    return q.groupBy("question_id").agg(F.max(F.struct("question", "question_style", "guideline_id", "source")).alias("x")).select("question_id", "x.*")


def section_breadcrumb(spark, sf_dir):
    return tree.breadcrumbs(nodes_once(spark, sf_dir))


def subtree_totals(spark, sf_dir):
    return tree.subtree_totals(nodes_once(spark, sf_dir))


def chapter_of_section(spark, sf_dir):
    return tree.chapter_of(nodes_once(spark, sf_dir))


def target_units(spark, sf_dir):
    return tree.target_units(nodes_once(spark, sf_dir)).select("guideline_id", "section_id", F.col("ord").cast("bigint").alias("ord"), "kind")


def section_numbering(spark, sf_dir):
    return tree.numbered(tree.target_units(nodes_once(spark, sf_dir))).select("guideline_id", "section_id", "section_number")


def heading_lines(spark, sf_dir):
    return nodes_once(spark, sf_dir).select("guideline_id", "section_id", tree.heading(F.col("level"), F.col("number"), F.col("title")).alias("heading"))


def subtree_assemble(spark, sf_dir):
    made = tree.assemble(nodes_once(spark, sf_dir), unit_texts(spark, sf_dir))
    return made.select("guideline_id", "section_id", F.length("text").cast("bigint").alias("n_chars"), F.sha2("text", 256).alias("digest"))


def strided_sample(spark, sf_dir):
    return tree.strided(nodes_once(spark, sf_dir).filter("level = 3"), "guideline_id", ["ord", "section_id"], 4).select("guideline_id", "section_id", F.col("place").cast("bigint").alias("place"))


def resource_owners(spark, sf_dir):
    return tree.resource_owners(nodes_once(spark, sf_dir))


def content_length_check(spark, sf_dir):
    """Announced against real lengths; a length that was not announced is counted by itself."""
    both = nodes_once(spark, sf_dir).select("guideline_id", "section_id", "content_length").join(unit_texts(spark, sf_dir), ["guideline_id", "section_id"])
    real = F.length("text")
    return both.groupBy("guideline_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("content_length").isNull()).alias("n_unannounced"), F.count_if(F.col("content_length") != real).alias("n_differing"), F.sum(real.cast("bigint")).alias("n_chars"))


def extract_summary(spark, sf_dir):
    """Histograms by level and by type, and the total, in one pass of grouping sets."""
    n = nodes_once(spark, sf_dir)
    out = n.groupingSets([["level"], ["section_type"], []], "level", "section_type").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("text_file").isNotNull()).alias("n_with_text"), F.count_if(F.size("figures") + F.size("tables") > 1).alias("n_many_resources"))
    return out.select(F.coalesce(F.col("level").cast("string"), F.lit("*")).alias("level"), F.coalesce("section_type", F.lit("*")).alias("section_type"), "n", "n_with_text", "n_many_resources")


def questions_by_source(spark, sf_dir):
    q = questions_once(spark, sf_dir).select("guideline_id", "question_style", F.col("source.chapter_id").alias("chapter_id"), F.col("source.char_count").cast("bigint").alias("chars"), F.col("source.subtopic_id").alias("subtopic_id"))
    return q.groupBy("guideline_id", "question_style").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("chapter_id").alias("n_chapters"), F.count_if(F.col("subtopic_id").isNull()).alias("n_without_subtopic"), F.sum("chars").alias("chars"))


def childless_chapters(spark, sf_dir):
    return tree.target_units(nodes_once(spark, sf_dir)).filter("kind = 'chapter'").select("guideline_id", "section_id")


def section_classify(spark, sf_dir):
    n = nodes_once(spark, sf_dir)
    kind = tree.section_kind(F.col("section_id"), F.col("path"), F.size("children") > 0, F.col("text_file").isNotNull())
    return n.select("guideline_id", "section_id", kind.alias("kind"))


def section_shortened(spark, sf_dir):
    t = unit_texts(spark, sf_dir)
    return t.select("guideline_id", "section_id", F.sha2(tree.shortened(F.col("text"), 800), 256).alias("digest"), tree.capped_summary(F.col("text")).alias("capped"))


def link_extract(spark, sf_dir):
    """Anchors of pages with their place, address and text."""
    pattern = '<a href="([^"]+)">([^<]*)</a>'
    d = sf_table(spark, sf_dir, "documents")
    pairs = F.arrays_zip(F.regexp_extract_all("text", F.lit(pattern), F.lit(1)).alias("href"), F.regexp_extract_all("text", F.lit(pattern), F.lit(2)).alias("label"))
    return d.select("doc_id", F.posexplode(pairs).alias("place", "x")).select("doc_id", F.col("place").cast("bigint").alias("place"), F.col("x.href").alias("href"), F.col("x.label").alias("label"))


_N = "n AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY guideline_id, section_id ORDER BY ord) AS q_ FROM section_nodes) WHERE q_ = 1), ap AS (SELECT guideline_id, section_id, path[i] AS ancestor_id, i AS depth FROM (SELECT *, unnest(range(1, len(path) + 1)) AS i FROM n))"
_U = "u AS (SELECT x.guideline_id AS guideline_id, x.node_id AS section_id, x.text AS text FROM (SELECT arg_max({guideline_id: guideline_id, node_id: node_id, text: text}, loaded_at) AS x FROM candidate_units WHERE doc_id IS NOT NULL GROUP BY doc_id))"
_TU = "tu AS (SELECT DISTINCT d.guideline_id, d.section_id, d.ord::BIGINT AS ord, 'unit' AS kind FROM n d JOIN n c ON c.guideline_id = d.guideline_id AND list_contains(d.path, c.section_id) WHERE d.level = 3 AND d.section_type <> 'abstract' AND d.rag_eligible AND c.level = 2 AND c.section_type = 'chapter' AND c.rag_eligible UNION ALL SELECT guideline_id, section_id, ord::BIGINT, 'chapter' FROM n c WHERE level = 2 AND section_type = 'chapter' AND rag_eligible AND NOT EXISTS (SELECT 1 FROM n d WHERE d.level = 3 AND d.section_type <> 'abstract' AND d.rag_eligible AND d.guideline_id = c.guideline_id AND list_contains(d.path, c.section_id)))"
_H = "concat_ws(' ', repeat('#', least(level, 6)), number || '.', title)"
_Q = "q AS (SELECT question_id, max({a: question, b: question_style, c: guideline_id, d: source}) AS x FROM questions GROUP BY 1)"

QUERIES = {f.__name__: f for f in (section_breadcrumb, subtree_totals, chapter_of_section, target_units, section_numbering, heading_lines, subtree_assemble, strided_sample, resource_owners, content_length_check, extract_summary, questions_by_source, childless_chapters, section_classify, section_shortened, link_extract)}

ORACLE_SQL = {
    "section_breadcrumb": f"WITH {_N} SELECT n.guideline_id, n.section_id, coalesce(b.t, '') AS breadcrumb FROM n LEFT JOIN (SELECT ap.guideline_id, ap.section_id, string_agg(a.title, ' > ' ORDER BY ap.depth) AS t FROM ap JOIN n a ON a.guideline_id = ap.guideline_id AND a.section_id = ap.ancestor_id WHERE a.section_type <> 'root' GROUP BY 1, 2) b USING (guideline_id, section_id)",
    "subtree_totals": f"WITH {_N} SELECT ap.guideline_id, ap.ancestor_id AS section_id, count(*)::BIGINT AS n_nodes, sum(coalesce(n.content_length, 0))::BIGINT AS n_chars, max(n.level)::BIGINT AS deepest FROM ap JOIN n USING (guideline_id, section_id) GROUP BY 1, 2",
    "chapter_of_section": f"WITH {_N} SELECT n.guideline_id, n.section_id, coalesce(c.id, '') AS chapter_id FROM n LEFT JOIN (SELECT ap.guideline_id, ap.section_id, arg_min(ap.ancestor_id, ap.depth) AS id FROM ap JOIN n a ON a.guideline_id = ap.guideline_id AND a.section_id = ap.ancestor_id WHERE a.section_type = 'chapter' GROUP BY 1, 2) c USING (guideline_id, section_id)",
    "target_units": f"WITH {_N}, {_TU} SELECT guideline_id, section_id, ord, kind FROM tu",
    "section_numbering": f"WITH {_N}, {_TU} SELECT guideline_id, section_id, row_number() OVER (PARTITION BY guideline_id ORDER BY ord, section_id)::BIGINT AS section_number FROM tu",
    "heading_lines": f"WITH {_N} SELECT guideline_id, section_id, {_H} AS heading FROM n",
    "subtree_assemble": f"WITH {_N}, {_U}, p AS (SELECT n.guideline_id, n.section_id, n.ord, concat_ws(chr(10), {_H}, trim(u.text, ' '), '') AS part FROM n LEFT JOIN u USING (guideline_id, section_id)), m AS (SELECT ap.guideline_id, ap.ancestor_id AS section_id, string_agg(p.part, chr(10) ORDER BY p.ord, p.part) AS text FROM ap JOIN p USING (guideline_id, section_id) GROUP BY 1, 2) SELECT guideline_id, section_id, length(text)::BIGINT AS n_chars, sha256(text) AS digest FROM m",
    "strided_sample": f"WITH {_N}, w AS (SELECT guideline_id, section_id, row_number() OVER (PARTITION BY guideline_id ORDER BY ord, section_id) - 1 AS place, count(*) OVER (PARTITION BY guideline_id) AS c FROM n WHERE level = 3) SELECT guideline_id, section_id, place::BIGINT AS place FROM w WHERE c <= 4 OR place IN (SELECT round_even(i * (w.c - 1) / 3.0, 0)::BIGINT FROM range(0, 4) r(i))",
    "resource_owners": f"WITH {_N}, e AS (SELECT guideline_id, ord, section_id, unnest(figures) AS resource_id, 'figure' AS kind FROM n UNION ALL SELECT guideline_id, ord, section_id, unnest(tables), 'table' FROM n), d AS (SELECT DISTINCT * FROM e) SELECT guideline_id, resource_id, kind, arg_min(section_id, ord) AS primary_section, string_agg(section_id, ',' ORDER BY ord, section_id) AS sections FROM d GROUP BY 1, 2, 3",
    "content_length_check": f"WITH {_N}, {_U} SELECT guideline_id, count(*)::BIGINT AS n, count(*) FILTER (content_length IS NULL)::BIGINT AS n_unannounced, count(*) FILTER (content_length <> length(text))::BIGINT AS n_differing, sum(length(text))::BIGINT AS n_chars FROM n JOIN u USING (guideline_id, section_id) GROUP BY 1",
    "extract_summary": f"WITH {_N} SELECT coalesce(level::VARCHAR, '*') AS level, coalesce(section_type, '*') AS section_type, count(*)::BIGINT AS n, count(text_file)::BIGINT AS n_with_text, count(*) FILTER (len(figures) + len(tables) > 1)::BIGINT AS n_many_resources FROM n GROUP BY GROUPING SETS ((level), (section_type), ())",
    "questions_by_source": f"WITH {_Q} SELECT x.c AS guideline_id, x.b AS question_style, count(*)::BIGINT AS n, count(DISTINCT x.d.chapter_id)::BIGINT AS n_chapters, count(*) FILTER (x.d.subtopic_id IS NULL)::BIGINT AS n_without_subtopic, sum(x.d.char_count)::BIGINT AS chars FROM q GROUP BY 1, 2",
    "childless_chapters": f"WITH {_N}, {_TU} SELECT guideline_id, section_id FROM tu WHERE kind = 'chapter'",
    "section_classify": f"WITH {_N} SELECT guideline_id, section_id, CASE WHEN len(path) = 0 OR section_id IN ('frontmatter', 'bodymatter', 'backmatter') THEN 'root' WHEN starts_with(section_id, 'bibliography') THEN 'bibliography' WHEN starts_with(section_id, 'appendix') THEN 'appendix' WHEN section_id IN ('affiliations', 'article-information') THEN 'metadata' WHEN starts_with(section_id, 'abs') THEN 'abstract' WHEN len(path) <= 2 THEN 'chapter' WHEN len(children) > 0 AND text_file IS NULL THEN 'container' ELSE 'subsection' END AS kind FROM n",
    "section_shortened": f"WITH {_U}, c AS (SELECT *, trim(trim(text, ' '), '\"'' ') AS k FROM u), w AS (SELECT *, left(k, 497) AS head, regexp_extract(left(k, 497), '(?s)^(.*) [^ ]*$', 1) AS word FROM c) SELECT guideline_id, section_id, sha256(CASE WHEN length(text) <= 800 THEN text WHEN length(text) <= 1600 THEN left(text, 760) || chr(10) || chr(10) || '[... content truncated for summary generation ...]' ELSE left(text, 400) || chr(10) || chr(10) || '[... middle content truncated ...]' || chr(10) || chr(10) || right(text, 200) END) AS digest, CASE WHEN length(k) <= 500 THEN k WHEN length(word) > 400 THEN word || '…' ELSE head || '…' END AS capped FROM w",
    "link_extract": "WITH l AS (SELECT doc_id, regexp_extract_all(text, '<a href=\"([^\"]+)\">([^<]*)</a>', 1) AS h, regexp_extract_all(text, '<a href=\"([^\"]+)\">([^<]*)</a>', 2) AS t FROM documents) SELECT doc_id, (i - 1)::BIGINT AS place, h[i] AS href, t[i] AS label FROM (SELECT *, unnest(range(1, len(h) + 1)) AS i FROM l)",
}
