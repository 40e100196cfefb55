"""Queries that send tables through the file formats and back, steps around model replies, and their SQL."""

from __future__ import annotations

import io
import uuid
import zipfile

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from citeloom.operators import extract, models, tree
from citeloom.plans import corpus_queries as co
from citeloom.plans.retrieval_queries import _LK, lookups_once
from citeloom.plans.segment_queries import _SP
from citeloom.plans.tree_queries import _N, _Q, nodes_once, questions_once
from citeloom.session import sf_table, shared_folder
from citeloom.sources import files

NODE = "section_id: string, title: string, number: string, level: int, parent_id: string, path: array<string>"


def _folder(spark, name):
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def jsonl_round_trip(spark, sf_dir):
    """Questions written as JSON lines, in two folders, and read as one table."""
    q = questions_once(spark, sf_dir).select("question_id", "question", "guideline_id", F.col("source.node_id").alias("node_id"), F.col("source.char_count").alias("char_count"))
    paths = [_folder(spark, "questions") for _ in range(2)]
    files.write_jsonl(q.filter("guideline_id < 'm'"), paths[0])
    files.write_jsonl(q.filter("guideline_id >= 'm'"), paths[1])
    return files.read_jsonl(spark, paths, "question_id string, question string, guideline_id string, node_id string, char_count int")


def tree_round_trip(spark, sf_dir):
    """Nodes written as tree documents, one for each guideline, and read back in document order."""
    n = nodes_once(spark, sf_dir)
    node = F.struct(*[F.col(c.split(":")[0]) for c in NODE.split(", ")])
    docs = n.groupBy("guideline_id").agg(F.map_from_entries(F.transform(F.array_sort(F.collect_list(F.struct("ord", F.struct("section_id", node.alias("node")).alias("e")))), lambda x: x["e"])).alias("nodes"))
    path = _folder(spark, "trees")
    files.write_jsonl(docs, path)
    back = files.read_tree(spark, path, NODE, lines=True)
    return back.select("guideline_id", F.col("ord").cast("bigint").alias("place"), "section_id", "title", "number", F.col("level").cast("bigint").alias("level"), "parent_id", F.array_join("path", "/").alias("path"))


@F.pandas_udf(T.BinaryType())
def _zipped(pages: pd.Series) -> pd.Series:
    def one(page):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            z.writestr("mimetype", "application/epub+zip")
            z.writestr("OEBPS/xhtml/index.xhtml", page)
        return out.getvalue()

    return pages.map(one)


def epub_round_trip(spark, sf_dir):
    """The sections out of EPUB files that hold the pages of the tree."""
    books = co._markup(spark, sf_dir).select("path", _zipped(F.col("value")).alias("content"))
    found = extract.epub_sections(books)
    return found.select(F.col("source").alias("guideline_id"), F.col("ord").cast("bigint").alias("ord"), "section_id", "number", "title", F.array_join("path", "/").alias("path"))


def _chapter_pages(spark, sf_dir):
    """(path, value) of a saved page for each chapter: a heading, a paragraph and a table for each section right below it."""
    n = nodes_once(spark, sf_dir)
    escape = lambda c: F.replace(F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    chapters = n.filter("level = 2 and section_type = 'chapter'").withColumn("no", F.row_number().over(Window.partitionBy("guideline_id").orderBy("ord")))
    kid = F.concat(F.lit('<h2 class="section-title" id="'), "section_id", F.lit('">'), F.coalesce(F.concat("number", F.lit(" ")), F.lit("")), escape(F.col("title")), F.lit("</h2><p>"), escape(F.col("summary")), F.lit('</p><div class="ref-list">left out</div><div class="table-overflow"><table><caption>Of '), "section_id", F.lit("</caption><tr><th>place</th></tr><tr><td>"), F.col("ord").cast("string"), F.lit("</td></tr></table></div>"))
    kids = n.filter("level = 3").select("guideline_id", F.col("parent_id").alias("section_id"), F.struct("ord", kid.alias("x")).alias("k")).groupBy("guideline_id", "section_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("k")), lambda k: k["x"]), "").alias("kids"))
    both = chapters.join(kids, ["guideline_id", "section_id"], "left")
    head = F.concat(F.lit('<html><h1 class="wi-article-title">'), F.col("no").cast("string"), F.lit(". "), escape(F.col("title")), F.lit(': Standards of Care 2030 | Journal<span class="icon">x</span></h1><p>menu</p><div class="widget-ArticleFulltext"><div class="widget-items"><p>meta</p></div><div class="widget-items"><p>'))
    value = F.concat(head, escape(F.col("summary")), F.lit("</p>"), F.coalesce("kids", F.lit("")), F.lit("</div></div></html>"))
    return both.select(F.concat("guideline_id", F.lit("/"), F.col("no").cast("string"), F.lit(".%20Chapter.html")).alias("path"), value.alias("value"))


def chapter_pages(spark, sf_dir):
    """Nodes out of saved chapter pages. A chapter without sections below has no element with headings, so its page is read whole."""
    found = extract.html_sections(_chapter_pages(spark, sf_dir))
    return found.select(F.col("source"), F.col("ord").cast("bigint").alias("place"), "section_id", "title", "number", F.col("level").cast("bigint").alias("level"), "parent_id", F.array_join("tables", " ").alias("tables"))


def page_assets(spark, sf_dir):
    found = extract.html_assets(_chapter_pages(spark, sf_dir))
    return found.select("source", F.col("ord").cast("bigint").alias("place"), "kind", "caption", "markdown")


def registry_available(spark, sf_dir):
    return files.list_available(sf_table(spark, sf_dir, "guideline_registry"), "epub")


def kept_replies(spark, sf_dir):
    """Keys of a table that two writers filled with overlapping rows."""
    q = questions_once(spark, sf_dir).select(F.sha2("question", 256).alias("key"), F.col("question").alias("reply"))
    table = files.KeptTable(spark, _folder(spark, "kept"), "key string, reply string")
    table.add(q.filter("length(reply) < 120"))
    table.add(q)
    return table.read()


def support_judged(spark, sf_dir):
    """Claims and quotes of lookups judged by the stand-in, each distinct pair once."""
    pairs = lookups_once(spark, sf_dir).select("claim", "quote").filter("claim is not null").distinct()
    replies, _ = models.ask(pairs, ["claim", "quote"], models.stand_in_judge, "stand-in-1")
    return models.verdicts(replies).select("claim", "quote", "support_verdict")


def question_ids(spark, sf_dir):
    """Ids of the questions to be made of every target unit."""
    made = models.question_ids(tree.target_units(nodes_once(spark, sf_dir)), ["direct", "scenario"], 2)
    return made.select("question_id")


def parsed_questions(spark, sf_dir):
    """Replies with a fenced JSON array of each unit's questions, parsed again."""
    q = questions_once(spark, sf_dir).select(F.concat_ws(":", "guideline_id", F.col("source.node_id")).alias("request"), "question_id", "question")
    packed = q.groupBy("request").agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("question_id", "question"))), lambda x: F.struct(x["question"].alias("question")))).alias("json"))
    replies = packed.select("request", F.concat(F.lit("```json\n"), "json", F.lit("\n```")).alias("reply"))
    return models.parse_questions(replies).select("request", F.col("place").cast("bigint").alias("place"), "question")


def claim_filter_round(spark, sf_dir):
    """What three rounds of a filter that names the claims of each answer by number decide; one round is lost and one names a number too many."""
    rows = sf_table(spark, sf_dir, "claim_rows").groupBy("claim_id").agg(*[F.max(c).alias(c) for c in ("answer_id", "idx", "is_claim")])
    c = rows.filter("answer_id is not null and idx is not null").select("answer_id", "idx", F.coalesce("is_claim", F.lit(False)).alias("is_claim"))
    per = c.groupBy(F.col("answer_id").alias("item")).agg((F.max("idx") + 1).alias("n"), F.array_sort(F.collect_set(F.when(F.col("is_claim"), F.col("idx") + 1))).alias("claim_numbers"))
    rounds = models.rounds(per, 3)
    numbers = F.when(F.col("round") == 1, F.concat("claim_numbers", F.array(F.lit(9999)))).otherwise(F.col("claim_numbers"))
    replies = rounds.select("item", "round", "n", F.when(F.col("round") < 2, F.to_json(F.struct(numbers.alias("claim_numbers")))).alias("reply"))
    votes = models.sentence_votes(replies).select(F.concat_ws("-", "item", "number").alias("item"), "vote")
    return models.keep_claims(votes)


_WORDS = lambda c: f"list_distinct(list_filter(string_split_regex(lower(coalesce({c}, '')), '{_SP}+'), lambda w: w <> ''))"
_CP = "cp AS (SELECT *, row_number() OVER (PARTITION BY guideline_id ORDER BY ord) AS no FROM n WHERE level = 2 AND section_type = 'chapter'), kd AS (SELECT cp.guideline_id, cp.no, k.section_id, k.title, k.number, k.ord, row_number() OVER (PARTITION BY cp.guideline_id, cp.no ORDER BY k.ord) AS i FROM cp JOIN n k ON k.guideline_id = cp.guideline_id AND k.parent_id = cp.section_id WHERE k.level = 3)"
_SRC = "guideline_id || '/' || no::VARCHAR || '.%20Chapter.html'"

QUERIES = {f.__name__: f for f in (jsonl_round_trip, tree_round_trip, epub_round_trip, chapter_pages, page_assets, registry_available, kept_replies, support_judged, question_ids, parsed_questions, claim_filter_round)}

ORACLE_SQL = {
    "jsonl_round_trip": f"WITH {_Q} SELECT question_id, x.a AS question, x.c AS guideline_id, x.d.node_id AS node_id, x.d.char_count AS char_count FROM q WHERE x.c IS NOT NULL",
    "tree_round_trip": f"WITH {_N} SELECT guideline_id, (row_number() OVER (PARTITION BY guideline_id ORDER BY ord) - 1)::BIGINT AS place, section_id, title, number, level::BIGINT AS level, parent_id, array_to_string(path, '/') AS path FROM n",
    "epub_round_trip": f"WITH {_N} SELECT guideline_id, ord::BIGINT AS ord, section_id, number, title, array_to_string(path, '/') AS path FROM n",
    "chapter_pages": f"WITH {_N}, {_CP} SELECT {_SRC} AS source, 0::BIGINT AS place, 'c' || lpad(no::VARCHAR, 2, '0') AS section_id, title, no::VARCHAR AS number, 1::BIGINT AS level, NULL AS parent_id, '' AS tables FROM cp UNION ALL SELECT {_SRC}, i, section_id, title, number, 2, 'c' || lpad(no::VARCHAR, 2, '0'), 'c' || lpad(no::VARCHAR, 2, '0') || '-t' || lpad(i::VARCHAR, 2, '0') FROM kd",
    "page_assets": f"WITH {_N}, {_CP} SELECT {_SRC} AS source, i - 1 AS place, 'table' AS kind, 'Of ' || section_id AS caption, '| place |' || chr(10) || '|---|' || chr(10) || '| ' || ord::VARCHAR || ' |' AS markdown FROM kd",
    "registry_available": "SELECT guideline_id FROM guideline_registry WHERE enabled AND source_type = 'epub'",
    "kept_replies": f"WITH {_Q} SELECT sha256(x.a) AS key, any_value(x.a) AS reply FROM q GROUP BY 1",
    "support_judged": f"WITH {_LK}, p AS (SELECT DISTINCT claim, quote FROM lk WHERE claim IS NOT NULL), w AS (SELECT claim, quote, {_WORDS('claim')} AS a, {_WORDS('quote')} AS b FROM p), s AS (SELECT *, len(list_intersect(a, b))::DOUBLE / greatest(1, len(a)) AS share FROM w) SELECT claim, quote, CASE WHEN len(b) = 0 THEN 'skipped_empty' WHEN share >= 0.8 THEN 'fully_supported' WHEN share >= 0.4 THEN 'partially_supported' ELSE 'not_supported' END AS support_verdict FROM s",
    "question_ids": f"WITH {_N}, {co._TU} SELECT guideline_id || '_' || section_id || '_' || style || '_q' || lpad(k::VARCHAR, 2, '0') AS question_id FROM tu, (VALUES ('direct'), ('scenario')) s(style), (VALUES (1), (2)) r(k)",
    "parsed_questions": f"WITH {_Q} SELECT x.c || ':' || x.d.node_id AS request, (row_number() OVER (PARTITION BY x.c, x.d.node_id ORDER BY question_id) - 1)::BIGINT AS place, trim(x.a, ' ') AS question FROM q",
    "claim_filter_round": "WITH c AS (SELECT claim_id, max(answer_id) AS answer_id, max(idx) AS idx, coalesce(max(is_claim), false) AS is_claim FROM claim_rows GROUP BY 1), d AS (SELECT * FROM c WHERE answer_id IS NOT NULL AND idx IS NOT NULL), p AS (SELECT answer_id, max(idx) AS m FROM d GROUP BY 1), e AS (SELECT answer_id, unnest(range(0, m + 1)) AS idx FROM p) SELECT e.answer_id::VARCHAR || '-' || (e.idx + 1)::VARCHAR AS item, coalesce(bool_or(d.is_claim), false) AS is_claim FROM e LEFT JOIN d ON d.answer_id = e.answer_id AND d.idx = e.idx GROUP BY 1",
}
