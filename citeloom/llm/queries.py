"""Queries of the training-data problems, and SQL where an operator has a plain relational form."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeloom.llm import annotator_consensus, byte_bpe, container_fill, look_alikes, natural_splits, reply_defects, sentences, shared_spans, stuffed_pages
from citeloom.session import sf_table


def _span_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = None
    for kind, table, key, text in (("citation", "citations", "citation_id", "quote"), ("unit", "candidate_units", "unit_id", "text"), ("lookup", "readset_lookups", "lookup_id", "evidence")):
        one = sf_table(spark, sf_dir, table).groupBy(F.col(key).alias("rec_id")).agg(F.max_by(text, "loaded_at").alias("text"))
        one = one.select(F.lit(kind).alias("rec_kind"), "rec_id", "text")
        out = one if out is None else out.unionByName(one)
    return out


def _least_span(spark: SparkSession, sf_dir: str) -> int:
    limit = sf_table(spark, sf_dir, "size_limits").filter("item_kind = 'shared_span'").select("min_size").first()
    return limit["min_size"] if limit else 150


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shared_spans.shared_spans(_span_records(spark, sf_dir), _least_span(spark, sf_dir))


def p1_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = _span_records(spark, sf_dir)
    return shared_spans.shared_shares(records, shared_spans.shared_spans(records, _least_span(spark, sf_dir)))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = sf_table(spark, sf_dir, "documents").select(F.lit("document").alias("rec_kind"), F.col("doc_id").alias("rec_id"), "text")
    claims = sf_table(spark, sf_dir, "claim_rows").groupBy(F.col("claim_id").alias("rec_id")).agg(F.max("text").alias("text"))  # without a time of loading
    return sentences.split_sentences(documents.unionByName(claims.select(F.lit("claim").alias("rec_kind"), "rec_id", "text")))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    prompts = sf_table(spark, sf_dir, "questions").groupBy("question_id").agg(F.max(F.struct("created_at", "question"))["question"].alias("asked"))
    answers = sf_table(spark, sf_dir, "answers").select("answer_id", "question_id", "answer", "question", "finish_reason", "loaded_at")
    joined = answers.join(prompts, "question_id", "left").select("answer_id", "answer", F.coalesce("asked", "question").alias("question"), "finish_reason", "loaded_at")
    tagged = sf_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text", "lang")
    return reply_defects.reply_defects(joined, profile=reply_defects.language_profile(tagged))


def _pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    limit = sf_table(spark, sf_dir, "size_limits").filter("item_kind = 'candidate_units.text'").select("max_size", "overlap").first()
    return natural_splits.split_oversized(sf_table(spark, sf_dir, "candidate_units"), "unit_id", "text", limit["max_size"] if limit else 1500, limit["overlap"] if limit else 150, "loaded_at")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pieces(spark, sf_dir).filter("piece_no = 0").select(F.col("item_id").alias("unit_id"), "cut_kind")


def p4_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pieces(spark, sf_dir).withColumnRenamed("item_id", "unit_id")


def _verdict_votes(given: DataFrame) -> DataFrame:
    return given.select("item", "annotator", F.col("verdict").alias("label"), F.col("shortfall").alias("kind"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = annotator_consensus.latest_labels(sf_table(spark, sf_dir, "verdicts"))
    decided = annotator_consensus.consensus(_verdict_votes(given), annotator_consensus.VERDICTS, annotator_consensus.SHORTFALLS)
    short = F.when(F.col("label").isin(*annotator_consensus.SHORT), F.col("kind"))
    return decided.select(F.col("item").alias("atom_id"), F.col("label").alias("support_verdict"), F.coalesce(short, F.lit("none")).alias("shortfall_type"))


def p5_judges(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = annotator_consensus.latest_labels(sf_table(spark, sf_dir, "verdicts"))
    return annotator_consensus.reliability(_verdict_votes(given), annotator_consensus.VERDICTS).withColumnRenamed("annotator", "judge_id")


def p5_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return annotator_consensus.agreement(_verdict_votes(annotator_consensus.latest_labels(sf_table(spark, sf_dir, "verdicts"))))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    quotes = sf_table(spark, sf_dir, "citations").groupBy(F.col("citation_id").alias("quote_id")).agg(F.max_by(F.struct("doc_id", "quote"), "loaded_at").alias("x"))
    units = sf_table(spark, sf_dir, "candidate_units").groupBy(F.col("unit_id").alias("passage_id")).agg(F.max_by(F.struct("doc_id", "text"), "loaded_at").alias("x"))
    found = look_alikes.same_to_the_eye(quotes.select("quote_id", F.col("x.doc_id").alias("key"), F.col("x.quote").alias("text")), units.select("passage_id", F.col("x.doc_id").alias("key"), F.col("x.text").alias("text")))
    return found.select(F.col("passage_id").alias("unit_id"), F.col("quote_id").alias("citation_id"))


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.encode_texts(sf_table(spark, sf_dir, "documents"), "doc_id", "text", byte_bpe.default_vocabulary())


def p8_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    limit = sf_table(spark, sf_dir, "size_limits").filter("size_unit like '%token%'").select("max_size").first()
    sizes = byte_bpe.encode_texts(sf_table(spark, sf_dir, "documents"), "doc_id", "text", byte_bpe.default_vocabulary(), counts_only=True)
    filled = container_fill.fill_containers(sizes, "doc_id", "n_tokens", limit["max_size"] if limit else 2048)
    return filled.withColumnRenamed("item_id", "doc_id").withColumnRenamed("size", "n_tokens")


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stuffed_pages.stuffed_pages(sf_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": p1_found,
    "p1_shares": p1_shares,
    "p2_found": p2_found,
    "p3_found": p3_found,
    "p4_found": p4_found,
    "p4_pieces": p4_pieces,
    "p5_found": p5_found,
    "p5_judges": p5_judges,
    "p5_agreement": p5_agreement,
    "p6_found": p6_found,
    "p7_ids": p7_ids,
    "p8_containers": p8_containers,
    "p9_found": p9_found,
}

ORACLE_SQL: dict[str, str] = {}
