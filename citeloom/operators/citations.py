"""Inline citations of answers: parsing, positions, sentence spans and attribution.

A marker is ``{{cite:doc|quote}}``. Positions count characters of the text without markers. Null answers have neither
markers nor spans.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeloom.functions.text import MARKER


def latest(df: DataFrame, key: str, columns: list[str], order: str = "loaded_at") -> DataFrame:
    """One row per key: the one loaded last, of equal ones the largest."""
    return df.groupBy(key).agg(F.max(F.struct(order, *columns)).alias("x")).select(key, *[F.col(f"x.{c}").alias(c) for c in columns])


def markers(answers: DataFrame) -> DataFrame:
    """(answer_id, marker_idx, doc_id, quote, pos) of every marker, in order."""
    docs, quotes = F.regexp_extract_all("answer", F.lit(MARKER), F.lit(1)), F.regexp_extract_all("answer", F.lit(MARKER), F.lit(2))
    parts = answers.select("answer_id", docs.alias("docs"), quotes.alias("quotes"), F.split("answer", MARKER, -1).alias("chunks")).filter(F.size("docs") > 0)
    each = parts.select("answer_id", "chunks", F.posexplode(F.arrays_zip("docs", "quotes")).alias("marker_idx", "m"))
    return each.select(
        "answer_id",
        F.col("marker_idx").cast("bigint").alias("marker_idx"),
        F.btrim("m.docs").alias("doc_id"),
        F.col("m.quotes").alias("quote"),
        F.length(F.array_join(F.slice("chunks", F.lit(1), F.col("marker_idx") + 1), "")).cast("bigint").alias("pos"),
    )


def cited_docs(answers: DataFrame) -> DataFrame:
    """(answer_id, pos, doc_id): the distinct cited documents in the order of their first citation."""
    docs = F.array_distinct(F.transform(F.regexp_extract_all("answer", F.lit(MARKER), F.lit(1)), lambda d: F.btrim(d)))
    return answers.select("answer_id", F.posexplode(docs).alias("pos", "doc_id")).withColumn("pos", F.col("pos").cast("bigint"))


def line_spans(answers: DataFrame) -> DataFrame:
    """(answer_id, sent_idx, start_pos, end_pos, text): the non-blank lines of the text without markers."""
    stripped = F.array_join(F.split("answer", MARKER, -1), "")
    lines = answers.select("answer_id", F.posexplode(F.split(stripped, "\n", -1)).alias("line", "raw"), F.split(stripped, "\n", -1).alias("all"))
    before = F.when(F.col("line") > 0, F.length(F.array_join(F.slice("all", F.lit(1), F.col("line")), "\n")) + 1).otherwise(0)
    placed = lines.select("answer_id", "line", F.btrim("raw").alias("text"), (before + F.length("raw") - F.length(F.ltrim("raw"))).alias("start_pos")).filter(F.length("text") > 0)
    gathered = placed.groupBy("answer_id").agg(F.array_sort(F.collect_list(F.struct("line", "start_pos", "text"))).alias("s"))
    each = gathered.select("answer_id", F.posexplode("s").alias("sent_idx", "s"))
    return each.select("answer_id", F.col("sent_idx").cast("bigint").alias("sent_idx"), F.col("s.start_pos").cast("bigint").alias("start_pos"), (F.col("s.start_pos") + F.length("s.text")).cast("bigint").alias("end_pos"), F.col("s.text").alias("text"))


def attribute(marks: DataFrame, spans: DataFrame) -> DataFrame:
    """(answer_id, marker_idx, sent_idx): the span that holds the marker, else the last one that ends before it, else the first.

    Markers of an answer without spans have a null sentence.
    """
    both = marks.select("answer_id", "marker_idx", "pos").join(spans.select("answer_id", "sent_idx", "start_pos", "end_pos"), "answer_id", "left")
    holds = (F.col("start_pos") <= F.col("pos")) & (F.col("pos") < F.col("end_pos"))
    inside = F.min(F.when(holds, F.col("sent_idx")))
    before = F.max(F.when(F.col("end_pos") <= F.col("pos"), F.col("sent_idx")))
    first = F.min("sent_idx")
    return both.groupBy("answer_id", "marker_idx").agg(F.coalesce(inside, before, first).alias("sent_idx"))
