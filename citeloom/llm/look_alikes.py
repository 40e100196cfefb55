"""One consistent form for text that looks the same.

The values are the code points of the decomposed texts. Each is mapped by compatibility decomposition where that changes
only width, style or joining, by the Unicode table of confusable characters for letters and digits of other scripts, and by
the forms of spaces and hyphens. The mapped values are grouped under the accent-sensitive Unicode collation, which ignores
invisible characters; the shortest member, of equal ones the smallest, is the canonical one of its class. The classes are
joined back to the values, and the texts are rewritten by them. There are at most 1,114,112 code points, so the dictionary
of those that change is bounded whatever the texts are, and travels with the tasks.

Differences that can be seen stay: words, numbers, case, accents, superscripts, line breaks, runs of spaces. Null stays
null, an empty text stays empty. Canonical texts are decomposed: split and composed accents are the same there.
"""

from __future__ import annotations

import unicodedata
from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Letters that the Unicode table lacks or sees otherwise, with their look-alikes in the same order; hyphens; and the kinds of compatibility decomposition that change the style only.
MORE, LATIN = "ԚӏԍκյꞬԼ", "QlgkjGL"
HYPHENS = "‐‑⁃˗−﹣－"
STYLES = frozenset(["<wide>", "<narrow>", "<font>", "<noBreak>", "<small>", "<initial>", "<medial>", "<final>", "<isolated>"])


def confusable_letters(spark: SparkSession, points: list[str]) -> dict[str, str]:
    """Of ``points`` the letters and digits of other scripts that look like one of ASCII, by the skeletons of the Unicode confusables.

    Of several ASCII characters of one skeleton (1, I and l) the one of the same kind is taken. The table is that of the
    library which the engine's collations come from.
    """
    checker = spark._jvm.com.ibm.icu.text.SpoofChecker.Builder().build()
    plain: dict[str, dict[str, str]] = {}
    for c in map(chr, range(33, 127)):
        if c.isalnum():
            plain.setdefault(checker.getSkeleton(c), {})[unicodedata.category(c)] = c
    out = {}
    for c in points:
        if not c.isascii() and unicodedata.category(c)[0] in "LN" and (known := plain.get(checker.getSkeleton(c))):
            kind = unicodedata.category(c)
            out[c] = known.get(kind) or known.get("Ll") or known.get("Lu") or known["Nd"]
    return out | dict(zip(MORE, LATIN))


def mapper(letters: dict[str, str]):
    """The function that gives the look-alike-mapped form of a code point."""

    @cache
    def one(ch: str) -> str:
        if unicodedata.category(ch) == "Zs" or ch == "\t":
            return " "
        if ch in HYPHENS:
            return "-"
        kind, _, parts = unicodedata.decomposition(ch).rpartition("> ")
        if kind:
            made = "".join(chr(int(x, 16)) for x in parts.split())
            if kind + ">" in STYLES or kind == "<compat" and made.isalpha():
                return "".join(one(x) for x in made)
        return letters.get(ch, ch)

    return one


def canonical_points(texts: DataFrame, column: str) -> dict[str, str]:
    """The code points of the decomposed texts that change, with the canonical member of their class."""
    spark = texts.sparkSession

    def points(batches):
        import pyarrow as pa

        seen: set[str] = set()
        for batch in batches:
            for t in batch.column(0).to_pylist():
                if t is not None and not t.isascii():
                    seen.update(t)
        found = {c for t in seen for c in unicodedata.normalize("NFD", t)}
        yield pa.RecordBatch.from_arrays([pa.array(sorted(found), pa.string())], ["value"])

    found = [r["value"] for r in texts.select(column).mapInArrow(points, "value string").distinct().collect()]
    one = mapper(confusable_letters(spark, found))
    # What a compatibility decomposition leads to can be a look-alike again.
    rows = [(c, one(c)) for c in {*found, *map(chr, range(9, 127)), ""} if c] + [("", "")]
    values = spark.createDataFrame(rows, "value string, mapped string")
    joined = spark.sql(
        """
        WITH classes AS (
          SELECT collate(mapped, 'UNICODE') AS class, min(struct(length(mapped) AS n, mapped AS member)).member AS canonical
          FROM {points} GROUP BY collate(mapped, 'UNICODE')
        )
        SELECT c.value, k.canonical FROM {points} c JOIN classes k ON collate(c.mapped, 'UNICODE') = k.class
        WHERE c.value <> k.canonical
        """,
        points=values,
    )
    return {r["value"]: r["canonical"] for r in joined.collect()}


def canonical_texts(texts: DataFrame, column: str) -> DataFrame:
    """``texts`` with the added column ``<column>_canonical``."""
    table = {ord(k): v for k, v in canonical_points(texts, column).items()}

    @F.pandas_udf("string")
    def rewrite(column):
        import pandas as pd

        plain = not any(k < 128 for k in table)

        def one(t):
            if t is None or plain and t.isascii():
                return t
            return (t if t.isascii() else unicodedata.normalize("NFD", t)).translate(table)

        return pd.Series([one(t) for t in column], dtype=object)

    return texts.withColumn(f"{column}_canonical", rewrite(F.col(column)))


def same_to_the_eye(quotes: DataFrame, passages: DataFrame) -> DataFrame:
    """(passage_id, quote_id) of the quotes that read like a part of their passage without being one.

    ``quotes`` has quote_id, key, text; ``passages`` has passage_id, key, text. A quote that is empty in its canonical form is no case.
    """
    both = quotes.select(F.lit(True).alias("is_quote"), F.col("quote_id").alias("id"), "key", "text").unionByName(passages.select(F.lit(False).alias("is_quote"), F.col("passage_id").alias("id"), "key", "text"))
    made = canonical_texts(both.filter("text is not null and key is not null"), "text")
    # A canonical form that is the text itself is not sent along.
    made = made.withColumn("form", F.when(F.col("text_canonical") != F.col("text"), F.col("text_canonical")))
    q = made.filter("is_quote").select("key", F.col("id").alias("quote_id"), F.col("text").alias("quote"), F.col("form").alias("quote_form"))
    p = made.filter("not is_quote").select("key", F.col("id").alias("passage_id"), "text", "form")
    quote, text = F.coalesce("quote_form", "quote"), F.coalesce("form", "text")
    changed = F.col("quote_form").isNotNull() | F.col("form").isNotNull()
    hit = changed & ~F.contains("text", "quote") & F.contains(text, quote) & (F.length(F.trim(quote)) > 0)
    return q.join(p, "key").filter(hit).select("passage_id", "quote_id")
