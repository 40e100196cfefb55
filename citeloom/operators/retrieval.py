"""Lexical and dense retrieval, and its evaluation by hits at k."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from citeloom.functions.stemming import tokens
from citeloom.session import materialise

K1, B, FLOOR = 1.5, 0.75, 0.25


@F.pandas_udf(T.ArrayType(T.StringType()))
def stemmed_tokens(text: pd.Series) -> pd.Series:
    return text.map(tokens)


@F.pandas_udf(T.ArrayType(T.StringType()))
def plain_tokens(text: pd.Series) -> pd.Series:
    """Runs of ASCII letters and digits in lower case, without stop words.

    As a built-in expression (a filter over the extracted runs) this compares each token with each stop word and took
    five times as long.
    """
    return text.map(lambda t: tokens(t, stemmed=False))


#: Bytes up to which blocks of queries travel to the rows; beyond that rows and blocks meet by a shuffle.
BROADCAST_BYTES = 64 << 20


def _meet(packed: DataFrame, blocks: DataFrame, n_blocks: int, n_bytes: int) -> DataFrame:
    """Every packed batch of rows with every block of queries (a stated set of queries against all rows, in blocks)."""
    side = F.broadcast(blocks) if n_bytes <= BROADCAST_BYTES else blocks
    return packed.select("*", F.explode(F.sequence(F.lit(0), F.lit(max(1, n_blocks) - 1))).alias("block")).join(side, "block")


def _ranked(scored: DataFrame, id_column: str, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), id_column)
    return scored.withColumn("rank", F.row_number().over(order).cast("bigint")).filter(F.col("rank") <= k)


def document_text(text: Column, summary: Column, breadcrumb: Column) -> Column:
    """What a candidate is searched by: its text, else its summary, else its breadcrumb; an empty one falls through."""
    filled = lambda c: F.nullif(c, F.lit(""))
    return F.coalesce(filled(text), filled(summary), filled(breadcrumb), F.lit(""))


def bm25_top(queries: DataFrame, documents: DataFrame, k: int, stemmed: bool = True, block: int = 1024, batch: int = 1000) -> DataFrame:
    """(query_id, doc_id, score, rank): the best ``k`` documents for each query.

    ``queries`` has query_id and text, ``documents`` doc_id and text. Okapi weights; a negative inverse frequency becomes
    a quarter of the mean one. Query terms count as often as they occur. Documents without any query term score 0 and stand
    behind the others; ties go to the smaller doc_id. Documents are packed into batches where they lie, queries into blocks of
    a bounded size; each batch is scored against a block at once and keeps its best ``k`` (and ties) for each query, so that
    no row is made for a term that a query and a document share, and nothing but counts comes to the driver.
    """
    cut = stemmed_tokens if stemmed else plain_tokens
    docs = materialise(documents.select("doc_id", cut(F.col("text")).alias("terms")), "bm25-terms")
    totals = docs.agg(F.count(F.lit(1)).alias("n"), F.avg(F.size("terms")).alias("avgdl")).first()
    n, avgdl = totals["n"], totals["avgdl"] or 1.0
    df = docs.select(F.explode(F.array_distinct("terms")).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    df = materialise(df.select("term", (F.log(F.lit(n) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)).alias("raw")), "bm25-terms-idf")
    least = (df.agg(F.avg("raw").alias("m")).first()["m"] or 0.0) * FLOOR
    idf = df.select("term", F.when(F.col("raw") < 0, F.lit(least)).otherwise(F.col("raw")).alias("idf"))
    n_blocks = max(1, -(-queries.count() // block))
    wanted = queries.select("query_id", F.explode(cut(F.col("text"))).alias("term")).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("q"))
    weights = wanted.join(idf, "term").select("query_id", "term", (F.col("q") * F.col("idf")).alias("w"), F.pmod(F.xxhash64("query_id"), F.lit(n_blocks).cast("bigint")).cast("int").alias("block"))
    blocks = materialise(weights.groupBy("block").agg(F.collect_list(F.struct("query_id", "term", "w")).alias("x")).select("block", F.col("x.query_id").alias("queries"), F.col("x.term").alias("asked"), F.col("x.w").alias("weights"), F.size("x").alias("n")), "bm25-blocks")
    kinds = [x.schema[c].dataType.simpleString() for x, c in ((queries, "query_id"), (documents, "doc_id"))]

    def pack(frames):
        for pdf in frames:
            for at in range(0, len(pdf), batch):
                part = pdf.iloc[at : at + batch]
                yield pd.DataFrame({"ids": [part["doc_id"].tolist()], "terms": [[list(t) for t in part["terms"]]]})

    def score(frames):
        for pdf in frames:
            for ids, lists, of, asked_terms, w in zip(*(pdf[c] for c in ("ids", "terms", "queries", "asked", "weights"))):
                rows, asked = pd.factorize(np.asarray(of), sort=True)
                columns, terms = pd.factorize(np.asarray(asked_terms), sort=True)
                place = {t: i for i, t in enumerate(terms)}
                q, has = np.zeros((len(place), len(asked))), np.zeros((len(place), len(asked)), dtype=np.float32)
                q[columns, rows], has[columns, rows] = np.asarray(w, dtype=np.float64), 1
                d = np.zeros((len(ids), len(place)))
                for i, ts in enumerate(lists):
                    for t in ts:
                        j = place.get(t)
                        if j is not None:
                            d[i, j] += 1
                size = np.array([len(ts) for ts in lists])[:, None]
                shared = (d > 0).astype(np.float32) @ has > 0
                d = d * (K1 + 1) / (d + K1 * (1 - B + B * size / avgdl))
                s = np.where(shared, np.round(d @ q, 6), -np.inf)
                bar = np.partition(s, -k, axis=0)[-k] if len(ids) > k else np.full(len(asked), -np.inf)
                doc, query = np.nonzero((s >= bar) & shared)
                yield pd.DataFrame({"query_id": asked[query], "doc_id": np.asarray(ids)[doc], "score": s[doc, query]})

    packed = docs.mapInPandas(pack, f"ids array<{kinds[1]}>, terms array<array<string>>")
    n_bytes = 64 * (blocks.agg(F.sum("n")).first()[0] or 0)
    found = _ranked(_meet(packed, blocks, n_blocks, n_bytes).drop("block", "n").mapInPandas(score, f"query_id {kinds[0]}, doc_id {kinds[1]}, score double"), "doc_id", k)
    # The first k documents that a query shares no term with are among the first 2k of all.
    first = [r[0] for r in documents.select("doc_id").orderBy("doc_id").limit(2 * k).collect()]
    if not first:
        return found
    short = queries.select("query_id").distinct().join(found.filter("score > 0").groupBy("query_id").agg(F.count(F.lit(1)).alias("m")), "query_id", "left").filter(F.coalesce("m", F.lit(0)) < k)
    others = short.select("query_id", F.explode(F.array(*[F.lit(x).cast(kinds[1]) for x in first])).alias("doc_id")).join(found.select("query_id", "doc_id"), ["query_id", "doc_id"], "left_anti")
    return _ranked(found.drop("rank").unionByName(others.withColumn("score", F.lit(0.0))), "doc_id", k)


def cosine_top(vectors: DataFrame, k: int, every: int = 100, block: int = 2048, batch: int = 4096) -> DataFrame:
    """(query_id, vec_id, rank, score): the ``k`` nearest other rows by cosine of every row whose id ``every`` divides.

    Rows are packed into batches where they lie, queries into blocks of a bounded size; each batch keeps its best ``k`` per
    query, and the partial results are merged by rank. Vectors of length zero or with nulls match nothing; ties go to the
    smaller id.
    """
    known = vectors.filter(F.col("embedding").isNotNull() & ~F.exists("embedding", lambda x: x.isNull())).select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    asked = known.filter(F.col("vec_id") % every == 0)
    size = asked.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("embedding")).alias("d")).first()
    n_blocks = max(1, -(-size["n"] // block))
    blocks = asked.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(n_blocks).cast("bigint")).cast("int")).groupBy("block").agg(F.collect_list(F.struct("vec_id", "embedding")).alias("x")).select("block", F.col("x.vec_id").alias("queries"), F.flatten(F.col("x.embedding")).alias("asked"))

    def unit(flat, n):
        x = np.asarray(flat, dtype=np.float64).reshape(n, -1)
        norm = np.linalg.norm(x, axis=1, keepdims=True)
        return np.divide(x, norm, out=np.full_like(x, np.nan), where=norm > 0)

    def pack(frames):
        for pdf in frames:
            for at in range(0, len(pdf), batch):
                part = pdf.iloc[at : at + batch]
                yield pd.DataFrame({"ids": [part["vec_id"].to_numpy()], "flat": [np.concatenate(part["embedding"].to_numpy())]})

    def nearest(frames):
        for pdf in frames:
            for own, flat, ids, wanted in zip(*(pdf[c] for c in ("ids", "flat", "queries", "asked"))):
                own, ids = np.asarray(own), np.asarray(ids)
                s = np.round(unit(wanted, len(ids)) @ unit(flat, len(own)).T, 9)
                s[ids[:, None] == own[None, :]] = np.nan
                s = np.where(np.isnan(s), -np.inf, s)
                order = np.lexsort((np.broadcast_to(own, s.shape), -s), axis=1)[:, :k]
                best = np.take_along_axis(s, order, axis=1)
                made = pd.DataFrame({"query_id": np.repeat(ids, order.shape[1]), "vec_id": own[order].ravel(), "score": best.ravel()})
                yield made[np.isfinite(made["score"])]

    packed = known.mapInPandas(pack, "ids array<bigint>, flat array<double>")
    met = _meet(packed, blocks, n_blocks, 8 * size["n"] * ((size["d"] or 0) + 1)).drop("block")
    return _ranked(met.mapInPandas(nearest, "query_id bigint, vec_id bigint, score double"), "vec_id", k)


def text_chunks(texts: DataFrame, key: str, size: int) -> DataFrame:
    """(key, chunk_no, chunk): each text in stretches of ``size`` characters; an empty or null text has none."""
    n = F.ceil(F.length("text") / F.lit(size)).cast("int")
    each = texts.filter(F.length("text") > 0).select(key, "text", F.explode(F.sequence(F.lit(0), n - 1)).alias("chunk_no"))
    return each.select(key, F.col("chunk_no").cast("bigint").alias("chunk_no"), F.substring("text", F.col("chunk_no") * size + 1, F.lit(size)).alias("chunk"))


def request_batches(items: DataFrame, group: str, order: str, size: Column, most_size: int, most_items: int) -> DataFrame:
    """``items`` with request_no: a request is sent when one more item would pass ``most_size`` or ``most_items``, inside each ``group``.

    Which request an item is in depends on all before it, so each group is walked once, in its order; the groups are the
    partitions of the work and run side by side.
    """
    kinds = ", ".join(f"{c} {items.schema[c].dataType.simpleString()}" for c in (group, order))

    def walk(frames):
        held, request, n, total = None, 0, 0, 0
        for pdf in frames:
            out = []
            for g, x in zip(pdf[group], pdf["size_"]):
                if g != held:
                    held, request, n, total = g, 0, 0, 0
                elif n and (total + x > most_size or n >= most_items):
                    request, n, total = request + 1, 0, 0
                n, total = n + 1, total + x
                out.append(request)
            yield pd.DataFrame({group: pdf[group], order: pdf[order], "request_no": out})

    return items.select(group, order, size.cast("bigint").alias("size_")).repartition(group).sortWithinPartitions(group, order).mapInPandas(walk, f"{kinds}, request_no bigint")


def mean_pooled(chunks: DataFrame, group: str, vector: str) -> DataFrame:
    """(group, place, value): unit vectors of each group averaged and scaled to unit length again."""
    length = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))) + 1e-9
    unit = chunks.select(group, length.alias("len"), F.posexplode(vector).alias("place", "x"))
    mean = unit.groupBy(group, "place").agg(F.avg(F.col("x").cast("double") / F.col("len")).alias("m"))
    total = mean.groupBy(group).agg((F.sqrt(F.sum(F.col("m") * F.col("m"))) + 1e-9).alias("norm"))
    return mean.join(total, group).select(group, F.col("place").cast("bigint").alias("place"), (F.col("m") / F.col("norm")).alias("value"))


def hits(ranked: DataFrame, truth: DataFrame, ks: tuple[int, ...]) -> DataFrame:
    """(query_id, k, hit, chapter_hit): whether the right document, or one of its chapter, is among the first k.

    ``ranked`` has query_id, doc_id, chapter and rank, ``truth`` query_id, doc_id and chapter. An empty ranking is a miss.
    """
    both = truth.select("query_id", F.col("doc_id").alias("right"), F.col("chapter").alias("right_chapter")).join(ranked.select("query_id", "doc_id", "chapter", "rank"), "query_id", "left")
    first = both.groupBy("query_id").agg(F.min(F.when(F.col("doc_id") == F.col("right"), F.col("rank"))).alias("at"), F.min(F.when(F.col("chapter") == F.col("right_chapter"), F.col("rank"))).alias("chapter_at"))
    each = first.select("*", F.explode(F.array(*[F.lit(k).cast("bigint") for k in ks])).alias("k"))
    return each.select("query_id", "k", F.coalesce(F.col("at") <= F.col("k"), F.lit(False)).alias("hit"), F.coalesce(F.col("chapter_at") <= F.col("k"), F.lit(False)).alias("chapter_hit"))


def hit_breakdowns(hit: DataFrame, facets: list[str]) -> DataFrame:
    """Mean hits at each k overall and by each facet, in one pass of grouping sets; a mean of nothing is 0."""
    sets = [["k"], *[["k", f] for f in facets]]
    rate = lambda c: F.coalesce(F.avg(F.col(c).cast("double")), F.lit(0.0))
    out = hit.groupingSets(sets, "k", *facets).agg(F.count(F.lit(1)).alias("n"), rate("hit").alias("hit_rate"), rate("chapter_hit").alias("chapter_rate"))
    return out.select("k", *[F.coalesce(F.col(f).cast("string"), F.lit("*")).alias(f) for f in facets], "n", "hit_rate", "chapter_rate")


def set_hits(ranked: DataFrame, truth: DataFrame, ks: tuple[int, ...]) -> DataFrame:
    """As ``hits``, with set_hit and set_chapter_hit (anywhere in the list) and n_returned; a failed ranking is an empty one."""
    sizes = ranked.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_returned"), F.max("rank").alias("last"))
    whole = hits(ranked, truth, (1 << 30,)).select("query_id", F.col("hit").alias("set_hit"), F.col("chapter_hit").alias("set_chapter_hit"))
    out = hits(ranked, truth, ks).join(whole, "query_id").join(sizes, "query_id", "left")
    return out.select("query_id", "k", "hit", "chapter_hit", "set_hit", "set_chapter_hit", F.coalesce("n_returned", F.lit(0)).alias("n_returned"))


def results(hit: DataFrame, facets: list[str]) -> DataFrame:
    """Rates of ``set_hits`` overall and by each facet: rounded to 4 places (halves to even), the mean length of the lists to 2."""
    rate = lambda c: F.bround(F.coalesce(F.avg(F.col(c).cast("double")), F.lit(0.0)), 4)
    names = {"hit": "hit_rate", "chapter_hit": "chapter_rate", "set_hit": "set_rate", "set_chapter_hit": "set_chapter_rate"}
    out = hit.groupingSets([["k"], *[["k", f] for f in facets]], "k", *facets).agg(F.count(F.lit(1)).alias("n"), F.bround(F.avg("n_returned"), 2).alias("avg_returned"), *[rate(c).alias(x) for c, x in names.items()])
    return out.select("k", *[F.coalesce(F.col(f).cast("string"), F.lit("*")).alias(f) for f in facets], "n", "avg_returned", *names.values())


def rank_failures(runs: DataFrame, most: int = 20) -> DataFrame:
    """One row of (query_id, error, n_returned) runs: how many failed or came back empty, and the first failures by id."""
    failed = F.col("error").isNotNull()
    counts = runs.agg(F.count(F.lit(1)).alias("n"), F.count_if(failed).alias("n_failed"), F.count_if(~failed & (F.col("n_returned") == 0)).alias("n_empty"))
    first = runs.filter(failed).orderBy("query_id").limit(most).agg(F.array_join(F.array_sort(F.collect_list("query_id")), " ").alias("failures"))
    return counts.crossJoin(first)


def run_ranker(questions: DataFrame, rank, valid: list[str] | None = None) -> DataFrame:
    """(query_id, ids, error) of a ranker, a callable from a question's text to a list of ids, over (query_id, text).

    A question whose ranking raises has no ids and the error's text; it is a miss for every rate. Ids that ``valid`` does not
    have and repeats are left out. The callable travels to the workers and works on its own batch.
    """
    kind = questions.schema["query_id"].dataType.simpleString()

    def run(frames):
        known = None if valid is None else set(valid)
        for pdf in frames:
            out = []
            for i, text in zip(pdf["query_id"], pdf["text"]):
                try:
                    ids = [x for x in dict.fromkeys(rank(text)) if known is None or x in known]
                    out.append((i, ids, None))
                except Exception as error:  # noqa: BLE001  # whatever a ranker raises is its result
                    out.append((i, None, f"{type(error).__name__}: {error}"))
            yield pd.DataFrame(out, columns=["query_id", "ids", "error"])

    return questions.select("query_id", "text").mapInPandas(run, f"query_id {kind}, ids array<string>, error string")
