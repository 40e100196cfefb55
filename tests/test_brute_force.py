"""Queries without SQL against plain Python over the smallest tables, and operators on planted cases."""

import math
import re
import unicodedata
from statistics import median

import pandas as pd
import pytest
from pyspark.sql import functions as F

from citeloom.functions.stemming import tokens
from citeloom.operators import recovery, retrieval, tree
from citeloom.plans import registry
from citeloom.plans.tree_queries import questions_once


def table(sf_dir, name):
    return pd.read_parquet(f"{sf_dir}/{name}.parquet")


def last(df, key, *columns):
    """The row loaded last of each key."""
    rows = df.sort_values("loaded_at").drop_duplicates(key, keep="last")
    return rows.set_index(key)[list(columns)]


def normal(t):
    t = unicodedata.normalize("NFKC", t).lower()
    t = "".join({"‘": "'", "’": "'", "“": '"', "”": '"', "‐": "-", "‑": "-", "‒": "-", "–": "-", "—": "-"}.get(c, c) for c in t)
    t = re.sub(r"\^[0-9]+", "", t)
    t = re.sub(r"[ \t\n\x0b\f\r]+", " ", re.sub(r"(?m)^[ \t]*[-*•][ \t]+", "", t))
    notes = [r"[†‡§¶*]", r"s[0-9]+\.[0-9]+-[0-9]+(?:[ ]*[-,][ ]*s?[0-9]+\.[0-9]+-[0-9]+)*", r"(?<![0-9][.,])(?<=[.,])[0-9]+(?:[-,–][0-9]+)*(?=\s|$)", r"\|", '"']
    t = re.sub(r"[ \t\n\x0b\f\r]+", " ", re.sub("|".join(notes), " ", t))
    return re.sub(r"[ ]+([,.;:)\]}])", r"\1", t).strip(" ")


def tier(quote, raw):
    if not quote or not raw:
        return "fail"
    bare = quote.strip("“”‘’\"' ")
    if quote in raw or bare and bare in raw:
        return "exact"
    n, source = normal(quote).strip("'\""), normal(raw)
    if n and n in source:
        return "normalized"
    core = n.strip(".,;:!?\"'()[] ")
    edges = n[: len(n) - len(n.lstrip(".,;:!?\"'()[] "))] + n[len(n.rstrip(".,;:!?\"'()[] ")) :]
    if core and core != n and not re.search(r"\[?[.]{3,}\]?", edges) and core in source:
        return "normalized"
    parts = [p.strip(" ") for p in re.split(r"[ ]*(?:\[[.]{3,}\]|[.]{3,})[ ]*", n)]
    parts, at = [p for p in parts if len(p) >= 10], 0
    for p in parts:
        found = source.find(p, at)
        if found < 0:
            return "fail"
        at = found + len(p)
    return "elided" if len(parts) > 1 else "fail"


def test_verbatim_tiers_full(spark, sf_dir):
    quotes = last(table(sf_dir, "citations"), "citation_id", "doc_id", "quote")
    texts = last(table(sf_dir, "candidate_units"), "doc_id", "text")["text"].to_dict()
    want = {i: "unresolved" if d not in texts else tier(q, texts[d]) for i, d, q in quotes.itertuples()}
    got = {r["citation_id"]: r["tier"] for r in registry.QUERIES["verbatim_tiers_full"](spark, sf_dir).collect()}
    assert got == want and len(set(want.values())) > 3


def okapi(asked, documents, k):
    docs = {i: tokens(t) for i, t in documents.items()}
    n, mean = len(docs), sum(map(len, docs.values())) / len(docs)
    df = {}
    for ts in docs.values():
        for t in set(ts):
            df[t] = df.get(t, 0) + 1
    idf = {t: math.log(n - x + 0.5) - math.log(x + 0.5) for t, x in df.items()}
    low = 0.25 * sum(idf.values()) / len(idf)
    idf = {t: low if v < 0 else v for t, v in idf.items()}
    scores = {i: round(sum(idf[t] * ts.count(t) * 2.5 / (ts.count(t) + 1.5 * (0.25 + 0.75 * len(ts) / mean)) for t in tokens(asked) if t in idf), 6) for i, ts in docs.items()}
    return sorted(scores.items(), key=lambda x: (-x[1], x[0]))[:k]


def test_bm25_stemmed(spark, sf_dir):
    units = last(table(sf_dir, "candidate_units"), "doc_id", "text", "summary", "title_path")
    documents = {i: t or s or " > ".join(p if p is not None else []) for i, t, s, p in units.itertuples()}
    asked = {r["question_id"]: r["question"] for r in questions_once(spark, sf_dir).collect()}
    got = {}
    for r in registry.QUERIES["bm25_stemmed"](spark, sf_dir).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["doc_id"], r["score"]))
    for i, q in asked.items():
        want = okapi(q, documents, 10)
        mine = [(d, s) for _, d, s in sorted(got[i])]
        assert [s for _, s in mine] == pytest.approx([s for _, s in want], abs=2e-6) and {d for d, _ in mine[:3]} == {d for d, _ in want[:3]}


def test_documents_without_a_term_stand_behind(spark):
    docs = spark.createDataFrame([("b", "renal dose"), ("a", "other words"), ("c", ""), ("d", "renal"), ("e", "more")], "doc_id string, text string")
    asked = spark.createDataFrame([(1, "renal"), (2, "zzz"), (3, None)], "query_id int, text string")
    got = {}
    for r in retrieval.bm25_top(asked, docs, 3).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["doc_id"], r["score"] > 0))
    assert sorted(got[1]) == [(1, "d", True), (2, "b", True), (3, "a", False)]
    assert [d for _, d, _ in sorted(got[2])] == ["a", "b", "c"] == [d for _, d, _ in sorted(got[3])]
    assert retrieval.bm25_top(asked, docs.limit(0), 3).count() == 0


def test_blocks_and_batches_do_not_change_the_ranking(spark, sf_dir, monkeypatch):
    units = spark.read.parquet(f"{sf_dir}/candidate_units.parquet").filter("text is not null").select("doc_id", "text").dropDuplicates(["doc_id"])
    asked = questions_once(spark, sf_dir).select(F.col("question_id").alias("query_id"), F.col("question").alias("text"))
    whole = {tuple(r) for r in retrieval.bm25_top(asked, units, 4).collect()}
    monkeypatch.setattr(retrieval, "BROADCAST_BYTES", 0)
    assert {tuple(r) for r in retrieval.bm25_top(asked, units, 4, block=7, batch=5).collect()} == whole
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    one = {tuple(r) for r in retrieval.cosine_top(vectors, 5, every=10).collect()}
    assert {tuple(r) for r in retrieval.cosine_top(vectors, 5, every=10, block=9, batch=64).collect()} == one


def test_null_control(spark, sf_dir):
    """Scores of all three groups, by plain loops over the smallest tables."""
    rows = table(sf_dir, "readset_lookups").sort_values("loaded_at").drop_duplicates("lookup_id", keep="last").sort_values("lookup_id")
    texts = last(table(sf_dir, "candidate_units"), "doc_id", "text")["text"].to_dict()
    kept = []
    for r in rows.itertuples():
        spans = [s.strip(" ") for s in r.evidence_spans if s and s.strip(" ")] if r.evidence_spans is not None else [r.evidence.strip(" ")] if r.evidence and r.evidence.strip(" ") else []
        if sum(map(len, spans)) >= 30:
            kept.append((r.lookup_id, list(r.read_set), spans, r.span_tier in ("exact", "normalized", "elided")))
    blob = lambda ids: normal("\n\n---\n\n".join(f"[{d}]\n{texts[d]}" for d in ids if texts.get(d)))
    score = lambda spans, ids: min(recovery.partial_ratio(normal(s), blob(ids)) for s in spans)
    bad = [k for k in kept if not k[3]]
    want = {"verified": [score(s, i) for _, i, s, ok in kept if ok], "own": [score(s, i) for _, i, s, ok in bad], "unrelated": []}
    for at, (_, ids, spans, _) in enumerate(bad):
        other = next((bad[(at + j) % len(bad)] for j in range(1, len(bad)) if not set(ids) & set(bad[(at + j) % len(bad)][1])), None)
        if other:
            want["unrelated"].append(score(spans, other[1]))
    got = {r["which"]: (r["n"], r["median_ratio"]) for r in registry.QUERIES["null_control"](spark, sf_dir).collect()}
    assert got == {k: (len(v), pytest.approx(median(v))) for k, v in want.items() if v}


def test_dense_places(spark):
    df = spark.createDataFrame([(i * 7 % 101,) for i in range(101)] + [(5,), (5,)], "id int")
    got = sorted((r["id"], r["place"]) for r in recovery.dense_places(df, "id").collect())
    assert [p for _, p in got] == list(range(103)) and [i for i, _ in got] == sorted(r["id"] for r in df.collect())
    assert recovery.dense_places(df.limit(0), "id").count() == 0


NODE = "guideline_id string, section_id string, ord int, level int, path array<string>, section_type string, title string, rag_eligible boolean"


def test_target_units_and_childless_chapters(spark):
    rows = [("g", "c1", 1, 2, ["r", "c1"], "chapter", "Aims", True), ("g", "u1", 2, 3, ["r", "c1", "u1"], "subsection", "x", True), ("g", "u2", 3, 3, ["r", "c1", "u2"], "abstract", "x", True), ("g", "u3", 4, 3, ["r", "c1", "u3"], "subsection", "x", False)]
    rows += [("g", "c2", 5, 2, ["r", "c2"], "chapter", "Contents", True), ("g", "u4", 6, 3, ["r", "c2", "u4"], "subsection", "x", None), ("g", "c3", 7, 2, ["r", "c3"], "chapter", "Hidden", False), ("g", "u5", 8, 3, ["r", "c3", "u5"], "subsection", "x", True), ("g", "c4", 9, 2, ["r", "c4"], "chapter", "Doses", True)]
    nodes = spark.createDataFrame(rows, NODE)
    get = lambda **k: {(r["section_id"], r["kind"]) for r in tree.target_units(nodes, **k).collect()}
    assert get() == {("u1", "unit"), ("c2", "chapter"), ("c4", "chapter")}
    assert get(wanted=("c2", "c3")) == {("c2", "chapter")} and get(skipped=("CONTENT",)) == {("u1", "unit"), ("c4", "chapter")}


def test_rungs_must_part_the_rows(spark):
    ok = spark.createDataFrame([("m", "node"), ("m", "error"), ("n", "nowhere")], "model string, rung string")
    assert {r["model"]: r["located_share"] for r in recovery.rung_table(ok, "model").collect()} == {"m": 1.0, "n": 0.0}
    with pytest.raises(Exception, match="part the rows"):
        recovery.rung_table(spark.createDataFrame([("m", "elsewhere")], "model string, rung string"), "model").collect()


def test_truth_outside_the_pool(spark):
    truth = spark.createDataFrame([(1, "a", "c"), (2, "zz", "c")], "query_id int, doc_id string, chapter string")
    ranked = spark.createDataFrame([(1, "b", "c", 1), (1, "a", "c", 2), (2, "b", "c", 1)], "query_id int, doc_id string, chapter string, rank long")
    got = {(r["query_id"], r["k"]): (r["hit"], r["chapter_hit"], r["set_hit"], r["n_returned"]) for r in retrieval.set_hits(ranked, truth, (1, 3)).collect()}
    assert got == {(1, 1): (False, True, True, 2), (1, 3): (True, True, True, 2), (2, 1): (False, True, False, 1), (2, 3): (False, True, False, 1)}
    runs = spark.createDataFrame([("q2", "boom", 0), ("q1", "boom", 0), ("q3", None, 0), ("q4", None, 2)], "query_id string, error string, n_returned int")
    assert tuple(retrieval.rank_failures(runs).first()) == (4, 2, 1, "q1 q2")
