"""Model-backed steps as batch functions: distinct inputs, a content-keyed cache, and a deterministic stand-in.

A model is any callable from a pandas frame of requests to a list of JSON strings (or None for a failed request). It is
called once for each distinct request that the cache does not hold; failures are not cached.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeloom.functions.text import cache_key
from citeloom.operators.history import cache_lookup
from citeloom.session import materialise

Model = Callable[[pd.DataFrame], list[str | None]]


class Ranker(Protocol):
    """Gives the ids that fit a question, best first; what it raises is a failed ranking."""

    name: str

    def __call__(self, question: str) -> list[str]: ...


class Judge(Protocol):
    """Gives a JSON reply for each row of a batch of requests, None for one that failed."""

    settings: str

    def __call__(self, requests: pd.DataFrame) -> list[str | None]: ...


def ask(requests: DataFrame, fields: list[str], model: Model, settings: str, cache: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(``requests`` with the column ``reply``, new cache rows (key, reply)). The settings are part of every key."""
    keyed = requests.withColumn("key", cache_key(F.lit(settings), *[F.col(f) for f in fields]))
    known = cache if cache is not None else keyed.sparkSession.createDataFrame([], "key string, reply string")
    _, missing = cache_lookup(keyed, known, "key")

    def run(frames):
        for pdf in frames:
            yield pd.DataFrame({"key": pdf["key"], "reply": model(pdf[fields])})

    # Cut here: a Python step whose result is used twice would be run twice.
    fresh = materialise(missing.select("key", *fields).mapInPandas(run, "key string, reply string").filter("reply is not null"), "model-replies")
    both = known.select("key", "reply").unionByName(fresh)
    return keyed.join(both, "key", "left").drop("key"), fresh


def stand_in_judge(frame: pd.DataFrame) -> list[str | None]:
    """Verdicts from word overlap of claim and quote, for runs without a model; a blank quote is not judged."""
    out: list[str | None] = []
    for claim, quote in zip(frame["claim"], frame["quote"]):
        a, b = set((claim or "").lower().split()), set((quote or "").lower().split())
        if not b:
            out.append(json.dumps({"support_verdict": "skipped_empty"}))
            continue
        share = len(a & b) / max(1, len(a))
        out.append(json.dumps({"support_verdict": "fully_supported" if share >= 0.8 else "partially_supported" if share >= 0.4 else "not_supported"}))
    return out


def rounds(requests: DataFrame, n: int) -> DataFrame:
    """Each request ``n`` times with its round, so that every round has a key of its own."""
    return requests.select("*", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("round"))


def keep_claims(votes: DataFrame) -> DataFrame:
    """(item, is_claim) of (item, vote): a claim if half of the surviving rounds and one more say so; without any round it is kept."""
    alive = votes.groupBy("item").agg(F.sum(F.col("vote").cast("int")).alias("yes"), F.count("vote").alias("n"))
    return alive.select("item", F.when(F.col("n") == 0, True).otherwise(F.col("yes") >= F.floor(F.col("n") / 2) + 1).alias("is_claim"))


def question_ids(units: DataFrame, styles: list[str], per_unit: int) -> DataFrame:
    """One row for each unit, style and place with the id ``{guideline}_{node}_{style}_q{02d}``."""
    spine = units.select("guideline_id", "section_id", F.explode(F.array(*[F.lit(s) for s in styles])).alias("style"))
    each = spine.select("*", F.explode(F.sequence(F.lit(1), F.lit(per_unit))).alias("q"))
    return each.withColumn("question_id", F.format_string("%s_%s_%s_q%02d", "guideline_id", "section_id", "style", "q"))


def parse_questions(replies: DataFrame) -> DataFrame:
    """(request, place, question) out of replies that hold a JSON array, fenced or not; blank ones are left out."""
    bare = F.regexp_replace(F.regexp_replace("reply", r"^\s*```[a-z]*\s*", ""), r"\s*```\s*$", "")
    items = F.from_json(bare, "array<struct<question string>>")
    each = replies.select("request", F.posexplode(items).alias("place", "x"))
    return each.select("request", "place", F.btrim("x.question").alias("question")).filter(F.length("question") > 0)


def claim_numbers(replies: DataFrame) -> DataFrame:
    """(item, round, number) of filter replies ``{"claim_numbers": [...]}`` with ``n`` sentences: numbers from 1, those out of range and repeats left out."""
    given = F.from_json("reply", "struct<claim_numbers: array<int>>")["claim_numbers"]
    kept = F.array_distinct(F.filter(given, lambda x: (x >= 1) & (x <= F.col("n"))))
    return replies.select("item", "round", F.explode(kept).alias("number"))


def sentence_votes(replies: DataFrame) -> DataFrame:
    """(item, number, vote) for every sentence and round of (item, round, n, reply); a round without a reply votes null."""
    picked = claim_numbers(replies).withColumn("vote", F.lit(True))
    every = replies.select("item", "round", F.col("reply").isNotNull().alias("alive"), F.explode(F.sequence(F.lit(1), F.col("n"))).alias("number"))
    return every.join(picked, ["item", "round", "number"], "left").select("item", "number", F.when(F.col("alive"), F.coalesce("vote", F.lit(False))).alias("vote"))


def adjudication_requests(pairs: DataFrame, together: bool) -> DataFrame:
    """(claim_id, claim, quote) to be judged: the distinct quotes of a claim joined in their order, or one by one.

    ``pairs`` has claim_id, claim, marker_idx and quote.
    """
    ordered = pairs.groupBy("claim_id", "claim", "quote").agg(F.min("marker_idx").alias("marker_idx"))
    if not together:
        return ordered.select("claim_id", "claim", "quote")
    packed = ordered.groupBy("claim_id", "claim").agg(F.array_sort(F.collect_list(F.struct("marker_idx", "quote"))).alias("q"))
    return packed.select("claim_id", "claim", F.array_join(F.transform("q", lambda x: x["quote"]), "\n\n").alias("quote"))


def adjudicated(judged: DataFrame) -> DataFrame:
    """(claim_id, strict, lenient) of (claim_id, support_verdict): whether any quote supports the claim fully, or in part."""
    any_of = lambda *v: F.coalesce(F.max(F.col("support_verdict").isin(*v)), F.lit(False))
    return judged.groupBy("claim_id").agg(any_of("fully_supported").alias("strict"), any_of("fully_supported", "partially_supported").alias("lenient"))


def verdicts(replies: DataFrame) -> DataFrame:
    """``replies`` with support_verdict: of the reply's JSON, not_parsable where there is none."""
    given = F.from_json("reply", "struct<support_verdict: string>")["support_verdict"]
    return replies.withColumn("support_verdict", F.coalesce(given, F.lit("not_parsable")))


def located_claims(replies: DataFrame, atoms: DataFrame) -> DataFrame:
    """``atoms`` (answer_id, marker_idx, claim, …) with the claims that a localiser gave for ``[CITE_n]``, those of the rules where it gave none.

    ``replies`` has answer_id and reply, ``{"claims": [{"n": 1, "claim": "…"}]}``.
    """
    given = replies.select("answer_id", F.explode(F.from_json("reply", "struct<claims: array<struct<n: int, claim: string>>>")["claims"]).alias("x"))
    named = given.filter(F.length(F.btrim("x.claim")) > 0).groupBy("answer_id", (F.col("x.n") - 1).cast("bigint").alias("marker_idx")).agg(F.min("x.claim").alias("located"))
    return atoms.join(named, ["answer_id", "marker_idx"], "left").withColumn("claim", F.coalesce("located", "claim")).drop("located")


def extracted_claims(replies: DataFrame) -> DataFrame:
    """(answer_id, place, claim) of replies ``{"claims": ["…"]}``, blank ones left out."""
    each = replies.select("answer_id", F.posexplode(F.from_json("reply", "struct<claims: array<string>>")["claims"]).alias("place", "claim"))
    return each.select("answer_id", "place", F.btrim("claim").alias("claim")).filter(F.length("claim") > 0)


def lookups(replies: DataFrame) -> DataFrame:
    """``replies`` with found and spans of a lookup's JSON; a reply that cannot be read has null for found, one that found nothing no spans."""
    x = F.from_json("reply", "struct<found: boolean, evidence: array<string>>")
    spans = F.filter(F.coalesce(x["evidence"], F.array().cast("array<string>")), lambda s: F.length(F.btrim(s)) > 0)
    return replies.withColumn("found", x["found"]).withColumn("spans", F.when(F.col("found"), spans).otherwise(F.array().cast("array<string>")))


def described(items: DataFrame, key: str, existing: DataFrame, replies: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(items with their description, items still without one): existing descriptions stay, new ones fill, failures are left for another run."""
    known = existing.select(key, F.col("description").alias("kept"))
    made = replies.filter(F.length(F.btrim("description")) > 0).groupBy(key).agg(F.min("description").alias("made"))
    out = items.join(known, key, "left").join(made, key, "left").withColumn("description", F.coalesce("kept", "made")).drop("kept", "made")
    return out, out.filter("description is null").drop("description")


def routed(requests: DataFrame, routes: DataFrame) -> DataFrame:
    """``requests`` (…, model) with endpoint and vendor of the longest prefix of the model in ``routes`` (prefix, vendor, endpoint); nulls if none fits."""
    names = requests.select("model").distinct()
    best = names.join(routes, F.startswith("model", F.col("prefix"))).groupBy("model").agg(F.max_by(F.struct("vendor", "endpoint"), F.length("prefix")).alias("r"))
    return requests.join(best, "model", "left").select(*requests.columns, "r.vendor", "r.endpoint")
