"""Consensus of several annotators' labels by expectation-maximisation over per-annotator confusion matrices.

Every usable label counts, also several rounds of one annotator. Item posteriors and confusion matrices are re-estimated
in turn, with additive smoothing of every row towards the diagonal, until the matrices stand still; a model that still moves
after ``rounds`` rounds gives a warning. Up to ``most_annotators`` annotators the model (annotators x labels x labels numbers)
is held by the driver and the items stay where they are: each round is one pass that adds up counts per annotator and label,
so no round shuffles the labels. With more annotators the matrices are a table that is joined to the labels in every round;
the estimates are the same.

A label may come with a kind; the kind of an item is the one given most often with its consensus label.

Ties of a posterior go to the label that comes first in ``labels``, those of kinds to the kind that comes first. Null and
unusable labels don't vote; items without a usable label have no row; repeated rows of an (item, annotator, round) are one
label, the one loaded last (of equal ones the label and kind that come last).
"""

from __future__ import annotations

import warnings

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeloom.session import materialise

VERDICTS = ("fully_supported", "partially_supported", "not_supported", "contradicted")
#: In the order in which ties are decided.
SHORTFALLS = ("causal_upgrade", "scope_inflation", "strength_inflation", "unsupported_addition")
#: The labels that a kind of shortfall belongs to.
SHORT = VERDICTS[1:3]


def label_of(raw: Column, labels: tuple[str, ...]) -> Column:
    """The label that a spelling stands for, null if none."""
    plain = F.lower(F.regexp_replace(raw, "[^A-Za-z]+", ""))
    return F.coalesce(*[F.when(plain == x.replace("_", ""), x) for x in labels])


def _code(raw: Column, labels: tuple[str, ...]) -> Column:
    """1 for the first label, and so on; 0 if none."""
    plain = F.lower(F.regexp_replace(raw, "[^A-Za-z]+", ""))
    return F.coalesce(*[F.when(plain == x.replace("_", ""), i + 1) for i, x in enumerate(labels)], F.lit(0))


def _name(code: Column, labels: tuple[str, ...]) -> Column:
    return F.get(F.array(*map(F.lit, labels)), code.cast("int") - 1)


def latest_labels(verdicts: DataFrame) -> DataFrame:
    """(item, annotator, round, verdict, shortfall), one row for each label given."""
    # Time and codes in one number, which aggregates without sorting; a row without a time is older than all others.
    packed = F.coalesce(F.unix_micros(F.col("loaded_at").cast("timestamp_ltz")), F.lit(0)) * 64 + _code(F.col("support_verdict"), VERDICTS) * 8 + _code(F.col("shortfall_type"), SHORTFALLS)
    keyed = verdicts.select(F.col("atom_id").alias("item"), F.col("judge_id").alias("annotator"), F.col("round_no").alias("round"), packed.alias("x"))
    last = keyed.groupBy("item", "annotator", "round").agg(F.max("x").alias("x"))
    return last.select("item", "annotator", "round", _name(F.expr("x div 8 & 7"), VERDICTS).alias("verdict"), _name(F.expr("x & 7"), SHORTFALLS).alias("shortfall"))


def _posteriors(offsets, flat, n, k, log_matrix, log_prior):
    votes = log_matrix[flat // k, :, flat % k] * n[:, None]
    out = np.tile(log_prior, (len(offsets) - 1, 1))
    np.add.at(out, np.repeat(np.arange(len(offsets) - 1), np.diff(offsets)), votes)
    out -= out.max(axis=1, keepdims=True)
    p = np.exp(out)
    return p / p.sum(axis=1, keepdims=True)


def _arrays(column):
    """(offsets, votes, kinds, counts) of a column of lists of (v, kind, n)."""
    offsets = column.offsets.to_numpy()
    fields = (column.values.field(i).to_numpy()[offsets[0] : offsets[-1]] for i in range(3))
    return offsets - offsets[0], *fields


def _start(many: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    return np.full((many, k, k), 0.3 / max(1, k - 1)) + np.eye(k) * (0.7 - 0.3 / max(1, k - 1)), np.full(k, 1 / k)


def _towards(smoothing: float, k: int) -> np.ndarray:
    """What smoothing adds to the counts of an annotator."""
    return smoothing * (np.eye(k) * (k - 1) + 1) / k


def _usable(votes: DataFrame, labels: tuple[str, ...], kinds: tuple[str, ...]) -> DataFrame:
    """(item, annotator, label, kind, n) with codes from 0, kind -1 if there is none; equal votes of an item are one row with a count."""
    place = lambda c, names: F.coalesce(*[F.when(F.col(c) == x, i) for i, x in enumerate(names)])
    kind = F.coalesce(place("kind", kinds), F.lit(-1)) if kinds else F.lit(-1)
    usable = votes.select("item", "annotator", place("label", labels).alias("label"), kind.alias("kind")).filter("label is not null and annotator is not null and item is not null")
    return usable.groupBy("item", "annotator", "label", "kind").agg(F.count(F.lit(1)).alias("n"))


def estimate(votes: DataFrame, labels: tuple[str, ...], kinds: tuple[str, ...] = (), smoothing: float = 1.0, rounds: int = 100, tolerance: float = 1e-4, most_annotators: int = 100_000) -> tuple[DataFrame, DataFrame]:
    """(decided items, reliability) of ``votes`` (item, annotator, label and, if there are ``kinds``, kind).

    The items have (item, label, kind, posterior, n_votes), the reliability one row for each annotator and pair of labels:
    (annotator, true_label, given_label, probability, accuracy), where accuracy is the diagonal weighted by the prior.
    """
    counted = materialise(_usable(votes, labels, kinds), "consensus-votes")
    annotators = [r[0] for r in counted.select("annotator").distinct().limit(most_annotators + 1).collect()]
    run = _on_the_driver if len(annotators) <= most_annotators else _by_joins
    return run(counted, sorted(annotators), labels, kinds, smoothing, rounds, tolerance)


def _warn(moved: float) -> None:
    warnings.warn(f"the confusion matrices still moved by {moved:.2g}", stacklevel=3)


def _on_the_driver(counted, annotators, labels, kinds, smoothing, rounds, tolerance):
    k, many, spark = len(labels), len(annotators), counted.sparkSession
    codes = spark.createDataFrame([(a, i) for i, a in enumerate(annotators)], "annotator string, a int")
    coded = counted.join(codes, "annotator").select("item", (F.col("a") * k + F.col("label")).alias("v"), "kind", "n")
    items = materialise(coded.groupBy("item").agg(F.collect_list(F.struct("v", "kind", "n")).alias("votes")), "consensus-items")
    matrix, prior = _start(many, k)
    moved = 0.0
    for _ in range(rounds if many else 0):
        log_matrix, log_prior = np.log(matrix), np.log(prior)

        def count(batches, log_matrix=log_matrix, log_prior=log_prior):
            import pyarrow as pa

            total = np.zeros((many * k, k))
            weight = np.zeros(k)
            for batch in batches:
                offsets, flat, _, n = _arrays(batch.column(0))
                p = _posteriors(offsets, flat, n, k, log_matrix, log_prior)
                np.add.at(total, flat, np.repeat(p, np.diff(offsets), axis=0) * n[:, None])
                weight += p.sum(axis=0)
            used = np.flatnonzero(total.any(axis=1))
            rows = np.concatenate([used, [-1]])
            values = np.concatenate([total[used], weight[None]])
            yield pa.RecordBatch.from_arrays([pa.array(rows.astype(np.int32))] + [pa.array(values[:, j]) for j in range(k)], ["v", *(f"p{j}" for j in range(k))])

        sums = items.select("votes").mapInArrow(count, "v int, " + ", ".join(f"p{j} double" for j in range(k))).groupBy("v").agg(*(F.sum(f"p{j}").alias(f"p{j}") for j in range(k)))
        counts = np.zeros((many, k, k))
        for r in sums.collect():
            if r["v"] < 0:
                prior = np.array([r[f"p{j}"] for j in range(k)]) + smoothing
            else:
                counts[r["v"] // k, :, r["v"] % k] = [r[f"p{j}"] for j in range(k)]
        new = counts + _towards(smoothing, k)
        new /= new.sum(axis=2, keepdims=True)
        prior = prior / prior.sum()
        moved = np.abs(new - matrix).max()
        matrix = new
        if moved < tolerance:
            break
    if moved >= tolerance:
        _warn(moved)
    log_matrix, log_prior = np.log(matrix), np.log(prior)

    def decide(batches):
        import pyarrow as pa

        for batch in batches:
            offsets, flat, kind, n = _arrays(batch.column(1))
            p = _posteriors(offsets, flat, n, k, log_matrix, log_prior)
            best, row = p.argmax(axis=1), np.repeat(np.arange(len(p)), np.diff(offsets))
            given = np.zeros(len(p), dtype=np.int64)
            np.add.at(given, row, n)
            named = np.zeros((len(p), len(kinds) + 1), dtype=np.int64)
            counts = (flat % k == best[row]) & (kind >= 0)
            np.add.at(named, (row[counts], kind[counts]), n[counts])
            most = named.argmax(axis=1)
            names = [kinds[m] if named[i, m] else None for i, m in enumerate(most)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([labels[b] for b in best], pa.string()), pa.array(names, pa.string()), pa.array(p[np.arange(len(p)), best]), pa.array(given)], ["item", "label", "kind", "posterior", "n_votes"])

    item = items.schema["item"].dataType.simpleString()
    decided = items.select("item", "votes").mapInArrow(decide, f"item {item}, label string, kind string, posterior double, n_votes bigint")
    rows = [(a, t, g, float(matrix[i, x, y]), float((matrix[i].diagonal() * prior).sum())) for i, a in enumerate(annotators) for x, t in enumerate(labels) for y, g in enumerate(labels)]
    return decided, spark.createDataFrame(rows, "annotator string, true_label string, given_label string, probability double, accuracy double")


def _by_joins(counted, _annotators, labels, kinds, smoothing, rounds, tolerance):
    k = len(labels)
    start, prior = _start(1, k)
    towards = _towards(smoothing, k)
    cell = lambda m, x, y: F.get(m, x * k + y)
    # A confusion matrix is an array of its rows, one after the other.
    matrices = counted.select("annotator").distinct().select("annotator", F.array(*[F.lit(float(v)) for v in start[0].ravel()]).alias("m"))
    moved = 0.0

    def posteriors(matrices, prior):
        logs = counted.join(matrices, "annotator").groupBy("item").agg(*[(F.sum(F.col("n") * F.log(cell(F.col("m"), F.lit(x), F.col("label")))) + float(np.log(prior[x]))).alias(f"l{x}") for x in range(k)], F.sum("n").alias("n_votes"))
        top = F.greatest(*[F.col(f"l{x}") for x in range(k)]) if k > 1 else F.col("l0")
        e = [F.exp(F.col(f"l{x}") - top) for x in range(k)]
        return logs.select("item", "n_votes", *[(x / sum(e[1:], e[0])).alias(f"p{i}") for i, x in enumerate(e)])

    for _ in range(rounds):
        p = materialise(posteriors(matrices, prior), "consensus-posteriors")
        weight = p.agg(*[F.sum(f"p{x}") for x in range(k)]).first()
        each = counted.join(p, "item").groupBy("annotator").agg(*[F.sum(F.when(F.col("label") == y, F.col("n") * F.col(f"p{x}")).otherwise(0.0)).alias(f"c{x}_{y}") for x in range(k) for y in range(k)])
        smooth = lambda x, y: F.col(f"c{x}_{y}") + float(towards[x, y])
        new = F.array(*[smooth(x, y) / sum((smooth(x, z) for z in range(1, k)), smooth(x, 0)) for x in range(k) for y in range(k)])
        step = materialise(each.select("annotator", new.alias("m")).join(matrices.withColumnRenamed("m", "before"), "annotator"), "consensus-matrices")
        moved = step.agg(F.max(F.array_max(F.zip_with("m", "before", lambda a, b: F.abs(a - b))))).first()[0]
        matrices = step.select("annotator", "m")
        prior = np.array([w or 0.0 for w in weight]) + smoothing
        prior = prior / prior.sum()
        if moved < tolerance:
            break
    if moved >= tolerance:
        _warn(moved)
    p = posteriors(matrices, prior)
    best = F.array_max(F.array(*[F.struct(F.col(f"p{x}").alias("p"), F.lit(-x).alias("first")) for x in range(k)]))
    decided = p.select("item", "n_votes", best.alias("b")).select("item", (-F.col("b.first")).alias("code"), F.col("b.p").alias("posterior"), "n_votes")
    given = counted.filter("kind >= 0").groupBy("item", F.col("label").alias("code"), "kind").agg(F.sum("n").alias("n")).groupBy("item", "code").agg(F.max(F.struct("n", (-F.col("kind")).alias("first"))).alias("k"))
    decided = decided.join(given, ["item", "code"], "left")
    name = lambda code, names: F.get(F.array(*map(F.lit, names)), code) if names else F.lit(None).cast("string")
    decided = decided.select("item", name(F.col("code"), labels).alias("label"), name(-F.col("k.first"), kinds).alias("kind"), "posterior", "n_votes")
    accuracy = sum((cell(F.col("m"), F.lit(x), F.lit(x)) * float(prior[x]) for x in range(1, k)), cell(F.col("m"), F.lit(0), F.lit(0)) * float(prior[0]))
    pairs = F.array(*[F.struct(F.lit(t).alias("true_label"), F.lit(g).alias("given_label"), cell(F.col("m"), F.lit(x), F.lit(y)).alias("probability")) for x, t in enumerate(labels) for y, g in enumerate(labels)])
    reliable = matrices.select("annotator", accuracy.alias("accuracy"), F.explode(pairs).alias("c")).select("annotator", "c.true_label", "c.given_label", "c.probability", "accuracy")
    return decided, reliable


def consensus(votes: DataFrame, labels: tuple[str, ...], kinds: tuple[str, ...] = (), **options) -> DataFrame:
    """(item, label, kind, posterior, n_votes)."""
    return estimate(votes, labels, kinds, **options)[0]


def reliability(votes: DataFrame, labels: tuple[str, ...], **options) -> DataFrame:
    """(annotator, true_label, given_label, probability, accuracy)."""
    return estimate(votes, labels, **options)[1]


def agreement(votes: DataFrame) -> DataFrame:
    """One row: observed and expected agreement of label pairs of one item and Krippendorff's alpha, over items with two labels or more.

    All three are null where nothing can be compared.
    """
    per = votes.filter("label is not null and item is not null").groupBy("item", "label").agg(F.count(F.lit(1)).alias("n"))
    per = per.groupBy("item").agg(F.sum("n").alias("m"), F.collect_list(F.struct("label", "n")).alias("by")).filter("m >= 2")
    rows = per.select(F.col("m"), F.explode("by").alias("x")).select("m", "x.label", "x.n").withColumn("same", F.col("n") * (F.col("n") - 1) / (F.col("m") - 1))
    by = rows.groupBy("label").agg(F.sum("n").alias("n"), F.sum("same").alias("same"))
    total = by.agg(F.sum("n").alias("t"), F.sum("same").alias("s"), F.sum(F.col("n") * (F.col("n") - 1)).alias("e"))
    observed, expected = F.try_divide("s", "t"), F.try_divide(F.col("e"), F.col("t") * (F.col("t") - 1))
    return total.select(F.col("t").alias("n_labels"), observed.alias("observed"), expected.alias("expected"), F.try_divide(observed - expected, 1 - expected).alias("alpha"))
