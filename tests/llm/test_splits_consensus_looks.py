"""Natural splits, consensus of annotators, look-alike forms."""

import random
import re

import numpy as np
import pytest

from citeloom.llm import annotator_consensus as ac
from citeloom.llm import look_alikes, natural_splits


@pytest.mark.parametrize("text", ["word " * 900, "a" * 4000, "One. Two!\n\n" * 300, "x" * 1400 + " " + "y" * 1400, "中" * 3100 + "。" + "文" * 20, "é" * 2000])
def test_split(text):
    pieces = natural_splits.split(text, 1500, 150)
    assert "".join(text[a:b] for a, b, _ in pieces) == text
    for i, (a, b, _) in enumerate(pieces):
        assert b - a + (min(150, a) if i else 0) <= 1500
        assert i == 0 or a >= 150
    for (a, _, _), (_, e, _) in zip(pieces, pieces[1:]):
        assert e - a + min(150, a) > 1500
    assert natural_splits.split("", 1500, 150) == []


def test_cut_kind_is_that_of_the_longest_run():
    """The kind that the pieces show against the definition, on texts of random runs."""
    rng = random.Random(11)
    for _ in range(400):
        text = "".join(rng.choice("aé中,;(") * rng.choice([3, 40, 60, 130, 190, 200, 201, 260]) + rng.choice([" ", "\n", ".", "。", "! ", "", "\n\n", "\u3000"]) for _ in range(rng.randint(1, 12)))
        parts = natural_splits.atoms(text)
        pieces = natural_splits.merge(parts, 200, 30)
        runs = re.findall(rf"[^\s{re.escape(natural_splits.STOPS)}]+", text)
        if len(text) > 200:
            assert natural_splits.cut_kind(text, parts, pieces, 200) == ("forced" if max(map(len, runs), default=0) > 200 else "natural")


def test_overlap_alone_forces_no_cut(spark):
    df = spark.createDataFrame([(1, "word " * 100 + "x" * 1450 + " word" * 100)], "unit_id long, text string")
    got = natural_splits.split_oversized(df, "unit_id", "text", 1500, 150).collect()
    assert {r["cut_kind"] for r in got} == {"natural"} and any(r["boundary"] == "none" for r in got)


def test_latest_row_counts(spark):
    df = spark.createDataFrame([(1, "z" * 1600, 1), (1, "a b " * 500, 2), (2, "z" * 1600, 1), (2, None, 2)], "unit_id long, text string, loaded int")
    got = natural_splits.split_oversized(df, "unit_id", "text", 1500, 150, "loaded").collect()
    assert {(r["item_id"], r["cut_kind"]) for r in got} == {(1, "natural")}


def test_weak_boundaries_go_first():
    text = ("Sentence of some words here. " * 20 + "\n\n") * 5
    cuts = [a for a, _, _ in natural_splits.split(text, 1500, 150)][1:]
    assert cuts and all(text[a - 2 : a] == "\n\n" for a in cuts)


def test_split_operator(spark):
    rows = [(1, "short"), (2, None), (3, ""), (4, "b" * 1600), (5, "word " * 400), (5, "word " * 400), (6, "c" * 1500 + " d")]
    df = spark.createDataFrame(rows, "unit_id long, text string")
    got = natural_splits.split_oversized(df, "unit_id", "text", 1500, 150)
    assert {(r["item_id"], r["cut_kind"]) for r in got.collect()} == {(4, "forced"), (5, "natural"), (6, "natural")}
    assert all(len(r["piece"]) == r["end_pos"] - r["start_pos"] <= 1500 and (r["repeated"] == 150 or r["piece_no"] == 0) for r in got.collect())
    with pytest.raises(ValueError):
        natural_splits.split_oversized(df, "unit_id", "text", 100, 100)


def simulated(n_items=400, seed=3):
    rng = random.Random(seed)
    labels = ac.VERDICTS
    good = {"good1": 0.9, "good2": 0.85, "good3": 0.8}
    truth, rows = {}, []
    for i in range(n_items):
        t = rng.choice(labels)
        truth[str(i)] = t
        for a, p in good.items():
            rows.append((str(i), a, t if rng.random() < p else rng.choice(labels)))
        for a in ("noise1", "noise2", "noise3", "noise4"):
            rows.append((str(i), a, rng.choice(labels)))
        rows.append((str(i), "swap", {"fully_supported": "contradicted", "contradicted": "fully_supported"}.get(t, t)))
    return truth, rows


def test_consensus_beats_majority(spark):
    truth, rows = simulated()
    votes = spark.createDataFrame(rows, "item string, annotator string, label string")
    got = {r["item"]: r["label"] for r in ac.consensus(votes, ac.VERDICTS).collect()}
    by = {}
    for i, _, x in rows:
        by.setdefault(i, []).append(x)
    majority = {i: max(ac.VERDICTS, key=x.count) for i, x in by.items()}
    right = lambda d: np.mean([d[i] == t for i, t in truth.items()])
    assert right(got) > 0.93 and right(got) > right(majority)
    accuracy = {r["annotator"]: r["accuracy"] for r in ac.reliability(votes, ac.VERDICTS).collect()}
    assert accuracy["good1"] > 0.8 > 0.45 > accuracy["noise1"]


def test_consensus_edges(spark):
    schema = "item string, annotator string, label string"
    assert ac.consensus(spark.createDataFrame([], schema), ac.VERDICTS).count() == 0
    one = ac.consensus(spark.createDataFrame([("a", "x", None), ("b", None, "contradicted"), ("c", "x", "contradicted")], schema), ac.VERDICTS).collect()
    assert [(r["item"], r["label"], r["n_votes"]) for r in one] == [("c", "contradicted", 1)]


def test_more_annotators_than_the_driver_holds(spark):
    """The joined form gives the estimates of the other one, with kinds and ties."""
    _, rows = simulated(60)
    rows = [(*r, ac.SHORTFALLS[i % 4] if i % 3 else None) for i, r in enumerate(rows)]
    votes = spark.createDataFrame(rows, "item string, annotator string, label string, kind string")
    some, many = (ac.estimate(votes, ac.VERDICTS, ac.SHORTFALLS, most_annotators=n, rounds=4, tolerance=0.05) for n in (100, 3))
    get = lambda df: {r["item"]: (r["label"], r["kind"], round(r["posterior"], 6), r["n_votes"]) for r in df.collect()}
    assert get(some[0]) == get(many[0])
    get = lambda df: {(r["annotator"], r["true_label"], r["given_label"]): (round(r["probability"], 6), round(r["accuracy"], 6)) for r in df.collect()}
    assert get(some[1]) == get(many[1])


def test_kinds_belong_to_the_consensus_label(spark):
    rows = [("a", "x", "not_supported", "scope_inflation"), ("a", "y", "not_supported", "causal_upgrade"), ("a", "z", "not_supported", "causal_upgrade"), ("a", "w", "contradicted", "strength_inflation"), ("b", "x", "contradicted", None), ("c", "y", "not_supported", "unsupported_addition"), ("c", "y", "not_supported", "scope_inflation")]
    votes = spark.createDataFrame(rows, "item string, annotator string, label string, kind string")
    got = {r["item"]: (r["label"], r["kind"]) for r in ac.consensus(votes, ac.VERDICTS, ac.SHORTFALLS).collect()}
    assert got == {"a": ("not_supported", "causal_upgrade"), "b": ("contradicted", None), "c": ("not_supported", "scope_inflation")}


def test_agreement(spark):
    schema = "item string, annotator string, label string"
    same = ac.agreement(spark.createDataFrame([("a", "x", "u"), ("a", "y", "u"), ("b", "x", "v"), ("b", "y", "v")], schema)).first()
    assert same["observed"] == 1.0 and abs(same["alpha"] - 1.0) < 1e-12
    none = ac.agreement(spark.createDataFrame([("a", "x", "u")], schema)).first()
    assert none["observed"] is None and none["alpha"] is None


def test_labels_and_shortfalls(spark):
    from datetime import datetime

    t = datetime(2030, 1, 1)
    rows = [("a", "x", 1, "PartiallySupported", "Scope inflation", t), ("a", "x", 1, "PartiallySupported", "Scope inflation", t), ("a", "y", 1, "partially-supported.", None, t), ("b", "x", 1, "error", None, t), ("c", "x", 1, None, None, t)]
    df = spark.createDataFrame(rows, "atom_id string, judge_id string, round_no int, support_verdict string, shortfall_type string, loaded_at timestamp")
    given = ac.latest_labels(df)
    assert given.count() == 4
    assert {(r["item"], r["annotator"]): (r["verdict"], r["shortfall"]) for r in given.collect()} == {("a", "x"): ("partially_supported", "scope_inflation"), ("a", "y"): ("partially_supported", None), ("b", "x"): (None, None), ("c", "x"): (None, None)}
    late = spark.createDataFrame([("a", "x", 1, "contradicted", None, None), *rows], df.schema)
    assert ac.latest_labels(late).filter("item = 'a' and annotator = 'x'").first()["verdict"] == "partially_supported"


SAME = [("ｄｒｕｇ", "drug"), ("café", "café"), ("no​w", "now"), ("a b", "a b"), ("асе", "ace"), ("ﬁne", "fine"), ("x‑y", "x-y"), ("𝖺𝖻", "ab"), ("b͏d", "bd"), ("K", "K"), ("oﬆ", "ost"), ("a　b", "a b")]
OTHER = [("cafe", "café"), ("Ab", "ab"), ("x²", "x2"), ("a b", "ab"), ("1", "l"), ("a\nb", "a b")]


def test_canonical(spark):
    rows = [(i, t) for i, pair in enumerate(SAME + OTHER) for t in pair] + [(99, None), (98, "")]
    df = spark.createDataFrame(rows, "id int, text string")
    got = {}
    for r in look_alikes.canonical_texts(df, "text").collect():
        got.setdefault(r["id"], []).append(r["text_canonical"])
    for i in range(len(SAME)):
        assert got[i][0] == got[i][1], (SAME[i], got[i])
    for i in range(len(OTHER)):
        a, b = got[len(SAME) + i]
        assert a != b, OTHER[i]
    assert got[99] == [None] and got[98] == [""]


def test_letters_of_other_scripts(spark):
    """Pairs of many scripts; the same kind of character is taken where several look alike."""
    pairs = [("ꓮꓐ", "AB"), ("Ꭺ", "A"), ("Ⲟ", "O"), ("ıӏ", "il"), ("ΑΒΕ", "ABE"), ("І", "I"), ("Ѕѕ", "Ss"), ("κ", "k"), ("օ", "o")]
    rows = [(i, t) for i, pair in enumerate(pairs) for t in pair]
    got = {}
    for r in look_alikes.canonical_texts(spark.createDataFrame(rows, "id int, text string"), "text").collect():
        got.setdefault(r["id"], set()).add(r["text_canonical"])
    assert all(len(v) == 1 for v in got.values()), {pairs[k]: v for k, v in got.items() if len(v) > 1}
    none = look_alikes.canonical_points(spark.createDataFrame([], "text string"), "text")
    assert none["\t"] == " " and not any(c.isprintable() for c in none)


def test_same_to_the_eye(spark):
    p = spark.createDataFrame([(1, "k", "The café is open."), (2, "n", None)], "passage_id long, key string, text string")
    q = spark.createDataFrame([(1, "k", "café is"), (2, "k", "café is"), (3, "k", "cafe is"), (4, "k", ""), (5, "k", "​"), (6, "z", "x"), (7, None, "x"), (8, "n", "x"), (9, "k", None)], "quote_id long, key string, text string")
    assert [tuple(r) for r in look_alikes.same_to_the_eye(q, p).collect()] == [(1, 1)]


def test_table_is_aligned():
    assert len(look_alikes.MORE) == len(look_alikes.LATIN)
