"""Golden vectors of normalisation, verbatim tiers, segmentation and stemming."""

import pytest
from pyspark.sql import functions as F

from citeloom.functions.stemming import stem, tokens
from citeloom.functions.text import FULL, cache_key, model_slug, nearest_rank, normalize
from citeloom.operators import segments, verbatim

SOURCE = "The goal is <130/80 mm Hg, unless contraindicated. Adults with diabetes should be screened every year for kidney disease."


@pytest.mark.parametrize(
    "raw, want",
    [
        ("Target “BP” — 130", "target bp - 130"),
        ("outcomesS2.1-27 improved", "outcomes improved"),
        ("hypertension.25-27 Next", "hypertension. next"),
        ("95% CI:119-128 mm", "95% ci:119-128 mm"),
        ("1.8 and 1,500", "1.8 and 1,500"),
        ("a\n  - weight loss ,\n  - diet", "a weight loss, diet"),
        ("PREVENT*)", "prevent)"),
        ("dose^12 x", "dose x"),
        ("ﬁbre²", "fibre2"),
        ("total - hdl", "total - hdl"),
        ("", ""),
    ],
)
def test_normalize(spark, raw, want):
    df = spark.createDataFrame([(raw,)], "t string")
    assert df.select(normalize(F.col("t"))).first()[0] == want


@pytest.mark.parametrize(
    "quote, want",
    [
        ("goal is <130/80 mm Hg", "exact"),
        ("“goal is <130/80 mm Hg”", "exact"),
        ("GOAL IS <130/80 mm hg", "normalized"),
        ("goal is <130/80 mm Hg.", "normalized"),
        ("The goal is <130/80 mm Hg ... screened every year", "elided"),
        ("The goal is <130/80 mm Hg … screened every year", "elided"),
        ("screened every year ... The goal is <130/80", "fail"),
        ("goal is <130/80 mm Hg...", "fail"),
        ("goal is <140/90 mm Hg", "fail"),
        ("goal ... year", "fail"),
        ("", "fail"),
        (None, "fail"),
    ],
)
def test_tier(spark, quote, want):
    quotes = spark.createDataFrame([(1, "g:s", quote), (2, "missing:0", quote)], "id int, doc_id string, quote string")
    sections = spark.createDataFrame([("g:s", SOURCE)], "doc_id string, text string")
    got = {r["id"]: r["tier"] for r in verbatim.quote_tiers(quotes, sections, FULL).collect()}
    assert got == {1: want, 2: "unresolved"}


def test_tier_without_section_text(spark):
    quotes = spark.createDataFrame([(1, "g:s", "x")], "id int, doc_id string, quote string")
    sections = spark.createDataFrame([("g:s", None)], "doc_id string, text string")
    assert verbatim.quote_tiers(quotes, sections).first()["tier"] == "fail"
    empty = verbatim.compliance(verbatim.quote_tiers(quotes.limit(0), sections)).first()
    assert empty["n"] == 0 and empty["verbatim_rate"] is None


def segmented(spark, text):
    """([sentences], [sentence of each marker], [malformed of each marker])."""
    df = spark.createDataFrame([(1, text)], "answer_id long, answer string")
    rows = sorted((r["sent_idx"], r["text"]) for r in segments.sentence_rows(df).collect())
    marks = sorted((r["marker_idx"], r["sent_idx"], r["malformed"]) for r in segments.marker_rows(df).collect())
    return [t for _, t in rows], [m[1] for m in marks], [m[2] for m in marks]


@pytest.mark.parametrize(
    "text, want",
    [
        ("BP is 0.5 e.g. low. Next one!", ["BP is 0.5 e.g. low.", "Next one!"]),
        ("Line one\nLine two.", ["Line one", "Line two."]),
        ("Give max. Forty mg now.", ["Give max. Forty mg now."]),
        ("See Prof. Smith. Then go.", ["See Prof. Smith.", "Then go."]),
        ("See Figs. Then go.", ["See Figs.", "Then go."]),
        ('He said "stop." Then... so?! Yes', ['He said "stop."', "Then...", "so?!", "Yes"]),
        ("It is (so.) Next", ["It is (so.) Next"]),
        ("A. Smith and E.g. B rose to 3. Now", ["A. Smith and E.g. B rose to 3.", "Now"]),
        ("## Head\n- **Bold** [text](http://x.y) here\n1. Two\nWhat follows:\nEnd", ["Bold text here", "Two", "End"]),
        ("\u00a0Wide.\u2003Next\u3000one", ["Wide.", "Next one"]),
        (None, []),
        ("", []),
        (" \n ", []),
    ],
)
def test_sentences(spark, text, want):
    assert segmented(spark, text)[0] == want


def test_segments(spark):
    assert segmented(spark, "Choose a drug based on {{cite:g:s|q}} and monitor.")[2] == [True]
    assert segmented(spark, "Use ACE inhibitors {{cite:g:s|q}}.")[2] == [False]
    assert segmented(spark, "Options include: {{cite:g:s|q}}\nNext")[2] == [False]
    assert segmented(spark, 'The "options include:" {{cite:g:s|q}} next')[2] == [True]
    assert segmented(spark, "Options include: {{cite:g:s|q}} next")[2] == [False]  # a piece that only introduces is left out
    assert segmented(spark, "It is non-based on' {{cite:g:s|q}} it")[2] == [True] and segmented(spark, "It is x-on {{cite:g:s|q}} it")[2] == [False]
    assert segmented(spark, "{{cite:g:s|q}}") == ([], [None], [False])
    assert segmented(spark, "One. {{cite:a|x}} Two {{cite:b|y}}{{cite:c|z}}. Three.")[:2] == (["One.", "Two .", "Three."], [0, 1, 1])


@pytest.mark.parametrize("text, plain, positions", [("a  {{cite:d|q}}  b", "a b", [1]), ("a{{cite:d|q}} b", "a b", [1]), ("a {{cite:d|q}}b", "a b", [2]), ("a {{cite:d|q}} {{cite:d|q}} b", "a b", [1, 1]), ("a {{cite:d|q}} {{cite:d|q}}b", "a b", [1, 2]), ("{{cite:d|q}} a\t", " a ", [0]), ("a \x01b", "a b", [])])
def test_marker_positions(spark, text, plain, positions):
    row = segments.segmented(spark.createDataFrame([(1, text)], "answer_id long, answer string")).first()
    assert (row["plain"], row["marks"]) == (plain, positions)


def test_atoms_and_placeholders(spark):
    df = spark.createDataFrame([(1, "One {{cite: g:s:t |q }} two. {{cite:d|}}"), (2, None), (3, "{{cite:x:y|z}}")], "answer_id long, answer string")
    got = sorted(tuple(r) for r in segments.atoms(df).collect())
    assert got == [(1, 0, "One two.", "q ", "g:s:t", "g", "s:t"), (1, 1, "One two.", "", "d", "d", ""), (3, 0, "", "z", "x:y", "x", "y")]
    assert [r[0] for r in df.select(segments.numbered_markers(F.col("answer"), "[CITE_", "]")).collect()] == ["One [CITE_1] two. [CITE_2]", None, "[CITE_1]"]
    assert segments.inconsistent(df).count() == 0


def test_long_spans_with_a_quotation_are_split_again(spark):
    long = "He said \"it is so.\" Then " + "word " * 60 + "went. It ended"
    df = spark.createDataFrame([(1, 0, 5, 5 + len(long), long), (1, 1, 900, 905, "A. B.")], "answer_id long, sent_idx long, start_pos long, end_pos long, text string")
    got = sorted(tuple(r) for r in segments.resplit(df).collect())
    assert [g[4].split()[0] for g in got] == ["He", "Then", "It", "A."] and [g[1] for g in got] == [0, 1, 2, 3]
    assert all(long[a - 5 : b - 5].strip() == t for _, _, a, b, t in got[:3])


@pytest.mark.parametrize("word, want", [("running", "run"), ("hopes", "hope"), ("generously", "generous"), ("nationality", "nation"), ("skies", "sky"), ("hoping", "hope"), ("agreed", "agre"), ("consistency", "consist"), ("dying", "die"), ("crying", "cri"), ("by", "by")])
def test_stem(word, want):
    assert stem(word) == want


def test_tokens():
    assert tokens("The Hypertension's 2 doses, and THE plan") == ["hypertens", "2", "dose", "plan"]
    assert tokens(None) == []


def test_small_columns(spark):
    row = spark.createDataFrame([([3, 1, 2], "a/b:model-4.5", None)], "v array<int>, m string, n string").select(nearest_rank(F.col("v"), 0.9), nearest_rank(F.array().cast("array<int>"), 0.9), model_slug(F.col("m")), cache_key(F.col("m"), F.col("n"))).first()
    assert row[0] == 3 and row[1] is None and row[2] == "model-4pt5" and len(row[3]) == 64
