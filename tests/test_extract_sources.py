"""Section extraction, placeholders, readers, writers and streams."""

import json
import zipfile

import pytest
from pyspark.sql import functions as F

from citeloom.operators import extract, tree
from citeloom.sources import files
from citeloom.streaming import events

XHTML = """<html><body><section id="bodymatter"><section id="s1"><h2>1. Goals of <i>care</i></h2><p>Aim low.  See <a href="t2.xhtml">Table 2</a> and <a href="t2.xhtml">Table 2</a>.</p>
<figure><a href="f3.xhtml"><img src="x.png"/></a></figure><section id="s2"><h3>130 people</h3><ul><li>One</li><li>Two<br/>lines</li></ul></section></section></section></body></html>"""
PAGE = """<html><h1 class="wi-article-title">2. Blood pressure: Standards of Care 2030 | Journal <span class="x">icon</span></h1><div class="widget-ArticleFulltext"><div class="widget-items"><p>meta</p></div>
<div class="widget-items"><p>Intro text.</p><h2 class="section-title" id="a">2.1 Screening</h2><p>Screen all.</p><div class="table-overflow"><table><tr><td>x</td></tr></table></div><h3 class="section-title" id="b">Tools</h3><p>Use a cuff.</p><script>no()</script>
<div class="ref-list">refs</div><h2 class="section-title" id="c">2.2 Goals</h2><p>Aim.</p></div></div></html>"""


def test_sections_of():
    rows = {r[2]: r for r in extract.sections_of(XHTML, "x")}
    assert list(rows) == ["bodymatter", "s1", "s2"]
    assert rows["s1"][3:8] == ("Goals of care", "1", 2, "bodymatter", ["bodymatter", "s1"])
    assert rows["s2"][3:5] == ("130 people", None) and rows["s2"][8] == "One\nTwo\n\nlines"
    assert rows["s1"][9:] == (["f3"], ["t2"]) and rows["s1"][8].count("[[table:t2]]") == 2 and "[[figure:f3]]" in rows["s1"][8]


def test_chapter_sections():
    rows = extract.chapter_sections(PAGE, "2. Blood pressure.html", "p")
    assert [(r[2], r[3], r[4], r[6]) for r in rows] == [("c02", "Blood pressure", "2", None), ("a", "Screening", "2.1", "c02"), ("b", "Tools", None, "a"), ("c", "Goals", "2.2", "c02")]
    assert rows[1][8] == "Screen all.\n[[table:c02-t01]]" and rows[2][8] == "Use a cuff."
    assert extract.chapter_sections(PAGE, "index.html", "p") == []


def test_markdown_table():
    assert extract.markdown_table([["A", "B"], ["1|2"], [], ["3", "4", "5"]]) == "| A | B |\n|---|---|\n| 1\\|2 |  |\n| 3 | 4 |"
    assert extract.markdown_table([]) == ""


def test_sections_without_id_silence_and_broken_markup():
    page = '<section id="a"><h2>Top</h2>one<section>lost<section id="b"><p>two</section></section><div class="hidden">no<section id="c"><h3>3.1 Deep</h3>three</section></div><span aria-hidden="true">no</span> four<figure>no<a href="x">y</a><a href="t7.xhtml">T</a><a href="t8.xhtml">U</a></figure></section>'
    got = {r[2]: (r[3], r[4], r[7], r[8], r[10]) for r in extract.sections_of(page, "x")}
    assert got == {"a": ("Top", None, ["a"], "one four[[table:t7]]", ["t7"]), "b": ("(no heading)", None, ["a", "b"], "two", []), "c": ("Deep", "3.1", ["a", "c"], "three", [])}
    assert extract.sections_of("", "x") == [] and extract.sections_of("<p>x", "x") == []


def test_assets():
    page = """<div class="fig-section"><div class="fig-label">Figure 1</div><div class="fig-caption">Of <b>care</b></div><img src="/a/b/f1.png"/></div>
    <div class="table-caption">Doses</div><div class="table-overflow"><table><tr><th>A</th></tr><tr><td>1</td></tr></table></div>
    <p>between</p><div class="table-overflow"><table><caption>Own</caption><tr><td>x</td></tr></table></div><div class="fig-section"></div>"""
    got = [r[2:] for r in extract.assets_of(page, "p")]
    assert got == [("figure", 0, "Figure 1", "Of care", "f1.png", None), ("table", 1, "", "Doses", None, "| A |\n|---|\n| 1 |"), ("table", 2, "", "Own", None, "| x |\n|---|"), ("figure", 3, "", "", None, None)]


def test_kept_text_and_natural_order(spark):
    df = spark.createDataFrame([(" x \n",), ("  ",), (None,), ("abcdef",)], "t string")
    assert [r[0] for r in df.select(extract.kept_text(F.col("t"), 3)).collect()] == [None, None, None, "abcdef\n"]
    assert [r[0] for r in df.select(extract.kept_text(F.col("t"))).collect()] == ["x\n", None, None, "abcdef\n"]
    ids = spark.createDataFrame([(x,) for x in ("t10", "t9", "f2", "at1", "x")], "r string")
    assert [r[0] for r in ids.orderBy(*extract.natural_order(F.col("r"))).collect()] == ["at1", "f2", "t9", "t10", "x"]


def test_epub_and_html_files(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "g.epub", "w") as z:
        z.writestr("OEBPS/xhtml/index.xhtml", XHTML)
    nodes = extract.with_children(extract.epub_sections(files.read_epubs(spark, str(tmp_path))))
    assert {r["section_id"]: r["children"] for r in nodes.collect()} == {"bodymatter": ["s1"], "s1": ["s2"], "s2": []}
    (tmp_path / "2. Blood pressure.html").write_text(PAGE)
    (tmp_path / "other.html").write_text(PAGE)
    chapters = files.read_chapters(spark, str(tmp_path))
    assert [r["chapter"] for r in chapters.collect()] == [2]
    assert extract.html_sections(chapters).count() == 4


def test_tree_rules(spark):
    ids = spark.createDataFrame([("g", s) for s in ("s1", "s1a", "s1a2", "s9b3", "x")], "guideline_id string, section_id string")
    assert {r["section_id"]: r["parent_id"] for r in tree.nearest_parent(ids).collect()} == {"s1": None, "s1a": "s1", "s1a2": "s1a", "s9b3": None, "x": None}
    heads = spark.createDataFrame([("1.2. Aim",), ("130 people",), ("12 Plan",), ("Plain",)], "h string").select(tree.heading_number(F.col("h")).alias("x")).select("x.number", "x.title").collect()
    assert [tuple(h) for h in heads] == [("1.2", "Aim"), (None, "130 people"), ("12", "Plan"), (None, "Plain")]
    texts = spark.createDataFrame([(1, "See [[figure:f1]] and [[table:zz]]."), (2, "none"), (3, "")], "text_id int, text string")
    res = spark.createDataFrame([("f1", "figure", "Cap", None, "desc")], "resource_id string, kind string, caption string, markdown string, description string")
    got = {r["text_id"]: r["text"] for r in tree.placeholders(texts, res).collect()}
    assert got == {1: "See [FIGURE f1] Cap\ndesc and [[table:zz]].", 2: "none", 3: ""}
    long = spark.createDataFrame([("word " * 150,), ("x" * 600,), ('"short"',), (None,)], "t string").select(tree.capped_summary(F.col("t"))).collect()
    assert long[0][0].endswith("word…") and len(long[0][0]) <= 500 and len(long[1][0]) == 498 and long[2][0] == "short" and long[3][0] is None


def test_files(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, None)], "id int, t string")
    files.write_jsonl(df, str(tmp_path / "out"))
    with pytest.raises(Exception, match="(?i)exist"):
        files.write_jsonl(df, str(tmp_path / "out"))
    assert files.read_jsonl(spark, str(tmp_path / "out"), "id int, t string").count() == 2
    with pytest.raises(FileExistsError):
        files.assert_absent(spark, str(tmp_path / "out"))
    (tmp_path / "r.json").write_text("{}")
    assert files.free_path(spark, str(tmp_path / "r.json")).endswith("r-2.json")
    for name in ("a", "bench50"):
        (tmp_path / "sets" / name).mkdir(parents=True)
        (tmp_path / "sets" / name / "qa.jsonl").write_text('{"q": 1}\n\n')
    assert files.read_datasets(spark, str(tmp_path / "sets"), "q int").count() == 1
    (tmp_path / "tree.json").write_text(json.dumps({"guideline_id": "g", "nodes": {"a": {"section_id": "a", "title": "A"}, "b": {"section_id": "b", "title": "B"}}}))
    assert [(r["ord"], r["section_id"]) for r in files.read_tree(spark, str(tmp_path / "tree.json"), "section_id: string, title: string").orderBy("ord").collect()] == [(0, "a"), (1, "b")]
    (tmp_path / "sections").mkdir()
    (tmp_path / "sections" / "a.txt").write_text("x\ny\n")
    assert [tuple(r) for r in files.read_section_texts(spark, str(tmp_path / "sections")).collect()] == [("a", "x\ny\n")]
    (tmp_path / "reg.yaml").write_text("guidelines:\n  g: {enabled: true, default: true}\n  h: {enabled: false}\n")
    assert files.read_registry(spark, str(tmp_path / "reg.yaml")).filter("enabled").count() == 1
    (tmp_path / "none.yaml").write_text("guidelines:\n  h: {enabled: false}\n")
    with pytest.raises(ValueError):
        files.read_registry(spark, str(tmp_path / "none.yaml"))
    assert files.provenance(df, query="q").select("meta.query").first()[0] == "q"
    rates = spark.createDataFrame([("bm25", 1, 0.5), ("bm25", 10, None)], "m string, k int, v double")
    assert files.summary_table(rates, "m", "k", "v").splitlines()[-1] == "| bm25 | 0.5000 | – |"


def test_stream_equals_batch(spark, sf_dir, tmp_path):
    e = spark.read.parquet(f"{sf_dir}/events.parquet").orderBy("ts")
    e.repartitionByRange(3, "ts").write.parquet(str(tmp_path / "in"))
    stream = events.sessions(events.once(events.marked(events.read_events(spark, str(tmp_path / "in"), 10))))
    q = stream.writeStream.format("memory").queryName("sessions_out").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    batch = e.groupBy("user_id", F.session_window("ts", "30 minutes")).count().count()
    got = spark.table("sessions_out").count()
    assert 0 < got <= batch and batch - got <= 5
