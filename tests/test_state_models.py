"""Kept tables, stages, reports and the steps around model replies."""

import json

import pytest
from pyspark.sql import functions as F

from citeloom.functions.text import percentage, release_dir
from citeloom.operators import guards, models
from citeloom.sources import files


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


def test_reports_and_paths(spark, tmp_path):
    path = str(tmp_path / "a" / "report.json")
    files.assert_absent(spark, None)
    files.write_report(spark, {"b": 1, "a": "é"}, path)
    assert json.loads(files.read_text(spark, path)) == {"b": 1, "a": "é"} and files.read_text(spark, path + "x") is None
    with pytest.raises(FileExistsError):
        files.write_report(spark, {}, path)
    files.write_report(spark, {}, path, overwrite=True)
    assert files.exists(spark, "file://" + path) and files.free_path(spark, path).endswith("report-2.json")
    assert rows(files.manifest(spark, str(tmp_path / "a")))[0][:2] == ("report.json", 3)
    (tmp_path / "a" / "x.txt").write_text("x")
    assert files.clear_outputs(spark, str(tmp_path / "a"), (".txt", ".html")) == 1 and files.exists(spark, path)
    assert files.clear_outputs(spark, str(tmp_path / "none"), (".txt",)) == 0


def test_kept_table(spark, tmp_path):
    cache = files.vector_cache(spark, str(tmp_path / "v"))
    assert cache.read().count() == 0
    given = spark.createDataFrame([("m", "t1", [1.0]), ("m", "t1", [1.0]), ("m", "t2", [2.0])], "m string, t string, embedding array<float>").withColumn("key", files.vector_key(F.col("m"), F.col("t")))
    cache.add(given)
    cache.add(given)
    assert cache.read().count() == 2 and all(len(r["key"]) == 16 for r in cache.read().collect())


def test_stages(spark, tmp_path):
    stages, log = files.Stages(spark, str(tmp_path / "state.json"), ("extract", "describe", "summarize")), []
    for name in stages.order:
        assert stages.run(name, lambda name=name: log.append(name))
    assert not stages.run("describe", lambda: log.append("again"))
    assert stages.run("describe", lambda: log.append("forced"), force=True)
    assert set(stages.done()) == {"extract", "describe"} and log == ["extract", "describe", "summarize", "forced"]
    files.write_text(spark, "{broken", str(tmp_path / "state.json"), overwrite=True)
    assert stages.done() == {}


def test_registry_and_meta(spark, tmp_path):
    registry = spark.createDataFrame([("a", "epub", True), ("b", "html", True), ("c", "epub", False)], "guideline_id string, source_type string, enabled boolean")
    assert rows(files.list_available(registry, "epub")) == [("a",)]
    meta = spark.createDataFrame([("a", "f1", "cap")], "guideline_id string, resource_id string, caption string")
    files.save_resource_meta(meta, str(tmp_path / "m"))
    with pytest.raises(Exception, match="(?i)exist"):
        files.save_resource_meta(meta, str(tmp_path / "m"))


def test_claim_filter(spark):
    replies = spark.createDataFrame([("r", 0, 3, '{"claim_numbers": [1, 3, 3, 9, 0]}'), ("r", 1, 3, '{"claim_numbers": [1]}'), ("r", 2, 3, None)], "item string, round int, n int, reply string")
    votes = models.sentence_votes(replies)
    kept = models.keep_claims(votes.select(F.concat_ws("-", "item", "number").alias("item"), "vote"))
    assert dict(rows(kept)) == {"r-1": True, "r-2": False, "r-3": False}


def test_adjudication(spark):
    pairs = spark.createDataFrame([(1, "c", 0, "a"), (1, "c", 2, "b"), (1, "c", 3, "a"), (2, "d", 0, "x")], "claim_id int, claim string, marker_idx int, quote string")
    assert rows(models.adjudication_requests(pairs, True), "claim_id") == [(1, "c", "a\n\nb"), (2, "d", "x")]
    assert models.adjudication_requests(pairs, False).count() == 3
    judged = models.verdicts(spark.createDataFrame([(1, '{"support_verdict": "fully_supported"}'), (1, None), (2, '{"support_verdict": "partially_supported"}'), (3, "oops")], "claim_id int, reply string"))
    assert rows(models.adjudicated(judged), "claim_id") == [(1, True, True), (2, False, True), (3, False, False)]


def test_localiser_extractor_lookup(spark):
    atoms = spark.createDataFrame([(1, 0, "rule 0"), (1, 1, "rule 1"), (2, 0, "rule 2")], "answer_id long, marker_idx long, claim string")
    replies = spark.createDataFrame([(1, '{"claims": [{"n": 2, "claim": "better"}, {"n": 1, "claim": " "}]}'), (2, None)], "answer_id long, reply string")
    assert [r[2] for r in rows(models.located_claims(replies, atoms), "answer_id", "marker_idx")] == ["rule 0", "better", "rule 2"]
    assert rows(models.extracted_claims(spark.createDataFrame([(1, '{"claims": [" a ", "", "b"]}'), (2, "x")], "answer_id long, reply string")), "place") == [(1, 0, "a"), (1, 2, "b")]
    got = models.lookups(spark.createDataFrame([('{"found": true, "evidence": ["a", " "]}',), ('{"found": false, "evidence": ["a"]}',), ("?",)], "reply string"))
    assert [(r["found"], r["spans"]) for r in got.collect()] == [(True, ["a"]), (False, []), (None, [])]


def test_descriptions_and_routes(spark):
    items = spark.createDataFrame([("a",), ("b",), ("c",)], "id string")
    done, left = models.described(items, "id", spark.createDataFrame([("a", "old")], "id string, description string"), spark.createDataFrame([("a", "new"), ("b", "made"), ("c", " ")], "id string, description string"))
    assert rows(done, "id") == [("a", "old"), ("b", "made"), ("c", None)] and rows(left) == [("c",)]
    routes = spark.createDataFrame([("x", "v1", "e1"), ("x-large", "v2", "e2")], "prefix string, vendor string, endpoint string")
    asked = spark.createDataFrame([("x-large-2",), ("x1",), ("y",)], "model string")
    assert rows(models.routed(asked, routes), "model") == [("x-large-2", "v2", "e2"), ("x1", "v1", "e1"), ("y", None, None)]


def test_guards(spark):
    for bad in (lambda: guards.check_funnel_inputs("any", "compliant"), lambda: guards.check_funnel_inputs("set", "none"), lambda: guards.check_rounds(2), lambda: guards.check_settings({"top_p": 1}), lambda: guards.check_seeds([1, 1]), lambda: guards.check_seeds([None, 1]), lambda: guards.check_labels(("a",), ("a", "b")), lambda: guards.check_lookup_report("node", "j", "j", ["m"], "m"), lambda: guards.check_lookup_report("readset", "j", "k", ["m"], "m"), lambda: guards.check_lookup_report("readset", "j", "j", ["m"], "x")):
        with pytest.raises(ValueError):
            bad()
    guards.check_funnel_inputs("set", "compliant"), guards.check_rounds(3), guards.check_settings({"seed": 1}), guards.check_seeds([1, 2]), guards.check_labels(("a", "b"), ("b", "a")), guards.check_lookup_report("readset", "j", "j", ["m"], "m")
    df = spark.createDataFrame([(1, [True, None], 1), (2, None, None)], "id int, votes array<boolean>, dropped int")
    assert rows(guards.dropped_share(df, F.col("votes"), F.col("dropped"))) == [(3, 1, 1 / 3, True)]
    assert rows(guards.dropped_share(df.limit(0), F.col("votes"), F.col("dropped"))) == [(None, None, 0.0, False)]
    known = spark.createDataFrame([(1,)], "id int")
    assert rows(guards.must_have(df.select("id").filter("id = 1"), known, "id")) == [(1,)]
    with pytest.raises(Exception, match="id is not known: 2"):
        guards.must_have(df.select("id"), known, "id").collect()
    questions = spark.createDataFrame([(1, "q"), (2, " ")], "id int, question string")
    assert rows(guards.asked(known, questions, ["id"], "question")) == [(1, "q")]
    with pytest.raises(Exception, match="blank"):
        guards.asked(df.select("id"), questions, ["id"], "question").collect()
    assert rows(guards.stray_share(df.select("id"), known, ["id"])) == [(2, 1, True)]


def test_small_forms(spark):
    df = spark.createDataFrame([(0.1234, "v/m-1.5", "unit"), (None, "m", " "), (0.00125, "m", None)], "r double, m string, g string")
    assert rows(df.select(percentage(F.col("r")), release_dir(F.col("m"), F.col("g")))) == [("12.3%", "m-1pt5_unit"), ("n/a", "m"), ("0.1%", "m")]


def test_written_tables_are_released(spark):
    from citeloom import session

    session.release(spark)
    df = session.materialise(spark.range(3), "released")
    path = df.inputFiles()[0].rsplit("/", 1)[0]
    assert df.count() == 3 and files.exists(spark, path) and session.release(spark) == 1
    assert not files.exists(spark, path) and session.release(spark) == 0
