"""The command line, criteria as data, rankers and window names."""

import pytest
from pyspark.sql import functions as F

from citeloom.__main__ import main
from citeloom.functions.text import FULL, PLAIN, Criteria, normalize
from citeloom.operators import history, retrieval, windows


def test_command_line(spark, sf_dir, tmp_path, capsys):
    assert main(["list"]) == 0 and "verbatim_compliance *" in capsys.readouterr().out.split("\n")
    assert main(["sql", "node_roots"]) == 0 and "parent_id IS NULL" in capsys.readouterr().out
    assert main(["sql", "none"]) == 2 and main(["run", "none", "--data", sf_dir]) == 2
    out = str(tmp_path / "out")
    assert main(["run", "node_roots", "--data", sf_dir, "--out", out]) == 0 and spark.read.parquet(out).count() > 0
    with pytest.raises(FileExistsError):
        main(["run", "node_roots", "--data", sf_dir, "--out", out])
    assert main(["run", "node_roots", "--data", sf_dir, "--out", out, "--overwrite"]) == 0
    assert main(["run", "node_roots", "--data", sf_dir, "--show", "1"]) == 0


def test_criteria_are_data(spark):
    assert Criteria.from_json(FULL.to_json()) == FULL and Criteria.from_json(PLAIN.to_json()) == PLAIN
    own = Criteria.from_json('{"fold_from": "x", "fold_to": "y", "apparatus": ["z"], "nfkc": false}')
    df = spark.createDataFrame([("Axz b",)], "t string")
    assert df.select(normalize(F.col("t"), own)).first()[0] == "ay b"
    for bad in ('{"colour": 1}', '{"fold_from": "ab"}'):
        with pytest.raises(ValueError):
            Criteria.from_json(bad)


def test_window_names():
    assert [windows.pairing_size(w) for w in ("nearest", "block", 3, "4")] == [1, 5, 3, 4]
    for bad in (0, -1, "far", None, "0"):
        with pytest.raises(ValueError):
            windows.pairing_size(bad)


def test_rankers(spark):
    def rank(text):
        if text is None:
            raise RuntimeError("no text")
        return ["a", "b", "a", "zz"] if text else []

    asked = spark.createDataFrame([(1, "x"), (2, ""), (3, None)], "query_id int, text string")
    got = {r["query_id"]: (r["ids"], r["error"]) for r in retrieval.run_ranker(asked, rank, ["a", "b"]).collect()}
    assert got == {1: (["a", "b"], None), 2: ([], None), 3: (None, "RuntimeError: no text")}


def test_usage_with_prices(spark):
    log = spark.createDataFrame([("m", 1, None, 0.5), ("m", 2, None, 0.25), ("n", 3, 4, None), ("n", 1, None, 1.0)], "model string, tokens int, reasoning int, price double")
    got = {r["model"]: (r["n"], r["sum_tokens"], r["sum_reasoning"], r["cost"]) for r in history.usage(log, "model", ["tokens", "reasoning"], "price").collect()}
    assert got == {"m": (2, 3, None, 0.75), "n": (2, 4, 4, None)}
