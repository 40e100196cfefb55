"""Partners of the null control are looked for among all rows."""

from citeloom.operators import recovery


def test_partner_beyond_a_run_of_rows_that_share_a_document(spark):
    rows = [(i, ["hot", f"d{i}"], i) for i in range(200)] + [(200, ["cold"], 200)]
    df = spark.createDataFrame(rows, "row_id long, read_set array<string>, place long")
    got = {r["row_id"]: r["partner_id"] for r in recovery.unrelated_partners(df).collect()}
    assert got == {i: 200 for i in range(200)} | {200: 0}
    assert recovery.unrelated_partners(df.filter("row_id < 3")).count() == 0


def test_groups(spark, sf_dir):
    from citeloom.plans import registry

    got = {r["which"]: r for r in registry.QUERIES["null_control"](spark, sf_dir).collect()}
    assert set(got) == {"own", "unrelated", "verified"}
    assert got["verified"]["median_ratio"] > got["own"]["median_ratio"] >= got["unrelated"]["median_ratio"]
