"""Sentence units: worked cases on a model trained on the test table, and coverage of all text."""

import pytest
from pyspark.sql import functions as F

from citeloom.llm import sentences


@pytest.fixture(scope="module")
def decide(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select(F.lit("document").alias("rec_kind"), F.col("doc_id").alias("rec_id"), "text")
    return sentences.Decider(sentences.train(docs))


CASES = [
    (["Dr. Pellander and Prof. Lindenn saw it in approx. 3.5% of cases.", "Next one!", "Is it? asked nobody."]),
    (["J. R. Kadrell proposed the cut-off that vers. 2.1 of the KUV-1 calculator still uses.[1,2]", '"Is it safe?" was the question that Orvel et al. asked in KIV-2.']),
    (["Take it at 8 a.m. and again at 9 p.m.", "The leaflet says \"take it with food.\"", "(See Suppl. Table 5 of CIP-3 for the 44 sites that withdrew.)", "It went on."]),
    (['The panel wrote: "Do not stop it. Recheck after 3 weeks." in its 2035 summary.', "Rates are in Table 4.", "Others fell."]),
    (["Am 3. Oktober 2046 wurde es u. a. für Schichtarbeiter zugelassen.", "„Ist es sicher? Wann wird kontrolliert?“ fragten die Teilnehmer."]),
    (["« Faut-il arrêter ? Oui. » peut-on lire dans l’art. 10 du rapport 2037.", "Pourquoi cela ?", "Le comité juge."]),
    (["«Suspenda. Llame al médico.» es lo que dice la pág. 11 del folleto.", "¿Cuándo debe suspenderse?", "El Dr. Muntell vio 3 casos."]),
    (["«Можно ли отменить? Нельзя.» — сказано в п. 1 отчёта 2042 г. о препарате.", "Доза мала."]),
]


@pytest.mark.parametrize("want", CASES)
def test_joined_by_a_space(decide, want):
    text = " ".join(want)
    assert [text[a:b] for a, b in sentences.units(text, decide)] == want


def test_without_spaces(decide):
    for want in (["说明书写道：“请勿停用。4周后复查。”并附有表9。", "患者问：“可以停药吗？”", "在研究中下降了29.30%。"], ["患者は「薬をやめてもよいですか？」と尋ねた。", "用量は2.40mg/kg（図10.8参照）を超えてはならない！"], ["用量は2.40mg/kg（図10.8参照）を超えてはならない！", "死亡が30.16%減少した。", "患者に安全か？"]):
        text = "".join(want)
        assert [text[a:b] for a, b in sentences.units(text, decide)] == want


def test_thai_and_lists(decide):
    text = "1. ควรเริ่มยาขนาด342.5มก.ในวัยรุ่น นพ.Bremanderพบการหกล้ม\n- One. Two\n2.4 Heading: aim\n\n| a | 2.5 mg |\r\n \xa0Last \xa0"
    assert [text[a:b] for a, b in sentences.units(text, decide)] == ["1. ควรเริ่มยาขนาด342.5มก.ในวัยรุ่น", "นพ.Bremanderพบการหกล้ม", "- One.", "Two", "2.4 Heading: aim", "| a | 2.5 mg |", "Last"]


def test_units_cover_all_text(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select(F.lit("document").alias("rec_kind"), F.col("doc_id").alias("rec_id"), "text")
    extra = spark.createDataFrame([("claim", 1, None), ("claim", 2, ""), ("claim", 3, " \n\xa0"), ("claim", 4, "x" * 50_000 + ". Y")], "rec_kind string, rec_id long, text string")
    texts = docs.unionByName(extra)
    rows = sentences.split_sentences(texts).collect()
    by = {}
    for r in rows:
        by.setdefault((r["rec_kind"], r["rec_id"]), []).append((r["start_pos"], r["end_pos"]))
    for r in texts.collect():
        text, spans = r["text"] or "", sorted(by.get((r["rec_kind"], r["rec_id"]), []))
        at = 0
        for a, b in spans:
            assert not text[at:a].strip() and a >= at and text[a:b] == text[a:b].strip() and b > a
            at = b
        assert not text[at:].strip()


def test_no_documents(spark):
    empty = spark.createDataFrame([], "rec_kind string, rec_id long, text string")
    assert sentences.split_sentences(empty).count() == 0


def test_words_are_seen_whole():
    """Tokens before and after a stop are not cut, however long they are and wherever their line begins."""
    long = "x" * 5000
    assert sentences._last_words(f"ab {long} cd{long}", 0, 3 + 5000 + 1 + 5002, 2) == [long, f"cd{long}"]
    assert sentences._last_words(f"ab {long}", 0, 5003, 3) == ["ab", long] and sentences._last_words(" \n", 0, 2, 2) == []
    assert sentences._next_word(f"{long}y z", 0) == f"{long}y"
    address = "See www.site.test/" + "a" * 300 + ".Bc and more"
    assert not any(end == address.index(".Bc") + 1 for _, _, end, _ in sentences.candidates(address))


def test_a_long_line_of_many_stops_takes_linear_time():
    import time

    begun = time.process_time()
    n = sum(1 for _ in sentences.candidates("It was so. " * 40_000))
    assert n == 40_000 and time.process_time() - begun < 20
