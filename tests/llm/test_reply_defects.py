"""Defects of replies: worked cases."""

import pytest

from citeloom.llm import reply_defects as d

Q = "How often should kidney function be checked after zolvoridorane is begun in transplant recipients?"
GOOD = "Kidney function should be measured within 6 weeks of starting zolvoridorane in shift workers {{cite:g:s|x}}. Stopping it abruptly raised the risk of falls by 44.1% in ABC-12."


@pytest.mark.parametrize("text", [None, "", " \n", "​", "-", "...", "N/A", "<p></p>", "{}", "[no answer]", " {{cite:g:s|q}}"])
def test_empty(text):
    assert d.is_empty(text)


@pytest.mark.parametrize("text", ["No.", "7", "中"])
def test_not_empty(text):
    assert not d.is_empty(text)


@pytest.mark.parametrize("text", [Q, f"> {Q}", Q.lower().rstrip("?"), f"Question: {Q}", f"{Q}\n{Q}", Q.replace("often ", "")])
def test_copy(text):
    assert d.is_copy(text, Q)


def test_restating_is_no_copy():
    assert not d.is_copy(f"{Q} {GOOD}", Q) and not d.is_copy(GOOD, Q) and not d.is_copy("x", None)


@pytest.mark.parametrize("text", ["It fell from 3.5% to", "It fell. {{cite:g:s|quo", "It fell.\n2. ", "It fell.\n3. **", "In FED-6, readings were labelled \"high", "It was seen by Dr.", "(See Table 5", "It rose by 22."])
def test_truncated(text):
    assert d.is_truncated(text)


@pytest.mark.parametrize("text", [GOOD, "It fell {{cite:g:s|x}}.", "Take it at 9 p.m.", "It is in Table 4.", "See the report of 2036.", "**It fell.**", "它下降了29.3%。", 'He says "take it."', "It fell (ratio 2.60)."])
def test_complete(text):
    assert not d.is_truncated(text)


def test_language():
    assert d.language(GOOD) == "en" and d.language("Die Nierenwerte sind nach Beginn von X zu prüfen") == "de"
    assert d.language("突然停用x会使风险升高1.7%") == "zh" and d.language("xは高齢者に安全か？") == "ja" and d.language("") is None


def test_main_language_is_that_of_most_sentences():
    mixed = GOOD + " 对于合并肥胖的老年患者，可考虑每日一次给予garpralevex 242.5毫克，并在四周内复查肾功能，以免出现跌倒。 Clinicians may lower it to 5 mg if falls appear during the first weeks."
    assert d.language(mixed) == "zh" and d.main_languages(mixed) == {"en"}
    assert d.main_languages("突然停用x会使风险升高1.7%，这一点已由LUCK-1证实。在研究中下降了2%。") == {"zh"} and d.main_languages("") == set()


TOPICS = ["Which dose of zolan is right for children?", "Is abc safe in winter?", "When may mirlubexa be stopped before surgery?", "Can quofentil be combined with hibtor?", "What does the trial say of dranista?"]


def test_operator(spark):
    rows = [(1, None, Q), (2, Q, Q), (3, "I am unable to give advice about zolvoridorane.", Q), (4, GOOD, Q), (5, GOOD[:-3], Q), (6, "突然停用zolvoridorane会使风险升高1.7%。在研究中下降了2%。", Q), (7, GOOD, None), (3, "I am unable to give advice about zolvoridorane.", Q)]
    rows += [(10 + i, f"I am unable to give advice about {t.split()[-1].rstrip('?')}.", t) for i, t in enumerate(TOPICS)]
    rows += [(100 + i, f"The sections give no threshold for drug{i}, but they support these points. {GOOD}", f"Which dose of drug{i}?") for i in range(5)]
    df = spark.createDataFrame(rows, "answer_id long, answer string, question string")
    got = {(r["answer_id"], r["defect_type"]) for r in d.reply_defects(df).collect()}
    assert got == {(1, "empty"), (2, "question_copy"), (3, "refusal"), (5, "truncated"), (6, "other_language")} | {(10 + i, "refusal") for i in range(5)}
    assert d.reply_defects(df.limit(0)).count() == 0


def test_the_row_loaded_last_counts_and_null_columns(spark):
    from datetime import datetime

    rows = [(1, GOOD, Q, None, datetime(2024, 1, 1)), (1, "", Q, "stop", datetime(2024, 1, 2)), (2, GOOD, None, None, None), (None, None, None, None, None)]
    df = spark.createDataFrame(rows, "answer_id long, answer string, question string, finish_reason string, loaded_at timestamp")
    assert {tuple(r) for r in d.reply_defects(df).collect()} == {(1, "empty"), (None, "empty")}


def test_profiles_are_learned_from_tagged_texts(spark):
    it = "Il rene deve essere controllato dopo la prima settimana di terapia e non si può dire che il rischio sia più alto negli anziani"
    nl = "De nier moet worden gecontroleerd na de eerste week van de behandeling en het is niet zo dat het risico hoger is bij ouderen"
    rows = [(f"{k}{i}", t, k) for k, t in (("it", it), ("nl", nl)) for i in range(30)] + [("x", None, "it"), ("y", "abc", None), ("z", "", "und")]
    profile = d.language_profile(spark.createDataFrame(rows, "id string, text string, lang string"))
    assert d.language("Non si può controllare il rene", profile) == "it" and d.language("Het risico is hoger na de behandeling", profile) == "nl"
    assert d.language("The risk of the patients is higher", profile) == "en"
    rows = [(1, "Het risico is hoger na de behandeling en moet worden gecontroleerd.", "Quando si deve controllare il rene dopo la terapia?")]
    df = spark.createDataFrame(rows, "answer_id long, answer string, question string")
    assert {tuple(r) for r in d.reply_defects(df, profile=profile).collect()} == {(1, "other_language")}


def test_entries_without_a_stop_are_complete_if_their_form_recurs(spark):
    rows = [(i, f"{GOOD}\n- Drugname{'abcdef'[i]} {i}5 mg, once daily", f"question number {i} about it?") for i in range(5)]
    rows.append((9, f"{GOOD}\n- Stopping drugnamex abruptly rai", "another one about it?"))
    df = spark.createDataFrame(rows, "answer_id long, answer string, question string")
    assert {tuple(r) for r in d.reply_defects(df).collect()} == {(9, "truncated")}


def test_a_recurring_cut_of_a_common_entry_is_no_form(spark):
    """The same three responses are cut at one place, but most entries that begin alike go on."""
    whole = "- When stable, recheck the patients of the ward every week."
    rows = [(i, f"{GOOD}\n{whole}\n{whole}", f"question number {i} about it?") for i in range(60)]
    rows += [(100 + i, f"{GOOD}\n{whole}\n- When stable, recheck", f"another question {i} about it?") for i in range(3)]
    df = spark.createDataFrame(rows, "answer_id long, answer string, question string")
    assert {tuple(r) for r in d.reply_defects(df).collect()} == {(100 + i, "truncated") for i in range(3)}


def test_openings_cluster(spark):
    words = "one two three four five six seven eight nine ten eleven twelve"
    other = words.replace("twelve", "dozen")
    df = spark.createDataFrame([(words,), (other,), ("quite another opening of a text",)], "opening string")
    got = {r["opening"]: r["cluster"] for r in d.cluster_openings(df).collect()}
    assert len(got) == 3 and got["quite another opening of a text"] == "quite another opening of a text"
