"""Openings of replies: near-equal ones cluster, and clusters are whole components."""

from citeloom.llm import reply_defects as d

LONG = [f"{a}{b}" for a in ("ka", "lo", "mi", "nu", "pe", "ra") for b in ("bat", "dor", "fen", "gil", "hum", "jat", "kel", "lom", "nib")][:50]


def test_one_changed_word_of_a_full_opening_clusters(spark):
    a, b = (d.clauses(" ".join(x), None)[0][0][0] for x in (LONG, [*LONG[:24], "changed", *LONG[25:]]))
    df = spark.createDataFrame([(a,), (b,), ("quite another opening of a text",)], "opening string")
    got = {r["opening"]: r["cluster"] for r in d.cluster_openings(df).collect()}
    assert a != b and len(got) == 3 and got[a] == got[b] == min(a, b)


def test_short_names_of_the_prompt_are_masked():
    said = "The sections give no threshold for {}, but they support this."
    assert len({str(d.clauses(said.format(x), f"Which dose of {x} is safe?")) for x in ("zolan", "abc", "bix", "mirlubexa")}) == 1
    assert d.clauses(said.format("zolan"), "Is the zolan safe?") == d.clauses(said.format("abc"), "What of abc?") == ([("the sections give no threshold for _", 7), ("but they support this", 4)], 11)
    assert d.clauses("我无法回答关于高血压病的问题。", "高血压病如何治疗？")[0][0][0] == d.clauses("我无法回答关于糖尿病的问题。", "糖尿病如何治疗？")[0][0][0]


def test_members_that_fail_against_one_hub_still_cluster(spark):
    # Neighbours share 0.8 or more, the ends do not; the smallest opening of a bucket is none of their kind.
    chain = [" ".join(LONG[:k] + [f"{w}x" for w in LONG[k:]]) for k in (50, 49, 48, 47, 46, 45, 44, 43, 42, 41, 40, 39, 38)]
    df = spark.createDataFrame([(x,) for x in [*chain, "aaa " + " ".join(LONG[20:40])]], "opening string")
    got = {r["opening"]: r["cluster"] for r in d.cluster_openings(df).collect()}
    assert {got[x] for x in chain} == {min(chain)} and len(got) == len(chain) + 1


def test_components_run_to_the_end(spark):
    n = 40
    links = spark.createDataFrame([(f"{i + 1:03d}", f"{i:03d}") for i in range(n)] + [("y", "x")], "opening string, hub string")
    got = {r["opening"]: r["cluster"] for r in d._components(links).collect()}
    assert got == {f"{i:03d}": "000" for i in range(n + 1)} | {"x": "x", "y": "x"}


def test_pairs_of_similar_texts_meet(spark):
    """Recall of the links against all pairs: at least 0.99 of the pairs with a similarity of 0.8 or more end in one cluster."""
    import random

    rng = random.Random(3)
    base = [[rng.choice(LONG) for _ in range(rng.randint(3, 50))] for _ in range(60)]
    texts = {" ".join(b) for b in base} | {" ".join([*b[:k], "other", *b[k + 1 :]]) for b in base for k in (0, len(b) // 2, len(b) - 1)}
    got = {r["opening"]: r["cluster"] for r in d.cluster_openings(spark.createDataFrame([(t,) for t in texts], "opening string")).collect()}
    parts = {t: d._parts(t) for t in texts}
    pairs = [(a, b) for a in texts for b in texts if a < b and len(parts[a] & parts[b]) >= 0.8 * len(parts[a] | parts[b])]
    assert len(pairs) > 50 and sum(got[a] == got[b] for a, b in pairs) >= 0.99 * len(pairs)


TOPICS = [("zolan", "Which dose of zolan is right for children?"), ("abc", "Is abc safe in winter?"), ("mirlubexa", "When may mirlubexa be stopped before surgery?"), ("quofentil", "Can quofentil be combined with tea?"), ("hibtor", "What does the trial say of hibtor?")]


def defects(spark, rows):
    df = spark.createDataFrame(rows, "answer_id long, answer string, question string")
    return {tuple(r) for r in d.reply_defects(df).collect()}


def test_members_of_a_recurring_refusal_are_refusals_whatever_they_carry(spark):
    long = "I am unable to answer this for {}. " + " ".join(LONG) + ". " + " ".join(x + "y" for x in LONG[:40]) + "."
    kinds = ["I searched all sections and nothing was found about {} that I could use.", "No passage that was loaded deals with {}, so I cannot answer for now.", long]
    rows = [(100 * k + i, text.format(x), asked) for k, text in enumerate(kinds) for i, (x, asked) in enumerate(TOPICS)]
    rows.append((900, kinds[1].format("dranista") + " {{cite:g:s|x}}", "How long is dranista taken?"))
    rows.append((901, kinds[0].format("dranista") + " I looked at 12 of them.", "How long is dranista taken?"))
    assert defects(spark, rows) == {(r[0], "refusal") for r in rows}


def test_a_new_opening_is_a_refusal_if_it_has_a_learned_clause(spark):
    rows = [(i, f"I cannot answer that, please ask a doctor about {x}.", asked) for i, (x, asked) in enumerate(TOPICS)]
    rows.append((10, "I cannot answer that; call 112.", "Is fenol safe for my dog?"))
    rows.append((11, "I cannot answer that, but the general section says: take 5 mg with water in the morning, and 7 mg in the evening after the last meal of the day.", "Is fenol safe for my dog?"))
    assert defects(spark, rows) == {(i, "refusal") for i in (*range(5), 10)}


def test_good_short_answers_are_no_refusals_even_if_they_recur(spark):
    rows = [(i, f"Yes. {x.capitalize()} is preferred in this setting because it lowers mortality.", asked) for i, (x, asked) in enumerate(TOPICS)]
    rows += [(10, "Take it with food in the morning.", "When is zolan taken?"), (11, "Yes, after a meal.", "Is abc taken late?")]
    assert defects(spark, rows) == set()


def test_without_clusters_there_are_no_refusals(spark, monkeypatch):
    """The result hangs on the clusters: without those that recur nothing is a refusal."""
    rows = [(i, f"I cannot answer that, please ask a doctor about {x}.", asked) for i, (x, asked) in enumerate(TOPICS)]
    df = spark.createDataFrame(rows, "answer_id long, answer string, question string")
    assert d.reply_defects(df).count() == 5 and d.reply_defects(df, least_prompts=6).count() == 0


def test_a_finish_reason_is_evidence_of_a_template_only(spark):
    rows = [(i, f"The matter of {x} stays with the ward.", asked, "content_filter") for i, (x, asked) in enumerate(TOPICS)]
    rows += [(10, "The matter of fenol stays with the ward.", "Is fenol safe for my dog?", "stop"), (11, "Take it with food.", "Is it taken late?", "refusal")]
    df = spark.createDataFrame(rows, "answer_id long, answer string, question string, finish_reason string")
    assert {tuple(r) for r in d.reply_defects(df).collect()} == {(i, "refusal") for i in (*range(5), 10)}
