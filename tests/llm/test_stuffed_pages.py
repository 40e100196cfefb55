"""Stuffed pages: what the corpus has in common, phrases, and languages with few pages."""

import random

from citeloom.llm import stuffed_pages as s

NORMAL = "The panel rated the certainty for {d} in {c} as moderate, because the trial enrolled only {n} people and the result was not seen in all of them. Kidney function of patients with diabetes should be measured within {n} weeks of starting {d} in adults."


def ordinary(n, seed=4):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("bdfglmnprstvz") + rng.choice("aeiou") for _ in range(4))
    return [" ".join(NORMAL.format(d=word(), c=rng.choice(["asthma", "gout", "stroke"]), n=rng.randint(1, 99)) for _ in range(2)) for _ in range(n)]


def found(spark, rows):
    return {r["doc_id"] for r in s.stuffed_pages(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}


def test_a_page_that_repeats_a_common_word_is_found(spark):
    rows = [(i, t, "en") for i, t in enumerate(ordinary(60))]
    assert found(spark, [*rows, (100, "diabetes patients diabetes adults diabetes weeks patients diabetes " * 6, "en")]) == {100}


def test_copies_of_a_page_do_not_make_its_keywords_common(spark):
    spam = "zolanbo buy zolanbo price zolanbo cheap online zolanbo order zolanbo buy price zolanbo online " * 4
    rows = [(i, t, "en") for i, t in enumerate(ordinary(60))]
    assert found(spark, rows + [(100 + i, spam, "en") for i in range(40)]) == set(range(100, 140))


def test_words_are_common_in_their_own_language_only():
    known = s.by_word({"en": {"the": 0.1, "of": 0.1, "die": 0.01}, "de": {"die": 0.1, "und": 0.1, "der": 0.1}})
    assert s.page_usual(["die", "und", "der", "x"], "de", known) == {"die": 0.1, "und": 0.1, "der": 0.1}
    assert s.page_usual(["the", "of", "die"], "en", known) == {"the": 0.1, "of": 0.1, "die": 0.01}
    assert s.page_usual(["die", "und", "der"], "en", known)["und"] == 0.1


def test_a_language_with_few_pages_is_judged_alike(spark):
    ordinary_de = "Die Werte und die Dosis sind in der Praxis und in der Klinik und in der Ambulanz und in der Stadt zu prüfen, wenn die Niere oder die Leber und der Puls in der Studie nicht gut sind. "
    spam = "zolanbo kaufen zolanbo preis zolanbo billig kaufen zolanbo preis " * 3
    for n in (3, 12):
        rows = [(i, ordinary_de + t, "de") for i, t in enumerate(f"Punkt {x} ist hier neu und wichtig." for x in range(n))]
        assert found(spark, [*rows, (100, spam, "de")]) == {100}


def test_links_with_long_labels_count():
    page = "\n".join(f'<a href="http://shop.test/{i}">{"long label of words " * 30}</a>' for i in range(3)) + "\n" + "\n".join(f"[{'label ' * 80}](/x/{i})" for i in range(3))
    assert s._link_share(page) > 0.95
    assert s._link_share("<a href='x'>" * 3000 + "[" * 3000) < 0.5


def test_phrases_of_a_page_count():
    assert s._again("one two three four one two three five".split())[0] == 2 / 6
    assert s._again([]) == (0.0, 0.0)


def test_a_page_of_phrases_is_found_and_function_words_protect(spark):
    rows = [(i, t, "en") for i, t in enumerate(ordinary(60))]
    phrases = ["buy cheap zolanbo tablets online", "order best mirtane capsules today", "get discount peltaro pills delivered"]
    spam = " ".join(phrases * 4)
    plain = "It was seen in the trial that the dose of the drug in the morning is not the dose of the drug in the evening and that it should be taken with water. " * 4
    assert found(spark, [*rows, (100, spam, "en"), (101, plain, "en")]) == {100}


def test_a_very_short_page_is_judged_too(spark):
    rows = [(i, t, "en") for i, t in enumerate(ordinary(60))]
    assert found(spark, [*rows, (100, "zolanbo zolanbo zolanbo", "en"), (101, "Kidney function", "en")]) == {100}


def test_signs_belong_to_words():
    assert s.page_words("अधिक न हो") == ["अधिक", "हो"]


def test_limits_move_with_the_pages_of_a_language(spark):
    rows = [("en", str(i), *[0.1] * 9, 0.9) for i in range(80)] + [("xx", str(i), *[0.1] * 9, 0.9) for i in range(2)]
    got = {r["language"]: r for r in s._limits(spark.createDataFrame(rows, s.FEATURES), 20).collect()}
    assert abs(got["en"]["weight"] - 0.8) < 1e-9 and s.BOUNDS["top"][0] < got["en"]["top_limit"] < got["xx"]["top_limit"] < s.BOUNDS["top"][1]
    assert got["xx"]["function_limit"] >= s.BOUNDS["function"][0]
