"""Shared spans against brute force over windows."""

import random
from collections import defaultdict

import numpy as np
import pytest

from citeloom.llm import shared_spans


def brute(records, least):
    seen = defaultdict(set)
    for key, text in records.items():
        for p in range(len(text or "") - least + 1):
            seen[text[p : p + least]].add(key)
    out = set()
    for (kind, i), text in records.items():
        cover = [False] * len(text or "")
        for p in range(len(text or "") - least + 1):
            if len(seen[text[p : p + least]]) > 1:
                cover[p : p + least] = [True] * least
        start = None
        for p, c in enumerate([*cover, False]):
            if c and start is None:
                start = p
            elif not c and start is not None:
                out.add((kind, i, start, p))
                start = None
    return out


def run(spark, records, least, **options):
    df = spark.createDataFrame([(k, i, t) for (k, i), t in records.items()], "rec_kind string, rec_id long, text string")
    rows = shared_spans.shared_spans(df, least, **options).collect()
    assert len(rows) == len(set(rows))
    return {tuple(r) for r in rows}


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcé中 ") for _ in range(rng.randint(2, 9)))
    passages = ["".join(word() for _ in range(60))[: rng.randint(60, 200)] for _ in range(6)] + ["x" * 130, "ab" * 90]
    records = {}
    for i in range(40):
        text = "".join(rng.choice(passages) if rng.random() < 0.4 else word() for _ in range(rng.randint(1, 12)))
        if rng.random() < 0.3 and len(text) > 80:
            cut = rng.randrange(20, len(text) - 20)
            text = text[cut:] + text[:cut]
        records[("unit", i)] = text
    records |= {("citation", 1): None, ("citation", 2): "", ("lookup", 1): records[("unit", 3)], ("lookup", 2): records[("unit", 3)]}
    wanted = brute(records, 70)
    assert run(spark, records, 70, shard_phrases=15) == wanted
    # Every phrase hot, and some: the windows of all contexts are compared instead of the contexts.
    assert run(spark, records, 70, group_contexts=1) == wanted
    assert run(spark, records, 70, group_contexts=12) == wanted


def test_many_contexts_of_one_phrase(spark):
    """More contexts than are compared by pairs, and one text in a third of all records."""
    rng = random.Random(5)
    phrase = "".join(rng.choice("abcdefgh ") for _ in range(90))
    records = {("unit", i): "".join(rng.choice("xyz ") for _ in range(i % 40)) + phrase[i % 7 :] + "".join(rng.choice("uvw ") for _ in range(i % 30)) for i in range(40)}
    records |= {("citation", i): phrase for i in range(20)}
    wanted = brute(records, 70)
    assert wanted and run(spark, records, 70) == wanted
    assert run(spark, records, 70, group_contexts=5) == wanted


def test_only_inside_one_record(spark):
    assert run(spark, {("unit", 1): "abcdefghij" * 40, ("unit", 2): "".join(map(chr, range(300, 700)))}, 150) == set()


def test_empty_and_null(spark):
    assert run(spark, {("unit", 1): None, ("unit", 2): ""}, 150) == set()


def test_shares(spark):
    text = "".join(map(chr, range(300, 500)))
    df = spark.createDataFrame([("a", 1, text), ("b", 1, text + "zz"), ("c", 1, ""), ("d", 1, None)], "rec_kind string, rec_id long, text string")
    got = {r["rec_kind"]: (r["shared_chars"], r["share"]) for r in shared_spans.shared_shares(df, shared_spans.shared_spans(df, 150)).collect()}
    assert got == {"a": (200, 1.0), "b": (200, 200 / 202), "c": (0, None), "d": (0, None)}


def test_hashes_depend_on_content_only():
    c = shared_spans._codes("some text that is moved along by other text")
    d = shared_spans._codes("xyz" + "some text that is moved along by other text")
    assert (shared_spans._hashes(c, 10, 1) == shared_spans._hashes(d, 10, 1)[3:]).all()
    v = np.random.default_rng(1).integers(0, 1 << 60, 57, dtype=np.uint64)
    assert shared_spans._sliding(v, 9, np.minimum).tolist() == [v[i : i + 9].min() for i in range(49)]


def test_least_is_checked(spark):
    with pytest.raises(ValueError):
        run(spark, {("unit", 1): "a"}, 10)
