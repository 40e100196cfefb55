"""Byte BPE against the public libraries, container filling, stuffed pages."""

import base64
import random

import numpy as np
import pytest

from citeloom.llm import byte_bpe, container_fill, stuffed_pages

VOCABULARY = byte_bpe.default_vocabulary()


@pytest.fixture(scope="module")
def reference():
    import public_tokenizers as P
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def encoded(texts):
    ids, offsets = byte_bpe.encode_batch(texts, VOCABULARY)
    return [ids[a:b].tolist() for a, b in zip(offsets, offsets[1:])]


def test_bpe_equals_library(reference):
    rng = random.Random(7)
    alphabet = "aab' \n\t'stmdrevll  éπ中 1½_-.…  ​🙂A|<>endoftext"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(4000)]
    texts += ["", None, " ", "\n\n ", "don't we'll 'tis ''s", "<|endoftext|>", "a" * 5000, "x\x00y", "ok\n", "нет 你好 กขค 12345"]
    assert encoded(texts) == [reference.encode_ordinary(t or "") for t in texts]


def test_bpe_decodes_back(reference):
    texts = ["Naïve café — 5 mg\r\n", "क्या 🙂👍🏽"]
    assert [reference.decode(x) for x in encoded(texts)] == texts


def test_bpe_operator(spark, reference):
    df = spark.createDataFrame([(1, "a b", "z"), (2, "", None), (3, None, "q"), (1, "a b", "z")], "doc_id long, text string, ids string")
    got = sorted((r["doc_id"], r["ids"]) for r in byte_bpe.encode_texts(df, "doc_id", "text", VOCABULARY).collect())
    assert got == [(1, reference.encode_ordinary("a b"))] * 2 + [(2, []), (3, [])]
    n = byte_bpe.encode_texts(df, "doc_id", "text", VOCABULARY, counts_only=True)
    assert sorted(tuple(r) for r in n.collect()) == [(1, 2), (1, 2), (2, 0), (3, 0)]
    assert byte_bpe.encode_texts(df.limit(0), "doc_id", "text", VOCABULARY).count() == 0


def test_chunks_are_bounded_and_whole():
    texts = ["a" * 5, None, "b" * 20, "c"]
    got = list(byte_bpe.chunks(texts, most=10))
    assert got == [(0, 2), (2, 3), (3, 4)] and list(byte_bpe.chunks([])) == []


def test_fullest_against_all_subsets():
    rng = random.Random(1)
    for _ in range(60):
        sizes = [rng.randint(1, 30) for _ in range(rng.randint(1, 9))]
        room = rng.randint(1, 60)
        best = max(s for m in range(1 << len(sizes)) if (s := sum(x for i, x in enumerate(sizes) if m >> i & 1)) <= room)
        counts = {s: sizes.count(s) for s in sizes}
        got = container_fill.fullest(counts, room)
        assert sum(s * n for s, n in got.items()) == best and all(n <= counts[s] for s, n in got.items())


def test_fill(spark):
    rng = random.Random(2)
    rows = [(i, rng.randint(1, 100)) for i in range(500)] + [(1000, 0), (1001, None), (1002, 250), (1003, 200), (1, 7)] + [(2000 + i, 33) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, n long")
    got = container_fill.fill_containers(df, "id", "n", 100, rows_per_bucket=50).collect()
    whole, loads = {}, {}
    for r in got:
        if r["size"]:
            loads[r["container_id"]] = loads.get(r["container_id"], 0) + r["size"]
            whole[r["item_id"]] = whole.get(r["item_id"], 0) + r["size"]
    assert max(loads.values()) <= 100
    want = {}
    for i, n in rows:
        if n:
            want[i] = want.get(i, 0) + n
    assert whole == want
    assert {r["item_id"] for r in got if r["container_id"] is None} == {1000, 1001}
    assert len(loads) <= 1.02 * sum(want.values()) / 100 + 1
    assert sum(1 for r in got if r["item_id"] == 1002) == 3
    assert container_fill.fill_containers(df.limit(0), "id", "n", 100).count() == 0
    with pytest.raises(ValueError):
        container_fill.fill_containers(df, "id", "n", 0)


NORMAL = "The panel rated the certainty for {d} in {c} as moderate, because the trial enrolled only {n} people and the result was not seen in all of them. Kidney function should be measured within {n} weeks of starting {d} in adults."


def test_stuffed_pages(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("bdfglmnprstvz") + rng.choice("aeiou") for _ in range(4))
    pages = [(i, " ".join(NORMAL.format(d=word(), c=rng.choice(["asthma", "gout", "stroke"]), n=rng.randint(1, 99)) for _ in range(4)), "en") for i in range(60)]
    spam = ["zolanbo buy zolanbo price zolanbo cheap online zolanbo order zolanbo buy price zolanbo online " * 4, "\n".join(f'<a href="http://shop.test/{i}">buy {word()}</a>' for i in range(12)), "#Zolanbo #BuyZolanbo #ZolanboPrice #Price #Zolanbo #BuyZolanbo #ZolanboBuy #Price #Buy", NORMAL.format(d="x", c="y", n=1) + "\n" + "zolanbo order cheap zolanbo best price zolanbo " * 25]
    rows = pages + [(100 + i, t, "en") for i, t in enumerate(spam)] + [(200, spam[0], None), (300, None, "en"), (301, "", "en"), (302, " \n", "EN"), (100, spam[0], "en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert {r["doc_id"] for r in stuffed_pages.stuffed_pages(df).collect()} == {100, 101, 102, 103, 200}
    assert stuffed_pages.stuffed_pages(df.limit(0)).count() == 0


def test_page_words():
    assert stuffed_pages.page_words("#BuyZolan http://x.test/a <b>Now</b> 5 mg 中文") == ["buy", "zolan", "now", "mg", "中", "文"]
    assert np.isclose(stuffed_pages.page_features("one two two two", frozenset(["one"]))[0], 0.75)
