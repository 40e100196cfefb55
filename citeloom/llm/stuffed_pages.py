"""Keyword-stuffed pages and link lists.

A page is judged by its shares: of the words it repeats (keywords instead of function words), of its top such word, of
phrases that come again, of repeated lines, of separators, of text inside links, and of the function words that ordinary
text has. All limits are calibrated for each language on its distinct texts of varied wording, so that neither copies nor
stuffed pages move them: a limit is what is far from usual there, between fixed bounds, and a language weighs by its pages
against ``prior_pages`` pages with the bounds that ask for most. So no number of pages switches a rule on or off.

The words that a language has in common (those in ``common_share`` of its pages, and a short list for ten languages) are no
keywords up to the share of a page that is usual for each; beyond it, in a page of little variety, they count like others.
Up to that share they are what an ordinary page is not without. The common words that hold for a page are those of its
language tag and of the languages its own words show.

A page is a case if much of its text is links, or if it lacks function words and its words repeated three times make up most
of it, or those repeated at all do, or the repeated words pass a lower limit and a top word, a top phrase, separators or
repeated lines confirm it, or most of its phrases come again in a page of little variety. Reference lists, glossaries and
tables of contents repeat many words a little and none much. Null, empty and blank texts are no case; rows that repeat an id
count once; a copy under another id is judged like its original. The common words held by each task are those in
``common_share`` of the pages of a language, so at most 1 / ``common_share`` times the words of its mean page.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeloom.llm.reply_defects import COMMON
from citeloom.session import materialise

#: Vowel signs and accents, which are part of the word they stand in.
_SIGNS = "".join(chr(c) for c in range(0x300, 0xFE30) if unicodedata.category(chr(c)) in ("Mn", "Mc"))
_LETTER = r"[^\W\d_぀-ヿ㐀-鿿]"
_WORD = re.compile(rf"[぀-ヿ㐀-鿿]|(?:{_LETTER}[{_SIGNS}]|{_LETTER}{{2}}){_LETTER}*(?:[{_SIGNS}]+{_LETTER}*)*(?:[’'][^\W\d_]+)*(?![\d_])")
_LINK = re.compile(r"<a\s[^>]*>(?:[^<]|<(?!/?a[\s>]))*</a>|!?\[[^\[\]\n]*\]\([^()\s]*\)|(?:https?://|www\.)\S+")
_ADDRESS = re.compile(r"<[^<>]*>|\]\([^)\s]*\)|(?:https?://|www\.)\S+")
_JOINED = re.compile(r"(?<=[^\W\d_A-ZА-ЯÀ-Þ])(?=[A-ZА-ЯÀ-Þ])")
_SEPARATORS = ("|", "/", "·", "»", "«", "#", ";", "•", "★", "☆", " – ", " — ", " - ")
FORM = ("lines", "separators", "links", "variety")
SHARES = ("repeated", "twice", "top", "phrases", "phrase", "function", *FORM)
FEATURES = "language string, digest string, " + ", ".join(f"{c} double" for c in SHARES)
#: Words of a block whose variety is measured, the variety of ordinary wording, the deviations and the most that is usual of a common word.
BLOCK, PLAIN, DEVIATIONS, MOST_USUAL = 50, 0.6, 5.0, 0.25
#: For each share the least and the most that its limit can be; where a language has no pages, the most (of ``function``, the least) holds.
BOUNDS = {"repeated": (0.25, 0.45), "twice": (0.6, 0.75), "top": (0.13, 0.2), "phrases": (0.6, 0.8), "phrase": (0.4, 0.5), "lines": (0.4, 0.5), "separators": (0.2, 0.4), "links": (0.4, 0.5), "function": (0.2, 0.4)}
#: The repeated share beyond which no other sign is asked for.
MOST_REPEATED = 0.45
#: Function words, and the share up to which one is no keyword where its language does not show another.
FUNCTION_SHARE = 0.12
FUNCTION_WORDS = COMMON | {
    "ru": "и в во не на с со что по к ко за из у о от до для при как или это если то но а бы ли же после через может быть есть был была были следует нельзя",
    "ar": "في من على إلى أن عن مع لا ما هو هي هذا هذه التي الذي كان كانت بعد قبل عند أو قد لم كل بين يمكن يجب",
    "hi": "के की का में है हैं से को और पर यह या ने एक तो भी नहीं कि जो इस लिए कर किया गया बाद होने सकता सकती",
    "zh": "的 在 是 了 和 有 不 与 为 可 应 用 以 对 者 或 中 后 于 一 若 其 及 及 未 能 时",
    "ja": "の に は を た が で て と し れ さ る い あ も な ら り か ま す こ よ",
    "th": "และ ใน ที่ ของ เป็น ไม่ มี ได้ ให้ จาก กับ หรือ การ ควร",
}


def page_words(text: str) -> list[str]:
    """Words in lower case, without addresses; words run together in a tag are taken apart."""
    return _words(_shown(text))


def _shown(text: str) -> str:
    return _ADDRESS.sub(" ", text) if "/" in text or "<" in text else text


def _words(shown: str) -> list[str]:
    return _WORD.findall((_JOINED.sub(" ", shown) if "#" in shown else shown).lower())


def _link_share(text: str) -> float:
    links = sum(m.end() - m.start() for m in _LINK.finditer(text)) if "http" in text or "www" in text or "](" in text or "<a" in text else 0
    return links / max(1, len(text.strip()))


def variety(words: list[str]) -> float:
    """The share of different words, as the mean over whole blocks of ``BLOCK`` words, so that long pages compare with short ones."""
    if len(words) <= BLOCK:
        return len(set(words)) / max(1, len(words))
    starts = range(0, len(words) - BLOCK + 1, BLOCK)
    return sum(len(set(words[i : i + BLOCK])) for i in starts) / (BLOCK * len(starts))


def page_features(text: str, usual: Mapping[str, float] | Iterable[str]) -> tuple[float, ...]:
    """The shares of a page, in the order of ``SHARES``.

    ``usual`` gives the share up to which a common word is no keyword; words without one (a mere set) never are.
    """
    words, *form = _read(text)
    return (*_wording(words, form[-1], usual if isinstance(usual, Mapping) else dict.fromkeys(usual, 1.0)), *form)


def _again(words: list[str]) -> tuple[float, float]:
    """(share of the three-word phrases that come again, share of the words that the most frequent of them makes up)."""
    counts = Counter(zip(words, words[1:], words[2:]))
    n = max(1, len(words) - 2)
    if len(counts) == n:
        return 0.0, 0.0
    return sum(k for k in counts.values() if k > 1) / n, 3 * max(counts.values(), default=0) / max(1, len(words))


def _read(text: str) -> tuple[list[str], float, float, float, float]:
    """(words, share of repeated lines, separators per word, share of text in links, variety)."""
    shown = _shown(text)
    words = _words(shown)
    lines = [x.strip() for x in text.splitlines() if x.strip()]
    return words, (len(lines) - len(set(lines))) / max(1, len(lines)), sum(map(shown.count, _SEPARATORS)) / max(1, len(words)), _link_share(text), variety(words)


def _wording(words: list[str], varied: float, usual: Mapping[str, float]) -> tuple[float, ...]:
    """The shares that the words make, up to ``function``."""
    m = max(1, len(words))
    counts = Counter(words)
    function = 0.0
    for w in usual.keys() & counts.keys():
        function += min(counts[w], usual[w] * m + 1)
        if varied >= PLAIN or counts[w] <= usual[w] * m + 1:
            del counts[w]
    repeated, twice = (sum(k for k in counts.values() if k >= least) for least in (3, 2))
    top = max(counts.values(), default=0)
    return repeated / m, twice / m, top / m, *_again(words), function / m


def _language(column: str):
    """The base of a language tag, null if it says nothing."""
    base = F.regexp_extract(F.lower(F.trim(F.col(column))), r"^([a-z]{2,3})(?:[-_].*)?$", 1)
    return F.when(~base.isin("", "und", "mul", "zxx"), base)


def read_pages(texts: DataFrame) -> DataFrame:
    """``texts`` (language, digest, text) with their words, joined by blanks, and the shares of ``FORM`` instead of the text."""

    def read(frames):
        import pandas as pd

        for pdf in frames:
            rows = [(words, *form) for words, *form in map(_read, pdf["text"])]
            yield pd.DataFrame([(a, b, " ".join(words), *form) for a, b, (words, *form) in zip(pdf["language"], pdf["digest"], rows)], columns=["language", "digest", "words", *FORM])

    return texts.mapInPandas(read, "language string, digest string, words string, " + ", ".join(f"{c} double" for c in FORM))


def usual_shares(pages: DataFrame, common_share: float, prior_pages: int) -> dict[str, dict[str, float]]:
    """For each language the words its pages (of ``read_pages``) have in common, with the share of a page that is usual for each.

    Only distinct texts of varied wording count, so that copies and stuffed pages make no word common. A word is common if it
    is in ``common_share`` of the pages and of ``prior_pages`` more without it.
    """

    def count(frames):
        import pandas as pd

        for pdf in frames:
            seen: dict = defaultdict(lambda: [0, 0.0, 0.0])
            for language, line in zip(pdf["language"], pdf["words"]):
                words = line.split(" ")
                seen[language, ""][0] += 1
                for w, k in Counter(words).items():
                    one, share = seen[language, w], k / len(words)
                    one[0] += 1
                    one[1] += share
                    one[2] += share * share
            yield pd.DataFrame([(a, b, *x) for (a, b), x in seen.items()], columns=["language", "word", "n", "total", "squares"])

    plain = pages.filter(F.col("language").isNotNull() & (F.length("words") > 0) & (F.col("variety") >= PLAIN) & (F.col("links") < BOUNDS["links"][0])).select("language", "words")
    per = plain.mapInPandas(count, "language string, word string, n bigint, total double, squares double").groupBy("language", "word").agg(*(F.sum(c).alias(c) for c in ("n", "total", "squares")))
    per = materialise(per.filter((F.col("word") == "") | (F.col("n") >= F.lit(common_share * prior_pages))), "page-words")
    sizes = per.filter("word = ''").select("language", F.col("n").alias("pages"))
    found = per.filter("word <> ''").join(F.broadcast(sizes), "language").filter(F.col("n") >= (F.col("pages") + prior_pages) * common_share)
    out: dict[str, dict[str, float]] = {}
    for r in found.select("language", "word", "n", "total", "squares").collect():
        mean = r["total"] / r["n"]
        out.setdefault(r["language"], {})[r["word"]] = min(MOST_USUAL, mean + DEVIATIONS * math.sqrt(max(0.0, r["squares"] / r["n"] - mean * mean)))
    return out


def by_word(usual: Mapping[str, Mapping[str, float]]) -> dict[str, tuple[tuple[str, float], ...]]:
    """The same shares by word, as (language, share) pairs."""
    out: dict[str, tuple[tuple[str, float], ...]] = {}
    for language, shares in usual.items():
        for w, share in shares.items():
            out[w] = (*out.get(w, ()), (language, share))
    return out


def page_usual(words: list[str], tag: str | None, known: Mapping[str, tuple[tuple[str, float], ...]]) -> dict[str, float]:
    """The usual shares that hold for a page: of its tag, and of the languages that have at least half as many of its different words as the best."""
    hits = known.keys() & set(words)
    score: dict[str, int] = {}
    for w in hits:
        for language, _ in known[w]:
            score[language] = score.get(language, 0) + 1
    best = max(score.values(), default=0)
    held = {language for language, n in score.items() if 2 * n >= best or language == tag}
    out = {}
    for w in hits:
        for language, share in known[w]:
            if language in held and share > out.get(w, 0.0):
                out[w] = share
    return out


def _limits(features: DataFrame, prior_pages: int) -> DataFrame:
    """(language, a limit for each share, weight) of every language: what is far from usual in its distinct varied texts."""
    plain = features.filter(F.col("language").isNotNull() & (F.col("variety") >= PLAIN))
    quarters = [F.percentile_approx(c, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), F.lit(1000)).alias(c) for c in BOUNDS]
    usual = plain.groupBy("language").agg(F.count(F.lit(1)).alias("pages"), *quarters)
    weight = F.col("pages") / (F.col("pages") + prior_pages)

    def limit(c: str, low: float, high: float):
        q1, q2, q3 = (F.element_at(c, i) for i in (1, 2, 3))
        if c == "function":
            here, prior = q2 - 3 * (q2 - q1), low
        else:
            here, prior = q3 + 3 * (q3 - q2), high
        bounded = F.least(F.lit(high), F.greatest(F.lit(low), here))
        return (weight * bounded + (1 - weight) * F.lit(prior)).alias(f"{c}_limit")

    return usual.select("language", weight.alias("weight"), *(limit(c, *b) for c, b in BOUNDS.items()))


def stuffed_pages(documents: DataFrame, common_share: float = 0.25, prior_pages: int = 20) -> DataFrame:
    """(doc_id) of the pages made of keywords, links or tags; ``documents`` has doc_id, text and lang.

    Pages without a language tag are judged by the limits that ask for least, and weigh like the language with most pages.
    """
    named = documents.select("doc_id", "text", _language("lang").alias("language")).filter(F.length(F.trim("text")) > 0).withColumn("digest", F.md5("text"))
    texts = named.groupBy("language", "digest").agg(F.first("text").alias("text"))
    # Cut here: every text is taken apart once, whatever is asked of its words.
    pages = materialise(read_pages(texts), "page-read")
    learned = usual_shares(pages, common_share, prior_pages)
    fixed = {k: dict.fromkeys(v.split(), FUNCTION_SHARE) for k, v in FUNCTION_WORDS.items()}
    known = by_word({k: fixed.get(k, {}) | learned.get(k, {}) for k in fixed.keys() | learned.keys()})

    def measure(frames):
        import pandas as pd

        for pdf in frames:
            rows = []
            for language, digest, line, *form in zip(*(pdf[c] for c in ("language", "digest", "words", *FORM))):
                words = line.split(" ") if line else []
                rows.append((language, digest, *_wording(words, form[-1], page_usual(words, language, known)), *form))
            yield pd.DataFrame(rows, columns=["language", "digest", *SHARES])

    features = materialise(pages.mapInPandas(measure, FEATURES), "page-features")
    limits = materialise(_limits(features, prior_pages), "page-limits")
    untagged = limits.agg(F.max("weight").alias("weight"), *((F.max if c == "function" else F.min)(f"{c}_limit").alias(f"{c}_limit") for c in BOUNDS)).select(F.lit(None).cast("string").alias("language"), "*")
    a, b = features.alias("a"), limits.unionByName(untagged).alias("b")
    judged = a.join(F.broadcast(b), F.col("a.language").eqNullSafe(F.col("b.language")), "left")
    over = {c: F.col(f"a.{c}") >= F.coalesce(F.col(f"{c}_limit"), F.lit(high)) for c, (_, high) in BOUNDS.items()}
    lacking = F.col("function") < F.coalesce("function_limit", F.lit(BOUNDS["function"][0]))
    little = F.col("variety") < PLAIN
    confirmed = over["top"] | over["phrase"] & little | over["lines"] | over["separators"] & (F.col("repeated") >= 0.9 * MOST_REPEATED)
    stuffed = (F.col("repeated") >= MOST_REPEATED) | over["twice"] | over["repeated"] & confirmed | over["phrases"] & little
    # Without pages to calibrate it by, a language is known by its lack of variety only.
    plain_enough = F.col("variety") < PLAIN + (1 - PLAIN) * F.coalesce("weight", F.lit(0.0))
    found = judged.filter(over["links"] | stuffed & lacking & plain_enough).select("a.language", "a.digest")
    n, f = named.select("doc_id", "language", "digest").alias("n"), found.alias("f")
    return n.join(f, F.col("n.language").eqNullSafe(F.col("f.language")) & (F.col("n.digest") == F.col("f.digest")), "left_semi").select("doc_id").distinct()
