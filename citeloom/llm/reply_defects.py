"""Defects of prompt and response pairs: empty, truncated, refusal, question_copy, other_language.

Copy, language and termination are read from the pair itself. Refusals are found by their templates: the openings of all
responses are cut into clauses, in which the words of their own prompt and all numbers are masked, and the clauses are
clustered by MinHash over shingles of five words; each link of a cluster is confirmed by its Jaccard similarity of 0.8 or
more, and a cluster is a connected component of links. A cluster that recurs across unrelated prompts is a refusal template
if most of its responses answer nothing (no citation, and no figure that the prompt did not have) and most of them decline:
by their wording, or by a finish reason that says so. A response is a refusal if its opening has a clause of such a
template and templates make up half of it, whatever its citations and figures, or if it answers nothing. Without a
template nothing is a refusal, however short: a response that names a gap and then answers is none, and a new wording is
one as soon as it recurs.

Languages are told by the words of a profile, learned from texts with a language tag (``language_profile``) where there are
some, on top of short lists, and by scripts. The finish reason is weak evidence only: of many responses, never of one.

The first of these that holds is the defect: empty, question_copy, refusal, truncated, other_language. A null response
is empty; a null prompt leaves only the checks that need none; rows that repeat an answer id are one record, the one loaded
last (of equal ones the largest).
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeloom.session import materialise

#: So long that one changed word leaves a similarity of 0.8: 41 of 51 shingles.
OPENING_WORDS = 50
SHINGLE, SIMILARITY, BANDS, ROWS = 5, 0.8, 12, 3

_CITED = re.compile(r"\{\{cite:[^|}]*\|[^}]*\}\}")
_TAG = re.compile(r"</?[A-Za-z!][^<>]*>")
_INVISIBLE = re.compile("[­͏؜ᅟᅠ឴឵᠋-᠏​-‏‪-‮⁠-⁯︀-️﻿]")
_WORD = re.compile(r"[぀-ヿ一-鿿㐀-䶿]|[^\W_](?:[\w.,'’\-]*[^\W_])?")
_STOP = re.compile(r"[.!?。！？؟।…]")
_CLOSERS = "\"”“»’'」』)]）】*_`~ \t\r\n  "
_LIST_MARK = re.compile(r"(?:[-*•–]|\(?\d{1,3}[.)]|#+)\s*\Z")
_LEAD = re.compile(r"\A[\s>\"“”„«»'*_#\-]*(?:(?:question|q|you asked|frage|pregunta|问题|問題)\s*[:：]\s*)?", re.IGNORECASE)

#: What stands for no answer, abbreviations that cannot end one, and common short words of each language.
PLACEHOLDERS = frozenset(["n/a", "na", "none", "null", "nil", "tbd", "todo", "no answer", "no response", "empty", "undefined", "nan", "{}", "[]"])
OPEN_ENDS = frozenset("dr prof st no nr fig figs vs cf e.g i.e approx suppl sect vers al esp max min i.v q.d b.i.d a.m z b d h u a lt vgl abb tab ca env ex p ej pág sra sr m j r art см рис проф п т е чел г".split())
COMMON = {
    "en": "the of and to in is with for that was be by or are at on it what how should which who has does from can my after when",
    "de": "der die das und ist mit für von zu den bei nicht ein eine im wird werden auf nach wie oft sind oder darf falls wenn welche wurde kann sollte durch um",
    "fr": "le la les de des du et est à pour une un dans que sur au aux par avec peut faut il être ou si en quelle après ont été contre",
    "es": "el la los las de del y es en para con una un que por se al debe puede no si ha cuándo tras qué qué más su como cuando",
}

#: The wording of refusals; it tells only where templates cannot, and never makes a case of a reply that gives more.
_DECLINING = re.compile(
    r"\b(?:sorry|unfortunately|unable to|i (?:cannot|can't|could not|couldn't|won't|will not|must decline|do not|don't|was not able|am not able)|not able to (?:help|answer)|decline to|(?:outside|beyond) (?:what i|my|the scope)|my role does not|not something i|"
    r"none of the (?:passages|sections|sources|documents)|nothing (?:was )?(?:found|retrieved)|no (?:relevant )?(?:information|guidance|passages?|sections?|results?) (?:\S+ ){0,6}(?:found|retrieved|available)|matter for your|would rather (?:leave|not)|(?:has|have) to be settled (?:with|by)|as a language model|"
    r"(?:kann|darf|möchte|finde|fand|antworte) ich (?:\S+ ){0,6}(?:nicht|nichts|keine)|muss ich (?:\S+ ){0,8}ablehnen|ich (?:kann|konnte|habe|darf) (?:\S+ ){0,8}(?:nicht|nichts|keine)|tut mir leid|leider|"
    r"désolé|malheureusement|je ne (?:peux|puis|suis)|je n'ai (?:rien|pas)|aucun(?:e)? (?:passage|information|section|recommandation)|"
    r"lo siento|lamentablemente|no (?:puedo|encontré|he encontrado|se encontró)|ningún pasaje|ninguna (?:sección|información))(?!\w)"
    r"|很遗憾|抱歉|无法(?:回答|提供|讨论|就)|不能(?:回答|提供)|没有找到|未(?:能)?找到|申し訳|お答えでき|回答でき|見つかりません|見つけられ|к сожалению|не могу|не (?:удалось )?наш|извините|عذر|آسف|لا أستطيع|لم أجد|क्षमा|खेद|नहीं मिल|उत्तर नहीं|ขออภัย|เสียใจ|ไม่สามารถ|ไม่พบ",
)


def _clean(text: str) -> str:
    return _INVISIBLE.sub("", _TAG.sub(" ", _CITED.sub(" ", text)))


def is_empty(text: str | None) -> bool:
    """Nothing to read but blanks, placeholders or markup."""
    if text is None:
        return True
    shown = _clean(text).strip().lower().strip("[](){}<>*_#`~-–—.…:;|\"' \t\r\n ")
    return not re.search(r"\w", shown) or shown in PLACEHOLDERS


def words(text: str) -> list[str]:
    return [w.lower() for w in _WORD.findall(text)]


def is_copy(text: str, prompt: str | None) -> bool:
    """The response is only the prompt again, once or more, perhaps slightly changed."""
    if not prompt:
        return False
    said, asked = words(_LEAD.sub("", _clean(text))), words(prompt)
    if not said or not asked or len(said) < 0.6 * len(asked):
        return False
    have, want = set(asked), set(said)
    fresh = sum(w not in have for w in said)
    return fresh <= 0.2 * len(asked) and fresh <= 0.25 * len(said) and sum(w in want for w in have) >= 0.75 * len(have)


def is_truncated(text: str) -> bool:
    """The last sentence, list entry or marker is not complete."""
    rest = _CITED.sub("", text)
    if "{{" in rest:
        return True
    rest = _INVISIBLE.sub("", rest).rstrip()
    line = rest.rsplit("\n", 1)[-1].strip()
    if _LIST_MARK.fullmatch(line.rstrip("*_` ")):
        return True
    core = rest.rstrip(_CLOSERS)
    if not core:
        return False
    if not _STOP.match(core[-1]):
        return True
    if "\n" not in rest[len(core) :] and (line.count("(") > line.count(")") or line.count("（") > line.count("）") or line.count('"') % 2 or line.count("「") > line.count("」") or line.count("«") > line.count("»")):
        return True
    if core[-1] == "." and len(core) == len(rest):
        tail = core[:-1].rsplit(None, 2)
        last = tail[-1].lstrip("(\"“«") if tail else ""
        if last.lower() in OPEN_ENDS or len(last) == 1 and last.isalpha():
            return True
        # A figure cut after its decimal point; whole numbers end sentences only as years or after a label.
        if re.fullmatch(r"\d{1,3}", last) and not (len(tail) > 1 and re.search(r"(?i)table|tab\.?|fig\.?|abb\.?|tabla|tableau|табл\.?|表", tail[-2])):
            return True
    return False


_ENTRY = re.compile(r"(?:[-*•–]|\d{1,3}[.)])\s+\S")


def entry_templates(text: str) -> tuple[list[str], str | None]:
    """(all lines that are list entries, the last line if it is one without a stop), with names and numbers masked."""
    lines = [x.strip() for x in _INVISIBLE.sub("", _CITED.sub("", text)).rstrip().split("\n")]
    made = [_form(x) if _ENTRY.match(x) and "{{" not in x else None for x in lines]
    open_end = made[-1] is not None and not _STOP.match(lines[-1].rstrip(_CLOSERS)[-1:] or ".")
    return [x for x in made if x], made[-1] if open_end else None


def _form(line: str) -> str:
    """A line as tokens with blanks between them: words, and each character of scripts without spaces."""
    masked = re.sub(r"[^\W\d_]{7,}", "_", re.sub(r"\d+(?:[.,]\d+)*", "#", line))
    return " ".join((masked if masked.isascii() else _NO_SPACES.sub(r" \g<0> ", masked)).split())


def complete_entries(closings: DataFrame, entries: DataFrame, least_prompts: int, least_share: float = 0.05) -> DataFrame:
    """(closing) of the last list entries without a stop that are complete: their form ends responses to several prompts, and no cut would leave it so often.

    A cut falls anywhere; so of the entries that begin like a cut one, up to its last word, hardly any ends right there. ``closings``
    has (closing, prompt), a row a response; ``entries`` has (entry), a row for every list entry of all responses.
    """
    stem = lambda c, n: F.xxhash64(F.array_join(F.slice(F.split(c, " "), F.lit(1), n), " "))
    ends = closings.groupBy("closing").agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct("prompt").alias("prompts")).filter(F.col("prompts") >= least_prompts)
    ends = ends.select("closing", "n", stem("closing", F.size(F.split("closing", " ")) - 1).alias("stem"))
    stems = entries.groupBy("entry").agg(F.count(F.lit(1)).alias("k")).withColumn("size", F.size(F.split("entry", " ")))
    stems = stems.select("k", F.explode(F.transform(F.sequence(F.lit(1), F.col("size")), lambda i: stem(F.col("entry"), i))).alias("stem")).groupBy("stem").agg(F.sum("k").alias("k"))
    return ends.join(stems, "stem").filter(F.col("n") >= F.col("k") * least_share).select("closing")


Profile = dict[str, tuple[tuple[str, float], ...]]


def language(text: str, profile: Profile | None = None) -> str | None:
    """The main language, or script where it tells the language; None if nothing can be said."""
    return _language(_clean(text), profile or FIXED_PROFILE)


_SCRIPTS = tuple((name, re.compile(pattern)) for name, pattern in (("kana", "[぀-ヿ]"), ("han", "[一-鿿]"), ("ar", "[؀-ۿ]"), ("ru", "[Ѐ-ӿ]"), ("hi", "[ऀ-ॿ]"), ("th", "[฀-๿]"), ("ko", "[가-힯]"), ("el", "[Ͱ-Ͽ]")))
_PART = re.compile(r"(?<=[.!?。！？؟।])\s+|\n|(?<=[。！？])")


def main_languages(text: str, profile: Profile | None = None) -> set[str]:
    """The language of most sentences of some length, and the one in which most is said.

    They differ where a text mixes languages. A character of a script without letters counts as 2.5.
    """
    count: dict[str, float] = {}
    length: dict[str, float] = {}
    for part in _PART.split(_clean(text)):
        if x := _language(part, profile or FIXED_PROFILE):
            length[x] = length.get(x, 0.0) + len(part.strip()) * (2.5 if x in ("zh", "ja", "ko") else 1.0)
            count[x] = count.get(x, 0.0) + (len(part) > 20)
    return {max(sorted(v), key=v.get) for v in (count, length) if v}


def _language(shown: str, profile: Profile) -> str | None:
    score: dict[str, float] = {}
    for name, pattern in () if shown.isascii() else _SCRIPTS:
        if n := len(pattern.findall(shown)):
            score[name] = n / (2.0 if name in ("han", "kana") else 4.0)
    if "kana" in score and score["kana"] * 4 >= score.get("han", 0):
        score = {k: v for k, v in score.items() if k not in ("kana", "han")} | {"ja": score["kana"] + score.get("han", 0)}
    elif "han" in score:
        score["zh"] = score.pop("han") + score.pop("kana", 0)
    for w in words(shown):
        for name, share in profile.get(w, ()):
            score[name] = score.get(name, 0.0) + share
    if not score:
        return None
    return max(sorted(score), key=lambda k: score[k])


#: Pages that a word of the short lists counts for in a profile, and the share of a language's pages that makes a word one of its own.
LIST_PAGES, OWN_SHARE = 20, 0.05


def profile_of(counts: dict[str, dict[str, int]], sizes: dict[str, int]) -> Profile:
    """For each word the languages that have it, each with its part of one vote; ``counts`` has the pages of each language by word."""
    names = set(sizes) | set(_COMMON_SETS)
    shares: dict[str, dict[str, float]] = {}
    for name in names:
        own, listed = counts.get(name, {}), _COMMON_SETS.get(name, frozenset())
        n = sizes.get(name, 0) + LIST_PAGES
        for w in own.keys() | listed:
            share = (own.get(w, 0) + LIST_PAGES * (w in listed)) / n
            if share >= OWN_SHARE:
                shares.setdefault(w, {})[name] = share
    return {w: tuple((name, x / sum(by.values())) for name, x in by.items()) for w, by in shares.items()}


def language_profile(texts: DataFrame, sample_texts: int = 6000) -> Profile:
    """The profile of the languages of ``texts`` (id, text, lang), fitted on at most about ``sample_texts`` of them, chosen by a hash of the id."""
    base = F.regexp_extract(F.lower(F.trim("lang")), r"^([a-z]{2,3})(?:[-_].*)?$", 1)
    tagged = texts.select("id", "text", base.alias("lang")).filter(F.col("text").isNotNull() & ~F.col("lang").isin("", "und", "mul", "zxx"))
    share = min(1.0, sample_texts / max(1, texts.count()))
    sample = tagged.filter(F.xxhash64("id") <= min(2**63 - 1, int(-(2**63) + share * 2**64))).select("lang", "text")

    def count(frames):
        import pandas as pd

        for pdf in frames:
            seen: dict = {}
            for name, text in zip(pdf["lang"], pdf["text"]):
                for w in {"", *words(_clean(text))}:
                    if not any(map(str.isdigit, w)):
                        seen[name, w] = seen.get((name, w), 0) + 1
            yield pd.DataFrame([(a, b, n) for (a, b), n in seen.items()], columns=["lang", "word", "n"])

    per = sample.mapInPandas(count, "lang string, word string, n bigint").groupBy("lang", "word").agg(F.sum("n").alias("n")).filter(F.col("n") >= OWN_SHARE * LIST_PAGES)
    total = per.filter("word = ''").select("lang", F.col("n").alias("pages"))
    kept = per.join(F.broadcast(total), "lang").filter((F.col("n") >= OWN_SHARE * (F.col("pages") + LIST_PAGES)) | (F.col("word") == ""))
    counts: dict[str, dict[str, int]] = {}
    sizes: dict[str, int] = {}
    for r in kept.select("lang", "word", "n").collect():
        if r["word"]:
            counts.setdefault(r["lang"], {})[r["word"]] = r["n"]
        else:
            sizes[r["lang"]] = r["n"]
    return profile_of(counts, sizes)


_COMMON_SETS = {k: frozenset(v.split()) for k, v in COMMON.items()}
_FUNCTION_WORDS = frozenset().union(*_COMMON_SETS.values())
FIXED_PROFILE = profile_of({}, {})
_NO_SPACES = re.compile("[぀-ヿ一-鿿㐀-䶿]")


def answers_nothing(text: str, prompt: str | None) -> bool:
    """Words only: no citation, and no figure that the prompt did not have."""
    if "{{cite:" in text:
        return False
    said, asked = words(_clean(text)), set(words(prompt or ""))
    return bool(said) and not any(any(c.isdigit() for c in w) and w not in asked for w in said)


def declines(text: str, finish: str | None = None) -> bool:
    """The wording of a refusal, or a finish reason that says so."""
    return (finish or "").lower() in ("refusal", "content_filter", "safety") or bool(_DECLINING.search(_clean(text).lower().replace("’", "'")))


_CLAUSE = re.compile(r"[.!?,;:…](?=[\s*_\"”»)\]]|\Z)|[。！？，；：、।؟،\n]|\s[–—-]\s")


def clauses(text: str, prompt: str | None) -> tuple[list[tuple[str, int]], int]:
    """([(clause, words)] of the opening, words of the whole): masked are the prompt's words and names and all numbers; function words stand as they are."""
    asked = set(words(prompt or "")) - _FUNCTION_WORDS
    low = prompt.lower() if prompt and _NO_SPACES.search(prompt) else ""
    out: list[tuple[str, int]] = []
    total = 0
    for part in _CLAUSE.split(_clean(text)):
        said = words(part)
        total += len(said)
        if total - len(said) < OPENING_WORDS and (made := _masked(said, asked, low)) not in ("", "_", "#"):
            out.append((made, len(said)))
    return out, total


def _masked(said: list[str], asked: set[str], low: str) -> str:
    masked = [w in asked and not (len(w) == 1 and _NO_SPACES.match(w) is not None) for w in said]
    # Scripts without spaces have a word a character: three in a row that the prompt has are a word of it.
    if low:
        for i in range(len(said) - 2):
            if all(map(_NO_SPACES.fullmatch, said[i : i + 3])) and "".join(said[i : i + 3]) in low:
                masked[i : i + 3] = [True] * 3
    out: list[str] = []
    for w, m in zip(said, masked):
        x = "#" if any(c.isdigit() for c in w) else "_" if m else w
        if x != "_" or out[-1:] != ["_"]:
            out.append(x)
    return " ".join(out)


def shingles(text: str) -> set[int]:
    w = text.split(" ")
    return {zlib.crc32(" ".join(w[i : i + SHINGLE]).encode()) for i in range(max(1, len(w) - SHINGLE + 1))}


def _parts(text: str) -> set[tuple[str, ...]]:
    """The shingles themselves: quicker than their hashes where they stay in one process."""
    w = text.split(" ")
    return set(zip(*(w[i:] for i in range(SHINGLE)))) if len(w) >= SHINGLE else {tuple(w)}


_RNG = np.random.default_rng(20240611)
_A = _RNG.integers(1, 1 << 31, BANDS * ROWS, dtype=np.uint64) | np.uint64(1)
_B = _RNG.integers(0, 1 << 31, BANDS * ROWS, dtype=np.uint64)


#: Sets of fewer shingles are alike only if they are equal.
SMALL = 4


def _bands(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(number of the text, band) pairs: the band's number in the high bits, a hash of the text's minima in it in the others; one band for small sets."""
    own = [shingles(t) for t in texts]
    small = np.array([len(x) < SMALL for x in own], dtype=bool)
    which, bands = [np.flatnonzero(small)], [np.array([zlib.crc32(repr(sorted(x)).encode()) for x, y in zip(own, small) if y], dtype=np.uint64)]
    bands[0] |= np.uint64(BANDS) << np.uint64(59)
    large = np.flatnonzero(~small)
    if len(large):
        starts = np.cumsum([0] + [len(own[i]) for i in large])[:-1]
        flat = np.fromiter((x for i in large for x in own[i]), dtype=np.uint64)
        for i in range(BANDS):
            made = np.zeros(len(large), dtype=np.uint64)
            for j in range(i * ROWS, (i + 1) * ROWS):
                made = (made ^ np.minimum.reduceat((flat * _A[j] + _B[j]) % np.uint64(4294967311), starts)) * np.uint64(0x9E3779B97F4A7C15)
            which.append(large)
            bands.append(made >> np.uint64(5) | np.uint64(i) << np.uint64(59))
    return np.concatenate(which), np.concatenate(bands).view(np.int64)


def bucket_links(texts: list[str]) -> list[tuple[str, str]]:
    """(text, other) links of confirmed pairs of one bucket: each text with one earlier text of each part that has one like it.

    Of two texts of the similarity the rarest shingles meet: in any one order of the shingles, here by how often they stand in
    the bucket, the first of both share one. So a text is compared only with those that share a rare shingle with it.
    """
    sets = [_parts(t) for t in texts]
    often = Counter(x for own in sets for x in own)
    part = list(range(len(texts)))
    by_shingle: dict = {}
    links = []

    def root(i: int) -> int:
        while part[i] != i:
            part[i] = i = part[part[i]]
        return i

    for me, (text, own) in enumerate(zip(texts, sets)):
        rare = sorted(own, key=lambda x: (often[x], hash(x)))[: len(own) - math.ceil(SIMILARITY * len(own)) + 1]
        seen = set()
        for shingle in rare:
            if often[shingle] == 1:
                continue
            groups: dict[int, list[int]] = {}
            for i, members in by_shingle.get(shingle, {}).items():
                here = groups.setdefault(root(i), members)
                if here is not members:
                    here.extend(members)
            for members in groups.values():
                if root(members[0]) == root(me):
                    continue
                for i in members:
                    if i in seen:
                        continue
                    seen.add(i)
                    theirs = sets[i]
                    if SIMILARITY * max(len(own), len(theirs)) <= min(len(own), len(theirs)) and len(own & theirs) >= SIMILARITY * len(own | theirs):
                        links.append((text, texts[i]))
                        part[root(me)] = root(i)
                        break
            groups.setdefault(root(me), []).append(me)
            by_shingle[shingle] = groups
    return links


def cluster_openings(openings: DataFrame) -> DataFrame:
    """(opening, cluster): each distinct opening with the smallest one of its connected component of confirmed pairs.

    In each bucket of a band an opening is compared with those that can be like it until it is linked to each part that has
    one, so no link between parts is missed and a bucket of near-equal openings takes one comparison each; a task holds the
    shingles of one bucket.
    """

    def band_rows(frames):
        import pandas as pd

        for pdf in frames:
            which, bands = _bands(pdf["opening"].tolist())
            yield pd.DataFrame({"opening": pdf["opening"].to_numpy()[which], "band": bands})

    def confirm(frames):
        import pandas as pd

        band, bucket = None, []
        for pdf in frames:
            links = []
            for o, x in zip(pdf["opening"], pdf["band"]):
                if x != band:
                    links += bucket_links(bucket)
                    band, bucket = x, []
                bucket.append(o)
            yield pd.DataFrame(links, columns=["opening", "hub"])
        yield pd.DataFrame(bucket_links(bucket), columns=["opening", "hub"])

    one = openings.select("opening").distinct()
    bands = one.mapInPandas(band_rows, "opening string, band bigint")
    buckets = bands.groupBy("band").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("band")
    near = bands.join(buckets, "band").repartition("band").sortWithinPartitions("band", "opening")
    links = near.mapInPandas(confirm, "opening string, hub string").distinct()
    return one.join(_components(links), "opening", "left").select("opening", F.coalesce("cluster", "opening").alias("cluster"))


def _components(links: DataFrame) -> DataFrame:
    """(opening, cluster) of all linked openings: the smallest of the component, by steps to the least neighbour and its label."""
    ends = materialise(links.select("opening", "hub").unionByName(links.select(F.col("hub").alias("opening"), F.col("opening").alias("hub"))).distinct(), "reply-links")
    labels = materialise(ends.groupBy("opening").agg(F.least(F.col("opening"), F.min("hub")).alias("cluster")), "reply-labels")
    while True:
        known = labels.select(F.col("opening").alias("hub"), F.col("cluster").alias("theirs"))
        near = ends.join(known, "hub").groupBy("opening").agg(F.min("theirs").alias("theirs"))
        least = labels.join(near, "opening").select("opening", F.col("cluster").alias("before"), F.least("cluster", "theirs").alias("hub"))
        step = materialise(least.join(known, "hub").select("opening", "before", F.least("hub", "theirs").alias("cluster")), "reply-labels")
        labels = step.select("opening", "cluster")
        if step.filter("before <> cluster").isEmpty():
            return labels


def reply_defects(answers: DataFrame, least_prompts: int = 3, profile: Profile | None = None) -> DataFrame:
    """(answer_id, defect_type) of the defective ones.

    ``answers`` has answer_id, answer and question (the prompt); finish_reason and loaded_at are used if it has them. Prompts
    count as unrelated if the least hashes of their words differ, so that near-equal prompts count about once.
    """
    profile = profile or FIXED_PROFILE

    def judge(frames):
        import pandas as pd

        names = ["answer_id", "own", "bare", "declines", "clauses", "total", "prompt", "asked", "entries", "closing", "foreign"]
        for pdf in frames:
            rows = []
            for i, a, q, finish in zip(pdf["answer_id"], pdf["answer"], pdf["question"], pdf["finish_reason"]):
                q = q if isinstance(q, str) else None
                if not isinstance(a, str) or is_empty(a):
                    rows.append((i, "empty", False, False, [], 0, 0, 0, [], None, False))
                    continue
                if is_copy(a, q):
                    rows.append((i, "question_copy", False, False, [], 0, 0, 0, [], None, False))
                    continue
                foreign = bool(q and (x := main_languages(a, profile)) and (y := language(q, profile)) and y not in x)
                own = "truncated" if is_truncated(a) else "other_language" if foreign else None
                said, total = clauses(a, q)
                prompt = min((zlib.crc32(w.encode()) for w in set(words(q or "")) - _FUNCTION_WORDS), default=0)
                rows.append((i, own, answers_nothing(a, q), declines(a, finish), said, total, prompt, zlib.crc32((q or "").encode()), *entry_templates(a), foreign))
            yield pd.DataFrame(rows, columns=names)

    have = {"finish_reason": "string", "loaded_at": "timestamp"}
    given = answers.select("answer_id", "answer", "question", *[F.col(c) if c in answers.columns else F.lit(None).cast(t).alias(c) for c, t in have.items()])
    one = given.groupBy("answer_id").agg(F.max(F.struct("loaded_at", "answer", "question", "finish_reason")).alias("x")).select("answer_id", "x.answer", "x.question", "x.finish_reason")
    judged = materialise(one.mapInPandas(judge, "answer_id bigint, own string, bare boolean, declines boolean, clauses array<struct<clause: string, n: int>>, total int, prompt bigint, asked bigint, entries array<string>, closing string, foreign boolean"), "reply-judged")
    closing = F.when(F.col("own") == "truncated", F.col("closing"))
    whole = complete_entries(judged.select(closing.alias("closing"), F.col("asked").alias("prompt")).filter("closing is not null"), judged.select(F.explode("entries").alias("entry")), least_prompts)
    judged = judged.withColumn("closing", closing).join(whole.withColumn("whole", F.lit(True)), "closing", "left").withColumn("own", F.when(F.col("whole"), F.when(F.col("foreign"), "other_language")).otherwise(F.col("own"))).drop("closing", "whole", "entries")

    said = judged.select("answer_id", "prompt", "bare", "declines", F.explode("clauses").alias("x")).select("answer_id", "prompt", "bare", "declines", F.col("x.clause").alias("opening"), "x.n")
    counted = said.groupBy("opening", "prompt").agg(F.count_if("bare").alias("bare"), F.count_if("declines").alias("declines"), F.count(F.lit(1)).alias("n"))
    clusters = materialise(cluster_openings(counted), "reply-clusters")
    templates = counted.join(clusters, "opening").groupBy("cluster").agg(F.sum("bare").alias("bare"), F.sum("declines").alias("declines"), F.sum("n").alias("n"), F.approx_count_distinct("prompt").alias("prompts"))
    refusing = templates.filter((F.col("prompts") >= least_prompts) & (F.col("bare") * 2 >= F.col("n")) & (F.col("declines") * 2 >= F.col("n"))).select("cluster")
    known = clusters.join(refusing, "cluster", "left_semi").select("opening")
    covered = said.join(known, "opening", "left_semi").groupBy("answer_id").agg(F.sum("n").alias("covered"))
    refusal = F.coalesce((F.col("covered") * 2 >= F.col("total")) | F.col("covered").isNotNull() & F.col("bare"), F.lit(False))
    return judged.join(covered, "answer_id", "left").select("answer_id", F.when(refusal, "refusal").otherwise(F.col("own")).alias("defect_type")).filter("defect_type is not null")
