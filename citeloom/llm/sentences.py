"""Sentence units of texts in any script, by a maximum-entropy model over candidate boundaries.

Line breaks always end a unit. Inside a line every run of stops (``. ! ? …`` and their forms in other scripts) is a
candidate, with the closing marks and reference marks that follow it. A candidate inside a quotation or bracket that
closes later in the line, or after nothing but a list mark or section number, is no boundary. All others are decided by
the model; its features are the tokens around the stop, their case, length, digits and script, the closing marks, and
the gap. Thai has no stops: there a space beside a Thai word is the boundary.

The model is trained on boundaries that are reliable without it: stops at the end of a line, stops before a small
letter or inside a token, and stops after tokens that the sample shows never or sometimes at the end of a line. The
sample has at most ``sample_texts`` texts, chosen by a hash of their id; everything else runs over whole texts.

Null, empty and blank texts have no unit. Every row is a text: rows that repeat an id are to be made one before.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections import Counter, defaultdict
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DIMENSIONS = 1 << 16
_LINE_BREAKS = "\n\r\v\f\x1c\x1d\x1e\x85  "
_CANDIDATE = re.compile(
    r"([.!?…]+|[。！？؟।॥．｡]+)"
    r"((?:[\"”“»’」』)\]）】›〉》]|[   ]»|\[\d[\d,;–\- ]*\]|\(\d{1,3}\)|[¹²³⁰⁴-⁹]+(?:[–,\-][¹²³⁰⁴-⁹]+)*)*)"
)
_GAP = re.compile(rf"[^\S{_LINE_BREAKS}]*")
_SPACE = re.compile(r"\s*")
_WHOLE = re.compile(r"\S+")
_ADDRESS = re.compile(r"[!-~]*\Z")
_BREAK = re.compile(rf"[{_LINE_BREAKS}]+")
_ENCLOSED = re.compile(
    rf"\"[^\"{_LINE_BREAKS}]*\"|“[^”{_LINE_BREAKS}]*”|„[^“”{_LINE_BREAKS}]*[“”]|«[^»{_LINE_BREAKS}]*»|「[^」{_LINE_BREAKS}]*」|『[^』{_LINE_BREAKS}]*』"
    rf"|\([^(){_LINE_BREAKS}]*\)|（[^（）{_LINE_BREAKS}]*）"
)
_OPENERS = "\"“„«‘‚‹「『([（【¿¡*_#"
_MARK = re.compile(r"[\s#>\-*•·–]*(?:\(?(?:\d+(?:\.\d+)*|[A-Za-z]|[ivxIVX]+)[.)]?)?\s*\Z")
_ONLY_MARK = re.compile(r"[\s#>\-*•·–]*\(?(?:\d+(?:\.\d+)*|[A-Za-z])[.)]\Z")
_JOINED = re.compile(r".*[^\W\d_]{2}[.!?][\"”»)\]]?([^\W\d_a-z].*)\Z")
_THAI = re.compile(r"[฀-๿]")
_SIDE = re.compile(r"(\S*)(\s+)(?=(\S*))")

#: Abbreviations that are never reliable ends, used as labels where the sample is too small to show it.
ABBREVIATIONS = frozenset(
    "dr prof st no nr fig figs vs cf e.g i.e approx suppl sect vers al esp max min vol pp ed eds jr sr mr mrs ms"
    " z b d h u a lt vgl abb tab bzw ca ggf sog usw art env ex mme mlle sra sr srta pág p ej aprox ud núm см рис табл"
    " проф т е г гл п стр чел др им д н".split()
)


def _kind(ch: str) -> str:
    if not ch:
        return "none"
    if ch.isdigit():
        return "digit"
    if ch.isalpha():
        return "upper" if ch.isupper() or ch.istitle() else "lower" if ch.islower() else "letter"
    return "mark"


@lru_cache(maxsize=65536)
def _script(ch: str) -> str:
    return unicodedata.name(ch, "?").split(" ")[0] if ch else "none"


def _token(raw: str) -> str:
    """A token's class: itself if short, else its shape."""
    t = raw.strip("\"“”„«»‘’「」『』()（）[]*_,;:!?¿¡….")
    if not t:
        return "<none>"
    if "://" in t or t.startswith("www."):
        return "<url>"
    digits = sum(c.isdigit() for c in t)
    if "." in t and not digits and len(t) <= 14:
        return t.lower()
    if "/" in t:
        return "<path>"
    if digits == len(t):
        return f"<d{min(len(t), 4)}>"
    if digits:
        return "<mixed>" if any(c.isalpha() for c in t) else "<number>"
    return t.lower() if len(t) <= 6 else "<long>"


def _last_words(text: str, start: int, stop: int, n: int) -> list[str]:
    """The last ``n`` whole words of text[start:stop]."""
    reach = 48
    while True:
        at = max(start, stop - reach)
        found = text[at:stop].rsplit(None, n)
        if at == start or len(found) > n:
            return found[-n:]
        reach *= 4


def _next_word(text: str, at: int) -> str:
    """The whole word that begins at ``at``."""
    m = _WHOLE.match(text, at)
    return m.group() if m else ""


def _key(text: str, start: int, stop: int, m: re.Match, follow: int) -> tuple:
    """What the model sees of a candidate whose unit began at ``start`` and whose next text is at ``follow``."""
    words = _last_words(text, start, stop, 2)
    word = words[-1] if words else ""
    joined = _JOINED.match(word)
    if joined:
        words.append(word := joined.group(1))
    at = follow
    n = len(text)
    while at < n and (text[at] in _OPENERS or text[at].isspace()):
        at += 1
    ch = text[at] if at < n else ""
    closers = m.group(2)
    ahead = _next_word(text, at)
    last = word.rstrip("\"“”»’」』)])")[-1:]
    return (
        "." if m.group(1) == "." else "…" if len(m.group(1)) > 1 and m.group(1)[0] == "." or "…" in m.group(1) else m.group(1)[0],
        _token(word),
        _token(words[-2]) if len(words) > 1 else "<start>",
        "none" if not closers else "mark" if closers[-1] in "]¹²³⁰⁴⁵⁶⁷⁸⁹" else "quote" if closers[-1] in "\"”“»’」』›" else "bracket",
        "none" if follow == m.end() else "space",
        _kind(ch),
        (ch if _kind(ch) == "letter" else _token(ahead)) if ahead else "<none>",
        "open" if at > follow else "plain",
        _kind(last) if last else "none",
        _script(last) if last.isalpha() else "none",
    )


def _features(key: tuple) -> list[int]:
    stop, word, before, closer, gap, kind, ahead, opened, case, script = key
    inner = "." in word
    size = "1" if len(word) == 1 else "2" if len(word) == 2 else "3-4" if len(word) < 5 else "5-6"
    shape = word if word[0] == "<" else f"{'inner' if inner else 'word'}{size}"
    names = [
        "bias", f"stop={stop}", f"word={word}", f"word={word}|{before}" if word.startswith("<d") else f"word={word}|", f"shape={shape}", f"closer={closer}", f"gap={gap}", f"kind={kind}",
        f"stop,kind={stop},{kind}", f"shape,kind={shape},{kind}", f"case,kind={case},{kind}", f"script,kind={script},{kind}", f"closer,kind={closer},{kind}", f"gap,kind={gap},{kind}",
        f"ahead={ahead}", f"closer,ahead={closer},{ahead}", f"open={opened},{kind}", f"digits,ahead={word if word.startswith('<d') else ''},{ahead if word.startswith('<d') else ''}",
        f"stop,closer,ahead={stop},{closer},{ahead if closer == 'quote' else ''}",
    ]
    return [zlib.crc32(x.encode()) % DIMENSIONS for x in names]


def candidates(text: str):
    """(key, whether the stop ends its line, match, unit start); what is no candidate by structure is left out."""
    start, after = 0, 0
    enclosed = [x.span() for x in _ENCLOSED.finditer(text)]
    e = 0
    breaks = [x.span() for x in _BREAK.finditer(text)] + [(len(text), len(text))]
    b = 0
    for m in _CANDIDATE.finditer(text):
        stop = m.start()
        while breaks[b][1] <= stop:
            start = max(start, breaks[b][1])
            b += 1
        end = m.end()
        gap_end = _GAP.match(text, end).end()
        ends = gap_end >= breaks[b][0]
        if not ends and gap_end == end and m.group(1)[0] in ".!?…" and not text[end].isupper():
            continue
        while e < len(enclosed) and enclosed[e][1] <= stop:
            e += 1
        if e < len(enclosed) and enclosed[e][0] <= stop and enclosed[e][1] > end:
            continue
        if e + 1 < len(enclosed) and enclosed[e + 1][0] <= stop < enclosed[e + 1][1] and enclosed[e + 1][1] > end:
            continue
        if not ends and _MARK.match(text, start, stop):
            continue
        if not ends and gap_end == end and m.group(1)[0] in ".!?…":
            # An address has no character of another script; a text without spaces that mentions mg/kg is none.
            token = _ADDRESS.search("".join(_last_words(text, start, stop, 1))).group()
            if "/" in token or "@" in token or token.lower().startswith("www") or _THAI.match(text, stop - 1):
                continue
        follow = _SPACE.match(text, end).end() if ends else gap_end
        yield _key(text, start, stop, m, follow), ends, end, gap_end


def units(text: str, decide) -> list[tuple[int, int]]:
    """(start, end) of the sentence units; ``decide(key)`` tells whether a candidate is a boundary."""
    cuts = [end for key, ends, end, _ in candidates(text) if not ends and decide(key)]
    if _THAI.search(text):
        mark_from = 0
        for x in _SIDE.finditer(text):
            if any(c in _LINE_BREAKS for c in x.group(2)):
                mark_from = x.end()
            elif (_THAI.search(x.group(1)) or _THAI.search(x.group(3))) and not _MARK.match(text, mark_from, x.end(1)):
                cuts.append(x.end(1))
                mark_from = x.end()
        cuts = sorted(set(cuts))
    hard = {x.start() for x in _BREAK.finditer(text)} | {len(text)}
    out, start = [], 0
    for cut in sorted(hard.union(cuts)):
        piece = text[start:cut]
        if cut not in hard and _ONLY_MARK.match(piece):
            continue
        left = len(piece) - len(piece.lstrip())
        piece = piece.strip()
        if piece:
            out.append((start + left, start + left + len(piece)))
        start = cut
    return out


def _types(key: tuple) -> str:
    stop, word, before = key[0], key[1], key[2]
    return f"{stop} {word}|{before}" if word.startswith("<d") else f"{stop} {word}"


def label(counts: dict[tuple, int], plain: dict[str, int]) -> list[tuple[tuple, float, int]]:
    """(key, label, weight) of the reliable candidates; ``counts`` is by (key, ends a line), ``plain`` counts the short words without a stop.

    A short word is taken for an abbreviation if it never ends a line with its stop and hardly occurs without it.
    """
    end, mid, starts = Counter(), Counter(), Counter()
    for (key, ends), n in counts.items():
        (end if ends else mid)[_types(key)] += n
        if ends or key[3] in ("none", "mark"):
            starts[key[6]] += n
    out = []
    for (key, ends), n in counts.items():
        stop, word, _, closer, gap, kind, ahead, _, case, script = key
        t = _types(key)
        cased = case in ("upper", "lower") or case == "digit" or case == "mark"
        if ends:
            y = 1.0 if stop != "…" else None
        elif stop in ".!?…" and kind == "lower" and (cased or word.startswith("<")):
            y = 0.0
        elif kind in ("mark", "none") and gap == "space" and stop in ".!?…":
            y = 0.0
        elif closer == "quote" and kind == "letter":
            y = 1.0 if starts[ahead] else 0.0 if n >= 3 else None
        elif stop == "…":
            y = 0.0
        elif stop != ".":
            y = 1.0
        elif word in ABBREVIATIONS and not end[t]:
            y = 0.0
        elif end[t]:
            y = 1.0 if end[t] * 40 >= mid[t] else 0.0
        elif word[0] == "<":
            y = 0.0 if mid[t] >= 12 else None
        elif mid[t] >= 3 and (len(word) == 1 or mid[t] > 4 * plain.get(word, 0)):
            y = 0.0
        elif len(word) > 2 and "." not in word and plain.get(word, 0) >= mid[t]:
            y = 1.0
        else:
            y = None
        if y is not None:
            out.append((key, y, n))
    return out


def fit(rows: list[tuple[tuple, float, int]], rounds: int = 150, rate: float = 0.5, penalty: float = 1e-5) -> np.ndarray:
    """Weights of the maximum-entropy model, by full-batch adaptive gradient steps."""
    w = np.zeros(DIMENSIONS)
    if not rows:
        return w
    x = np.array([_features(k) for k, _, _ in rows])
    y = np.array([r[1] for r in rows])
    n = np.log1p(np.array([r[2] for r in rows], dtype=float))
    n /= n.sum()
    square = np.full(DIMENSIONS, 1e-8)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(w[x].sum(axis=1), -30, 30)))
        g = np.bincount(x.ravel(), weights=np.repeat((p - y) * n, x.shape[1]), minlength=DIMENSIONS) + penalty * w
        square += g * g
        w -= rate * g / np.sqrt(square)
    return w


def train(texts: DataFrame, sample_texts: int = 6000) -> np.ndarray:
    """Model fitted on at most ``sample_texts`` rows of (rec_id, text), chosen by a hash of the id."""
    order = F.xxhash64("rec_kind", "rec_id")
    known = texts.filter("text is not null")
    # The range of hashes that holds about twice the sample, so that the ordering sees a bounded number of rows.
    share = min(1.0, 2.0 * sample_texts / max(1, texts.select("rec_kind", "rec_id").count()))
    near = known.filter(order < int(-(2**63) + share * (2**64 - 1))) if share < 1 else known
    sample = near.orderBy(order).limit(sample_texts)

    def extract(frames):
        import pandas as pd

        for pdf in frames:
            counts: Counter = Counter()
            for t in pdf["text"]:
                for key, ends, _, _ in candidates(t):
                    counts["\x1f".join(key), ends] += 1
                for word in t.split():
                    if len(word) <= 6 and word[-1].isalpha():
                        counts[word.lower(), None] += 1
            yield pd.DataFrame({"key": [k for k, _ in counts], "ends": [e for _, e in counts], "n": list(counts.values())})

    found = sample.select("text").mapInPandas(extract, "key string, ends boolean, n bigint").groupBy("key", "ends").agg(F.sum("n").alias("n"))
    counts: dict = defaultdict(int)
    plain: dict = defaultdict(int)
    for r in found.collect():
        if r["ends"] is None:
            plain[r["key"]] += r["n"]
        else:
            counts[tuple(r["key"].split("\x1f")), r["ends"]] += r["n"]
    return fit(label(counts, plain))


class Decider:
    """Remembers the decisions of a model; the memory is bounded."""

    def __init__(self, weights: np.ndarray, most: int = 400_000):
        self.weights, self.most, self.seen = weights, most, {}

    def __call__(self, key: tuple) -> bool:
        got = self.seen.get(key)
        if got is None:
            if len(self.seen) >= self.most:
                self.seen.clear()
            got = self.seen[key] = bool(self.weights[_features(key)].sum() > 0)
        return got


def split_sentences(texts: DataFrame, sample_texts: int = 6000) -> DataFrame:
    """(rec_kind, rec_id, start_pos, end_pos) of every unit; ``texts`` has rec_kind, rec_id and text."""
    weights = train(texts, sample_texts)

    def run(batches):
        import pyarrow as pa

        decide = Decider(weights)
        for batch in batches:
            kinds, ids, starts, ends = [], [], [], []
            for k, i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                got = units(t, decide)
                kinds += [k] * len(got)
                ids += [i] * len(got)
                starts += [a for a, _ in got]
                ends += [b for _, b in got]
            yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.string()), pa.array(ids, pa.int64()), pa.array(starts, pa.int64()), pa.array(ends, pa.int64())], ["rec_kind", "rec_id", "start_pos", "end_pos"])

    return texts.select("rec_kind", F.col("rec_id").cast("bigint").alias("rec_id"), "text").filter("text is not null").mapInArrow(run, "rec_kind string, rec_id bigint, start_pos bigint, end_pos bigint")
