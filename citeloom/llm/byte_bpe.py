"""Byte-level BPE over whole batches of texts.

A batch of texts becomes one flat array of code points. Word boundaries of the public pre-tokenizer pattern are found
by class changes in that array, equal words are found by hash and confirmed character by character, and the distinct
words are merged together: an index maps each pair to all its positions in the batch, the active ranks are applied in
ascending order, and the lists of the touched pairs are updated.

Null and empty texts have an empty list of ids. Texts are processed whole.
"""

from __future__ import annotations

import heapq
import json
from functools import lru_cache

import numpy as np

LETTER, NUMBER, OTHER, SPACE, DIVIDER = 0, 1, 2, 3, 4
_MIX = np.uint64(0x9E3779B97F4A7C15)
_BASE = np.uint64(0xD1342543DE82EF95)


def default_vocabulary() -> str:
    """Path of the public vocabulary; a parameter everywhere else."""
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """Class of every code point as the public pattern sees it."""
    import regex

    table = np.full(0x110000, OTHER, dtype=np.uint8)
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    for code, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
        for m in regex.finditer(pattern, every):
            table[ord(m.group()[0]) : ord(m.group()[-1]) + 1] = code
    return table


@lru_cache(maxsize=2)
def load_vocabulary(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(id of each byte; left, right and merged id of each rank; sorted pair keys and their ranks)."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    ids = model["vocab"]
    merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
    # Printable stand-ins of bytes: printable ones stand for themselves, the rest are numbered from 256.
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    shown = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(x for x in range(256) if x not in set(plain))}
    of_byte = np.array([ids[shown[b]] for b in range(256)], dtype=np.int64)
    left = np.array([ids[a] for a, _ in merges], dtype=np.int64)
    right = np.array([ids[b] for _, b in merges], dtype=np.int64)
    merged = np.array([ids[a + b] for a, b in merges], dtype=np.int64)
    keys = (left << 20) | right
    order = np.argsort(keys, kind="stable")
    return of_byte, left, right, merged, keys[order], order


def _word_starts(codes: np.ndarray, kind: np.ndarray) -> np.ndarray:
    """True where a word of the pre-tokenizer begins (dividers included)."""
    n = len(codes)
    start = np.ones(n, dtype=bool)
    start[1:] = kind[1:] != kind[:-1]
    nxt = np.full(n, DIVIDER, dtype=np.uint8)
    nxt[:-1] = kind[1:]
    # The last white space before a word stands alone; a plain space joins that word.
    last = np.flatnonzero((kind == SPACE) & (nxt < SPACE))
    start[last] = True
    start[last[codes[last] == 32] + 1] = False
    # Contractions: a lone apostrophe that begins a word, with its ending.
    quote = np.flatnonzero((codes == 39) & start & (nxt == LETTER))
    if len(quote):
        far = np.concatenate([codes, np.zeros(3, dtype=codes.dtype)])
        kinds = np.concatenate([kind, np.full(3, DIVIDER, dtype=np.uint8)])
        a, b = far[quote + 1], far[quote + 2]
        one = np.isin(a, [ord(c) for c in "stmd"])
        two = ((a == ord("r")) | (a == ord("v"))) & (b == ord("e")) | (a == ord("l")) & (b == ord("l"))
        for which, size in ((one, 2), (~one & two, 3)):
            at = quote[which]
            start[at + 1] = False
            rest = at + size
            start[rest[kinds[rest] == LETTER]] = True
    start[kind == DIVIDER] = True
    after = np.flatnonzero(kind == DIVIDER) + 1
    start[after[after < n]] = True
    return start


def _distinct(codes: np.ndarray, begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(word number of each place, a place of each word); equal hashes are confirmed on the characters."""
    mixed = (codes.astype(np.uint64) + np.uint64(1)) * _MIX
    mixed ^= mixed >> np.uint64(29)
    power = np.cumprod(np.full(int(size.max()), _BASE, dtype=np.uint64))
    flat_begin = np.zeros(len(begin), dtype=np.int64)
    np.cumsum(size[:-1], out=flat_begin[1:])
    small = size.astype(np.int32)
    within = np.arange(int(size.sum()), dtype=np.int32) - np.repeat(flat_begin.astype(np.int32), small)
    source = np.repeat(begin.astype(np.int32), small) + within
    h = np.add.reduceat(mixed[source] * power[within], flat_begin)
    h ^= h >> np.uint64(32)
    _, place, number = np.unique(h, return_index=True, return_inverse=True)
    rep = place[number]
    if (size[rep] == size).all() and (codes[np.repeat(begin[rep].astype(np.int32), small) + within] == codes[source]).all():
        return number, place
    seen: dict[bytes, int] = {}
    number = np.empty(len(begin), dtype=np.int64)
    places = []
    for i, (b, s) in enumerate(zip(begin.tolist(), size.tolist())):
        key = codes[b : b + s].tobytes()
        if key not in seen:
            seen[key] = len(places)
            places.append(i)
        number[i] = seen[key]
    return number, np.array(places, dtype=np.int64)


def merge_words(words: list[bytes], path: str) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all words one after the other, number of ids of each word)."""
    of_byte, left, right, merged, keys, rank_of = load_vocabulary(path)
    size = np.array([len(w) for w in words], dtype=np.int64)
    sym = of_byte[np.frombuffer(b"".join(words), dtype=np.uint8)]
    n = len(sym)
    end = np.cumsum(size)
    nxt = np.arange(1, n + 1, dtype=np.int64)
    prv = np.arange(-1, n - 1, dtype=np.int64)
    full = size > 0
    nxt[end[full] - 1] = -1
    prv[(end - size)[full]] = -1

    def ranks(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = (a << 20) | b
        at = np.searchsorted(keys, key)
        at[at == len(keys)] = 0
        return np.where(keys[at] == key, rank_of[at], -1)

    at = np.flatnonzero(nxt >= 0)
    r = ranks(sym[at], sym[nxt[at]])
    at, r = at[r >= 0], r[r >= 0]
    order = np.argsort(r, kind="stable")
    at, r = at[order], r[order]
    cuts = np.flatnonzero(np.diff(r)) + 1
    index: dict[int, list] = {int(r[c]): [part] for c, part in zip(np.concatenate([[0], cuts]).tolist(), np.split(at, cuts)) if len(part)}
    heap = list(index)
    heapq.heapify(heap)
    while heap:
        k = heapq.heappop(heap)
        found = index.pop(k)
        p = found[0] if isinstance(found[0], np.ndarray) else np.array(found[:1], dtype=np.int64)
        if len(found) > 1:
            p = np.unique(np.concatenate([p, np.array(found[1:], dtype=np.int64)]))
        q = nxt[p]
        p = p[(sym[p] == left[k]) & (q >= 0) & (sym[q] == right[k])]
        if left[k] == right[k] and len(p) > 1:
            keep, taken = [], -1
            for x in np.sort(p).tolist():
                if x != taken:
                    keep.append(x)
                    taken = int(nxt[x])
            p = np.array(keep, dtype=np.int64)
        if not len(p):
            continue
        q = nxt[p]
        after = nxt[q]
        sym[p] = merged[k]
        sym[q] = -1
        nxt[p] = after
        has = after >= 0
        prv[after[has]] = p[has]
        before = prv[p]
        lefts = np.concatenate([before[before >= 0], p[has]])
        if not len(lefts):
            continue
        r = ranks(sym[lefts], sym[nxt[lefts]])
        known = r >= 0
        for x, y in zip(r[known].tolist(), lefts[known].tolist()):
            got = index.get(x)
            if got is None:
                index[x] = [y]
                heapq.heappush(heap, x)
            else:
                got.append(y)
    alive = sym >= 0
    total = np.concatenate([[0], np.cumsum(alive)])
    return sym[alive].astype(np.int32), total[end] - total[end - size]


def encode_batch(texts: list[str | None], path: str) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all texts one after the other, offsets of length ``len(texts) + 1``)."""
    texts = [t or "" for t in texts]
    lengths = np.array([len(t) for t in texts], dtype=np.int64)
    offsets = np.zeros(len(texts) + 1, dtype=np.int64)
    if not lengths.sum():
        return np.zeros(0, dtype=np.int32), offsets
    joined = "\n".join(texts) + "\n"
    # A lone surrogate has no UTF-8 form; it is read as the replacement character.
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    kind = _classes()[codes]
    dividers = np.cumsum(lengths + 1) - 1
    kind[dividers] = DIVIDER
    begin = np.flatnonzero(_word_starts(codes, kind))
    size = np.diff(np.append(begin, len(codes)))
    real = kind[begin] != DIVIDER
    begin, size = begin[real], size[real]
    number, place = _distinct(codes, begin, size)
    words = [joined[b : b + s].encode("utf-8", "replace") for b, s in zip(begin[place].tolist(), size[place].tolist())]
    ids, count = merge_words(words, path)
    first = np.cumsum(count) - count
    each = count[number]
    cum = np.cumsum(each)
    flat = np.arange(int(cum[-1]), dtype=np.int64) + np.repeat(first[number] - (cum - each), each)
    done = np.concatenate([[0], cum])
    offsets[1:] = done[np.searchsorted(begin, dividers)]
    return ids[flat], offsets


def chunks(texts: list[str | None], most: int = 4_000_000):
    """Slices of a batch with a bounded number of characters (a single text is never cut)."""
    a = total = 0
    for i, t in enumerate(texts):
        n = len(t or "")
        if total + n > most and i > a:
            yield a, i
            a, total = i, 0
        total += n
    if a < len(texts):
        yield a, len(texts)


def encode_texts(df, id_column: str, text_column: str, vocabulary: str, counts_only: bool = False):
    """(id, ids) of every row, or (id, n_tokens) if ``counts_only``; one row per input row, null and empty texts included."""
    from pyspark.sql import functions as F

    kind = df.schema[id_column].dataType.simpleString()

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in chunks(texts):
                ids, offsets = encode_batch(texts[a:b], vocabulary)
                if counts_only:
                    made = pa.array(np.diff(offsets))
                else:
                    made = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), made], ["id", "made"])

    out = df.select(F.col(id_column).alias("id"), F.col(text_column).cast("string").alias("text")).mapInArrow(run, f"id {kind}, made {'bigint' if counts_only else 'array<int>'}")
    return out.select(F.col("id").alias(id_column), F.col("made").alias("n_tokens" if counts_only else "ids"))
