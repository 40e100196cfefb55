"""Long exact spans shared between records, by repeated-phrase automata.

A run of ``least`` characters (a window) that stands in two records makes all its characters shared. Of each window the
phrase of ``PHRASE`` characters with the smallest hash is its anchor, so equal windows have equal anchors wherever they
stand. Phrases that are an anchor in two records are confirmed as recurring. The texts are dealt into shards by a hash;
the confirmed phrases of a shard's texts are compiled into one Aho-Corasick automaton, and the shard's texts are streamed
through it, which finds every occurrence that can be an anchor there. An occurrence carries its context, the
``2 * least - PHRASE`` characters that windows around it can reach; so one row stands for all of its windows. The contexts of
a phrase are compared where they meet: equal ones are shared as a whole, others as far as they agree on both sides.

A phrase with more than ``group_contexts`` occurrences is hot: its distinct contexts are taken apart into windows, which are
compared over all tasks by 128-bit hashes, so that no task holds a hot phrase. Both ways give the same spans.

Equal texts are one text with several records, shared as a whole. Texts shorter than a window, null and empty texts have
no span; a record that is repeated is one record. Repetition inside one record is none. Texts are known by a 128-bit key.
No group of records is gathered, and the shards grow in number, not in size.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from citeloom.session import materialise

PHRASE = 50
#: Characters that are hashed at once.
BLOCK = 400_000
_MASK = (1 << 64) - 1
_BASES = (0xD1342543DE82EF95, 0xAF251AF3B0F025B5)
_MIXES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


@lru_cache(maxsize=8)
def _powers(which: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    base = _BASES[which]
    out = []
    for x in (base, pow(base, -1, 1 << 64)):
        row = np.full(size, x, dtype=np.uint64)
        row[0] = 1
        out.append(np.cumprod(row))
    return out[0], out[1]


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)


def _hashes(codes: np.ndarray, length: int, which: int) -> np.ndarray:
    """Hash of every stretch of ``length`` characters, by prefix sums modulo 2**64."""
    n = len(codes)
    up, down = _powers(which, 1 << max(8, int(n - 1).bit_length()))
    c = (codes + np.uint64(1)) * _MIXES[which]
    c ^= c >> np.uint64(31)
    total = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(c * up[:n], out=total[1:])
    h = (total[length:] - total[:-length]) * down[: n - length + 1]
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xFF51AFD7ED558CCD)
    return h ^ (h >> np.uint64(33))


def _sliding(values: np.ndarray, width: int, pick) -> np.ndarray:
    """``pick`` (np.minimum or np.maximum) over every ``width`` neighbours, by block prefixes and suffixes."""
    n = len(values)
    pad = -n % width
    edge = np.uint64(_MASK) if pick is np.minimum else np.uint64(0)
    blocks = np.concatenate([values, np.full(pad, edge, dtype=np.uint64)]).reshape(-1, width)
    before = pick.accumulate(blocks, axis=1).ravel()
    after = pick.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return pick(after[: n - width + 1], before[width - 1 : n])


def anchor_positions(codes: np.ndarray, bounds: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions, hashes) of the phrases that are the anchor of a window; ``bounds`` are the ends of the texts in ``codes``, 0 first."""
    width = least - PHRASE + 1
    if len(codes) < least:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    h = _hashes(codes, PHRASE, 0)
    low = _sliding(h, width, np.minimum)
    # Only windows inside one text count.
    step = np.zeros(len(codes) + 1, dtype=np.int32)
    whole = np.flatnonzero(np.diff(bounds) >= least)
    np.add.at(step, bounds[whole], 1)
    np.add.at(step, bounds[whole + 1] - least + 1, -1)
    low[np.cumsum(step)[: len(low)] == 0] = 0
    edge = np.zeros(width - 1, dtype=np.uint64)
    at = np.flatnonzero(_sliding(np.concatenate([edge, low, edge]), width, np.maximum) == h)
    return at, h[at]


def _blocks(rows):
    """Lists of rows (…, text) of about ``BLOCK`` characters together."""
    block, size = [], 0
    for row in rows:
        block.append(row)
        size += len(row[-1])
        if size >= BLOCK:
            yield block
            block, size = [], 0
    if block:
        yield block


def _anchored(texts: list[str], least: int) -> tuple[str, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(all texts joined, their bounds, text number, place in it and hash of every anchor)."""
    joined = "".join(texts)
    bounds = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    at, h = anchor_positions(_codes(joined), bounds, least)
    which = np.searchsorted(bounds, at, side="right") - 1
    return joined, bounds, which, at - bounds[which], h


def _phrases(batches, least):
    """One row for each text and phrase that is an anchor in it."""
    import pyarrow as pa

    for batch in batches:
        shards, several = batch.column(0), batch.column(1)
        for block in _blocks(enumerate(batch.column(2).to_pylist())):
            rows = np.array([i for i, _ in block])
            joined, bounds, which, at, h = _anchored([t for _, t in block], least)
            order = np.lexsort((h, which))
            which, at, h = which[order], at[order], h[order]
            fresh = np.ones(len(h), dtype=bool)
            fresh[1:] = (which[1:] != which[:-1]) | (h[1:] != h[:-1])
            first = np.flatnonzero(fresh)
            n = np.diff(np.concatenate([first, [len(h)]]))
            here = pa.array(rows[which[first]])
            places = (bounds[which[first]] + at[first]).tolist()
            yield pa.RecordBatch.from_arrays([shards.take(here), several.take(here), pa.array(h[first].view(np.int64)), pa.array(n), pa.array([joined[p : p + PHRASE] for p in places], pa.string())], ["shard", "several", "ph", "n", "phrase"])


def _contexts(batches, least, group_contexts):
    """The occurrences that the automaton of their shard finds, each with its context; rows come by shard, phrases first."""
    import ahocorasick
    import pyarrow as pa

    names = ["ph", "hot", "key", "several", "pos", "head", "context"]
    reach, last = least - PHRASE, PHRASE - 1

    def located(automaton, rows):
        """The rows with an occurrence, with the ends of all of them and what the automaton knows of each phrase."""
        for key, several, text in rows:
            if found := dict(automaton.iter(text)):
                yield key, several, found, text

    def made(automaton, rows):
        for block in _blocks(located(automaton, rows)):
            keys, several, found, texts = zip(*block)
            _, _, which, at, _ = _anchored(list(texts), least)
            hits = [(i, p, known) for i, p in zip(which.tolist(), at.tolist()) if (known := found[i].get(p + last))]
            rows_of = np.array([i for i, _, _ in hits], dtype=np.int64)
            pos = np.array([p for _, p, _ in hits], dtype=np.int64)
            start = np.maximum(0, pos - reach)
            contexts = [texts[i][a : p + least] for (i, p, _), a in zip(hits, start.tolist())]
            here = pa.array(rows_of)
            columns = [
                pa.array([known[0] for _, _, known in hits], pa.int64()),
                pa.array([known[1] > group_contexts for _, _, known in hits], pa.bool_()),
                pa.array(keys, pa.binary()).take(here),
                pa.array(several, pa.bool_()).take(here),
                pa.array(pos),
                pa.array((pos - start).astype(np.int32)),
                pa.array(contexts, pa.string()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names)

    shard, automaton, waiting = None, None, []
    for batch in batches:
        for at, is_text, key, several, ph, n, text in zip(*(batch.column(i).to_pylist() for i in range(7))):
            if at != shard:
                if waiting:
                    yield from made(automaton, waiting)
                shard, automaton, waiting = at, ahocorasick.Automaton(), []
            if not is_text:
                automaton.add_word(text, (ph, n))
            elif len(automaton):
                if automaton.kind != ahocorasick.AHOCORASICK:
                    automaton.make_automaton()
                waiting.append((key, several, text))
        if waiting:
            yield from made(automaton, waiting)
            waiting = []


def _agreeing(a: str, b: str) -> int:
    """Length of the common beginning."""
    if a == b:
        return len(a)
    low, high = 0, min(len(a), len(b))
    while low < high:
        middle = (low + high + 1) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle - 1
    return low


def shared_parts(contexts: list[tuple[int, str, bytes | None]], least: int) -> list[list[tuple[int, int]]]:
    """For each distinct context of a phrase (its place in it, the text, its one record or None if it has several) the stretches shared with another record."""
    out: list[list[tuple[int, int]]] = [[] if key is not None else [(0, len(text))] for _, text, key in contexts]
    if len(contexts) <= 12:
        sides = [(text[:head][::-1], text[head:]) for head, text, _ in contexts]
        for i, (_, _, a) in enumerate(contexts):
            for j in range(i):
                b = contexts[j][2]
                if a is None and b is None or a == b:
                    continue
                before, after = _agreeing(sides[i][0], sides[j][0]), _agreeing(sides[i][1], sides[j][1])
                if before + after >= least:
                    for x, key in ((i, a), (j, b)):
                        if key is not None:
                            out[x].append((contexts[x][0] - before, contexts[x][0] + after))
        return out
    owner: dict = {}
    windows = [[(head - s, text[s : s + least]) for s in range(min(head, len(text) - least) + 1)] for head, text, _ in contexts]
    for mine, (_, _, key) in zip(windows, contexts):
        for w in mine:
            owner[w] = key if owner.get(w, key) == key else None
    for i, (mine, (head, _, key)) in enumerate(zip(windows, contexts)):
        if key is not None:
            out[i] = [(head - before, head - before + least) for before, w in mine if owner[before, w] is None]
    return out


def merged(parts: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(parts):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _settle(batches, least):
    """Shared stretches of each text from the contexts of each phrase; rows come by phrase."""
    import pyarrow as pa

    names = ["key", "start_pos", "end_pos"]

    def settled(group, out):
        by: dict = {}
        for row in group:
            by.setdefault((row[3], row[4]), []).append(row)
        contexts = []
        for (head, text), rows in by.items():
            keys = {r[0] for r in rows}
            contexts.append((head, text, None if len(keys) > 1 or any(r[1] for r in rows) else rows[0][0]))
        if len(contexts) > 1 or contexts[0][2] is None:
            for (head, text), rows, parts in zip(by, by.values(), shared_parts(contexts, least)):
                for a, b in merged(parts) if len(text) >= least else ():
                    for key, several, pos, _, _ in rows:
                        if not several:
                            for column, x in zip(out, (key, pos - head + a, pos - head + b)):
                                column.append(x)

    phrase, group = None, []
    for batch in batches:
        out: list[list] = [[] for _ in names]
        for ph, *row in zip(*(batch.column(i).to_pylist() for i in range(6))):
            if ph != phrase:
                if len(group) > 1 or group and group[0][1]:
                    settled(group, out)
                phrase, group = ph, []
            group.append(row)
        yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.binary()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64())], names)
    out = [[] for _ in names]
    if group:
        settled(group, out)
    yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.binary()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64())], names)


def _windows(batches, least):
    """The windows of contexts (head, context), as two hashes and the number of characters before the phrase."""
    import pyarrow as pa

    for batch in batches:
        ids, heads = [], []
        w1, w2 = [], []
        for i, head, text in zip(range(len(batch)), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
            n = min(head, len(text) - least) + 1
            if n <= 0:
                continue
            codes = _codes(text)
            for out, which in ((w1, 0), (w2, 1)):
                out.append(_hashes(codes, least, which)[:n].view(np.int64))
            ids.append(np.full(n, i))
            heads.append(head - np.arange(n))
        if ids:
            here = pa.array(np.concatenate(ids))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(here), batch.column(1).take(here), pa.array(np.concatenate(heads).astype(np.int32)), pa.array(np.concatenate(w1)), pa.array(np.concatenate(w2))], ["c1", "c2", "before", "w1", "w2"])


def _settle_hot(occurrences: DataFrame, least: int) -> DataFrame:
    """As ``_settle``, for phrases with any number of occurrences."""
    occurrences = occurrences.select("*", F.xxhash64("head", "context").alias("c1"), F.xxhash64(F.lit(1), "context", "head").alias("c2"))
    distinct = occurrences.groupBy("c1", "c2", "head", "context").agg(F.min("key").alias("a"), F.max("key").alias("b"), F.max("several").alias("several"))
    distinct = materialise(distinct.select("c1", "c2", "head", "context", F.when(~F.col("several") & (F.col("a") == F.col("b")), F.col("a")).alias("owner")), "span-contexts")
    windows = materialise(distinct.select("c1", "c2", "head", "context").mapInArrow(lambda x: _windows(x, least), "c1 bigint, c2 bigint, before int, w1 bigint, w2 bigint"), "span-windows")
    owned = windows.join(distinct.select("c1", "c2", "owner"), ["c1", "c2"])
    several = owned.groupBy("w1", "w2").agg(F.min("owner").alias("a"), F.max("owner").alias("b"), F.max(F.col("owner").isNull()).alias("some"))
    known = several.filter("some or a <> b").select("w1", "w2")
    shared = owned.filter("owner is not null").join(known, ["w1", "w2"], "left_semi").select("c1", "c2", "before")
    whole = distinct.filter("owner is null").select("c1", "c2", "head", F.length("context").alias("n"))
    parts = shared.select("c1", "c2", (-F.col("before")).alias("a"), (F.lit(least) - F.col("before")).alias("b")).unionByName(whole.select("c1", "c2", (-F.col("head")).alias("a"), (F.col("n") - F.col("head")).alias("b")))
    return occurrences.filter("not several").join(_islands(parts, ["c1", "c2"], "a", "b"), ["c1", "c2"]).select("key", (F.col("pos") + F.col("a")).alias("start_pos"), (F.col("pos") + F.col("b")).alias("end_pos"))


def _islands(spans: DataFrame, by: list[str], start: str, end: str) -> DataFrame:
    """Overlapping and touching spans of one key merged."""
    order = Window.partitionBy(*by).orderBy(start, end)
    reached = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = spans.withColumn("begins", F.coalesce((F.col(start) > reached).cast("int"), F.lit(1)))
    return marked.withColumn("island", F.sum("begins").over(order)).groupBy(*by, "island").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("island")


def shared_spans(records: DataFrame, least: int, shard_phrases: int = 8_000, group_contexts: int = 2_000) -> DataFrame:
    """(rec_kind, rec_id, start_pos, end_pos) of the maximal shared spans of ``records`` (rec_kind, rec_id, text), one row per record."""
    if least < PHRASE:
        raise ValueError(f"spans of less than {PHRASE} characters are not supported")
    key = F.unhex(F.md5("text"))
    records = records.filter(F.length("text") >= least).select("rec_kind", "rec_id", "text")
    grouped = records.groupBy("text").agg(F.count(F.lit(1)).alias("n"))
    texts = materialise(grouped.select(key.alias("key"), (F.col("n") > 1).alias("several"), "text"), "span-texts")
    # About two anchors stand in each window's length of phrases.
    anchors = (texts.agg(F.sum(F.length("text"))).first()[0] or 0) * 2 // (least - PHRASE + 2)
    shards = max(1, -(-anchors // shard_phrases))
    shard = F.pmod(F.xxhash64("key"), F.lit(shards).cast("bigint")).cast("int").alias("shard")
    phrases = materialise(texts.select(shard, "several", "text").mapInArrow(lambda b: _phrases(b, least), "shard int, several boolean, ph bigint, n bigint, phrase string"), "span-phrases")
    recurring = phrases.groupBy("ph").agg(F.count(F.lit(1)).alias("texts"), F.sum("n").alias("n"), F.max("several").alias("several"))
    confirmed = materialise(recurring.filter("texts > 1 or several").select("ph", "n"), "span-confirmed")
    none = F.lit(None)
    held = phrases.select("shard", "ph", "phrase").join(confirmed, "ph").select("shard", F.lit(False).alias("is_text"), none.cast("binary").alias("key"), none.cast("boolean").alias("several"), "ph", "n", F.col("phrase").alias("text"))
    stream = texts.select(shard, F.lit(True).alias("is_text"), "key", "several", none.cast("bigint").alias("ph"), none.cast("bigint").alias("n"), "text")
    ordered = held.unionByName(stream).repartition(shards, "shard").sortWithinPartitions("shard", "is_text")
    occurrences = ordered.mapInArrow(lambda b: _contexts(b, least, group_contexts), "ph bigint, hot boolean, key binary, several boolean, pos bigint, head int, context string")
    any_hot = not confirmed.filter(F.col("n") > group_contexts).isEmpty()
    if any_hot:
        occurrences = materialise(occurrences, "span-occurrences")
    plain = occurrences.filter("not hot").select("ph", "key", "several", "pos", "head", "context").repartition("ph").sortWithinPartitions("ph")
    spans = plain.mapInArrow(lambda b: _settle(b, least), "key binary, start_pos bigint, end_pos bigint")
    if any_hot:
        spans = spans.unionByName(_settle_hot(occurrences.filter("hot"), least))
    whole = texts.filter("several").select("key", F.lit(0).cast("bigint").alias("start_pos"), F.length("text").cast("bigint").alias("end_pos"))
    found = _islands(spans, ["key"], "start_pos", "end_pos").unionByName(whole)
    return records.select("rec_kind", "rec_id", key.alias("key")).join(found, "key").select("rec_kind", "rec_id", "start_pos", "end_pos")


def shared_shares(records: DataFrame, spans: DataFrame) -> DataFrame:
    """(rec_kind, rec_id, n_chars, shared_chars, share) of every record; the share of an empty or null text is null."""
    sums = spans.groupBy("rec_kind", "rec_id").agg(F.sum(F.col("end_pos") - F.col("start_pos")).alias("shared_chars"))
    out = records.select("rec_kind", "rec_id", F.length("text").cast("bigint").alias("n_chars")).join(sums, ["rec_kind", "rec_id"], "left")
    out = out.withColumn("shared_chars", F.coalesce("shared_chars", F.lit(0)))
    return out.withColumn("share", F.try_divide("shared_chars", "n_chars"))
