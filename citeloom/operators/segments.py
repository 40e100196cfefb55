"""Sentences of answers with their citation markers, as column expressions.

A marker becomes one mark character between the plain pieces of an answer, so that flattening, collapsing of blanks and
the splitting into sentences are regular expressions over one string, and every position follows from the length of what
stands before. Nothing leaves the JVM. Positions count characters of the plain text, without markers.

Null answers have no sentences. A sentence ends at a line break, or at a stop that is followed, after closing quotes and
more points, by white space or the end; a point after an abbreviation or a single letter ends none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeloom.functions.text import MARKER

#: Abbreviations that keep their point, what may follow a stop inside its sentence, words that leave a clause open.
ABBREVIATIONS = "e.g i.e eg ie vs etc cf al fig no eq approx dr mr mrs ms prof st ca vol ref incl max min".split()
AFTER_STOP = ".\"'"
OPEN_WORDS = (
    "because since as such based on including include includes namely comprising like than from to of for with by that which when while if the a an is are was were be being about into at via should must can may will shows showing demonstrating indicating evaluate assess assesses emphasize emphasizes highlight highlights reassure normalize note noting following ensure ensures targets target recommends"
).split()
#: Spans of this length that hold a closed quotation inside are split again.
RESPLIT_LENGTH, RESPLIT_CUE = 300, r"[.!?][\"”]{space}+[^{blank}]"

#: White space of any script, as the inside of a character class that Java and RE2 share.
BLANK = r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
SPACE = f"[{BLANK}]"
MARK, CUT = "\x01", "\x02"

_PROTECTED = r"(?<![\p{L}.])\.{0,9}(?:(?i:" + "|".join(a.replace(".", r"\.") for a in ABBREVIATIONS) + r")|\p{L})\.{0,9}"
#: A stop that ends a sentence, with what still belongs to it.
END = rf"(?:[?!]|(?<!{_PROTECTED})\.)[{AFTER_STOP}]*(?={SPACE}|\z)"
_CLOSERS = rf"[”\"')*|\]{BLANK}]*"
OPEN_END = r"(?:(?:^|[^A-Za-z'/-])['/-]*(?:" + "|".join(OPEN_WORDS) + rf")|:){_CLOSERS}\z"
GOES_ON = r"^[ \t,;]*[^ \t,;.!?\r\n]"


def flat_line(line: Column) -> Column:
    """A line of Markdown as text: headings and lines that only introduce others are empty, emphasis and list marks are gone."""
    bare = F.regexp_replace(F.translate(line, "*`", ""), r"^[ \t]*(?:[-+]|\d+[.)])[ \t]+", "")
    return F.when(F.rlike(line, F.lit(r"^[ \t]*#{1,6}[ \t]")), "").when(F.rlike(bare, F.lit(r"^[^.!?]*:[ \t]*\z")), "").otherwise(bare)


def flat(piece: Column) -> Column:
    """A piece between markers as text; its first line begins with it."""
    linked = F.regexp_replace(piece, r"\[([^\]]+)\]\([^)]*\)", "$1")
    return F.array_join(F.transform(F.split(linked, "\n", -1), flat_line), "\n")


def marked(answer: Column) -> Column:
    """The plain text with ``MARK`` for each marker; of a run of blanks the last one stays, behind the marks inside the run."""
    pieces = F.transform(F.split(F.translate(answer, MARK + CUT, ""), MARKER, -1), flat)
    return F.translate(F.regexp_replace(F.array_join(pieces, MARK), rf"[ \t](?={MARK}*[ \t])", ""), "\t", " ")


def _upto(sizes: Column, n) -> Column:
    """Sum of the first ``n`` sizes."""
    return F.aggregate(F.slice(sizes, F.lit(1), n), F.lit(0), lambda a, x: a + x)


def _placed(parts: Column, sizes: Column) -> Column:
    """(start, end, text) of parts that follow each other, without leading white space; blank parts are left out.

    Both are columns of their own: an expression in their place would be worked out again for every part.
    """
    trimmed = F.transform(parts, lambda x, i: F.struct(_upto(sizes, i).alias("at"), x.alias("x"), F.regexp_replace(x, rf"^{SPACE}+", "").alias("own")))
    shown = F.filter(trimmed, lambda p: F.length(p["own"]) > 0)
    line_end = lambda p: F.length(p["x"]) - F.endswith(p["x"], F.lit("\n")).cast("int")
    return F.transform(shown, lambda p: F.struct((p["at"] + F.length(p["x"]) - F.length(p["own"])).alias("start"), (p["at"] + line_end(p)).alias("end"), F.regexp_replace(F.regexp_replace(p["own"], rf"{SPACE}+\z", ""), rf"{SPACE}+", " ").alias("text")))


def with_sentences(rows: DataFrame, column: str) -> DataFrame:
    """``rows`` with sentences: array<struct<start, end, text>> of the plain text in ``column``."""
    cut = F.split(F.regexp_replace(F.regexp_replace(column, END, "$0" + CUT), "\n", "\n" + CUT), CUT, -1)
    sized = rows.withColumn("parts_", cut).withColumn("sizes_", F.transform("parts_", F.length))
    return sized.withColumn("sentences", _placed(F.col("parts_"), F.col("sizes_"))).drop("parts_", "sizes_")


def resplit(spans: DataFrame, key: str = "answer_id") -> DataFrame:
    """Spans (key, sent_idx, start_pos, end_pos, text) of any splitter, long ones with a closed quotation inside taken apart by the rules."""
    cue = RESPLIT_CUE.format(space=SPACE, blank=BLANK)
    parts = F.col("sentences")
    again = (F.length("text") >= RESPLIT_LENGTH) & F.rlike("text", F.lit(cue))
    own = F.array(F.struct(F.lit(0).alias("start"), F.length("text").alias("end"), F.col("text").alias("text")))
    each = with_sentences(spans, "text").select(key, "sent_idx", "start_pos", F.explode(F.when(again & (F.size(parts) > 1), parts).otherwise(own)).alias("p"))
    placed = each.select(key, (F.col("start_pos") + F.col("p.start")).alias("start_pos"), (F.col("start_pos") + F.col("p.end")).alias("end_pos"), F.col("p.text").alias("text"))
    gathered = placed.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("start_pos", "end_pos", "text"))).alias("s"))
    return gathered.select(key, F.posexplode("s").alias("sent_idx", "s")).select(key, F.col("sent_idx").cast("bigint").alias("sent_idx"), F.col("s.start_pos").cast("bigint").alias("start_pos"), F.col("s.end_pos").cast("bigint").alias("end_pos"), "s.text")


def segmented(answers: DataFrame) -> DataFrame:
    """(answer_id, plain, sentences, marks): the plain text, its sentences in order and the position of each marker."""
    one = answers.select("answer_id", marked(F.coalesce("answer", F.lit(""))).alias("m")).withColumn("sizes", F.transform(F.split("m", MARK, -1), F.length))
    marks = F.transform(F.slice("sizes", F.lit(1), F.size("sizes") - 1), lambda _, i: _upto(F.col("sizes"), i + 1))
    one = one.select("answer_id", F.translate("m", MARK, "").alias("plain"), marks.alias("marks"))
    return with_sentences(one, "plain").select("answer_id", "plain", "sentences", "marks")


def holder(sentences: Column, pos: Column) -> Column:
    """Index of the sentence that holds a position, else of the last one that ends before it, else of the first; null without sentences."""
    numbered = F.transform(sentences, lambda s, i: F.struct(i.alias("i"), s["start"].alias("start"), s["end"].alias("end")))
    inside = F.array_min(F.transform(F.filter(numbered, lambda s: (s["start"] <= pos) & (pos < s["end"])), lambda s: s["i"]))
    before = F.array_max(F.transform(F.filter(numbered, lambda s: s["end"] <= pos), lambda s: s["i"]))
    return F.coalesce(inside, before, F.when(F.size(sentences) > 0, F.lit(0)))


def breaks_clause(before: Column, after: Column) -> Column:
    """Whether a marker between ``before`` and ``after`` stands where a complement of its sentence belongs."""
    return F.rlike(before, F.lit(OPEN_END)) & F.rlike(after, F.lit(GOES_ON))


def _marker_arrays(answers: DataFrame) -> DataFrame:
    """``segmented`` with the arrays held (the sentence of each marker) and broken (whether it is malformed)."""
    one = segmented(answers)
    broken = F.transform("marks", lambda p: breaks_clause(F.left("plain", p), F.substring("plain", p + 1, F.length("plain"))))
    return one.withColumns({"held": F.transform("marks", lambda p: holder(F.col("sentences"), p)), "broken": broken})


def sentence_rows(answers: DataFrame) -> DataFrame:
    """(answer_id, sent_idx, start_pos, end_pos, text, n_markers, malformed) of every sentence."""
    count = lambda i: F.size(F.filter("held", lambda h: h == i))
    bad = lambda i: F.exists(F.arrays_zip("held", "broken"), lambda x: (x["held"] == i) & x["broken"])
    full = F.transform("sentences", lambda s, i: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["text"].alias("text"), count(i).alias("n"), bad(i).alias("bad")))
    each = _marker_arrays(answers).select("answer_id", F.posexplode(full).alias("i", "s"))
    return each.select("answer_id", F.col("i").cast("bigint").alias("sent_idx"), F.col("s.start").cast("bigint").alias("start_pos"), F.col("s.end").cast("bigint").alias("end_pos"), "s.text", F.col("s.n").cast("bigint").alias("n_markers"), F.coalesce("s.bad", F.lit(False)).alias("malformed"))


def marker_rows(answers: DataFrame) -> DataFrame:
    """(answer_id, marker_idx, pos, sent_idx, sentence, malformed) of every marker."""
    each = _marker_arrays(answers).select("answer_id", "sentences", F.posexplode(F.arrays_zip("marks", "held", "broken")).alias("i", "x"))
    return each.select("answer_id", F.col("i").cast("bigint").alias("marker_idx"), F.col("x.marks").cast("bigint").alias("pos"), F.col("x.held").cast("bigint").alias("sent_idx"), F.get("sentences", F.col("x.held"))["text"].alias("sentence"), F.col("x.broken").alias("malformed"))


def atoms(answers: DataFrame) -> DataFrame:
    """(answer_id, marker_idx, claim, quote, doc_id, guideline_id, section_id) of every marker; a marker without a sentence has the claim ''."""
    docs, quotes = (F.regexp_extract_all("answer", F.lit(MARKER), F.lit(g)) for g in (1, 2))
    cited = answers.select("answer_id", F.posexplode(F.arrays_zip(docs.alias("doc"), quotes.alias("quote"))).alias("marker_idx", "m"))
    cited = cited.select("answer_id", F.col("marker_idx").cast("bigint").alias("marker_idx"), F.btrim("m.doc").alias("doc_id"), F.col("m.quote").alias("quote"))
    both = cited.join(marker_rows(answers).select("answer_id", "marker_idx", "sentence"), ["answer_id", "marker_idx"])
    colon = F.instr(F.col("doc_id"), ":")
    guideline = F.when(colon > 0, F.substring_index("doc_id", ":", 1)).otherwise(F.col("doc_id"))
    section = F.when(colon > 0, F.substring("doc_id", colon + 1, F.length("doc_id"))).otherwise("")
    return both.select("answer_id", "marker_idx", F.coalesce("sentence", F.lit("")).alias("claim"), "quote", "doc_id", guideline.alias("guideline_id"), section.alias("section_id"))


def numbered_markers(answer: Column, before: str, after: str) -> Column:
    """The text with ``before``, the number from 1 and ``after`` for each marker."""
    return F.array_join(F.transform(F.split(answer, MARKER, -1), lambda x, i: F.when(i > 0, F.concat(F.lit(before), i.cast("string"), F.lit(after), x)).otherwise(x)), "")


def inconsistent(answers: DataFrame) -> DataFrame:
    """(answer_id, n_raw, n_segmented) of the answers whose markers were not all found again after flattening."""
    raw = F.size(F.regexp_extract_all("answer", F.lit(MARKER), F.lit(1)))
    both = answers.select("answer_id", F.coalesce(raw, F.lit(0)).cast("bigint").alias("n_raw")).join(segmented(answers).select("answer_id", F.size("marks").cast("bigint").alias("n_segmented")), "answer_id")
    return both.filter("n_raw <> n_segmented")
