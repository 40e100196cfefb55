"""Queries about the sentences of answers and the markers in them, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from citeloom.operators import citations, segments
from citeloom.plans.citation_queries import _A, _RE, answers_once


def answer_sentences(spark, sf_dir):
    return segments.sentence_rows(answers_once(spark, sf_dir))


def marker_sentences(spark, sf_dir):
    return segments.marker_rows(answers_once(spark, sf_dir)).drop("sentence")


def malformed_gate(spark, sf_dir):
    return segments.marker_rows(answers_once(spark, sf_dir)).groupBy("answer_id").agg(F.count(F.lit(1)).alias("n_markers"), F.count_if("malformed").alias("n_malformed"))


def citation_atoms(spark, sf_dir):
    return segments.atoms(answers_once(spark, sf_dir))


def placeholder_answers(spark, sf_dir):
    """Answers with numbered placeholders, and as shown to a reader."""
    return answers_once(spark, sf_dir).select("answer_id", segments.numbered_markers(F.col("answer"), "[CITE_", "]").alias("placeholdered"), segments.numbered_markers(F.col("answer"), "[", "]").alias("shown"))


def marker_consistency(spark, sf_dir):
    """One row: answers, and those in which flattening lost or made a marker (none may)."""
    answers = answers_once(spark, sf_dir)
    return answers.agg(F.count(F.lit(1)).alias("n_answers")).crossJoin(segments.inconsistent(answers).agg(F.count(F.lit(1)).alias("n_inconsistent")))


def line_resplit(spark, sf_dir):
    return segments.resplit(citations.line_spans(answers_once(spark, sf_dir)))


_q = lambda text: text.replace("'", "''")
_SP = segments.SPACE
_LINE = f"CASE WHEN regexp_matches(l, '^[ \\t]*#{{1,6}}[ \\t]') THEN '' WHEN regexp_matches(regexp_replace(translate(l, '*`', ''), '^[ \\t]*(?:[-+]|\\d+[.)])[ \\t]+', ''), '^[^.!?]*:[ \\t]*$') THEN '' ELSE regexp_replace(translate(l, '*`', ''), '^[ \\t]*(?:[-+]|\\d+[.)])[ \\t]+', '') END"
_FLAT = f"list_transform(string_split_regex(coalesce(translate(answer, chr(1) || chr(2), ''), ''), '{_RE}'), lambda p: array_to_string(list_transform(string_split(regexp_replace(p, '\\[([^\\]]+)\\]\\([^)]*\\)', '\\1', 'g'), chr(10)), lambda l: {_LINE}), chr(10)))"
_BLANKS = f"regexp_replace(array_to_string({_FLAT}, chr(1)), '[ \\t]+', ' ', 'g')"
for _ in range(12):
    _BLANKS = f"regexp_replace({_BLANKS}, ' (\\x01+) ', '\\1 ', 'g')"
_ABBR = "[" + ", ".join(f"'{a}'" for a in segments.ABBREVIATIONS) + "]"


def _sentences(source: str, key: str, column: str) -> str:
    """CTEs that give sn (key, sent_idx, start_pos, end_pos, text) of the texts of a relation."""
    trail = f"'^[{_q(segments.AFTER_STOP)}]*(?:{_SP}|$)'"
    return f"""
st0 AS (SELECT {key}, {column} AS plain, regexp_extract_all({column}, '[^.?!\\n]*[.?!\\n]') AS f FROM {source}),
st1 AS (SELECT {key}, plain, (list_sum(list_transform(f[1:i], lambda x: length(x))) - 1)::BIGINT AS e, right(f[i], 1) AS c FROM (SELECT *, unnest(range(1, len(f) + 1)) AS i FROM st0)),
st2 AS (SELECT *, substr(plain, e + 2) AS after, trim(lower(regexp_extract(left(plain, e), '([\\p{{L}}.]*)$', 1)), '.') AS token FROM st1),
st3 AS (SELECT DISTINCT {key}, CASE WHEN c = chr(10) THEN e + 1 ELSE e + 1 + length(regexp_extract(after, '^[{_q(segments.AFTER_STOP)}]*')) END AS cut, c = chr(10) AS hard FROM st2
        WHERE c = chr(10) OR (regexp_matches(after, {trail}) AND NOT (c = '.' AND (list_contains({_ABBR}, token) OR length(token) = 1)))),
st4 AS (SELECT {key}, cut, bool_or(hard) AS hard FROM st3 GROUP BY 1, 2 UNION ALL SELECT {key}, length(plain), false FROM st0),
st5 AS (SELECT {key}, cut, hard, coalesce(lag(cut) OVER (PARTITION BY {key} ORDER BY cut, hard DESC), 0) AS prev FROM st4),
st6 AS (SELECT st5.*, substr(plain, prev + 1, cut - prev) AS piece FROM st5 JOIN st0 USING ({key})),
st7 AS (SELECT *, regexp_replace(piece, '^{_SP}+', '') AS own FROM st6),
sn AS (SELECT {key}, (row_number() OVER (PARTITION BY {key} ORDER BY cut) - 1)::BIGINT AS sent_idx, (cut - length(own))::BIGINT AS start_pos, (cut - hard::INT)::BIGINT AS end_pos, regexp_replace(regexp_replace(own, '{_SP}+$', ''), '{_SP}+', ' ', 'g') AS text FROM st7 WHERE length(own) > 0)"""


_SEG = f"""a AS ({_A}), mk AS (SELECT answer_id, answer, {_BLANKS} AS m FROM a), pl0 AS (SELECT answer_id, answer, replace(m, chr(1), '') AS plain, string_split(m, chr(1)) AS parts FROM mk), {_sentences("pl0", "answer_id", "plain")},
mr0 AS (SELECT answer_id, plain, (i - 1)::BIGINT AS marker_idx, list_sum(list_transform(parts[1:i], lambda x: length(x)))::BIGINT AS pos FROM (SELECT *, unnest(range(1, len(parts))) AS i FROM pl0)),
mr1 AS (SELECT r.answer_id, r.marker_idx, any_value(r.pos) AS pos, any_value(r.plain) AS plain, coalesce(min(CASE WHEN s.start_pos <= r.pos AND r.pos < s.end_pos THEN s.sent_idx END), max(CASE WHEN s.end_pos <= r.pos THEN s.sent_idx END), min(s.sent_idx)) AS sent_idx FROM mr0 r LEFT JOIN sn s USING (answer_id) GROUP BY 1, 2),
mr AS (SELECT answer_id, marker_idx, pos, sent_idx, regexp_matches(left(plain, pos), '{_q(segments.OPEN_END)}') AND regexp_matches(substr(plain, pos + 1), '{_q(segments.GOES_ON)}') AS malformed FROM mr1)"""
_NUMBERED = lambda a: f"array_to_string(list_transform(string_split_regex(answer, '{_RE}'), lambda x, i: CASE WHEN i > 1 THEN '{a}' || (i - 1)::VARCHAR || ']' || x ELSE x END), '')"
_CUE = segments.RESPLIT_CUE.format(space=_SP, blank=segments.BLANK)

QUERIES = {f.__name__: f for f in (answer_sentences, marker_sentences, malformed_gate, citation_atoms, placeholder_answers, marker_consistency, line_resplit)}


def _resplit_sql() -> str:
    from citeloom.plans.citation_queries import _LINES, _MARKS

    return f"""WITH {_MARKS}, {_LINES}, ln AS (SELECT row_number() OVER () AS k, * FROM s), {_sentences("ln", "k", "text")},
n AS (SELECT k, count(*) AS n FROM sn GROUP BY 1),
o AS (SELECT ln.answer_id, ln.start_pos + sn.start_pos AS start_pos, ln.start_pos + sn.end_pos AS end_pos, sn.text FROM ln JOIN n USING (k) JOIN sn USING (k) WHERE n.n > 1 AND length(ln.text) >= {segments.RESPLIT_LENGTH} AND regexp_matches(ln.text, '{_q(_CUE)}')
      UNION ALL SELECT ln.answer_id, ln.start_pos, ln.start_pos + length(ln.text), ln.text FROM ln LEFT JOIN n USING (k) WHERE NOT (coalesce(n.n, 0) > 1 AND length(ln.text) >= {segments.RESPLIT_LENGTH} AND regexp_matches(ln.text, '{_q(_CUE)}')))
SELECT answer_id, (row_number() OVER (PARTITION BY answer_id ORDER BY start_pos) - 1)::BIGINT AS sent_idx, start_pos::BIGINT AS start_pos, end_pos::BIGINT AS end_pos, text FROM o"""


ORACLE_SQL = {
    "answer_sentences": f"WITH {_SEG} SELECT sn.answer_id, sn.sent_idx, sn.start_pos, sn.end_pos, sn.text, count(mr.marker_idx)::BIGINT AS n_markers, coalesce(bool_or(mr.malformed), false) AS malformed FROM sn LEFT JOIN mr ON mr.answer_id = sn.answer_id AND mr.sent_idx = sn.sent_idx GROUP BY ALL",
    "marker_sentences": f"WITH {_SEG} SELECT answer_id, marker_idx, pos, sent_idx, malformed FROM mr",
    "malformed_gate": f"WITH {_SEG} SELECT answer_id, count(*)::BIGINT AS n_markers, count(*) FILTER (malformed)::BIGINT AS n_malformed FROM mr GROUP BY 1",
    "citation_atoms": f"WITH {_SEG}, d AS (SELECT answer_id, regexp_extract_all(answer, '{_RE}', 1) AS docs, regexp_extract_all(answer, '{_RE}', 2) AS quotes FROM a), e AS (SELECT answer_id, (i - 1)::BIGINT AS marker_idx, trim(docs[i], ' ') AS doc_id, quotes[i] AS quote FROM (SELECT *, unnest(range(1, len(docs) + 1)) AS i FROM d)) SELECT e.answer_id, e.marker_idx, coalesce(sn.text, '') AS claim, e.quote, e.doc_id, CASE WHEN contains(e.doc_id, ':') THEN split_part(e.doc_id, ':', 1) ELSE e.doc_id END AS guideline_id, CASE WHEN contains(e.doc_id, ':') THEN substr(e.doc_id, strpos(e.doc_id, ':') + 1) ELSE '' END AS section_id FROM e JOIN mr USING (answer_id, marker_idx) LEFT JOIN sn ON sn.answer_id = e.answer_id AND sn.sent_idx = mr.sent_idx",
    "placeholder_answers": f"WITH a AS ({_A}) SELECT answer_id, {_NUMBERED('[CITE_')} AS placeholdered, {_NUMBERED('[')} AS shown FROM a",
    "marker_consistency": f"WITH {_SEG}, w AS (SELECT a.answer_id, coalesce(len(regexp_extract_all(a.answer, '{_RE}')), 0) AS n, (SELECT count(*) FROM mr WHERE mr.answer_id = a.answer_id) AS k FROM a) SELECT count(*)::BIGINT AS n_answers, count(*) FILTER (n <> k)::BIGINT AS n_inconsistent FROM w",
    "line_resplit": _resplit_sql(),
}
