"""Column builders for text: quote normalisation, citation markers, digests."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field, fields

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

MARKER = r"\{\{cite:([^|}]+)\|([^}]*)\}\}"
WRAPPING = "“”‘’\"'"
BOUNDARY = ".,;:!?\"'()[]"
ELLIPSIS = r"[ ]*(?:\[[.]{3,}\]|[.]{3,})[ ]*"


@dataclass(frozen=True)
class Criteria:
    """How a quote may differ from its source and still be verbatim. Data, not code."""

    nfkc: bool = True
    superscript_references: bool = True
    # Characters folded before comparison and what they fold to; deleted apparatus.
    fold_from: str = "‘’“”‐‑‒–—"
    fold_to: str = "''\"\"-----"
    apparatus: tuple[str, ...] = field(default=("[†‡§¶*]", r"s[0-9]+\.[0-9]+-[0-9]+(?:[ ]*[-,][ ]*s?[0-9]+\.[0-9]+-[0-9]+)*", r"\|", '"'))
    least_fragment: int = 10
    least_fragments: int = 2

    @classmethod
    def from_json(cls, text: str) -> Criteria:
        """Rules out of a JSON object of these fields; those that are not named keep their values, unknown ones are an error."""
        given = json.loads(text)
        unknown = sorted(set(given) - {f.name for f in fields(cls)})
        if unknown:
            raise ValueError(f"unknown criteria: {', '.join(unknown)}")
        if len(given.get("fold_from", cls.fold_from)) != len(given.get("fold_to", cls.fold_to)):
            raise ValueError("fold_from and fold_to must have the same length")
        return cls(**{k: tuple(v) if isinstance(v, list) else v for k, v in given.items()})

    def to_json(self) -> str:
        return json.dumps(asdict(self), ensure_ascii=False)


#: The part of the rules that plain SQL engines share.
PLAIN = Criteria(nfkc=False, superscript_references=False)
FULL = Criteria()
_AFTER_PUNCTUATION = r"(?<![0-9][.,])(?<=[.,])[0-9]+(?:[-,–][0-9]+)*(?=\s|$)"


@F.pandas_udf(T.StringType())
def nfkc(text: pd.Series) -> pd.Series:
    """Compatibility composition; null stays null."""
    import unicodedata

    return text.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFKC", t))


def collapse(text: Column) -> Column:
    return F.regexp_replace(text, r"[ \t\n\x0B\f\r]+", " ")


def normalize(text: Column, criteria: Criteria = FULL) -> Column:
    """The comparable form of a quote or a source."""
    out = nfkc(text) if criteria.nfkc else text
    out = F.translate(F.lower(out), criteria.fold_from, criteria.fold_to)
    out = F.regexp_replace(out, r"\^[0-9]+", "")
    out = collapse(F.regexp_replace(out, r"(?dm)^[ \t]*[-*•][ \t]+", ""))
    rules = list(criteria.apparatus)
    if criteria.superscript_references:
        rules.insert(2, _AFTER_PUNCTUATION)
    out = collapse(F.regexp_replace(out, "|".join(rules), " "))
    return F.btrim(F.regexp_replace(out, r"[ ]+([,.;:)\]}])", "$1"))


def strip_markers(text: Column) -> Column:
    return F.regexp_replace(text, MARKER, "")


def cache_key(*parts: Column) -> Column:
    """SHA-256 over the parts joined by a control character that texts don't hold."""
    return F.sha2(F.concat_ws("\x01", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256)


def percentage(share: Column) -> Column:
    """A share as a percentage with one place, halves to even; n/a if there is none."""
    return F.when(share.isNotNull(), F.format_string("%.1f%%", F.bround(share * 100, 1))).otherwise("n/a")


def release_dir(model: Column, granularity: Column) -> Column:
    """The folder of a release: the model's slug and how its units were cut."""
    return F.concat_ws("_", model_slug(model), F.nullif(F.btrim(granularity), F.lit("")))


def model_slug(name: Column) -> Column:
    """Last segment of a model id, with points spelled out."""
    return F.regexp_replace(F.regexp_replace(name, r"^.*[:/]", ""), r"\.", "pt")


def nearest_rank(values: Column, q: float) -> Column:
    """Element at floor(q * n), capped, of the sorted array; null if it is empty."""
    n = F.size(values)
    return F.when(n > 0, F.element_at(F.array_sort(values), F.least(n, F.floor(F.lit(q) * n).cast("int") + 1)))
