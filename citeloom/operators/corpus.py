"""The corpus as retrieval units: eligibility, listing, scope, reading, and what is put before a model.

Nodes are those of ``operators.tree``: (guideline_id, section_id, ord, level, path, children, title, number, section_type,
rag_eligible, text_file, summary). A null eligibility counts as not eligible.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citeloom.operators.tree import KEY, ancestor_pairs, numbered

#: What stands for a missing summary, between evidence parts, and the characters a lookup may read.
NO_SUMMARY, BETWEEN, MOST_EVIDENCE = "(no summary)", "\n\n---\n\n", 380_000


@dataclass(frozen=True)
class Exclusions:
    """Which sections are no content: by id, by an ancestor, by the beginning of the id, by their exact title."""

    ids: tuple[str, ...] = ()
    subtrees: tuple[str, ...] = ()
    id_prefixes: tuple[str, ...] = ()
    titles: tuple[str, ...] = ()


def is_eligible(rules: Exclusions) -> Column:
    """Whether a node (section_id, path, title) is content under the rules; one without a title has none to be excluded by."""
    out = ~F.col("section_id").isin(*rules.ids) if rules.ids else F.lit(True)
    if rules.subtrees:
        out &= ~F.arrays_overlap("path", F.array(*map(F.lit, rules.subtrees)))
    for prefix in rules.id_prefixes:
        out &= ~F.startswith("section_id", F.lit(prefix))
    if rules.titles:
        out &= ~F.coalesce(F.col("title").isin(*rules.titles), F.lit(False))
    return out


def roots(nodes: DataFrame) -> DataFrame:
    """The nodes without a parent."""
    return nodes.filter("parent_id is null")


def ancestor_at_level(nodes: DataFrame, level: int) -> DataFrame:
    """(guideline_id, section_id, ancestor_id): the first member of the path that has the level, itself included; '' if there is none."""
    levels = nodes.filter(F.col("level") == level).select("guideline_id", F.col("section_id").alias("ancestor_id"))
    found = ancestor_pairs(nodes).join(levels, ["guideline_id", "ancestor_id"]).groupBy(*KEY).agg(F.min_by("ancestor_id", "depth").alias("ancestor_id"))
    return nodes.select(*KEY).join(found, list(KEY), "left").select(*KEY, F.coalesce("ancestor_id", F.lit("")).alias("ancestor_id"))


def _label() -> Column:
    """``N. Title``, or the title where there is no number."""
    return F.concat(F.coalesce(F.concat("number", F.lit(". ")), F.lit("")), "title")


def chapters_above(nodes: DataFrame) -> DataFrame:
    """(guideline_id, section_id, chapter_label, chapter_id): the first node of level 2 above a node, and the chapter it counts to (itself if it is one)."""
    two = nodes.filter("level = 2").select("guideline_id", F.col("section_id").alias("ancestor_id"), _label().alias("label"), (F.col("section_type") == "chapter").alias("is_chapter"))
    above = ancestor_pairs(nodes).filter("ancestor_id <> section_id").join(two, ["guideline_id", "ancestor_id"])
    first = above.groupBy(*KEY).agg(F.min_by("label", "depth").alias("chapter_label"), F.min_by("ancestor_id", F.when(F.col("is_chapter"), F.col("depth"))).alias("above_id"))
    joined = nodes.select(*KEY, "section_type").join(first, list(KEY), "left")
    return joined.select(*KEY, "chapter_label", F.when(F.col("section_type") == "chapter", F.col("section_id")).otherwise(F.col("above_id")).alias("chapter_id"))


def listed_sections(nodes: DataFrame, level: int = 3) -> DataFrame:
    """(guideline_id, section_number, section_id, title, summary, subsections): the eligible units of a level, and chapters with content that none of them covers.

    The title names the number and, below the chapters, the chapter; ``subsections`` are the titles of the eligible children.
    """
    able = nodes.filter(F.coalesce("rag_eligible", F.lit(False)))
    units = able.filter(F.col("level") == level)
    if level > 2:
        covered = units.join(chapters_above(nodes), list(KEY)).filter("chapter_id is not null").select("guideline_id", F.col("chapter_id").alias("section_id")).distinct()
        full = F.col("text_file").isNotNull() | (F.size("children") > 0)
        units = units.unionByName(able.filter((F.col("section_type") == "chapter") & full).join(covered, list(KEY), "left_anti"))
    kids = units.select(*KEY, F.posexplode("children").alias("place", "child")).join(able.select("guideline_id", F.col("section_id").alias("child"), F.col("title").alias("child_title")), ["guideline_id", "child"])
    kids = kids.groupBy(*KEY).agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "child_title"))), lambda x: x["child_title"]).alias("subsections"))
    out = numbered(units).join(chapters_above(nodes).select(*KEY, "chapter_label"), list(KEY), "left").join(kids, list(KEY), "left")
    below = F.when(F.col("level") > 2, F.coalesce(F.concat(F.lit(" < "), "chapter_label"), F.lit(""))).otherwise("")
    return out.select("guideline_id", "section_number", "section_id", F.concat(_label(), below).alias("title"), F.coalesce("summary", F.lit("")).alias("summary"), F.coalesce("subsections", F.array().cast("array<string>")).alias("subsections"))


def in_scope(sections: DataFrame, selected: DataFrame, requested: DataFrame | None = None) -> DataFrame:
    """Sections of the requested guidelines within the selection; no selection and no request both mean all."""
    wanted = selected if requested is None else requested
    if not selected.isEmpty():
        wanted = wanted.join(selected, "guideline_id", "left_semi")
    elif requested is None:
        return sections
    return sections.join(wanted.select("guideline_id").distinct(), "guideline_id", "left_semi")


def read_sections(requests: DataFrame, sections: DataFrame, texts: DataFrame) -> DataFrame:
    """``requests`` (…, guideline_id, asked) with section_number, section_id, title and text: by id, or by number if ``asked`` is digits.

    What cannot be resolved has nulls there. ``texts`` has (guideline_id, section_id, text).
    """
    by_number = F.rlike("asked", F.lit("^[0-9]+$"))
    known = sections.select("guideline_id", "section_number", "section_id", "title").join(texts, list(KEY), "left")
    keys = known.select("*", F.explode(F.array(F.concat(F.lit("#"), F.col("section_number").cast("string")), F.concat(F.lit("@"), "section_id"))).alias("key"))
    key = F.when(by_number, F.concat(F.lit("#"), F.coalesce(F.nullif(F.ltrim("asked", F.lit("0")), F.lit("")), F.lit("0")))).otherwise(F.concat(F.lit("@"), "asked"))
    return requests.withColumn("key", key).join(keys, ["guideline_id", "key"], "left").drop("key")


def listing_line(doc_id: Column, crumb: Column, summary: Column) -> Column:
    """``[id] crumb — summary``, one line of a list of candidates."""
    return F.concat(F.lit("["), doc_id, F.lit("] "), crumb, F.lit(" — "), F.coalesce(F.nullif(summary, F.lit("")), F.lit(NO_SUMMARY)))


def evidence(rows: DataFrame, key: str, texts: DataFrame, most: int = MOST_EVIDENCE) -> DataFrame:
    """(key, evidence, truncated): the texts of each row's ``read_set`` in its order, each under its ``[id]``, cut at ``most`` characters.

    ``texts`` has doc_id and text; sections that are not there or empty are left out, a row without any has ''.
    """
    each = rows.select(key, F.posexplode("read_set").alias("place", "doc_id")).join(texts.filter(F.length("text") > 0), "doc_id")
    part = F.concat(F.lit("["), "doc_id", F.lit("]\n"), "text")
    made = each.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", part.alias("part")))), lambda x: x["part"]), BETWEEN).alias("whole"))
    out = rows.select(key).join(made, key, "left").withColumn("whole", F.coalesce("whole", F.lit("")))
    return out.select(key, F.left("whole", F.lit(most)).alias("evidence"), (F.length("whole") > most).alias("truncated"))


def frozen(answers: DataFrame, key: str, sections: DataFrame) -> DataFrame:
    """(key, sections): the payloads (doc_id, title, text) of each ``read_set`` in its order; unknown ids are skipped, keys with none are dropped."""
    each = answers.select(key, F.posexplode("read_set").alias("place", "doc_id")).join(sections.select("doc_id", "title", "text"), "doc_id")
    packed = each.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("place", "doc_id", "title", "text"))).alias("s"))
    return packed.select(key, F.transform("s", lambda x: F.struct(x["doc_id"].alias("doc_id"), x["title"].alias("title"), x["text"].alias("text"))).alias("sections"))


def prompt(sections: Column) -> Column:
    """Frozen sections as one text."""
    return F.array_join(F.transform(sections, lambda s: F.concat(F.lit("["), s["doc_id"], F.lit("] "), s["title"], F.lit("\n"), F.coalesce(s["text"], F.lit("")))), BETWEEN)


def text_budgets(max_input_tokens: int, reserved: int = 14_000, chars_per_token: float = 3.5) -> dict[str, int]:
    """How much of a text fits a model: the whole, the head alone, and head and tail."""
    full = int(max(1_000, max_input_tokens - reserved) * chars_per_token)
    return {"full": full, "head_up_to": 2 * full, "head": int(full * 0.95), "long_head": full // 2, "long_tail": full // 4}


def capped_per_node(items: DataFrame, node: list[str], order: list[str], most: int) -> DataFrame:
    """At most ``most`` items of each node, the first ones."""
    return items.withColumn("place_", F.row_number().over(Window.partitionBy(*node).orderBy(*order))).filter(F.col("place_") <= most).drop("place_")


def limited(rows: DataFrame, order: list[str], most: int | None) -> DataFrame:
    """The first ``most`` rows in an order; None or 0 means all."""
    return rows.orderBy(*order).limit(most) if most else rows


def selected_valid(selected: Column, valid: Column) -> Column:
    """The valid ones of selected ids, each once, in the order selected."""
    return F.array_intersect(selected, valid)


def searched(selection: Column, candidates: Column) -> Column:
    """What a search gives: the valid ones selected; all candidates if the selection failed (null)."""
    return F.when(selection.isNull(), candidates).otherwise(selected_valid(selection, candidates))
