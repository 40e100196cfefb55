"""Section trees: ancestors, subtrees, breadcrumbs, target units, numbering and text assembly.

A node row carries its path from the root and its place in document order, so no operator recurses: a subtree is a join
on the members of the paths. Rows that repeat a node are one node.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEY = ("guideline_id", "section_id")
#: What stands where a text was cut.
CUT_END, CUT_MIDDLE = "\n\n[... content truncated for summary generation ...]", "\n\n[... middle content truncated ...]\n\n"


def unique_nodes(nodes: DataFrame) -> DataFrame:
    """One row per (guideline_id, section_id): the first in document order."""
    rest = [c for c in nodes.columns if c not in KEY]
    return nodes.groupBy(*KEY).agg(F.min(F.struct("ord", *[c for c in rest if c != "ord"])).alias("x")).select(*KEY, "x.*")


def ancestor_pairs(nodes: DataFrame) -> DataFrame:
    """(guideline_id, section_id, ancestor_id, depth): every node with each member of its path, itself included."""
    return nodes.select("guideline_id", "section_id", F.posexplode("path").alias("depth", "ancestor_id")).withColumn("depth", F.col("depth").cast("bigint"))


def breadcrumbs(nodes: DataFrame, skip: tuple[str, ...] = ("root",)) -> DataFrame:
    """(guideline_id, section_id, breadcrumb): titles from the root down, without the types in ``skip``; members that don't exist are left out."""
    titles = nodes.select("guideline_id", F.col("section_id").alias("ancestor_id"), "title", "section_type")
    joined = ancestor_pairs(nodes).join(titles, ["guideline_id", "ancestor_id"]).filter(~F.col("section_type").isin(*skip))
    made = joined.groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct("depth", "title"))).alias("t"))
    return nodes.select(*KEY).join(made, list(KEY), "left").select(*KEY, F.coalesce(F.array_join(F.col("t.title"), " > "), F.lit("")).alias("breadcrumb"))


def subtree_totals(nodes: DataFrame) -> DataFrame:
    """(guideline_id, section_id, n_nodes, n_chars, deepest) over each node and all below it."""
    sizes = nodes.select("guideline_id", "section_id", "content_length", "level")
    below = ancestor_pairs(nodes).join(sizes, list(KEY))
    return below.groupBy("guideline_id", F.col("ancestor_id").alias("section_id")).agg(F.count(F.lit(1)).alias("n_nodes"), F.sum(F.coalesce("content_length", F.lit(0)).cast("bigint")).alias("n_chars"), F.max("level").cast("bigint").alias("deepest"))


def chapter_of(nodes: DataFrame) -> DataFrame:
    """(guideline_id, section_id, chapter_id): the first chapter on the path, '' if there is none."""
    types = nodes.select("guideline_id", F.col("section_id").alias("ancestor_id"), "section_type")
    found = ancestor_pairs(nodes).join(types.filter("section_type = 'chapter'"), ["guideline_id", "ancestor_id"]).groupBy(*KEY).agg(F.min_by("ancestor_id", "depth").alias("chapter_id"))
    return nodes.select(*KEY).join(found, list(KEY), "left").select(*KEY, F.coalesce("chapter_id", F.lit("")).alias("chapter_id"))


def eligible_chapters(nodes: DataFrame, wanted: tuple[str, ...] = (), skipped: tuple[str, ...] = ()) -> DataFrame:
    """Eligible chapters of level 2: those of ``wanted`` ids if there are any, else those whose title has no part of ``skipped``."""
    chapters = nodes.filter((F.col("level") == 2) & (F.col("section_type") == "chapter") & F.coalesce("rag_eligible", F.lit(False)))
    if wanted:
        return chapters.filter(F.col("section_id").isin(*wanted))
    for part in skipped:
        chapters = chapters.filter(~F.contains(F.lower("title"), F.lit(part.lower())))
    return chapters


def target_units(nodes: DataFrame, level: int = 3, left_out: tuple[str, ...] = ("abstract",), wanted: tuple[str, ...] = (), skipped: tuple[str, ...] = ()) -> DataFrame:
    """(guideline_id, section_id, ord, kind): the eligible units of ``level`` in the chapters chosen, and chapters that have none."""
    chapters = eligible_chapters(nodes, wanted, skipped)
    units = nodes.filter((F.col("level") == level) & ~F.col("section_type").isin(*left_out) & F.coalesce("rag_eligible", F.lit(False)))
    held = units.select(*KEY, "ord", F.explode("path").alias("chapter")).join(chapters.select("guideline_id", F.col("section_id").alias("chapter")), ["guideline_id", "chapter"])
    bare = chapters.join(held.select("guideline_id", F.col("chapter").alias("section_id")), list(KEY), "left_anti")
    return held.select(*KEY, "ord", F.lit("unit").alias("kind")).distinct().unionByName(bare.select(*KEY, "ord", F.lit("chapter").alias("kind")))


def numbered(units: DataFrame) -> DataFrame:
    """``units`` with their 1-based place in document order as section_number."""
    return units.withColumn("section_number", F.row_number().over(Window.partitionBy("guideline_id").orderBy("ord", "section_id")).cast("bigint"))


def heading(level: Column, number: Column, title: Column) -> Column:
    """``#`` up to six times, the number with a point if there is one, and the title."""
    return F.concat_ws(" ", F.repeat(F.lit("#"), F.least(level, F.lit(6))), F.concat(number, F.lit(".")), title)


def assemble(nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """(guideline_id, section_id, text) of every node: heading and text of it and all below it, in document order.

    ``texts`` has (guideline_id, section_id, text); nodes without a text give their heading only.
    """
    parts = nodes.join(texts, list(KEY), "left").select(*KEY, "ord", F.concat_ws("\n", heading(F.col("level"), F.col("number"), F.col("title")), F.btrim("text"), F.lit("")).alias("part"))
    placed = ancestor_pairs(nodes).select("guideline_id", "section_id", "ancestor_id").join(parts, list(KEY))
    made = placed.groupBy("guideline_id", F.col("ancestor_id").alias("section_id")).agg(F.array_sort(F.collect_list(F.struct("ord", "part"))).alias("p"))
    return made.select(*KEY, F.array_join(F.col("p.part"), "\n").alias("text"))


def strided(items: DataFrame, group: str, order: list[str], size: int) -> DataFrame:
    """Evenly spaced rows of each group: the places round(i * (n - 1) / (size - 1)), halves to even; all rows if there are no more."""
    w = Window.partitionBy(group)
    placed = items.withColumn("place", F.row_number().over(w.orderBy(*order)) - 1).withColumn("n", F.count(F.lit(1)).over(w))
    spots = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.bround(i * (F.col("n") - 1) / F.lit(max(1, size - 1)), 0).cast("int"))
    return placed.filter((F.col("n") <= size) | F.array_contains(spots, F.col("place"))).drop("n")


def resource_owners(nodes: DataFrame) -> DataFrame:
    """(guideline_id, resource_id, kind, primary_section, sections): who refers to each figure and table, first owner first."""
    each = [nodes.select("guideline_id", "ord", "section_id", F.explode(c).alias("resource_id"), F.lit(kind).alias("kind")) for c, kind in (("figures", "figure"), ("tables", "table"))]
    both = each[0].unionByName(each[1])
    return both.groupBy("guideline_id", "resource_id", "kind").agg(F.min_by("section_id", F.struct("ord", "section_id")).alias("primary_section"), F.array_join(F.transform(F.array_sort(F.collect_set(F.struct("ord", "section_id"))), lambda x: x["section_id"]), ",").alias("sections"))


def section_kind(section_id: Column, path: Column, has_children: Column, has_text: Column) -> Column:
    """Type of a section, by ordered rules over its id and its place."""
    return (
        F.when((F.size(path) == 0) | section_id.isin("frontmatter", "bodymatter", "backmatter"), "root")
        .when(F.startswith(section_id, F.lit("bibliography")), "bibliography")
        .when(F.startswith(section_id, F.lit("appendix")), "appendix")
        .when(section_id.isin("affiliations", "article-information"), "metadata")
        .when(F.startswith(section_id, F.lit("abs")), "abstract")
        .when(F.size(path) <= 2, "chapter")
        .when(has_children & ~has_text, "container")
        .otherwise("subsection")
    )


def nearest_parent(ids: DataFrame) -> DataFrame:
    """(guideline_id, section_id, parent_id) of legacy ids (an s and runs of digits and letters): the longest prefix of runs that exists."""
    runs = F.regexp_extract_all(F.expr("substring(section_id, 2)"), F.lit("[0-9]+|[^0-9]+"), F.lit(0))
    cut = ids.select("guideline_id", "section_id", runs.alias("runs")).filter(F.startswith("section_id", F.lit("s")) & (F.size("runs") > 1))
    prefixes = cut.select("guideline_id", "section_id", "runs", F.explode(F.sequence(F.lit(1), F.size("runs") - 1)).alias("n"))
    prefixes = prefixes.select("guideline_id", "section_id", "n", F.concat(F.lit("s"), F.array_join(F.slice("runs", F.lit(1), F.col("n")), "")).alias("parent_id"))
    found = prefixes.join(ids.select("guideline_id", F.col("section_id").alias("parent_id")), ["guideline_id", "parent_id"], "left_semi")
    best = found.groupBy("guideline_id", "section_id").agg(F.max_by("parent_id", "n").alias("parent_id"))
    return ids.select("guideline_id", "section_id").join(best, list(KEY), "left")


def shortened(text: Column, full: int) -> Column:
    """The whole text within ``full`` characters, its head within twice that, else head and tail."""
    return (
        F.when(F.length(text) <= full, text)
        .when(F.length(text) <= 2 * full, F.concat(F.left(text, F.lit(int(full * 0.95))), F.lit(CUT_END)))
        .otherwise(F.concat(F.left(text, F.lit(full // 2)), F.lit(CUT_MIDDLE), F.right(text, F.lit(full // 4))))
    )


def capped_summary(text: Column, most: int = 500, least: int = 400) -> Column:
    """A summary without wrapping quotes; over ``most`` characters it is cut at the last space after ``least``, if there is one."""
    clean = F.btrim(F.btrim(text), F.lit("\"' "))
    head = F.left(clean, F.lit(most - 3))
    word = F.regexp_extract(head, r"(?s)^(.*) [^ ]*$", 1)
    return F.when(F.length(clean) <= most, clean).when(F.length(word) > least, F.concat(word, F.lit("…"))).otherwise(F.concat(head, F.lit("…")))


def heading_number(heading_text: Column) -> Column:
    """(number, title) of a heading; a bare number of three digits or more is part of the title."""
    number = F.regexp_extract(heading_text, r"^(\d+(?:\.\d+)*)\.?\s+(.*)$", 1)
    rest = F.regexp_extract(heading_text, r"^(\d+(?:\.\d+)*)\.?\s+(.*)$", 2)
    usable = (F.length(number) > 0) & ~(F.rlike(number, F.lit(r"^\d{3,}$")))
    return F.struct(F.when(usable, number).alias("number"), F.when(usable, rest).otherwise(heading_text).alias("title"))


def placeholders(texts: DataFrame, resources: DataFrame) -> DataFrame:
    """``texts`` (text_id, text) with ``[[figure:id]]`` and ``[[table:id]]`` replaced by label and caption; unknown ids stay."""
    pattern = r"\[\[(figure|table):([^\]]+)\]\]"
    split = texts.select("text_id", F.split("text", pattern, -1).alias("chunks"), F.regexp_extract_all("text", F.lit(pattern), F.lit(0)).alias("marks"), F.regexp_extract_all("text", F.lit(pattern), F.lit(2)).alias("ids"))
    each = split.select("text_id", F.posexplode("chunks").alias("i", "chunk"), F.col("marks"), F.col("ids"))
    each = each.select("text_id", "i", "chunk", F.get("marks", F.col("i")).alias("mark"), F.get("ids", F.col("i")).alias("resource_id"))
    shown = F.when(F.col("label").isNotNull(), F.concat_ws("\n", F.concat_ws(" ", "label", "caption"), F.coalesce("markdown", "description"))).otherwise(F.coalesce("mark", F.lit("")))
    known = resources.select("resource_id", F.concat(F.lit("["), F.upper("kind"), F.lit(" "), F.col("resource_id"), F.lit("]")).alias("label"), "caption", "markdown", "description")
    made = each.join(known, "resource_id", "left").select("text_id", "i", F.concat("chunk", shown).alias("piece")).groupBy("text_id").agg(F.array_sort(F.collect_list(F.struct("i", "piece"))).alias("p"))
    return made.select("text_id", F.array_join(F.col("p.piece"), "").alias("text"))
