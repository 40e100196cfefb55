"""Readers and writers of the file formats around the engine."""

from __future__ import annotations

import json
import os
import subprocess
from collections.abc import Callable
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_jsonl(spark: SparkSession, paths: str | list[str], schema: str) -> DataFrame:
    """JSON lines, gzipped or not, blank lines left out; several paths are one table."""
    return spark.read.schema(schema).json(paths)


def read_datasets(spark: SparkSession, root: str, schema: str, left_out: str = "bench50") -> DataFrame:
    """All ``*/qa.jsonl`` below ``root`` but those of one folder, with the file they come from."""
    rows = spark.read.schema(schema).json(os.path.join(root, "*", "qa.jsonl")).withColumn("file", F.col("_metadata.file_path"))
    return rows.filter(~F.contains("file", F.lit(f"/{left_out}/")))


def read_tree(spark: SparkSession, path: str, node_schema: str, lines: bool = False) -> DataFrame:
    """Tree documents ``{guideline_id, nodes: {id: node}}``, one a file or one a line, as one row per node, in document order."""
    doc = spark.read.schema(f"guideline_id string, nodes map<string, struct<{node_schema}>>").option("multiLine", not lines).json(path)
    return doc.select("guideline_id", F.posexplode("nodes").alias("ord", "key", "node")).select("guideline_id", "ord", "node.*")


def write_tree(nodes: DataFrame, path: str) -> None:
    """Nodes as Parquet, a folder per guideline; an existing target is an error."""
    nodes.write.partitionBy("guideline_id").mode("errorifexists").parquet(path)


def read_section_texts(spark: SparkSession, path: str) -> DataFrame:
    """(section_id, text) of a folder of ``<section_id>.txt``."""
    rows = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), "value")
    return rows.select(F.regexp_replace("file", r"\.txt$", "").alias("section_id"), F.col("value").alias("text"))


def read_resource_meta(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One row per ``*.meta.json`` of a folder."""
    return spark.read.schema(schema).option("multiLine", True).option("pathGlobFilter", "*.meta.json").json(path)


def read_epubs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.epub").load(path).select("path", "content")


def read_chapters(spark: SparkSession, path: str) -> DataFrame:
    """(chapter, path, value) of saved pages named ``N. Title.html``."""
    pages = spark.read.text(path, wholetext=True, pathGlobFilter="*.html").select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_name").alias("file"), "value")
    numbered = pages.withColumn("chapter", F.regexp_extract(F.regexp_replace("file", "%20", " "), r"^(\d+)\.\s", 1))
    return numbered.filter("chapter <> ''").select(F.col("chapter").cast("int").alias("chapter"), "path", "value")


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    """(guideline_id, enabled, is_default) of a YAML registry; a registry without an enabled guideline is an error."""
    import yaml

    with open(path, encoding="utf-8") as f:
        entries = (yaml.safe_load(f) or {}).get("guidelines", {})
    rows = [(k, bool((v or {}).get("enabled", True)), bool((v or {}).get("default", False))) for k, v in entries.items()]
    if not any(enabled for _, enabled, _ in rows):
        raise ValueError("no guideline is enabled")
    return spark.createDataFrame(rows, "guideline_id string, enabled boolean, is_default boolean")


def _file(spark: SparkSession, path: str):
    """(file system, path) of a path of any kind that the cluster knows; a bare one is local."""
    full = path if "://" in path or path.startswith("file:") else "file://" + os.path.abspath(path)
    where = spark._jvm.org.apache.hadoop.fs.Path(full)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def exists(spark: SparkSession, path: str) -> bool:
    fs, where = _file(spark, path)
    return fs.exists(where)


def assert_absent(spark: SparkSession, path: str | None, overwrite: bool = False) -> None:
    """Fails before any work if the target exists, unless it may be overwritten; no path is no target."""
    if path is not None and not overwrite and exists(spark, path):
        raise FileExistsError(path)


def free_path(spark: SparkSession, path: str) -> str:
    """The first unused numbered sibling of a path, with its ending if it is a file's."""
    stem, end = os.path.splitext(path)
    n, free = 1, path
    while exists(spark, free):
        n += 1
        free = f"{stem}-{n}{end}"
    return free


def write_text(spark: SparkSession, text: str, path: str, overwrite: bool = False) -> None:
    """A small text as one file, as the cluster's file system writes it; an existing target is an error unless it may go."""
    assert_absent(spark, path, overwrite)
    fs, where = _file(spark, path)
    out = fs.create(where, True)
    try:
        out.write(bytearray(text.encode("utf-8")))
    finally:
        out.close()


def read_text(spark: SparkSession, path: str) -> str | None:
    """A small text file, null if there is none."""
    fs, where = _file(spark, path)
    if not fs.exists(where):
        return None
    stream = fs.open(where)
    try:
        return bytes(stream.readAllBytes()).decode("utf-8")
    finally:
        stream.close()


def write_report(spark: SparkSession, report: dict, path: str, overwrite: bool = False) -> None:
    """A report of some figures as indented JSON, keys in the order given."""
    write_text(spark, json.dumps(report, ensure_ascii=False, indent=2) + "\n", path, overwrite)


def save_resource_meta(resources: DataFrame, path: str) -> None:
    """Rows of resources as JSON, a folder per guideline; an existing target is an error."""
    resources.write.partitionBy("guideline_id").mode("errorifexists").json(path)


def list_available(registry: DataFrame, source_type: str) -> DataFrame:
    """The ids of the enabled guidelines of a source type."""
    return registry.filter(F.col("enabled") & (F.col("source_type") == source_type)).select("guideline_id")


class KeptTable:
    """Rows by key in a Parquet folder that grows: what is there is not made again.

    Each ``add`` appends the keys that are new; of a key that two writers added at once one row is read. An unreadable or
    missing folder is an empty table.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, key: str = "key"):
        self.spark, self.path, self.schema, self.key = spark, path, schema, key

    def read(self) -> DataFrame:
        empty = self.spark.createDataFrame([], self.schema)
        if not exists(self.spark, self.path):
            return empty
        return self.spark.read.schema(empty.schema).option("ignoreCorruptFiles", "true").parquet(self.path).dropDuplicates([self.key])

    def add(self, rows: DataFrame) -> None:
        fresh = rows.dropDuplicates([self.key]).join(self.read().select(self.key), self.key, "left_anti")
        fresh.select(*self.spark.createDataFrame([], self.schema).columns).write.mode("append").parquet(self.path)


def vector_cache(spark: SparkSession, path: str) -> KeptTable:
    """Vectors by the digest of model and text."""
    return KeptTable(spark, path, "key string, embedding array<float>")


def vector_key(model: Column, text: Column) -> Column:
    """The first 16 characters of a digest over model and text."""
    return F.left(F.sha2(F.concat_ws("\x01", model, text), 256), F.lit(16))


class Stages:
    """Which stages of a run are done: a JSON file of stage and time beside the results.

    ``run`` skips a stage that is done, unless it is forced; a forced one makes those after it undone.
    """

    def __init__(self, spark: SparkSession, path: str, order: tuple[str, ...]):
        self.spark, self.path, self.order = spark, path, order

    def done(self) -> dict[str, str]:
        try:
            return json.loads(read_text(self.spark, self.path) or "{}")
        except ValueError:
            return {}

    def run(self, stage: str, work: Callable[[], None], force: bool = False) -> bool:
        """Whether the work was done now."""
        done = self.done()
        if stage in done and not force:
            return False
        work()
        after = self.order[self.order.index(stage) :] if force else (stage,)
        done = {k: v for k, v in done.items() if k not in after}
        done[stage] = datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
        write_text(self.spark, json.dumps(done, indent=2), self.path, overwrite=True)
        return True


def clear_outputs(spark: SparkSession, folder: str, endings: tuple[str, ...]) -> int:
    """Deletes the files of a folder that a stage owns by their ending, and nothing else; gives their number."""
    fs, where = _file(spark, folder)
    if not fs.exists(where):
        return 0
    owned = [f.getPath() for f in fs.listStatus(where) if f.isFile() and f.getPath().getName().endswith(endings)]
    for path in owned:
        fs.delete(path, False)
    return len(owned)


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    """(file, n_bytes, digest) of the files below a folder, in any depth."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return rows.select(F.regexp_replace("path", "^.*/", "").alias("file"), F.col("length").alias("n_bytes"), F.sha2("content", 256).alias("digest"))


def write_jsonl(df: DataFrame, path: str) -> None:
    df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value")).write.mode("errorifexists").text(path)


def provenance(df: DataFrame, **facts: str) -> DataFrame:
    """``df`` with a column that says how it was made."""
    try:
        commit = subprocess.run(["git", "rev-parse", "--short", "HEAD"], capture_output=True, text=True, check=False).stdout.strip() or None
    except OSError:
        commit = None
    fields = [F.lit(v).alias(k) for k, v in sorted(facts.items())] + [F.lit(commit).alias("commit"), F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("made_at")]
    return df.withColumn("meta", F.struct(*fields))


def summary_table(rates: DataFrame, row: str, column: str, value: str) -> str:
    """A Markdown table of a small result, one line per ``row``; missing values are dashes."""
    cells = {(str(r[0]), str(r[1])): r[2] for r in rates.select(row, column, value).collect()}
    rows, columns = sorted({a for a, _ in cells}), sorted({b for _, b in cells}, key=lambda x: (len(x), x))
    show = lambda v: "–" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v)
    lines = [f"| {row} | " + " | ".join(columns) + " |", "|---" * (len(columns) + 1) + "|"]
    return "\n".join(lines + [f"| {a} | " + " | ".join(show(cells.get((a, b))) for b in columns) + " |" for a in rows])
