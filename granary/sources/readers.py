"""Scans. Paths go to Spark's readers only, so any store that Spark reads will do."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from granary.functions.markup import safe_names


def expand(spark: SparkSession, patterns: Iterable[str], env: dict[str, str] | None = None) -> list[str]:
    """Paths of the patterns with $NAME replaced, matched by the store's own globbing; each once, sorted. An unmatched pattern is an error."""
    out: set[str] = set()
    for p in patterns:
        p = re.sub(r"\$\{?(\w+)\}?", lambda m: (env or {}).get(m[1], m[0]), p)
        path = spark._jvm.org.apache.hadoop.fs.Path(p)
        found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path)
        if not found:
            raise FileNotFoundError(p)
        out |= {str(s.getPath()) for s in found}
    return sorted(out)


def corpus(spark: SparkSession, paths: list[str], schema: StructType | str | None = None) -> DataFrame:
    """Rows of Parquet and JSON-lines files together, with source_file and source_row (from 0 within a file).

    Columns that one kind lacks are null. Parquet has row numbers; JSON lines get theirs by their
    place among the file's lines, blank ones counted. A line that isn't JSON of the schema ends the
    job and names its file and line.
    """
    parquet, lines = [p for p in paths if not re.search(r"\.jsonl?(\.gz)?$", p)], [p for p in paths if re.search(r"\.jsonl?(\.gz)?$", p)]
    parts = []
    if parquet:
        reader = spark.read.schema(schema) if schema else spark.read
        parts.append(reader.parquet(*parquet).select("*", F.col("_metadata.file_name").alias("source_file"), F.col("_metadata.row_index").alias("source_row")))
    if lines:
        numbered = numbered_lines(spark, lines)
        shape = StructType.fromDDL(schema) if isinstance(schema, str) else schema or spark.read.json(lines).schema
        held = StructType([*shape.fields]).add("_corrupt_record", "string")
        parsed = numbered.where("trim(line) <> ''").select(F.from_json("line", held).alias("r"), "source_file", "source_row")
        bad = F.raise_error(F.concat(F.lit("no record: "), "source_file", F.lit(" line "), (F.col("source_row") + 1).cast("string")))
        parts.append(parsed.select(F.when(F.col("r._corrupt_record").isNotNull(), bad).otherwise(F.col("r")).alias("r"), "source_file", "source_row").select(*[F.col("r").getField(f.name).alias(f.name) for f in shape.fields], "source_file", "source_row"))
    if not parts:
        raise ValueError("no paths")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def numbered_lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(line, source_file, source_row): a file's lines numbered from 0, blank ones too.

    Large files are read in blocks by many tasks: blocks are counted first, and a line's number is the
    lines of its file's earlier blocks and its place in its own. Only a row for each block is broadcast.
    """
    lines = spark.read.text(paths).select(F.col("value").alias("line"), F.col("_metadata.file_path").alias("__f"), F.col("_metadata.file_name").alias("source_file"), F.col("_metadata.file_block_start").alias("__b"), F.monotonically_increasing_id().alias("__i"))
    blocks = lines.groupBy("__f", "__b").agg(F.count("*").alias("__n"), F.min("__i").alias("__first"))
    base = F.coalesce(F.sum("__n").over(W.partitionBy("__f").orderBy("__b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    placed = blocks.select("__f", "__b", "__first", base.alias("__base"))
    return lines.join(placed, ["__f", "__b"]).select("line", "source_file", (F.col("__base") + F.col("__i") - F.col("__first")).cast("long").alias("source_row"))


def json_lines(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Typed JSON lines; a bad line ends the job. Blank lines don't count."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def json_lines_with_faults(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """Typed JSON lines with the bad ones' text in _corrupt_record."""
    return spark.read.schema(StructType([*schema.fields]).add("_corrupt_record", "string")).option("mode", "PERMISSIVE").json(path)


def projected(spark: SparkSession, paths: list[str], id_col: str, field: str, expected_files: int | None = None, expected_rows: int | None = None, limit: int | None = None) -> DataFrame:
    """Id and one field with the row's pointer; only these two columns are read. Counts that aren't as expected are errors."""
    df = spark.read.parquet(*paths)
    if missing := {id_col, field} - set(df.columns):
        raise ValueError(f"columns are missing: {sorted(missing)}")
    if expected_files is not None and len(df.inputFiles()) != expected_files:
        raise ValueError(f"{len(df.inputFiles())} files, not {expected_files}")
    if expected_rows is not None and (n := df.count()) != expected_rows:
        raise ValueError(f"{n} rows, not {expected_rows}")
    out = df.select(F.col(id_col).alias("record_id"), F.col(field).alias("document_text"), F.col("_metadata.file_name").alias("shard"), F.col("_metadata.row_index").alias("row_index"))
    return out if limit is None else out.orderBy("shard", "row_index").limit(limit)


def allowlist(spark: SparkSession, paths: dict[str, str], expected: int | None = None) -> DataFrame:
    """(domain, record_id) of text files of ids by domain; malformed or repeated ids and wrong counts are errors."""
    out = None
    for domain, path in paths.items():
        part = spark.read.text(path).select(F.lit(domain).alias("domain"), F.trim("value").alias("record_id")).where("record_id <> ''")
        out = part if out is None else out.unionByName(part)
    bad = out.groupBy("domain").agg(F.count("*").alias("n"), F.countDistinct("record_id").alias("d"), F.count_if(~F.col("record_id").rlike("^[0-9a-f]{32}$")).alias("odd"))
    for r in bad.collect():
        if r["odd"] or r["n"] != r["d"] or (expected is not None and r["n"] != expected):
            raise ValueError(f"allowlist {r['domain']}: {r['n']} ids, {r['d']} different, {r['odd']} malformed")
    return out


#: Names that exclusion records use.
EXCLUSION_KEYS = {
    "id": ("id", "item_id", "record_id"),
    "svg": ("canonical_svg_sha256", "svg_sha256", "svg_hash"),
    "caption": ("caption_sha256", "caption_hash", "description_sha256", "detail_sha256", "text_sha256", "instruction_sha256"),
}
EXCLUSION_LISTS = {"id": ("ids",), "svg": ("svg_hashes",), "caption": ("caption_hashes",)}


def exclusions(records: DataFrame) -> DataFrame:
    """(kind, value) of exclusion records: every known key and list, each value once; hashes in lower case."""
    parts = []
    for kind, names in EXCLUSION_KEYS.items():
        parts += [records.select(F.lit(kind).alias("kind"), F.trim(F.col(n).cast("string")).alias("value")) for n in names if n in records.columns]
    for kind, names in EXCLUSION_LISTS.items():
        parts += [records.select(F.lit(kind).alias("kind"), F.explode(F.col(n).cast("array<string>")).alias("value")) for n in names if n in records.columns]
    if not parts:
        return records.sparkSession.createDataFrame([], "kind string, value string")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("kind", F.when(F.col("kind") == "id", F.col("value")).otherwise(F.lower("value")).alias("value")).where("value <> ''").distinct()


def neighbours(records: DataFrame, most: int = 3) -> DataFrame:
    """(key, retrieved) of neighbour records; over `most` ids, repeated ones, or a key with different lists are errors."""
    ids = F.coalesce(*[F.col(c) for c in ("retrieved_item_ids", "top3", "neighbors") if c in records.columns])
    record = F.coalesce(*[F.col(c).cast("string") for c in ("record_id", "id") if c in records.columns])
    domain = [F.col(c) for c in ("dataset_type", "domain") if c in records.columns]
    key = F.when(F.coalesce(*domain).isNotNull(), F.concat_ws(":", F.coalesce(*domain), record)).otherwise(record) if domain else record
    checked = F.when((F.size(ids) > most) | (F.size(F.array_distinct(ids)) < F.size(ids)), F.raise_error(F.lit("neighbours must be few and different"))).otherwise(ids)
    return records.select(key.alias("key"), checked.alias("ids")).groupBy("key").agg(F.when(F.countDistinct("ids") > 1, F.raise_error(F.lit("conflicting neighbours"))).otherwise(F.first("ids")).alias("retrieved"))


def artifacts(spark: SparkSession, folder: str, schema: StructType | str) -> DataFrame:
    """JSON sidecars of a folder, one document a file, with their file."""
    return spark.read.schema(schema).option("multiLine", True).option("pathGlobFilter", "*.json").json(folder).withColumn("source_file", F.input_file_name())


def digests(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """(path, bytes, sha256) of whole files."""
    return spark.read.format("binaryFile").load(paths).select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def checked_snapshot(spark: SparkSession, path: str, schema: StructType | str, count: int, sha256: str) -> DataFrame:
    """JSON lines of which count and digest are as the manifest says, else an error."""
    got = digests(spark, path).first()["sha256"]
    if got != sha256:
        raise ValueError(f"digest of {path} is {got}")
    df = json_lines(spark, path, schema)
    if (n := df.count()) != count:
        raise ValueError(f"{path} has {n} records, not {count}")
    return df


def task_records(df: DataFrame, task: str = "text_to_svg") -> DataFrame:
    return df.where(F.col("task") == task)


def by_position(df: DataFrame, position: str, wanted: list[int]) -> DataFrame:
    """Rows at the wanted positions, in that order, repeats included; a missing one is an error when the result is read."""
    asked = df.sparkSession.createDataFrame(list(enumerate(wanted)), "asked_order long, asked long")
    joined = asked.join(df, F.col("asked") == F.col(position), "left")
    return joined.withColumn(position, F.when(F.col(position).isNull(), F.raise_error(F.lit("a position is missing"))).otherwise(F.col(position))).orderBy("asked_order").drop("asked", "asked_order")


def trainer_log(spark: SparkSession, path: str) -> DataFrame:
    """Entries of a trainer state's log_history, one row each."""
    schema = "log_history array<struct<step: long, epoch: double, loss: double, eval_loss: double, test_loss: double, grad_norm: double, learning_rate: double>>"
    return spark.read.schema(schema).option("multiLine", True).json(path).select(F.explode("log_history").alias("e")).select("e.*")


def asserted(df: DataFrame, violations: DataFrame, message: str) -> DataFrame:
    """df, after a check that there are no violations."""
    if rows := violations.limit(5).collect():
        raise ValueError(f"{message}: {[r.asDict() for r in rows]}")
    return df


def unique_ids(df: DataFrame, name: str) -> DataFrame:
    """df, if no id is null or repeated."""
    bad = df.groupBy(name).count().where((F.col("count") > 1) | F.col(name).isNull())
    return asserted(df, bad, f"{name} is null or repeated")


def column_or_null(df: DataFrame, name: str, kind: str = "string") -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast(kind)


def safe_fragments(df: DataFrame, content: str, caption: str, most: int = 1_000_000) -> DataFrame:
    """Corpus rows with a caption and safe markup of bounded size, and their element names; fragments are judged inside a root."""
    sized = df.where((F.length(content) <= most) & (F.coalesce(F.trim(caption), F.lit("")) != ""))
    return sized.withColumn("element_names", safe_names(content)).where("element_names is not null")
