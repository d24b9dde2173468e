"""Line-delimited JSON, Parquet and configuration files: scans with provenance, sinks, resume."""

from __future__ import annotations

import dataclasses

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tessera.functions.features import Rules
from tessera.operators.selection import numbered
from tessera.sources.tables import on_disk, shared_folder


def read_jsonl(spark: SparkSession, path: str, schema: str, strict: bool = False, limit: int | None = None) -> DataFrame:
    """Rows of line-delimited JSON with a declared schema; bad lines are skipped, or fail the scan if ``strict``.

    ``limit`` takes the first rows in the order of files and lines.
    """
    place = [F.col("_metadata.file_path").alias("_path"), F.col("_metadata.file_block_start").alias("_start"), F.monotonically_increasing_id().alias("_mono")]
    if strict:
        df = spark.read.schema(schema).option("mode", "FAILFAST").json(path)
        df = df if limit is None else df.select("*", *place)
    else:
        full = StructType.fromDDL(schema).add("_corrupt_record", "string")
        lines = spark.read.text(path).select("value", *(place if limit is not None else ())).where(r"value rlike '\\S'")
        parsed = F.from_json("value", full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
        df = lines.withColumn("r", parsed).where("r._corrupt_record is null").select("r.*", *(["_path", "_start", "_mono"] if limit is not None else ())).drop("_corrupt_record")
    return df if limit is None else df.orderBy("_path", "_start", "_mono").limit(limit).drop("_path", "_start", "_mono")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(source_file, source_idx, value): lines of text files with their physical numbers, blank lines counted.

    Files are split as usual; the line counts of the splits, one number each, shift the numbers within a split.
    """
    df = spark.read.text(path).select(F.col("_metadata.file_path").alias("_path"), F.col("_metadata.file_name").alias("source_file"), F.col("_metadata.file_block_start").alias("_start"), F.monotonically_increasing_id().alias("_mono"), "value")
    splits = df.groupBy("_path", "_start").agg(F.min("_mono").alias("_first"), F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("_path").orderBy("_start").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shift = splits.select("_path", "_start", (before - F.col("_first")).alias("_shift"))
    return df.join(shift, ["_path", "_start"]).select("source_file", (F.col("_mono") + F.col("_shift")).alias("source_idx"), "value")


def read_parquet_rows(spark: SparkSession, path: str) -> DataFrame:
    """Parquet rows with id ``{file stem}_{row}``."""
    return spark.read.parquet(path).select("*", F.concat_ws("_", F.regexp_replace(F.col("_metadata.file_name"), r"\.parquet$", ""), F.col("_metadata.row_index")).alias("id"))


def read_first(spark: SparkSession, jsonl: str, parquet: str, schema: str) -> DataFrame:
    """The JSON lines if they exist, else the Parquet table."""
    files, place = on_disk(spark, jsonl)
    return read_jsonl(spark, jsonl, schema, strict=True) if files.exists(place) else spark.read.parquet(parquet)


def read_document(spark: SparkSession, path: str) -> DataFrame:
    """One JSON document that spans lines."""
    return spark.read.option("multiLine", True).json(path)


def corpus_filter(df: DataFrame, least_score: int | None = None, least_tokens: int = 50, most_tokens: int = 8192) -> DataFrame:
    """Rows with enough tokens, text and, if asked, score; missing numbers count as 0."""
    keep = F.coalesce("token_count", F.lit(0)).between(least_tokens, most_tokens) & F.coalesce(F.col("text").rlike(r"(?U)\S"), F.lit(False))
    return df.where(keep if least_score is None else keep & (F.coalesce("int_score", F.lit(0)) >= least_score))


def read_config(spark: SparkSession, path: str) -> dict[str, str]:
    """``key: value`` lines of a YAML file's outermost level; comments, quotes and nested levels are left out."""
    files, place = on_disk(spark, path)
    lines = spark.read.text(path).collect() if files.exists(place) else []  # a configuration, a few lines
    out = {}
    for (line,) in lines:
        name, colon, value = line.partition(" #")[0].partition(":")
        if colon and name == name.strip() and name[:1] not in ("", "#", "-") and value.strip():
            out[name.strip("\"'")] = value.strip().strip("\"'")
    return out


def load_rules(path: str | None = None, spark: SparkSession | None = None) -> Rules:
    """Thresholds of a YAML file; unknown keys are ignored, missing ones and those of a missing file keep their values."""
    if path is None:
        return Rules()
    told = read_config(spark or SparkSession.active(), path)
    kinds = {f.name: int if f.type == "int" else float for f in dataclasses.fields(Rules)}
    return Rules(**{k: kinds[k](v.replace("_", "")) for k, v in told.items() if k in kinds})


def write_jsonl(df: DataFrame, path: str, append: bool = False) -> None:
    df.write.mode("append" if append else "overwrite").json(path)


def write_array(df: DataFrame, path: str) -> None:
    """One JSON array in one file, of any number of rows.

    Executors write the rows, each behind a comma; the parts' bytes are then put one after the other behind the
    opening bracket, without the first comma, so no row passes through Python.
    """
    spark = df.sparkSession
    jvm, folder = spark._jvm, shared_folder(spark, "array") + "/parts"
    df.select(F.concat(F.lit(","), F.to_json(F.struct("*"), {"ignoreNullFields": "false"})).alias("value")).write.text(folder)
    source, place = on_disk(spark, folder)
    target, file = on_disk(spark, path)
    parts = sorted((f.getPath() for f in source.listStatus(place) if f.getPath().getName().startswith("part-") and f.getLen()), key=lambda p: p.getName())
    out = target.create(file, True)
    try:
        out.write(ord("["))
        out.write(ord("\n"))
        for i, part in enumerate(parts):
            rows = source.open(part)
            if i == 0:
                rows.read()
            jvm.org.apache.hadoop.io.IOUtils.copyBytes(rows, out, 1 << 16, False)
            rows.close()
        out.write(ord("]"))
    finally:
        out.close()


def write_shards(df: DataFrame, path: str, n: int, order: str = "row_idx") -> None:
    """Contiguous shards of an ordered table, one folder each."""
    from tessera.operators.selection import shards

    shards(df, n, order).write.mode("overwrite").partitionBy("shard").parquet(path)


def read_shards(spark: SparkSession, path: str, n: int, order: str = "row_idx") -> DataFrame:
    """All shards in order; a missing one is an error."""
    files, _ = on_disk(spark, path)
    missing = [i for i in range(n) if not files.exists(on_disk(spark, f"{path}/shard={i}")[1])]
    if missing:
        raise FileNotFoundError(f"missing shards {missing} of {path}")
    return spark.read.parquet(path).orderBy("shard", order)


def rewrite(spark: SparkSession, path: str, change) -> None:  # noqa: ANN001
    """A Parquet table replaced by ``change(table)``: written beside it, then swapped by two renames.

    If a run ends between the renames, the next one finds no table and first puts the old one back.
    """
    files, now = on_disk(spark, path)
    new, old = (on_disk(spark, f"{path}.{x}")[1] for x in ("new", "old"))
    if not files.exists(now) and files.exists(old):
        files.rename(old, now)
    change(spark.read.parquet(path)).write.mode("overwrite").parquet(f"{path}.new")
    files.delete(old, True)
    if not (files.rename(now, old) and files.rename(new, now)):
        raise OSError(f"{path} could not be swapped")
    files.delete(old, True)


def with_row_idx(df: DataFrame, order: str) -> DataFrame:
    return numbered(df, order).withColumnRenamed("_n", "row_idx")
