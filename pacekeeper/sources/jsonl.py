"""JSON Lines sources and sinks, run state, catalog of splits."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F, types as T

BAD = "_bad"


def read(spark: SparkSession, paths: str | Sequence[str], schema: T.StructType | str, mode: str = "drop") -> DataFrame:
    """Rows with ``_file`` and ``_ord`` (place in the scan). mode: drop or fail on malformed lines."""
    how = {"drop": "DROPMALFORMED", "fail": "FAILFAST"}[mode]
    df = spark.read.schema(schema).option("mode", how).json(list(paths) if not isinstance(paths, str) else paths)
    return df.withColumn("_file", F.col("_metadata.file_name")).withColumn("_ord", F.monotonically_increasing_id())


def read_checked(spark: SparkSession, paths: str | Sequence[str], schema: T.StructType | str) -> tuple[DataFrame, DataFrame]:
    """Good rows, and malformed lines as (_file, line): the log of what was skipped."""
    given = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)
    lines = spark.read.text(list(paths) if not isinstance(paths, str) else paths).select("value", F.col("_metadata.file_name").alias("_file")).withColumn("_ord", F.monotonically_increasing_id()).filter(F.trim("value") != "")
    wide = T.StructType([*given.fields, T.StructField(BAD, T.StringType())])
    parsed = lines.select("_file", "_ord", "value", F.from_json("value", wide, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": BAD}).alias("_r"))
    return parsed.filter(F.col(f"_r.{BAD}").isNull()).select(*[F.col(f"_r.`{f.name}`") for f in given.fields], "_file", "_ord"), parsed.filter(F.col(f"_r.{BAD}").isNotNull()).select("_file", F.col("value").alias("line"))


def read_union(spark: SparkSession, paths: Sequence[str], schema: T.StructType | str) -> DataFrame:
    """Files one after another: ``_file_no`` then ``_ord``."""
    frames = [read(spark, p, schema).withColumn("_file_no", F.lit(i)) for i, p in enumerate(paths)]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


#: Formats of training splits that ``all`` stands for.
ALL_FORMATS = ("ab", "abdiff", "adiff")


def split_paths(root: str, language: str, form: str, split: str) -> list[str]:
    return [f"{root}/{language}_{f}_{split}.jsonl" for f in (ALL_FORMATS if form == "all" else (form,))]


def window_of_rows(df: DataFrame, skip: int = 0, limit: int | None = None, order: str = "_ord") -> DataFrame:
    out = df.orderBy(order).offset(skip)
    return out.limit(limit) if limit is not None else out


def completed(spark: SparkSession, path: str, keys: Sequence[str]) -> DataFrame:
    """Distinct keys of an earlier output; none if there is no output yet."""
    schema = T.StructType([T.StructField(k, T.StringType()) for k in keys])
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).json(path).dropna(how="all").distinct()


def resume(df: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.join(done, list(keys), "left_anti")


def read_report(spark: SparkSession, path: str, result_schema: str) -> DataFrame:
    """Rows of the ``pair_results`` of a whole-file JSON report."""
    df = spark.read.schema(f"pair_results array<struct<{result_schema}>>").option("multiLine", True).json(path)
    return df.select(F.explode("pair_results").alias("r")).select("r.*")


def best_checkpoint(spark: SparkSession, root: str) -> DataFrame:
    """The checkpoint folder with the least metric, then the first epoch; without metrics the last epoch."""
    df = spark.read.schema("best_metric double, epoch double").option("multiLine", True).json(f"{root}/checkpoint-*/trainer_state.json")
    place = F.regexp_extract(F.col("_metadata.file_path"), r"(.*)/trainer_state\.json$", 1)
    rows = df.select(place.alias("checkpoint"), "best_metric", F.coalesce("epoch", F.lit(0.0)).alias("epoch"))
    has = F.max(F.col("best_metric").isNotNull()).over(W.partitionBy())  # one row for each checkpoint
    rows = rows.withColumn("_has", has)
    first = F.when(F.col("_has"), F.col("epoch")).otherwise(-F.col("epoch"))
    return rows.orderBy(F.coalesce("best_metric", F.lit(float("inf"))), first, "checkpoint").limit(1).drop("_has")


def write(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).json(path)


def write_dataset(df: DataFrame, path: str, language: str | None = None) -> None:
    """Without work columns (``_*``); the language, if given, in lower case."""
    out = df.select([c for c in df.columns if not c.startswith("_")])
    write(out.withColumn("language", F.lit(language.lower())) if language else out, path)


def append_problems(df: DataFrame, path: str) -> None:
    """Problems with a successful result and a common test."""
    write(df.filter(F.exists("results", lambda r: r["status"] == "success") & (F.col("num_common_valid_tc") > 0)), path, "append")


def append_successes(df: DataFrame, path: str) -> None:
    write(df.filter("status = 'success'"), path, "append")


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """One small file with that text."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(where, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def write_report(df: DataFrame, path: str) -> None:
    """The frame's rows as one JSON document each (for small aggregates)."""
    df.select(F.to_json(F.struct(*df.columns)).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def schema_report(df: DataFrame, required: Sequence[str], preview: int = 50) -> list[dict]:
    """Name, type and preview of each column's first value, and required columns that are missing."""
    first = df.first()
    rows = [{"name": f.name, "type": f.dataType.simpleString(), "preview": None if first is None else str(first[f.name])[:preview], "required": f.name in required} for f in df.schema.fields]
    return [*rows, *[{"name": r, "type": "missing", "preview": None, "required": True} for r in required if r not in df.columns]]


def read_directory(spark: SparkSession, folder: str, schema: T.StructType | str) -> tuple[DataFrame, DataFrame]:
    """Good rows of all ``*.jsonl`` files of a folder, and for every file, in the order of names, its lines, good and bad.

    One file's fault does not touch the others: malformed lines and files that can't be read to the end only show in the second frame.
    """
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder.rstrip('/')}/*.jsonl")
    found = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(where)
    paths = sorted(f.getPath().toString() for f in found or [])
    given = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)
    names = spark.createDataFrame([(i, p.rpartition("/")[2]) for i, p in enumerate(paths)], "_file_no int, _file string")
    if not paths:
        return spark.createDataFrame([], T.StructType([*given.fields, T.StructField("_file", T.StringType()), T.StructField("_ord", T.LongType())])), names.selectExpr("_file", "0L as lines", "0L as good", "0L as bad")
    lines = spark.read.option("ignoreCorruptFiles", True).option("ignoreMissingFiles", True).text(paths).select("value", F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+\.jsonl)(?:/[^/]*)?$", 1).alias("_file")).withColumn("_ord", F.monotonically_increasing_id())
    wide = T.StructType([*given.fields, T.StructField(BAD, T.StringType())])
    parsed = lines.filter(F.trim("value") != "").select("_file", "_ord", F.from_json("value", wide, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": BAD}).alias("_r"))
    good = F.col(f"_r.{BAD}").isNull()
    counts = parsed.groupBy("_file").agg(F.count("*").alias("lines"), F.count_if(good).alias("good"), F.count_if(~good).alias("bad"))
    told = names.join(counts, "_file", "left").fillna(0, ["lines", "good", "bad"]).orderBy("_file_no").select("_file", "lines", "good", "bad")
    return parsed.filter(good).select(*[F.col(f"_r.`{f.name}`") for f in given.fields], "_file", "_ord"), told


def write_in_portions(df: DataFrame, path: str, key: str, portions: int, report: Callable[[DataFrame], DataFrame], report_path: str) -> None:
    """Appends the rows portion by portion (by a hash of the key) and renews the report after each, and at the end whatever happens.

    After a failure the rows of the portions that were done are there, and ``completed`` and ``resume`` leave only the others.
    """
    spark, schema = df.sparkSession, df.schema

    def renew() -> None:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        if where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
            write_report(report(spark.read.schema(schema).json(path)), report_path)

    try:
        for i in range(portions):
            write(df.filter(F.pmod(F.xxhash64(F.col(key)), F.lit(portions)) == i), path, "append")
            if i + 1 < portions:
                renew()
    finally:
        renew()
