"""Queries that write JSON Lines to the shared folder and read them again: scans, sinks, run state."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, functions as F

from pacekeeper.plans.registry import query, table
from pacekeeper.sources import jsonl as J
from pacekeeper.sources.scratch import Scratch

_DOC = "doc_id long, lang string"


def _place(spark: SparkSession, name: str) -> str:
    return Scratch(spark, name).root


def _lines(spark, sf_dir) -> DataFrame:
    """A good line for each document, and the same line cut short."""
    docs = table(spark, sf_dir, "documents")
    good = F.to_json(F.struct("doc_id", "lang"))
    return docs.select("lang", F.explode(F.array(good, F.concat(F.lit('{"doc_id":'), F.col("doc_id").cast("string")))).alias("value"))


@query("""SELECT doc_id, lang, NULL::VARCHAR AS line FROM documents UNION ALL SELECT NULL, NULL, '{"doc_id":' || doc_id FROM documents""")
def scan_checked(spark, sf_dir):
    """Malformed lines are skipped and logged."""
    path = _place(spark, "scan")
    _lines(spark, sf_dir).select("value").write.text(path)
    good, bad = J.read_checked(spark, path, _DOC)
    none = F.lit(None)
    return good.select("doc_id", "lang", none.cast("string").alias("line")).unionByName(bad.select(none.cast("long").alias("doc_id"), none.cast("string").alias("lang"), "line"))


@query("SELECT doc_id, lang FROM documents")
def scan_dropping(spark, sf_dir):
    path = _place(spark, "scan")
    _lines(spark, sf_dir).select("value").write.text(path)
    return J.read(spark, path, _DOC).select("doc_id", "lang")


@query("SELECT doc_id, lang FROM documents")
def scan_strict(spark, sf_dir):
    """Well-formed lines in the mode that would fail at the first other."""
    path = _place(spark, "scan")
    J.write(table(spark, sf_dir, "documents").select("doc_id", "lang"), path)
    return J.read(spark, path, _DOC, "fail").select("doc_id", "lang")


@query("SELECT lang || '.jsonl' AS file, 2 * count(*) AS lines, count(*) AS good, count(*) AS bad FROM documents GROUP BY 1 UNION ALL SELECT 'empty.jsonl', 0, 0, 0")
def scan_directory(spark, sf_dir):
    """A file for each language and one without lines; every file is told on, whatever the others hold."""
    path, lines = _place(spark, "folder"), _lines(spark, sf_dir).cache()
    for r in lines.select("lang").distinct().collect():
        lines.filter(F.col("lang").eqNullSafe(F.lit(r["lang"]))).select("value").write.text(f"{path}/{r['lang']}.jsonl")
    lines.unpersist()
    J.write_text(spark, f"{path}/empty.jsonl", "")
    return J.read_directory(spark, path, _DOC)[1].withColumnRenamed("_file", "file")


@query("SELECT doc_id AS id, 0 AS file_no FROM documents UNION ALL SELECT item_id, 1 FROM benchmark")
def scan_union(spark, sf_dir):
    path = _place(spark, "union")
    J.write(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id")), f"{path}/a.jsonl")
    J.write(table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id")), f"{path}/b.jsonl")
    return J.read_union(spark, [f"{path}/a.jsonl", f"{path}/b.jsonl"], "id long").select("id", F.col("_file_no").alias("file_no"))


@query("SELECT doc_id, ['ab', 'abdiff', 'adiff'][doc_id % 3 + 1] AS form FROM documents")
def scan_splits(spark, sf_dir):
    """``all`` is the union of the three formats of a language's split."""
    path = _place(spark, "splits")
    docs = table(spark, sf_dir, "documents").select("doc_id", F.element_at(F.array(*map(F.lit, J.ALL_FORMATS)), (F.col("doc_id") % 3 + 1).cast("int")).alias("form"))
    for form, where in zip(J.ALL_FORMATS, J.split_paths(path, "en", "all", "train")):
        J.write(docs.filter(F.col("form") == form), where)
    return J.read_union(spark, J.split_paths(path, "en", "all", "train"), "doc_id long, form string").select("doc_id", "form")


@query("SELECT doc_id, n_chars FROM documents d ANTI JOIN labels USING (doc_id)")
def scan_resumed(spark, sf_dir):
    """Keys of an earlier output do not run again."""
    path = _place(spark, "done")
    J.write(table(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("doc_id")), path)
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), "n_chars")
    return J.resume(docs, J.completed(spark, path, ["doc_id"]), ["doc_id"]).select(F.col("doc_id").cast("long").alias("doc_id"), "n_chars")


@query("SELECT n_nationkey AS pair_id, n_name AS prediction FROM nation")
def scan_report(spark, sf_dir):
    """The results inside a whole-file JSON report."""
    path = _place(spark, "report")
    rows = table(spark, sf_dir, "nation").select(F.struct(F.col("n_nationkey").alias("pair_id"), F.col("n_name").alias("prediction")).alias("r"))
    report = rows.agg(F.to_json(F.struct(F.lit(1).alias("version"), F.collect_list("r").alias("pair_results"))).alias("value"))  # 25 nations
    report.coalesce(1).write.text(path)
    return J.read_report(spark, path, "pair_id long, prediction string")


@query("SELECT 'checkpoint-' || n_nationkey AS checkpoint, (n_nationkey * 7 % 5)::DOUBLE AS best_metric FROM nation ORDER BY best_metric, n_regionkey, 'checkpoint-' || n_nationkey LIMIT 1")
def scan_checkpoints(spark, sf_dir):
    """The least metric, then the first epoch, then the name."""
    path = _place(spark, "runs")
    for r in table(spark, sf_dir, "nation").collect():  # 25 nations
        J.write_text(spark, f"{path}/checkpoint-{r['n_nationkey']}/trainer_state.json", json.dumps({"best_metric": float(r["n_nationkey"] * 7 % 5), "epoch": float(r["n_regionkey"])}, indent=1))
    best = J.best_checkpoint(spark, path)
    return best.select(F.regexp_extract("checkpoint", r"([^/]+)$", 1).alias("checkpoint"), "best_metric")


@query("SELECT doc_id, 'en' AS language FROM documents")
def sink_dataset(spark, sf_dir):
    """Work columns go, the language comes in lower case."""
    path = _place(spark, "sink")
    J.write_dataset(table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("_lang"), F.lit(1).alias("_bin")), path, "EN")
    return spark.read.json(path)


@query("SELECT l_orderkey AS problem_id, count(*) AS n_results FROM lineitem GROUP BY 1 HAVING bool_or(l_linestatus = 'F') AND count(DISTINCT l_partkey) > 1")
def sink_problems(spark, sf_dir):
    """Two runs append the problems that have a success and a common test."""
    path = _place(spark, "sink")
    one = F.struct(F.when(F.col("l_linestatus") == "F", "success").otherwise("failed").alias("status"))
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("problem_id")).agg(F.collect_list(one).alias("results"), (F.count_distinct("l_partkey") - 1).alias("num_common_valid_tc"))
    for part in (0, 1):
        J.append_problems(rows.filter(F.pmod("problem_id", F.lit(2)) == part), path)
    return spark.read.schema("problem_id long, results array<struct<status:string>>").json(path).select("problem_id", F.size("results").cast("long").alias("n_results"))


@query("SELECT l_orderkey, l_linenumber, 'success' AS status FROM lineitem WHERE l_linestatus = 'F'")
def sink_successes(spark, sf_dir):
    path = _place(spark, "sink")
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("int").alias("l_linenumber"), F.when(F.col("l_linestatus") == "F", "success").otherwise("failed").alias("status"))
    J.append_successes(rows, path)
    return spark.read.schema(rows.schema).json(path)


@query("SELECT lang, count(*) AS n FROM documents GROUP BY 1")
def sink_report(spark, sf_dir):
    """Rows are appended in portions; the report is renewed after each and complete at the end."""
    path = _place(spark, "sink")
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    J.write_in_portions(docs, f"{path}/rows", "doc_id", 3, lambda d: d.groupBy("lang").agg(F.count("*").alias("n")), f"{path}/report")
    return spark.read.schema("lang string, n long").json(f"{path}/report")
