"""JSON sources and sinks, streaming, and the registered queries' names."""

import json

import pytest
from pyspark.sql import functions as F

from pacekeeper.sources import jsonl as L, schemas
from pacekeeper.streaming import incremental as I


def lines(path, *rows):
    path.write_text("\n".join(r if isinstance(r, str) else json.dumps(r, ensure_ascii=False) for r in rows) + "\n")
    return str(path)


def test_scans(spark, tmp_path):
    p = lines(tmp_path / "a.jsonl", {"pair_id": "é", "speedup": 2.0}, "{bad", "", {"pair_id": "b"})
    q = lines(tmp_path / "b.jsonl", {"pair_id": "c"})
    good, bad = L.read_checked(spark, [p, q], "pair_id string, speedup double")
    assert [(r.pair_id, r._file) for r in good.orderBy("_file", "_ord").collect()] == [("é", "a.jsonl"), ("b", "a.jsonl"), ("c", "b.jsonl")]
    assert [(r._file, r.line) for r in bad.collect()] == [("a.jsonl", "{bad")]
    assert L.read(spark, p, schemas.PAIR).filter("pair_id is not null").count() == 2
    with pytest.raises(Exception, match="(?i)malformed"):
        L.read(spark, p, schemas.PAIR, "fail").collect()
    assert [r._file_no for r in L.read_union(spark, [q, q], schemas.PAIR).collect()] == [0, 1]
    assert [r.pair_id for r in L.window_of_rows(good, 1, 1).collect()] == ["b"]


def test_sinks_and_resume(spark, tmp_path):
    df = spark.createDataFrame([("p", "s1", "success", 1), ("p", "s2", "failed", 2)], "problem_id string, solution_id string, status string, _work int")
    out = str(tmp_path / "out")
    keys = ["problem_id", "solution_id"]
    assert L.completed(spark, out, keys).count() == 0
    L.append_successes(df, out)
    L.append_successes(df, out)
    done = L.completed(spark, out, keys)
    assert done.count() == 1 and [r.solution_id for r in L.resume(df, done, keys).collect()] == ["s2"]
    L.write_dataset(df, str(tmp_path / "d"), "CPP")
    assert spark.read.json(str(tmp_path / "d")).select("language").distinct().collect()[0][0] == "cpp" and "_work" not in spark.read.json(str(tmp_path / "d")).columns
    L.write_report(df.groupBy("status").count(), str(tmp_path / "r"))
    assert spark.read.json(str(tmp_path / "r")).count() == 2
    problems = spark.createDataFrame([("a", 1, [("success",)]), ("b", 0, [("success",)]), ("c", 2, [("failed",)])], "problem_id string, num_common_valid_tc int, results array<struct<status:string>>")
    L.append_problems(problems, str(tmp_path / "p"))
    assert spark.read.json(str(tmp_path / "p")).count() == 1
    found = L.schema_report(df, ["problem_id", "code"])
    assert found[0]["preview"] == "p" and found[-1] == {"name": "code", "type": "missing", "preview": None, "required": True}


def test_state_and_checkpoints(spark, tmp_path):
    (tmp_path / "state.json").write_text(json.dumps({"config": {}, "pair_results": [{"pair_id": "a", "error": None}, {"pair_id": "b", "error": "x"}]}, indent=1))
    assert L.read_report(spark, str(tmp_path / "state.json"), "pair_id:string,error:string").count() == 2
    for n, state in ((1, {"best_metric": 0.5, "epoch": 1}), (2, {"best_metric": 0.4, "epoch": 2}), (3, {"epoch": 3})):
        (tmp_path / f"checkpoint-{n}").mkdir()
        (tmp_path / f"checkpoint-{n}" / "trainer_state.json").write_text(json.dumps(state, indent=1))
    assert L.best_checkpoint(spark, str(tmp_path)).first().checkpoint.endswith("checkpoint-2")
    assert L.split_paths("r", "cpp", "all", "train") == [f"r/cpp_{f}_train.jsonl" for f in ("ab", "abdiff", "adiff")] and L.split_paths("r", "cpp", "ab", "test") == ["r/cpp_ab_test.jsonl"]


def test_stream_takes_each_pair_once(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    lines(folder / "a.json", {"pair_id": "1", "correct": True}, {"pair_id": "1", "correct": False}, {"pair_id": "2", "correct": True})
    schema = "pair_id string, correct boolean"
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    I.append_to(I.once(I.watch(spark, str(folder), schema), ["pair_id"]), out, state).awaitTermination(60)
    lines(folder / "b.json", {"pair_id": "2", "correct": True}, {"pair_id": "3", "correct": False})
    I.append_to(I.once(I.watch(spark, str(folder), schema), ["pair_id"]), out, state).awaitTermination(60)
    assert sorted(r.pair_id for r in spark.read.parquet(out).collect()) == ["1", "2", "3"]
    q = I.running_accuracy(I.watch(spark, str(folder), "pair_id string, correct boolean, difficulty string")).writeStream.outputMode("complete").format("memory").queryName("acc").start()
    q.processAllAvailable()
    q.stop()
    assert spark.sql("select total, correct from acc").first() == (5, 3)


def test_every_oracle_has_its_query():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and "pair_difficulty" in e.queries()


def test_entry_runs(spark):
    import __spark_entry__ as e

    assert {r.difficulty for r in e.entry(spark).collect()} <= {"easy", "medium", "hard"}
