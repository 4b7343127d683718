"""Model calls, reports, refilled samples."""

from pyspark.sql import functions as F

from pacekeeper.functions.bins import SAMPLING_BINS
from pacekeeper.operators import dedup as D, prompts as Q, replenish as R, reports as P, sampling as S
from pacekeeper.sources import jsonl as J


def test_outcomes_of_a_call():
    waits = []

    def once(*answers):
        left = list(answers)

        def call(messages):
            x = left.pop(0)
            if isinstance(x, Exception):
                raise x
            return x

        waits.clear()
        return Q.call_once(call, [], 3, 3.0, waits.append)

    assert once(" hi ") == {"response": "hi", "status": "ok", "attempts": 1, "prompt_tokens": 0, "completion_tokens": 0} and waits == []
    got = once(None, ValueError("x" * 900), {"content": "Answer: A", "finish_reason": "length", "prompt_tokens": 5, "completion_tokens": 7})
    assert (got["response"], got["status"], got["attempts"], got["prompt_tokens"], got["completion_tokens"]) == ("Answer: A\n\n[RESPONSE TRUNCATED]", "truncated", 3, 5, 7) and waits == [3.0, 6.0]
    assert once({"content": "", "finish_reason": "content_filter"})["response"] == "Content filtered by API" and waits == []
    assert once("", "", {"content": None, "finish_reason": "stop"})["response"] == "Empty content (finish_reason: stop)" and waits == [3.0, 6.0]
    got = once(ValueError("a"), ValueError("b"), ValueError("c" * 900))
    assert got["status"] == "error" and got["response"] == "c" * 500
    assert Q.call_once(lambda m: "x", [], 0)["response"] == "Max retries exceeded"


def test_ask_many(spark):
    df = spark.createDataFrame([(f"p{i}", f"a{i}", "b", "py") for i in range(30)], "pair_id string, slow_code string, fast_code string, language string")
    tests = Q.swapped_tests(df)

    def connect():
        def call(messages):
            text = messages[-1]["content"]
            if "a7\n" in text:
                raise RuntimeError("down")
            return {"content": f"**Answer: {'B' if text.find('a') < text.find('b') else 'A'}**", "prompt_tokens": len(text)}

        return call

    rows = Q.ask(tests, connect, attempts=2, pause=0.0, threads=100).collect()
    assert len(rows) == 60 and {(r.pair_id, r.test_no) for r in rows} == {(f"p{i}", t) for i in range(30) for t in (1, 2)}
    assert {(r.status, r.attempts, r.response) for r in rows if r.pair_id == "p7"} == {("error", 2, "down")}
    assert all(r.status == "ok" and r.prompt_tokens > 0 for r in rows if r.pair_id != "p7")
    assert [m["role"] for m in spark.range(1).select(Q.trained_format_messages(F.lit("i"), F.lit("g")).alias("m")).first().m] == ["system", "user"]


def test_text_reports(spark):
    df = spark.createDataFrame([("x", 1, 0.5), ("longer", 20, None)], "name string, n long, rate double")
    assert P.table_text(df) == "name     n  rate\n----------------\nx        1  0.50\nlonger  20"
    marked = spark.createDataFrame([("p", "b", i, i == 0) for i in range(4)] + [("q", "b", 9, True)] + [("r", "b", i, i > 0) for i in range(3)], "problem string, bin string, i long, kept boolean")
    details = D.duplicate_details(marked, ["problem", "bin"])
    assert [tuple(r) for r in details.collect()] == [("p", "b", 4, 1), ("r", "b", 3, 2)]
    assert [tuple(r) for r in D.duplicate_details(marked, ["problem", "bin"], 1).collect()] == [("p", "b", 4, 1)]
    text = P.dataset_report(10, 7, 2, df, details)
    assert "final: 9 = 10 - 3 + 2" in text and "[groups with most duplicates]" in text and "p        b" in text


def test_bins_of_candidates(spark):
    rows = [(2.5, None, None, None), (None, "8", "2", None), (None, None, "2", None), (None, "8", "0", None), (None, "x", "2", None), (None, None, None, 3.0), (99.0, None, None, None), (1.2, None, None, None)]
    df = spark.createDataFrame(rows, "speedup double, src_agg_runtime string, tgt_agg_runtime string, _speedup double")
    got = [(r._speedup, r.bin) for r in R.with_bin(df, SAMPLING_BINS).collect()]
    assert got == [(2.5, "[2.0x, 4.0x)"), (4.0, "[4.0x, 8.0x)"), (0.0, None), (1.0, None), (1.0, None), (3.0, "[2.0x, 4.0x)"), (99.0, "[16.0x, inf)"), (1.2, None)]


def test_refilled_is_kept_and_fill(spark):
    df = spark.createDataFrame([(i, i % 3, f"p{i % 4}", f"c{i}") for i in range(40)], "k long, b int, p string, src string").withColumn("tgt", F.col("src"))
    out = R.refilled(df.filter("k < 5"), df.filter("k = 7"), df, 17, "b", "p", "k", "src", "tgt").collect()
    assert len(out) == len({r.k for r in out}) == 17 and {r.k for r in out if not r.refilled} == set(range(5)) and 7 not in {r.k for r in out}


def test_jitter_and_bins_of_two(spark):
    rows = spark.range(2000).select(S.jitter(F.col("id")).alias("j")).collect()
    assert all(-0.35 < r.j < 0.35 for r in rows) and abs(sum(r.j for r in rows)) < 40 and len({r.j for r in rows}) == 2000
    a, b = spark.createDataFrame([("x",), ("x",), (None,)], "label string"), spark.createDataFrame([("y",)], "label string")
    assert [tuple(r) for r in S.bins_of_two(a, b, "label").collect()] == [("unknown", 1, 0), ("x", 2, 0), ("y", 0, 1)]


def test_directory_of_files(spark, tmp_path):
    (tmp_path / "b.jsonl").write_text('{"i": 1}\n\n{"i": \n{"i": 2}\n')
    (tmp_path / "a.jsonl").write_text("")
    (tmp_path / "c.jsonl.gz").write_text("no")
    (tmp_path / "d.jsonl").write_text("x\n")
    rows, files = J.read_directory(spark, str(tmp_path), "i long")
    assert sorted(r.i for r in rows.collect()) == [1, 2]
    assert [tuple(r) for r in files.collect()] == [("a.jsonl", 0, 0, 0), ("b.jsonl", 3, 2, 1), ("d.jsonl", 1, 0, 1)]
    empty = tmp_path / "none"
    empty.mkdir()
    rows, files = J.read_directory(spark, str(empty), "i long")
    assert rows.count() == files.count() == 0


def test_report_is_written_even_after_a_failure(spark, tmp_path):
    df = spark.range(20).select("id", F.when(F.col("id") == 13, F.raise_error(F.lit("broken"))).otherwise(F.lit("x")).cast("string").alias("v"))
    path, report = str(tmp_path / "rows"), str(tmp_path / "report")
    try:
        J.write_in_portions(df, path, "id", 4, lambda d: d.agg(F.count("*").alias("n")), report)
        raise AssertionError("no failure")
    except Exception as error:  # noqa: BLE001
        assert "broken" in str(error)
    done = spark.read.schema("id long, v string").json(path).count() if (tmp_path / "rows").exists() else 0
    assert done < 20 and (not done or spark.read.json(report).first().n == done)
