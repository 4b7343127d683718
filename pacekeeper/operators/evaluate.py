"""Position-swap evaluation of comparison models: routing, categories, accuracy, cost."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from pacekeeper.functions import parse as P
from pacekeeper.functions.bins import evaluation_bin

#: USD for a million input and output tokens; the first key that a model's name contains decides.
PRICES = [
    ("deepseek-v3", 0.27, 1.10), ("deepseek-v3.2", 0.27, 1.10), ("deepseek-chat", 0.14, 0.28), ("deepseek-coder", 0.14, 0.28),
    ("gpt-4o", 2.50, 10.00), ("gpt-4o-mini", 0.150, 0.600), ("gpt-4-turbo", 10.00, 30.00), ("gpt-3.5-turbo", 0.50, 1.50), ("gpt-5-mini", 0.40, 1.60), ("gpt-5.2", 5.00, 15.00),
    ("claude-3-opus", 15.00, 75.00), ("claude-3-sonnet", 3.00, 15.00), ("claude-3-haiku", 0.25, 1.25), ("claude-sonnet-4", 3.00, 15.00), ("claude-sonnet-4-5", 3.00, 15.00),
    ("qwen-turbo", 0.30, 0.60), ("qwen-plus", 0.80, 2.00), ("qwen-max", 2.00, 6.00), ("qwen3-235b", 2.00, 6.00), ("qwen3-30b", 0.50, 1.50), ("qwen3-coder-480b", 2.50, 7.50), ("qwen3-coder-30b", 0.50, 1.50),
]
DEFAULT_PRICE = (5.0, 15.0)


def prices(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, *p) for i, p in enumerate(PRICES)], "ordinal int, name string, input_usd double, output_usd double")


def priced(models: DataFrame, model: str = "model", longest: bool = False) -> DataFrame:
    """``models`` with input_usd and output_usd. ``longest`` takes the longest key instead of the first."""
    table = prices(models.sparkSession)
    names = models.select(model).distinct()
    hit = names.join(F.broadcast(table), F.lower(F.col(model)).contains(F.col("name")))  # a table of fixed size
    order = -F.length("name") if longest else F.col("ordinal")
    best = hit.groupBy(model).agg(F.min_by("input_usd", order).alias("input_usd"), F.min_by("output_usd", order).alias("output_usd"))
    return models.join(best, model, "left").fillna({"input_usd": DEFAULT_PRICE[0], "output_usd": DEFAULT_PRICE[1]})


def cost(prompt_tokens: Column, completion_tokens: Column) -> Column:
    return prompt_tokens / 1_000_000 * F.col("input_usd") + completion_tokens / 1_000_000 * F.col("output_usd")


def dataset_type(has: dict[str, Column]) -> Column:
    """Kind of an item from the fields it has; ``has`` maps the fields of the table to columns."""
    there = lambda *names: [has[n].isNotNull() if n in has else F.lit(False) for n in names]
    both = lambda a, b: (lambda x: x[0] & x[1])(there(a, b))
    either = lambda a, b: (lambda x: x[0] | x[1])(there(a, b))
    tier = has["tier"].isin("fast", "medium", "slow") if "tier" in has else F.lit(False)
    return (
        F.when(F.coalesce(has["scheme"] if "scheme" in has else F.lit(""), F.lit("")) != "", has.get("scheme", F.lit("")))
        .when(either("medium_code", "medium_time"), "triple")
        .when(both("raw_code", "clean_code"), "clean_vs_raw")
        .when(F.coalesce(tier, F.lit(False)), "same_tier")
        .when(there("pair_type")[0] | both("slow_code", "fast_code"), "cross_tier")
        .when(both("src_code", "tgt_code"), "effibench_pair")
        .otherwise("unknown")
    )


def expected_kind(given: Column, kind: Column) -> Column:
    """similar or fast."""
    g = F.coalesce(given, F.lit(""))
    return F.when(g != "", F.when(F.lower(g) == "similar", "similar").otherwise("fast")).when(kind.isin("same_tier", "clean_vs_raw"), "similar").otherwise("fast")


def sides(kind: Column, has: dict[str, Column]) -> dict[str, Column]:
    """slow_code, fast_code, slow_time, fast_time by kind of item."""
    get = lambda *names: F.coalesce(*[has[n] for n in names if n in has], F.lit(None))
    fields = {
        "clean_vs_raw": (("raw_code",), ("clean_code",), ("cpu_time",), ("cpu_time",)),
        "same_tier": (("code_b",), ("code_a",), ("time_b",), ("time_a",)),
        "effibench_pair": (("src_code",), ("tgt_code",), ("src_agg_runtime",), ("tgt_agg_runtime",)),
    }
    other = (("slow_code", "code_b"), ("fast_code", "code_a"), ("slow_time", "time_b"), ("fast_time", "time_a"))
    out = {}
    for i, name in enumerate(("slow_code", "fast_code", "slow_time", "fast_time")):
        c = get(*other[i])
        for k, names in fields.items():
            c = F.when(kind == k, get(*names[i])).otherwise(c)
        out[name] = F.coalesce(c.try_cast("double"), F.lit(0.0)) if "time" in name else c
    return out


def judge_pairs(items: DataFrame, responses: DataFrame, gold: Column | None = None) -> DataFrame:
    """One row for each item with both predictions, correctness, category, consistency and error.

    ``responses`` has (pair_id, test_no 1 or 2, response, prompt_tokens, completion_tokens). In test 1 the
    slow program is A, in test 2 B. Test 2 counts only if test 1 could be parsed, as it would not be asked else.
    """
    r = responses.withColumn("_p", P.answer("response"))
    at = lambda c, n: F.max(F.when(F.col("test_no") == n, F.col(c)))
    wide = r.groupBy("pair_id").agg(*[at(c, n).alias(f"{c}{n}") for n in (1, 2) for c in ("_p", "response", "prompt_tokens", "completion_tokens")])
    rows = items.join(wide, "pair_id", "left")
    asked = [F.col("_p1").isNotNull(), F.col("_p1").isin("A", "B")]
    similar = gold == "similar" if gold is not None else F.lit(False)
    want = [F.when(similar, "SIMILAR").otherwise(x) for x in ("B", "A")]
    p1, p2 = F.coalesce("_p1", F.lit("UNKNOWN")), F.when(asked[1], F.coalesce("_p2", F.lit("UNKNOWN")))
    fault = lambda n, p, body: F.when(p == "PARSE_FAILED", f"test{n}_answer_parse_failed").when(~p.isin("A", "B"), F.concat(F.lit(f"test{n}_error: "), F.substring(F.coalesce(body, F.lit("")), 1, 100)))
    error = F.coalesce(fault(1, p1, F.col("response1")), fault(2, p2, F.col("response2")))
    right = [F.when(p.isin("A", "B"), p == w) for p, w in zip((p1, p2), want)]
    ok = error.isNull()
    category = F.when(ok & right[0] & right[1], "both_correct").when(ok & ~right[0] & ~right[1], "both_wrong").when(ok, "position_bias")
    return rows.select(
        *items.columns, p1.alias("test1_prediction"), p2.alias("test2_prediction"), right[0].alias("test1_correct"), right[1].alias("test2_correct"),
        F.when(ok, (p1 == "B") == (p2 == "A")).alias("is_consistent"), category.alias("category"), error.alias("error"),
        (F.coalesce("prompt_tokens1", F.lit(0)) + F.when(asked[1], F.coalesce("prompt_tokens2", F.lit(0))).otherwise(0)).alias("prompt_tokens"),
        (F.coalesce("completion_tokens1", F.lit(0)) + F.when(asked[1], F.coalesce("completion_tokens2", F.lit(0))).otherwise(0)).alias("completion_tokens"),
    )


#: The right letter in the three rotations of (fast, medium, slow).
ROTATIONS = ("A", "B", "C")


def judge_triples(items: DataFrame, responses: DataFrame) -> DataFrame:
    """As judge_pairs, over three rotations; later tests count only if all before could be parsed."""
    r = responses.withColumn("_p", P.answer("response", triple=True))
    wide = r.groupBy("pair_id").agg(*[F.coalesce(F.max(F.when(F.col("test_no") == n, F.col("_p"))), F.lit("UNKNOWN")).alias(f"_p{n}") for n in (1, 2, 3)])
    p = [F.col(f"_p{n}") for n in (1, 2, 3)]
    bad = [F.when(x == "PARSE_FAILED", f"test{i}_answer_parse_failed").when(~x.isin(*ROTATIONS), f"test{i}_error") for i, x in enumerate(p, 1)]
    error = F.coalesce(*bad)
    right = [(x == w).cast("int") for x, w in zip(p, ROTATIONS)]
    total = right[0] + right[1] + right[2]
    steady = (right[0] == right[1]) & (right[1] == right[2])
    category = F.when(total == 3, "all_correct").when(total == 0, "all_wrong").when(steady, "consistent_partial").otherwise("position_bias")
    return items.join(wide, "pair_id").select(
        *items.columns, *[x.alias(f"test{i}_prediction") for i, x in enumerate(p, 1)], error.alias("error"),
        F.when(error.isNull(), total).alias("num_correct"), F.when(error.isNull(), steady).alias("is_consistent"), F.when(error.isNull(), category).alias("category"),
    )


def with_evaluation_bin(df: DataFrame, speedup: str = "speedup") -> DataFrame:
    return df.withColumn("_b", evaluation_bin(F.col(speedup))).withColumns({"speedup_bin": F.col("_b.label"), "speedup_bin_idx": F.col("_b.idx")}).drop("_b")


def percent(part: Column, whole: Column, digits: int = 2) -> Column:
    return F.round(F.coalesce(F.try_divide(part * 100.0, whole), F.lit(0.0)), digits)


def _counters(right: str) -> list[Column]:
    is_ = lambda c: F.count_if(F.col("category") == c)
    return [
        F.count("*").alias("total"), F.count_if(F.col("error").isNull()).alias("success"), F.count_if(F.col("error").isNotNull()).alias("errors"),
        F.count_if(F.col("error").contains("parse_failed")).alias("parse_errors"), is_(right).alias("correct"),
        F.count_if("is_consistent").alias("consistent"), F.count_if(~F.col("is_consistent")).alias("inconsistent"),
    ]


def evaluation_stats(judged: DataFrame, dataset: str = "dataset_type", bin_col: str = "speedup_bin", right: str = "both_correct") -> DataFrame:
    """Counters overall, by data set and by bin, in one scan: level, name, counters, accuracy.

    Overall accuracy is over rows without error, the others over all their rows; an empty bin name is no bin.
    """
    other = [F.count_if(F.col("category") == c).alias(c) for c in ("both_wrong", "position_bias", "all_wrong", "consistent_partial")]
    sets = judged.groupingSets([[], [dataset], [bin_col]], dataset, bin_col).agg(F.grouping_id().alias("_g"), *_counters(right), *other)
    level = F.when(F.col("_g") == 3, "overall").when(F.col("_g") == 1, "dataset").otherwise("bin")
    name = F.when(F.col("_g") == 3, "all").when(F.col("_g") == 1, F.col(dataset)).otherwise(F.col(bin_col))
    accuracy = percent(F.col("correct"), F.when(F.col("_g") == 3, F.col("success")).otherwise(F.col("total")))
    out = sets.select(level.alias("level"), name.alias("name"), *[c for c in sets.columns if c not in (dataset, bin_col, "_g")], accuracy.alias("accuracy"), percent(F.col("consistent"), F.col("success")).alias("consistency_rate"))
    return out.filter((F.col("level") != "bin") | (F.coalesce("name", F.lit("")) != ""))


def pending(items: DataFrame, done: DataFrame, key: str, order: str, limit: int | None = None, retry_errors: bool = False) -> DataFrame:
    """Items that are not done yet, then the first ``limit`` of those. Failed rows count as done unless retried."""
    seen = done.filter("error is null") if retry_errors else done
    left = items.join(seen.select(key).distinct(), key, "left_anti")
    return left.orderBy(order).limit(limit) if limit else left
