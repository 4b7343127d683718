"""Queries on texts: documents stand for source code."""

from __future__ import annotations

from pyspark.sql import Window as W, functions as F

from pacekeeper.functions import text as T
from pacekeeper.operators import sanitize as Z
from pacekeeper.plans.dataset import _NORM
from pacekeeper.plans.registry import query, table

_TOKENS = r"regexp_extract_all({}, '[\p{{L}}\p{{M}}\p{{N}}_]+')"


def _docs(spark, sf_dir):
    return table(spark, sf_dir, "documents")


@query(f"SELECT doc_id, md5({_NORM}) AS code_hash, strlen({_NORM})::INTEGER AS n_bytes FROM documents")
def normalize_hash(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", T.code_hash("text").alias("code_hash"), F.octet_length(T.normalize_code("text")).alias("n_bytes"))


@query(f"SELECT doc_id, len({_TOKENS.format(_NORM)})::INTEGER AS n_tokens, len(list_distinct({_TOKENS.format(_NORM)}))::INTEGER AS n_distinct FROM documents")
def token_count(spark, sf_dir):
    tokens = T.tokens("text")
    return _docs(spark, sf_dir).select("doc_id", F.size(tokens).alias("n_tokens"), F.size(F.array_distinct(tokens)).alias("n_distinct"))


@query(f"""WITH t AS (SELECT doc_id, md5({_NORM}) AS h, list_distinct({_TOKENS.format(_NORM)}) AS s FROM documents)
  SELECT a.doc_id, round(CASE WHEN len(a.s) + len(b.s) = 0 THEN 1.0 ELSE len(list_intersect(a.s, b.s)) / (len(a.s) + len(b.s) - len(list_intersect(a.s, b.s))) END, 9) AS jaccard,
    CASE WHEN a.h = b.h THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS same FROM t a JOIN t b ON b.doc_id = a.doc_id + 1""")
def pair_similarity(spark, sf_dir):
    """Each document with the next one."""
    rows = _docs(spark, sf_dir).select("doc_id", "text")
    after = rows.select((F.col("doc_id") - 1).alias("doc_id"), F.col("text").alias("other"))
    return rows.join(after, "doc_id").select("doc_id", F.round(T.similarity("text", "other", "jaccard"), 9).alias("jaccard"), T.similarity("text", "other", "hash").alias("same"))


@query()
def edit_similarity(spark, sf_dir):
    """Ratcliff-Obershelp ratio of each role's neighbouring turns."""
    turns = table(spark, sf_dir, "conversations")
    after = F.lead("text").over(W.partitionBy("conv_id").orderBy("turn"))
    return turns.withColumn("other", after).filter("other is not null").select("conv_id", "turn", F.round(T.similarity("text", "other", "edit"), 9).alias("ratio"))


@query(f"SELECT code_hash, count(*) AS n FROM (SELECT md5({_NORM}) AS code_hash FROM documents) GROUP BY 1 HAVING count(*) > 1")
def exact_copies(spark, sf_dir):
    return _docs(spark, sf_dir).groupBy(T.code_hash("text").alias("code_hash")).agg(F.count("*").alias("n")).filter("n > 1")


_AUTHORED = "'// Author: x' || chr(10) || text || chr(10) || '@author y' || chr(10) || 'Copyright 2020 z' || chr(10) || 'int solution by me;' || chr(10) || '__author__ = 1'"


def _scrub_sql(patterns, flags="'g'") -> str:
    sql = _AUTHORED
    for p in patterns:
        sql = f"regexp_replace({sql}, '{p}', '', {flags})"
    return sql


def _authored():
    return F.concat(F.lit("// Author: x\n"), "text", F.lit("\n@author y\nCopyright 2020 z\nint solution by me;\n__author__ = 1"))


@query(f"""SELECT doc_id, md5(regexp_replace({_scrub_sql([rf"{p}[^\n]*" for p in T.C_STYLE_AUTHOR])}, '\\n\\s*\\n\\s*\\n', chr(10) || chr(10), 'g')) AS cpp,
  md5({_scrub_sql([rf"(?m)^{p}\s*=[^\n]*" for p in T.PYTHON_AUTHOR])}) AS python FROM documents""")
def scrub_author(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.md5(T.scrub_author(_authored(), "cpp")).alias("cpp"), F.md5(T.scrub_author(_authored(), "python")).alias("python"))


_CODED = "'s = \"a//b\"; // end' || chr(10) || '/* ' || text || ' */ x = ''/'';' || chr(10) || text || ' // ' || doc_id"


def _coded():
    return F.concat(F.lit('s = "a//b"; // end\n/* '), "text", F.lit(" */ x = '/';\n"), "text", F.lit(" // "), F.col("doc_id").cast("string"))


@query(f"""SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace({_CODED}, '//[^\\n]*', '', 'g'), '(?s)/\\*.*?\\*/', '', 'g'), '#[^\\n]*', '', 'g')) AS h FROM documents""")
def basic_clean(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.md5(T.basic_clean(_coded())).alias("h"))


_SPLIT = r"""("(?:\\[\s\S]|[^"\\\n])*(?:"|\n|\z)|''(?:\\[\s\S]|[^''\\\n])*(?:''|\n|\z)|//[^\n]*|/\*[\s\S]*?(?:\*/|\z)|[^"''/]+|[\s\S])"""


@query(f"""SELECT doc_id, md5(array_to_string(list_transform(regexp_extract_all({_CODED}, '{_SPLIT}', 1),
  lambda x: CASE WHEN starts_with(x, '//') THEN '' WHEN starts_with(x, '/*') THEN CASE WHEN contains(x, chr(10)) THEN chr(10) ELSE ' ' END ELSE x END), '')) AS h FROM documents""")
def strip_comments(spark, sf_dir):
    """Java comments outside literals."""
    return _docs(spark, sf_dir).select("doc_id", F.md5(Z.strip_c_comments(_coded(), "java")).alias("h"))


@query("""SELECT CASE doc_id % 4 WHEN 0 THEN 'python' WHEN 1 THEN 'cpp_state_machine' WHEN 2 THEN 'java_state_machine' ELSE 'basic_unsafe' END AS sanitize_method, CASE WHEN doc_id % 4 = 3 THEN 'skipped' ELSE 'valid' END AS syntax_valid, count(*) AS n FROM documents GROUP BY ALL""")
def sanitize_stats(spark, sf_dir):
    """Documents as programs of four languages: method and syntax status."""
    lang = F.element_at(F.array(*map(F.lit, ("python", "cpp", "java", "rust"))), (F.col("doc_id") % 4 + 1).cast("int"))
    rows = _docs(spark, sf_dir).select("doc_id", F.concat(F.lit('x = 1  # '), F.translate("text", "\n", " ")).alias("code"), lang.alias("language"))
    return Z.batch_stats(Z.sanitized(rows))


@query("""SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'io' WHEN 1 THEN 'function' WHEN 2 THEN 'io' WHEN 3 THEN 'function' ELSE 'io' END AS code_type, CASE WHEN doc_id % 2 = 0 THEN 'f' || doc_id ELSE '' END AS entry_point FROM documents""")
def code_type(spark, sf_dir):
    k = F.col("doc_id") % 5
    solution = F.when(k == 0, "x = input()").when(k == 1, "class Solution: pass").otherwise("pass")
    prompt = F.concat(F.lit("Write def  "), F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("f"), F.col("doc_id").cast("string"), F.lit(" (x)"))).otherwise("?"))
    return _docs(spark, sf_dir).select("doc_id", T.code_type(solution, F.when(k == 3, "f"), F.when(k == 2, "1\n2").otherwise("1")).alias("code_type"), T.entry_point(prompt).alias("entry_point"))


@query("""SELECT doc_id, 'n = a / b' || chr(10) || 'random.randint(1, n // ' || doc_id || ')' AS fixed, 'public class Solution { class B' || doc_id || ' {} Solution x; } // class Solution' AS renamed FROM documents""")
def code_repairs(spark, sf_dir):
    n = F.col("doc_id").cast("string")
    fixed = T.fix_generator(F.concat(F.lit("n = a / b\nrandom.randint(1, n / "), n, F.lit(")")))
    java = F.concat(F.lit("public class Main { class B"), n, F.lit(" {} Solution x; } // class Main"))
    return _docs(spark, sf_dir).select("doc_id", fixed.alias("fixed"), T.rename_main_class(java).alias("renamed"))


@query("""WITH c AS (SELECT o_orderkey, o_orderkey * 977 % 3000017 AS n FROM orders)
  SELECT o_orderkey, CASE WHEN n >= 1000000 THEN format('{:.1f}M', n::DOUBLE / 1000000) WHEN n >= 1000 THEN format('{:.1f}K', n::DOUBLE / 1000) ELSE n::VARCHAR END AS shown FROM c""")
def human_counts(spark, sf_dir):
    n = F.col("o_orderkey") * 977 % 3000017
    return table(spark, sf_dir, "orders").select("o_orderkey", T.human_count(n).alias("shown"))


@query("""WITH n AS (SELECT DISTINCT source, lang FROM documents), m AS (SELECT source, lang, CASE WHEN lang = 'en' THEN '' ELSE '__' || source || '/x:' || lang || ' v2.1.' END AS model FROM n)
  SELECT source, lang, CASE WHEN model = '' THEN '' ELSE source || '_x_' || lang || '_v2.1' END AS safe, 'in_results_zero-shot' || CASE WHEN model = '' THEN '' ELSE '_' || source || '_x_' || lang || '_v2.1' END || '.json' AS file,
    CASE lang WHEN 'fr' THEN 'C++' WHEN 'de' THEN 'Python' ELSE upper(lang) END AS shown FROM m""")
def model_names(spark, sf_dir):
    model = F.when(F.col("lang") != "en", F.concat(F.lit("__"), "source", F.lit("/x:"), "lang", F.lit(" v2.1.")))
    alias = F.when(F.col("lang") == "fr", "cc").when(F.col("lang") == "de", "py").otherwise(F.col("lang"))
    return _docs(spark, sf_dir).select("source", "lang").distinct().select("source", "lang", T.file_safe(model).alias("safe"), T.result_name(F.lit("in"), F.lit("zero-shot"), model).alias("file"), T.language_name(alias).alias("shown"))


@query("""SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'p' || doc_id WHEN 1 THEN source || '_' || n_chars WHEN 2 THEN source || '_line' || doc_id ELSE 'line_' || doc_id END AS id, 'q' || doc_id || '_x' AS base FROM documents""")
def identifiers(spark, sf_dir):
    k, n = F.col("doc_id") % 4, F.col("doc_id").cast("string")
    made = T.synthetic_id(F.when(k == 0, F.concat(F.lit("p"), n)).otherwise(""), F.when(k < 3, F.col("source")), F.when(k == 1, F.col("n_chars")), F.col("doc_id"))
    side = F.when(k > 1, "_forward").otherwise("_reversed")
    return _docs(spark, sf_dir).select("doc_id", made.alias("id"), T.base_id(F.concat(F.lit("q"), n, F.lit("_x"), side)).alias("base"))


@query(f"""WITH t AS (SELECT doc_id, lang, list_distinct({_TOKENS.format(_NORM)}) AS s FROM documents),
  p AS (SELECT a.doc_id, CASE WHEN len(a.s) + len(b.s) = 0 THEN 1.0 ELSE len(list_intersect(a.s, b.s)) / (len(a.s) + len(b.s) - len(list_intersect(a.s, b.s))) END::DOUBLE AS x, CASE WHEN a.lang = b.lang THEN 1.0 ELSE 0.0 END::DOUBLE AS y FROM t a JOIN t b ON b.doc_id = a.doc_id + 1)
  SELECT doc_id, round(x, 9) AS src, round(y, 9) AS tgt, round(least(x, y), 9) AS "both", round(greatest(x, y), 9) AS either FROM p""")
def pair_similarity_modes(spark, sf_dir):
    """Two similarities of a pair taken as one in four ways."""
    rows = _docs(spark, sf_dir).select("doc_id", "text", "lang")
    after = rows.select((F.col("doc_id") - 1).alias("doc_id"), F.col("text").alias("text2"), F.col("lang").alias("lang2"))
    x, y = T.similarity("text", "text2", "jaccard"), F.when(F.col("lang") == F.col("lang2"), 1.0).otherwise(0.0)
    return rows.join(after, "doc_id").select("doc_id", *[F.round(T.pair_similarity(x, y, mode), 9).alias(mode) for mode in ("src", "tgt", "both", "either")])


@query(f"""SELECT doc_id, md5(array_to_string(list_transform(regexp_extract_all({_CODED}, '{_SPLIT}', 1),
  lambda x: CASE WHEN starts_with(x, '//') THEN '' WHEN starts_with(x, '/*') THEN CASE WHEN contains(x, chr(10)) THEN chr(10) ELSE ' ' END ELSE x END), '')) AS h FROM documents""")
def strip_comments_cpp(spark, sf_dir):
    """C++ comments outside literals."""
    return _docs(spark, sf_dir).select("doc_id", F.md5(Z.strip_c_comments(_coded(), "cpp")).alias("h"))


@query("""SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN '{"a": ' || doc_id || '}' END AS from_text, '[' || doc_id || ',' || n_chars || ']' AS from_object FROM documents""")
def json_values(spark, sf_dir):
    """JSON text stays, other text is null, objects become text."""
    text = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit('{"a": '), F.col("doc_id").cast("string"), F.lit("}"))).otherwise("{a")
    rows = _docs(spark, sf_dir).select("doc_id", text.alias("t"), F.array("doc_id", "n_chars").alias("o"))
    return rows.select("doc_id", T.json_value(F.col("t"), rows.schema["t"].dataType).alias("from_text"), T.json_value(F.col("o"), rows.schema["o"].dataType).alias("from_object"))
