"""Stemmer, Markdown sections, readiness and anchors on literal rows."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__  # noqa: F401  (it registers all queries)
from sparkloom.functions import readiness, scoring, stemmer
from sparkloom.operators import anchors
from sparkloom.plans import queries as plan
from sparkloom.sources import markdown


@pytest.mark.parametrize("word, want", [
    ("caresses", "caress"), ("ponies", "poni"), ("cats", "cat"), ("feed", "feed"), ("agreed", "agre"), ("plastered", "plaster"), ("bled", "bled"), ("motoring", "motor"), ("sing", "sing"),
    ("conflated", "conflat"), ("hopping", "hop"), ("falling", "fall"), ("filing", "file"), ("happy", "happi"), ("sky", "sky"), ("vietnamization", "vietnam"), ("triplicate", "triplic"),
    ("adjustable", "adjust"), ("adoption", "adopt"), ("probate", "probat"), ("rate", "rate"), ("controll", "control"), ("roll", "roll"), ("is", "is"),
])
def test_one_pass(word, want):
    assert stemmer.porter(word) == want


def test_fixed_point():
    assert stemmer.stem("deployment") == "deploi" and stemmer.stem("v2x") == "v2x" and stemmer.stem("") == ""
    for word in ("generalizations", "oscillators", "agreed", "databases"):
        assert stemmer.porter(stemmer.stem(word)) == stemmer.stem(word)


def test_sections():
    text = "---\ntitle: x\n---\nintro\n# A\none\n## B\n```\n# not a heading\n```\n### C #\n## D\n\ntwo\n# E"
    got = markdown.split_sections(text, "file")
    assert [(level, path) for level, path, _ in got] == [(1, ["file"]), (1, ["A"]), (2, ["A", "B"]), (3, ["A", "B", "C"]), (2, ["A", "D"]), (1, ["E"])]
    assert [body for *_, body in got] == ["intro", "one", "```\n# not a heading\n```", "", "two", ""]
    assert markdown.split_sections("", "x") == [] and markdown.split_sections("\n \n", "x") == []


def test_section_rows(spark):
    docs = spark.createDataFrame([(1, "# A\nbody", "t"), (2, None, "t"), (3, "plain", None)], "id long, text string, title string")
    got = [tuple(r) for r in markdown.sections(docs, "id", "text", "title").orderBy("id").collect()]
    assert got == [(1, 0, 1, ["A"], "body", 1), (3, 0, 1, [""], "plain", 2)]


def test_suffixes(spark):
    a = spark.createDataFrame([("src/a.ts",), ("a.ts",), ("x/y/src/a.ts",)], "anchor string")
    p = spark.createDataFrame([("pkg/src/a.ts",), ("src/a.ts",), ("a.ts",)], "path string")
    got = {tuple(r) for r in anchors.file_suffix_matches(a, p).collect()}
    assert got == {("src/a.ts", "pkg/src/a.ts"), ("src/a.ts", "src/a.ts"), ("a.ts", "a.ts"), ("x/y/src/a.ts", "src/a.ts")}


def test_confidence(spark):
    rows = [(3, 0.97, 0.5, 0.4, False, False), (3, 0.97, 0.9, 0.4, False, False), (3, 0.6, 0.59, 0.4, True, False), (0, None, None, None, False, False), (1, 0.01, None, None, True, False), (2, 0.5, 0.1, None, False, True)]
    c = F.col
    df = spark.createDataFrame(rows, "n int, a double, b double, c double, anchored boolean, bare boolean")
    got = [r[0] for r in df.select(readiness.result_confidence(c("n"), c("a"), c("b"), c("c"), c("anchored"), c("bare"))).collect()]
    assert got == ["confident", "uncertain", "confident", "empty", "empty", "uncertain"]


def test_stemmed_rank_covers_the_plain_one(spark, sf):
    plain = plan.QUERIES["bm25f_scores"](spark, sf).select("item_id", "doc_id")
    assert plain.exceptAll(plan.QUERIES["stemmed_bm25"](spark, sf).select("item_id", "doc_id")).isEmpty()
    assert plan.QUERIES["stemmed_df"](spark, sf).count() > 0
    assert plan.QUERIES["markdown_sections"](spark, sf).select("doc_id").distinct().count() == spark.read.parquet(f"{sf}/documents.parquet").where(F.col("text").rlike(r"\S")).count()


def test_rounding_of_halves_is_that_of_sql(spark):
    import duckdb

    values = [0.1303315, 0.061927499999999996, 1.0000005, -0.1303315, -2.5, 0.0, 1e-7, 0.3, 12.3456785]
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x double").orderBy("i").select(scoring.rounded(F.col("x"), 6).alias("y"), F.round("x", 6).alias("z")).collect()
    want = [duckdb.execute("SELECT round(CAST(? AS DOUBLE), 6)", [v]).fetchone()[0] for v in values]
    assert [r["y"] for r in rows] == want
    assert [r["z"] for r in rows][:2] != want[:2]
