"""Each operator on nulls, empty and long texts, ties, repeated rows, clashing columns and empty tables."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sparkloom.llm import decontam, html_text, imatch, langid, linededup, packing, pii, secret_scan, simhash, url_filter

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fingerprint string, component_id int, name string, spans string, part int, k int"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon"
ROWS = [
    (1, None, "en"), (2, "", "en"), (3, "   \n\t ", None), (4, WORDS, "en"), (5, WORDS, "en"), (5, WORDS, "en"), (6, WORDS + "\n" + WORDS, None),
    (None, "une phrase sans rien", "fr"), (None, None, None), (8, "x" * 200_000, "en"), (9, "word " * 30_000, "en"), (10, "123 456", "de"), (11, "a\u0000b ß İ 😀", "tr"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, lang, "s", len(t or ""), "f", 1, "n", "z", 3, 4) for i, t, lang in ROWS], SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


OPERATORS = {
    "imatch": imatch.edited_fingerprints,
    "langid": lambda d: langid.predict(d, langid.fit(d)),
    "secrets": secret_scan.find_secrets,
    "simhash": simhash.near_duplicate_groups,
    "similar": simhash.similar_groups,
    "lines": linededup.dedup_lines,
    "packing": packing.pack_documents,
    "pii": pii.find_personal_data,
}


@pytest.mark.parametrize("name", OPERATORS)
def test_rows(docs, none, name):
    got = OPERATORS[name](docs).collect()
    if name == "packing":
        assert {r["piece"] for r in got} >= {0} and sum(r["piece"] == 0 for r in got) == len(ROWS)
    else:
        assert len(got) == len(ROWS)
    assert sorted((r["doc_id"] is not None, r["doc_id"] or 0) for r in got if r.asDict().get("piece", 0) == 0) == sorted((i is not None, i or 0) for i, *_ in ROWS)
    assert OPERATORS[name](none).collect() == []


def test_decontam(spark, docs, none):
    items = spark.createDataFrame([(1, WORDS), (2, None), (3, ""), (4, "phrase sans"), (1, WORDS)], "item_id int, text string")
    got = {(r["doc_id"], r["item_id"], r["similarity"]) for r in decontam.find_contamination(docs, items).collect()}
    assert got == {(4, 1, 1.0), (5, 1, 1.0), (6, 1, 1.0), (None, 4, 1.0)}
    assert decontam.find_contamination(none, items).count() == 0
    assert decontam.find_contamination(docs, items.limit(0)).count() == 0
    assert decontam.keep_clean(docs, items).count() == len(ROWS) - 5
    assert decontam.keep_clean(docs, items, block_chars=10).count() == len(ROWS) - 5
    small = decontam.find_contamination(docs, items, block_chars=10).distinct().count()
    assert small == 4


def test_pages(spark):
    rows = [(1, None, None), (2, "", ""), (3, "http://a.net/es/x", "<p>one"), (3, "no scheme", "text &amp; <b>more</b> <script>x<p>y"), (None, "x://casino.bet.org?b", "<!-- open")]
    pages = spark.createDataFrame([(*r, "t", "h") for r in rows], "page_id long, url string, html string, text string, host string")
    assert html_text.extract_pages(pages).count() == url_filter.judge_urls(pages).count() == len(rows)
    got = {r["path"]: (r["host"], r["rule"], r["verdict"]) for r in url_filter.judge_urls(pages).where("host <> ''").collect()}
    assert got == {"/es/x": ("a.net", "net/es/", "block"), "": ("casino.bet.org", None, "block")}
    assert html_text.extract_pages(pages.limit(0)).count() == url_filter.judge_urls(pages.limit(0)).count() == 0


def test_stages(spark, docs, none, tmp_path):
    spark.createDataFrame([(1, WORDS)], "item_id int, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for start in (docs, none):
        now = start
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, now, str(tmp_path))
            out.write.parquet(f"{tmp_path}/{name}{start is docs}")
            now = spark.read.parquet(f"{tmp_path}/{name}{start is docs}")
            if name != "packing":
                assert now.columns == start.columns
        assert start is docs or now.count() == 0


def test_near_stage_keeps_one_of_a_group(spark, docs):
    got = corpus_pipeline.near_dedup(spark, docs.where("text is not null"), "").select("doc_id", F.substring("text", 1, 5).alias("t")).collect()
    assert sorted(r["doc_id"] for r in got if r["t"] == "alpha" and r["doc_id"] != 6) == [4]


def test_hostile_texts(spark):
    """One row each that is deep, long or repetitive: linear work, no deep recursion."""
    mail, spelled, digits = "mail a@b" + ".c" * 500_000, "x@y." + "a." * 300_000 + "com", "4 " * 300_000
    rows = [(1, mail), (2, spelled), (3, digits), (4, "+1 " + "(2)" * 300_000), (5, "DE00" + " AB12" * 200_000), (6, "½ ² 3"), (7, "a@b..c.com d@e.f")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r["doc_id"]: r for r in pii.find_personal_data(docs).collect()}
    assert found[1]["n_email"] == 1 and found[2]["n_email"] == 1 and found[7]["n_email"] == 1
    assert {r["doc_id"]: r["lang_pred"] for r in langid.predict(docs, langid.fit(docs.withColumn("lang", F.lit("en")))).collect()}[6] == "und"
    lines = "\n".join(f"line number {i} of a long repeated run" for i in range(30_000))
    cut = linededup.dedup_lines(spark.createDataFrame([(1, lines), (2, "start\n" + lines)], "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["lines_removed"] for r in cut} == {1: 0, 2: 30_000}
    pages = ["<div>" * 100_000 + "</p>" * 100_000 + "text", "<h1>" * 100_000 + "<p>x</p>" * 1000, "<section>" + "<div>" * 50_000 + "</section>" * 50_000 + "<article><p>The end."]
    got = html_text.extract_pages(spark.createDataFrame(list(enumerate(pages)), "page_id long, html string").withColumn("url", F.lit(""))).collect()
    assert {r["page_id"]: r["text"] for r in got}[2] == "The end."
