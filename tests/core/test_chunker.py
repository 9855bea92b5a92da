"""The chunker on literal documents, and families and phrases on literal rows."""

import pytest
from pyspark.sql import functions as F

from sparkloom.functions import phrases
from sparkloom.operators import selection
from sparkloom.sources import chunker


def kinds(text):
    return [(b.kind, b.first, b.last) for b in chunker.blocks(text.split("\n"))]


def rows(text, target=20, limit=30, path="docs/a b.md"):
    return [dict(zip([c.split()[0] for c in chunker.SCHEMA.split(", ")], r)) for r in chunker.document_chunks(text, path, target, limit)]


def test_blocks():
    text = "# A\npara\nmore\n\n- one\n  two\n\n- three\n\nTitle\n===\n> q\nlazy\n\n| a | b |\n|---|---|\n| 1 | 2 |\n\n```py\n# no heading\n\n```\n---\n    code\n\n    code"
    assert kinds(text) == [
        ("heading", 0, 0), ("paragraph", 1, 2), ("list", 4, 7), ("heading", 9, 10), ("blockquote", 11, 12), ("table", 14, 16), ("code", 18, 21), ("rule", 22, 22), ("code", 23, 25),
    ]
    assert kinds("") == kinds("\n \n") == []
    assert kinds("```\nopen\n# x") == [("code", 0, 2)]


def test_sections_and_ids():
    got = rows("---\ntitle: 'Named'\n---\nintro\n\n# One `x` *y*\n## Two!\nbody\n## Three\n# One\n")
    assert [r["heading_path"] for r in got] == [["Named"], ["One x"], ["One x", "Two!"], ["One x", "Three"], ["One"]]
    assert [(r["body"], r["tokens"], r["start_line"], r["end_line"]) for r in got] == [("intro", 2, 1, 1), ("", 0, 0, 0), ("body", 1, 5, 5), ("", 0, 0, 0), ("", 0, 0, 0)]
    assert got[2]["heading_slug"] == "two" and got[2]["stable_key"] == chunker.sha("docs/a b.md::One x > Two!::1", 16)
    assert rows("x")[0]["heading_path"] == ["a b"] and rows("") == [] and rows(" \n") == []


def test_fill():
    para = lambda n: "w" * n
    got = rows("\n\n".join([para(40), para(36), para(40), para(200), para(4)]))
    assert [r["tokens"] for r in got] == [20, 10, 50, 1]
    assert [bool(r["warning"]) for r in got] == [False, False, True, False] and got[2]["warning"].startswith("Block of type 'paragraph'")
    assert {r["chunk_count"] for r in got} == {4} and [r["chunk_index"] for r in got] == [1, 2, 3, 4]


@pytest.mark.parametrize("text", [
    "\n".join(f"- item {i} {'x' * 40}" for i in range(12)),
    "| a | b |\n|---|---|\n" + "\n".join(f"| {i} | {'y' * 40} |" for i in range(12)),
    "```py\n" + "\n\n".join(f"f{i}({'z' * 40})\ng()" for i in range(12)) + "\n```",
])
def test_atomic_blocks_are_split(text):
    got = rows(text)
    assert len(got) > 2 and [r["part"] for r in got] == list(range(1, len(got) + 1)) and all(r["parts"] == len(got) and "split across" in r["warning"] for r in got)
    if not text.startswith("```"):
        assert "\n".join(r["body"] for r in got) == text and max(r["tokens"] for r in got) <= 30
    else:
        assert all(r["body"].startswith("```py\n") and r["body"].endswith("\n```") for r in got)
        assert "\n\n".join(r["body"][6:-4] for r in got) == text[6:-4]
    quote = rows("> " + "q" * 400)
    assert len(quote) == 1 and "kept as single chunk" in quote[0]["warning"]


def test_chunk_rows(spark):
    docs = spark.createDataFrame([("a.md", "# A\nbody"), ("b.md", None), (None, "x"), ("c.md", "")], "path string, text string")
    assert [(r.path, r.body, r.part) for r in chunker.chunks(docs, "path", "text").collect()] == [("a.md", "body", None)]
    assert chunker.chunks(docs.where("false"), "path", "text").count() == 0


def test_phrases(spark):
    cases = [("red fox", "the red fox", "exact"), ("red fox", "red sly old fox", "near"), ("red fox", "red bb cc dd ee fox", "ordered"), ("red fox", "fox red", "scattered"), ("red fox", "red cat", "none"),
             ("fox", "old fox", "exact"), ("", "fox", "none"), ("red red fox", "red fox red fox", "near"), ("red fox", "red bb cc dd fox_red-fox", "exact")]
    df = spark.createDataFrame(cases, "ask string, field string, want string")
    got = df.select("want", phrases.phrase_hit(phrases.phrase_tokens(F.col("ask")), phrases.phrase_tokens(F.col("field"))).alias("hit")).collect()
    assert [r.hit for r in got] == [r.want for r in got]


def test_long_chain_is_one_family(spark):
    paths = ["/".join("d" * (i + 1)) + ".md" for i in range(12)] + ["lone.md"]
    df = spark.createDataFrame([(1, i, p, None) for i, p in enumerate(paths)], "q int, rank int, path string, aliases array<string>")
    got = {r.path: r for r in selection.families(df, "q").collect()}
    assert {r.family for p, r in got.items() if p != "lone.md"} == {"family_0"} and got["lone.md"].family == "family_1" and got["lone.md"].evidence == []
    assert selection.families(df.where("false"), "q").count() == 0
