"""Re-ranking, selection and votes on literal cases."""

import pytest
from pyspark.sql import functions as F

from sparkloom.functions import identifiers, mentions
from sparkloom.functions.stemmer import stemmed
from sparkloom.operators import rerank, select
from sparkloom.sources import profiles

CANDIDATE = (
    "q int, source string, tokens array<string>, intent string, chunk_score double, chunk_rank int, fused_rank int, title string, h1 string, intro string, headings array<string>, "
    "aliases array<struct<kind:string,value:string>>, purpose string, role string, token_count int, chunk_count int, package_segment string, version_segment string"
)


def row(q, source, tokens, intent="broad_domain", score=0.5, rank=1, title=None, heads=(), intro=None, purpose="unknown", role="canonical", tokens_n=100, chunks=3, package=None, version=None):
    return (q, source, tokens.split(), intent, score, rank, None, title, title, intro, list(heads), [("title", title)] if title else [], purpose, role, tokens_n, chunks, package, version)


def ranks(spark, rows):
    got = rerank.reranked(spark.createDataFrame(rows, CANDIDATE), "q", stemmed).collect()
    return {(r["q"], r["source"]): r for r in got}


def test_matches_of_tokens(spark):
    asked = spark.createDataFrame([("auth",), ("mock",), ("route",), ("chain",), ("api",)], "token string")
    known = spark.createDataFrame([("authoriz",), ("mocking",), ("subroutes",), ("routes",), ("pipelin",), ("apiary",), ("api",), (None,)], "token string")
    got = {r["token"]: set(r["forms"]) for r in rerank.token_matches(asked, known).collect()}
    # a longer target counts from five characters and three more on
    assert got == {"auth": {"authoriz"}, "route": {"subroutes"}, "chain": {"pipelin"}, "api": {"api"}}


def test_reranking_prefers_owners_and_demotes_distractors(spark):
    q = "snapshot test"
    got = ranks(spark, [
        row(1, "docs/guide/snapshots.md", q, title="Snapshots", purpose="guide", rank=2, score=0.4), row(1, "docs/changelog.md", q, title="Changelog", purpose="changelog", heads=["Snapshot fix"], rank=1, score=0.6),
        row(1, "docs/api/index.md", q, title="API", purpose="api_reference", heads=["snapshot", "test"], tokens_n=5000, rank=3, score=0.5),
        row(2, "docs/upgrade.md", "upgrad v2", title="Upgrade", purpose="migration", rank=1), row(2, "docs/old.md", "upgrad v2", title="Old", role="archive", rank=2), row(2, "packages/v2/x.md", "upgrad v2", title="X", package="v2", rank=3),
    ])
    assert got[1, "docs/guide/snapshots.md"]["rerank_rank"] == 1 and got[1, "docs/changelog.md"]["astray"] == pytest.approx(-0.2)
    assert got[1, "docs/api/index.md"]["container"] < 0 and got[1, "docs/guide/snapshots.md"]["owner"] == pytest.approx(0.3)
    assert got[2, "docs/upgrade.md"]["purpose_fit"] == 0.3 and got[2, "docs/old.md"]["role_cost"] == -0.15 and got[2, "packages/v2/x.md"]["topology"] == 0.3


def test_landing_pages_inherit_in_order(spark):
    rows = [(1, "g/index.md", 1, 1.0), (1, "g/a.md", 2, 2.0), (1, "g/a/b.md", 3, 4.0), (1, "h/README.md", 4, -1.0), (1, "h/x.md", 5, 3.0), (1, "README.md", 6, 1.0), (1, "notes.txt", 7, 1.0)]
    scored = spark.createDataFrame([(*r, "broad_domain") for r in rows], "q int, source string, chunk_rank int, score double, intent string")
    got = {r["source"]: round(r["score"], 6) for r in rerank.inherited(scored, "q").collect()}
    assert got == {"g/index.md": 1.15, "g/a.md": 2.3, "g/a/b.md": 4.0, "h/README.md": -1.0, "h/x.md": 3.0, "README.md": 1.0, "notes.txt": 1.0}


SOURCE = "q int, source string, rank int, tokens array<string>, intent string, title string, purpose string, label string, reasons array<string>, combined double"


def chosen(spark, rows):
    got = select.selection(spark.createDataFrame([(q, s, r, t.split(), i, ti, p, la, re.split(), c) for q, s, r, t, i, ti, p, la, re, c in rows], SOURCE), "q").collect()
    return {(r["q"], r["source"]): (r["selection_rank"], round(r["selection_score"], 4), r["promotions"]) for r in got}


def test_selection(spark):
    got = chosen(spark, [
        (1, "docs/server.md", 1, "server client", "broad_domain", "Server", "guide", "covers", "", 0.9), (1, "docs/server-client.md", 2, "server client", "broad_domain", "Server client", "guide", "partial", "", 0.9),
        (2, "a.md", 1, "x y", "broad_domain", "A", "guide", "unsupported", "", 0.0),
        (3, "docs/changelog.md", 2, "acme releas", "broad_domain", "Changelog", "changelog", "partial", "changelog_release_intent", 0.5), (3, "docs/acme-releas.md", 1, "acme releas", "broad_domain", "acme releas", "guide", "covers", "", 0.9),
        (4, "docs/t.md", 1, "topic", "broad_domain", "Something", "concept", "covers", "concept_over_leaves_by_purpose", 0.6), (4, "docs/ex.md", 2, "topic", "broad_domain", "Example", "example", "covers", "", 0.6),
        (5, "docs/pipelines.md", 2, "compose streams", "broad_domain", "pipe streams", "guide", "partial", "", 0.4), (5, "docs/other.md", 1, "compose streams", "broad_domain", "Other", "guide", "partial", "", 0.4),
        (6, "docs/overview.md", 2, "what acme", "broad_domain", "Overview", "guide", "partial", "", 0.4), (6, "docs/acmes.md", 1, "what acme", "broad_domain", "Acmes", "guide", "covers", "", 0.4),
    ])
    assert got[1, "docs/server-client.md"] == (2, 0.9998, ["title_exact_match_promoted"]) and got[1, "docs/server.md"][:2] == (1, 0.9999)
    assert not [k for k in got if k[0] == 2]
    # A changelog that is asked for keeps others from being owners.
    assert got[3, "docs/changelog.md"] == (1, 1.0998, ["changelog_release_intent_preserved"]) and got[3, "docs/acme-releas.md"][2] == ["covers_label"]
    assert got[4, "docs/ex.md"][:2] == (2, 1.3998) and got[4, "docs/t.md"][0] == 1
    assert got[5, "docs/other.md"][0] == 1
    assert got[6, "docs/overview.md"] == (1, 1.1998, ["overview_landing_promoted"])


def pair(spark, a, b, intent):
    schema = "source string, tokens array<string>, role string, canonicality string, family string, relation string, hit string, field string, anchors array<string>, title_coverage double"
    df = spark.createDataFrame([(a, b, intent)], f"a struct<{schema}>, b struct<{schema}>, intent string")
    votes = df.select(select.pair_votes(F.col("a"), F.col("b"), F.col("intent"), stemmed).alias("votes"))
    return votes.select(select.verdict(F.col("votes")).alias("v")).first()["v"].asDict()


def card(source, tokens="x", role="guide", canon="leaf", family=None, relation=None, hit="none", field="none", anchors=(), title=0.0):
    return (source, tokens.split(), role, canon, family, relation, hit, field, list(anchors), title)


def test_votes(spark):
    got = pair(spark, card("docs/useQuery.md", anchors=["useQuery"]), card("docs/useQueries.md", anchors=["useQuery"]), "exact_symbol")
    assert got == {"winner": "a", "confidence": "high", "margin": 3, "reasons": ["anchor_symbol_basename_match"]}
    got = pair(spark, card("a/index.md", canon="parent", family="f", relation="parent", role="overview"), card("a/b.md", family="f", relation="child", role="api", hit="exact", field="title"), "broad_domain")
    assert got["winner"] == "a" and got["margin"] == 3 and set(got["reasons"]) == {"role_compat_overview_for_broad", "canonicality_parent_for_broad", "family_parent_over_child"}
    got = pair(spark, card("a.md", "why broken", role="guide"), card("b.md", "why broken", role="troubleshooting"), "broad_domain")
    assert got["margin"] == -1 and got["winner"] == "b" and got["reasons"] == ["role_compat_troubleshooting_for_symptom"]
    got = pair(spark, card("docs/globs.md", "glob input", title=0.5), card("docs/configuration.md", "glob input", title=0.0), "exact_symbol")
    assert got["margin"] == 3 and got["reasons"] == ["title_token_coverage_decisive"]
    assert pair(spark, card("a.md"), card("b.md"), "broad_domain") == {"winner": "tie", "confidence": "low", "margin": 0, "reasons": []}
    assert pair(spark, card("test-context.md", anchors=["TestContext"]), card("context.md", anchors=["TestContext"]), "exact_symbol")["winner"] == "tie"


def test_swap_needs_a_reason_of_substance(spark):
    def after(second, intent):
        cards = [card("docs/a.md", role="guide"), second]
        rows = [(1, k + 1, 1.0 - k / 10, ["covers_label"], intent, *x) for k, x in enumerate(cards)]
        schema = "q int, selection_rank int, selection_score double, promotions array<string>, intent string, source string, tokens array<string>, role string, canonicality string, family string, relation string, hit string, field string, anchors array<string>, title_coverage double"
        got = select.swapped(spark.createDataFrame(rows, schema), "q").orderBy("selection_rank").collect()
        return [(r["source"], r["selection_score"], r["promotions"]) for r in got]

    assert after(card("docs/b.md", role="overview", canon="parent"), "broad_domain")[0][0] == "docs/a.md"  # shape alone
    assert after(card("docs/adr.md", role="decision"), "decision_lookup") == [("docs/adr.md", 1.0, ["covers_label", "pairwise_rerank_promoted"]), ("docs/a.md", 0.9, ["covers_label"])]


def test_profiles(spark):
    text = "---\ntitle: Named\n---\nLead in.\n\n# First *em* one\n\nThe intro\ngoes on.\n\n## How to run\n\n### Deep   Part\n\n## Why?\n\n#### x\n\n```\n# no heading\n```\n"
    docs = spark.createDataFrame([("packages/tool/README.md", text), ("docs/adr/a.b.md", "no heading"), ("x.md", None)], "path string, text string")
    got = {r["path"]: r for r in profiles.source_profiles(docs).collect()}
    one = got["packages/tool/README.md"]
    assert one["title"] == "Named" and one["h1"] == "First  one" and one["intro"] == "The intro\ngoes on." and one["questions"] == ["How to run", "Why?"]
    assert [(a["normalized"], a["depth"], a["section_path"]) for a in one["heading_aliases"]] == [("first one", 1, []), ("how to run", 2, ["First  one"]), ("deep part", 3, ["First  one", "How to run"]), ("why?", 2, ["First  one"]), ("x", 4, ["First  one", "Why?"])]
    assert (one["purpose"], one["package_segment"]) == ("package_readme", "tool") and ("package", "tool") in [(a["kind"], a["value"]) for a in one["aliases"]]
    assert (got["docs/adr/a.b.md"]["title"], got["docs/adr/a.b.md"]["intro"], got["docs/adr/a.b.md"]["purpose"]) == ("a.b", "no heading", "adr")
    assert got["x.md"]["title"] == "x" and got["x.md"]["intro"] is None and got["x.md"]["summary"] is None


def test_long_lines_kill_no_task(spark):
    n = 20_000
    texts = ["a/" * n + "b.c", "Foo" + ".bar" * n, "/x" * n, "|" + "---|" * n, "A" * n + ".B" * n, "a-" * n, "x" * n + "/" * n, "a-" * n + "_test.py"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    found = lambda p: F.size(F.regexp_extract_all("t", F.lit(p), F.lit(1)))
    got = df.select(
        identifiers.query_intent(F.col("t")).alias("i"), identifiers.layout_risk(F.col("t")), found(mentions.JAVA_ROUTE), found(mentions.JAVA_SYMBOL_CHAIN), found(mentions.JAVA_TEST_FILE).alias("tests"),
        found(identifiers.JAVA_FILE_PATH).alias("files"),
    ).collect()
    assert got[0]["i"] == "file_anchored" and got[0]["files"] == 1 and got[7]["tests"] == 1
