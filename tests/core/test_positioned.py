"""Lines, cells and blocks of positioned text, and navigation entries, on literal cases."""

from sparkloom.operators import navigation, positioned

ITEM = "doc int, page int, text string, x double, y double, width double, height double"


def item(text, x, y, width=None, height=10.0, page=1):
    return (1, page, text, float(x), float(y), float(len(text) * 5 if width is None else width), float(height))


def lines_of(spark, *items):
    return positioned.lines(spark.createDataFrame(items, ITEM))


def cells(spark, *items):
    return [r["cells"] for r in lines_of(spark, *items).orderBy("page", "line").collect()]


def test_lines_and_cells(spark):
    assert cells(spark, item("12,345", 300, 700), item("1 Ordinary business income", 72, 700), item("Heading", 72, 680)) == [["Heading"], ["1 Ordinary business income", "12,345"]]
    assert cells(spark, item("Ending capital", 72, 700, 70), item(" ", 142, 700, 158), item("62,345", 300, 700)) == [["Ending capital", "62,345"]]
    assert cells(spark, item("Net", 72, 700, 15), item("income", 90, 700, 30), item("(lo", 122.8, 700, 12), item("ss)", 135.2, 700, 12)) == [["Net income (loss)"]]
    assert cells(spark, item("Total", 72, 700), item("(1)", 100, 697, height=6), item("Next line", 72, 714)) == [["Total (1)"], ["Next line"]]
    assert cells(spark, item("   ", 72, 700, 40)) == []


def blocks_of(spark, *items, tables=(), fields=()):
    ruled = spark.createDataFrame([(1, p, i, rows) for i, (p, rows) in enumerate(tables)], "doc int, page int, nr int, rows array<array<string>>") if tables else None
    forms = spark.createDataFrame([(1, *f) for f in fields], "doc int, page int, label string, value string") if fields else None
    got = positioned.blocks(lines_of(spark, *items), ruled, forms).orderBy("page", "place").collect()
    return [(r["page"], r["kind"], r["level"] or (r["label"], r["value"]) if r["kind"] != "table" else r["rows"], r["text"]) for r in got]


def test_blocks(spark):
    pair = (None, None)
    assert blocks_of(spark, item("1 Income (loss)", 72, 700), item("12,345", 300, 700), item("2 Net rental", 72, 714), item("-1,200", 300, 714)) == [(1, "key_value", ("1 Income (loss)", "12,345"), None), (1, "key_value", ("2 Net rental", "-1,200"), None)]
    got = blocks_of(spark, item("Schedule K-1", 72, 80), item("Part III Partner's Share", 72, 100), item("Sections of this are prose.", 72, 114), item("Schedule of fees", 72, 140), item("Part II applies to renewals.", 72, 180))
    assert [g[1:3] for g in got] == [("heading", 1), ("heading", 2), ("paragraph", pair), ("paragraph", pair), ("paragraph", pair)]
    assert blocks_of(spark, item("Total distributions . . . . . 9,876", 72, 700)) == [(1, "key_value", ("Total distributions", "9,876"), None)]
    assert blocks_of(spark, item("the left column continues its sentence", 72, 700), item("while the right column narrates separately", 320, 700)) == [(1, "paragraph", pair, "the left column continues its sentence while the right column narrates separately")]
    table = [item(t, x, y) for y, row in ((700, ("Quarter", "Revenue", "Margin")), (714, ("Q1", "4,000", "31%"))) for t, x in zip(row, (72, 220, 380))]
    assert blocks_of(spark, *table, item("Prose resumes here.", 72, 760), *[item(t, x, 774) for t, x in (("Lone", 72), ("row", 220), ("cells", 380))]) == [
        (1, "table", [["Quarter", "Revenue", "Margin"], ["Q1", "4,000", "31%"]], None), (1, "paragraph", pair, "Prose resumes here."), (1, "paragraph", pair, "Lone row cells"),
    ]
    assert [g[3] for g in blocks_of(spark, item("First one.", 72, 700), item("First two.", 72, 713), item("Second.", 72, 760))] == ["First one.\nFirst two.", "Second."]
    assert [g[3] for g in blocks_of(spark, item("Docusign Envelope ID: A-1", 72, 60), item("----------------", 72, 80), item("Real content.", 72, 100))] == ["Real content."]


def test_ruled_tables_and_fields(spark):
    items = [item("Beginning capital", 80, 680), item("50,000", 230, 680), item("Ending capital", 80, 630), item("62,345", 230, 630), item("Outside.", 72, 760)]
    rows = [["Beginning capital", "50,000"], ["Ending capital", "62,345"]]
    got = blocks_of(spark, *items, tables=[(1, rows), (1, [["only one row", "x"]]), (1, [["a"], ["b"]]), (1, [["", ""], ["", ""]])], fields=[(1, "Final", "checked"), (1, "Final", "checked"), (2, "", "45.5%")])
    assert [(g[0], g[1]) for g in got] == [(1, "paragraph"), (1, "table"), (1, "key_value"), (2, "key_value")]
    assert got[1][2] == rows and got[2][2] == ("Final", "checked") and got[3][2] == ("Form field", "45.5%")


def test_navigation(spark):
    config = "- Guide:\n  - Start: guide/start.md\n  - Deep:\n    - Inner: guide/deep/a.md\n    - Other: guide/deep/b.md\n  - End: guide/end.md\n- Home: index.md\n- Api:\n  - One: api/one.md"
    raw = navigation.from_outline(spark.createDataFrame([("mkdocs", "m", config)], "origin string, name string, text string"))
    got = {r["source"]: (r["section"], r["depth"], r["position"]) for r in raw.collect()}
    assert got == {
        "guide/start.md": ("Guide", 1, 1), "guide/deep/a.md": ("Guide/Deep", 2, 1), "guide/deep/b.md": ("Guide/Deep", 2, 2), "guide/end.md": ("Guide", 1, 2), "index.md": ("root", 0, 1), "api/one.md": ("Api", 1, 1),
    }
    entry = "origin string, source string, label string, section string, depth int, position int, landing boolean"
    more = spark.createDataFrame([("frontmatter", "guide/end.md", "F", "guide", 0, 1, True), ("vitepress", "index.md", "V", "Api", 0, 1, False), ("frontmatter", "x/a.md", "A", "x", 0, 2, True), ("readme_as_index", "x/README.md", "R", "x", 0, 1, True)], entry)
    got = {r["source"]: (r["label"], r["section"], r["position"], r["landing"], r["provenance"]) for r in navigation.merged(raw.union(more)).collect()}
    assert got["guide/end.md"] == ("End", "Guide", 2, False, "explicit_config") and got["guide/start.md"] == ("Start", "Guide", 1, True, "explicit_config")
    assert got["index.md"] == ("V", "Api", 2, False, "explicit_config") and got["api/one.md"] == ("One", "Api", 1, True, "explicit_config")
    assert got["x/a.md"] == ("A", "x", 2, True, "frontmatter") and got["x/README.md"] == ("R", "x", 1, False, "structural")
