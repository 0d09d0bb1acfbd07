from __future__ import annotations

from pyspark.sql import functions as F

from docquarry.functions import headings as H
from docquarry.functions import text as X
from docquarry.operators import chunking, metadata


def one(spark, value, build, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(build(F.col("v")).alias("r")).first()["r"]


def test_markdown_stack_closes_skipped_levels(spark):
    text = "# A\ntext\n### B\n## C\n# D\n"
    rows = one(spark, text, H.markdown_headings)
    assert [(r["level"], r["text"], r["position"], r["path"]) for r in rows] == [
        (1, "A", 0, "A"),
        (3, "B", 9, "A > B"),
        (2, "C", 15, "A > C"),
        (1, "D", 20, "D"),
    ]


def test_markdown_heading_may_follow_blank_lines(spark):
    rows = one(spark, "é\n#\n\nTitle\n", H.markdown_headings)
    assert [(r["text"], r["position"]) for r in rows] == [("Title", 2)]


def test_html_slots_keep_levels(spark):
    html = "<h1>A</h1>x<h3>B <b>b</b></h3><h2 class='k'>C</h2><H3>D</H3>"
    rows = one(spark, html, H.html_headings)
    assert [(r["level"], r["text"], r["path"], r["font_size"]) for r in rows] == [
        (1, "A", "A", 22.0),
        (3, "B b", "A > B b", 18.0),
        (2, "C", "A > C", 20.0),
        (3, "D", "A > C > D", 18.0),
    ]
    assert [r["position"] for r in rows] == [html.lower().index(t) for t in ("<h1", "<h3>b", "<h2", "<h3>d")]


RUN = "array<struct<text:string,font_size:double,page:int,position:int>>"


def test_font_headings(spark):
    runs = [("Title", 18.0, 1, 0), ("Part", 14.0, 1, 5), ("x" * 201, 10.0, 1, 9), ("Other", 14.0, 2, 300)]
    rows = one(spark, runs, H.font_headings, RUN)
    assert [(r["text"], r["level"], r["path"]) for r in rows] == [
        ("Title", 1, "Title"),
        ("Part", 2, "Title > Part"),
        ("Other", 2, "Title > Other"),
    ]
    numbered = one(spark, runs, lambda v: H.font_headings(v, "per_item"), RUN)
    assert [(r["text"], r["level"]) for r in numbered] == [("Title", 1), ("Part", 2), ("Other", 3)]
    many = [(f"t{i}", 12.0, 1, i) for i in range(11)]
    assert one(spark, many, lambda v: H.font_headings(v, "per_item"), RUN) == []
    assert one(spark, [], H.font_headings, RUN) == []


def test_closest_heading_prefers_the_earlier_of_equals(spark):
    text = "# A\n12345678\n# B\n"
    for position, expected in ((0, "A"), (6, "A"), (7, "B"), (99, "B")):
        found = one(spark, text, lambda v, p=position: H.closest_heading(H.markdown_headings(v), F.lit(p)))
        assert found["text"] == expected


def test_titles(spark):
    assert one(spark, "\n  \n" + "x" * 100 + "\n  Short line \nrest", X.first_short_line) == "Short line"
    assert one(spark, "x" * 100, X.first_short_line) is None
    assert one(spark, "intro\n  # Head line \n", X.markdown_title) == "Head line"
    assert one(spark, "<html><h1 id=a>Big <i>one</i></h1>", X.html_title) == "Big one"
    assert one(spark, "<TITLE> A\nb </TITLE><h1>c</h1>", X.html_title) == "A\nb"


def test_given_title_stays(spark):
    df = spark.createDataFrame(
        [("given", "first", "text/plain"), (None, "first", "text/plain"), (None, "p", "application/pdf")],
        "title string, text string, content_type string",
    )
    rows = metadata.extract_metadata(df).collect()
    assert [r["title"] for r in rows] == ["given", "first", "p"]
    assert rows[2]["heading_hierarchy"][0]["path"] == "p" and rows[2]["page_num"] == 1


def test_inherited_keys(spark):
    df = spark.createDataFrame([({"a": "1"}, {"title": "T", "a": "2", "lang": "x"})], "m map<string,string>, f map<string,string>")
    several = df.select(chunking.inherit(F.col("m"), F.col("f"), F.lit(2)).alias("r")).first()["r"]
    single = df.select(chunking.inherit(F.col("m"), F.col("f"), F.lit(1)).alias("r")).first()["r"]
    assert several == {"a": "1", "title": "T"} and single == {"a": "1"}


def test_globs(spark):
    df = spark.createDataFrame([("docs/a.md",), ("docs/sub/b.md",), ("reports/q1",)], "p string")
    rows = df.select(
        X.glob_match(F.col("p"), "docs/*.md").alias("g"), X.path_glob_match(F.col("p"), "sub/*.md").alias("m")
    ).collect()
    assert [tuple(r) for r in rows] == [(True, False), (True, True), (False, False)]
