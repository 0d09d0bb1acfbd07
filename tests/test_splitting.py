from __future__ import annotations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from docquarry.config import ChunkSettings
from docquarry.errors import InvalidConfiguration
from docquarry.operators import chunking, splitting

TEXT = st.text(alphabet="ab .,\n", max_size=120)


def cut(text, size, overlap, separators=splitting.SEMANTIC, length=len):
    return list(splitting.split_recursively(text, separators, size, overlap, length))


def test_paragraphs_become_chunks():
    first, second = "A short first paragraph.", "The second one is a good deal longer, " * 2
    assert cut(f"{first}\n\n{second}", 90, 0) == [first, second.strip()]


def test_custom_separators():
    assert len(cut("one---two===three\n\nfour", 10, 0, ["---", "===", "\n\n"])) > 1


@given(TEXT, st.integers(2, 30))
@settings(max_examples=300, deadline=None)
def test_no_overlap_keeps_every_visible_character(text, size):
    chunks = cut(text, size, 0)
    assert "".join("".join(chunks).split()) == "".join(text.split())
    assert all(len(c) <= size for c in chunks)


@given(TEXT, st.integers(4, 30), st.integers(1, 3))
@settings(max_examples=200, deadline=None)
def test_chunks_occur_in_the_text(text, size, overlap):
    for chunk in cut(text, size, overlap):
        assert chunk in text and len(chunk) <= size


def test_overlap_repeats_the_tail():
    # a piece carries its separator: " bb" has length 3, so one piece fits the overlap
    assert cut("aa bb cc dd ee", 8, 3, [" ", ""]) == ["aa bb cc", "cc dd", "dd ee"]


def test_sections_carry_headers():
    text = "intro\n# One\nbody\n## Two\n\ntext\nmore\n\nlast\n# Three\n## Two\nend\n"
    got = [([h for h in headers if h], body) for headers, body in splitting.markdown_sections(text)]
    assert got == [
        ([], "intro"),
        (["One"], "body"),
        (["One", "Two"], "text\nmore  \nlast"),
        (["Three", "Two"], "end"),
    ]


def test_fenced_code_is_no_header():
    text = "# A\n```\n# not a header\n```\nafter"
    assert [b for _, b in splitting.markdown_sections(text)] == ["```\n# not a header\n```\nafter"]


def test_same_headers_join():
    text = "# A\none\n# B\n# A\ntwo"
    assert [b for _, b in splitting.markdown_sections(text)] == ["one  \ntwo"]


@pytest.mark.parametrize("size,overlap", [(10, 3), (7, 0), (5, 4)])
def test_char_windows_cover_the_text(spark, size, overlap):
    text = "äöü" * 9 + "xyz"
    df = spark.createDataFrame([(1, text), (2, ""), (3, "ab")], "id int, text string")
    rows = chunking.char_windows(df, size=size, overlap=overlap).orderBy("id", "chunk_index").collect()
    mine = [r for r in rows if r["id"] == 1]
    expected, start = [], 0
    while start < len(text):
        expected.append(text[start : start + size])
        start += size - overlap
    assert [r["content"] for r in mine] == expected
    assert {r["chunk_total"] for r in mine} == {len(expected)}
    assert not [r for r in rows if r["id"] == 2]


def test_token_windows_stop_at_the_end(spark):
    text = " a b\nc  d e f g "
    df = spark.createDataFrame([(1, text)], "id int, text string")
    rows = chunking.token_windows(df, size=4, overlap=2).orderBy("chunk_index").collect()
    assert [r["content"].split() for r in rows] == [list("abcd"), list("cdef"), list("efg")]
    whole = chunking.token_windows(df, size=100, overlap=2).collect()
    assert [r["content"] for r in whole] == [text]


def test_first_occurrence(spark):
    df = spark.createDataFrame([("abcabc", "abc"), ("abc", "x"), ("abc", "")], "text string, content string")
    rows = chunking.first_positions(df).collect()
    assert [(r["chunk_start_char"], r["chunk_end_char"]) for r in rows] == [(0, 3), (None, None), (None, None)]


def test_routes_by_type(spark):
    docs = spark.createDataFrame(
        [
            ("m", "text/markdown", "# Top\nalpha beta\n## Sub\ngamma"),
            ("t", "text/plain", "one two three four five"),
            ("h", "text/html", "<h1>Head</h1><p>" + "word " * 12 + "</p>"),
            ("x", "application/x-other", "First. Second. Third."),
        ],
        "source_id string, content_type string, text string",
    )
    rows = chunking.split_documents(docs, ChunkSettings(size=6, overlap=1)).collect()
    names = {r["source_id"]: r["text_splitter"] for r in rows}
    assert names == {
        "m": "markdown_header_splitter",
        "t": "token_splitter",
        "h": "html_splitter",
        "x": "semantic_splitter",
    }
    paths = sorted((r["chunk_index"], r["heading_path"], r["closest_heading"]) for r in rows if r["source_id"] == "m")
    assert paths == [(0, "Top", "Top"), (1, "Top > Sub", "Sub")]
    plain = chunking.split_documents(docs, ChunkSettings(size=4, overlap=1, semantic=False)).collect()
    assert {r["text_splitter"] for r in plain} == {"markdown_header_splitter", "token_splitter"}


def test_settings(monkeypatch):
    monkeypatch.setenv("RAG_CHUNK_SIZE", "300")
    monkeypatch.setenv("RAG_CHUNK_OVERLAP", "30")
    found = ChunkSettings.from_environment()
    assert (found.size, found.overlap) == (300, 30)
    with pytest.raises(InvalidConfiguration):
        ChunkSettings(size=10, overlap=10)


def test_one_long_text_with_many_chunks(spark):
    body = "\n\n".join(f"paragraph {i} " + "word " * 480 for i in range(1_000))
    df = spark.createDataFrame([(1, body)], "id int, text string")
    chunks = chunking.recursive_chunks(df, size=500, overlap=0)
    row = chunks.selectExpr("count(*) AS n", "sum(length(content)) AS size", "max(length(text)) AS whole").first()
    assert row["n"] >= 1_000 and row["whole"] == len(body) and row["size"] > 0.95 * len(body)


def test_token_windows_obey_the_model(spark):
    df = spark.createDataFrame([("x" * 1_000,)], "text string")
    sizes = {m: [len(r["content"]) for r in chunking.token_windows(df, size=100, overlap=0, model=m).collect()] for m in ("chars", "chars4")}
    assert sizes == {"chars": [100] * 10, "chars4": [400, 400, 200]}
