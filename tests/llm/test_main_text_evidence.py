"""Vouched text goes through the host's suffix array and says what repeated open text is."""

from __future__ import annotations

import pytest

from docquarry.llm import html_text


@pytest.mark.parametrize("group_pages", [2, 1000])
def test_vouched_text_decides_about_open_text(spark, group_pages):
    story = " ".join(f"s{i}" for i in range(80))
    notice = " ".join(f"n{i}" for i in range(60))
    teaser = " ".join(f"s{i}" for i in range(10, 65))
    letter = " ".join(f"m{i}" for i in range(30))
    rows = [
        ("<article><p>{}</p></article>".format(story), story),
        # copies of the story on pages without an article are prose, the notice is not
        (f"<p>first {story} end</p><p>a {notice} b</p>", f"first {story} end a b"),
        (f"<p>second {story} fin</p><p>c {notice} d</p>", f"second {story} fin c d"),
        # an excerpt of the story beside another article is a teaser
        (f"<article><p>other text</p></article><div>read {teaser} more</div>", "other text"),
        # pages of unlike articles are unlike, so what stands beside both is the host's
        (f"<article><p>third</p></article><div>{letter}</div>", "third"),
        (f"<article><p>fourth</p></article><div>{letter}</div>", "fourth"),
    ]
    frame = spark.createDataFrame([(i, "http://g.example/", h) for i, (h, _) in enumerate(rows)], "page_id long, url string, html string")
    found = {r.page_id: r.text for r in html_text.main_text(frame, group_pages=group_pages).collect()}
    assert [found[i] for i in range(len(rows))] == [t for _, t in rows]
