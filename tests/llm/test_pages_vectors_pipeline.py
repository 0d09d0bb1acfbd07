"""Pages and vectors against brute force, the pipeline's stages, and the registered queries."""

from __future__ import annotations

import os
import random
import sys

import numpy as np
import oracle
import pytest
from conftest import ODD
from pyspark.sql import functions as F

from docquarry.llm import embeddings, html_text, queries

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))


def test_repeated_tokens_against_brute_force():
    draw = np.random.default_rng(4)
    for length in (1, 3, 4, 7):
        streams = [draw.integers(0, 3, draw.integers(0, 40)).tolist() for _ in range(6)]
        seen: dict[tuple, set[int]] = {}
        for i, s in enumerate(streams):
            for j in range(len(s) - length + 1):
                seen.setdefault(tuple(s[j : j + length]), set()).add(i)
        for i, (s, mask) in enumerate(zip(streams, html_text.repeated_tokens(streams, length), strict=True)):
            gone = [False] * len(s)
            for j in range(len(s) - length + 1):
                if len(seen[tuple(s[j : j + length])]) > 1:
                    gone[j : j + length] = [True] * length
            assert mask.tolist() == gone, i


PAGE = (
    "<!DOCTYPE html><html><head><title>t</title><style>p{}</style><script>var t='</p>';</script></head><body class='x'>"
    "<header><h2>Site</h2></header><nav><ul><li>Home</ul></nav><!-- ad > --><div class='ad-box'>Buy <div>now</div></div>"
    "<div id='cookie-banner'>We use cookies</div><article><header><h1>Head&amp;line</h1></header><p>One&nbsp;<b>bo</b>ld"
    "\n text<br>line &#233;<p>1 &lt; 2 &gt; 0<form><input><button>Go</button></form><aside>see also</aside>"
    "<section class='comments'><article class=comment>first!</article></section></article>"
    "<aside>side</aside><footer>&copy; x</footer></body></html>"
)


def test_page_structure(spark):
    open_page = "<body><div>Our shop sells many good things</div><p>{}</p><div>All rights reserved by our shop ltd</div>"
    rows = [
        (1, "http://a.example/x", PAGE),
        (2, "http://b.example/1", open_page.format("alpha beta gamma delta")),
        (3, "http://b.example/2", open_page.format("one two three four five")),
        (4, "http://b.example/2", open_page.format("one two three four five")),
        (5, None, None),
        (6, "", "<nav>menu <article>body text</article>"),
        (7, "http://c.example/", "plain <b>text</b> only"),
        (None, "http://d.example/", "<p>" + "word " * 50_000),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as k", "'x' as text")
    found = {r.page_id: r for r in html_text.main_text(pages).collect()}
    assert len(found) == len(rows)
    assert found[1].text == "Head&line One bold text line é 1 < 2 > 0"
    assert found[2].text == "alpha beta gamma delta"
    assert found[3].text == found[4].text == "one two three four five"
    assert found[5].text == "" and found[5].n_chars == 0
    assert found[6].text == "body text" and found[7].text == "plain text only"
    assert found[None].n_chars == 5 * 50_000 - 1
    assert html_text.main_text(pages.limit(0)).count() == 0


def test_vectors_against_all_pairs(spark):
    draw = np.random.default_rng(5)
    centers = draw.normal(size=(12, 16))
    rows = []
    for i in range(300):
        x = centers[i % 12] + draw.normal(scale=0.03 if i % 3 else 0.5, size=16)
        rows.append((i, x.astype(np.float32).tolist(), i % 2))
    rows += [(300 + i, rows[0][1], 0) for i in range(40)]
    odd = [
        (400, None, 1), (401, [0.0] * 16, 1), (402, rows[1][1], None), (403, [float("nan")] * 16, 1),
        (404, [None, *rows[1][1][1:]], 1), (405, [], 1), (406, [1.0, 2.0], 1), (407, [float("inf"), *rows[1][1][1:]], 1),
    ]
    frame = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, label int").selectExpr("*", "1 as cid", "2 as n")
    x = np.array([r[1] for r in rows], np.float32).astype(float)
    x /= np.linalg.norm(x, axis=1)[:, None]
    label = np.array([r[2] for r in rows])
    link = (x @ x.T >= 0.98) & (label[:, None] == label[None, :]) & ~np.eye(len(rows), dtype=bool)
    part = np.arange(len(rows))
    while True:
        new = np.minimum(part, np.where(link, part[None, :], len(rows)).min(axis=1))
        if (new == part).all():
            break
        part = new
    ids = np.array([r[0] for r in rows])
    for tile in (8, 2048):
        found = {r.vec_id: r for r in embeddings.near_duplicates(frame, tile=tile).collect()}
        assert len(found) == len(rows) + len(odd)
        for i in range(len(rows)):
            r = found[ids[i]]
            assert (r.n_links, r.component_id) == (link[i].sum(), ids[part[i]])
            assert r.kept == (r.vec_id == r.component_id)
        assert all(found[i[0]].n_links == 0 and found[i[0]].kept for i in odd)
    assert embeddings.near_duplicates(frame.limit(0)).count() == 0


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_queries_agree_with_sql(spark, folder, name):
    found = oracle.spark_rows(queries.QUERIES[name](spark, folder))
    assert found == oracle.sql_rows(oracle.connect(folder), queries.ORACLES[name])


def test_every_operator_has_one_query():
    numbers = [int(n[2:].split("_")[0]) for n in queries.QUERIES if n.startswith("op")]
    assert numbers == list(range(1, 14))


def test_pipeline_stages(spark, folder, odd):
    import corpus_pipeline

    docs = spark.read.parquet(f"{folder}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    for _, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, folder)
        assert after.columns == docs.columns
        assert 0 < after.count() <= docs.count()
        odd = odd.withColumns({n: F.lit("x") for n in ("mix_domain", "__domain", "__tokens", "__times") if n not in odd.columns})
        strange = stage(spark, odd, folder)
        assert strange.columns == odd.columns and strange.count() <= len(ODD)
        assert stage(spark, docs.limit(0), folder).count() == 0
    found = corpus_pipeline.run(spark, folder)
    assert found.columns == ["doc_id", "size", "text_crc32", "shard", "slot"]
    assert found.count() == found.select("doc_id").distinct().count() > 0


def test_pipeline_drops_copies_and_leaks(spark, folder):
    import corpus_pipeline

    docs = spark.read.parquet(f"{folder}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    kept = {r.doc_id for r in stages["SimHash near-dedup"](spark, docs, folder).collect()}
    grams = {}
    for r in docs.collect():
        words = (r.text or "").encode().lower().split()
        grams[r.doc_id] = {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}
    close = {a: {b for b in grams if a != b and len(grams[a] & grams[b]) * 5 >= len(grams[a] | grams[b]) * 4} for a in grams}
    assert not any(close[a] & kept for a in kept) and any(close.values())
    reach = list(kept)
    for a in reach:
        reach += [b for b in close[a] if b not in set(reach)]
    assert set(reach) == set(grams)  # what has gone hangs together with what stays
    clean = stages["benchmark decontamination"](spark, docs, folder)
    leaks = queries.op3_decontaminate(spark, folder).where("contaminated")
    assert clean.count() == docs.count() - leaks.count()
    assert clean.join(leaks, "doc_id", "left_semi").count() == 0


def test_pipeline_drops_copies_with_scattered_edits(spark, folder):
    import corpus_pipeline

    body = [f"w{i}" for i in range(300)]
    edited = [w if i % 43 else f"x{i}" for i, w in enumerate(body)]  # seven words: similarity 0.79 to 0.81
    few = [w if i % 60 else f"y{i}" for i, w in enumerate(body)]
    other = [w if i % 20 else f"z{i}" for i, w in enumerate(body)]
    rows = [(i, " ".join(w)) for i, w in enumerate((body, edited, few, other), 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {r.doc_id for r in dict(corpus_pipeline.STAGES)["SimHash near-dedup"](spark, docs, folder).collect()}
    grams = {i: {tuple(t.split()[j : j + 5]) for j in range(296)} for i, t in rows}
    close = lambda a, b: len(grams[a] & grams[b]) >= 0.8 * len(grams[a] | grams[b])
    assert close(1, 2) and close(1, 3) and not close(1, 4)
    assert kept == {1, 4}


def test_near_duplicate_stage_keeps_one_row_per_text_and_id(spark, folder):
    import corpus_pipeline

    rows = [(2, "one two three", "a"), (1, "one two three", "b"), (1, "one two three", "b"), (None, "one two three", "c")]
    rows += [(None, "four five", "d"), (None, "four five", "d"), (None, "", "e"), (3, None, "f"), (4, "six seven", "g")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, `a.b` string").selectExpr("*", "'x' as __id", "1 as later")
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, folder)
    assert kept.columns == docs.columns
    assert sorted(tuple(r)[2:4] for r in kept.collect()) == [("b", "x"), ("d", "x"), ("f", "x"), ("g", "x")]


def test_prose_that_shares_phrases_survives(spark):
    phrase = "at the end of the day it is what it is"
    long = " ".join(f"l{i}" for i in range(60))
    own = [f"first{i} story {phrase} and other{i} things" for i in range(5)]
    rows = [
        (i, "http://e.example/", f"<div>All pages show this line</div><p>{t}</p><p>c{i} {long} d{i}</p>")
        for i, t in enumerate(own)
    ]
    found = {r.page_id: r.text for r in html_text.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert found == {i: f"{t} c{i} d{i}" for i, t in enumerate(own)}


def test_groups_of_a_host_give_the_text_of_the_whole_host(spark):
    long = " ".join(f"né{i}" for i in range(70))
    rows = []
    for i in range(40):
        menu = f"<div>section menu of part {i // 2}</div>"  # on two pages only
        body = f"<p>own{i} words of page{i}" + (f" {long} end{i}" if i in (3, 17) else "") + "</p>"
        rows.append((i, "http://f.example/", menu + body))
    rows.append((40, "http://f.example/", rows[5][2]))
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    whole = {r.page_id: r.text for r in html_text.main_text(pages).collect()}
    assert whole[3] == "own3 words of page3 end3" and whole[40] == whole[5] == "own5 words of page5"
    assert {r.page_id: r.text for r in html_text.main_text(pages, group_pages=4).collect()} == whole


def test_markup_that_must_not_hide_an_article(spark):
    long = " ".join(f"body{i}" for i in range(40))
    rows = [
        ("<article><p>one</p><svg width='1'/><p>two three</p></article>", "one two three"),
        ("<article><p>a <template-card>b</template-card> <style-guide>c</style-guide> d</p></article>", "a b c d"),
        ("<article><nav>menu<p>more</article><p>end</p>", "end"),
        ("<div><nav>menu<div>x</div><p>more</div><p>the text</p>", "the text"),
        (f"<article><p>teaser</p></article><div><p>{long}</div>", f"teaser {long}"),
        ("<article><p>text</p></article><div>short line beside it</div>", "text"),
        ("<article>loose text<br>and more<p>held</p></article>", "loose text and more held"),
        ("<main><svg><path d='/'/></svg><p>after</main>", "after"),
    ]
    pages = spark.createDataFrame([(i, f"http://h{i}.example/", h) for i, (h, _) in enumerate(rows)], "page_id long, url string, html string")
    found = {r.page_id: r.text for r in html_text.main_text(pages).collect()}
    assert [found[i] for i in range(len(rows))] == [t for _, t in rows]


@pytest.mark.parametrize("group_pages", [5, 1000])
def test_whole_operator_against_brute_force(spark, group_pages):
    draw = random.Random(group_pages)
    notice = [f"n{i}" for i in range(60)]
    rows = []
    for i in range(30):
        blocks = []
        for _ in range(draw.randint(1, 4)):
            words = [f"v{draw.randint(0, 9)}" for _ in range(draw.randint(1, 45))]
            if draw.random() < 0.3:
                words[len(words) // 2 : len(words) // 2] = notice
            if draw.random() < 0.2:
                words = ["one", "and", "the", "same", "line"]
            blocks.append(words)
        rows.append((i, f"http://host{i % 2}.example/{i}", draw.random() < 0.5, blocks))
    markup = lambda article, blocks: (
        "<article><p>held words</p>" + "".join(f"<div>{' '.join(b)}</div>" for b in blocks[1:]) + f"</article><div>{' '.join(blocks[0])}</div>"
        if article else "".join(f"<p>{' '.join(b)}</p>" for b in blocks)
    )
    frame = spark.createDataFrame([(i, u, markup(a, b)) for i, u, a, b in rows], "page_id long, url string, html string")
    found = {r.page_id: r.text for r in html_text.main_text(frame, group_pages=group_pages).collect()}

    def open_of(article, blocks):
        return blocks if not article else blocks[1:] + ([blocks[0]] if len(blocks[0]) >= html_text.OUTSIDE_TOKENS else [])

    for i, _, article, blocks in rows:
        others = [open_of(a, b) for j, _, a, b in rows if j % 2 == i % 2]
        mine = open_of(article, blocks)
        stream = [w for b in mine for w in b]
        others = [o for o in others if [w for b in o for w in b] != stream]
        windows = {tuple(s[k : k + 50]) for o in others for s in [[w for b in o for w in b]] for k in range(len(s) - 49)}
        gone = [False] * len(stream)
        for k in range(len(stream) - 49):
            if tuple(stream[k : k + 50]) in windows:
                gone[k : k + 50] = [True] * 50
        kept, at = ["held", "words"] if article else [], 0
        for n, block in enumerate(mine):
            mask, at = gone[at : at + len(block)], at + len(block)
            copied = len(block) >= 4 and any(block in o for o in others)
            beside = article and n == len(blocks) - 1
            if not (beside and (copied or any(mask))) and not (not article and copied):
                kept += [w for w, drop in zip(block, mask, strict=True) if not drop]
        assert found[i] == " ".join(kept), i
