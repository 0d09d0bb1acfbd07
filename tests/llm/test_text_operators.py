"""Operators on documents: brute-force twins on small tables, and rows of every odd kind."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from conftest import LONG, ODD, PASSAGE  # noqa: F401
from pyspark.sql import functions as F

from docquarry.llm import decontaminate, jaccard, language_model, mixing, quality, sharding, simhash, suffix_dedup, toxicity
from docquarry.llm.common import fold
from docquarry.llm.components import smallest_reachable
from docquarry.llm.suffix_sort import permuted_prefixes, suffix_array


def texts(seed: int, n: int) -> list[tuple]:
    """Texts with shared passages, exact and near copies, ties in id order."""
    draw = random.Random(seed)
    words = ["".join(draw.choice("abcdeé ß\n") for _ in range(draw.randint(2, 7))) for _ in range(300)]
    shared = [" ".join(draw.choice(words) for _ in range(25)) for _ in range(5)]
    rows = []
    for i in range(n):
        body = [" ".join(draw.choice(words) for _ in range(draw.randint(0, 60)))]
        if draw.random() < 0.5:
            body.insert(draw.randint(0, 1), draw.choice(shared))
        rows.append((i, " ".join(body), draw.choice(["en", "de", None]), f"src{draw.randint(0, 5)}", 0))
        if draw.random() < 0.2:
            rows[-1] = (i, rows[draw.randint(0, i)][1], "en", "src0", 0)
    return rows


def brute_suffix(rows: list[tuple], width: int) -> dict[int, tuple]:
    first: dict[bytes, int] = {}
    for i, text, *_ in sorted(rows, key=lambda r: r[0]):
        data = (text or "").encode()
        for j in range(len(data) - width + 1):
            first.setdefault(data[j : j + width], i)
    out = {}
    for i, text, *_ in rows:
        data = (text or "").encode()
        gone = [False] * len(data)
        for j in range(len(data) - width + 1):
            if first[data[j : j + width]] < i:
                gone[j : j + width] = [True] * width
        spans = sum(g and not (p and gone[p - 1]) for p, g in enumerate(gone))
        kept = bytes(b for b, g in zip(data, gone, strict=True) if not g)
        out[i] = (len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest(), kept)
    return out


@pytest.mark.parametrize("alphabet", [1, 2, 5])
def test_suffix_array_and_prefixes(alphabet):
    draw = np.random.default_rng(alphabet)
    for n in (1, 2, 3, 70, 700):
        text = draw.integers(97, 97 + alphabet, n).astype(np.uint8)
        data = text.tobytes()
        order = suffix_array(text, 50).tolist()
        assert sorted(order) == list(range(n))
        assert [data[i : i + 50] for i in order] == sorted(data[i : i + 50] for i in range(n))
        prefixes = permuted_prefixes(text, np.array(order))
        for a, b in zip(order, order[1:]):
            same = next((k for k in range(n) if a + k >= n or b + k >= n or data[a + k] != data[b + k]), n)
            assert prefixes[b] == same


def test_suffix_dedup_is_exact(spark):
    rows = texts(3, 120)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    found = {r[0]: tuple(r[1:5]) + (bytes(r[5]),) for r in suffix_dedup.suffix_dedup(docs).collect()}
    assert found == brute_suffix(rows, 50)


def test_suffix_dedup_in_small_pieces(spark, monkeypatch):
    rows = texts(4, 60)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    monkeypatch.setattr(suffix_dedup, "SHARD_BYTES", 200)
    found = {r[0]: tuple(r[1:5]) + (bytes(r[5]),) for r in suffix_dedup.suffix_dedup(docs, width=30).collect()}
    assert found == brute_suffix(rows, 30)


def test_suffix_dedup_odd_rows(spark, odd, empty):
    found = {r.doc_id: r for r in suffix_dedup.suffix_dedup(odd).collect() if r.doc_id != 7}
    assert found[1].n_removed == 0 and found[2].n_removed == found[2].n_bytes and found[2].n_spans == 1
    assert found[3].n_bytes == found[4].n_bytes == 0
    assert found[6].n_bytes == len(LONG.encode()) and found[6].n_removed == 0
    assert found[None].n_removed >= len(PASSAGE)
    assert suffix_dedup.suffix_dedup(odd).count() == len(ODD)
    assert suffix_dedup.suffix_dedup(empty).count() == 0


def brute_fingerprint(text: str | None) -> int:
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    counts = Counter(b for s in shingles for b in range(64) if xxhash.xxh64_intdigest(s, 42) >> b & 1)
    return sum(1 << b for b, n in counts.items() if 2 * n > len(shingles))


def brute_components(ids: list, linked) -> dict:
    part = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for a in ids:
            for b in ids:
                if part[b] < part[a] and linked(a, b):
                    part[a], changed = part[b], True
    return part


def test_simhash_against_all_pairs(spark):
    rows = texts(5, 80)
    rows += [(100 + i, PASSAGE * 9 + f" end{i}", "en", "s", 0) for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    prints = {r[0]: brute_fingerprint(r[1]) for r in rows}
    part = brute_components(sorted(prints), lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 3)
    for limit in (16, 100_000):
        found = simhash.near_duplicates(docs, trie_rows=limit).collect()
        assert {r.doc_id: (r.fp & (1 << 64) - 1, r.component_id) for r in found} == {
            i: (prints[i], part[i]) for i in prints
        }


def test_trie_of_close_values_is_dealt_again(spark):
    draw = random.Random(2)
    values = sorted({draw.getrandbits(7) | draw.getrandbits(2) << 40 | 5 << 50 for _ in range(300)})
    links = simhash.fingerprint_links(spark.createDataFrame([(v,) for v in values], "fp long"), 3, 16)
    edges = links[0].read()
    for more in links[1:]:
        edges = edges.union(more.read())
    assert len(links) > 1
    found = {r.node: r.component for r in smallest_reachable(edges).collect()}
    part = brute_components(values, lambda a, b: (a ^ b).bit_count() <= 3)
    assert {v: found.get(v, v) for v in values} == part


def test_simhash_odd_rows(odd, empty):
    found = simhash.near_duplicates(odd).collect()
    part = {r.doc_id: r.component_id for r in found}
    assert len(found) == len(ODD)
    assert part[2] == part[1] == 1 and part[4] == part[5] == 3 and part[7] == 7
    assert part[None] is None
    assert simhash.near_duplicates(empty).count() == 0


def test_components_of_a_long_chain_and_a_star(spark):
    chain = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 300)] + [(5, 5), (None, 3)]
    found = {r.node: r.component for r in smallest_reachable(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert found == {**{i: 0 for i in range(1, 201)}, **{1000 + i: 1000 for i in range(1, 300)}}


ITEMS = [(10, PASSAGE), (11, "seven wizards watch"), (11, "seven wizards watch"), (12, ""), (13, None), (None, "größe äöü")]


def test_decontamination_odd_rows(spark, odd, empty):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    found = decontaminate.decontaminate(odd, items, spans=True).collect()
    rows = {r.doc_id: r for r in found}
    n = len(PASSAGE.split())
    assert len(found) == len(ODD)
    assert (rows[1].n_words, rows[1].n_hit, rows[1].n_items) == (n + 1, n, 2)
    assert rows[1].items_sha256 == hashlib.sha256(b"10,11").hexdigest()
    assert [(s.start, s.end) for s in rows[1].spans] == [(0, len(PASSAGE))]
    assert rows[7].n_hit == n
    assert rows[3].n_words == rows[4].n_words == rows[5].n_words == 0 and not rows[4].contaminated
    assert rows[6].n_words == 80_000 and not rows[6].contaminated
    text = ODD[6][1]
    assert [text[s.start : s.end] for s in rows[7].spans] == [PASSAGE]
    assert decontaminate.decontaminate(empty, items).count() == 0
    assert decontaminate.decontaminate(odd, items.limit(0)).where("contaminated").count() == 0
    clean = decontaminate.clean_documents(odd, items)
    assert clean.columns == odd.columns and {r.doc_id for r in clean.collect()} == {3, 4, 5, 6, 8}


@pytest.mark.parametrize("bound", [10, 60, 200])
def test_items_in_blocks_give_the_same_answer(spark, odd, bound):
    more = [(20 + i, " ".join(PASSAGE.split()[i : i + 11])) for i in range(4)] + [(30, "seven wizards")]
    items = spark.createDataFrame(ITEMS + more, "item_id long, text string")
    docs = odd.unionByName(odd.where("doc_id = 1"))
    whole = decontaminate.decontaminate(docs, items, spans=True)
    parts = decontaminate.decontaminate(docs, items, spans=True, max_items_bytes=bound)
    assert parts.schema == whole.schema
    assert sorted(map(repr, parts.collect())) == sorted(map(repr, whole.collect()))
    clean = decontaminate.clean_documents(docs, items, max_items_bytes=bound)
    assert clean.columns == docs.columns and {r.doc_id for r in clean.collect()} == {3, 4, 5, 6, 8}


def test_mixture_gives_shortages_to_siblings_first(spark):
    leaves = spark.createDataFrame(
        [("a", "en", "x", 100), ("a", "en", "y", 900), ("a", "de", "z", 5000), ("b", "en", "w", 5000)],
        "domain string, language string, origin string, tokens long",
    )
    parts = {r.origin: r.part for r in mixing.leaf_budgets(leaves, 4000, weights={}, default_weight=1).collect()}
    # a and b get 2000 each; x and y are short of 1000 together: none left over; x gives 400 to y
    assert parts == {"x": 100, "y": 900, "z": 1000, "w": 2000}
    parts = {r.origin: r.part for r in mixing.leaf_budgets(leaves, 9000, weights={("b",): 3, ("a",): 1}, default_weight=1).collect()}
    assert parts == {"x": 100, "y": 900, "z": 3000, "w": 5000}
    parts = {r.origin: r.part for r in mixing.leaf_budgets(leaves, 4000, weights={("b",): 0}, default_weight=1).collect()}
    assert parts["w"] == 0 and sum(parts.values()) == 4000


def test_mixture_odd_rows(odd, empty):
    whole = mixing.mix(odd, share=(1, 1), max_epochs=1, weights={})
    assert whole.columns[: len(odd.columns)] == odd.columns
    assert whole.count() == len(ODD)
    assert {r.mix_epochs for r in mixing.mix(odd, share=(3, 1), max_epochs=3, weights={}).collect() if r.mix_tokens} == {3}
    some = mixing.mix(odd, budget=60, weights={})
    assert sum(r.mix_tokens for r in some.collect()) <= 60
    assert mixing.mix(empty).count() == 0


def test_shards_are_even_and_slots_gapless(spark, odd, empty):
    rows = [(i, "x" * (i * 37 % 400), "en" if i % 3 else "de", "src0", 0) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(6)
    for leaves in (1, 5, 16):
        found = sharding.kd_shards(docs, leaves=leaves).collect()
        assert len(found) == len(rows)
        sizes, slots = Counter(), defaultdict(list)
        for r in found:
            assert r.size == len(rows[r.doc_id][1]) + 1
            assert r.text_crc32 == zlib.crc32(rows[r.doc_id][1].encode())
            sizes[r.shard] += r.size
            slots[r.shard].append(r.slot)
        assert set(sizes) == set(range(leaves))
        assert max(sizes.values()) - min(sizes.values()) < 0.03 * sum(sizes.values()) / leaves + 800
        assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    found = sharding.kd_shards(odd, target_bytes=200_000).collect()
    assert len(found) == len(ODD) and {r.shard for r in found} <= set(range(4))
    assert sorted(r.size for r in found if r.doc_id in (3, 4)) == [1, 1]
    assert sharding.kd_shards(empty, leaves=4).count() == 0


def test_kd_cut_is_the_weighted_median_along_the_widest_dimension(spark):
    rows = [(i, "x" * 9, "en", "s", 0) for i in range(64)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    found = sharding.kd_shards(docs, leaves=2, dimensions={"id": F.col("doc_id"), "flat": F.lit(1)}).collect()
    assert {r.doc_id for r in found if r.shard == 0} == set(range(32))


LABELS = [(i, "good plain words of a calm text number %d" % (i % 7), 1) for i in range(60)] + [
    (100 + i, "BUY!! NOW!! CHEAP!! %d" % (i % 5), 0) for i in range(30)
]


def test_quality_learns_and_stands_odd_rows(spark, odd, empty):
    labelled = spark.createDataFrame(LABELS, "key long, text string, grade int")
    model = quality.fit_quality(labelled)
    docs = labelled.select(F.col("key").alias("doc_id"), "text")
    score = {r.doc_id: r.score for r in quality.score_quality(docs, model).collect()}
    assert all((score[k] > 0.5) == (g == 1) for k, _, g in LABELS)
    found = quality.score_quality(odd, model).collect()
    assert len(found) == len(ODD) and all(0 <= r.score <= 1 for r in found)
    assert {r.score for r in found if r.doc_id in (3, 4)} == {next(r.score for r in found if r.doc_id == 3)}
    one = quality.fit_quality(labelled.where("grade = 1"))
    assert all(r.score > 0.9 for r in quality.score_quality(odd, one).collect())
    none = quality.fit_quality(labelled.limit(0))
    assert {r.score for r in quality.score_quality(odd, none).collect()} == {0.5}
    assert quality.score_quality(empty, model).count() == 0
    assert quality.accepted_documents(odd, model, 0.0).columns == odd.columns


def test_dual_descent_separates():
    draw = np.random.default_rng(0)
    rows = [np.unique(draw.integers(0, 20, 5)) if i % 2 else np.unique(draw.integers(15, 40, 5)) for i in range(200)]
    y = np.where(np.arange(200) % 2, 1.0, -1.0)
    w, b = quality.hinge_dual(rows, [np.ones(len(r)) for r in rows], y, 40, np.ones(200), 50, 0)
    assert (np.sign([w[r].sum() + b for r in rows]) == y).mean() > 0.95


def test_toxicity_grades_are_ordered(spark, odd, empty):
    draw = random.Random(1)
    calm = [f"calm{draw.randint(0, 30)} word{draw.randint(0, 30)} text" for _ in range(80)]
    rows = [(i, t, 0) for i, t in enumerate(calm)] + [
        (200 + i, t + " scum" * 1 + (" trash idiot moron" if i % 2 else ""), 1) for i, t in enumerate(calm[:40])
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    found = {r.doc_id: r for r in toxicity.toxicity(docs.select("doc_id", "text"), docs.select("doc_id", "toxic")).collect()}
    assert all(found[i].toxic == bool(t) for i, _, t in rows)
    mild = np.mean([found[200 + i].severity for i in range(0, 40, 2)])
    severe = np.mean([found[200 + i].severity for i in range(1, 40, 2)])
    assert severe > mild > np.mean([found[i].severity for i in range(80)])
    labels = docs.select("doc_id", "toxic").limit(0)
    assert max(r.severity for r in toxicity.toxicity(odd, labels).collect()) < 1e-6
    assert toxicity.toxicity(empty, docs.select("doc_id", "toxic")).count() == 0


def test_language_model_counts_and_normalises(spark, odd, empty):
    rows = texts(8, 150)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    found = {r.doc_id: r for r in language_model.score_texts(docs, size=20, listed=60, width=4).collect()}
    kinds = {i: (t or "").encode().lower().split() + [b"\n"] for i, t, *_ in rows}
    counts = Counter(w for i, ws in kinds.items() if zlib.crc32(str(i).encode()) % 7 != 2 for w in ws)
    total = sum(counts.values())
    for i, ws in kinds.items():
        r = found[i]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(ws), sum(counts[w] > 0 for w in ws), total)
        assert r.base_score == pytest.approx(sum(np.log10((counts[w] + 1) / (total + len(counts) + 1)) for w in ws))
        assert r.held_out == (zlib.crc32(str(i).encode()) % 7 == 2) and r.score < 0
    assert language_model.score_texts(odd).count() == len(ODD)
    assert language_model.score_texts(empty).count() == 0


def test_language_model_beats_the_base_on_structure(spark):
    draw = random.Random(3)
    rows = []
    for i in range(400):
        w = [draw.randint(0, 29)]
        while len(w) < 60:
            w.append((w[-1] * 7 + draw.randint(0, 1)) % 30)
        rows.append((i, " ".join(f"w{x}" for x in w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    found = language_model.score_texts(docs, size=30).where("held_out").collect()
    assert sum(r.score for r in found) > 0.8 * sum(r.base_score for r in found)


def test_banded_words_follow_their_context(spark):
    """Two topics share frequent words; the banded words depend on which of them stood before."""
    draw = random.Random(5)
    rows = []
    for i in range(1500):
        topic = draw.choice("ab")
        rows.append((i, " ".join(f"{topic}{draw.randint(0, 2)} {topic}x{draw.randint(0, 39)}" for _ in range(20))))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    scores = {}
    for cover in (0.0, 1.0):
        found = language_model.score_texts(docs, size=6, cover=cover).where("held_out").collect()
        scores[cover] = sum(r.score for r in found) / sum(r.n_tokens for r in found)
    # knowing the topic of a banded word is worth half of log10(2) per token
    assert scores[1.0] > scores[0.0] + 0.08


def test_vocabulary_follows_the_tokens(spark):
    counts = spark.createDataFrame([(f"w{i:04d}", 1 + 4000 // (i + 1)) for i in range(2000)] + [("\n", 50)], "word string, n long")
    sizes = []
    for cover in (0.0, 0.5, 0.9, 1.0):
        known = language_model.vocabulary(counts, 100, 1500, cover)
        words = known.total - known.ends
        assert known.own in (100, 1500) or known.counts[: known.own].sum() >= cover * words > known.counts[: known.own - 1].sum()
        assert known.symbol_counts().sum() == known.total and len(known.symbol_counts()) == known.symbols
        assert known.rest == (words - known.counts[: known.own].sum(), 2000 - known.own)
        assert known.symbol_of().max() == known.symbols - 2
        shares = np.exp(known.band_shares())
        assert np.allclose([shares[a:b].sum() for a, b in zip(known.edges()[:-1], known.edges()[1:], strict=True)], 1.0, atol=1e-4)
        sizes.append(known.own)
    assert sizes == sorted(sizes) and sizes[0] == 100 and sizes[-1] == 1500


def test_bands_are_normalised_over_their_words():
    draw = np.random.default_rng(2)
    m = language_model.Parameters.start(9, np.arange(9) * 3.0, 5, 1)
    m.q *= 20
    bands = language_model.Bands(draw.normal(0, 2, (7, 5)).astype(np.float32), np.zeros(7, np.float32), np.array([0, 4, 7]))
    c1, c2 = (np.repeat(draw.integers(0, 9, 30), 7) for _ in range(2))
    p = np.exp(bands.log_probabilities(m, c1, c2, np.tile(np.arange(7), 30))).reshape(30, 7)
    assert np.allclose(p[:, :4].sum(axis=1), 1.0, atol=1e-5) and np.allclose(p[:, 4:].sum(axis=1), 1.0, atol=1e-5)
    h = m.q[c1[0]] * m.p[0] + m.q[c2[0]] * m.p[1]
    by_hand = np.exp([h @ t for t in bands.t[:4]])
    assert np.allclose(p[0, :4], by_hand / by_hand.sum(), rtol=1e-4)


def test_tables_give_normalised_probabilities():
    m = language_model.Parameters.start(9, np.arange(9) * 3.0, 5, 1)
    m.q *= 20
    a1, a2, z = language_model.score_tables(m)
    p = np.exp(a1[:, None, :] + a2[None, :, :] - z[:, :, None])
    assert np.allclose(p.sum(axis=2), 1.0)


def test_folds(odd):
    found = {r[0]: r[1] for r in odd.select("doc_id", fold("doc_id", 7)).collect()}
    assert found == {i: zlib.crc32(str(i).encode()) % 7 if i is not None else 0 for i, *_ in ODD}


def test_first_of_similar_against_all_pairs(spark):
    draw = random.Random(11)
    rows = [(i, t) for i, t, *_ in texts(12, 60)]
    for base in range(6):
        body = [f"b{base}w{draw.randint(0, 400)}" for _ in range(300)]
        for edits in (0, 1, 2, 3, 5, 7, 9, 14, 30):
            copy = list(body)
            for at in draw.sample(range(len(copy)), edits):
                copy[at] = "edited"
            rows.append((len(rows) + 100, " ".join(copy)))
    rows += [(None, rows[-1][1]), (None, "no id here"), (None, "no id  HERE"), (900, None), (901, " ")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    found = {r.digest: r.id for r in jaccard.first_of_similar(docs).read().collect()}
    nodes: dict[str, tuple] = {}
    for i, t in rows:
        data = (t or "").encode()
        words = data.lower().split()
        grams = {tuple(words[j : j + 5]) for j in range(max(1, len(words) - 4))}
        nodes.setdefault(hashlib.md5(data).hexdigest(), (set(), grams))[0].add(i)
    close = {
        (a, b)
        for a, (_, x) in nodes.items()
        for b, (_, y) in nodes.items()
        if a != b and len(x & y) * 5 >= len(x | y) * 4
    }
    assert not [p for p in close if p[0] in found and p[1] in found]
    reach = set(found)
    while more := {b for a, b in close if a in reach} - reach:
        reach |= more
    assert reach == set(nodes)  # whatever has gone hangs together with what is left
    assert len(found) < len(nodes)
    for node, i in found.items():
        assert i == min((x for x in nodes[node][0] if x is not None), default=None)
    assert jaccard.first_of_similar(docs.limit(0)).read().count() == 0


def test_first_of_similar_takes_few_rounds_for_copies(spark):
    body = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join([*body[:i], "x", *body[i + 1 :]])) for i in range(0, 400, 4)]
    assert [r.id for r in jaccard.first_of_similar(spark.createDataFrame(rows, "doc_id long, text string")).read().collect()] == [0]


def test_a_common_passage_makes_no_candidates():
    """Texts that share a passage, but are not similar, share no key; a similar pair always does."""
    draw = random.Random(2)
    passage = [f"p{i}" for i in range(40)]
    sets = jaccard.Shingler()
    texts_ = [[*(f"{draw.random()}" for _ in range(60)), *passage, *(f"{draw.random()}" for _ in range(60))] for _ in range(300)]
    texts_ += [[*t[:80], "edit", *t[81:]] for t in texts_[:30]]
    found = [sets(" ".join(t).encode()) for t in texts_]
    sketch = np.zeros(jaccard.SKETCH, np.int64)
    for x in found:
        np.add.at(sketch, jaccard._counter(x), 1)
    keys = defaultdict(set)
    for i, x in enumerate(found):
        for key in jaccard.prefix(x, sketch).tolist():
            keys[key].add(i)
    pairs = {(a, b) for group in keys.values() for a in group for b in group if a < b}
    assert pairs == {(i, 300 + i) for i in range(30)}
    flat = np.zeros_like(sketch)  # a sketch that knows nothing costs candidates and loses none
    for i in range(30):
        common = len(np.intersect1d(found[i], found[300 + i]))
        assert common * 9 >= 4 * (len(found[i]) + len(found[300 + i]))
        assert set(jaccard.prefix(found[i], flat)) & set(jaccard.prefix(found[300 + i], flat))


def _labels(monkeypatch, module) -> list[str]:
    """The labels of the tables that *module* writes from now on."""
    made: list[str] = []

    class Noted(module.Written):
        def __init__(self, df, label):
            made.append(label)
            super().__init__(df, label)

    monkeypatch.setattr(module, "Written", Noted)
    return made


def test_texts_that_share_a_key_and_differ_are_compared_in_two_rounds(spark, monkeypatch):
    made = _labels(monkeypatch, jaccard)
    # five shingles each, four of them in all texts: two go into the keys, so all share one, and none is a copy
    rows = [(i, f"u{i} a common line of eight words right here") for i in range(40)]
    rows += [(100 + i, " ".join([*[f"w{j}" for j in range(400)], f"e{i}"])) for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.id for r in jaccard.first_of_similar(docs).read().collect()}
    assert found == {*range(40), 100}
    assert made.count("postings") <= 2 and made.count("pairs") <= 2


def test_few_links_need_no_rounds(spark, monkeypatch):
    from docquarry.llm import components

    made = _labels(monkeypatch, components)
    chain = [(i + 1, i) for i in range(300)] + [(-7, 5), (9, 9), (None, 3), (4000, 4001)]
    links = spark.createDataFrame(chain, "a long, b long").repartition(7)
    wanted = {**{i: -7 for i in range(301)}, 4001: 4000}
    assert {r.node: r.component for r in smallest_reachable(links).collect()} == wanted
    assert made == ["links"]
    assert {r.node: r.component for r in smallest_reachable(links, task_links=16).collect()} == wanted
    assert smallest_reachable(links.limit(0)).count() == 0


def test_rows_of_a_step_are_added_without_a_number_per_cell():
    import tracemalloc

    counts = np.arange(2000, 0, -1).astype(np.float64)
    start = language_model.Parameters.start(2000, counts, 24, 1)
    none = language_model.Bands(np.zeros((0, 24), np.float32), np.zeros(0, np.float32), np.zeros(1, np.int64))
    trainer = language_model.Trainer(start, none, counts, 8, 0.15, 1)
    draw = np.random.default_rng(3)
    at, grads = draw.integers(0, 300, 20_000), draw.normal(size=(20_000, 24)).astype(np.float32)
    values, seen = np.zeros((2000, 24), np.float32), np.full((2000, 1), 0.1, np.float32)
    trainer._rows(values, seen, at, grads, 0.15)
    total = np.zeros((2000, 24))
    np.add.at(total, at, grads.astype(np.float64))
    square = 0.1 + (total * total).mean(axis=1, keepdims=True)
    assert np.allclose(seen, square, rtol=1e-4) and np.allclose(values, -0.15 * total / np.sqrt(square), rtol=1e-3, atol=1e-5)
    tracemalloc.start()
    trainer._rows(values, seen, at, grads, 0.15)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < grads.size * 8  # eight bytes a cell


def test_what_survives_has_no_similar_earlier_text(spark, monkeypatch):
    draw, rows = np.random.default_rng(11), []
    for family in range(8):
        members = [[f"f{family}w{i}" for i in range(120)]]
        for n in range(1, 24):
            words = list(members[draw.integers(len(members))])
            for at in draw.choice(120, draw.integers(1, 4), replace=False):
                words[at] = f"f{family}m{n}at{at}"
            members.append(words)
        rows += [(family * 100 + i, " ".join(w)) for i, w in enumerate(members)]
    # the third is like the second, that like the first; others hold the ends, so all three have the same rare shingles
    base = [f"b{i}" for i in range(300)]
    others = [[*base[:59], *(f"o{n}w{i}" for i in range(400)), *base[241:]] for n in range(3)]
    rows += [(9000 + i, " ".join(w)) for i, w in enumerate((base[:245], base, base[55:], *others))]
    sets = {i: set(jaccard.Shingler()(t.encode()).tolist()) for i, t in rows}
    close = lambda a, b: len(sets[a] & sets[b]) * 5 >= len(sets[a] | sets[b]) * 4
    wanted = {b for b in sets if not any(close(a, b) for a in sets if a < b)}
    chained = {b for b in set(sets) - wanted if not any(close(a, b) for a in wanted if a < b)}
    assert len(wanted) > 40 and chained and 9002 in chained
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.id for r in jaccard.first_of_similar(docs).read().collect()} == wanted
    monkeypatch.setattr(jaccard, "FEW_PAIRS", 0)
    monkeypatch.setattr(jaccard, "PARTNERS", 0.05)
    monkeypatch.setattr(jaccard, "DOUBLINGS", 1)
    made = _labels(monkeypatch, jaccard)
    assert {r.id for r in jaccard.first_of_similar(docs).read().collect()} == wanted
    assert made.count("pairs") > 3


def test_picked_rows_hold_all_that_are_asked_for(spark, monkeypatch):
    rows, asked = spark.range(5000).selectExpr("id as node", "id * 2 as k"), spark.range(0, 5000, 7).selectExpr("id as node")
    wanted = {(i, 2 * i) for i in range(0, 5000, 7)}
    assert {tuple(r) for r in jaccard._picked(rows, asked).collect()} == wanted
    monkeypatch.setattr(jaccard, "BITS", 1 << 12)
    found = jaccard._picked(rows, asked)
    assert found.columns == rows.columns and wanted < {tuple(r) for r in found.collect()} and found.count() < 2000
    assert jaccard._picked(rows, asked.limit(0)).count() == 0
