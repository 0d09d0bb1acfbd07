"""Language-model scoring: a log-bilinear neural model trained with noise-contrastive estimation.

*Counts.* Token counts over all training texts, added up in tasks and by Spark.

*Model.* Words have a probability of their own until ``COVER`` of the training tokens is reached, so the
vocabulary grows with the corpus; it ends at the ``LISTED`` words a task may hold. The ``HEAD`` most frequent
ones are symbols; the others are cut by frequency into at most ``BANDS`` bands of equal size, and each band is a
symbol. One symbol stands for all further words, one for the end of a text. A context of two symbols c1 (next)
and c2 has the vector h = q[c1] * p1 + q[c2] * p2 and predicts the symbol w with score h . r[w] + b[w]. Within
a band the same vector predicts the word v with score h . t[v] + log share of v, normalised over the band alone,
so the work per token stays a bounded matrix product however large the vocabulary.

Training goes once over all training texts: every task of about ``TASK_TOKENS`` runs noise-contrastive steps in
numpy from the same start (noise of all symbols for symbols, of the band for words) and sends its parameters, of
words only those that it met. They are averaged in a tree of sums, symbols by tokens, words by how often each
task met them. What is sent grows with the tasks, so with the corpus.

*Scores.* As scores are bilinear, the log-normalisers of all contexts are one matrix product,
log(exp(A1 + b) exp(A2)'), and a symbol's log10 probability is a gather from three tables. The words of a band
are scored together, a block of contexts against the band. A word without a probability of its own has that of
the common symbol times its smoothed share of its tokens.

*Rare words.* Counts of the ``LISTED`` most frequent words are sent to the tasks, words of at most 64
bytes, 20 MB at most. The others of a text are joined to the counts by Spark.

Null texts are empty: the end alone is their token. A null id is in the fold of remainder 0. Repeated
ids and rows are rows of their own; extra columns are ignored. Without training texts every count is
zero and the model is uniform.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docquarry.llm.common import Written, fold, utf8_rows

FOLDS = 7
HELD_OUT = 2
HEAD = 1024
BANDS = 512
LEAST_BAND = 128
COVER = 0.9
LISTED = 300_000
LISTED_BYTES = 64
WIDTH = 24
NOISE = 48
BAND_NOISE = 4
STEP = 4096
RATE = 0.15
BAND_RATE = 0.15
SEED = 9
END = "\n"  # no word holds a line end
FLUSH_WORDS = 400_000
FAN = 16
TASK_TOKENS = 1 << 22
#: Contexts scored against their band at once, and how many wait for it.
BLOCK = 2048
WAITING = 1 << 20


def tokens(text: bytes) -> list[bytes]:
    """Lower-cased words of a UTF-8 text, without the end."""
    return text.lower().split()


def count_tokens(texts: DataFrame) -> DataFrame:
    """``(word, n)`` of *texts* ``(text)``; the end of a text is the word ``END``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[bytes] = Counter()

        def out() -> pa.RecordBatch:
            words = pa.array(list(held.keys()), pa.binary()).cast(pa.string())
            return pa.RecordBatch.from_arrays([words, pa.array(list(held.values()), pa.int64())], names=["word", "n"])

        for batch in batches:
            held[END.encode()] += batch.num_rows
            for text in utf8_rows(batch.column(0)):
                held.update(tokens(text))
                if len(held) > FLUSH_WORDS:
                    yield out()
                    held.clear()
        yield out()

    return texts.select("text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where("n > 0")


@dataclass(frozen=True)
class Vocabulary:
    """Listed words, most frequent first, with their counts, and what all training tokens are."""

    words: list[bytes]
    counts: np.ndarray
    total: int
    distinct: int
    ends: int
    size: int  # the first *size* words are symbols
    own: int  # the first *own* words have a probability of their own
    band: int  # words of a band

    @property
    def bands(self) -> int:
        return -(-(self.own - self.size) // self.band)

    @property
    def symbols(self) -> int:
        """Words, bands, the common symbol of all others, the end."""
        return self.size + self.bands + 2

    def symbol_of(self) -> np.ndarray:
        """The symbol of each listed word; the last place is that of all unlisted ones."""
        places = np.arange(len(self.words) + 1)
        banded = self.size + (places - self.size) // self.band
        return np.where(places < self.size, places, np.where(places < self.own, banded, self.symbols - 2)).astype(np.int32)

    def edges(self) -> np.ndarray:
        """Where the bands begin and end, counted from the first banded word."""
        return np.minimum(np.arange(self.bands + 1) * self.band, self.own - self.size)

    def symbol_counts(self) -> np.ndarray:
        words = self.counts[: self.own]
        bands = np.add.reduceat(words[self.size :], self.edges()[:-1]) if self.bands else []
        return np.concatenate(
            (words[: self.size], bands, [self.total - self.ends - words.sum(), self.ends])
        ).astype(np.float64)

    def band_shares(self) -> np.ndarray:
        """The log share of each banded word in its band."""
        words = self.counts[self.size : self.own].astype(np.float64)
        of_band = self.symbol_counts()[self.size : self.size + self.bands]
        return np.log(words / np.repeat(of_band, np.diff(self.edges()))).astype(np.float32)

    @property
    def rest(self) -> tuple[float, float]:
        """Tokens and distinct words without a probability of their own."""
        return float(self.symbol_counts()[-2]), float(max(0, self.distinct - (self.ends > 0) - self.own))


def vocabulary(counts: DataFrame, size: int = HEAD, listed: int = LISTED, cover: float = COVER) -> Vocabulary:
    sums = counts.agg(F.sum("n"), F.count("*"), F.max(F.when(F.col("word") == END, F.col("n")))).first()
    top = (
        counts.where((F.col("word") != END) & (F.octet_length("word") <= LISTED_BYTES))
        .orderBy(F.desc("n"), "word")
        .limit(listed)
        .toArrow()
    )
    # the sort of a limit is kept in the plan only: order again
    top = top.sort_by([("n", "descending"), ("word", "ascending")])
    words = [w.encode() for w in top.column("word").to_pylist()]
    n = top.column("n").to_numpy()
    total, distinct, ends = (int(x or 0) for x in sums)
    covering = int(np.searchsorted(np.cumsum(n), cover * (total - ends))) + 1
    size = min(size, len(words))
    own = max(size, min(covering, len(words)))
    return Vocabulary(words, n, total, distinct, ends, size, own, max(LEAST_BAND, -(-(own - size) // BANDS)))


@dataclass
class Parameters:
    """Context vectors q (symbols and the start), target vectors r, biases b, place weights p."""

    q: np.ndarray
    r: np.ndarray
    b: np.ndarray
    p: np.ndarray

    @classmethod
    def start(cls, symbols: int, counts: np.ndarray, width: int, seed: int) -> Parameters:
        draw = np.random.default_rng(seed)
        share = (counts + 1.0) / (counts + 1.0).sum()
        return cls(
            draw.normal(0, 0.1, (symbols + 1, width)).astype(np.float32),
            draw.normal(0, 0.1, (symbols, width)).astype(np.float32),
            np.log(share).astype(np.float32),
            np.ones((2, width), np.float32),
        )

    def flat(self) -> np.ndarray:
        return np.concatenate([x.ravel() for x in (self.q, self.r, self.b, self.p)]).astype(np.float64)

    def filled(self, flat: np.ndarray) -> Parameters:
        parts, at = [], 0
        for x in (self.q, self.r, self.b, self.p):
            parts.append(flat[at : at + x.size].reshape(x.shape).astype(np.float32))
            at += x.size
        return Parameters(*parts)


@dataclass
class Bands:
    """Target vectors of the banded words, their log shares, and where each band begins and ends."""

    t: np.ndarray
    share: np.ndarray
    edges: np.ndarray

    @classmethod
    def start(cls, known: Vocabulary, width: int) -> Bands:
        return cls(np.zeros((known.own - known.size, width), np.float32), known.band_shares(), known.edges())

    def log_probabilities(self, m: Parameters, c1: np.ndarray, c2: np.ndarray, v: np.ndarray) -> np.ndarray:
        """Natural log of the probability of each word *v* among the words of its band."""
        out = np.empty(len(v))
        band = np.searchsorted(self.edges, v, side="right") - 1
        order = np.argsort(band, kind="stable")
        ends = np.searchsorted(band[order], np.arange(len(self.edges)))
        for k in np.flatnonzero(np.diff(ends)):
            lo, hi = self.edges[k], self.edges[k + 1]
            targets = self.t[lo:hi].T
            for at in range(ends[k], ends[k + 1], BLOCK):
                pick = order[at : min(at + BLOCK, ends[k + 1])]
                scores = (m.q[c1[pick]] * m.p[0] + m.q[c2[pick]] * m.p[1]) @ targets + self.share[lo:hi]
                scores -= scores.max(axis=1, keepdims=True)
                found = scores[np.arange(len(pick)), v[pick] - lo]
                out[pick] = found - np.log(np.exp(scores, out=scores).sum(axis=1))
        return out


class Trainer:
    """Noise-contrastive steps with AdaGrad on the tokens of one task."""

    def __init__(self, start: Parameters, bands: Bands, counts: np.ndarray, noise: int, rate: float, seed: int) -> None:
        self.m = start.filled(start.flat())
        self.noise, self.rate = noise, rate
        share = (counts + 1.0) / (counts + 1.0).sum()
        self.log_noise = np.log(share * noise).astype(np.float32)
        self.edges = np.cumsum(share)
        self.draw = np.random.default_rng(seed)
        self.seen = [np.full((len(x), 1), 0.1, np.float32) for x in (self.m.q, self.m.r)]
        self.seen_b = np.full(len(self.m.b), 0.1, np.float32)
        self.seen_p = np.full((2, 1), 100.0, np.float32)
        self.bands = Bands(bands.t.copy(), bands.share, bands.edges)
        self.first_band = len(counts) - 2 - (len(bands.edges) - 1)
        self.seen_t = np.full((len(bands.t), 1), 0.1, np.float32)
        self.met = np.zeros(len(bands.t), np.int64)
        self.slots = np.zeros(max(len(self.m.q), len(bands.t)), np.int64)
        self.columns = np.empty((self.m.q.shape[1], 0))

    def _rows(self, values: np.ndarray, seen: np.ndarray, at: np.ndarray, grads: np.ndarray, rate: float) -> None:
        # one place of each row stands for all, found without a sort
        here, width = np.arange(len(at)), grads.shape[1]
        self.slots[at] = here
        stand = self.slots[at]
        chosen = stand == here
        rows, place = at[chosen], (np.cumsum(chosen) - 1)[stand]
        # a column at a time: the same sums in doubles as over single cells, which are several times slower
        total = np.empty((len(rows), width), np.float32)
        if self.columns.shape[1] < len(at):
            self.columns = np.empty((width, len(at)))
        columns = self.columns[:, : len(at)]
        columns[...] = grads.T
        for j in range(width):
            total[:, j] = np.bincount(place, columns[j], len(rows))
        seen[rows] += (total * total).mean(axis=1, keepdims=True)
        values[rows] -= rate * total / np.sqrt(seen[rows])

    def _within(self, h: np.ndarray, band: np.ndarray, v: np.ndarray) -> np.ndarray:
        """A step of the words *v* of their bands against evenly drawn words of them; the gradient of the contexts."""
        of = self.bands
        lo, many = of.edges[band], of.edges[band + 1] - of.edges[band]
        noise = lo[:, None] + (self.draw.random((len(v), BAND_NOISE), np.float32) * many[:, None]).astype(np.int64)
        at = np.concatenate((v[:, None], np.minimum(noise, (lo + many - 1)[:, None])), axis=1)
        t = of.t[at]
        scores = np.einsum("ij,ikj->ik", h, t) + of.share[at] - np.log(BAND_NOISE / many).astype(np.float32)[:, None]
        g = 1.0 / (1.0 + np.exp(-np.clip(scores, -30, 30)))
        g[:, 0] -= 1.0
        self._rows(of.t, self.seen_t, at.ravel(), (g[:, :, None] * h[:, None, :]).reshape(-1, h.shape[1]), BAND_RATE)
        np.add.at(self.met, v, 1)
        return np.einsum("ik,ikj->ij", g, t)

    def step(self, c1: np.ndarray, c2: np.ndarray, w: np.ndarray, v: np.ndarray) -> None:
        """A step of the symbols *w* after *c1* and *c2*, and of the banded words *v* (below 0: none)."""
        m = self.m
        q1, q2 = m.q[c1], m.q[c2]
        h = q1 * m.p[0] + q2 * m.p[1]
        rw = m.r[w]
        noise = np.minimum(np.searchsorted(self.edges, self.draw.random(self.noise)), len(m.b) - 1)
        rn = m.r[noise]
        of_target = np.einsum("ij,ij->i", h, rw) + m.b[w] - self.log_noise[w]
        of_noise = h @ rn.T + m.b[noise] - self.log_noise[noise]
        gt = 1.0 / (1.0 + np.exp(-np.clip(of_target, -30, 30))) - 1.0
        gn = 1.0 / (1.0 + np.exp(-np.clip(of_noise, -30, 30)))
        # noise words are shared by the step; their gradient is that of the mean over the step
        dh = gt[:, None] * rw + gn @ rn
        banded = np.flatnonzero(v >= 0)
        if len(banded):
            dh[banded] += self._within(h[banded], w[banded] - self.first_band, v[banded])
        scale = np.float32(1.0 / 64)
        self._rows(m.r, self.seen[1], np.concatenate((w, noise)), np.concatenate((gt[:, None] * h, gn.T @ h)) * scale, self.rate)
        gb = (np.bincount(w, gt, len(m.b)) + np.bincount(noise, gn.sum(axis=0), len(m.b))) * scale
        self.seen_b += (gb * gb).astype(np.float32)
        m.b -= (self.rate * gb / np.sqrt(self.seen_b)).astype(np.float32)
        gp = np.stack([(dh * q1).sum(axis=0), (dh * q2).sum(axis=0)]) * scale
        self.seen_p += (gp * gp).mean(axis=1, keepdims=True)
        self._rows(
            m.q, self.seen[0], np.concatenate((c1, c2)), np.concatenate((dh * m.p[0], dh * m.p[1])) * scale, self.rate
        )
        m.p -= self.rate * gp / np.sqrt(self.seen_p)


def _contexts(ids: np.ndarray, n: int, end: int, start: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Next symbol, the one before it, and the target of each token of a text and its end."""
    w = np.empty(n + 1, np.int32)
    w[:n] = ids
    w[n] = end
    c1 = np.empty_like(w)
    c2 = np.empty_like(w)
    c1[0], c1[1:] = start, w[:-1]
    c2[:2], c2[2:] = start, w[:-2]
    return c1, c2, w


def _sparse(met: np.ndarray, t: np.ndarray) -> list[bytes]:
    """Which words were met, how often, and their vectors times that."""
    rows = np.flatnonzero(met)
    return [rows.astype(np.int32).tobytes(), met[rows].astype(np.int64).tobytes(), t[rows].astype(np.float32).tobytes()]


_SENT = "n long, sums binary, rows binary, met binary, vectors binary"
_KINDS = [pa.int64(), *[pa.binary()] * 4]


def _sent(*values: object) -> pa.RecordBatch:
    names = [part.split()[0] for part in _SENT.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, _KINDS, strict=True)], names=names)


class _Sums:
    """Added parameters of tasks."""

    def __init__(self, words: int, width: int) -> None:
        self.n, self.sums = 0, None
        self.met, self.t = np.zeros(words, np.int64), np.zeros((words, width), np.float32)

    def add(self, n: int, sums: bytes, rows: bytes, met: bytes, vectors: bytes) -> None:
        self.n += n
        part = np.frombuffer(sums)
        self.sums = part.copy() if self.sums is None else self.sums + part
        at = np.frombuffer(rows, np.int32)
        self.met[at] += np.frombuffer(met, np.int64)
        self.t[at] += np.frombuffer(vectors, np.float32).reshape(len(at), self.t.shape[1])


def train(texts: DataFrame, known: Vocabulary, width: int = WIDTH, seed: int = SEED) -> tuple[Parameters, Bands]:
    """Parameters averaged over the tasks that have gone through *texts* ``(text)`` once."""
    counts = known.symbol_counts()
    start, bands = Parameters.start(known.symbols, counts, width, seed), Bands.start(known, width)
    if not known.total:
        return start, bands
    spark = texts.sparkSession
    words = {w: i for i, w in enumerate(known.words[: known.own])}
    sent = spark.sparkContext.broadcast((words, np.append(known.symbol_of()[: known.own], known.symbols - 2), known.size, counts, start, bands))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, symbol_of, size, symbol_counts, first, of_bands = sent.value
        get, other, end = own.get, len(own), len(symbol_counts) - 1
        trainer = Trainer(first, of_bands, symbol_counts, NOISE, RATE, seed)
        held: list[tuple[np.ndarray, ...]] = []
        n = seen = 0

        def learn(all_: bool) -> None:
            nonlocal held, n, seen
            if not n:
                return
            taken = [np.concatenate(x) for x in zip(*held, strict=True)]
            order = trainer.draw.permutation(n)
            used = n if all_ else n - n % STEP
            for at in range(0, used, STEP):
                pick = order[at : min(at + STEP, used)]
                trainer.step(*(x[pick] for x in taken))
            rest = order[used:]
            held, n, seen = [tuple(x[rest] for x in taken)], len(rest), seen + used

        for batch in batches:
            for text in utf8_rows(batch.column(0)):
                found = np.array([get(t, other) for t in tokens(text)], np.int32)
                v = np.full(len(found) + 1, -1, np.int32)
                v[:-1] = np.where((found >= size) & (found < other), found - size, -1)
                held.append((*_contexts(symbol_of[found], len(found), end, end + 1), v))
                n += len(found) + 1
                if n >= 64 * STEP:
                    learn(False)
        learn(True)
        if seen:
            t = trainer.bands.t * trainer.met[:, None].astype(np.float32)
            yield _sent(seen, (trainer.m.flat() * seen).tobytes(), *_sparse(trainer.met, t))

    many = len(bands.t)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = _Sums(many, width)
        for batch in batches:
            for i in range(batch.num_rows):
                total.add(*(batch.column(c)[i].as_py() for c in range(5)))
        if total.n:
            yield _sent(total.n, total.sums.tobytes(), *_sparse(total.met, total.t))

    parts = texts.rdd.getNumPartitions()
    wanted = max(spark.sparkContext.defaultParallelism, -(-known.total // TASK_TOKENS))
    if wanted < parts:
        texts, parts = texts.coalesce(wanted), wanted
    sums = texts.select("text").mapInArrow(run, _SENT)
    while parts > 1:
        parts = -(-parts // FAN)
        sums = sums.repartition(parts).mapInArrow(add, _SENT)
    whole = _Sums(many, width)
    for row in sums.toLocalIterator():
        whole.add(*row)
    if not whole.n:
        return start, bands
    mean = whole.t / np.maximum(whole.met, 1)[:, None].astype(np.float32)
    return start.filled(whole.sums / whole.n), Bands(mean, bands.share, bands.edges)


def score_tables(m: Parameters) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Scores by next symbol (with bias), by the symbol before it, and the log-normaliser of each pair."""
    q, r = m.q.astype(np.float64), m.r.astype(np.float64)
    a1 = (q * m.p[0]) @ r.T + m.b
    a2 = (q * m.p[1]) @ r.T
    top1, top2 = a1.max(axis=1), a2.max(axis=1)
    mass = np.exp(a1 - top1[:, None]) @ np.exp(a2 - top2[:, None]).T
    return a1, a2, np.log(mass) + top1[:, None] + top2[None, :]


_ROW = "k long, doc_id %s, held_out boolean, n_tokens long, n_known long, base double, model double, others array<string>"


def _first_pass(docs: DataFrame, known: Vocabulary, model: Parameters, bands: Bands) -> DataFrame:
    """Per row the sums over listed words and the end, and the words that must be looked up."""
    spark = docs.sparkSession
    tables = tuple(x.astype(np.float32) for x in score_tables(model))
    sent = spark.sparkContext.broadcast((known, model, bands, tables))
    cache: dict[str, tuple] = {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab, params, of_bands, (a1, a2, z) = sent.value
        if "made" not in cache:
            places = {w: i for i, w in enumerate(vocab.words)}
            logs = np.log10(np.append(vocab.counts, 0).astype(np.float64) + 1.0)
            cache["made"] = (places, logs, vocab.symbol_of())
        places, logs, symbol_of = cache["made"]
        size, own, listed = vocab.size, vocab.own, len(vocab.words)
        end = vocab.symbols - 1
        base_floor = np.log10(vocab.total + 1.0 * (vocab.distinct + 1))
        rest_tokens, rest_words = vocab.rest
        rest_floor = np.log10(rest_tokens + 1.0 * (rest_words + 1))
        log_end = np.log10(vocab.ends + 1.0)
        get = places.get
        for batch in batches:
            out: list[tuple] = []
            lms = np.zeros(batch.num_rows)
            held: list[tuple[np.ndarray, ...]] = []
            waiting = 0
            for row, text in enumerate(utf8_rows(batch.column(3))):
                words = tokens(text)
                at = np.array([get(w, listed) for w in words], np.int32)
                c1, c2, w = _contexts(symbol_of[at], len(words), end, end + 1)
                lms[row] = float((a1[c1, w] + a2[c2, w] - z[c1, c2]).sum(dtype=np.float64)) / np.log(10.0)
                unlisted = np.flatnonzero(at == listed)
                rare = at[at >= own]
                base = float(logs[at].sum()) + log_end - (len(words) + 1) * base_floor
                lms[row] += float(logs[rare].sum()) - len(rare) * rest_floor
                banded = np.flatnonzero((at >= size) & (at < own))
                held.append((np.full(len(banded), row), c1[banded], c2[banded], at[banded] - size))
                waiting += len(banded)
                if waiting >= WAITING or row == batch.num_rows - 1:
                    rows, c1, c2, v = (np.concatenate(x) for x in zip(*held, strict=True))
                    lms += np.bincount(rows, of_bands.log_probabilities(params, c1, c2, v), len(lms)) / np.log(10.0)
                    held, waiting = [], 0
                n_known = len(words) - len(unlisted) + (vocab.ends > 0)
                out.append((len(words) + 1, n_known, base, [words[i].decode() for i in unlisted]))
            counted, known_, bases, others = list(zip(*out, strict=True)) if out else [[]] * 4
            columns = [counted, known_, bases, lms, others]
            types = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.list_(pa.string())]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], *[pa.array(c, t) for c, t in zip(columns, types, strict=True)]],
                names=["k", "doc_id", "held_out", "n_tokens", "n_known", "base", "model", "others"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select(
        F.monotonically_increasing_id().alias("k"), "doc_id", (fold("doc_id", FOLDS) == HELD_OUT).alias("held_out"), "text"
    ).mapInArrow(run, _ROW % kind)


def score_texts(
    docs: DataFrame, size: int = HEAD, listed: int = LISTED, width: int = WIDTH, cover: float = COVER
) -> DataFrame:
    """``(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score)`` per row."""
    learned = docs.where(fold("doc_id", FOLDS) != HELD_OUT)
    counts = Written(count_tokens(learned), "counts")
    known = vocabulary(counts.read(), size, listed, cover)
    model, bands = train(learned, known, width)
    rows = Written(_first_pass(docs, known, model, bands), "scored")
    # words without a place in the tasks' list: log10(c + 1) and c > 0 come from the counts
    looked_up = (
        rows.read().where(F.size("others") > 0)
        .select("k", F.explode("others").alias("word"))
        .join(counts.read(), "word", "left")
        .groupBy("k")
        .agg(F.sum(F.log10(F.coalesce("n", F.lit(0)) + 1.0)).alias("logs"), F.count("n").alias("more"))
    )
    return (
        rows.read().drop("others").join(looked_up, "k", "left")
        .select(
            "doc_id", "held_out", "n_tokens",
            (F.col("n_known") + F.coalesce("more", F.lit(0))).cast("long").alias("n_known"),
            F.lit(known.total).cast("long").alias("train_tokens"),
            (F.col("base") + F.coalesce("logs", F.lit(0.0))).alias("base_score"),
            (F.col("model") + F.coalesce("logs", F.lit(0.0))).alias("score"),
        )
    )
