"""BM25 search over a stored inverted index, without reading texts and without Python workers.

Documents are dealt into *ranges* of about ``range_docs`` by a hash of their id. A *block* holds the
postings of one term in one range: ``(part, term, range, size, tokens, impact, built, docs, tfs, lengths)``
with one element per document in the last three (plain arrays take half the bytes of an array of structs). So a very frequent term is many blocks of bounded size, and a
block fits a task whatever the corpus. Blocks lie in folders by a hash of their term (``part``), sorted by term
and falling ``impact``, the largest term frequency gain of the block. The null term has one posting per
document; it counts documents and tokens.

A search reads the parts of the asked terms in two steps:

1. The heads (all columns but the arrays) bound what a range can give to a question: the sum of weight times
   impact. The ``LEADS`` best ranges of each question are scored; their k-th score is a floor of the result.
2. Of the other ranges only those whose bound reaches the floor are scored. All others are skipped, which
   cannot change the answer.

Indexes grow by batches. The mean length moves with each batch while stored impacts keep the mean of their own
(``built``); a gain grows at most by the ratio of the two means, by which bounds are raised. A batch counts
once the statistics after it are written; one that was cut off before is overwritten by the next attempt.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.functions.binding import unnest
from docquarry.functions.text import split_tokens
from docquarry.operators.bm25 import B, K1, term_weights
from docquarry.operators.ranking import SCORE_DECIMALS, top_k_per_group
from docquarry.session import Scratch, cut_lineage, delete_path

# Ranges scored per question before the others are held against the k-th score.
LEADS = 2
# Bounds and scores are sums in different orders; a range this close to the floor is scored.
SLACK = 1e-6
# Ranges dealt to one task, when they are scored and when they are written.
SCORED_RANGES = 4
WRITTEN_RANGES = 4
# Up to so many asked terms are pushed to the scan as a list.
PUSHED_TERMS = 1_000
# The array columns of a block, and what one element of each is.
ENTRIES = {"docs": "doc", "tfs": "tf", "lengths": "length"}
# Range numbers of one batch lie below this.
_BATCH_RANGES = 1 << 40


class Searched(NamedTuple):
    """A result, with the (question, range) pairs that hold an asked term and those that were scored."""

    rows: DataFrame
    ranges: int
    scored: int


class PostingIndex:
    """An inverted index below *path*, which all executors must reach.

    Ids are unique over all batches. Rows whose id or text is null are left out; empty texts count as
    documents of length 0. One writer at a time; removed documents need a new index.
    """

    def __init__(
        self, spark: SparkSession, path: str, parts: int = 64, range_docs: int = 1024, k1: float = K1, b: float = B
    ) -> None:
        self.spark = spark
        self.path = path.rstrip("/")
        self.parts = parts
        self.range_docs = range_docs
        self.k1 = k1
        self.b = b

    # state
    def version(self) -> int:
        """Number of batches that count."""
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/weights")
        files = folder.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not files.exists(folder):
            return 0
        done = [0]
        for entry in files.listStatus(folder):
            marker = self.spark._jvm.org.apache.hadoop.fs.Path(entry.getPath(), "_SUCCESS")
            if files.exists(marker):
                done.append(int(entry.getPath().getName().split("=")[1]))
        return max(done)

    def weights(self) -> DataFrame:
        """``(term, df, tokens, idf, avg_len)`` over all batches; the null term stands for the corpus."""
        return self.spark.read.parquet(f"{self.path}/weights/version={self.version()}")

    def blocks(self) -> DataFrame:
        """All blocks of the batches that count."""
        folders = [f"{self.path}/blocks/batch={n}" for n in range(self.version())]
        return self.spark.read.option("basePath", f"{self.path}/blocks").parquet(*folders).drop("batch")

    def clear(self) -> None:
        delete_path(self.spark, self.path)

    # writing
    def _gain(self, avg_len: Column) -> Column:
        # a corpus of empty texts has mean 0 and no postings to score
        share = F.coalesce(F.try_divide(F.col("length"), avg_len), F.lit(0.0))
        return F.col("tf") * (self.k1 + 1.0) / (F.col("tf") + self.k1 * (1.0 - self.b + self.b * share))

    def _part(self) -> Column:
        return F.pmod(F.xxhash64("term"), F.lit(self.parts)).cast("int")

    def add(self, docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> None:
        """Index one more batch of documents.

        The texts are shuffled once, by range; counting terms and gathering blocks need no other shuffle.
        A batch without rows adds nothing.
        """
        batch = self.version()
        held = docs.select(F.col(doc_id).alias("doc"), F.col(text).alias("text")).where(
            F.col("doc").isNotNull() & F.col("text").isNotNull()
        )
        n_docs, tokens = held.agg(F.count("*"), F.sum(F.size(split_tokens(F.col("text"))))).first()
        if not n_docs:
            return
        built = float(tokens) / n_docs if tokens else 1.0
        ranges = max(1, -(-n_docs // self.range_docs))
        number = F.pmod(F.xxhash64("doc"), F.lit(ranges)) + F.lit(batch * _BATCH_RANGES)
        cores = self.spark.sparkContext.defaultParallelism
        tasks = min(ranges, max(cores, -(-ranges // WRITTEN_RANGES)))
        dealt = held.withColumn("range", number).repartition(tasks, "range")
        split = dealt.select("range", "doc", split_tokens(F.col("text")).alias("held"))
        marked = F.concat("held", F.array(F.lit(None).cast("string")))
        listed = unnest(split, marked, value="term").select("range", "doc", F.size("held").alias("length"), "term")
        counted = listed.groupBy("range", "doc", "length", "term").agg(F.count("*").cast("int").alias("tf"))
        blocks = counted.groupBy("range", "term").agg(
            F.count("*").alias("size"),
            F.sum("length").alias("tokens"),
            F.max(self._gain(F.lit(built))).alias("impact"),
            F.lit(built).alias("built"),
            F.collect_list(F.struct("doc", "tf", "length")).alias("entries"),
        )
        for name, member in ENTRIES.items():
            blocks = blocks.withColumn(name, F.col(f"entries.{member}"))
        target = f"{self.path}/blocks/batch={batch}"
        (
            blocks.drop("entries")
            .withColumn("part", self._part())
            .hint("rebalance", "part")
            .sortWithinPartitions("part", "term", F.desc("impact"))
            .write.mode("overwrite")
            .partitionBy("part")
            .parquet(target)
        )
        self._count(batch, target)

    def _count(self, batch: int, target: str) -> None:
        """Statistics of the batches so far plus the one in *target*; writing them commits it."""
        parts = self.spark.read.parquet(target).select("term", F.col("size").alias("df"), "tokens")
        if batch:
            parts = parts.unionByName(self.weights().select("term", "df", "tokens"))
        summed = parts.groupBy("term").agg(F.sum("df").alias("df"), F.sum("tokens").alias("tokens"))
        with Scratch(self.spark) as scratch:
            stats = scratch.cut(summed)
            weighed = term_weights(stats).select("term", "idf", "avg_len")
            whole = stats.join(weighed, "term", "left").select("term", "df", "tokens", "idf", "avg_len")
            whole.write.mode("overwrite").parquet(f"{self.path}/weights/version={batch + 1}")
        if batch:
            delete_path(self.spark, f"{self.path}/weights/version={batch}")

    # searching
    def _asked(self, questions: DataFrame, question_id: str, question_text: str) -> DataFrame:
        """``(qid, part, term, weight, avg_len)`` of the asked terms that occur."""
        listed = questions.select(
            F.col(question_id).alias("qid"), F.explode(split_tokens(F.col(question_text))).alias("term")
        )
        known = self.weights().where(F.col("term").isNotNull()).select("term", "idf", "avg_len")
        return (
            listed.groupBy("qid", "term")
            .agg(F.count("*").alias("times"))
            .join(known, "term")
            .select("qid", self._part().alias("part"), "term", (F.col("idf") * F.col("times")).alias("weight"), "avg_len")
        )

    def _asked_blocks(self, asked: DataFrame) -> DataFrame:
        """The blocks of the parts that hold an asked term; few terms are pushed as well."""
        wanted = [row[0] for row in asked.select("part").distinct().collect()]
        blocks = self.blocks().where(F.col("part").isin(wanted))
        few = [row[0] for row in asked.select("term").distinct().limit(PUSHED_TERMS + 1).collect()]
        return blocks.where(F.col("term").isin(few)) if len(few) <= PUSHED_TERMS else blocks

    def _scored(self, chosen: DataFrame, asked: DataFrame, blocks: DataFrame) -> DataFrame:
        """``(qid, doc, score)`` of all documents with an asked term in the *chosen* ``(qid, range)``.

        A block is shuffled once, by its range, beside the questions that ask for its term; postings meet
        questions within the task of their range, and a task has a fixed number of ranges.
        """
        tasks = max(1, -(-chosen.select("range").distinct().count() // SCORED_RANGES))
        # dealt on both sides: Spark gives a join its own number of tasks otherwise
        wanted = chosen.repartition(tasks, "range").groupBy("range").agg(F.collect_set("qid").alias("wanted"))
        askers = asked.groupBy("part", "term").agg(
            F.collect_list(F.struct("qid", "weight")).alias("askers"), F.any_value("avg_len").alias("avg_len")
        )
        held = blocks.select("part", "term", "range", *ENTRIES).join(askers, ["part", "term"])
        dealt = held.repartition(tasks, "range").join(wanted.hint("shuffle_hash"), "range")
        met = F.array_intersect(F.transform("askers", lambda a: a["qid"]), "wanted")
        mine = F.when(F.size("met") == F.size("askers"), F.col("askers")).otherwise(
            F.filter("askers", lambda a: F.array_contains("met", a["qid"]))
        )
        dealt = dealt.withColumn("met", met).withColumn("askers", mine)
        listed = dealt.select("range", "avg_len", "askers", F.inline(F.arrays_zip(*ENTRIES)).alias(*ENTRIES.values()))
        gained = listed.select("range", "doc", self._gain(F.col("avg_len")).alias("gain"), F.inline("askers").alias("qid", "weight"))
        score = F.round(F.sum(F.col("weight") * F.col("gain")), SCORE_DECIMALS)
        return gained.groupBy("qid", "range", "doc").agg(score.alias("score")).select("qid", "doc", "score")

    def search(
        self,
        questions: DataFrame,
        k: int = 4,
        *,
        question_id: str = "qid",
        question_text: str = "text",
        doc_id: str = "doc_id",
    ) -> DataFrame:
        """Top-k documents by BM25 per question: ``(question_id, doc_id, rank, score)``.

        Same rows as :func:`docquarry.operators.bm25.bm25`: ties go to the smaller id, and documents
        without any term of the question are left out.
        """
        return self.searched(
            questions, k, question_id=question_id, question_text=question_text, doc_id=doc_id
        ).rows

    def searched(
        self,
        questions: DataFrame,
        k: int = 4,
        *,
        question_id: str = "qid",
        question_text: str = "text",
        doc_id: str = "doc_id",
    ) -> Searched:
        """As :meth:`search`, with the number of ranges met and scored.

        The rows returned are a table of at most questions x k rows below the shared folder. An index
        without documents has no type of id yet: its empty result has a string.
        """
        if not self.version():
            none = questions.select(
                question_id, F.lit("").alias(doc_id), F.lit(0).alias("rank"), F.lit(0.0).alias("score")
            )
            return Searched(none.where(F.lit(False)), 0, 0)
        best = [F.desc("score"), F.asc("doc")]
        with Scratch(self.spark) as scratch:
            asked = scratch.cut(self._asked(questions, question_id, question_text))
            blocks = self._asked_blocks(asked)
            heads = blocks.select("part", "term", "range", "impact", "built").join(asked, ["part", "term"])
            raised = F.greatest(F.lit(1.0), F.col("avg_len") / F.col("built"))
            # a very common term may weigh less than nothing: it adds nothing to a bound
            most = F.greatest(F.lit(0.0), F.col("weight")) * F.col("impact") * raised
            bounds = scratch.cut(heads.groupBy("qid", "range").agg(F.sum(most).alias("bound")))
            order = [F.desc("bound"), F.asc("range")]
            first = scratch.cut(top_k_per_group(bounds, ["qid"], order, LEADS).select("qid", "range"))
            lead = scratch.cut(top_k_per_group(self._scored(first, asked, blocks), ["qid"], best, k))
            floor = lead.where(F.col("rank") == k).select("qid", F.col("score").alias("floor"))
            rest = scratch.cut(
                bounds.join(first, ["qid", "range"], "left_anti")
                .join(floor, "qid", "left")
                .where(F.col("floor").isNull() | (F.col("bound") >= F.col("floor") - SLACK))
                .select("qid", "range")
            )
            more = self._scored(rest, asked, blocks)
            found = top_k_per_group(lead.drop("rank").unionByName(more), ["qid"], best, k)
            rows = cut_lineage(
                found.select(F.col("qid").alias(question_id), F.col("doc").alias(doc_id), "rank", "score")
            )
            return Searched(rows, bounds.count(), first.count() + rest.count())
