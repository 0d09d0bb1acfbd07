"""One object that ties a session, a store, models and settings together."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.clock import SystemClock
from docquarry.config import EngineConfig, SearchSettings
from docquarry.operators import answer as A
from docquarry.operators import embed as E
from docquarry.operators import store as ST
from docquarry.operators.postings import PostingIndex
from docquarry.plans import answering, ingest
from docquarry.sources import files, loaders
from docquarry.streaming import ingest as stream


class Engine:
    """Index documents and answer questions.

    *model*, *chat* and *clock* replace the defaults, which need no network.
    """

    def __init__(
        self,
        spark: SparkSession,
        config: EngineConfig,
        *,
        model: E.Model | None = None,
        chat: A.ChatModel | None = None,
        clock=None,
        steps: ingest.Transforms | None = None,
        models: Mapping[str, E.Model] | None = None,
    ) -> None:
        self.spark = spark
        self.config = config
        self.model = model or E.native_model(config.embedding_model, config.embedding_dim)
        self.models = models
        self.chat = chat
        self.clock = clock or SystemClock()
        self.steps = steps
        self.store = ST.DocumentStore(spark, config.data_dir, config.buckets)

    # indexing
    def index(self, sources: DataFrame, force: bool = False, load=None) -> ingest.IngestResult:
        """Index a ``sources`` frame; *load* makes the texts of those that are stale."""
        return ingest.ingest(
            sources,
            self.store,
            self.config,
            model=self.model,
            models=self.models,
            steps=self.steps,
            clock=self.clock,
            force=force,
            load=load,
        )

    def index_directory(self, folder: str | None = None, force: bool = False) -> ingest.IngestResult:
        found = files.read_documents(self.spark, folder or self.config.documents_dir)
        return self.index(found, force, self._loaded)

    def index_file(self, source_id: str, folder: str | None = None) -> ingest.IngestResult:
        found = files.get_document(self.spark, folder or self.config.documents_dir, source_id)
        return self.index(found, load=self._loaded)

    def _loaded(self, found: DataFrame) -> DataFrame:
        loaded = loaders.load_documents(found, join_records=True)
        # HTML keeps its markup: titles, headings and the HTML splitter need the tags
        return loaded.withColumn("text", F.coalesce("raw", "text")).drop("raw", "part", "content")

    def index_stream(self, sources: DataFrame, checkpoint: str):
        """Start indexing a streaming ``sources`` frame."""
        return stream.index_stream(sources, self, checkpoint)

    def rebuild(self) -> ingest.IngestResult:
        self.store.clear()
        return self.index_directory()

    def delete(self, source_ids: Iterable[str]) -> None:
        ids = self.spark.createDataFrame([(i,) for i in source_ids], "source_id string")
        self.store.remove_sources(ids)

    def clear(self) -> None:
        self.store.clear()

    # answering
    def _settings(self, **changes) -> SearchSettings:
        return SearchSettings(**{**self.config.search.__dict__, **changes})

    def questions(self, texts: Iterable[str]) -> DataFrame:
        rows = [(i, text) for i, text in enumerate(texts)]
        return self.spark.createDataFrame(rows, "qid bigint, text string")

    def index_terms(self) -> PostingIndex:
        """Postings of all chunks for hybrid search, to be passed to :meth:`answer`; write them after indexing."""
        terms = PostingIndex(self.spark, f"{self.config.data_dir}/terms", self.config.buckets)
        answering.index_terms(self.store.chunks.located(), terms)
        return terms

    def answer(self, questions: DataFrame, terms: PostingIndex | None = None, **changes) -> DataFrame:
        """Answers of a ``(qid, text)`` frame; *changes* override search settings."""
        if self.store.vectors.read().isEmpty():
            none = F.expr("cast(array() as array<struct<path:string,type:string,excerpt:string>>)")
            return questions.select(
                "qid",
                F.col("text").alias("question"),
                F.lit(A.NOTHING_INDEXED).alias("answer"),
                F.lit(None).cast("string").alias("raw_answer"),
                none.alias("sources"),
                F.lit(0).alias("num_sources"),
                F.lit(0).alias("num_documents_retrieved"),
                F.lit(float(self.clock.time())).alias("timestamp"),
            )
        return answering.answer_questions(
            questions,
            self.store.chunks.located(),
            self.store.vectors.located(),
            self.model,
            self._settings(**changes),
            self.chat,
            self.clock.time(),
            terms,
        )

    def ask(self, question: str, **changes) -> dict:
        """Answer one question as a dictionary."""
        return self.answer(self.questions([question]), **changes).first().asDict(recursive=True)

    def search(self, questions: DataFrame, k: int = 4) -> DataFrame:
        return answering.search_chunks(
            questions,
            self.store.chunks.read(),
            self.store.vectors.read(),
            self.model,
            k,
            self.config.search.metric,
        )

    # catalog
    def documents(self) -> DataFrame:
        return self.store.list_sources().select(
            F.col("location").alias("file_path"),
            F.coalesce("content_type", F.lit("text/plain")).alias("file_type"),
            F.col("chunk_count").alias("num_chunks"),
            F.coalesce("size_bytes", F.lit(0)).alias("file_size"),
        )

    def listing(self) -> DataFrame:
        return ST.display_listing(self.store.list_sources())

    def stats(self) -> DataFrame:
        return ST.index_stats(self.store.list_sources())

    def summaries(self, k: int = 5) -> DataFrame:
        return ST.largest_sources(self.store.list_sources(), k)

    def generated_summaries(self, k: int = 5) -> DataFrame:
        """Model-written summaries of the k sources with the most chunks, from their opening."""
        top = (
            self.store.list_sources()
            .orderBy(F.desc("chunk_count"), "source_id")
            .limit(k)
            .select("source_id", "location", "content_type", "chunk_count")
        )
        opening = (
            self.store.chunks.read()
            .where(F.col("chunk_order") == 0)
            .join(F.broadcast(top), "source_id")
            .select(
                F.col("source_id").alias("qid"),
                F.concat(
                    F.lit("Give a one or two sentence summary of this document: "),
                    A.summary_input(F.col("content")),
                ).alias("text"),
            )
        )
        settings = self._settings(k=1, prompt_id="summary")
        answers = answering.answer_questions(
            opening,
            self.store.chunks.read(),
            self.store.vectors.read(),
            self.model,
            settings,
            self.chat,
            self.clock.time(),
        )
        return top.join(answers, top["source_id"] == answers["qid"]).select(
            F.col("location").alias("file_path"),
            F.coalesce("content_type", F.lit("text/plain")).alias("file_type"),
            F.col("answer").alias("summary"),
            F.col("chunk_count").alias("num_chunks"),
        )
