from __future__ import annotations

import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from docquarry import Engine, EngineConfig
from docquarry import cli
from docquarry.clock import FixedClock
from docquarry.config import ChunkSettings, SearchSettings
from docquarry.errors import PathOutsideRoot, QuarryError, SourceError
from docquarry.operators import answer as A
from docquarry.operators import embed as E
from docquarry.service import Tools, bearer_allowed
from docquarry.sources import files, loaders, tables
from docquarry.streaming.ingest import index_stream


def config(path, **more):
    return EngineConfig(
        str(path), embedding_dim=32, chunks=ChunkSettings(size=6, overlap=1), buckets=3, **more
    )


def sources(spark, rows):
    df = spark.createDataFrame(rows, "id string, text string")
    return tables.text_sources(df, F.col("id"), F.col("text"), F.lit("text/plain"))


A1 = [("a", "one two three four five six seven"), ("b", "alpha beta")]
B1 = [("c", "gamma delta epsilon zeta eta theta iota"), ("d", "last one")]


def state(engine):
    chunks = engine.store.chunks.read().select("doc_id", "source_id", "content", "chunk_hash").collect()
    vectors = engine.store.vectors.read().select("doc_id", "embedding").collect()
    return sorted(map(tuple, chunks)), sorted((r[0], tuple(r[1])) for r in vectors)


def test_batches_add_up(spark, tmp_path):
    parts = Engine(spark, config(tmp_path / "parts"), clock=FixedClock(1.0))
    assert parts.index(sources(spark, A1)).counts["vectors_stored"] == 3
    parts.index(sources(spark, B1))
    whole = Engine(spark, config(tmp_path / "whole"), clock=FixedClock(1.0))
    whole.index(sources(spark, A1 + B1))
    assert state(parts) == state(whole)


def test_hybrid_answers_from_stored_postings(spark, tmp_path):
    engine = Engine(spark, config(tmp_path / "s"), clock=FixedClock(1.0))
    engine.index(sources(spark, A1 + B1))
    terms = engine.index_terms()
    asked = engine.questions(["gamma delta", "two three", "last one", "one filter:source_id=a", "nothing known"])

    def found(**more):
        rows = engine.answer(asked, hybrid=True, k=2, **more).collect()
        return sorted((r["qid"], r["answer"], str(r["sources"])) for r in rows)

    assert found(terms=terms) == found()
    # written again, the index holds new chunks and no old ones
    engine.index(sources(spark, [("e", "gamma gamma delta delta")]))
    assert found(terms=engine.index_terms()) == found()
    assert terms.version() == 1


def test_changed_source_reuses_equal_chunks(spark, tmp_path):
    engine = Engine(spark, config(tmp_path / "s"))
    engine.index(sources(spark, A1))
    again = engine.index(sources(spark, A1))
    assert again.success and again.counts["documents_loaded"] == 0
    longer = [("a", "one two three four five six seven eight nine ten eleven"), A1[1]]
    third = engine.index(sources(spark, longer)).counts
    assert third == {
        "documents_loaded": 1,
        "chunks_stored": 2,
        "embeddings_reused": 1,
        "vectors_stored": 2,
        "errors": 0,
    }
    shorter = engine.index(sources(spark, [("a", "one")])).counts
    assert shorter["chunks_stored"] == 1
    assert engine.store.vectors.read().count() == 2 == engine.store.count_documents()
    other = Engine(spark, EngineConfig(str(tmp_path / "s"), embedding_dim=32, chunks=ChunkSettings(size=5, overlap=1), buckets=3))
    assert other.index(sources(spark, [("a", "one"), A1[1]])).counts["documents_loaded"] == 2


def test_errors_are_rows(spark, tmp_path):
    engine = Engine(spark, config(tmp_path / "s"))
    rows = sources(spark, [("a", "fine text"), ("b", None)])
    result = engine.index(rows)
    assert not result.success
    assert [(r["stage"], r["source_id"]) for r in result.errors.collect()] == [("loading", "b")]
    assert engine.store.count_documents() == 1


def test_answers(spark, tmp_path):
    engine = Engine(spark, config(tmp_path / "s"), clock=FixedClock(7.0))
    assert engine.ask("anything")["answer"] == A.NOTHING_INDEXED
    engine.index(sources(spark, A1 + B1))
    # equal texts have equal digests, so the passage itself is the nearest
    found = engine.ask("alpha beta", k=2)
    assert found["sources"][0]["path"] == "b" and found["num_documents_retrieved"] == 2
    assert found["timestamp"] == 7.0
    filtered = engine.ask("last one filter:source_id=d", k=1)
    assert [s["path"] for s in filtered["sources"]] == ["d"]
    assert engine.ask("last one filter:nothing=1")["answer"] == A.NOTHING_FOUND
    hybrid = engine.answer(engine.questions(["gamma delta"]), hybrid=True, rerank=True, k=1).first()
    assert hybrid["sources"][0]["path"] == "c"
    asked = []

    def chat(batches):
        return [f"from [b] {len(m)}" for m in batches]

    talking = Engine(spark, config(tmp_path / "s"), chat=chat)
    assert talking.ask("alpha beta", k=1)["answer"] == "from [b] 1\n\nSources:\n1. b"
    assert not asked
    assert {r["file_path"] for r in engine.generated_summaries(2).collect()} == {"a", "c"}


def test_golden_facts(spark, tmp_path):
    facts = {"France": "Paris", "Spain": "Madrid", "Italy": "Rome", "Norway": "Oslo", "Japan": "Tokyo"}
    rows = [(k, f"The capital of {k} is {v}.") for k, v in facts.items()]
    engine = Engine(spark, config(tmp_path / "s", search=SearchSettings(hybrid=True, rerank=True, k=3)))
    engine.index(sources(spark, rows))
    asked = engine.questions([f"What is the capital of {k}?" for k in facts])
    answers = {r["question"]: r for r in engine.answer(asked).collect()}
    hits = [
        any(v in s["excerpt"] for s in answers[f"What is the capital of {k}?"]["sources"])
        for k, v in facts.items()
    ]
    assert sum(hits) / len(hits) >= 0.8


def _zip(**members):
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as archive:
        for name, text in members.items():
            archive.writestr(name.replace("__", "/") + ".xml", text)
    return buffer.getvalue()


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "docs with space"
    (root / "sub").mkdir(parents=True)
    (root / "a.txt").write_text("plain text", encoding="utf-8")
    (root / "b.md").write_text("# Head\nbody\n## Deep\nmore", encoding="utf-8")
    (root / "sub" / "c.html").write_text("<title>T</title><h1>H</h1><p>x &amp; y</p>", encoding="utf-8")
    (root / "d.csv").write_text('name,age\nAnn,3\n"Bo, B",4\n', encoding="utf-8")
    (root / "e.txt").write_bytes(b"\xff\xfe\x00bad")
    (root / "f.rtf").write_bytes(b"{\\rtf1}")
    (root / ".hidden.txt").write_text("no")
    (root / "noext").write_text("sniffed")
    (root / "bin").write_bytes(b"\xff\x00")
    (root / "skip.png").write_bytes(b"\x89PNG")
    w = "http://w"
    (root / "g.docx").write_bytes(
        _zip(word__document=f"<d xmlns:w='{w}'><w:p><w:r><w:t>Hello</w:t></w:r></w:p><w:p><w:t>World</w:t></w:p></d>")
    )
    (root / "h.pptx").write_bytes(
        _zip(
            ppt__slides__slide2="<s xmlns:a='x'><a:p><a:t>second</a:t></a:p></s>",
            ppt__slides__slide1="<s xmlns:a='x'><a:p><a:t>first</a:t></a:p></s>",
        )
    )
    (root / "i.xlsx").write_bytes(
        _zip(
            xl__sharedStrings="<sst><si><t>shared</t></si></sst>",
            xl__worksheets__sheet1=(
                "<w><sheetData><row><c t='s'><v>0</v></c><c><v>2.5</v></c></row>"
                "<row><c/></row><row><c t='inlineStr'><is><t>in</t></is></c></row></sheetData></w>"
            ),
        )
    )
    return str(root)


def test_scan(spark, tree):
    names = [r["source_id"] for r in files.list_documents(spark, tree).collect()]
    assert names == ["a.txt", "b.md", "d.csv", "e.txt", "f.rtf", "g.docx", "h.pptx", "i.xlsx", "sub/c.html"]
    some = files.list_documents(spark, tree, [".TXT", ".html"], ["sub/*"]).collect()
    assert [r["source_id"] for r in some] == ["a.txt", "e.txt"]
    rows = {r["source_id"]: r for r in files.read_documents(spark, tree).collect()}
    assert set(rows) == {*names, "noext"} and rows["noext"]["content_type"] == "text/plain"
    assert rows["e.txt"]["text"] is None and rows["a.txt"]["text"] == "plain text"
    assert rows["a.txt"]["metadata"]["file_extension"] == ".txt" and rows["a.txt"]["size_bytes"] == 10
    assert files.get_document(spark, tree, "sub/c.html").count() == 1
    assert files.get_document(spark, tree, "missing.txt").count() == 0
    assert files.document_exists(spark, tree, "a.txt") and not files.document_exists(spark, tree, "zz")
    assert files.get_document(spark, tree, "sub").count() == 0 and not files.document_exists(spark, tree, "sub")
    wanted = spark.createDataFrame([("a.txt",), ("zz",)], "source_id string")
    assert files.get_documents(spark, tree, wanted).count() == 1
    assert files.document_metadata(spark, tree).where("source_id = 'b.md'").first()["size_bytes"] == 24
    for bad in ("../x", "/etc/passwd", "sub/../../x", "."):
        with pytest.raises(PathOutsideRoot):
            files.resolve(tree, bad)
    with pytest.raises(SourceError):
        files.scan(spark, tree + "/none")


def test_loaders(spark, tree):
    loaded = loaders.load_documents(files.read_documents(spark, tree))
    rows = {(r["source_id"], r["part"]): r for r in loaded.collect()}
    text = {k: r["text"] for k, r in rows.items()}
    assert text[("d.csv", 0)] == "name: Ann\nage: 3" and text[("d.csv", 1)] == "name: Bo, B\nage: 4"
    assert text[("sub/c.html", 0)] == "T\nH\nx & y"
    assert text[("g.docx", 0)] == "Hello\n\nWorld"
    assert text[("h.pptx", 0)] == "first\n\nsecond"
    assert text[("i.xlsx", 0)] == "shared 2.5\nin"
    errors = {k[0] for k, r in rows.items() if r["load_error"]}
    assert errors == {"e.txt", "f.rtf"}


def test_directory_and_tools(spark, tree, tmp_path):
    engine = Engine(spark, config(tmp_path / "s", documents_dir=tree), clock=FixedClock(3.0))
    tools = Tools(engine)
    assert set(tools.names()) >= {
        "query", "search", "index", "rebuild", "index_stats", "documents", "get_document",
        "delete_document", "summaries", "clear",
    }
    result = tools.call("index")
    assert not result["success"] and result["errors"] == 2 and result["documents_loaded"] == 8
    assert tools.call("index_stats")["document_count"] == 8
    page = engine.store.chunks.read().where("source_id = 'sub/c.html'").first()
    assert page["title"] == "T"
    md = engine.store.source_chunks("b.md").collect()
    # the following heading may be the nearest one
    assert [r["heading_path"] for r in md] == ["Head > Deep", "Head > Deep"]
    assert tools.call("search", {"query": "plain text", "top_k": 1})[0]["page_content"] == "plain text"
    assert tools.call("query", {"question": "plain text", "top_k": 1})["num_documents_retrieved"] == 1
    assert tools.call("chat", {"question": "plain text", "session_id": "x"})["num_sources"] >= 1
    path = next(d["file_path"] for d in tools.call("documents") if d["file_path"].endswith("a.txt"))
    assert tools.call("get_document", {"path": path})["num_chunks"] == 1
    assert tools.call("delete_document", {"path": path}) and tools.call("get_document", {"path": path}) is None
    assert len(tools.call("summaries", {"k": 2})) == 2
    assert not tools.call("clear") and tools.call("clear", {"all": True})
    assert tools.call("documents") == []
    with pytest.raises(QuarryError):
        tools.call("nothing")
    assert bearer_allowed({"Authorization": "Bearer k"}, "k") and bearer_allowed({}, None)
    assert not bearer_allowed({"authorization": "Bearer x"}, "k") and not bearer_allowed({}, "k")


def test_command_line(spark, tree, tmp_path):
    def call(*argv):
        out = io.StringIO()
        args = cli.parser().parse_args(["--json", "--data-dir", str(tmp_path / "s"), *argv])
        code = cli.run(args, spark, out)
        return code, [json.loads(line) for line in out.getvalue().splitlines()]

    code, lines = call("index", tree, "--file", "b.md")
    assert code == 0 and lines[0]["documents_loaded"] == 1
    assert call("list")[1][0]["chunks"] == 2
    assert call("query", "body", "-k", "1")[1][0]["num_documents_retrieved"] == 1
    assert [p["prompt_id"] for p in call("prompts")[1]] == A.prompt_ids()
    assert len(call("eval")[1]) == 5
    assert call("summarize")[1][0]["num_chunks"] == 2
    assert call("clear", "b.md")[0] == 0 and call("list")[1] == []
    out = io.StringIO()
    cli.emit([{"a": 1}], False, out)
    assert out.getvalue() == "a: 1\n\n"


def test_stream_keeps_the_last_version(spark, tmp_path):
    engine = Engine(spark, config(tmp_path / "s"))
    arriving = tmp_path / "in"
    for i, text in enumerate(["first version", "second version here"]):
        df = sources(spark, [("a", text), (f"x{i}", "other")]).withColumn("last_modified", F.lit(float(i + 1)))
        df.write.mode("append").parquet(str(arriving))
    schema = spark.read.parquet(str(arriving)).schema
    stream = spark.readStream.schema(schema).parquet(str(arriving))
    for _ in range(2):
        index_stream(stream, engine, str(tmp_path / "check")).awaitTermination()
    rows = {r["source_id"]: r["content"] for r in engine.store.chunks.read().collect()}
    assert rows == {"a": "second version here", "x0": "other", "x1": "other"}


def test_other_model(spark, tmp_path):
    model = E.Model("lengths", 2, remote=lambda texts: [[float(len(t)), 1.0] for t in texts])
    engine = Engine(spark, config(tmp_path / "s"), model=model)
    engine.index(sources(spark, A1))
    found = engine.search(engine.questions(["x" * 26]), 1).first()
    assert found["content"] == "one two three four five six"


def test_each_path_has_its_model(spark, tmp_path):
    mapped = config(tmp_path / "s", model_map={"*.md": "md5"})
    engine = Engine(spark, mapped)
    rows = sources(spark, [("x.md", "same words"), ("x.txt", "same words")])
    assert engine.index(rows).counts["vectors_stored"] == 2
    assert engine.index(rows).counts["documents_loaded"] == 0
    held = {r["source_id"]: r for r in engine.store.vectors.read().collect()}
    assert held["x.md"]["model"] == "md5:1" and held["x.txt"]["model"] == "sha256:1"
    assert held["x.md"]["embedding"] != held["x.txt"]["embedding"]
    # another default model concerns the other path only
    again = Engine(spark, config(tmp_path / "s", model_map={"*.md": "md5"}, embedding_model="codepoints"))
    counts = again.index(rows).counts
    assert (counts["documents_loaded"], counts["embeddings_reused"]) == (1, 0)


def test_nothing_is_loaded_twice_and_no_scratch_stays(spark, tmp_path):
    from pathlib import Path

    from docquarry.session import shared_dir

    engine = Engine(spark, config(tmp_path / "s"))
    calls = []

    def load(df):
        calls.append(1)
        return df

    before = set(Path(shared_dir(spark)).glob("*"))
    rows = sources(spark, A1)
    engine.index(rows, load=load)
    engine.index(rows, load=load)
    assert len(calls) == 1
    assert set(Path(shared_dir(spark)).glob("step-*")) <= before


def test_answers_read_the_buckets_of_their_chunks(spark, tmp_path):
    from docquarry.plans import answering

    engine = Engine(spark, config(tmp_path / "s"))
    engine.index(sources(spark, A1 + B1))
    found = answering.retrieve(
        answering.parse_questions(engine.questions(["alpha beta"])),
        engine.store.chunks.located(),
        engine.store.vectors.located(),
        engine.model,
        SearchSettings(k=1),
    )
    assert "dynamicpruning" in found._jdf.queryExecution().executedPlan().toString()
    assert [r["source_id"] for r in found.collect()] == ["b"]


def test_filters_come_before_the_search(spark, tmp_path):
    rows = [(f"n{i}", f"alpha {i}") for i in range(20)] + [("x1", "zeta"), ("x2", "theta")]
    engine = Engine(spark, config(tmp_path / "s"))
    engine.index(sources(spark, rows))
    asked = ["alpha 3 filter:source_id=x", "alpha 4"]
    for hybrid in (False, True):
        answers = engine.answer(engine.questions(asked), k=2, hybrid=hybrid).collect()
        paths = {r["qid"]: sorted(s["path"] for s in r["sources"]) for r in answers}
        assert hybrid or paths[0] == ["x1", "x2"]
        assert set(paths[0]) <= {"x1", "x2"} and len(paths[1]) == 2


def test_failed_embeddings_are_completed_by_the_next_run(spark, tmp_path):
    from docquarry.errors import ServiceError
    from docquarry.operators.embed import Model, Retry

    asked = str(tmp_path / "asked")
    down = spark.createDataFrame([("a", "alpha text"), ("b", "broken text"), ("c", "   ")], "source_id string, text string")
    sources = down.selectExpr(
        "source_id", "source_id location", "'text/plain' content_type", "text", "sha2(text, 256) content_hash",
        "length(text) size_bytes", "100.0D last_modified",
    )

    def model(fails):
        def remote(texts):
            with open(asked, "a") as log:
                log.writelines(t + "\n" for t in texts)
            if any(fails in t for t in texts):
                raise ServiceError("down")
            return [[float(len(t)), 0.0] for t in texts]

        return Model(name="m", dim=2, remote=remote, retry=Retry(attempts=1))

    config = EngineConfig(str(tmp_path / "store"), embedding_model="m", embedding_dim=2, buckets=2, embedding_attempts=3)
    one = lambda fails: Engine(spark, config, model=model(fails))
    first = one("broken").index(sources.repartition(3, "source_id"))
    held = lambda e: {r.doc_id.split("#")[0]: r.ordinal for r in e.store.vectors.read().collect()}
    assert first.counts["errors"] >= 1 and "b" not in held(one(""))
    again = one("broken").index(sources)
    assert again.counts["documents_loaded"] == 0 and again.counts["errors"] == 1
    assert [r.attempts for r in one("").store.unfinished.read().collect() if r.source_id == "b"] == [2]
    with open(asked, "w"):
        pass
    done = one("nothing").index(sources.where("source_id = 'a'"))  # its source need not come again
    assert done.counts["vectors_stored"] >= 1 and "broken text" in open(asked).read()
    assert {"a", "b"} <= set(held(one(""))) and sorted(held(one("")).values()) == list(range(len(held(one("")))))
    assert one("").store.unfinished.read().count() == 0
    with open(asked, "w"):
        pass
    assert one("text").index(sources).counts["errors"] == 0 and open(asked).read() == ""


def test_an_older_version_does_not_replace_a_newer_one(spark, tmp_path):
    def version(time, text):
        return spark.createDataFrame([("s", "s", "text/plain", text, text, 1, time)],
                                     "source_id string, location string, content_type string, text string, content_hash string, size_bytes long, last_modified double")

    engine = Engine(spark, EngineConfig(str(tmp_path / "store"), buckets=2))
    stored = lambda: engine.store.chunks.read().first().content
    engine.index(version(200.0, "new version"))
    assert engine.index(version(100.0, "old version")).counts["documents_loaded"] == 0 and stored() == "new version"
    engine.index(version(None, "time unknown"))
    assert stored() == "time unknown"
    engine.index(version(300.0, "newest"))
    engine.index(version(100.0, "old by force"), force=True)
    assert stored() == "old by force"
