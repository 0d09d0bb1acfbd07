"""The tool surface: ten named operations with plain arguments and JSON-ready results.

It opens no port. A web or tool server can forward its requests to :meth:`Tools.call`.
"""

from __future__ import annotations

import hmac
from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docquarry.engine import Engine
from docquarry.errors import QuarryError


def bearer_allowed(headers: Mapping[str, str], key: str | None) -> bool:
    """Whether the ``Authorization: Bearer`` header carries *key*; without a key all pass."""
    if not key:
        return True
    given = {name.lower(): value for name, value in headers.items()}.get("authorization", "")
    return hmac.compare_digest(given.encode(), f"Bearer {key}".encode())


def rows(df: DataFrame) -> list[dict]:
    """Rows of a small result (top-k, one source, statistics) as dictionaries."""
    return [row.asDict(recursive=True) for row in df.collect()]


class Tools:
    def __init__(self, engine: Engine) -> None:
        self.engine = engine

    def names(self) -> list[str]:
        return sorted(n.removeprefix("tool_") for n in dir(self) if n.startswith("tool_"))

    def call(self, name: str, arguments: Mapping | None = None):
        tool = getattr(self, f"tool_{name}", None)
        if tool is None:
            raise QuarryError("unknown tool", name=name)
        return tool(**(arguments or {}))

    def tool_query(self, question: str, top_k: int = 4) -> dict:
        return self.engine.ask(question, k=top_k)

    def tool_chat(self, question: str, session_id: str = "") -> dict:
        """Plain question answering; sessions carry no memory."""
        return self.engine.ask(question, k=4)

    def tool_search(self, query: str, top_k: int = 4) -> list[dict]:
        found = self.engine.search(self.engine.questions([query]), top_k).orderBy("rank")
        return rows(found.select(F.col("content").alias("page_content"), "metadata"))

    def tool_index(self, path: str | None = None, folder: str | None = None) -> dict:
        engine = self.engine
        result = engine.index_file(path, folder) if path else engine.index_directory(folder)
        return {"success": result.success, **result.counts}

    def tool_rebuild(self) -> dict:
        result = self.engine.rebuild()
        return {"success": result.success, **result.counts}

    def tool_index_stats(self) -> dict:
        return rows(self.engine.stats())[0]

    def tool_documents(self, after: str | None = None, limit: int = 1000) -> list[dict]:
        """A page of the listing in path order; ``after`` is the last path of the page before."""
        listed = self.engine.documents()
        if after is not None:
            listed = listed.where(F.col("file_path") > after)
        return rows(listed.orderBy("file_path").limit(limit))

    def tool_get_document(self, path: str) -> dict | None:
        found = rows(self.engine.documents().where(F.col("file_path") == path).limit(1))
        return found[0] if found else None

    def tool_delete_document(self, path: str) -> bool:
        """Delete by source id or location."""
        held = self.engine.store.sources.read()
        match = held.where((F.col("source_id") == path) | (F.col("location") == path))
        self.engine.store.remove_sources(match.select("source_id"))
        return True

    def tool_summaries(self, k: int = 5) -> list[dict]:
        return rows(self.engine.summaries(k))

    def tool_clear(self, path: str | None = None, all: bool = False) -> bool:
        if all:
            self.engine.clear()
            return True
        return self.tool_delete_document(path) if path else False
