"""The engine: both collections, their searches and changes, and a request dispatcher."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions.dates import DateError, parse_date
from skein.functions.prepare import mail_text, memory_text
from skein.operators import lookup, search
from skein.operators.embedding import Embedder
from skein.plans.match import MEMORY, MESSAGES, Layout
from skein.plans.synonyms import Synonyms, default_synonyms
from skein.sources.rows import MEMORY_SCHEMA, MESSAGE_SCHEMA, from_rows
from skein.sources.store import SCHEMA_VERSION, Collection

VERSION = "0.2.0"


class Table:
    """What both collections offer."""

    def __init__(self, engine: SearchEngine, collection: Collection, layout: Layout, schema):
        self.engine, self.collection, self.layout, self.schema = engine, collection, layout, schema

    def index(self, rows: list[dict] | DataFrame) -> dict:
        df = rows if isinstance(rows, DataFrame) else from_rows(self.engine.spark, rows, self.schema)
        return self.collection.index(df)

    def remove(self, ids: list) -> dict:
        return self.collection.remove(ids)

    def clear(self) -> dict:
        return self.collection.clear()

    def sample(self, limit: int = 10) -> DataFrame:
        return lookup.newest(self.collection.docs(), limit)

    def _bounds(self, low: object, high: object, ignore_date: bool, strict: bool) -> tuple[int | None, int | None]:
        """Parsed bounds; keyword-only and list searches raise on bad dates, hybrid ones drop the bound."""
        if ignore_date:
            return None, None
        out = []
        for value in (low, high):
            try:
                out.append(parse_date(value))
            except DateError:
                if strict:
                    raise
                out.append(None)
        return out[0], out[1]

    def search(self, query: str, low: object = None, high: object = None, ignore_date: bool = False, limit: int = 50) -> DataFrame:
        query, embedder = query.strip(), self.engine.embedder
        version = self.collection.manifest()
        docs, vectors, index = self.collection.docs(version), self.collection.vectors(version), self.collection.index_of(version)
        if not query and self.layout is MEMORY:
            return search.browse(docs, *self._bounds(low, high, ignore_date, True), limit)
        hybrid = bool(query) and embedder is not None and not vectors.isEmpty()
        bounds = self._bounds(low, high, ignore_date, not hybrid)
        if not hybrid:
            return search.keyword_search(docs, query, self.layout, *bounds, limit, self.engine.synonyms, stems=True, index=index)
        vector = embedder.embed([query])[0].tolist()
        return search.hybrid_search(docs, vectors, query, vector, self.layout, *bounds, limit, self.engine.synonyms, stems=True, index=index, unique=True)


class Messages(Table):
    def stats(self) -> dict:
        return self.collection.stats()

    def optimize(self) -> dict:
        return self.collection.optimize()

    def filter_new(self, rows: list[dict]) -> dict:
        """Ids that are not indexed, in their order and with repetitions, and counts."""
        ids = [r["msgId"] for r in rows if isinstance(r.get("msgId"), str) and r["msgId"]]
        if not ids:
            return {"newMsgIds": [], "newCount": 0, "skippedCount": 0, "totalChecked": len(rows)}
        asked = self.engine.spark.createDataFrame(list(enumerate(ids)), "_pos long, msgId string")
        new = [r[0] for r in lookup.not_in(asked, self.collection.docs(), "msgId").orderBy("_pos").select("msgId").collect()]
        return {"newMsgIds": new, "newCount": len(new), "skippedCount": len(ids) - len(new), "totalChecked": len(rows)}

    def get(self, msg_id: str) -> dict | None:
        found = lookup.by_key(self.collection.docs(), "msgId", msg_id).first()
        return found.asDict() if found else None

    def find_by_header(self, account: str, header: str) -> list[str]:
        return [r[0] for r in lookup.by_header(self.collection.docs(), account, header).collect()]

    def by_date_range(self, low: object, high: object, limit: int = 1000) -> DataFrame:
        return lookup.by_date_range(self.collection.docs(), parse_date(low), parse_date(high), limit)


class Memory(Table):
    def stats(self) -> dict:
        s = self.collection.stats()
        return {"memoryDocs": s["docs"], "memoryVecDocs": s["vecDocs"], "memoryDbBytes": s["dbBytes"]}

    def read_around(self, at_ms: int, tolerance_ms: int = 600_000) -> DataFrame:
        return lookup.read_around(self.collection.docs(), at_ms, tolerance_ms)


class SearchEngine:
    """Opens both collections below a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, path: str, embedder: Embedder | None = None, synonyms: Synonyms | None = None):
        self.spark, self.embedder, self.synonyms, self.ready = spark, embedder, synonyms or default_synonyms(), False
        mail = lambda: mail_text(F.col("subject"), F.col("from_"), F.col("to_"), F.col("body"))
        memory = lambda: memory_text(F.col("role"), F.col("content"))
        self.messages = Messages(self, Collection(spark, path, "messages", MESSAGES, MESSAGE_SCHEMA, mail, embedder), MESSAGES, MESSAGE_SCHEMA)
        self.memory = Memory(self, Collection(spark, path, "memory", MEMORY, MEMORY_SCHEMA, memory, embedder), MEMORY, MEMORY_SCHEMA)

    @classmethod
    def open(cls, spark: SparkSession, path: str, embedder: Embedder | None = None) -> SearchEngine:
        return cls(spark, path, embedder)

    def info(self) -> dict:
        return {"version": VERSION, "schemaVersion": SCHEMA_VERSION, "hasEmbeddings": self.embedder is not None, "docs": self.messages.collection.manifest()["rows"], "memoryDocs": self.memory.collection.manifest()["rows"]}

    def init(self) -> dict:
        """What a client calls first; until then `handle` answers nothing but `hello`."""
        self.ready = True
        return self.info()

    def rebuild_start(self) -> dict:
        return {"emailTotal": self.messages.collection.rebuild_start(), "memoryTotal": self.memory.collection.rebuild_start()}

    def rebuild_batch(self, target: str = "email", last_rowid: int = 0, size: int = 500) -> dict:
        """Any target but `memory` is the mails; the answer repeats the name."""
        collection = (self.memory if target == "memory" else self.messages).collection
        return {"target": target, **collection.rebuild_batch(last_rowid, size)}

    def handle(self, request: dict) -> dict:
        """Answers {id, method, params} with {id, result} or {id, error}."""
        p = request.get("params") or {}
        rows = lambda df: [r.asDict() for r in df.collect()]  # noqa: E731  (bounded by the method's limit)
        dated = lambda: {"low": p.get("from"), "high": p.get("to"), "ignore_date": bool(p.get("ignoreDate", False)), "limit": int(p.get("limit", 50))}
        methods = {
            "hello": self.info,
            "init": self.init,
            "search": lambda: rows(self.messages.search(p.get("q", ""), **dated())),
            "stats": self.messages.stats,
            "filterNewMessages": lambda: self.messages.filter_new(p.get("rows", [])),
            "getMessageByMsgId": lambda: self.messages.get(p["msgId"]),
            "findByHeaderMessageId": lambda: self.messages.find_by_header(p["accountId"], p["headerMessageId"]),
            "queryByDateRange": lambda: rows(self.messages.by_date_range(p.get("from"), p.get("to"), int(p.get("limit", 1000)))),
            "debugSample": lambda: rows(self.messages.sample()),
            "memorySearch": lambda: rows(self.memory.search(p.get("q", ""), **dated())),
            "memoryStats": self.memory.stats,
            "memoryDebugSample": lambda: rows(self.memory.sample()),
            "memoryRead": lambda: rows(self.memory.read_around(int(p.get("timestampMs") or 0), int(p.get("toleranceMs", 600_000)))),
            "indexBatch": lambda: self.messages.index(p.get("rows", [])),
            "removeBatch": lambda: self.messages.remove(p.get("ids", [])),
            "optimize": self.messages.optimize,
            "clear": self.messages.clear,
            "rebuildEmbeddingsStart": self.rebuild_start,
            "rebuildEmbeddingsBatch": lambda: self.rebuild_batch(p.get("target", "email"), int(p.get("lastRowid", 0)), int(p.get("batchSize", 500))),
            "memoryIndexBatch": lambda: self.memory.index(p.get("rows", [])),
            "memoryRemoveBatch": lambda: self.memory.remove(p.get("ids", [])),
            "memoryClear": self.memory.clear,
        }
        method = request.get("method")
        if method not in methods:
            return {"id": request.get("id"), "error": f"unknown method: {method}"}
        if not self.ready and method not in ("hello", "init"):
            return {"id": request.get("id"), "error": "not initialised: call init first"}
        try:
            return {"id": request.get("id"), "result": methods[method]()}
        except Exception as e:
            return {"id": request.get("id"), "error": str(e) or type(e).__name__}
