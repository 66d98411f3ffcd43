"""Versioned Parquet collections: folders of added rows behind numbered manifests."""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skein.operators.embedding import Embedder, embed
from skein.operators.lookup import keyset_batch
from skein.operators.postings import build_postings, collection_size, postings_schema, sorted_by_term
from skein.operators.search import Index
from skein.plans.match import Layout
from skein.sources.files import Folder

SCHEMA_VERSION = 2
VECTORS = T.StructType([T.StructField("rowid", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType()))])
GONE = T.StructType([T.StructField("rowid", T.LongType())])
#: Seconds that a folder is kept after the last manifest that names it, for readers of older versions.
KEEP_SECONDS = 3600


class Conflict(RuntimeError):
    """Another writer published the next version first; its change stands, this one left nothing."""


class Collection:
    """One collection of texts, postings and vectors.

    A manifest names the folders that make up a version; they are never
    changed. A batch adds folders of its own (texts sorted by date, postings by
    term, vectors), a removal adds a list of row ids, and `optimize` brings all
    together in new folders. A version is published by creating the manifest of
    the next number, which fails if another writer did so first: no lock can be
    left behind. Readers keep the version that they opened; folders that no
    manifest names any more are deleted KEEP_SECONDS later.

    A manifest also has the numbers of rows and tokens, so that a search counts
    nothing. A collection with vectors of other dimensions, or of an unknown
    version, is refused.
    """

    def __init__(self, spark: SparkSession, root: str, name: str, layout: Layout, schema: T.StructType, embed_text, embedder: Embedder | None = None, stems: bool = True):
        self.spark, self.layout, self.embedder, self.embed_text, self.stems = spark, layout, embedder, embed_text, stems
        self.schema = T.StructType([T.StructField("rowid", T.LongType()), *schema.fields])
        self.folder = Folder(spark, f"{root}/{name}")
        if not self._numbers():
            self.folder.create("manifest-0000000001.json", json.dumps(self._blank()))
        m = self.manifest()
        if m["schema_version"] != SCHEMA_VERSION:
            raise ValueError(f"{self.folder.path} has schema version {m['schema_version']}")
        self.stems = m["stems"]
        if embedder and m["dims"] not in (None, embedder.dims):
            raise ValueError(f"{self.folder.path} has vectors of {m['dims']} numbers, the embedder makes {embedder.dims}")

    def _blank(self) -> dict:
        return {"schema_version": SCHEMA_VERSION, "number": 1, "next_rowid": 1, "distance": "cosine", "stems": self.stems, "dims": self.embedder.dims if self.embedder else None, "rows": 0, "tokens": 0, "docs": [], "postings": [], "vectors": [], "gone": [], "retired": {}}

    def _numbers(self) -> list[int]:
        return [int(n[9:-5]) for n in self.folder.names() if n.startswith("manifest-") and n.endswith(".json")]

    def manifest(self) -> dict:
        return json.loads(self.folder.read(f"manifest-{max(self._numbers()):010}.json"))

    def _publish(self, old: dict, **changes) -> None:
        new = {**old, **changes, "number": old["number"] + 1}
        if self.embedder:
            new["dims"] = self.embedder.dims
        named = {p for part in ("docs", "postings", "vectors", "gone") for p in self._folders(new, part)}
        before = {p for part in ("docs", "postings", "vectors", "gone") for p in self._folders(old, part)}
        new["retired"] = {**old["retired"], **dict.fromkeys(sorted(before - named), time.time())}
        if not self.folder.create(f"manifest-{new['number']:010}.json", json.dumps(new)):
            raise Conflict(f"another writer changed {self.folder.path}")
        for n in self._numbers():
            if n < new["number"] - 20:
                self.folder.delete(f"manifest-{n:010}.json")

    @staticmethod
    def _folders(m: dict, part: str) -> list[str]:
        return [p["folder"] for p in m[part]] if part == "vectors" else m[part]

    def _write(self, df: DataFrame, part: str) -> str:
        name = f"{part}-{uuid.uuid4().hex}"
        df.write.parquet(self.folder.url(name))
        return name

    def _read(self, names: list[str], schema: T.StructType) -> DataFrame:
        if not names:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[self.folder.url(n) for n in names])

    def _left(self, df: DataFrame, m: dict) -> DataFrame:
        return df.join(self._read(m["gone"], GONE), "rowid", "left_anti") if m["gone"] else df

    def docs(self, m: dict | None = None) -> DataFrame:
        m = m or self.manifest()
        return self._left(self._read(m["docs"], self.schema), m).select(*self.schema.names)

    def vectors(self, m: dict | None = None) -> DataFrame:
        """The vectors; of a row embedded anew those of the later batch."""
        m = m or self.manifest()
        parts = [self._read([p["folder"]], VECTORS).where(~F.lit(False) if not p["without"] else ~self._in(p["without"])) for p in m["vectors"] if p["without"]]
        plain = [p["folder"] for p in m["vectors"] if not p["without"]]
        whole = self._read(plain, VECTORS)
        for p in parts:
            whole = whole.unionByName(p)
        return self._left(whole, m).select(*VECTORS.names)

    @staticmethod
    def _in(ranges: list[list[int]]):
        found = F.lit(False)
        for low, high in ranges:
            found = found | F.col("rowid").between(low, high)
        return found

    def index_of(self, m: dict | None = None) -> Index:
        """The postings (of stems, unless the collection was made without) with the numbers of rows and tokens."""
        m = m or self.manifest()
        return Index(self._left(self._read(m["postings"], postings_schema()), m).select(*postings_schema().names), (m["rows"], m["tokens"]), self.stems)

    def index(self, rows: DataFrame) -> dict:
        """Adds rows with new keys; of several with one key the first (`_pos`) counts; existing rows are never changed.

        Only the new rows are written, with their postings and vectors. Row ids
        grow and are never used again. A text on which the model fails stays
        without a vector. The counts are those of the batch.
        """
        key, m = self.layout.key, self.manifest()
        keyed = rows.where(F.col(key).isNotNull() & (F.col(key) != ""))
        keyed = keyed if "_pos" in keyed.columns else keyed.withColumn("_pos", F.monotonically_increasing_id())
        rest = [c for c in keyed.columns if c not in (key, "_pos")]
        first = keyed.groupBy(key).agg(F.min("_pos").alias("_pos"), F.min_by(F.struct(*rest), "_pos").alias("_r")).select(key, "_pos", "_r.*")
        new = first.join(self.docs(m).select(key), key, "left_anti")
        start = m["next_rowid"]
        # Numbered by partition counts, so that no task holds all rows.
        placed = new.repartitionByRange("_pos").sortWithinPartitions("_pos").withColumn("_part", F.spark_partition_id()).persist()
        sizes = dict(placed.groupBy("_part").count().collect())
        before, total = {}, 0
        for part in sorted(sizes):
            before[part] = total
            total += sizes[part]
        received = keyed.count()
        if total:
            offset = F.create_map(*[x for k, v in before.items() for x in (F.lit(k), F.lit(v))])[F.col("_part")]
            numbered = placed.withColumn("rowid", F.lit(start) + offset + F.row_number().over(Window.partitionBy("_part").orderBy("_pos")) - 1)
            added = numbered.select(*[F.col(f.name).cast(f.dataType) for f in self.schema.fields])
            docs = self._write(added.sortWithinPartitions("dateMs", "rowid"), "docs")
            written = self._read([docs], self.schema)
            _, tokens = collection_size(written, self.layout)
            postings = self._write(sorted_by_term(build_postings(written, self.layout, self.stems), max(1, total // 100_000)), "postings")
            vectors = m["vectors"]
            if self.embedder:
                made = self._write(embed(written.select("rowid", self.embed_text().alias("text")), "rowid", "text", self.embedder, skip_failures=True), "vectors")
                vectors = [*vectors, {"folder": made, "low": start, "high": start + total - 1, "without": []}]
            self._publish(m, docs=[*m["docs"], docs], postings=[*m["postings"], postings], vectors=vectors, next_rowid=start + total, rows=m["rows"] + total, tokens=m["tokens"] + tokens)
        placed.unpersist()
        return {"ok": True, "count": total, "skippedDuplicates": received - total}

    def remove(self, ids: list) -> dict:
        """Removes the rows of the given keys; anything but non-empty texts is ignored, a repeated key counts once."""
        wanted = sorted({x for x in ids if isinstance(x, str) and x})
        if not wanted:
            return {"ok": True, "count": 0}
        m = self.manifest()
        keys = self.spark.createDataFrame([(x,) for x in wanted], f"{self.layout.key} string")
        gone = self.docs(m).join(keys, self.layout.key, "left_semi")
        count, tokens = collection_size(gone, self.layout)
        if count:
            name = self._write(gone.select("rowid"), "gone")
            self._publish(m, gone=[*m["gone"], name], rows=m["rows"] - count, tokens=m["tokens"] - tokens)
        return {"ok": True, "count": count}

    def clear(self) -> dict:
        self._publish(self.manifest(), docs=[], postings=[], vectors=[], gone=[], next_rowid=1, rows=0, tokens=0)
        return {"ok": True}

    def optimize(self, rows_per_file: int = 1_000_000, keep_seconds: float = KEEP_SECONDS) -> dict:
        """Brings all folders together: texts range-partitioned by date in files of even size, postings by term; removed rows go.

        Folders that no manifest has named for `keep_seconds` are deleted.
        """
        m = self.manifest()
        files = max(1, -(-m["rows"] // rows_per_file))
        changes: dict = {"gone": []}
        if m["docs"]:
            changes["docs"] = [self._write(self.docs(m).repartitionByRange(files, "dateMs", "rowid").sortWithinPartitions("dateMs", "rowid"), "docs")]
            changes["postings"] = [self._write(sorted_by_term(self.index_of(m).postings, max(1, m["rows"] // 100_000)), "postings")]
        if m["vectors"]:
            changes["vectors"] = [{"folder": self._write(self.vectors(m).coalesce(files), "vectors"), "low": 1, "high": m["next_rowid"] - 1, "without": []}]
        old = {name: at for name, at in m["retired"].items() if at > time.time() - keep_seconds}
        self._publish({**m, "retired": old}, **changes)
        live = self.manifest()
        named = {p for part in ("docs", "postings", "vectors", "gone") for p in self._folders(live, part)} | set(live["retired"])
        for name in set(m["retired"]) - named:
            self.folder.delete(name)
        return {"ok": True}

    def stats(self) -> dict:
        m = self.manifest()
        size = sum(self.folder.size(p) for part in ("docs", "postings", "vectors", "gone") for p in self._folders(m, part))
        return {"docs": m["rows"], "vecDocs": self.vectors(m).count(), "dbBytes": size}

    def rebuild_start(self) -> int:
        """Drops all vectors; the number of texts to embed. An error without an embedder."""
        if not self.embedder:
            raise ValueError("there is no embedder")
        m = self.manifest()
        self._publish(m, vectors=[])
        return m["rows"]

    def rebuild_batch(self, last_rowid: int = 0, size: int = 500) -> dict:
        """Embeds the next texts after `last_rowid`, replacing their vectors; done when fewer than `size` were left. Only the batch is written."""
        if not self.embedder:
            raise ValueError("there is no embedder")
        m = self.manifest()
        batch = keyset_batch(self.docs(m), last_rowid, size)
        found = batch.agg(F.count(F.lit(1)).alias("n"), F.max("rowid").alias("last")).first()
        if not found["n"]:
            return {"lastRowid": last_rowid, "processed": 0, "embedded": 0, "done": True}
        made = self._write(embed(batch.select("rowid", self.embed_text().alias("text")), "rowid", "text", self.embedder, skip_failures=True), "vectors")
        low, high = last_rowid + 1, found["last"]
        older = [{**p, "without": [*p["without"], [low, high]]} if p["low"] <= high and low <= p["high"] else p for p in m["vectors"]]
        self._publish(m, vectors=[*older, {"folder": made, "low": low, "high": high, "without": []}])
        embedded = self._read([made], VECTORS).count()
        return {"lastRowid": found["last"], "processed": found["n"], "embedded": embedded, "done": found["n"] < size}
