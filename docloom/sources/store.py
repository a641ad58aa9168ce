"""The index store: Parquet segments and a manifest for each generation.

A table is a list of segments, each with the number of the generation that wrote it, and of lists
of dead keys: rows of older segments with a dead key are gone. So a write adds what it changes and
the keys that it replaces, whatever the store's size, and compact() merges segments. Folders have
names of their own, so writers never touch each other's data. A generation is published by claiming
its number (the claim file is created exclusively), checking that no other was published since, and
renaming the finished manifest into place. A slower writer gets StaleWriter and changes nothing; a
crash leaves the old generation in place. Reads see one generation. Paths may be on any file system that
Spark can write.
"""

from __future__ import annotations

import hashlib
import json
import time
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom import schemas
from docloom.sources.workspace import DEAL_BYTES, SHUFFLES_DROPPED, dealt, largest_file, settings
from docloom.operators.fts import BlockIndex, StoredIndex, build_blocks, by_term, packed_shuffle, sorted_blocks, stored_blocks, token_counts

TABLES = {"documents": schemas.DOCUMENTS, "chunks": schemas.CHUNKS, "taxonomy": schemas.TAXONOMY, "meta": schemas.META, "postings": schemas.POSTINGS, "fts_stats": schemas.FTS_STATS, "failures": schemas.FAILED, "doomed": schemas.DOOMED}
#: The key by which rows are replaced; other tables are replaced whole.
KEYS = {"documents": "id", "chunks": "document_id", "postings": "document_id", "fts_stats": "document_id"}
SCHEMA_VERSION = 2
#: Seconds after which a claim that led to no generation counts as that of a dead writer.
CLAIM_SECONDS = 600
DAY = 86_400


class StaleWriter(RuntimeError):
    """Another writer committed first."""


class IndexStore:
    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm = spark._jvm
        self._root = self._jvm.org.apache.hadoop.fs.Path(self.path)
        self._fs = self._root.getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, *parts: str):
        return self._jvm.org.apache.hadoop.fs.Path("/".join((self.path, *parts)))

    def _commits(self) -> list[tuple[int, str, float]]:
        """Number, kind and time of the files in the commit folder."""
        if not self._fs.exists(self._at("_commits")):
            return []
        names = [(s.getPath().getName().split("."), s.getModificationTime() / 1000) for s in self._fs.listStatus(self._at("_commits"))]
        return [(int(n[0]), n[-1], t) for n, t in names if n[0].isdigit()]

    def generation(self) -> int:
        """The newest committed generation; 0 for a new store."""
        return max((n for n, kind, _ in self._commits() if kind == "json"), default=0)

    def _manifest(self) -> dict:
        n = self.generation()
        if not n:
            return {"generation": 0, "schema_version": SCHEMA_VERSION, "tables": {}}
        text = "".join(r.value for r in self.spark.read.text(f"{self.path}/_commits/{n:012d}.json").collect())  # one line
        found = json.loads(text)
        if found["schema_version"] > SCHEMA_VERSION:
            raise RuntimeError(f"the store has schema version {found['schema_version']}, newer than {SCHEMA_VERSION}")
        return found

    def read(self, table: str) -> DataFrame:
        found = self._manifest()["tables"].get(table, {"segments": [], "dead": []})
        if not found["segments"]:
            return self.spark.createDataFrame([], TABLES[table])
        segment = lambda folder: self.spark.read.schema(TABLES[table]).parquet(f"{self.path}/{folder}")
        newest = max((n for _, n in found["dead"]), default=0)
        parts = [segment(f) for f, n in found["segments"] if n >= newest]
        old = [segment(f).withColumn("_n", F.lit(n)) for f, n in found["segments"] if n < newest]
        if old:
            key = KEYS[table]
            dead = reduce(DataFrame.unionByName, [self.spark.read.schema("key long").parquet(f"{self.path}/{f}").withColumn("_m", F.lit(n)) for f, n in found["dead"]])
            rows = reduce(DataFrame.unionByName, old)
            parts.append(rows.join(dead, (F.col(key) == F.col("key")) & (F.col("_n") < F.col("_m")), "left_anti").drop("_n"))
        return reduce(DataFrame.unionByName, parts)

    @staticmethod
    def new_folder(table: str) -> str:
        return f"{table}/{uuid.uuid4().hex}"

    def stage(self, table: str, df: DataFrame, folder: str | None = None, in_order: bool = False) -> str:
        """Write rows of a table to a folder that no generation names yet, or add them to one of these. in_order: postings are sorted as they are stored."""
        folder = folder or self.new_folder(table)
        rows = df.select(*[F.col(f.name).cast(f.dataType.simpleString()) for f in TABLES[table].fields])
        with settings(self.spark, SHUFFLES_DROPPED):
            (by_term(rows) if table == "postings" and not in_order else rows).write.mode("append").option("compression", "zstd").parquet(f"{self.path}/{folder}")
        return folder

    def staged(self, table: str, folder: str) -> DataFrame:
        return self.spark.read.schema(TABLES[table]).parquet(f"{self.path}/{folder}")

    def publish(self, base: dict, replaced: dict[str, str] | None = None, added: dict[str, str] | None = None, dead: dict[str, DataFrame] | None = None) -> int:
        """The next generation after the manifest `base`: tables replaced by a staged folder or grown by one, and keys (column key) that are dead in older segments."""
        n = base["generation"] + 1
        tables = {t: {k: [list(x) for x in v] for k, v in parts.items()} for t, parts in base["tables"].items()}
        for table, folder in (replaced or {}).items():
            tables[table] = {"segments": [[folder, n]], "dead": []}
        written: dict[int, str] = {}
        for table, keys in (dead or {}).items():
            if id(keys) not in written:
                written[id(keys)] = f"dead/{uuid.uuid4().hex}"
                keys.select(F.col("key").cast("long")).distinct().write.parquet(f"{self.path}/{written[id(keys)]}")
            if tables.get(table, {}).get("segments"):
                tables[table]["dead"].append([written[id(keys)], n])
        for table, folder in (added or {}).items():
            tables.setdefault(table, {"segments": [], "dead": []})["segments"].append([folder, n])
        self._publish(n, {"generation": n, "schema_version": SCHEMA_VERSION, "tables": tables})
        return n

    def _publish(self, n: int, manifest: dict) -> None:
        self._fs.mkdirs(self._at("_commits"))
        claim = self._at("_commits", f"{n:012d}.claim")
        found = {k: t for m, k, t in self._commits() if m == n}
        if "json" in found or "claim" in found and time.time() - found["claim"] < CLAIM_SECONDS:
            raise StaleWriter(f"generation {n} exists")
        if "claim" in found:  # of a writer that died before it published
            self._fs.delete(claim, False)
        try:
            self._fs.create(claim, False).close()
        except Exception as e:
            raise StaleWriter(f"generation {n} exists") from e
        if self.generation() != n - 1:
            raise StaleWriter(f"generation {n} exists")
        part = self._at("_commits", f"{n:012d}.{uuid.uuid4().hex}.part")
        out = self._fs.create(part, False)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        if not self._fs.rename(part, self._at("_commits", f"{n:012d}.json")):
            raise StaleWriter(f"generation {n} exists")

    def commit(self, **tables: DataFrame) -> int:
        """Replace the given tables whole; the others stay as they are."""
        base = self._manifest()
        return self.publish(base, {t: self.stage(t, df) for t, df in tables.items()})

    # point and state reads

    def index_state(self) -> DataFrame:
        return self.read("documents").select("id", "modified", "content_hash")

    def document_ids(self) -> DataFrame:
        return self.read("documents").select("id")

    def meta(self, key: str) -> str | None:
        row = self.read("meta").where(F.col("key") == key).first()
        return row.value if row else None

    def index(self) -> StoredIndex:
        """The full-text index."""
        return StoredIndex(self.read("postings"), self.read("fts_stats"))

    def _blocks_of(self, manifest: dict) -> str:
        """The folder of the block index over the manifest's chunks, whatever else has changed."""
        state = json.dumps(manifest["tables"].get("chunks", {}), sort_keys=True)
        return f"blocks/{hashlib.sha256(state.encode()).hexdigest()[:32]}"

    def search_index(self) -> BlockIndex:
        """The full-text index in blocks, for many searches over one state: built by the first that asks after chunks have changed, and published by a rename."""
        manifest = self._manifest()
        folder = self._blocks_of(manifest)
        if not self._fs.exists(self._at(folder)):
            part = f"{folder}.{uuid.uuid4().hex}"
            build_blocks(self.read("chunks").select("chunk_id", "document_id", "text"), f"{self.path}/{part}")
            if self._fs.exists(self._at(folder)) or not self._fs.rename(self._at(part), self._at(folder)):
                self._fs.delete(self._at(part), True)  # another was faster
        return stored_blocks(self.spark, f"{self.path}/{folder}")

    # writes

    def write_meta(self, **values: str | None) -> int:
        new = self.spark.createDataFrame(list(values.items()), schemas.META)
        return self.commit(meta=self.read("meta").join(new, "key", "left_anti").unionByName(new))

    def upsert(self, documents: DataFrame, chunks: DataFrame) -> int:
        """Replace the given documents with all their chunks and index entries, together."""
        base = self._manifest()
        added = {"documents": self.stage("documents", documents), "chunks": self.stage("chunks", chunks)}
        held, path = self.staged("chunks", added["chunks"]), f"{self.path}/{added['chunks']}"
        if largest_file(self.spark, path) > 2 * DEAL_BYTES:  # smaller ones are dealt out as they lie
            held = dealt(held, path, "chunk_id")
        with packed_shuffle(self.spark):
            added["postings"] = self.stage("postings", sorted_blocks(held, rows=True), in_order=True)
        added["fts_stats"] = self.stage("fts_stats", token_counts(self.staged("chunks", added["chunks"]), self.staged("postings", added["postings"])))
        gone = self.staged("documents", added["documents"]).select(F.col("id").alias("key"))
        return self.publish(base, added=added, dead=dict.fromkeys(KEYS, gone))

    METADATA = ("title", "correspondent_id", "document_type_id", "tag_ids", "created", "modified", "indexed_at")

    def update_metadata(self, changes: DataFrame) -> int:
        """Replace the metadata columns of indexed documents, also by nulls; chunks, hash and page count stay. An unknown id is an error."""
        base, documents = self._manifest(), self.read("documents")
        if not changes.join(documents, "id", "left_anti").isEmpty():
            raise KeyError("metadata of a document that isn't indexed")
        folder = self.stage("documents", merged_metadata(documents.join(changes.select("id"), "id", "left_semi"), changes))
        return self.publish(base, added={"documents": folder}, dead={"documents": self.staged("documents", folder).select(F.col("id").alias("key"))})

    def delete(self, ids: DataFrame) -> int:
        """Remove documents (id) with chunks and index entries."""
        return self.publish(self._manifest(), dead=dict.fromkeys(KEYS, ids.select(F.col("id").alias("key"))))

    def refresh_taxonomy(self, entries: DataFrame) -> int:
        return self.commit(taxonomy=entries)

    def wipe(self, model: str) -> int:
        """Empty documents, chunks and index, forget the watermark and failures, and note the embedding model."""
        empty = {t: self.spark.createDataFrame([], TABLES[t]) for t in (*KEYS, "failures")}
        meta = self.read("meta").where(~F.col("key").isin("watermark", "embedding_model")).unionByName(self.spark.createDataFrame([("embedding_model", model)], schemas.META))
        return self.commit(meta=meta, **empty)

    def check_model(self, model: str) -> bool:
        """True if the store had another model's vectors and was emptied."""
        known = self.meta("embedding_model")
        if known == model:
            return False
        if known is None:
            self.write_meta(embedding_model=model)
            return False
        self.wipe(model)
        return True

    def reembed_scope(self) -> tuple[int, int]:
        """Documents and chunks that a rebuild would embed; -1, -1 if the store can't be read."""
        try:
            return self.read("documents").count(), self.read("chunks").count()
        except Exception:  # noqa: BLE001
            return -1, -1

    def segments(self) -> int:
        """The most segments that a table has."""
        return max((len(t["segments"]) + len(t["dead"]) for t in self._manifest()["tables"].values()), default=0)

    def compact(self) -> int:
        """Merge each table's segments and drop its dead rows; files get the session's advisory partition size."""
        base = self._manifest()
        return self.publish(base, {t: self.stage(t, self.read(t).hint("rebalance")) for t, parts in base["tables"].items() if len(parts["segments"]) + len(parts["dead"]) > 1})

    def vacuum(self, older_than: float = DAY) -> None:
        """Delete folders that the current generation doesn't name, but for those of the last `older_than` seconds: a writer or reader may be at work on them."""
        manifest = self._manifest()
        tables = manifest["tables"].values()
        keep = {f for t in tables for parts in (t["segments"], t["dead"]) for f, _ in parts} | {self._blocks_of(manifest)}
        for table in (*TABLES, "dead", "blocks"):
            if self._fs.exists(self._at(table)):
                for s in self._fs.listStatus(self._at(table)):
                    if f"{table}/{s.getPath().getName()}" not in keep and time.time() - s.getModificationTime() / 1000 >= older_than:
                        self._fs.delete(s.getPath(), True)


def merged_metadata(documents: DataFrame, changes: DataFrame) -> DataFrame:
    """documents with the metadata columns of changes where there is a row for the id."""
    new = changes.select(F.col("id"), F.struct(*[F.col(c) for c in IndexStore.METADATA]).alias("_new"))
    joined = documents.join(new, "id", "left")
    return joined.select(*[F.when(F.col("_new").isNotNull(), F.col(f"_new.{c}")).otherwise(F.col(c)).alias(c) if c in IndexStore.METADATA else F.col(c) for c in documents.columns])
