"""Document fingerprints: a canonical exact digest.

A text's canonical form is NFKC, case-folded, NFKC again, with runs of white space made one space
and the ends trimmed; its fingerprint is the 128-bit xxh3 of that form. Rows with equal digests are
compared byte for byte with the smallest doc_id's canonical text; one that differs gets a longer
fingerprint of its own, so equal fingerprints mean equal canonical texts.

Null texts count as empty; texts of any length are read whole, a batch of rows at a time; repeated
rows get equal fingerprints; rows that share a doc_id follow each other by their texts; null doc_ids
come last; an empty table gives an empty result; other columns of the input aren't read.
"""

from __future__ import annotations

import hashlib
import math
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.llm.runs import trimmed
from docloom.llm.scratch import Scratch, broadcast_if_small


#: Documents of one bucket that are compared in one part.
PART = 256
#: Text of one range, about.
RANGE_BYTES = 1 << 27


def canonical(text: str) -> str:
    if text.isascii():
        return " ".join(text.lower().split())
    folded = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).casefold())
    return " ".join(folded.split())


def digest(canon: str) -> str:
    return xxhash.xxh3_128_hexdigest(canon.encode("utf-8", "surrogatepass"))


def edited(text: str, following: str) -> str:
    """The last quarter of text replaced by as much of the following text."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


def _row(doc_id, text: str, canon: str, following: str, following_canon: str) -> tuple:
    own, e = digest(canon), edited(text, following)
    ec = canonical(e)
    return doc_id, len(text), hashlib.sha256(e.encode("utf-8", "surrogatepass")).hexdigest(), own, digest(ec), float(ec == canon), float(following_canon == canon)


_COLUMNS = ("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")
_SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one range in order: each but the last with its successor; the first and last texts also go on, for the neighbouring ranges."""
    part = TaskContext.get().partitionId()
    first = last = None
    fields = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int32(), pa.string(), pa.string()]
    names = [*_COLUMNS, "part", "first", "last"]

    def table(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), fields, strict=True)], names)

    for b in batches:
        rows = []
        for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            text = text or ""
            canon = canonical(text)
            if last is None:
                first = text
            else:
                rows.append((*_row(*last, text, canon), None, None, None))
            last = (doc_id, text, canon)
        if rows:
            yield table(rows)
    if last is not None:
        yield table([(last[0], None, None, None, None, None, None, part, first, last[1])])


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = [_row(i, t, canonical(t), n, canonical(n)) for i, t, n in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True)]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()], strict=True)], list(_COLUMNS))


def _canonical_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([canonical(t or "") for t in b.column(1).to_pylist()], pa.string())], ["doc_id", "canon"])


def collisions(docs: DataFrame, prints: DataFrame) -> DataFrame:
    """doc_id and fingerprint of documents that share a digest with a smaller doc_id but not its canonical bytes; as a rule none.

    prints: doc_id, fingerprint. Only texts of documents in buckets of two or more are moved. A bucket
    is dealt into parts of about PART documents, and its first text goes along once a part."""
    scratch = Scratch(docs.sparkSession)
    shared = scratch.keep(prints.where(F.col("doc_id").isNotNull()).groupBy("fingerprint").agg(F.ceil(F.count(F.lit(1)) / PART).alias("parts"), F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"))
    members = scratch.keep(prints.join(broadcast_if_small(shared), "fingerprint").select("doc_id", "fingerprint", "rep", "parts").distinct())
    ids = broadcast_if_small(scratch.keep(members.select("doc_id").distinct()))
    texts = docs.join(ids, "doc_id", "left_semi").select("doc_id", "text").mapInArrow(trimmed(_canonical_batches), "doc_id long, canon string")
    held = scratch.keep(members.join(texts, "doc_id"))
    firsts = held.where("doc_id = rep").groupBy("rep", "parts").agg(F.min("canon").alias("first_canon"))
    firsts = firsts.select("rep", "first_canon", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))
    others = held.where("doc_id <> rep").withColumn("part", F.pmod(F.xxhash64("doc_id"), F.col("parts")))
    out = scratch.keep(others.join(firsts, ["rep", "part"]).where("canon <> first_canon").groupBy("doc_id").agg(F.min(F.concat_ws(":", "fingerprint", F.sha2("canon", 256))).alias("own")))
    scratch.only(out)
    return out


def fingerprint_documents(docs: DataFrame, partitions: int | None = None) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next; docs: doc_id, text."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0] if partitions is None else 0
    n = partitions or max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(size / RANGE_BYTES))
    order = F.col("doc_id").asc_nulls_last()
    scratch = Scratch(spark)
    ranged = docs.repartitionByRange(n, order).sortWithinPartitions(order, "text")
    found = scratch.keep(ranged.mapInArrow(trimmed(_in_order), f"{_SCHEMA}, part int, first string, last string"))
    ends = found.where(F.col("part").isNotNull())  # a row for each range
    # the numbers of the ranges that have rows are put in order by themselves; texts move to their neighbours by a join
    w = Window.orderBy("part")
    first_of_all = F.first("part").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    neighbours = scratch.keep(ends.select("part", F.coalesce(F.lead("part").over(w), first_of_all).alias("next")))
    firsts = ends.select(F.col("part").alias("next"), F.col("first").alias("following"))
    pairs = ends.select("part", "doc_id", F.col("last").alias("text")).join(neighbours, "part").join(firsts, "next")
    closed = pairs.select("doc_id", "text", "following").mapInArrow(trimmed(_ends), _SCHEMA)
    out = scratch.keep(found.where(F.col("part").isNull()).select(*_COLUMNS).unionByName(closed))
    scratch.drop(found)
    other = broadcast_if_small(collisions(docs, out.select("doc_id", "fingerprint")))
    return out.join(other, "doc_id", "left").withColumn("fingerprint", F.coalesce("own", "fingerprint")).select(*_COLUMNS)


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = None
