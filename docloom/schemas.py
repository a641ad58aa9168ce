"""Schemas of the index tables and the value types of queries."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql.types import ArrayType, BooleanType, DoubleType, FloatType, IntegerType, LongType, StringType, StructField, StructType

DOCUMENTS = StructType([
    StructField("id", LongType(), False), StructField("title", StringType()), StructField("correspondent_id", LongType()), StructField("document_type_id", LongType()),
    StructField("tag_ids", ArrayType(LongType(), False), False), StructField("created", StringType()), StructField("modified", StringType(), False), StructField("content_hash", StringType(), False),
    StructField("page_count", IntegerType()), StructField("chunk_count", IntegerType()), StructField("indexed_at", StringType(), False),
])
TAXONOMY = StructType([StructField("kind", StringType(), False), StructField("id", LongType(), False), StructField("name", StringType(), False)])
CHUNKS = StructType([
    StructField("chunk_id", LongType(), False), StructField("document_id", LongType(), False), StructField("chunk_index", IntegerType(), False), StructField("text", StringType(), False),
    StructField("page_hint", IntegerType()), StructField("embedding", ArrayType(FloatType(), False)),
])
POSTINGS = StructType([
    StructField("term", StringType(), False), StructField("chunk_id", LongType(), False), StructField("document_id", LongType(), False), StructField("tf", IntegerType(), False), StructField("dl", IntegerType(), False),
    StructField("positions", ArrayType(IntegerType(), False), False),
])
FTS_STATS = StructType([StructField("chunk_id", LongType(), False), StructField("document_id", LongType(), False), StructField("dl", IntegerType(), False)])
META = StructType([StructField("key", StringType(), False), StructField("value", StringType())])
FAILED = StructType([StructField("document_id", LongType(), False), StructField("failures", IntegerType(), False)])
DOOMED = StructType([StructField("id", LongType(), False), StructField("generation", LongType(), False)])
PRICES = StructType([StructField("model", StringType(), False), StructField("input_per_mtok", DoubleType(), False), StructField("output_per_mtok", DoubleType(), False)])
VERDICTS = StructType([StructField("document_id", LongType(), False), StructField("keep", BooleanType()), StructField("reason", StringType()), StructField("score", DoubleType())])


@dataclass(frozen=True)
class SearchFilters:
    """Conjunctive filters on documents; None and empty mean no restriction."""

    date_from: str | None = None
    date_to: str | None = None
    correspondent_id: int | None = None
    document_type_id: int | None = None
    tag_ids: tuple[int, ...] = ()

    def is_empty(self) -> bool:
        return self == SearchFilters()


@dataclass(frozen=True)
class FilterGuess:
    """Names and date phrases as a planner wrote them."""

    correspondent: str | None = None
    document_type: str | None = None
    tags: tuple[str, ...] = ()
    date_from: str | None = None
    date_to: str | None = None


@dataclass(frozen=True)
class PlannedSpec:
    mode: str  # semantic or keyword
    semantic: str | None = None
    keywords: tuple[str, ...] = ()
    filter_guess: FilterGuess = field(default_factory=FilterGuess)
    rationale: str = ""


@dataclass(frozen=True)
class RetrievalPlan:
    specs: tuple[PlannedSpec, ...]
    clarify: str | None = None


@dataclass(frozen=True)
class RetrievalSpec:
    mode: str
    semantic: str | None
    keywords: tuple[str, ...]
    filters: SearchFilters
    rationale: str = ""


@dataclass(frozen=True)
class Tiers:
    """Cut points of the relevance badge, partial <= good <= strong."""

    strong: float = 0.70
    good: float = 0.66
    partial: float = 0.60
