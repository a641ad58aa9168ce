"""Questions over an index: hybrid retrieval, and answers with planning, judging and refinement."""

from __future__ import annotations

import datetime as dt
import time
from collections import OrderedDict
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.operators.browse import browse, browse_page, date_bounds, facet_counts, index_stats
from docloom.operators.filters import document_filter
from docloom.operators.fts import BlockIndex, StoredIndex
from docloom.operators.fusion import best_sources, capped_chunks, fuse, merge_chunks, merge_verdicts
from docloom.operators.pages import fetch_documents
from docloom.operators.ranked import keyword_document_count, keyword_documents, keyword_search, rank_in
from docloom.operators.vectors import similarity, vector_search_batch
from docloom.plans.providers import Embedder, Judge, KeepAllJudge, Planner, QuotingSynthesizer, RawPlanner, Synthesizer
from docloom.plans.specs import broaden, call_budget, raw_rag_plan, resolve
from docloom.schemas import RetrievalPlan, RetrievalSpec, SearchFilters, Tiers


@dataclass(frozen=True)
class SearchSettings:
    top_k: int = 10
    per_spec_k: int = 10
    per_document: int = 3
    max_specs: int = 8
    min_similarity: float = 0.60
    min_query_chars: int = 2
    max_refinements: int = 1
    use_judge: bool = True
    cache_seconds: float = 14400
    cache_entries: int = 512
    strict_filters: bool = False
    tiers: Tiers = field(default_factory=Tiers)


class ResultCache:
    """Least recently used entries go first, old ones on reading; keyed by question, filters and index version."""

    def __init__(self, entries: int, seconds: float, clock: Callable[[], float] = time.monotonic) -> None:
        self.entries, self.seconds, self.clock = entries, seconds, clock
        self._held: OrderedDict[tuple, tuple[float, object]] = OrderedDict()

    @staticmethod
    def key(query: str, filters: SearchFilters | None, version: str) -> tuple:
        return " ".join(query.split()).casefold(), filters, version

    def get(self, key: tuple):
        if key not in self._held:
            return None
        at, value = self._held[key]
        if self.clock() - at > self.seconds:
            del self._held[key]
            return None
        self._held.move_to_end(key)
        return value

    def put(self, key: tuple, value: object) -> None:
        self._held[key] = (self.clock(), value)
        self._held.move_to_end(key)
        while len(self._held) > self.entries:
            self._held.popitem(last=False)


class Search:
    """Tables: documents (with text), chunks, vectors (chunk_id, document_id, embedding) and taxonomy; with a stored full-text index keyword searches read that. A Search reads one state of the tables."""

    def __init__(self, documents: DataFrame, chunks: DataFrame, vectors: DataFrame, taxonomy: DataFrame, embedder: Embedder, planner: Planner | None = None, judge: Judge | None = None, synthesizer: Synthesizer | None = None, settings: SearchSettings = SearchSettings(), index: StoredIndex | BlockIndex | None = None) -> None:  # noqa: B008
        self.index = index
        self._names: dict[str, list[tuple[int, str]]] | None = None
        self.documents, self.chunks, self.vectors, self.taxonomy = documents, chunks, vectors, taxonomy
        self.embedder, self.planner, self.judge, self.synthesizer = embedder, planner or RawPlanner(), judge or KeepAllJudge(), synthesizer or QuotingSynthesizer()
        self.settings = settings
        self.cache = ResultCache(settings.cache_entries, settings.cache_seconds)

    def names(self) -> dict[str, list[tuple[int, str]]]:
        """The taxonomy on the driver: a dimension of names, read once."""
        if self._names is None:
            self._names = {}
            for r in self.taxonomy.orderBy("kind", "id").collect():
                self._names.setdefault(r.kind, []).append((r.id, r.name))
        return self._names

    # operators

    def ranked_lists(self, specs: Sequence[RetrievalSpec]) -> list[DataFrame]:
        """A short ranked list for each spec, semantic ones first; if the embedder fails only keyword ones."""
        semantic = [s for s in specs if s.mode == "semantic" and s.semantic]
        try:
            vectors = self.embedder([s.semantic for s in semantic]) if semantic else []
        except Exception:  # noqa: BLE001  any provider error: go on by keywords
            vectors = []
        k, lists = self.settings.per_spec_k, []
        asked: dict[SearchFilters, list[tuple[int, list[float]]]] = {}
        for i, (s, v) in enumerate(zip(semantic, vectors, strict=False)):
            asked.setdefault(s.filters, []).append((i, [float(x) for x in v]))
        for f, queries in asked.items():  # one pass over the vectors for all that share a filter
            where = None if f.is_empty() else document_filter(f)
            table = self.vectors.sparkSession.createDataFrame(queries, "query_id long, embedding array<double>")
            hits = vector_search_batch(self.vectors, self.documents, table, k, where)
            lists.append(hits.select("chunk_id", "document_id", F.col("query_id").cast("int").alias("list_no"), F.col("rank").alias("pos"), "distance", F.lit(False).alias("keyword")))
        for s in specs:
            if s.mode == "keyword" and s.keywords:
                hits = keyword_search(self.index or self.chunks, self.documents, " ".join(s.keywords), k, s.filters)
                lists.append(rank_in(hits, len(vectors) + len(lists), F.round("bm25", 6), "chunk_id").withColumn("distance", F.lit(None).cast("double")).withColumn("keyword", F.lit(True)))
        return lists

    def retrieve_specs(self, specs: Sequence[RetrievalSpec]) -> DataFrame | None:
        """chunk_id, document_id, rrf, similarity, keyword_hit, text: fused, the best documents, capped."""
        lists = self.ranked_lists(specs)
        if not lists:
            return None
        hits = reduce(DataFrame.unionByName, lists)
        extra = hits.groupBy("chunk_id").agg(similarity(F.min("distance")).alias("similarity"), F.bool_or("keyword").alias("keyword_hit"))
        chosen = capped_chunks(fuse(hits), self.settings.top_k, self.settings.per_document).select("chunk_id", "document_id", "rrf")
        return chosen.join(extra, "chunk_id").join(self.chunks.select("chunk_id", "text"), "chunk_id", "left")

    def _bind(self, plan: RetrievalPlan, ui: SearchFilters | None, today: dt.date, query: str, twins: bool = True) -> list[RetrievalSpec]:
        return resolve(plan, self.names(), ui, today, query, self.settings.max_specs if twins else None, self.settings.strict_filters)

    def retrieve_plan(self, plan: RetrievalPlan, query: str, ui: SearchFilters | None = None, today: dt.date | None = None) -> DataFrame | None:
        """One pass; if it finds nothing, one more without any filter."""
        found = self._held(self.retrieve_specs(self._bind(plan, ui, today or dt.date.today(), query)))
        if found is None or found.isEmpty():
            found = self._held(self.retrieve_specs(self._bind(broaden(plan), ui if self.settings.strict_filters else None, today or dt.date.today(), "", False)))
        return found

    def _held(self, found: DataFrame | None) -> DataFrame | None:
        """The chosen rows, at most top_k * per_document, as a table of their own, so that gate, judge and sources don't search again."""
        return None if found is None else found.sparkSession.createDataFrame(found.collect(), found.schema)

    # entry points

    def retrieve(self, query: str, ui: SearchFilters | None = None, today: dt.date | None = None) -> DataFrame | None:
        """Sources for a question without any model call but the embedding; None if the question is too short."""
        if len(query.strip()) < self.settings.min_query_chars:
            return None
        chunks = self.retrieve_plan(raw_rag_plan(query), query, ui, today)
        return None if chunks is None else best_sources(chunks, self.documents, tiers=self.settings.tiers)

    def answer(self, query: str, ui: SearchFilters | None = None, today: dt.date | None = None) -> dict:
        """Plan, retrieve, gate, judge, answer, refine. The result says how it ended and counts model calls within call_budget."""
        s = self.settings
        if len(query.strip()) < s.min_query_chars:
            return {"status": "clarify", "answer": None, "sources": [], "calls": 0}
        version = index_stats(self.documents, self.chunks).first().version
        key = ResultCache.key(query, ui, version)
        if (held := self.cache.get(key)) is not None:
            return held
        calls, most = 1, call_budget(s.use_judge, s.max_refinements)
        plan = self.planner.plan(query)
        if plan.clarify and not plan.specs:
            return {"status": "clarify", "answer": plan.clarify, "sources": [], "calls": calls}
        chunks = self.retrieve_plan(plan, query, ui, today)
        outcome: dict = {"status": "empty", "answer": None, "sources": [], "calls": calls}
        for round_ in range(s.max_refinements + 1):
            if chunks is None or chunks.isEmpty():
                break
            signal = chunks.agg(F.max("similarity").alias("similarity"), F.bool_or("keyword_hit").alias("hit")).first()
            if signal.similarity is not None and signal.similarity < s.min_similarity and not signal.hit:
                outcome = {"status": "irrelevant", "answer": None, "sources": [], "calls": calls}
                break
            rows = best_sources(chunks, self.documents, tiers=s.tiers).collect()  # at most top_k documents
            if s.use_judge:
                calls += 1
                verdicts = self.documents.sparkSession.createDataFrame(self.judge.judge(query, [(r.document_id, r.snippet) for r in rows]), "document_id long, keep boolean, reason string, score double")
                asked = self.documents.sparkSession.createDataFrame([(r.document_id,) for r in rows], "document_id long")
                kept = {r.document_id for r in merge_verdicts(asked, verdicts).where("keep").collect()}
                rows = [r for r in rows if r.document_id in kept]
                if not rows:
                    outcome = {"status": "judged_empty", "answer": None, "sources": [], "calls": calls}
                    break
            calls += 1
            reply = self.synthesizer.answer(query, [(r.document_id, r.snippet) for r in rows], round_ == s.max_refinements)
            cited = [r for r in rows if r.document_id in set(reply.get("citations") or [])] or rows
            outcome = {"status": reply.get("outcome", "answered"), "answer": reply.get("answer"), "sources": [r.asDict() for r in cited], "calls": calls}
            if reply.get("outcome") != "needs_more" or round_ == s.max_refinements or calls + 2 > most:
                break
            again = self.planner.plan(f"{query}\n{reply.get('adjustment') or ''}".strip())
            if again == plan:
                break
            calls, plan = calls + 1, again
            more = self.retrieve_plan(again, "", ui, today)
            chunks = chunks if more is None else merge_chunks(chunks, more)
        self.cache.put(key, outcome)
        return outcome

    def keyword(self, query: str, limit: int = 10, offset: int = 0, filters: SearchFilters | None = None) -> tuple[DataFrame, DataFrame]:
        """A page of documents (1 to 50 rows) and their number; filters hold here."""
        limit, offset = min(max(1, limit), 50), max(0, offset)
        source = self.index or self.chunks
        return keyword_documents(source, self.documents, query, limit, offset, filters), keyword_document_count(source, self.documents, query, filters)

    def fetch(self, ids: Sequence[int]) -> DataFrame:
        """Texts of one to five documents."""
        if not 1 <= len(ids) <= 5:
            raise ValueError("ask for one to five documents")
        return fetch_documents(self.documents.sparkSession.createDataFrame([(i,) for i in ids], "document_id long"), self.documents)

    def facets(self) -> DataFrame:
        return facet_counts(self.documents, self.taxonomy)

    def dates(self) -> DataFrame:
        return date_bounds(self.documents)

    def stats(self) -> DataFrame:
        return index_stats(self.documents, self.chunks)

    def browse(self, filters: SearchFilters = SearchFilters(), text: str | None = None, sort: str = "created", descending: bool = True, number: int = 1, size: int = 20) -> DataFrame:  # noqa: B008
        return browse_page(browse(self.documents, self.taxonomy, filters, text), sort, descending, number, size)
