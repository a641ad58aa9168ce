"""Chunks of document text: paragraphs packed into windows with overlap, as a column of frames and as table functions of SQL.

Paragraphs are runs of non-blank lines; page-marker lines end them and set the page. A window takes
paragraphs, joined by a blank line, while they fit. When one doesn't, the window is a chunk and the
next starts with its last characters; if even that plus the paragraph is too long, the overlap is
dropped. A paragraph longer than a chunk is cut at a stride of size less overlap. At the end no
chunk is longer than HARD_CAP.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from itertools import groupby

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: fixed value: the page marker line
PAGE_MARKER = r"^--- Page (\d+)(?: \([^)]+\))? ---$"
HARD_CAP = 6000
_marker = re.compile(PAGE_MARKER)


def paragraphs(content: str) -> list[tuple[int | None, str]]:
    """(page, text) of each paragraph."""
    page: int | None = None
    lines: list[tuple[bool, int | None, str]] = []  # (is text, page, line)
    for line in content.splitlines():
        found = _marker.match(line)
        if found:
            page = int(found[1])
        lines.append((not found and bool(line.strip()), page, line))
    out = []
    for is_text, run in groupby(lines, key=lambda x: x[0]):
        if is_text:
            rows = list(run)
            out.append((rows[0][1], "\n".join(r[2] for r in rows).strip()))
    return out


class _Window:
    """The chunk under way: its text, page, and whether it holds more than carried-over overlap."""

    def __init__(self, size: int, overlap: int) -> None:
        self.size, self.overlap = size, overlap
        self.tail, self.tail_page = "", None
        self.text, self.page, self.filled = "", None, False

    def fits(self, text: str) -> bool:
        """Takes the paragraph if it fits, after the overlap of the last chunk at need."""
        head = self.text or self.tail
        return len(head) + (2 if head else 0) + len(text) <= self.size

    def add(self, page: int | None, text: str) -> None:
        if not self.text and self.tail:
            self.text, self.page = self.tail, self.tail_page
        self.text += ("\n\n" if self.text else "") + text
        self.page = page if self.page is None else self.page
        self.filled = True

    def close(self, text: str, page: int | None) -> tuple[int | None, str]:
        self.tail, self.tail_page = (text[-self.overlap :] if self.overlap else ""), page
        self.text, self.page, self.filled = "", None, False
        return page, text


def _windows(parts: list[tuple[int | None, str]], size: int, overlap: int) -> Iterator[tuple[int | None, str]]:
    w = _Window(size, overlap)
    for page, text in parts:
        if not w.fits(text) and w.filled:
            yield w.close(w.text, w.page)
        if not w.fits(text):
            w.text, w.page, w.tail = "", None, ""
        if w.fits(text):
            w.add(page, text)
            continue
        stride = size - overlap
        last = max(0, -(-(len(text) - size) // stride))
        for i in range(last + 1):
            yield w.close(text[i * stride : i * stride + size], page)
    if w.text:
        yield w.page, w.text


def chunk_text(content: str, size: int = 2000, overlap: int = 256, cap: int = HARD_CAP) -> list[tuple[int, str, int | None]]:
    """(chunk_index, text, page_hint) of one text."""
    return packed(paragraphs(content or ""), size, overlap, cap)


def packed(parts: list[tuple[int | None, str]], size: int, overlap: int, cap: int = HARD_CAP) -> list[tuple[int, str, int | None]]:
    """(chunk_index, text, page_hint) of the paragraphs (page, text) of one document."""
    if not 0 <= overlap < size:
        raise ValueError(f"overlap {overlap} must be at least 0 and less than the size {size}")
    cut = ((page, text[i : i + cap]) for page, text in _windows(parts, size, overlap) for i in range(0, len(text), cap))
    return [(i, text, page) for i, (page, text) in enumerate(cut)]


def chunk_documents(docs: DataFrame, size: int = 2000, overlap: int = 256, key: str = "document_id", text: str = "text") -> DataFrame:
    """document_id, chunk_index, text, page_hint of all documents; Arrow batches in and out, no shuffle."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = [(k, *c) for k, t in zip(pdf[key], pdf[text], strict=True) for c in chunk_text(t or "", size, overlap)]
            out = pd.DataFrame(rows, columns=["document_id", "chunk_index", "text", "page_hint"])
            out["page_hint"] = out["page_hint"].astype("Int64")
            yield out

    if not 0 <= overlap < size:
        raise ValueError("overlap must be at least 0 and less than size")
    return docs.select(key, text).mapInPandas(run, "document_id long, chunk_index int, text string, page_hint int")


CHUNKED = "document_id long, chunk_index int, text string, page_hint int"
_CHUNKED = pa.schema([("document_id", pa.int64()), ("chunk_index", pa.int32()), ("text", pa.string()), ("page_hint", pa.int32())])


def _chunk_table(rows: Iterable[tuple[int | None, int, str, int | None]]) -> pa.Table:
    columns = list(zip(*rows, strict=True)) or [()] * 4
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _CHUNKED, strict=True)], schema=_CHUNKED)


class _Documents:
    """chunk_documents(rows => TABLE(...), size => n, overlap => n): chunks of rows (document_id, text), a batch at a time."""

    def eval(self, rows: pa.RecordBatch, size: pa.Array, overlap: pa.Array) -> Iterator[pa.Table]:
        n, over = size[0].as_py(), overlap[0].as_py()
        yield _chunk_table((k, *c) for k, t in zip(rows.column("document_id").to_pylist(), rows.column("text").to_pylist(), strict=True) for c in chunk_text(t or "", n, over))


class _Pages:
    """chunk_pages(rows => TABLE(...) PARTITION BY document_id ORDER BY page, size => n, overlap => n): chunks of documents that lie as a row
    (document_id, page, text) for each page. Chunks run over page ends and carry the page on which they begin."""

    def __init__(self) -> None:
        self.parts: list[tuple[int | None, str]] = []
        self.document_id, self.size, self.overlap = None, 0, 0

    def eval(self, rows: pa.RecordBatch, size: pa.Array, overlap: pa.Array) -> Iterator[pa.Table]:
        self.size, self.overlap = size[0].as_py(), overlap[0].as_py()
        for k, page, text in zip(*(rows.column(c).to_pylist() for c in ("document_id", "page", "text")), strict=True):
            self.document_id = k
            self.parts += [(page, t) for _, t in paragraphs(text or "")]
        return iter(())

    def terminate(self) -> Iterator[pa.Table]:
        if self.parts:
            yield _chunk_table((self.document_id, *c) for c in packed(self.parts, self.size, self.overlap))


class _OneText:
    """chunk_text(text, size, overlap): chunks of one text, for LATERAL, which takes no Arrow functions."""

    def eval(self, text: str | None, size: int, overlap: int) -> Iterator[tuple[int, str, int | None]]:
        yield from chunk_text(text or "", size, overlap)


def register_chunking(spark: SparkSession) -> None:
    """The table functions chunk_documents, chunk_pages and chunk_text for the session's SQL."""
    spark.udtf.register("chunk_documents", F.arrow_udtf(_Documents, returnType=CHUNKED))
    spark.udtf.register("chunk_pages", F.arrow_udtf(_Pages, returnType=CHUNKED))
    spark.udtf.register("chunk_text", F.udtf(_OneText, returnType="chunk_index int, text string, page_hint int"))


def hard_cap(docs: DataFrame, most: int = HARD_CAP, key: str = "document_id", text: str = "text") -> DataFrame:
    """document_id, chunk_index, text: plain cuts of `most` characters, without Python."""
    cut = F.regexp_extract_all(F.col(text), F.lit(f"(?s).{{1,{most}}}"), F.lit(0))  # in one pass, whatever the length
    return docs.select(F.col(key).alias("document_id"), F.posexplode(cut).alias("chunk_index", "text"))


def chunk_key(document_id: Column, chunk_index: Column) -> Column:
    """A chunk id that indexing again gives again: 20 bits of index under the document's id."""
    return F.call_function("shiftleft", document_id.cast("long"), F.lit(20)) + chunk_index


def page_hint_of(text: Column) -> Column:
    return F.regexp_extract(text, "(?m)" + PAGE_MARKER, 1).try_cast("int")
