"""Page texts: assembly into one document, truncation, born-digital decision."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions.text import page_ranges

FOOTER = "\n\nTranscribed by model:"
_HEADER = re.compile(r"^--- Page (\d+)(?: \([^)]+\))? ---$", re.M)


def assemble_pages(pages: DataFrame, show_models: bool = False) -> DataFrame:
    """document_id, text, models. pages: document_id, page (from 1), text, model. Several pages get headers; blank ones are left out; a footer lists the models."""
    one = pages.groupBy("document_id").agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list(F.struct("page", "text", "model"))).alias("p"))
    filled = F.filter("p", lambda x: x["text"].rlike(r"(?U)\S"))
    model_part = lambda x: F.when(F.coalesce(x["model"], F.lit("")) != "", F.concat(F.lit(" ("), x["model"], F.lit(")"))).otherwise("") if show_models else F.lit("")
    section = lambda x: F.when(F.col("n") > 1, F.concat(F.lit("--- Page "), x["page"].cast("string"), model_part(x), F.lit(" ---\n"), x["text"])).otherwise(x["text"])
    body = F.array_join(F.transform(filled, section), "\n\n")
    models = F.array_sort(F.array_distinct(F.filter(F.transform(filled, lambda x: x["model"]), lambda m: F.coalesce(m, F.lit("")) != "")))
    one = one.select("document_id", body.alias("body"), models.alias("models"))
    footer = F.concat(F.lit("Transcribed by model: "), F.array_join("models", ", "))
    text = F.when(F.size("models") == 0, F.col("body")).when(F.col("body") == "", footer).otherwise(F.concat("body", F.lit("\n\n"), footer))
    return one.select("document_id", text.alias("text"), "models")


def split_footer(text: Column) -> tuple[Column, Column]:
    """Body and footer, cut at the last footer mark."""
    at = F.length(text) - F.instr(F.reverse(text), FOOTER[::-1]) - len(FOOTER) + 1
    there = F.instr(text, FOOTER) > 0
    return F.when(there, F.substr(text, F.lit(1), at)).otherwise(text), F.when(there, F.substr(text, at + 1)).otherwise("")


def truncate_chars(text: Column, most: int) -> Column:
    """At most `most` characters with the footer whole, if it alone isn't longer."""
    if most <= 0:
        return text
    body, footer = split_footer(text)
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.substr(body, F.lit(1), F.greatest(F.lit(0), F.lit(most) - F.length(footer))), footer))


def page_note(pages: Column, total: Column) -> Column:
    return F.concat(F.lit("NOTE: The document transcription below was truncated to reduce cost. Included pages (from OCR headers): "), page_ranges(pages), F.lit(". Total pages with OCR headers: "), total.cast("string"), F.lit("."))


def headed_pages(text: str) -> tuple[str, list[tuple[int, str]], str]:
    """Footerless body, its pages as (number, text) with the first also holding what precedes it, and the footer."""
    at = text.rfind(FOOTER)
    body, footer = (text, "") if at < 0 else (text[:at], text[at:])
    starts = [(m.start(), int(m[1])) for m in _HEADER.finditer(body)]
    cuts = [0, *(s for s, _ in starts[1:]), len(body)]
    return body, [(n, body[a:b]) for (_, n), a, b in zip(starts, cuts, cuts[1:], strict=False)], footer


def truncate_pages(docs: DataFrame, head: int, tail: int, headless_chars: int, key: str = "document_id", text: str = "text") -> DataFrame:
    """document_id, text, pages (those kept), total, truncated: the first and last pages with the footer; texts without headers are cut by characters."""

    def run(frames):
        for pdf in frames:
            rows = []
            for k, t in zip(pdf[key], pdf[text], strict=True):
                t = t or ""
                body, pages, footer = headed_pages(t)
                if head <= 0 or pages and len(pages) <= head + max(0, tail):
                    rows.append((k, t, [], len(pages), False))
                elif pages:
                    kept = pages[:head] + (pages[-tail:] if tail > 0 else [])
                    rows.append((k, "".join(p for _, p in kept) + footer, [n for n, _ in kept], len(pages), True))
                elif len(t) > headless_chars > 0:
                    rows.append((k, body[: max(0, headless_chars - len(footer))] + footer, [], 0, True))
                else:
                    rows.append((k, t, [], 0, False))
            yield pd.DataFrame(rows, columns=["document_id", "text", "pages", "total", "truncated"])

    cut = docs.select(key, text).mapInPandas(run, "document_id long, text string, pages array<int>, total int, truncated boolean")
    headless = F.lit(f"NOTE: The document transcription below was truncated because page headers were not found. Included the first {headless_chars} characters.")
    return cut.withColumn("note", F.when(F.col("truncated"), F.when(F.col("total") > 0, page_note(F.col("pages"), F.col("total"))).otherwise(headless)))


def born_digital(pages: DataFrame, min_chars: int, coverage: float) -> DataFrame:
    """document_id, skip, reason and signals. pages: document_id, chars (non-space), coverage (largest image's share, null without one), glyphless."""
    s = pages.groupBy("document_id").agg(F.count(F.lit(1)).alias("pages"), F.min("chars").alias("min_page_chars"), F.coalesce(F.max("coverage"), F.lit(0.0)).alias("c"), F.bool_or("glyphless").alias("glyphless"))
    reason = F.when(F.col("glyphless"), "glyphless-ocr-layer").when(F.col("min_page_chars") < min_chars, "low-text-page").when(F.col("c") >= coverage, "full-page-image").otherwise("born-digital")
    return s.select("document_id", (reason == "born-digital").alias("skip"), reason.alias("reason"), "pages", "min_page_chars", F.round("c", 3).alias("max_coverage"), "glyphless")


def fetch_documents(ids: DataFrame, documents: DataFrame, most: int = 50_000) -> DataFrame:
    """For each requested id (document_id): text cut to `most` characters, whether it was cut, and an error if there is no such document."""
    got = ids.join(documents.select(F.col("id").alias("document_id"), "text"), "document_id", "left")
    there = F.col("text").isNotNull()
    return got.select("document_id", F.substring("text", 1, most).alias("text"), F.coalesce(F.length("text") > most, F.lit(False)).alias("truncated"), F.when(~there, F.lit("not found")).alias("error"))
