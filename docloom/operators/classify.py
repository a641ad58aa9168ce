"""What becomes of a document when it is classified: one pass of states and tags as columns."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions.classification import is_empty_classification, parse_classification
from docloom.functions.tags import without_pipeline_tags
from docloom.functions.text import is_error_content, is_generic_type, is_model_refusal


@dataclass(frozen=True)
class PipelineTags:
    """Tag ids of the two steps, transcription and classification, and of errors; none where a step has no such tag."""

    ocr_waiting: int
    waiting: int
    done: int | None = None
    running: int | None = None
    ocr_done: int | None = None
    ocr_running: int | None = None
    error: int | None = None

    def all(self) -> tuple[int, ...]:
        return tuple(t for t in (self.ocr_waiting, self.ocr_done, self.ocr_running, self.waiting, self.done, self.running, self.error) if t is not None)


def _has(tags: Column, tag: int | None) -> Column:
    return F.lit(False) if tag is None else F.array_contains(tags, F.lit(tag).cast("long"))


def _with(tags: Column, tag: int | None) -> Column:
    return tags if tag is None else F.array_union(tags, F.array(F.lit(tag).cast("long")))


def screen(documents: DataFrame, tags: PipelineTags) -> DataFrame:
    """documents (id, text, tag_ids ...) with state before any model is asked: errored, claimed (by another), requeued (no text yet), refused (the text is a model's refusal), or ready."""
    text = F.coalesce("text", F.lit(""))
    state = F.when(_has(F.col("tag_ids"), tags.error), "errored").when(_has(F.col("tag_ids"), tags.running), "claimed").when(~text.rlike(r"(?U)\S"), "requeued")
    return documents.withColumn("state", state.when(is_error_content(text) | is_model_refusal(text), "refused").otherwise("ready"))


def settle(screened: DataFrame, replies: DataFrame, tags: PipelineTags) -> DataFrame:
    """id, state, tag_ids after classification. replies: id, reply (a model's text), tag_ids of the entries that its names were matched to.

    A ready document without a usable reply is empty, one with a type that says nothing is generic; both, and errored and refused ones, lose all
    pipeline tags and get that for errors. Requeued ones wait for transcription again, claimed ones stay as they are, and classified ones get the tag for done and those of their names."""
    parsed = replies.select("id", parse_classification(F.col("reply")).alias("_p"), F.col("tag_ids").alias("_names"))
    rows = screened.select("id", "state", "tag_ids").join(parsed, "id", "left")
    empty = F.col("_p").isNull() | is_empty_classification(F.col("_p"))
    state = F.when(F.col("state") != "ready", F.col("state")).when(empty, "empty").when(is_generic_type(F.col("_p.document_type")), "generic").otherwise("classified")
    clean = without_pipeline_tags(F.col("tag_ids"), tags.all())
    after = (
        F.when(F.col("state") == "claimed", F.col("tag_ids"))
        .when(F.col("state") == "requeued", _with(clean, tags.ocr_waiting))
        .when(F.col("state") == "classified", F.array_union(_with(clean, tags.done), F.coalesce("_names", F.array().cast("array<bigint>"))))
        .otherwise(_with(clean, tags.error))
    )
    return rows.withColumn("state", state).select("id", "state", after.alias("tag_ids"))
