"""Prompts: a question put together with the document and table facts it needs.

Contexts are rows (doc, text), or windows of documents as ``document_windows`` gives
them: then there is one prompt for each question and window, with the window's place, so
that a question is asked about the whole document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Characters of a document that go into one prompt of each kind.
DOCUMENT_CHARS = 100_000
UNIFIED_CHARS = 5_000
SUMMARY_CHARS = 3_000
# Fixed value: what stands for a missing context in a summary.
NOT_AVAILABLE = "No disponible"

DOCUMENT_TASK = "Answer from the document below and cite the passages you use. Say so if it has no answer."
UNIFIED_TASK = "Answer by combining the document with the table statistics. Say so if something is missing."
SUMMARY_TASK = "Write a short summary that combines the document and the table statistics."
TABLE_TASK = "Answer from the table statistics below. Give figures, patterns and recommendations."


PLACE = ("part_no", "window_no")


def _place(contexts: DataFrame) -> list[str]:
    return [c for c in PLACE if c in contexts.columns]


def _joined(questions: DataFrame, contexts: DataFrame, doc: str) -> DataFrame:
    # Both sides are shuffled for this join alone (parts are grouped by document and part),
    # so adaptive execution can split a document with very many questions or windows.
    return questions.join(contexts.select(doc, *_place(contexts), F.col("text").alias("_context")), doc, "left")


def _block(title: str, text: Column) -> Column:
    """A titled block; nothing at all where the text is missing or empty."""
    return F.when(F.length(text) > 0, F.concat(F.lit(f"\n\n[{title}]\n"), text)).otherwise("")


def document_prompt(questions: DataFrame, contexts: DataFrame, doc: str = "doc_id", task: str = DOCUMENT_TASK) -> DataFrame:
    """Questions (doc, question) with the prompt on their document's text.

    The prompt is null where the document has no text.
    """
    prompt = F.concat(
        F.lit(task), F.lit("\n\n[document]\n"), F.col("_context"), F.lit("\n\n[question]\n"), F.col("question")
    )
    return _joined(questions, contexts, doc).select(*questions.columns, *_place(contexts), prompt.alias("prompt"))


def unified_prompt(
    questions: DataFrame, contexts: DataFrame, report: DataFrame, doc: str = "doc_id", task: str = UNIFIED_TASK
) -> DataFrame:
    """Questions with the prompt on their document and on a table's report.

    ``report`` has one row with the column ``text`` and enters as a scalar subquery.
    """
    prompt = F.concat(
        F.lit(task),
        _block("document", F.col("_context")),
        _block("table statistics", F.col("_report")),
        F.lit("\n\n[question]\n"),
        F.col("question"),
    )
    return (
        _joined(questions, contexts, doc)
        .withColumn("_report", report.select("text").scalar())
        .select(*questions.columns, *_place(contexts), prompt.alias("prompt"))
    )


def summary_prompt(contexts: DataFrame, report: DataFrame, doc: str = "doc_id", task: str = SUMMARY_TASK) -> DataFrame:
    """One prompt per document, or per window of it, for a summary of it and of a table's report."""

    def or_missing(text: Column) -> Column:
        return F.when(F.length(text) > 0, text).otherwise(NOT_AVAILABLE)

    prompt = F.concat(
        F.lit(task),
        F.lit("\n\n[document]\n"),
        or_missing(F.col("text")),
        F.lit("\n\n[table statistics]\n"),
        or_missing(F.col("_report")),
    )
    return contexts.withColumn("_report", report.select("text").scalar()).select(
        doc, *_place(contexts), prompt.alias("prompt")
    )


def table_prompt(questions: DataFrame, summary: DataFrame, task: str = TABLE_TASK) -> DataFrame:
    """Questions with the prompt on a table's summary only."""
    prompt = F.concat(
        F.lit(task), F.lit("\n\n[table statistics]\n"), F.col("_summary"), F.lit("\n\n[question]\n"), F.col("question")
    )
    return questions.withColumn("_summary", summary.select("text").scalar()).select(
        *questions.columns, prompt.alias("prompt")
    )
