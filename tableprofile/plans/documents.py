"""Document and prompt queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import normalise_text
from ..operators import context, documents, enrich, report
from ..session import scratch_path
from . import checks
from .incidents import COLUMNS, CTE, incidents
from .registry import query, read


@query(
    "normalise_text",
    "SELECT doc_id, regexp_replace(lower(strip_accents(text)), '[^a-z0-9]', '', 'g') AS text FROM documents",
)
def normalise_text_query(spark, folder):
    return read(spark, folder, "documents").select("doc_id", normalise_text(F.col("text")).alias("text"))


@query(
    "text_stats",
    r"SELECT doc_id, length(text) AS chars, len(regexp_extract_all(text, '[^\s]+')) AS words FROM documents",
)
def text_stats(spark, folder):
    return documents.text_stats(read(spark, folder, "documents"), "doc_id")


@query("text_preview", "SELECT doc_id, substr(text, 1, 2000) AS preview FROM documents")
def text_preview(spark, folder):
    return documents.preview_texts(read(spark, folder, "documents"), "doc_id")


@query("truncate_context", "SELECT doc_id, substr(text, 1, 5000) AS text, length(text) > 5000 AS truncated FROM documents")
def truncate_context(spark, folder):
    return documents.truncate_context(read(spark, folder, "documents"), "doc_id", context.UNIFIED_CHARS)


_ASSEMBLED = r"""assembled AS (SELECT *, length(text) AS chars FROM (
    SELECT conv_id, CAST(0 AS BIGINT) AS part_no, count(*) AS n_pages,
    regexp_replace(string_agg(chr(10) || '--- PÁGINA ' || turn || ' ---' || chr(10) || text || chr(10), '' ORDER BY turn),
      '^\s+|\s+$', '', 'g') AS text FROM conversations GROUP BY conv_id))"""


def _assembled(spark, folder):
    return documents.assemble_pages(read(spark, folder, "conversations"), "conv_id", "turn")


def _questions(spark, folder):
    """What users say in a conversation, asked about the conversation."""
    turns = read(spark, folder, "conversations").where(F.col("role") == "user")
    return turns.select("conv_id", F.col("text").alias("question"))


_QUESTIONS = "questions AS (SELECT conv_id, text AS question FROM conversations WHERE role = 'user')"


@query("assemble_pages", "WITH " + _ASSEMBLED + " SELECT * FROM assembled")
def assemble_pages(spark, folder):
    return _assembled(spark, folder)


@query(
    "document_context",
    "WITH " + _ASSEMBLED + " SELECT conv_id, substr(text, 1, 3000) AS text, length(text) > 3000 AS truncated FROM assembled",
)
def document_context(spark, folder):
    return documents.document_context(_assembled(spark, folder), context.SUMMARY_CHARS, "conv_id")


@query(
    "text_quality_gate",
    """SELECT doc_id, CASE WHEN length(text) > 100 THEN text ELSE reverse(text) END AS text,
    CASE WHEN length(text) > 100 THEN 'primary' ELSE 'fallback' END AS method FROM documents""",
)
def text_quality_gate(spark, folder):
    texts = read(spark, folder, "documents").select("doc_id", "text")
    return documents.text_quality_gate(texts, lambda weak: weak.withColumn("text", F.reverse("text")))


def _prompt_sql(task: str, *blocks: tuple[str, str]) -> str:
    parts = [f"'{task}'"]
    parts += [f"chr(10) || chr(10) || '[{title}]' || chr(10) || {text}" for title, text in blocks]
    return " || ".join(parts)


def _windows_sql(chars: int) -> str:
    """CTE ``windows``: the assembled documents in windows."""
    return f"""windows AS (SELECT conv_id, part_no, w::INT AS window_no, substr(text, (w * {chars} + 1)::BIGINT, {chars}) AS text
    FROM (SELECT *, unnest(range(greatest(1, ceil(length(text) / {chars}))::BIGINT)) AS w FROM assembled))"""


def _windows(spark, folder, chars):
    return documents.document_windows(_assembled(spark, folder), chars, "conv_id")


@query(
    "assemble_pages_small_parts",
    r"""SELECT *, length(text) AS chars FROM (SELECT conv_id, part_no, n_pages,
      CASE WHEN part_no = max(part_no) OVER (PARTITION BY conv_id) THEN regexp_replace(text, '\s+$', '') ELSE text END AS text
    FROM (SELECT conv_id, turn // 2 AS part_no, count(*) AS n_pages,
      string_agg('--- PÁGINA ' || turn || ' ---' || chr(10) || text || chr(10) || chr(10), '' ORDER BY turn) AS text
      FROM conversations GROUP BY conv_id, turn // 2))""",
)
def assemble_pages_small_parts(spark, folder):
    """Documents of several parts."""
    return documents.assemble_pages(read(spark, folder, "conversations"), "conv_id", "turn", pages_per_part=2)


@query(
    "assemble_parts",
    r"""WITH marked AS (SELECT conv_id, turn, turn // 4 AS s,
      '--- PÁGINA ' || turn || ' ---' || chr(10) || text || chr(10) || chr(10) AS text FROM conversations),
    begins AS (SELECT conv_id, s, p, count(*) AS n_pages FROM (SELECT conv_id, s, coalesce(sum(length(text)) OVER (
        PARTITION BY conv_id, s ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) // 500 AS p FROM marked) GROUP BY ALL),
    slices AS (SELECT conv_id, s, string_agg(text, '' ORDER BY turn) AS text FROM marked GROUP BY conv_id, s),
    stripped AS (SELECT conv_id, s,
      CASE WHEN s = max(s) OVER (PARTITION BY conv_id) THEN regexp_replace(text, '\s+$', '') ELSE text END AS text FROM slices),
    parts AS (SELECT conv_id, s, p, substr(text, p * 500 + 1, 500) AS text
      FROM (SELECT *, unnest(range(ceil(length(text) / 500)::BIGINT)) AS p FROM stripped))
    SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY s, p) - 1 AS part_no, coalesce(n_pages, 0) AS n_pages,
      length(text) AS chars, text FROM parts LEFT JOIN begins USING (conv_id, s, p)""",
)
def assemble_parts(spark, folder):
    """Short parts, so that most pages are cut."""
    return documents.assemble_parts(read(spark, folder, "conversations"), "conv_id", "turn", part_chars=500, pages_per_slice=4)


@query(
    "document_windows",
    """SELECT doc_id, 0::BIGINT AS part_no, w::INT AS window_no, substr(text, (w * 2000 + 1)::BIGINT, 2000) AS text
    FROM (SELECT *, unnest(range(greatest(1, ceil(length(text) / 2000))::BIGINT)) AS w FROM documents)""",
)
def document_windows(spark, folder):
    """Many documents are longer than a window."""
    parts = read(spark, folder, "documents").withColumn("part_no", F.lit(0).cast("long"))
    return documents.document_windows(parts, 2000)


@query(
    "document_prompt",
    "WITH " + _ASSEMBLED + ", " + _windows_sql(context.DOCUMENT_CHARS) + ", " + _QUESTIONS + f"""
    SELECT conv_id, question, part_no, window_no, {_prompt_sql(context.DOCUMENT_TASK, ("document", "text"), ("question", "question"))}
    AS prompt FROM questions JOIN windows USING (conv_id)""",
)
def document_prompt(spark, folder):
    windows = _windows(spark, folder, context.DOCUMENT_CHARS)
    return context.document_prompt(_questions(spark, folder), windows, "conv_id")


@query(
    "unified_prompt",
    "WITH " + _ASSEMBLED + ", " + _windows_sql(context.UNIFIED_CHARS) + ", " + _QUESTIONS + ", "
    + checks.report_text_cte("customer", checks.CUSTOMER) + f"""
    SELECT conv_id, question, part_no, window_no, {_prompt_sql(
        context.UNIFIED_TASK, ("document", "w.text"), ("table statistics", "r.text"), ("question", "question")
    )} AS prompt FROM questions JOIN windows w USING (conv_id), report_text r""",
)
def unified_prompt(spark, folder):
    windows = _windows(spark, folder, context.UNIFIED_CHARS)
    table = report.report_text(report.dataset_report(read(spark, folder, "customer")))
    return context.unified_prompt(_questions(spark, folder), windows, table, "conv_id")


@query(
    "summary_prompt",
    "WITH " + _ASSEMBLED + ", " + _windows_sql(context.SUMMARY_CHARS) + ", "
    + checks.report_text_cte("customer", checks.CUSTOMER) + f"""
    SELECT conv_id, part_no, window_no, {_prompt_sql(
        context.SUMMARY_TASK, ("document", "w.text"), ("table statistics", "r.text")
    )} AS prompt FROM windows w, report_text r""",
)
def summary_prompt(spark, folder):
    windows = _windows(spark, folder, context.SUMMARY_CHARS)
    table = report.report_text(report.dataset_report(read(spark, folder, "customer")))
    return context.summary_prompt(windows, table, "conv_id")


@query(
    "table_prompt",
    "WITH " + CTE + ", " + _QUESTIONS + ", " + checks.summary_text_cte("incidents", COLUMNS) + f"""
    SELECT conv_id, question, {_prompt_sql(context.TABLE_TASK, ("table statistics", "s.text"), ("question", "question"))}
    AS prompt FROM questions, summary_text s""",
)
def table_prompt(spark, folder):
    summary = report.context_summary(incidents(spark, folder))
    return context.table_prompt(_questions(spark, folder), summary)


def counting_client():
    """A deterministic stand-in for the client of an answer service."""

    def make_answer():
        def answer(prompt: str) -> str:
            if "#" in prompt:
                raise ValueError("unreadable prompt")
            return f"{len(prompt)} characters"

        return answer

    return make_answer


# Small windows, so that many documents have several.
_ANSWER_CHARS = 1000
_ANSWERS = "WITH " + _ASSEMBLED + ", " + _windows_sql(_ANSWER_CHARS) + ", " + _QUESTIONS + f""", prompts AS (
    SELECT conv_id, question, part_no, window_no,
      {_prompt_sql(context.DOCUMENT_TASK, ("document", "text"), ("question", "question"))} AS prompt
    FROM (SELECT DISTINCT * FROM questions) JOIN windows USING (conv_id)),
    answers AS (SELECT conv_id, question, part_no, window_no,
    CASE WHEN contains(prompt, '#') THEN '{enrich.FAILED_ANSWER}' ELSE length(prompt) || ' characters' END AS answer,
    CASE WHEN contains(prompt, '#') THEN 'ValueError: unreadable prompt' END AS error FROM prompts)"""


@query("batch_answers", _ANSWERS + " SELECT * FROM answers")
def batch_answers(spark, folder):
    windows = _windows(spark, folder, _ANSWER_CHARS)
    return enrich.batch_answers(
        _questions(spark, folder),
        lambda questions: context.document_prompt(questions, windows, "conv_id"),
        counting_client(),
        keys=("conv_id", "question"),
    )


@query("ledger_answers", _ANSWERS + " SELECT * FROM answers")
def ledger_answers(spark, folder):
    """Half of the conversations first; then all, of which half is in the ledger."""
    ledger = scratch_path(spark, "ledger")
    prompts = context.document_prompt(_questions(spark, folder).distinct(), _windows(spark, folder, _ANSWER_CHARS), "conv_id")
    enrich.ledger_answers(prompts.where("conv_id % 2 = 0"), counting_client(), ledger)
    return enrich.ledger_answers(prompts, counting_client(), ledger)


@query(
    "gather_answers",
    _ANSWERS + """ SELECT conv_id, question, list(answer ORDER BY part_no, window_no) AS answers, count(error) AS failed
    FROM answers GROUP BY conv_id, question""",
)
def gather_answers(spark, folder):
    return enrich.gather_answers(batch_answers(spark, folder), ("conv_id", "question"))
