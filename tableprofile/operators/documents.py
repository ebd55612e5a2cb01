"""Document text, page by page and as a whole."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import WHITESPACE, text_preview, truncate_text, word_count

# The line that opens a page, and the shortest text worth keeping.
PAGE_MARKER = "--- PÁGINA {} ---"
MIN_TEXT_CHARS = 100

# Pages of a document that are put together in one row. Longer documents get more
# rows (parts), so that no task has to hold a document of any size.
PAGES_PER_PART = 1000


def _with_marker(page: Column, text: Column) -> Column:
    """A page from its marker up to the line that separates it from the next marker."""
    before, after = PAGE_MARKER.split("{}")
    opening = F.concat(F.lit(before), page.cast("string"), F.lit(after + "\n"))
    return F.concat(opening, F.coalesce(text, F.lit("")), F.lit("\n\n"))


def assemble_pages(
    pages: DataFrame, doc: str = "doc_id", page: str = "page_no", text: str = "text", pages_per_part: int = PAGES_PER_PART
) -> DataFrame:
    """(doc, part_no, n_pages, chars, text): the pages of each document in order, with markers.

    A document whose page numbers stay below ``pages_per_part`` is one row. The parts of
    a longer one, one after the other, are the document; the whole of it never has to fit
    into one task. ``doc`` and ``page`` (from 0 or 1) identify a row. A row without a page
    number, as a failed extraction gives, adds no text.
    """
    part_no = F.coalesce(F.floor(F.col(page) / pages_per_part), F.lit(0)).alias("part_no")
    rows = pages.select(
        doc,
        part_no,
        F.col(page).alias("_number"),
        F.struct(F.col(page).alias("page"), _with_marker(F.col(page), F.col(text)).alias("text")).alias("_page"),
        F.lit(False).alias("_end"),
    )
    # Only the end of a document is stripped. One row without text tells the last part that
    # it is the last, so texts move once, by part, and a document is never gathered.
    ends = pages.groupBy(doc).agg(F.max(page).alias(page)).select(doc, part_no, F.lit(True).alias("_end"))
    parts = (
        rows.unionByName(ends, allowMissingColumns=True)
        .groupBy(doc, "part_no")
        .agg(
            F.count("_number").alias("n_pages"),
            F.array_sort(F.collect_list("_page")).alias("_pages"),
            F.max("_end").alias("_end"),
        )
    )
    joined = F.array_join(F.transform("_pages", lambda p: p["text"]), "")
    text_of_part = F.when(F.col("_end"), F.rtrim(joined, F.lit(WHITESPACE))).otherwise(joined)
    assembled = parts.select(doc, "part_no", "n_pages", text_of_part.alias("text"))
    return assembled.select(doc, "part_no", "n_pages", F.length("text").cast("long").alias("chars"), "text")


def document_windows(parts: DataFrame, chars: int, doc: str = "doc_id") -> DataFrame:
    """(doc, part_no, window_no, text): each part in windows of ``chars`` characters.

    In order, the windows of a document are the whole document. An empty part is one empty
    window. No row is moved, and a window belongs to one part, so a document of any length
    is spread over as many tasks as its parts were.
    """
    last = F.greatest(F.lit(1), F.ceil(F.length("text") / chars)).cast("int") - 1
    windows = parts.select(doc, "part_no", "text", F.explode(F.sequence(F.lit(0), last)).alias("window_no"))
    text = F.substring(F.col("text"), F.col("window_no") * chars + 1, F.lit(chars))
    return windows.select(doc, "part_no", "window_no", F.coalesce(text, F.lit("")).alias("text"))


def document_context(parts: DataFrame, chars: int, doc: str = "doc_id") -> DataFrame:
    """(doc, text, truncated): the first ``chars`` characters of each assembled document.

    ``parts`` comes from ``assemble_pages``, best as a written table. Only part lengths are
    added up per document; of the texts, only the parts that the result needs go on, and
    at most ``chars`` characters meet in one row.
    """
    in_order = Window.partitionBy(doc).orderBy("part_no").rowsBetween(Window.unboundedPreceding, -1)
    lengths = parts.select(doc, "part_no", F.col("chars").alias("_chars"))
    offsets = lengths.withColumn("_start", F.coalesce(F.sum("_chars").over(in_order), F.lit(0)))
    needed = offsets.where(F.col("_start") <= chars)
    piece = F.substring(F.col("text"), F.lit(1), (F.lit(chars) - F.col("_start")).cast("int"))
    return (
        parts.join(needed, [doc, "part_no"])
        .select(
            doc,
            F.struct("part_no", piece.alias("text")).alias("_piece"),
            (F.col("_start") + F.col("_chars") > chars).alias("_cut"),
        )
        .groupBy(doc)
        .agg(F.array_sort(F.collect_list("_piece")).alias("_pieces"), F.bool_or("_cut").alias("truncated"))
        .select(doc, F.array_join(F.transform("_pieces", lambda p: p["text"]), "").alias("text"), "truncated")
    )


def good_text(text: Column) -> Column:
    """Whether extracted text is long enough to be used."""
    return F.coalesce(F.length(text) > MIN_TEXT_CHARS, F.lit(False))


def text_quality_gate(extracted: DataFrame, fallback: Callable[[DataFrame], DataFrame], text: str = "text") -> DataFrame:
    """Keep good text; run the costly ``fallback`` on the other rows only.

    ``fallback`` takes the rejected rows and returns them with new text. ``extracted`` is
    read twice, so it should be a written table, as ``incremental_extract`` gives.
    """
    accepted = good_text(F.col(text))
    if "part_no" in extracted.columns:
        # Only a document in a single part can be short.
        accepted = accepted | (F.col("part_no") > 0)
    kept = extracted.where(accepted).withColumn("method", F.lit("primary"))
    replaced = fallback(extracted.where(~accepted)).withColumn("method", F.lit("fallback"))
    if "chars" in extracted.columns:
        replaced = replaced.withColumn("chars", F.length(text).cast("long"))
    return kept.unionByName(replaced)


def text_stats(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Characters and words per row."""
    c = F.col(text)
    return df.select(key, F.length(c).cast("long").alias("chars"), word_count(c).alias("words"))


def preview_texts(df: DataFrame, key: str, text: str = "text", chars: int = 2000) -> DataFrame:
    """The beginning of each text."""
    return df.select(key, text_preview(F.col(text), chars).alias("preview"))


def truncate_context(df: DataFrame, key: str, chars: int, text: str = "text") -> DataFrame:
    """Each text cut to ``chars`` characters, and whether it was cut."""
    return df.select(key, truncate_text(F.col(text), chars).alias("_cut")).select(key, "_cut.text", "_cut.truncated")


# Characters of a part, and pages whose places are worked out together.
PART_CHARS = 1 << 20
PAGES_PER_SLICE = 1000


def assemble_parts(
    pages: DataFrame,
    doc: str = "doc_id",
    page: str = "page_no",
    text: str = "text",
    part_chars: int = PART_CHARS,
    pages_per_slice: int = PAGES_PER_SLICE,
) -> DataFrame:
    """(doc, part_no, n_pages, chars, text): the document of ``assemble_pages`` in parts of bounded size.

    No part is longer than ``part_chars`` characters, however many pages a document has and
    however long one of them is: a page is cut where a part is full. One after the other
    the parts are the document. ``n_pages`` counts the pages that begin in a part.

    Lengths alone tell where each page lies: running totals within slices of pages, then the
    parts of all slices before. Texts then move once, to their slice. ``doc`` and ``page``
    identify a row; a row without a page number adds no text, and a document of such rows
    alone is one empty part.
    """
    numbered = pages.where(F.col(page).isNotNull())
    slice_no = F.floor(F.col(page) / pages_per_slice).cast("long")
    marked = _with_marker(F.col(page), F.col(text))
    lengths = numbered.select(
        F.col(doc).alias("_doc"),
        F.col(page).alias("_page"),
        slice_no.alias("_slice"),
        F.length(marked).cast("long").alias("_chars"),
        F.length(F.rtrim(marked, F.lit(WHITESPACE))).cast("long").alias("_stripped"),
    )
    in_slice = Window.partitionBy("_doc", "_slice").orderBy("_page")
    before = F.coalesce(F.sum("_chars").over(in_slice.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    last_page = F.lead("_page").over(in_slice).isNull()
    slices = (
        lengths.select("_doc", "_slice", "_page", "_chars", "_stripped", before.alias("_start"), last_page.alias("_last"))
        .groupBy("_doc", "_slice")
        .agg(
            F.map_from_entries(F.collect_list(F.struct("_page", "_start"))).alias("_starts"),
            F.max(F.when(F.col("_last"), F.struct("_page", "_start", "_chars", "_stripped"))).alias("_end"),
        )
    )
    of_doc = Window.partitionBy("_doc").orderBy("_slice")
    # Only the end of a document is stripped: of its last slice, the last page.
    ends = F.lead("_slice").over(of_doc).isNull()
    total = F.col("_end._start") + F.when(ends, F.col("_end._stripped")).otherwise(F.col("_end._chars"))
    parts = F.ceil(total / part_chars)
    placed = slices.select(
        "_doc",
        "_slice",
        "_starts",
        total.alias("_total"),
        F.coalesce(F.sum(parts).over(of_doc.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"),
    )
    texts = numbered.select(F.col(doc).alias("_doc"), slice_no.alias("_slice"), F.col(page).alias("_page"), marked.alias("_text"))
    joined = texts.join(placed, ["_doc", "_slice"]).withColumn("_start", F.try_element_at("_starts", F.col("_page"))).drop("_starts")
    first = F.floor(F.col("_start") / part_chars)
    length = F.least(F.length("_text"), F.col("_total") - F.col("_start"))
    last = F.floor((F.col("_start") + length - 1) / part_chars)
    pieces = joined.select("*", F.explode(F.sequence(first, last)).alias("_part"))
    begin = F.greatest(F.lit(0), F.col("_part") * part_chars - F.col("_start"))
    end = F.least(length, (F.col("_part") + 1) * part_chars - F.col("_start"))
    piece = F.struct("_page", F.substring(F.col("_text"), (begin + 1).cast("int"), (end - begin).cast("int")).alias("text"))
    assembled = pieces.groupBy("_doc", "_slice", "_part").agg(
        F.first("_base").alias("_base"),
        F.count_if(F.col("_part") == first).alias("n_pages"),
        F.array_sort(F.collect_list(piece)).alias("_pieces"),
    )
    found = assembled.select(
        F.col("_doc").alias(doc),
        (F.col("_base") + F.col("_part")).cast("long").alias("part_no"),
        "n_pages",
        F.array_join(F.transform("_pieces", lambda p: p["text"]), "").alias("text"),
    )
    unnumbered = pages.groupBy(doc).agg(F.count(page).alias("n_pages")).where("n_pages = 0")
    empty = unnumbered.select(doc, F.lit(0).cast("long").alias("part_no"), "n_pages", F.lit("").alias("text"))
    return found.unionByName(empty).select(doc, "part_no", "n_pages", F.length("text").cast("long").alias("chars"), "text")
