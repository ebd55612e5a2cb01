"""Source and sink queries: they write what they read below the shared scratch folder."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import functions as F

from ..operators import report
from ..session import scratch_path
from ..sources import datasets, files, pages, snapshots
from . import checks
from .cleaning import decimal_sql, hour_sql
from .incidents import COLUMNS, WITH, incidents
from .registry import query, read

_ORDERS_SQL = """SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, strftime(o_orderdate, '%Y-%m-%d') AS o_orderdate,
    o_orderpriority FROM orders"""


def _orders(spark, folder):
    return read(spark, folder, "orders").withColumn("o_orderdate", F.date_format("o_orderdate", "yyyy-MM-dd"))


@query("scan_csv", _ORDERS_SQL)
def scan_csv(spark, folder):
    path = files.write_table(_orders(spark, folder), scratch_path(spark, "csv"), "csv")
    return files.scan_csv(spark, path)


_TYPED = {"a_o": "BIGINT", "edad": "BIGINT"}


@query(
    "scan_csv_nulls",
    WITH + f"SELECT {', '.join(f'CAST({c} AS {_TYPED[c]}) AS {c}' if c in _TYPED else c for c, _, _ in COLUMNS)} FROM incidents",
)
def scan_csv_nulls(spark, folder):
    path = files.write_table(incidents(spark, folder), scratch_path(spark, "csv"), "csv")
    return files.scan_csv(spark, path)


@query("scan_csv_records", "SELECT doc_id, text, lang FROM documents")
def scan_csv_records(spark, folder):
    """Whole documents, with their line breaks and quotes, as CSV that is split."""
    texts = read(spark, folder, "documents").select("doc_id", "text", "lang")
    path = files.write_table(texts, scratch_path(spark, "csv-records"), "csv")
    return files.scan_csv_records(spark, path, "doc_id long, text string, lang string")


@query(
    "snapshots",
    """SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 2 = 1 THEN o_orderstatus END AS o_orderstatus FROM orders""",
)
def snapshot_table(spark, folder):
    """A version that is replaced, and a part with one more column that is appended."""
    orders, path = read(spark, folder, "orders"), scratch_path(spark, "snapshots")
    even, odd = (orders.where(F.col("o_orderkey") % 2 == i).select("o_orderkey", "o_custkey", *c) for i, c in ((0, []), (1, ["o_orderstatus"])))
    snapshots.write_snapshot(odd, path)
    snapshots.write_snapshot(even, path)
    snapshots.write_snapshot(odd, path, append=True)
    return snapshots.read_snapshot(spark, path)


@query("write_table", "SELECT * FROM lineitem")
def write_table(spark, folder):
    path = files.write_table(read(spark, folder, "lineitem"), scratch_path(spark, "table"), partition_by=("l_returnflag",))
    return spark.read.parquet(path).select(*(name for name, _, _ in checks.LINEITEM))


@query("scan_json_records", _ORDERS_SQL)
def scan_json_records(spark, folder):
    # Records land as arrays, one response page of at most a thousand records per line.
    record = F.struct(*_orders(spark, folder).columns)
    landed = (
        _orders(spark, folder)
        .groupBy(F.floor(F.col("o_orderkey") / 1000).alias("page"))
        .agg(F.to_json(F.collect_list(record)).alias("value"))
        .select("value")
    )
    path = scratch_path(spark, "json")
    landed.write.text(path)
    return files.scan_json_records(spark, path).select(*_orders(spark, folder).columns)


_CLEAN = ", ".join(
    f"{decimal_sql(c)} AS {c}" if c in ("lat", "long", "edad") else f"{hour_sql(c)} AS {c}" if c == "hora" else c
    for c, _, _ in COLUMNS
)


def _land(spark, df, label: str) -> str:
    path = scratch_path(spark, label)
    df.write.json(path)
    return path


@query("ingest_dataset", WITH + f"SELECT {_CLEAN} FROM incidents")
def ingest_dataset(spark, folder):
    rows = incidents(spark, folder)
    landed = _land(spark, rows, "landed")
    ingested = datasets.ingest_dataset(
        spark, landed, "City incidents-2024", scratch_path(spark, "clean"), schema=rows.schema
    )
    return ingested.select(*(name for name, _, _ in COLUMNS))


@query(
    "ingest_all",
    WITH + f"""SELECT 'city' AS dataset, ipat, {hour_sql("hora")} AS hora, {decimal_sql("edad")} AS edad, zona,
      CAST(NULL AS VARCHAR) AS genero FROM incidents
    UNION ALL SELECT 'region', ipat, {hour_sql("hora")}, {decimal_sql("edad")}, NULL, genero FROM incidents""",
)
def ingest_all(spark, folder):
    rows = incidents(spark, folder)
    landed = {
        "city": _land(spark, rows.select("ipat", "hora", "edad", "zona"), "city"),
        "region": _land(spark, rows.select("ipat", "hora", "edad", "genero"), "region"),
    }
    return datasets.ingest_all(spark, landed, scratch_path(spark, "clean"))


@query(
    "ingest_all_clashing",
    WITH + f"""SELECT 'city' AS dataset, ipat, {hour_sql("hora")} AS hora, {decimal_sql("edad")} AS edad, CAST(a_o AS VARCHAR) AS zona
    FROM incidents UNION ALL SELECT 'region', ipat, {hour_sql("hora")}, {decimal_sql("edad")}, zona FROM incidents""",
)
def ingest_all_clashing(spark, folder):
    """One column is a number in one dataset and text in the other."""
    rows = incidents(spark, folder)
    city = rows.select("ipat", "hora", "edad", F.col("a_o").cast("long").alias("zona"))
    landed = {"city": _land(spark, city, "city"), "region": _land(spark, rows.select("ipat", "hora", "edad", "zona"), "region")}
    return datasets.ingest_all(spark, landed, scratch_path(spark, "clean"))


@query(
    "ingest_retention",
    """SELECT 'orders' AS dataset, count(*) AS "rows", count(*) FILTER (o_orderkey % 3 > 0) AS kept,
    round(count(*) FILTER (o_orderkey % 3 > 0) / count(*) * 100, 6) AS percent FROM orders""",
)
def ingest_retention(spark, folder):
    status = F.when(F.col("o_orderkey") % 3 > 0, F.col("o_orderstatus"))
    rows = read(spark, folder, "orders").select(F.col("o_orderkey").cast("string").alias("code"), status.alias("status"))
    landed = {"orders": _land(spark, rows, "orders")}
    kept = datasets.ingest_retention(spark, landed, scratch_path(spark, "clean"), drop_any=True)
    return kept.withColumn("percent", F.round("percent", 6))


def line_extractor():
    """A page extractor for plain text: every line is a page.

    A function made within a function travels to the workers by value, so they need no
    copy of this package.
    """

    def extract(content: bytes) -> list[tuple[int, str]]:
        return list(enumerate(content.decode("utf-8").split("\n"), start=1))

    return extract


# Documents in a landed file.
ROWS_PER_FILE = 2_000

_PAGES_SQL = """SELECT doc_id, CAST(unnest(generate_series(1, len(lines))) AS BIGINT) AS page_no, unnest(lines) AS text
    FROM (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents)"""


def _document_files(spark, folder):
    return read(spark, folder, "documents").select("doc_id", F.encode("text", "UTF-8").alias("content"))


@query("extract_pages", f"SELECT *, CAST(NULL AS VARCHAR) AS error FROM ({_PAGES_SQL})")
def extract_pages(spark, folder):
    return pages.extract_pages(_document_files(spark, folder), line_extractor(), "doc_id")


@query("incremental_extract", _PAGES_SQL)
def incremental_extract(spark, folder):
    cache = scratch_path(spark, "page-cache")
    documents = _document_files(spark, folder)
    labelled = documents.join(read(spark, folder, "labels").select("doc_id").distinct(), "doc_id", "left_semi")
    pages.incremental_extract(labelled, cache, line_extractor(), "doc_id")
    return pages.incremental_extract(documents, cache, line_extractor(), "doc_id")


def lines_of_file():
    """A page extractor for text files: every line is a page, taken out of the file when its turn comes."""

    def extract(content: bytes) -> Iterator[tuple[int, str]]:
        number = start = 0
        while (end := content.find(b"\n", start)) >= 0:
            number += 1
            yield number, content[start:end].decode("utf-8")
            start = end + 1

    return extract


@query("extract_new_files", "SELECT unnest(string_split(text, chr(10))) AS text FROM documents")
def extract_new_files(spark, folder):
    """Text files land in two goes, and each is read once."""
    landing, cache = scratch_path(spark, "landing"), scratch_path(spark, "page-cache")
    texts = read(spark, folder, "documents")
    for part in (F.col("doc_id") % 2 == 0, F.col("doc_id") % 2 != 0):
        # Files do not grow with the table: one is held whole by the task that reads it.
        landed = texts.where(part).select("text").write.option("maxRecordsPerFile", ROWS_PER_FILE)
        landed.mode("append").text(landing)
        found = pages.extract_new_files(pages.list_files(spark, landing, "*.txt"), cache, lines_of_file())
    return found.select("text")


def whole_extractor(reverse: bool):
    """The whole text as one page; reversed text stands for a costly way to read a file."""

    def extract(content: bytes) -> list[tuple[int, str]]:
        text = content.decode("utf-8")
        return [(1, text[::-1] if reverse else text)]

    return extract


@query(
    "extract_documents",
    r"""SELECT doc_id, 0::BIGINT AS part_no, 1::BIGINT AS n_pages, length(text) AS chars, text, method FROM (
    SELECT doc_id, regexp_replace('--- PÁGINA 1 ---' || chr(10) || CASE WHEN long THEN text ELSE reverse(text) END, '\s+$', '') AS text,
      CASE WHEN long THEN 'primary' ELSE 'fallback' END AS method
    FROM (SELECT doc_id, text, length(regexp_replace('--- PÁGINA 1 ---' || chr(10) || text, '\s+$', '')) > 100 AS long FROM documents))""",
)
def extract_documents(spark, folder):
    return pages.extract_documents(
        _document_files(spark, folder), whole_extractor(False), whole_extractor(True), "doc_id"
    )


@query(
    "report_text",
    "WITH " + checks.report_ctes("orders", checks.ORDERS)
    + f"\nSELECT section || ' | ' || item || ': ' || {checks.number('value')} AS \"value\" FROM report",
)
def report_text(spark, folder):
    orders = read(spark, folder, "orders")
    return spark.read.text(files.write_report(report.dataset_report(orders), scratch_path(spark, "report")))
