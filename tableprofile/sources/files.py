"""Table files: header CSV with inferred types, JSON records, Parquet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.names import column
from ..functions.numbers import NUMBER_PATTERN
from ..operators.cleaning import normalise_na
from ..operators.report import report_lines

CSV_OPTIONS = {
    "header": True,
    "escape": '"',
    "ignoreLeadingWhiteSpace": False,
    "ignoreTrailingWhiteSpace": False,
}

WHOLE_NUMBER = r"^\s*[+-]?[0-9]+\s*$"
# The spellings of truth values in a text table.
TRUE_TOKENS = ("True", "TRUE", "true")
FALSE_TOKENS = ("False", "FALSE", "false")


def infer_types(df: DataFrame) -> DataFrame:
    """Give the text columns the types that all their values fit.

    One aggregate over the table decides between bigint, double, boolean and string for
    all columns at once. Dates stay text. A column without values becomes double.
    """
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    if not texts:
        return df

    def unfit(c: Column, fits: Column) -> Column:
        return F.count_if(c.isNotNull() & ~F.coalesce(fits, F.lit(False)))

    checks = []
    for name in texts:
        c = column(name)
        checks += [
            unfit(c, c.rlike(WHOLE_NUMBER) & c.try_cast("bigint").isNotNull()),
            unfit(c, c.rlike(NUMBER_PATTERN)),
            unfit(c, c.isin(*TRUE_TOKENS, *FALSE_TOKENS)),
            F.count(c),
        ]
    found = list(df.agg(*(c.alias(f"c{i}") for i, c in enumerate(checks))).first())
    typed = {}
    for i, name in enumerate(texts):
        c, (not_whole, not_number, not_boolean, filled) = column(name), found[4 * i : 4 * i + 4]
        if filled and not not_whole:
            typed[name] = c.try_cast("bigint")
        elif not not_number:
            typed[name] = c.try_cast("double")
        elif not not_boolean:
            typed[name] = c.isin(*TRUE_TOKENS)
    return df.withColumns(typed) if typed else df


def scan_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None, multiline: bool = False) -> DataFrame:
    """A CSV file or folder with a header; NA tokens are null.

    Without a schema the types are inferred from all rows, which costs one more scan.
    ``multiline`` allows line breaks within quotes; a file is then one task's, which
    ``scan_csv_records`` avoids.
    """
    reader = spark.read.options(**CSV_OPTIONS, multiLine=multiline)
    texts = reader.csv(path)
    first = texts.columns[0]
    if first.startswith("\ufeff"):
        texts = texts.withColumnRenamed(first, first.lstrip("\ufeff"))
    texts = normalise_na(texts)
    if schema is None:
        return infer_types(texts)
    wanted = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    return texts.select(*(column(f.name).try_cast(f.dataType).alias(f.name) for f in wanted.fields))


def csv_records(spark: SparkSession, path: str) -> DataFrame:
    """(file, first_line, record): the text of every CSV record, line breaks within quotes included.

    A line begins a record if the quotes before it, in its file, are even in number; doubled
    quotes leave that as it is. Whether a split of a file begins within quotes is not known
    while it is read, so each split reports the parity of its quotes, a sum over the splits
    before gives the state at its beginning, and lines are then numbered and joined. Files
    are read by as many tasks as they have splits; a group holds one record's lines.
    ``first_line`` orders the records of a file. Blank lines between records are left out.
    """
    lines = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("split"),
        F.monotonically_increasing_id().alias("line"),  # rises within a split
        F.col("value"),
        (F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))).alias("quotes"),
    )
    in_split = Window.partitionBy("file", "split").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    splits_before = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    # A row a split.
    states = lines.groupBy("file", "split").agg(F.sum("quotes").alias("quotes"), F.count(F.lit(1)).alias("lines"))
    states = states.select(
        "file",
        "split",
        (F.coalesce(F.sum("quotes").over(splits_before), zero) % 2).alias("open"),
        F.coalesce(F.sum("lines").over(splits_before), zero).alias("lines_before"),
    )
    placed = (
        lines.withColumn("_quotes", F.coalesce(F.sum("quotes").over(in_split), zero))
        .withColumn("_line", F.count(F.lit(1)).over(in_split))
        .join(states, ["file", "split"])
        .select("file", "split", "value", (F.col("lines_before") + F.col("_line")).alias("line"), ((F.col("_quotes") + F.col("open")) % 2 == 0).alias("begins"))
    )
    upto_line = Window.partitionBy("file", "split").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    begun = placed.withColumn("first_line", F.max(F.when(F.col("begins"), F.col("line"))).over(upto_line))
    # Lines before the first beginning of a split go on with the last record of the splits before.
    last = begun.groupBy("file", "split").agg(F.max("first_line").alias("last"))
    going_on = last.select("file", "split", F.max("last").over(splits_before).alias("last_before"))
    joined = begun.join(going_on, ["file", "split"]).withColumn("first_line", F.coalesce("first_line", "last_before"))
    records = joined.groupBy("file", "first_line").agg(F.array_sort(F.collect_list(F.struct("line", "value"))).alias("lines"))
    text = F.array_join(F.transform("lines", lambda x: x["value"]), "\n")
    return records.select("file", "first_line", F.rtrim(text, F.lit("\r")).alias("record")).where(F.col("record") != "")


def scan_csv_records(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """``scan_csv`` with ``multiline``, but every file is split over many tasks.

    The columns are those of the header of the first file; all files have the same.
    """
    header = spark.read.options(**CSV_OPTIONS, multiLine=True).csv(path).columns  # reads the beginning of a file
    names = [header[0].lstrip("\ufeff"), *header[1:]]
    records = csv_records(spark, path).where("first_line > 0").select("record")
    options = {k: str(v).lower() if isinstance(v, bool) else v for k, v in CSV_OPTIONS.items() if k != "header"}
    texts = ", ".join(f"`{n.replace('`', '``')}` string" for n in names)
    parsed = records.select(F.from_csv("record", texts, options).alias("r")).select("r.*")
    cleaned = normalise_na(parsed)
    if schema is None:
        return infer_types(cleaned)
    wanted = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    return cleaned.select(*(column(f.name).try_cast(f.dataType).alias(f.name) for f in wanted.fields))


def scan_json_records(
    spark: SparkSession,
    path: str,
    limit: int | None = None,
    schema: T.StructType | str | None = None,
    multiline: bool = False,
) -> DataFrame:
    """Landed JSON records: one object per line, or one array of objects per line.

    Keys that a record lacks are null. ``multiline`` reads files that hold one array
    spread over many lines, each of them in one task. A missing path raises.
    """
    reader = spark.read if schema is None else spark.read.schema(schema)
    records = reader.option("mode", "FAILFAST").json(path, multiLine=multiline)
    return records if limit is None else records.limit(limit)


def write_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by: tuple[str, ...] = ()) -> str:
    """Write the table as a folder of part files and return the path.

    The write replaces the folder, so a job that is run again gives the same table.
    """
    writer = df.write.mode("overwrite").partitionBy(*partition_by)
    if fmt == "csv":
        writer.options(**CSV_OPTIONS).csv(path)
    else:
        writer.format(fmt).save(path)
    return path


def write_report(report: DataFrame, path: str) -> str:
    """Write a dataset report as text, a few lines per table column, in one ordered file."""
    report_lines(report).coalesce(1).write.mode("overwrite").text(path)
    return path
