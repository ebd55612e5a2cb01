"""Unit tables of the column functions."""

import sys
import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tableprofile import functions as fn
from tableprofile.functions.text import WHITESPACE, _accent_table, normalise_name

HOURS = {
    "7:05": "07:05", "14;30": "14:30", "14::30": "14:30", " 9:5 ": "09:05", "24:00": None, "12:30:00": None,
    "7": None, "": None, "310": "03:10", "1430": "14:30", "14 : 30": "14:30", "14: :30": None, "12:60": None,
    "1:30PM": None, "14305": None, None: None, "+7:30": "07:30", "-0:30": "00:30", "-1:30": None, "007:05": "07:05",
    "310.0": None, "23:59": "23:59", "0:0": "00:00", ":30": None, "12:": None, "\t8:15\n": "08:15", "ab:cd": None,
    "7.5:30": None, " 7:05": "07:05", "99": None, "07:05\n": "07:05", "2460": None, "12:\t5": "12:05",
}
DECIMALS = {
    "3,5361": 3.5361, "-76,30": -76.3, "1.234,5": None, "no aplica": None, "1e2": 100.0, "1.5d": None, " 4,0 ": 4.0,
    None: None, "1.5f": None, ".5": 0.5, "5.": 5.0, "+2,5": 2.5, "": None, "nan": None, "0x10": None, "1_0": None,
    "inf": float("inf"), "1,5e-3": 0.0015, "--1": None, "\t4\n": 4.0, " inf ": float("inf"), "4 5": None, "-Infinity": float("-inf"),
}
NORMALISED = {
    "Dirección": "direccion", "direcci_n": "direccin", "AÑO 2023": "ano2023", "___": "", "é": "e", "ÅNGSTRÖM": "angstrom",
    "ﬁ": "", "½": "", "Straße": "strae",
}
TITLES = {"NO REPORTA": "No Reporta", "o'neil": "O'Neil", "1-URGENT": "1-Urgent", "año nuevo": "Año Nuevo", "a1b": "A1B"}
URLS = {
    "https://h.org/resource/ab.json?$limit=5#x": "https://h.org/resource/ab.json",
    "https://h.org/resource/ab/": "https://h.org/resource/ab.json",
    "https://h.org/resource/ab//?q=1": "https://h.org/resource/ab.json",
    "HTTP://h.org/ab;v=1?q": "http://h.org/ab.json",
    "no address": None, "": None, None: None,
}
SLUGS = {"City data-2024": "city_data_2024.csv", "plain": "plain.csv"}
REPORTS = {"City data-2024": "reporte_city_data-2024.txt"}
TOKENS = {t: None for t in fn.NA_TOKENS} | {"na": "na", "x": "x", " NA": " NA", "-": "-"}
WORDS = {"": 0, "  ": 0, "one": 1, " two\twords\n": 2, "a b c": 3, "x\x1cy": 2}


def _check(spark, table, function):
    df = spark.createDataFrame([(i, k) for i, k in enumerate(table)], "i int, v string")
    got = {r.i: r.o for r in df.select("i", function(F.col("v")).alias("o")).collect()}
    assert {k: got[i] for i, k in enumerate(table)} == table


@pytest.mark.parametrize(
    "table, function",
    [
        (HOURS, fn.fix_hour),
        (DECIMALS, fn.parse_decimal),
        (NORMALISED, fn.normalise_text),
        (TITLES, fn.title_case),
        (URLS, fn.normalise_url),
        (SLUGS, fn.dataset_slug),
        (REPORTS, fn.report_file_name),
        (TOKENS, fn.na_to_null),
        (WORDS, fn.word_count),
    ],
    ids=lambda x: getattr(x, "__name__", ""),
)
def test_unit_table(spark, table, function):
    _check(spark, table, function)


def _clock(text):
    """The hour rule, spelled out for one value."""
    text = text.strip().replace(";", ":").replace("::", ":").replace(" ", "")
    if ":" not in text and len(text) in (3, 4):
        text = text[:-2] + ":" + text[-2:]
    parts = text.split(":")
    if len(parts) != 2 or "_" in text or not text.isascii():
        return None
    try:
        h, m = map(int, parts)
    except ValueError:
        return None
    return f"{h:02}:{m:02}" if 0 <= h < 24 and 0 <= m < 60 else None


@settings(max_examples=8, deadline=None)
@given(st.lists(st.text(alphabet="0123456789:; +-", max_size=7), min_size=80, max_size=200))
def test_fix_hour_equals_the_rule_on_any_text(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "v string")
    for r in df.select("v", fn.fix_hour(F.col("v")).alias("o")).collect():
        assert r.o == _clock(r.v), r.v


def test_hours_and_decimals_of_numbers(spark):
    df = spark.sql("SELECT 310 AS i, 310.0D AS d, float('nan') AS n, 1e-5D AS s")
    row = df.select(
        fn.fix_hour(F.col("i")).alias("hi"),
        fn.fix_hour(F.col("d")).alias("hd"),
        fn.parse_decimal(F.col("d")).alias("pd"),
        fn.parse_decimal(F.col("n")).alias("pn"),
        fn.locale_decimal(F.col("d")).alias("ld"),
        fn.locale_decimal(F.col("i")).alias("li"),
    ).first()
    assert row == ("03:10", None, 310.0, None, "310,0", "310")


def test_accent_table_covers_all_of_unicode():
    folded = dict(zip(*_accent_table()))
    for code in range(0x80, sys.maxunicode + 1):
        head = unicodedata.normalize("NFD", chr(code))[0]
        if head.isascii() and head.isalnum():
            assert folded[chr(code)] == head


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(max_size=20), min_size=50, max_size=100))
def test_normalise_text_equals_normalise_name_and_words_equal_split(spark, texts):
    texts = [t.replace("\x00", "").encode("utf-8", "ignore").decode() for t in texts]
    df = spark.createDataFrame([(t,) for t in texts], "v string")
    for r in df.select("v", fn.normalise_text(F.col("v")).alias("o"), fn.word_count(F.col("v")).alias("w")).collect():
        assert r.o == normalise_name(r.v)
        assert r.w == len(r.v.split())


def test_whitespace_is_what_strip_removes():
    assert all(c.isspace() for c in WHITESPACE)
    assert not any(chr(c).isspace() for c in range(0x3001, sys.maxunicode + 1))


def test_dates_follow_the_format_list(spark):
    df = spark.createDataFrame([("2023-05-01",), ("01/06/2023",), ("2023-05-01 10:00:00",), ("soon",), (None,)], "v string")
    got = [r.m for r in df.select(fn.month_label(fn.parse_timestamp(F.col("v"))).alias("m")).collect()]
    assert got == ["2023-05", "2023-06", "2023-05", None, None]


def test_preview_and_truncation(spark):
    df = spark.createDataFrame([("añb",), ("a",)], "v string")
    rows = df.select(fn.text_preview(F.col("v"), 2).alias("p"), fn.truncate_text(F.col("v"), 2).alias("t")).collect()
    assert [(r.p, r.t.text, r.t.truncated) for r in rows] == [("añ", "añ", True), ("a", "a", False)]


def test_uniform_numbers_depend_on_the_key_only(spark):
    df = spark.range(2000)
    u = fn.uniform_from_key(F.col("id"), 7, "x")
    one = {r.id: r.u for r in df.repartition(3).select("id", u.alias("u")).collect()}
    two = {r.id: r.u for r in df.repartition(11).select("id", u.alias("u")).collect()}
    assert one == two
    assert all(0 <= v < 1 for v in one.values())
    assert 0.45 < sum(one.values()) / len(one) < 0.55
