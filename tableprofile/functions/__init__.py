"""Column expressions: one Column in, one Column out, no Python workers."""

from .clock import fix_hour
from .dates import month_label, parse_timestamp
from .missing import NA_TOKENS, is_missing, na_to_null, value_or_null
from .numbers import locale_decimal, parse_decimal
from .sampling import sample_order, uniform_from_key
from .text import (
    dataset_slug,
    normalise_text,
    report_file_name,
    strip_whitespace,
    text_preview,
    title_case,
    truncate_text,
    word_count,
)
from .web import normalise_url

__all__ = [
    "NA_TOKENS",
    "dataset_slug",
    "fix_hour",
    "is_missing",
    "locale_decimal",
    "month_label",
    "na_to_null",
    "normalise_text",
    "normalise_url",
    "parse_decimal",
    "parse_timestamp",
    "report_file_name",
    "sample_order",
    "strip_whitespace",
    "text_preview",
    "title_case",
    "truncate_text",
    "uniform_from_key",
    "value_or_null",
    "word_count",
]
