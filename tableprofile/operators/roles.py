"""Finding columns by what they hold, under differing names."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from os.path import commonprefix

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.missing import is_missing
from ..functions.names import column as named
from ..functions.text import normalise_name
from .profile import value_counts
from .schema import one_row, per_column, union_aligned

Roles = Mapping[str, Sequence[str]]

# The names under which each role is looked for, in order.
INCIDENT_ROLES: Roles = {
    "tipo_siniestro": ("clase_siniestro", "tipo_siniestro", "tipo", "clase"),
    "tiempo": ("jornada", "periodo", "hora", "turno"),
    "zona": ("zona", "area", "sector", "localidad"),
    "genero": ("genero", "sexo", "genero_victima", "sexo_victima"),
    "gravedad": ("gravedad", "severidad", "tipo_herida", "estado"),
    "fecha": ("fecha", "fecha_ocurrencia", "fecha_siniestro", "date", "timestamp"),
    "barrio": ("barrios_corregimiento_via", "barrio", "comuna", "localidad", "sector"),
    "direccion": ("direccion", "direccion_ocurrencia", "address", "via", "calle"),
    "latitud": ("latitud", "lat", "latitude", "y"),
    "longitud": ("longitud", "long", "lon", "longitude", "x"),
}
# Shortest name that may match in part, and the share of it that must agree.
PARTIAL_NAME_LENGTH = 5
PREFIX_SHARE = 0.7


def _alike(column: str, wanted: str) -> bool:
    if not column or not wanted:
        return False
    shorter = min(len(column), len(wanted))
    return (
        column == wanted
        # A one-letter name is part of almost every name, so it must be equal.
        or (len(wanted) > 1 and wanted in column)
        or (len(column) >= PARTIAL_NAME_LENGTH and column in wanted)
        or (
            shorter >= PARTIAL_NAME_LENGTH
            and len(commonprefix((column, wanted))) >= PREFIX_SHARE * shorter
        )
    )


def find_column(columns: Sequence[str], names: Sequence[str]) -> str | None:
    """The first of ``names`` that is a column, else the first column alike to any of them."""
    exact = next((n for n in names if n in columns), None)
    if exact is not None:
        return exact
    wanted = [normalise_name(n) for n in names]
    return next((c for c in columns if any(_alike(normalise_name(c), w) for w in wanted)), None)


def find_roles(df: DataFrame, roles: Roles) -> dict[str, str | None]:
    return {role: find_column(df.columns, names) for role, names in roles.items()}


def harmonise_columns(datasets: Mapping[str, DataFrame], roles: Roles) -> DataFrame:
    """One table of all datasets with a column per role; an absent role is null.

    Columns are found by name at plan time, so each dataset is a pruned scan. A role that is
    text in one dataset and a number in another is text.
    """
    parts = []
    for name, df in datasets.items():
        found = {role: column for role, column in find_roles(df, roles).items() if column is not None}
        parts.append(
            df.select(F.lit(name).alias("dataset"), *(named(c).alias(role) for role, c in found.items()))
        )
    return union_aligned(parts)


def detected_roles(datasets: Mapping[str, DataFrame], roles: Roles = INCIDENT_ROLES) -> DataFrame:
    """(dataset, role, column, values, n_columns): the column found per role, if any."""

    def panel(name: str, df: DataFrame) -> DataFrame:
        found = find_roles(df, roles)
        rows = [F.struct(F.lit(r).alias("role"), F.lit(c).cast("string").alias("column")) for r, c in found.items()]
        used = [f for f in df.schema.fields if f.name in found.values()]
        filled = per_column(df, used or df.schema.fields[:1], {"values": lambda f: F.count_if(~is_missing(f))})
        return (
            one_row(df)
            .select(F.inline(F.array(*rows)))
            .join(filled, "column", "left")
            .select(
                F.lit(name).alias("dataset"),
                "role",
                "column",
                F.coalesce("values", F.lit(0)).alias("values"),
                F.lit(len(df.columns)).cast("long").alias("n_columns"),
            )
        )

    return reduce(DataFrame.unionByName, (panel(name, df) for name, df in datasets.items()))


def role_breakdown(df: DataFrame, wanted: Sequence[str] = ("genero", "gravedad"), roles: Roles = INCIDENT_ROLES) -> DataFrame:
    """Frequencies of the first role of ``wanted`` that the table has."""
    for role in wanted:
        column = find_column(df.columns, roles[role])
        if column is not None:
            return value_counts(df, column).select(F.lit(role).alias("role"), F.lit(column).alias("column"), "value", "count")
    schema = T.StructType().add("role", "string").add("column", "string").add("value", "string").add("count", "long")
    return df.sparkSession.createDataFrame([], schema)
