"""Column role queries."""

from __future__ import annotations

from ..operators import roles
from .incidents import WITH, incidents
from .registry import query, read

ACCOUNT_ROLES = {
    "name": ("name",),
    "nation": ("nationkey",),
    "balance": ("account_balance", "acctbal"),
    "segment": ("mktsegment",),
}


@query(
    "harmonise_columns",
    """SELECT 'customer' AS dataset, c_name AS name, c_nationkey AS nation, c_acctbal AS balance, c_mktsegment AS segment
    FROM customer UNION ALL SELECT 'supplier', s_name, s_nationkey, s_acctbal, NULL FROM supplier""",
)
def harmonise_columns(spark, folder):
    tables = {name: read(spark, folder, name) for name in ("customer", "supplier")}
    return roles.harmonise_columns(tables, ACCOUNT_ROLES)


_FOUND = {
    "tipo_siniestro": "clase_siniestro", "tiempo": "jornada", "zona": "zona", "genero": "genero", "gravedad": None,
    "fecha": "fecha", "barrio": "barrios_corregimiento_via", "direccion": "direccion", "latitud": "lat",
    "longitud": "long",
}


@query(
    "detected_roles",
    WITH + "\nUNION ALL\n".join(
        f"""SELECT 'incidents' AS dataset, '{role}' AS role, {f"'{c}'" if c else "CAST(NULL AS VARCHAR)"} AS "column",
        {f"count({c})" if c else "CAST(0 AS BIGINT)"} AS "values", CAST(15 AS BIGINT) AS n_columns
        FROM {"incidents" if c else "(SELECT 1)"}"""
        for role, c in _FOUND.items()
    ),
)
def detected_roles(spark, folder):
    return roles.detected_roles({"incidents": incidents(spark, folder)})


@query(
    "role_breakdown",
    WITH + """SELECT 'genero' AS role, 'genero' AS "column", genero AS "value", count(*) AS "count" FROM incidents
    WHERE genero IS NOT NULL GROUP BY genero""",
)
def role_breakdown(spark, folder):
    return roles.role_breakdown(incidents(spark, folder))
