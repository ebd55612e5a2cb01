"""Endpoint addresses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalise_url(c: Column) -> Column:
    """Scheme, host and path of an address, ending in ``.json``; null without a scheme.

    Query, fragment and the ``;parameters`` of the last path segment are dropped.
    """
    address = F.regexp_extract(c, r"^([A-Za-z][A-Za-z0-9+.-]*://[^?#]*?)(;[^/?#]*)?([?#].*)?$", 1)
    scheme_end = F.instr(address, "://")
    address = F.concat(
        F.lower(F.substring(address, F.lit(1), scheme_end)), F.substring(address, scheme_end + 1, F.length(address))
    )
    return F.when(address == "", None).otherwise(
        F.when(F.endswith(address, F.lit(".json")), address).otherwise(
            F.concat(F.rtrim(address, F.lit("/")), F.lit(".json"))
        )
    )
