"""Counter-based uniforms: the same draw for the same key in any engine and partitioning."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def u01(*key) -> Column:
    """Uniform in [0, 1) from the md5 of the key's parts joined by '|'."""
    parts = [k.cast("string") if isinstance(k, Column) else F.lit(str(k)) for k in key]
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts).cast("binary")), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def u01_sql(*key: str) -> str:
    """The same in DuckDB's SQL; parts are SQL expressions."""
    return f"(('0x'||substr(md5(concat_ws('|',{','.join(key)})),1,8))::BIGINT/4294967296.0)"
