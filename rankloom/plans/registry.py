"""Registry of checked queries: Spark builder + DuckDB oracle text per key."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}
# oracles whose text needs the sample tables to be generated (column lists read with DESCRIBE)
LAZY_ORACLES: dict[str, Callable[[str], str]] = {}

def register(name: str, oracle: str | None = None):
    """Register a Spark builder (spark, sf_dir) -> DataFrame under ``name``."""
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn
    return deco


def finish(df: DataFrame) -> DataFrame:
    """Widen integers, booleans and floats to the types the oracles return; no value changes."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.FloatType):
            c = c.cast("double")
        elif isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType, T.BooleanType)):
            c = c.cast("bigint")
        elif isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.FloatType):
            c = c.cast("array<double>")
        elif isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType,
                                                                (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("array<bigint>")
        out.append(c.alias(f.name))
    return df.select(*out)


def by_position(df: DataFrame, vector: str, *keys: str) -> DataFrame:
    """A computed vector as rows (keys, position from 1, value), so each value compares as a scalar."""
    return df.select(*keys, F.posexplode(vector).alias("p", "value")).select(
        *keys, (F.col("p") + 1).cast("bigint").alias("position"), F.col("value").cast("double").alias("value"))


def sql_by_position(sql: str, vector: str, *keys: str) -> str:
    """The same rows from an oracle that returns whole vectors."""
    cols = "".join(k + ", " for k in keys)
    return (f"SELECT {cols}CAST(generate_subscripts({vector}, 1) AS BIGINT) AS position, "
            f"CAST(unnest({vector}) AS DOUBLE) AS value FROM (\n{sql}\n) AS _v")


def normalise_oracle(sql: str, sample_dir: str) -> str:
    """Wrap an oracle text with the same normalisation ``finish`` applies.

    Column types are read with DESCRIBE against the small sample tables (types
    do not depend on the data). Integers become BIGINT, floats and decimals DOUBLE.
    """
    con = _duck_con(sample_dir)
    desc = con.execute(f"DESCRIBE {sql}").fetchall()
    rep = []
    for name, typ, *_ in desc:
        q = '"' + name.replace('"', '""') + '"'
        t = typ.upper()
        if t.endswith("[]"):
            inner = t[:-2]
            if inner in ("FLOAT", "REAL") or inner.startswith("DECIMAL"):
                rep.append(f"CAST({q} AS DOUBLE[]) AS {q}")
            elif inner in ("INTEGER", "SMALLINT", "TINYINT", "HUGEINT"):
                rep.append(f"CAST({q} AS BIGINT[]) AS {q}")
        elif t in ("FLOAT", "REAL") or t.startswith("DECIMAL"):
            rep.append(f"CAST({q} AS DOUBLE) AS {q}")
        elif t in ("INTEGER", "SMALLINT", "TINYINT", "HUGEINT", "UBIGINT", "UINTEGER", "BOOLEAN"):
            rep.append(f"CAST({q} AS BIGINT) AS {q}")
    if not rep:
        return sql
    return f"SELECT * REPLACE ({', '.join(rep)}) FROM (\n{sql}\n) AS _q"


_CON = {}


def _duck_con(sample_dir: str):
    import duckdb

    from ..fixtures import TABLES
    if sample_dir not in _CON:
        con = duckdb.connect()
        for t in TABLES:
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sample_dir}/{t}.parquet')")
        _CON[sample_dir] = con
    return _CON[sample_dir]
