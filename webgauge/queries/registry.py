"""Where queries register."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(oracle: str | None = None) -> Callable[[Query], Query]:
    """Register a function under its name, with the SQL that gives the same rows."""

    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if oracle:
            ORACLE[f.__name__] = oracle
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Parts that heavy rows are dealt to, for each core and for each part the table is read in, and the rows of
#: a part where that makes more of them, so that tasks don't grow with the table.
DEALT, DEALT_ROWS = 4, 2000


def dealt(rows: DataFrame, a_part: int | None = None) -> DataFrame:
    """Rows of a table for work that is heavy on each, dealt evenly to several parts a core, and to more of a large table (its
    files' footers give the count).  How a table is read says little of where its rows are: no split divides a row group, and
    a file of few of them leaves most parts empty.  ``a_part`` rows make a part at most (``DEALT_ROWS`` where none are given)."""
    least = DEALT * max(rows.sparkSession.sparkContext.defaultParallelism, rows.rdd.getNumPartitions())
    return rows.repartition(max(least, -(-rows.count() // (a_part or DEALT_ROWS))))


def long(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("long")


def six(c: Column) -> Column:
    """Six digits, rounded half up, so that both engines give the same double."""
    return F.floor(c * 1000000.0 + 0.5) / 1000000.0


def sql_six(e: str) -> str:
    return f"floor(({e}) * CAST(1000000 AS DOUBLE) + CAST(0.5 AS DOUBLE)) / CAST(1000000 AS DOUBLE)"


def sql_list(values) -> str:
    return "(" + ", ".join("'" + str(v).replace("'", "''") + "'" for v in values) + ")"


def sql_values(rows) -> str:
    cell = lambda v: "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)
    return "(VALUES " + ", ".join("(" + ", ".join(map(cell, r)) + ")" for r in rows) + ")"


def sql_tokens(e: str) -> str:
    word = r"[\p{L}\p{N}][\p{L}\p{N}''’-]*"
    return f"list_filter(list_transform(regexp_extract_all(lower({e}), '{word}'), lambda w: regexp_replace(w, '^[-''’]+|[-''’]+$', '', 'g')), lambda w: w <> '')"
