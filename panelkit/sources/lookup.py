"""Point lookups in a scored history (P17): rows by hash bucket of the id, sorted inside.

A lookup names its ids as literals. Spark prunes to the buckets that can hold them, and the sorted rows let the Parquet
reader skip row groups by their smallest and largest id. The files are the table; ``open_lookup`` names them in a session.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _name(path: str) -> str:
    return f"panelkit_lookup_{hashlib.sha1(path.encode()).hexdigest()[:16]}"


def write_lookup(df: DataFrame, path: str, key: str, order: list[str] | None = None, buckets: int | None = None) -> None:
    """Write ``df`` to ``path`` in ``buckets`` (as many as shuffle partitions) of ``key``, sorted by key and ``order``."""
    spark = df.sparkSession
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    spark.sql(f"DROP TABLE IF EXISTS {_name(path)}")
    dealt = df.repartition(n, key)  # one file a bucket
    dealt.write.mode("overwrite").bucketBy(n, key).sortBy(key, *(order or [])).option("path", path).saveAsTable(_name(path))


def open_lookup(spark: SparkSession, path: str, schema: str, key: str, buckets: int) -> DataFrame:
    """The table at ``path``, also in a session that did not write it."""
    spark.sql(f"CREATE TABLE IF NOT EXISTS {_name(path)} ({schema}) USING parquet CLUSTERED BY ({key}) INTO {buckets} BUCKETS LOCATION '{path}'")
    return spark.table(_name(path))


def lookup(table: DataFrame, key: str, ids: list) -> DataFrame:
    """The rows of the named ids; ids without a row have none. At most some thousand ids, as a request has."""
    return table.where(F.col(key).isin(list(dict.fromkeys(ids))))
