"""A join that splits the keys which hold too many rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_SALT, _PARTS = "_salt", "_parts"
#: A key is split when it holds more than one part in so many of a task's fair share.
FINENESS = 16


def heavy_keys(facts: DataFrame, key: str, tasks: int, *, fineness: int = FINENESS) -> DataFrame:
    """``key, _parts``: the keys with more rows than a ``fineness``-th of a task's fair share, and in how many parts they go.

    Fewer than ``tasks * fineness`` keys can be that heavy, however many rows
    and keys there are: the result may be broadcast.
    """
    counts = facts.groupBy(key).agg(F.count(F.lit(1)).alias("_held"))
    fair = counts.agg((F.sum("_held") / (tasks * fineness)).alias("fair")).scalar()
    return counts.where(F.col("_held") > fair).select(key, F.ceil(F.col("_held") / fair).cast("int").alias(_PARTS))


def split_join(facts: DataFrame, units: DataFrame, key: str, *, tasks: int | None = None) -> DataFrame:
    """``facts`` inner join ``units`` on ``key``, heavy keys in parts.

    A heavy key's facts are dealt to its parts by a hash of the row, and its
    rows in ``units`` (the small side of a key) are copied to each part. Counts
    come from the key column alone, combined before their shuffle.
    """
    spark = facts.sparkSession
    heavy = F.broadcast(heavy_keys(facts, key, tasks or int(spark.conf.get("spark.sql.shuffle.partitions"))))
    parts = F.coalesce(F.col(_PARTS), F.lit(1))
    salted = facts.join(heavy, key, "left").withColumn(_SALT, F.pmod(F.xxhash64(*facts.columns), parts).cast("int")).drop(_PARTS)
    copied = units.join(heavy, key, "left").withColumn(_SALT, F.explode(F.sequence(F.lit(0), parts - 1))).drop(_PARTS)
    return salted.join(copied, [key, _SALT]).drop(_SALT)
