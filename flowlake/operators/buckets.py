"""Neighbouring rows of a long history without one window over the whole of it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def with_edges(rows: DataFrame, keys: list[str], bucket: str, order: list[str], after: bool = False) -> DataFrame:
    """Rows, and in every bucket of a key the last row of the bucket before it (``after``: the first of the next), marked ``edge``.

    Buckets follow ``order``. ``lag`` (``lead``) over (keys, bucket) then finds what it would find over the keys alone, and a
    key that holds a third of all rows spreads over as many tasks as it has buckets. The only window per key is over one row
    per bucket, which a partial aggregate makes.
    """
    names = [c for c in rows.columns if c not in (*keys, bucket)]
    pick, near = (F.min_by, F.lead) if after else (F.max_by, F.lag)
    ends = rows.groupBy(*keys, bucket).agg(pick(F.struct(*names), F.struct(*order)).alias("_end"))
    carried = ends.withColumn("_end", near("_end").over(Window.partitionBy(*keys).orderBy(bucket))).where("_end IS NOT NULL")
    carried = carried.select(*keys, bucket, "_end.*", F.lit(True).alias("edge"))
    return rows.select(*keys, bucket, *names, F.lit(False).alias("edge")).unionByName(carried)
