"""Cutting lineage in loops, numbering rows and sending small tables, without a task or a driver that holds all rows."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: rows of a table that is sent to every task
MOST_SENT = 100_000


def cut(df: DataFrame) -> DataFrame:
    """The rows of ``df``, computed and kept in the folder that ``spark.checkpoint.dir`` names. Where it is unset, a folder of this session's own in local mode, and an error on a cluster."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not re.match(r"local($|\[)", context.master):
                raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            folder = tempfile.mkdtemp(prefix="crosswalk-")
        context.setCheckpointDir(folder)
    return df.checkpoint()


def sent(df: DataFrame, most: int = MOST_SENT) -> DataFrame:
    """``df`` marked to be sent to every task if it has ``most`` rows or fewer; as it is beyond, where the join shuffles."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def dealt(df: DataFrame, rows: int, *keys: str, each: int = 500_000) -> DataFrame:
    """``df``, of which about ``rows`` rows are expected, dealt by ``keys`` to as many tasks as hold about ``each`` of them, whatever the settings: so what a task holds doesn't grow with the table."""
    return df.repartition(max(1, -(-rows // each)), *keys)


def numbered(df: DataFrame, order: list, name: str) -> DataFrame:
    """Rows numbered from 1 in an order: sorted in ranges, counted in each, and moved up by the rows of the ranges before."""
    at = cut(df.orderBy(*order).withColumn("__at", F.monotonically_increasing_id()))
    part = F.shiftright("__at", 33)
    held = at.groupBy(part.alias("__part")).agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row a range
    first = held.select("__part", before.alias("__before"))
    return at.withColumn("__part", part).join(sent(first), "__part").withColumn(name, (F.col("__before") + F.col("__at").bitwiseAND((1 << 33) - 1) + 1).cast("int")).drop("__at", "__part", "__before")
