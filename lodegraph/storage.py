"""Lineage cuts in the shared checkpoint folder of the session, and how joins deal their sides."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows, of a few values each, that a join may broadcast.
FEW = 1 << 14


def cut(df: DataFrame) -> DataFrame:
    """The rows, checkpointed in spark.checkpoint.dir; a folder of our own only where that is unset and all runs on this machine, as in tests."""
    spark = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(folder or tempfile.mkdtemp(prefix="lodegraph-"))
    return df.checkpoint(eager=True)


def side(df: DataFrame, rows: int | None = None) -> DataFrame:
    """A side of a join: broadcast if it has FEW rows at most, shuffled with the other side if it has more or their number isn't known.

    The planner takes a table to be as large as its compressed files, and rows exploded from it no larger; what it
    broadcasts by that measure grows with the input and has to fit the driver.
    """
    return F.broadcast(df) if rows is not None and rows <= FEW else df.hint("merge")


#: Rows, of a few values each, that a task takes in: some hundreds of MB once they are sorted and put in hash tables.
ROWS = 1 << 20


def dealt(df: DataFrame, rows: int | None, *columns: str) -> DataFrame:
    """df for a join or an aggregate by these columns, in tasks of ROWS rows at most on average, and no fewer than the session's shuffle
    partitions, since a join would deal fewer again. Where all cores hold the rows, or their number isn't known,
    the planner deals them: by the compressed bytes of a shuffle, which say little of what they take in memory, or by a fixed number
    of partitions."""
    if rows is None or rows <= ROWS * df.sparkSession.sparkContext.defaultParallelism:
        return df
    return df.repartition(max(-(-rows // ROWS), int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))), *columns)


def together(parts: list[DataFrame]) -> DataFrame:
    """Their union. Each part gets columns of its own, since what Spark knows of a checkpointed table may speak of columns that it
    no longer has, and a union of two such tables fails to plan."""
    own = [part.select(*[F.col(c).alias(c) for c in part.columns]) for part in parts]
    out = own[0]
    for part in own[1:]:
        out = out.union(part)
    return out
