"""Bulk-synchronous best-fit packing of token sequences.

Documents longer than the capacity are cut into full pieces, the first one shorter. A piece of more than half
the capacity fits no gap that such a piece leaves, so each has a sequence of its own. The others are placed by
bands of lengths, the longest first, in rounds:

* Sort: the band's pieces and the gaps that can hold one of them are range-partitioned by size, from the largest
  down, and sorted within the ranges.
* Sweep: each task goes down its range. A gap waits; a piece takes its successor, the smallest gap that waits.
  Pieces that have the same successor get it by rank: the longest one has it, the next takes the gap above it. A
  gap that holds several pieces of the band at least waits as often.
* Carry: a task reports how many pieces found no gap in its range and how many places still wait. From these two
  numbers a task, the driver says which range's places each range's pieces take, and the executors join them by rank.
* Update: gaps shrink by what they took, and the next round begins. Where no gap holds any piece that is left, new
  sequences begin, as many as the pieces left fill at least.

Ties in size are ordered by id, which splits them over ranges. The number of sequences is that of best-fit
decreasing on the tests' inputs; small lengths share one band, so one more now and then is possible.

Nulls: a null text is an empty document of the end id alone. Rows with a null or repeated doc_id are
packed like others; other columns are ignored, whatever they are called. A text of any length is pieces of the
capacity. An empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, few_tasks, short_batches, side, texts
from .repair import with_end
from .tokens import encoder

CAPACITY = 1024
PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids."""
    first = n % capacity or min(n, capacity)
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


def pieces(docs: DataFrame, tokenizer_path: str, end_id: int = 2, capacity: int = CAPACITY) -> DataFrame:
    """The pieces of every document, with their checksums; the ids themselves don't move."""
    short_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer_path)
        for b in batches:
            if not b.num_rows:
                continue
            flat, n = with_end(*enc.encode(b.column(1)), end_id)
            view = memoryview(flat.astype("<u4")).cast("B")
            doc, piece, start, length, crc = [], [], [], [], []
            at = 0
            for i, k in enumerate(n.tolist()):
                for j, (s, m) in enumerate(cut(k, capacity)):
                    doc.append(i)
                    piece.append(j)
                    start.append(s)
                    length.append(m)
                    crc.append(zlib.crc32(view[4 * (at + s) : 4 * (at + s + m)]))
                at += k
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(doc, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return texts(docs).mapInArrow(run, PIECE)


SWEPT = "what int, part int, rank long, pid long, sid long, size long, until long"
_PAIR, _PIECE, _GAP, _SUM = range(4)


def places(gap: int, longest: int) -> int:
    """How many pieces of a band a gap holds at least, and one that may fit."""
    return max(1, gap // longest)


def _sweep(longest: int) -> object:
    """Rows (down, is_piece, id, part) of one range, sorted: pairs (pid, sid, size), then what is left of the range and how much of it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, stack, alone = 0, [], 0

        def made(what: int, rows: list[tuple[int, int, int, int, int]]) -> pa.RecordBatch:
            columns = [pa.array(c, pa.int64()) for c in zip(*rows, strict=True)]
            return pa.RecordBatch.from_arrays([pa.array([what] * len(rows), pa.int32()), pa.array([part] * len(rows), pa.int32()), *columns], names=[c.split()[0] for c in SWEPT.split(", ")])

        for b in batches:
            pairs, left = [], []
            part = b.column(3)[0].as_py() if b.num_rows else part
            for down, is_piece, i in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                if not is_piece:
                    stack.append([i, -down, places(-down, longest)])
                elif stack:
                    top = stack[-1]
                    pairs.append((0, i, top[0], -down, 0))
                    top[2] -= 1
                    if not top[2]:
                        stack.pop()
                else:
                    left.append((alone, i, 0, -down, 0))
                    alone += 1
            yield from (made(w, rows) for w, rows in ((_PAIR, pairs), (_PIECE, left)) if rows)
        waiting, rows = 0, []
        for sid, gap, n in stack:
            rows.append((waiting, 0, sid, gap, waiting + n))
            waiting += n
            if len(rows) == 1 << 14:
                yield made(_GAP, rows)
                rows = []
        if rows:
            yield made(_GAP, rows)
        if alone or waiting:
            yield made(_SUM, [(alone, 0, 0, 0, waiting)])

    return run


def carried(sums: list[tuple[int, int, int]]) -> tuple[list[tuple[int, int, int, int, int]], dict[int, int]]:
    """sums (range, pieces without a gap, places that wait), from the largest sizes down, to (range of the places, first place,
    end, range of the pieces, rank of the piece at the last place) and how many pieces of each range get one. At most two rows a range."""
    waiting: list[tuple[int, int, int]] = []
    out, got = [], {}
    for part, alone, open_ in sums:
        rank = 0
        while rank < alone and waiting:
            of, first, end = waiting.pop()
            n = min(alone - rank, end - first)
            out.append((of, end - n, end, part, rank))
            rank += n
            if end - n > first:
                waiting.append((of, first, end - n))
        got[part] = rank
        if open_:
            waiting.append((part, 0, open_))
    return out, got


def _round(scratch: Scratch, left: DataFrame, gaps: DataFrame, shortest: int, longest: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """left (pid, length), gaps (sid, gap) to (pairs (pid, sid, length), what is left, the gaps after it)."""
    spark = left.sparkSession
    rows = left.select((-F.col("length")).alias("down"), F.lit(True).alias("is_piece"), F.col("pid").alias("id"))
    rows = rows.union(gaps.where(F.col("gap") >= shortest).select(-F.col("gap"), F.lit(False), F.col("sid")))
    order = ["down", "is_piece", "id"]
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())  # a task may sweep several, one after the other
    swept = scratch.write(few_tasks(ranged.mapInArrow(_sweep(longest), SWEPT)), "swept")
    sums = sorted((r["part"], r["rank"], r["until"]) for r in swept.where(F.col("what") == _SUM).collect())  # one row a task
    plan, got = carried(sums)
    pairs = swept.where(F.col("what") == _PAIR).select("pid", "sid", F.col("size").alias("length"))
    alone = swept.where(F.col("what") == _PIECE)
    after = alone
    if plan:
        links = spark.createDataFrame(plan, "part int, first long, end long, to_part int, to_rank long")
        waits = swept.where(F.col("what") == _GAP).select("part", "sid", F.col("rank").alias("from"), "until").join(F.broadcast(links), "part")
        waits = waits.withColumn("lo", F.greatest("from", "first")).withColumn("hi", F.least("until", "end")).where("lo < hi")
        taken = waits.select("sid", F.col("to_part").alias("part"), "end", "to_rank", F.explode(F.expr("sequence(lo, hi - 1)")).alias("place"))
        taken = taken.select("sid", "part", (F.col("to_rank") + F.col("end") - 1 - F.col("place")).alias("rank"))
        pairs = scratch.write(few_tasks(pairs.union(alone.join(taken.withColumnRenamed("sid", "of"), ["part", "rank"]).select("pid", F.col("of").alias("sid"), F.col("size").alias("length")))), "pairs")
        count = spark.createDataFrame(list(got.items()), "part int, got long")
        after = alone.join(F.broadcast(count), "part").where("rank >= got")
    shrunk = gaps.union(pairs.select("sid", -F.col("length"))).groupBy("sid").agg(F.sum("gap").alias("gap")).where("gap > 0")
    return pairs, after.select("pid", F.col("size").alias("length")), scratch.write(few_tasks(shrunk), "gaps")


def pack(spark: SparkSession, made: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """made: rows of pieces(), already written, since they are read more than once."""
    scratch = Scratch(spark, "packing")
    made = scratch.write(made.withColumn("pid", F.monotonically_increasing_id()), "numbered")  # the numbers stay as written
    sizes = {r["length"]: r["count"] for r in made.groupBy("length").count().collect()}  # at most one row a length
    placed = [made.where(2 * F.col("length") > capacity).select("pid", F.col("pid").alias("sid"), "length", F.lit(0).alias("round"))]
    gaps = placed[0].select("sid", (capacity - F.col("length")).alias("gap")).where("gap > 0")
    widest = max([capacity - n for n in sizes if 2 * n > capacity], default=0)
    rest = sorted((n for n in sizes if 2 * n <= capacity), reverse=True)
    n_new = 0
    while rest:
        low = rest[0] // 2 if 8 * rest[0] > capacity else 0
        band, rest = [n for n in rest if n > low], [n for n in rest if n <= low]
        left = made.where(F.col("length").between(band[-1], band[0])).select("pid", "length")
        n, total, shortest, longest = sum(sizes[x] for x in band), sum(x * sizes[x] for x in band), band[-1], band[0]
        while n:
            if widest < shortest:
                more = max(1, total // capacity)
                gaps = gaps.union(spark.range(n_new + 1, n_new + 1 + more).select((-F.col("id")).alias("sid"), F.lit(capacity).cast("long").alias("gap")))
                n_new += more
            before, (pairs, left, gaps) = gaps, _round(scratch, left, gaps, shortest, longest)
            scratch.drop(before)
            placed.append(pairs.select("pid", "sid", "length", F.lit(len(placed)).alias("round")))
            stats = left.select("length", F.lit(0).cast("long").alias("gap")).union(gaps.select(F.lit(None).cast("long"), "gap"))
            n, total, shortest, longest, widest = stats.agg(F.count("length"), F.sum("length"), F.min("length"), F.max("length"), F.coalesce(F.max("gap"), F.lit(0))).first()
    all_placed = placed[0]
    for p in placed[1:]:
        all_placed = all_placed.union(p)
    before = Window.partitionBy("sid").orderBy("round", "pid").rowsBetween(Window.unboundedPreceding, -1)  # a sequence's pieces, capacity at most
    at = all_placed.select("pid", F.col("sid").alias("sequence_id"), F.coalesce(F.sum("length").over(before), F.lit(0)).cast("long").alias("offset"))
    return made.join(side(at), "pid").select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def packed(spark: SparkSession, docs: DataFrame, tokenizer_path: str, end_id: int = 2, capacity: int = CAPACITY) -> DataFrame:
    return pack(spark, pieces(docs, tokenizer_path, end_id, capacity), capacity)
