"""Order MinHash fingerprints, in DataFrame functions only.

The pieces of a text are its words; a word of more than PIECE_CHARS characters gives all its runs of PIECE_CHARS
characters, one from each place, so that an inserted character changes few of them. K consecutive pieces are a k-mer,
whatever the length of the text; a text of fewer pieces is one k-mer. Equal k-mers are numbered by their occurrence in the text, so that repeats count. A hash deals the
numbered k-mers into BINS; of each bin the TUPLE smallest are taken, put back into the order of the text and
hashed together. Two texts agree in a bin only if they have the same smallest k-mers in the same order, so
moved text lowers the likeness as well as changed text does. Dealing one hash into bins takes the place of
BINS separate permutations: the text is sorted twice, whatever the number of bins.

The likeness of two fingerprints is the share of equal bins among those that either has. Empty texts have
the empty fingerprint; two of these have the likeness 1, one and another text 0.

The next document is the next row by doc_id (then by the text's hash; null ids first); the last one's is the
first. Ranges of ids find it without a global sort: each range also gets the first row of the range after. An id
with more rows than a range (a repeated or a null one) is ranges of its own, cut by the texts' hashes.
Nulls: a null text is an empty one. Repeated rows are rows of their own, next to each other. An empty table gives
no rows. Texts of any length are worked on by expressions alone; a row has to fit a task. Columns besides doc_id
and text are ignored, whatever they are called.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, texts

PIECE_CHARS, K, BINS_LOG2, TUPLE = 8, 3, 6, 2
#: A piece is group 1: a short word as a whole, or the run from one place of a long word.
_PIECE = f"(?=(\\\\S{{1,{PIECE_CHARS}}}+))(?:(?<!\\\\S)\\\\S{{1,{PIECE_CHARS}}}+(?!\\\\S)|\\\\S(?=\\\\S{{{PIECE_CHARS - 1}}}))"
#: Rows of one range, about. Ranges come in two levels, MAX_COARSE * MAX_FINE at most, since a bound and a first row of
#: each go to all tasks: some MB, whatever the input. Beyond 131 million rows ranges grow; a range is sorted on disk.
RANGE_ROWS, MAX_COARSE, MAX_FINE = 1000, 512, 256
_POS = 28  # bits of a place in the text
_LOW = (1 << _POS) - 1
_TOP = 63 - BINS_LOG2


def codes(df: DataFrame, text: str, out: str) -> DataFrame:
    """Adds the fingerprint as an array of (bin << 24 | tuple hash). Each step is a column of its own that the
    next one reads more than once, so it is evaluated once a row and not once an element."""
    w, k, p, q, s = (f"_{x}_{out}" for x in "wkpqs")
    run = f"shiftright(v, {_POS})"
    search = (
        f"aggregate(sequence(1, 2 + cast(log2(i + 1) as int)), named_struct('lo', 0, 'hi', i), "
        f"(a, x) -> if(a.lo < a.hi, if(shiftright({p}[(a.lo + a.hi) div 2], {_POS}) < {run}, named_struct('lo', cast((a.lo + a.hi) div 2 as int) + 1, 'hi', a.hi), named_struct('lo', a.lo, 'hi', cast((a.lo + a.hi) div 2 as int))), a), a -> a.lo)"
    )
    occurrence = f"case when i = 0 then 0 when shiftright({p}[i - 1], {_POS}) <> {run} then 0 else i - {search} end"
    binned = f"transform({p}, (v, i) -> named_struct('h', xxhash64({run}, {occurrence}), 'p', v & {_LOW}L))"
    df = df.withColumn(w, F.expr(f"transform(regexp_extract_all({text}, '{_PIECE}', 1), x -> xxhash64(x))"))
    df = df.withColumn(k, F.expr(f"case when size({w}) >= {K} then transform(slice({w}, 1, size({w}) - {K - 1}), (x, i) -> xxhash64(x, {', '.join(f'{w}[i + {j}]' for j in range(1, K))})) when size({w}) > 0 then array(xxhash64({w})) else cast(array() as array<bigint>) end"))
    df = df.withColumn(p, F.expr(f"sort_array(transform({k}, (x, i) -> shiftleft(x, {_POS}) + i))"))
    df = df.withColumn(q, F.expr(f"sort_array(transform({binned}, e -> shiftleft(e.h & {(1 << BINS_LOG2) - 1}L, {_TOP}) + shiftleft(shiftrightunsigned(e.h, {BINS_LOG2}) & {(1 << (_TOP - _POS)) - 1}L, {_POS}) + e.p))"))
    df = df.withColumn(s, F.expr(f"filter({q}, (v, i) -> i < {TUPLE} or shiftright({q}[i - {TUPLE}], {_TOP}) <> shiftright(v, {_TOP}))"))
    first, other = f"{k}[cast(v & {_LOW}L as int)]", f"{k}[cast({s}[i + 1] & {_LOW}L as int)]"
    same = f"coalesce(shiftright(get({s}, i + 1), {_TOP}) = shiftright(v, {_TOP}), false)"
    pair = f"case when not {same} then xxhash64({first}) when (v & {_LOW}L) < ({s}[i + 1] & {_LOW}L) then xxhash64({first}, {other}) else xxhash64({other}, {first}) end"
    made = f"transform({s}, (v, i) -> case when i = 0 or shiftright({s}[i - 1], {_TOP}) <> shiftright(v, {_TOP}) then cast(shiftleft(shiftright(v, {_TOP}), 24) + ({pair} & 16777215L) as int) end)"
    return df.withColumn(out, F.expr(f"filter({made}, c -> c is not null)")).drop(w, k, p, q, s)


def fingerprint(code: Column) -> Column:
    return F.array_join(F.transform(code, lambda c: F.lower(F.lpad(F.hex(c), 8, "0"))), "")


def likeness(a: Column, b: Column) -> Column:
    bins = lambda c: F.transform(c, lambda x: F.shiftright(x, 24))
    either = F.size(F.array_union(bins(a), bins(b)))
    return F.when(either == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / either)


def _below(array: str, value: str, steps: int) -> Column:
    """How many bounds of a sorted array are below the value, by binary search."""
    mid = "cast((a.lo + a.hi) div 2 as int)"
    step = f"(a, x) -> if(a.lo < a.hi, if({array}[{mid}] < {value}, named_struct('lo', {mid} + 1, 'hi', a.hi), named_struct('lo', a.lo, 'hi', {mid})), a)"
    return F.expr(f"aggregate(sequence(1, {steps}), named_struct('lo', 0, 'hi', size({array})), {step}, a -> a.lo)")


def _ranges(scratch: Scratch, ids: DataFrame) -> tuple[DataFrame, Column, int]:
    """(coarse, bounds, by_hash) of the ranges of (_id, _h), MAX_COARSE * 2 rows at most; the cuts between coarse ones, and the steps of a search in these."""
    n = ids.count()
    coarse = min(MAX_COARSE, max(1, n // (2 * RANGE_ROWS)))
    fine = min(MAX_FINE, max(2, n // (coarse * RANGE_ROWS)))
    cuts = ids.agg(F.percentile_approx("_id", [i / coarse for i in range(1, coarse)], 10 * coarse)).first()[0] or [] if coarse > 1 else []
    lowest = -(1 << 63)
    cuts = sorted({b for b in cuts if b > lowest} | {b - 1 for b in cuts if b > lowest + 1 and cuts.count(b) > 1} | {lowest + 1 for b in cuts if b == lowest})
    array = F.array(*[F.lit(b).cast("long") for b in cuts]) if cuts else F.array().cast("array<bigint>")
    some = ids.withColumn("_cuts", array)
    share = [i / fine for i in range(1, fine)]
    by = some.groupBy(_below("_cuts", "_id", len(cuts).bit_length() + 1).alias("coarse")).agg(F.min("_id").alias("low"), F.max("_id").alias("high"), *[F.array_distinct(F.percentile_approx(c, share, 10 * fine)).alias(c) for c in ("_id", "_h")])
    by = by.select("coarse", (F.col("low") == F.col("high")).alias("by_hash"), F.when(F.col("low") == F.col("high"), F.col("_h")).otherwise(F.col("_id")).alias("bounds"))
    return scratch.write(by, "ranges"), array, len(cuts).bit_length() + 1


def with_next(spark: SparkSession, rows: DataFrame, carried: list[str]) -> DataFrame:
    """rows (doc_id, text, …) with next_<column> of the row after, for the carried columns."""
    scratch = Scratch(spark, "next")
    rows = rows.withColumn("_id", F.coalesce("doc_id", F.lit(-(1 << 63)))).withColumn("_h", F.xxhash64("text"))
    ids = rows.select("_id", "_h")
    ranges, cuts, steps = _ranges(scratch, ids)

    def placed(df: DataFrame) -> DataFrame:
        df = df.withColumn("_cuts", cuts).withColumn("coarse", _below("_cuts", "_id", steps)).drop("_cuts")
        df = df.join(F.broadcast(ranges), "coarse").withColumn("_value", F.expr("if(by_hash, _h, _id)"))
        return df.withColumn("fine", _below("bounds", "_value", MAX_FINE.bit_length() + 1)).drop("bounds", "by_hash", "_value")

    firsts = scratch.write(placed(ids).groupBy("coarse", "fine").agg(F.min(F.struct("_id", "_h")).alias("_first")), "firsts")  # one row a range
    order = Window.orderBy("coarse")
    last = firsts.groupBy("coarse").agg(F.max("fine").alias("last"))  # one row a coarse range
    last = last.select("coarse", F.coalesce(F.lag(F.struct("coarse", "last")).over(order), F.max_by(F.struct("coarse", "last"), "coarse").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("before"))
    inner = F.lag("fine").over(Window.partitionBy("coarse").orderBy("fine"))
    guests = firsts.withColumn("inner", inner).join(F.broadcast(last), "coarse")
    guests = guests.select(F.col("_first._id").alias("_id"), F.col("_first._h").alias("_h"), F.when(F.col("inner").isNotNull(), F.struct("coarse", F.col("inner").alias("fine"))).otherwise(F.struct(F.col("before.coarse"), F.col("before.last").alias("fine"))).alias("_guest_of"))
    at = placed(rows).join(F.broadcast(guests), ["_id", "_h"], "left")
    own = F.struct(F.col("coarse"), F.col("fine"), F.lit(False).alias("guest"))
    guest = F.when(F.col("_guest_of").isNotNull(), F.struct(F.col("_guest_of.coarse"), F.col("_guest_of.fine"), F.lit(True).alias("guest")))
    at = at.withColumn("_at", F.explode(F.array_compact(F.array(own, guest)))).select("*", F.col("_at.coarse").alias("_coarse"), F.col("_at.fine").alias("_fine"), F.col("_at.guest").alias("_guest")).drop("_guest_of", "_at", "coarse", "fine")
    here = Window.partitionBy("_coarse", "_fine").orderBy("_guest", "_id", "_h")  # plain columns and one select: one exchange for all
    at = at.select("*", *[F.lead(c).over(here).alias(f"next_{c}") for c in carried])
    return at.where(~F.col("_guest")).drop("_coarse", "_fine", "_guest", "_id", "_h")


def fingerprints(spark: SparkSession, docs: DataFrame) -> DataFrame:
    rows = codes(texts(docs), "text", "code")
    rows = with_next(spark, rows, ["text", "code"])
    n = F.char_length("text")
    rows = rows.select("doc_id", n.cast("long").alias("n_chars"), "code", "next_code", F.concat(F.expr("substring(text, 1, char_length(text) - cast(floor(char_length(text) / 4) as int))"), F.expr("substring(next_text, 1, cast(floor(char_length(text) / 4) as int))")).alias("edited"))
    rows = codes(rows, "edited", "edited_code")
    return rows.select("doc_id", "n_chars", F.sha2(F.col("edited"), 256).alias("edited_sha256"), fingerprint(F.col("code")).alias("fingerprint"), fingerprint(F.col("edited_code")).alias("edited_fingerprint"), likeness(F.col("code"), F.col("edited_code")).alias("near_edited"), likeness(F.col("code"), F.col("next_code")).alias("near_next"))
