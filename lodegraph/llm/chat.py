"""Chat formatting as a prefix tree, written once depth-first.

A turn becomes a segment <|im_start|>role\\ntext<|im_end|>\\n, with control strings inside escaped so that
they can be told from the template's and come back exactly. Conversations that begin with the same turns
share these segments. Sorted by the hashes of their prefixes, conversations stand in the order of a
depth-first walk of the tree: each adds what it doesn't share with the one before. Ranges of that order are
written by different tasks, so a first turn that many conversations share is no single task's work; only
the last path of each range goes to the driver, which gives every range its place in the stream and the
ancestors that it takes over.

Every segment has its place in the stream, the position of its first unit in the conversation, the stream
intervals of its ancestors (with its own, causally, all that it may attend to) and the part under the loss
mask, which is the text of an assistant's turn. A unit is a code point, or a token if a tokenizer is given.

Turns stand by turn, then role and text, nulls first. A null role or text is an empty one; rows with a null
conv_id are one conversation; repeated rows are turns of their own. An empty table gives no rows. A
conversation is one row and so has to fit a task; the number of conversations that share turns doesn't. Texts may be of
any length within it. Columns besides conv_id, turn, role and text are ignored, whatever they are called.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, short_batches, shuffle_parts
from .tokens import encoder

START, END = "<|im_start|>", "<|im_end|>"

_SEGMENT = "depth: int, text: string, ids: array<int>, start: long, length: long, position: long, mask_from: long, mask_to: long"
_ROW = f"conv_id long, part int, seq long, shared int, taken int, places array<long>, lengths array<long>, path binary, segments array<struct<{_SEGMENT}>>"


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def unescape(text: str) -> str:
    out, at = [], 0
    while (i := text.find("\\", at)) >= 0:
        out.append(text[at:i])
        out.append({"n": "\n"}.get(text[i + 1], text[i + 1]))
        at = i + 2
    return "".join([*out, text[at:]])


def segment(role: str, text: str) -> tuple[str, str, str]:
    """What stands before the text, the text, and what stands after it."""
    return f"{START}{escape(role).replace(chr(10), chr(92) + 'n')}\n", escape(text), f"{END}\n"


def parse(segment_: str) -> tuple[str, str]:
    """(role, text) of a segment."""
    if not segment_.startswith(START) or not segment_.endswith(f"{END}\n"):
        raise ValueError("not a segment")
    role, _, text = segment_[len(START) : -len(END) - 1].partition("\n")
    return unescape(role), unescape(text)


def _hashes(turns: list[dict]) -> bytes:
    """16 bytes for each prefix of the conversation, one after the other."""
    out, before = [], b""
    for t in turns:
        role, text = t["role"].encode(), t["text"].encode()
        before = hashlib.blake2b(before + len(role).to_bytes(8, "little") + role + text, digest_size=16).digest()
        out.append(before)
    return b"".join(out)


def _common(a: bytes, b: bytes) -> int:
    n = 0
    while 16 * n < min(len(a), len(b)) and a[16 * n : 16 * n + 16] == b[16 * n : 16 * n + 16]:
        n += 1
    return n


def _units(parts: tuple[str, str, str], tokenizer_path: str | None) -> tuple[list[int], list[int] | None]:
    if tokenizer_path is None:
        return [len(p) for p in parts], None
    ids, n = encoder(tokenizer_path).encode(pa.array(parts))
    return n.tolist(), ids.tolist()


def _intervals(way: list[int], lengths: list[int]) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """The stream intervals of the segments on the way down, those that adjoin as one; for each depth how many of them hold
    what is above it, and where the last of these ends there."""
    seen: list[tuple[int, int]] = []
    above = []
    for w, n in zip(way, lengths, strict=True):
        above.append((len(seen), seen[-1][1] if seen else 0))
        if seen and seen[-1][1] == w:
            seen[-1] = (seen[-1][0], w + n)
        else:
            seen.append((w, w + n))
    return seen, above


#: Conversations that read a segment from one place; more read copies of it.
SHARED = 20_000


def tree(spark: SparkSession, conversations: DataFrame, tokenizer_path: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(segments, paths): the stream, one row for each distinct segment in the order of `start`, and for each
    conversation the segments' starts on its way down the tree."""
    short_batches(spark)
    scratch = Scratch(spark, "chat")
    turn = F.struct(F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    whole = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), turn.alias("t")).groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            paths = [_hashes(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(paths, pa.binary())], names=["conv_id", "turns", "path"])

    turns = "array<struct<turn: long, role: string, text: string>>"
    sorted_ = whole.mapInArrow(hashed, f"conv_id long, turns {turns}, path binary").repartitionByRange(shuffle_parts(spark), "path", "conv_id").sortWithinPartitions("path", "conv_id")

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        before: bytes | None = None
        places: list[int] = []  # of the segments on the way down, from the range's own begin
        lengths: list[int] = []
        at = seq = taken = 0
        for b in batches:
            rows = []
            for conv, turns_, path in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                shared = _common(before, path) if before is not None else 0
                taken = len(turns_) if before is None else min(taken, shared)  # that deep an earlier range may have been
                del places[shared:], lengths[shared:]
                made = []
                for depth in range(shared, len(turns_)):
                    parts = segment(turns_[depth]["role"], turns_[depth]["text"])
                    n, ids = _units(parts, tokenizer_path)
                    loss = turns_[depth]["role"] == "assistant"
                    made.append({"depth": depth, "text": "".join(parts), "ids": ids, "start": at, "length": sum(n), "position": sum(lengths), "mask_from": n[0] if loss else 0, "mask_to": n[0] + n[1] if loss else 0})
                    places.append(at)
                    lengths.append(sum(n))
                    at += sum(n)
                rows.append((conv, part, seq, shared, taken, list(places), list(lengths), path, made))
                before, seq = path, seq + 1
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _TYPES, strict=True)], names=_NAMES)

    walked = scratch.write(sorted_.mapInArrow(walk, _ROW), "walk")
    ends = walked.groupBy("part").agg(F.min_by(F.struct("path", "lengths"), "seq").alias("first"), F.max_by(F.struct("path", "places", "lengths", "taken"), "seq").alias("last"), F.sum(F.aggregate("segments", F.lit(0).cast("long"), lambda a, s: a + s["length"])).alias("n")).orderBy("part").collect()  # one row a range
    ranges: dict[int, tuple[int, int, list[int]]] = {}  # part: where it begins, how much of its first conversation went before, places of that
    path, places, begin = b"", [], 0
    for r in ends:
        shared = _common(path, r["first"]["path"])
        gone = sum(r["first"]["lengths"][:shared])
        ranges[r["part"]] = (begin - gone, shared, places[:shared])
        last, keep = r["last"], min(shared, r["last"]["taken"])
        path, places = last["path"], [*places[:keep], *(p + begin - gone for p in last["places"][keep:])]
        begin += r["n"] - gone

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: dict[str, list] = {"conv_id": [], "path": [], "segments": []}
            for r in b.to_pylist():
                shift, shared, above = ranges[r["part"]]
                keep = min(shared, r["taken"])
                way = [*above[:keep], *(p + shift for p in r["places"][keep:])]
                skip = shared if r["seq"] == 0 else 0
                seen, upto = _intervals(way, r["lengths"])
                new = []
                for s in r["segments"]:
                    if s["depth"] >= skip:
                        d = s["depth"]
                        new.append(s | {"start": s["start"] + shift, "attends": [{"from": f, "to": e if i + 1 < upto[d][0] else upto[d][1]} for i, (f, e) in enumerate(seen[: upto[d][0]])]})
                out["conv_id"].append(r["conv_id"])
                out["path"].append(way)
                out["segments"].append(new)
            yield pa.RecordBatch.from_arrays([pa.array(out["conv_id"], pa.int64()), pa.array(out["path"], pa.list_(pa.int64())), pa.array(out["segments"], pa.list_(_WITH_ATTENDS))], names=list(out))

    full = f"conv_id long, path array<long>, segments array<struct<{_SEGMENT}, attends: array<struct<from: long, to: long>>>>"
    written = scratch.write(walked.mapInArrow(placed, full), "stream")
    return written.select(F.explode("segments").alias("s")).select("s.*"), written.select("conv_id", "path")


_SEGMENT_TYPE = pa.struct([("depth", pa.int32()), ("text", pa.string()), ("ids", pa.list_(pa.int32())), ("start", pa.int64()), ("length", pa.int64()), ("position", pa.int64()), ("mask_from", pa.int64()), ("mask_to", pa.int64())])
_WITH_ATTENDS = pa.struct([*_SEGMENT_TYPE, pa.field("attends", pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())])))])
_TYPES = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.list_(_SEGMENT_TYPE)]
_NAMES = ["conv_id", "part", "seq", "shared", "taken", "places", "lengths", "path", "segments"]

READ_BACK = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def read_back(segments: DataFrame, paths: DataFrame) -> DataFrame:
    """The conversations again, from the stream of code points alone: each from the segments on its way down."""
    steps = paths.select("conv_id", F.posexplode("path").alias("depth", "start"))
    hot = steps.groupBy("start").agg(F.ceil(F.count(F.lit(1)) / SHARED).alias("copies")).where("copies > 1")  # one in SHARED steps at most
    steps = steps.join(F.broadcast(hot), "start", "left").withColumn("copy", F.pmod(F.xxhash64("conv_id"), F.coalesce("copies", F.lit(1))))
    copies = segments.select("start", "text", "mask_from", "mask_to").join(F.broadcast(hot), "start", "left").withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("copies", F.lit(1)) - 1))).drop("copies")
    lines = steps.drop("copies").join(copies, ["start", "copy"])
    whole = lines.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("depth", "text", "mask_from", "mask_to"))).alias("turns"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for conv, turns in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                said, loss, n_loss = hashlib.sha256(), hashlib.sha256(), 0
                for t in turns:
                    role, text = parse(t["text"])
                    said.update(f"{role}\n{text}\n".encode())
                    masked = unescape(t["text"][t["mask_from"] : t["mask_to"]])
                    loss.update(masked.encode())
                    n_loss += len(masked)
                out.append((conv, len(turns), said.hexdigest(), n_loss, loss.hexdigest(), sum(len(t["text"]) for t in turns)))
            if out:
                types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=[x.split()[0] for x in READ_BACK.split(", ")])

    return whole.mapInArrow(run, READ_BACK)
