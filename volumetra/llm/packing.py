"""Packing by minimum bin slack.

A piece is known by its length alone, so the plan is made from the histogram of
lengths (at most `size` numbers, whatever the corpus). For each bin a bitset
subset-sum over the lengths still there, largest first and the largest of all
always in, finds the fullest combination; it is taken out as often as the
counts allow. A plan has a bounded number of rows: every pattern leaves at least
one length with fewer copies than that pattern takes.

Pieces are then ranked within their length. Ranks come from counts of hashed
buckets of about RANKED pieces plus a row number inside the bucket, so a length
that a third of all pieces share is ranked by many tasks.

Null texts are empty: one piece that holds the end token. Repeated rows are
packed once each.
"""

from __future__ import annotations

import zlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from volumetra.llm.bpe import ByteUnits, ready
from volumetra.llm.common import Scratch, batches, ship

RANKED = 50_000


def cut_points(length: int, size: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document: one, or full pieces after a first that may be shorter."""
    if length <= size:
        return [(0, length)]
    first = length % size
    starts = ([0] if first else []) + list(range(first, length, size))
    return [(s, min(size, first - s) if s < first else size) for s in starts]


def pieces(docs: DataFrame, tokenizer: str, ranks: str | None = None, size: int = 1024, end: int = 2, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and, if asked for, ids (little-endian unsigned 32-bit)."""
    ship(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    tail = end.to_bytes(4, "little")

    def run(frames):
        units = ready(ByteUnits, tokenizer, ranks)
        for batch in batches(frames, 4.0):
            which, rows = [], []
            for n, text in enumerate(batch.column("text").to_pylist()):
                ids = units.encode(text) + tail
                for i, (a, k) in enumerate(cut_points(len(ids) // 4, size)):
                    part = ids[4 * a : 4 * (a + k)]
                    which.append(n)
                    rows.append((i, a, k, zlib.crc32(part), part))
            piece, start, length, crc, part = zip(*rows)
            columns = [batch.column("doc_id").take(pa.array(which)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                columns, names = [*columns, pa.array(part, pa.binary())], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(columns, names)

    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + (", ids binary" if with_ids else "")
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def fullest(counts: dict[int, int], size: int) -> dict[int, int]:
    """The combination with the largest sum up to size that holds the largest length."""
    seed = max(counts)
    room = size - seed
    mask = (1 << (room + 1)) - 1
    sums, taken = 1, []
    for length in sorted(counts, reverse=True):
        if length > room:
            continue
        left, step = min(counts[length] - (length == seed), room // length), 1
        while left > 0 and not sums >> room:
            n = min(step, left)
            left, step = left - n, 2 * step
            taken.append((length, n, sums))
            sums |= (sums << (n * length)) & mask
        if sums >> room:
            break
    at = sums.bit_length() - 1
    out = {seed: 1}
    for length, n, before in reversed(taken):
        if not before >> at & 1:
            out[length] = out.get(length, 0) + n
            at -= n * length
    return out


def plan(counts: dict[int, int], size: int) -> list[tuple[int, int, int, int, int, int]]:
    """(length, lo, hi, first sequence, copies in a sequence, offset of the first): ranks lo..hi-1 of a length."""
    counts = {k: n for k, n in counts.items() if n}
    used: dict[int, int] = {}
    out, sequence = [], 0
    while counts:
        combination = fullest(counts, size)
        times = min(counts[k] // n for k, n in combination.items())
        offset = 0
        for k in sorted(combination, reverse=True):
            n = combination[k]
            lo = used.get(k, 0)
            used[k] = lo + n * times
            out.append((k, lo, used[k], sequence, n, offset))
            offset += k * n
            counts[k] -= n * times
            if not counts[k]:
                del counts[k]
        sequence += times
    return out


def pack(cut: DataFrame, size: int = 1024) -> DataFrame:
    """cut (doc_id, piece, start, length, ids_crc32, more) with sequence_id and offset. Reads cut twice: pass a written table."""
    spark = cut.sparkSession
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `size` rows
    if not counts:
        return cut.select("*", F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    buckets = spark.createDataFrame([(k, max(1, -(-n // RANKED))) for k, n in counts.items()], "length long, n_buckets long")
    places = spark.createDataFrame(plan(counts, size), "p_length long, lo long, hi long, base long, copies long, at long")
    salted = cut.join(F.broadcast(buckets), "length").withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "start", "ids_crc32"), F.col("n_buckets"))).drop("n_buckets")
    before = salted.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    before = before.select("length", "bucket", (F.sum("n").over(W.partitionBy("length").orderBy("bucket")) - F.col("n")).alias("before"))
    ranked = salted.withColumn("rank", F.row_number().over(W.partitionBy("length", "bucket").orderBy("doc_id", "piece", "start", "ids_crc32")))
    ranked = ranked.join(before, ["length", "bucket"]).withColumn("rank", F.col("rank") - 1 + F.col("before"))
    placed = ranked.join(F.broadcast(places), (F.col("length") == F.col("p_length")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")))
    past = F.col("rank") - F.col("lo")
    return placed.select(
        *cut.columns,
        (F.col("base") + F.floor(past / F.col("copies"))).cast("long").alias("sequence_id"),
        (F.col("at") + F.pmod(past, F.col("copies")) * F.col("length")).cast("long").alias("offset"),
    )


def pack_documents(docs: DataFrame, tokenizer: str, ranks: str | None = None, size: int = 1024, end: int = 2) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every document. Texts are encoded once."""
    cut = Scratch(docs.sparkSession, "packing").save(pieces(docs, tokenizer, ranks, size, end), "pieces")
    return pack(cut, size)
