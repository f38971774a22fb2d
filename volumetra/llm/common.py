"""What the operators share: scratch tables, shipping code, words, row handling.

Conventions that hold in every operator of this subpackage:

* A null text is an empty text. A null `doc_id` is an ordinary value unless the
  operator's docstring says otherwise. Repeated rows each get their own result.
* Only the columns an operator names are read; others may have any name.
"""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Whitespace of the word rule `[^\x20\x09-\x0D]+`.
ASCII_SPACE = "\t\n\x0b\f\r"
BROADCAST_ROWS = 200_000
FILTER_BITS = 1 << 24
#: While a scratch table is written: it replaces the shuffle files it came from, and the driver keeps short plan texts.
SAVING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.maxPlanStringLength": "4096", "spark.sql.maxMetadataStringLength": "20"}
#: While a table of dear rows is written: small shuffled parts are not put together, so that all cores have work.
DEAR = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "1m"}
HOT, HOT_LEAST, SALTS = 1000, 10_000, 32


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    table = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return table.select(*columns) if columns else table


def whole_text(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package wherever the driver found it."""
    sc = spark.sparkContext
    if getattr(sc, "_volumetra_shipped", False):
        return
    top = Path(__file__).resolve().parents[1]
    folder = tempfile.mkdtemp(prefix="volumetra-ship-")
    archive = os.path.join(folder, "volumetra_pkg.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for p in sorted(top.rglob("*.py")):
            z.write(p, p.relative_to(top.parent))
    sc.addPyFile(archive)
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    sc._volumetra_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; where it is unset, a temporary one on a local master (tests) alone."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    sc = spark.sparkContext
    if not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not getattr(sc, "_volumetra_scratch", None):
        sc._volumetra_scratch = tempfile.mkdtemp(prefix="volumetra-scratch-")
        atexit.register(shutil.rmtree, sc._volumetra_scratch, ignore_errors=True)
    return f"file://{sc._volumetra_scratch}"


class Scratch:
    """Intermediate tables in the shared folder.

    Writing a table and reading it back cuts lineage: a lost executor costs at
    most the stage in hand. `drop` removes a table that nothing reads any more.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.n = 0

    def path(self, name: str) -> str:
        self.n += 1
        return f"{self.root}/{self.n}-{name}"

    def save(self, df: DataFrame, name: str, path: str | None = None, dear: bool = False) -> DataFrame:
        path = path or self.path(name)
        schema = df.schema
        settings = SAVING | (DEAR if dear else {})
        before = {k: self.spark.conf.get(k) for k in settings}
        for k, v in settings.items():
            self.spark.conf.set(k, v)
        try:
            df.write.mode("overwrite").option("compression", "zstd").parquet(path)
        finally:
            for k, v in before.items():
                self.spark.conf.set(k, v)
        out = self.spark.read.schema(schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            path = getattr(t, "_scratch_path", None)
            if path:
                jvm = self.spark.sparkContext._jvm
                p = jvm.org.apache.hadoop.fs.Path(path)
                p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def only(df: DataFrame, ids: DataFrame, column: str, rows: int) -> DataFrame:
    """The rows of df whose column stands in ids, a written table of that many distinct values.

    Up to BROADCAST_ROWS they are broadcast. Beyond, a filter of FILTER_BITS bits is, whatever their number, and what
    passes it meets the ids in a shuffle; so texts that are not wanted stay where they are.
    """
    if rows <= BROADCAST_ROWS:
        return df.join(F.broadcast(ids), column, "left_semi")
    place = F.pmod(F.xxhash64(column), F.lit(FILTER_BITS))
    bits = ids.select(place.alias("at")).groupBy(F.floor(F.col("at") / 64).alias("_word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod("at", F.lit(64)).cast("int"))).alias("_bits"))
    passed = df.withColumn("_at", place).join(F.broadcast(bits), F.floor(F.col("_at") / 64) == F.col("_word"))
    passed = passed.filter(F.call_function("getbit", F.col("_bits"), F.pmod("_at", F.lit(64)).cast("int")) == 1).drop("_at", "_word", "_bits")
    return passed.join(ids, column, "left_semi")


def salted_join(rows: DataFrame, side: DataFrame, key: str, other: str, total: int, how: str = "inner") -> DataFrame:
    """rows joined to side, which has one row a key and n, how many rows have that key; n is dropped.

    Keys of more than 1 / HOT of the total, 2 * HOT of them at most, are broadcast, and their rows dealt by the column
    other to SALTS tasks.
    """
    limit = max(HOT_LEAST, total // HOT)
    if total <= limit:
        return rows.join(side.drop("n"), key, how)
    hot = side.filter(F.col("n") > limit).select(F.col(key).alias("_hot"))
    rows = rows.join(F.broadcast(hot), F.col(key) == F.col("_hot"), "left")
    rows = rows.withColumn("_salt", F.when(F.col("_hot").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64(other), F.lit(SALTS)).cast("int"))).drop("_hot")
    salts = F.when(F.col("n") > limit, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    return rows.join(side.withColumn("_salt", F.explode(salts)).drop("n"), [key, "_salt"], how).drop("_salt")


# --- words -----------------------------------------------------------------


def ascii_words(text: Column) -> Column:
    """Words `[^\\x20\\x09-\\x0D]+`, by plain byte replacement and a split on one character: no regular expression."""
    for c in ASCII_SPACE:
        text = F.replace(text, F.lit(c), F.lit(" "))
    return F.array_remove(F.split(text, " "), "")


def let(value: Column, body) -> Column:
    """body(value) with value computed once: inside a lambda a column expression would be computed per element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64's constants), so that sums of hashes stay spread."""
    h = h.astype(np.uint64, copy=True)
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def word_lists(texts: pa.Array, lower: bool = False) -> tuple[pa.Array, np.ndarray]:
    """(flat words, offsets) of a string array: text i has words offsets[i]..offsets[i+1]."""
    # a cast slice keeps its parent's buffers, which ascii_lower reads from the start; what take returns starts at 0
    texts = pc.fill_null(texts.take(pa.array(np.arange(len(texts)))).cast(pa.large_string()), "")
    if lower:
        texts = pc.ascii_lower(texts)
    parts = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(texts))
    offsets = np.asarray(parts.offsets, dtype=np.int64)
    flat = parts.values
    if offsets[0] or offsets[-1] != len(flat):
        flat = flat.slice(offsets[0], offsets[-1] - offsets[0])
        offsets = offsets - offsets[0]
    keep = np.asarray(pc.greater(pc.binary_length(flat), 0)).astype(bool)
    if not keep.all():
        before = np.concatenate([[0], np.cumsum(keep)])
        flat, offsets = flat.filter(pa.array(keep)), before[offsets]
    return flat, offsets


def word_hashes(flat: pa.Array, seed: int = 0) -> np.ndarray:
    """A 64-bit hash for each word; each distinct word of the batch is hashed once."""
    import xxhash

    if not len(flat):
        return np.zeros(0, np.uint64)
    d = flat.dictionary_encode()
    table = np.fromiter((xxhash.xxh3_64_intdigest(w, seed) for w in d.dictionary.cast(pa.large_binary()).to_pylist()), np.uint64, len(d.dictionary))
    return table[np.asarray(d.indices)]


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words from each position of one flat word array; the last k-1 positions are left out."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.zeros(n, np.uint64)
    for j in range(k):
        h = h * np.uint64(0x9E3779B97F4A7C15) + words[j : j + n]
        h ^= h >> np.uint64(29)
    return mix(h)


def batches(frames, megabytes: float = 8.0, column: str = "text"):
    """Arrow batches cut so that the text in hand stays near the given size."""
    limit = int(megabytes * 1e6)
    for batch in frames:
        if not batch.num_rows:
            continue
        size = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0)).astype(np.int64)
        part = np.cumsum(size) // limit
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(part)) + 1, [batch.num_rows]])
        for a, b in zip(cuts[:-1], cuts[1:]):
            if b > a:
                yield batch.slice(a, b - a)
