"""Substring dedup with a log-structured fingerprint index.

A window is WINDOW consecutive words. Of the GRAM-word hashes of a text those
are fingerprints that are the least of WINDOW - GRAM + 1 neighbours (winnowing):
two equal windows choose the same ones, so every shared window shares a
fingerprint, at about a quarter of the windows.

The index is a folder of sorted immutable runs (fp, lo, hi: the smallest and
largest doc_id that has it), each a table bucketed by fp, so that runs are
merge-joined where they lie, without a shuffle. A batch of documents becomes a run
of level 0 and is merge-joined with every historical run, which gives the
fingerprints that two documents share. Two runs of a level are compacted into one
of the next before a batch is added, so a fingerprint is rewritten as often as the
logarithm of the batches. An index can be opened again, and new documents added:
the registered query adds its table in BATCHES batches and compacts once.

Documents with one word sequence are settled first: all but those with the
smallest doc_id lose every word, and only the others meet the index.

Shared fingerprints are then verified: in the documents that have them, every
window around one is hashed in full (96 bits), the smallest doc_id of each hash
is found with partial aggregates, and the words of windows that a smaller
document has are removed.

Rows with one doc_id are one document: their windows never remove each other.
Rows with a null doc_id are left alone and remove nothing. Null and empty texts
have no words; a text of fewer than WINDOW words loses none.
"""

from __future__ import annotations

import hashlib
import uuid
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from volumetra.llm.common import BROADCAST_ROWS, Scratch, batches, gram_hashes, only, salted_join, ship, word_hashes, word_lists

WINDOW, GRAM = 13, 6
SPAN = WINDOW - GRAM + 1
BATCHES = 4


def _slide(x: np.ndarray, n: int, op) -> np.ndarray:
    """op over each n neighbours (n a power of two), by doubling."""
    step = 1
    while step < n:
        x = op(x[:-step], x[step:])
        step *= 2
    return x


def chosen(grams: np.ndarray) -> np.ndarray:
    """Which of a text's gram hashes are the least of some SPAN neighbours."""
    low = _slide(grams, SPAN, np.minimum)
    pad = np.zeros(SPAN - 1, np.uint64)
    return _slide(np.concatenate([pad, low, pad]), SPAN, np.maximum) == grams


def _texts(frames, seeds=(0,)):
    """(batch, row, word hashes per seed, flat words, offsets) row by row."""
    for batch in batches(frames, 4.0):
        flat, offsets = word_lists(batch.column("text"))
        words = [word_hashes(flat, s) for s in seeds]
        yield batch, flat, offsets, words


def sequences(docs: DataFrame, text_out: bool = False) -> DataFrame:
    """doc_id, text_key, n_words, seq (128-bit digest of the words, null below WINDOW words), kept of the unchanged text; docs has doc_id, text, text_key."""
    import xxhash

    ship(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(frames):
        for batch in batches(frames, 4.0):
            n, seq, kept = [], [], []
            for text in batch.column("text").to_pylist():
                words = text.encode("utf-8", "surrogatepass").split()  # bytes: ASCII white space alone
                joined = b" ".join(words)
                n.append(len(words))
                seq.append(xxhash.xxh3_128_digest(joined) if len(words) >= WINDOW else None)
                kept.append(joined.decode("utf-8", "surrogatepass") if text_out else hashlib.sha256(joined).hexdigest())
            columns = [batch.column("doc_id"), batch.column("text_key"), pa.array(n, pa.int64()), pa.array(seq, pa.binary()), pa.array(kept, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text_key", "n_words", "seq", "kept"])

    return docs.select("doc_id", "text", "text_key").mapInArrow(run, f"doc_id {kind}, text_key long, n_words long, seq binary, kept string")


def fingerprints(docs: DataFrame) -> DataFrame:
    """fp, doc_id: the distinct fingerprints of each row with a doc_id."""
    ship(docs.sparkSession)

    def run(frames):
        for batch, _, offsets, (words,) in _texts(frames):
            ids, counts, found = [], [], []
            grams = gram_hashes(words, GRAM)
            for i, d in enumerate(batch.column("doc_id").to_pylist()):
                a, b = offsets[i], offsets[i + 1]
                if d is not None and b - a >= WINDOW:
                    g = grams[a : b - GRAM + 1]
                    g = np.unique(g[chosen(g)])
                    ids.append(d)
                    counts.append(len(g))
                    found.append(g)
            if ids:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64)), pa.array(np.repeat(np.array(ids, np.int64), counts))], ["fp", "doc_id"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "fp long, doc_id long")


class FingerprintIndex:
    """Sorted immutable runs of fingerprints in one folder, which may hold an index already.

    A run's folder is named by its level, its number and its buckets; one that was not written to its end has no _SUCCESS
    file and is not part of the index.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self.id = uuid.uuid4().hex
        #: (level, number, buckets) of each run
        self.runs = []
        path = self._path(folder)
        files = self._files(path)
        if files.exists(path):
            for s in files.listStatus(path):
                kind, *numbers = s.getPath().getName().split("-")
                if kind == "run" and files.exists(self._path(f"{s.getPath()}/_SUCCESS")):
                    self._known(tuple(map(int, numbers)))

    def _path(self, name: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)

    def _files(self, path):
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _place(self, run) -> str:
        return "/".join([self.folder, "-".join(map(str, ("run", *run)))])

    def _table(self, run) -> str:
        return f"fingerprints_{self.id}_{run[1]}"

    def _known(self, run) -> None:
        self.spark.sql(f"CREATE TABLE IF NOT EXISTS {self._table(run)} (fp BIGINT, lo BIGINT, hi BIGINT) USING parquet OPTIONS (path '{self._place(run)}') CLUSTERED BY (fp) SORTED BY (fp) INTO {run[2]} BUCKETS")
        self.runs = sorted([*self.runs, run], key=lambda r: r[1])

    def _write(self, rows: DataFrame, level: int, buckets: int) -> tuple:
        """rows (fp, lo, hi), dealt by fp to so many tasks, as a new run."""
        run = (level, 1 + max((r[1] for r in self.runs), default=0), buckets)
        rows = rows.select("fp", "lo", "hi").sortWithinPartitions("fp")
        rows.write.mode("overwrite").format("parquet").option("compression", "zstd").option("path", self._place(run)).bucketBy(buckets, "fp").sortBy("fp").saveAsTable(self._table(run))
        self.runs = sorted([*self.runs, run], key=lambda r: r[1])
        return run

    def read(self, run) -> DataFrame:
        return self.spark.table(self._table(run))

    def append(self, fps: DataFrame, scratch: Scratch) -> DataFrame:
        """Adds a batch (fp, doc_id); returns the fingerprints of the batch that two documents share, history included, as a written table."""
        self.compact()
        history = list(self.runs)
        buckets = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        rows = fps.repartition(buckets, "fp").groupBy("fp").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"))
        new = self.read(self._write(rows, 0, buckets))
        shared = new.filter("lo != hi").select("fp")
        for run in history:
            hit = new.alias("n").join(self.read(run).alias("o").hint("merge"), "fp").filter("n.lo != o.lo or n.hi != o.hi or n.lo != n.hi")
            shared = shared.unionByName(hit.select("fp"))
        return scratch.save(shared.distinct(), "shared")

    def compact(self) -> None:
        """Merges two runs of a level, as long as there are two."""
        while pair := next(([r for r in self.runs if r[0] == level][:2] for level in sorted({r[0] for r in self.runs}) if sum(r[0] == level for r in self.runs) > 1), None):
            one, two = (self.read(r) for r in pair)
            merged = one.withColumnsRenamed({"lo": "lo1", "hi": "hi1"}).join(two.withColumnsRenamed({"lo": "lo2", "hi": "hi2"}).hint("merge"), "fp", "full")
            self._write(merged.select("fp", F.least("lo1", "lo2").alias("lo"), F.greatest("hi1", "hi2").alias("hi")), pair[0][0] + 1, pair[0][2])
            for r in pair:
                self._forget(r)
                path = self._path(self._place(r))
                self._files(path).delete(path, True)

    def _forget(self, run) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self._table(run)}")
        self.runs.remove(run)

    def close(self, keep: bool = True) -> None:
        """Forgets the tables; the folder stays, unless it is not to be kept."""
        for r in list(self.runs):
            self._forget(r)
        if not keep:
            path = self._path(self.folder)
            self._files(path).delete(path, True)


def candidate_windows(texts: DataFrame) -> DataFrame:
    """h, c, doc_id of the windows around a shared fingerprint; texts has doc_id, text, fps."""
    ship(texts.sparkSession)

    def run(frames):
        for batch, _, offsets, (one, two) in _texts(frames, (0, 1)):
            grams, h, c = gram_hashes(one, GRAM), gram_hashes(one, WINDOW), gram_hashes(two, WINDOW)
            ids, hs, cs = [], [], []
            lists = batch.column("fps")
            at, values = np.asarray(lists.offsets), np.asarray(lists.values).view(np.uint64)
            for i, d in enumerate(batch.column("doc_id").to_pylist()):
                a, b = offsets[i], offsets[i + 1]
                if b - a < WINDOW:
                    continue
                hit = np.flatnonzero(np.isin(grams[a : b - GRAM + 1], values[at[i] : at[i + 1]]))
                n = b - a - WINDOW + 1
                mark = np.zeros(n + SPAN + 1, np.int32)
                np.add.at(mark, np.maximum(hit - SPAN + 1, 0), 1)
                np.add.at(mark, np.minimum(hit + 1, n), -1)
                starts = np.flatnonzero(np.cumsum(mark)[:n] > 0) + a
                u, first = np.unique(h[starts], return_index=True)
                ids.append(np.full(len(u), d, np.int64))
                hs.append(u)
                cs.append(c[starts][first])
            if ids:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(hs).view(np.int64)), pa.array((np.concatenate(cs) >> np.uint64(32)).astype(np.int64).astype(np.int32, casting="unsafe")), pa.array(np.concatenate(ids))], ["h", "c", "doc_id"])

    return texts.mapInArrow(run, "h long, c int, doc_id long")


def removal_mask(h: np.ndarray, gone: np.ndarray, n: int) -> np.ndarray:
    """Which of n words stand in a window whose hash is in gone; h are the hashes of the n - WINDOW + 1 windows."""
    mark = np.zeros(n + 1, np.int32)
    starts = np.flatnonzero(np.isin(h, gone))
    mark[starts] += 1
    np.add.at(mark, starts + WINDOW, -1)
    return np.cumsum(mark)[:n] > 0


def _removed(frames, text_out: bool):
    for batch, _, offsets, (words,) in _texts(frames):
        h = gram_hashes(words, WINDOW)
        lists = batch.column("gone")
        at, values = np.asarray(lists.offsets), np.asarray(lists.values).view(np.uint64)
        n_removed, kept = [], []
        for i, text in enumerate(batch.column("text").to_pylist()):
            a, b = offsets[i], offsets[i + 1]
            gone = removal_mask(h[a : b - WINDOW + 1], values[at[i] : at[i + 1]], b - a) if b - a >= WINDOW and at[i + 1] > at[i] else np.zeros(b - a, bool)
            joined = b" ".join(compress(text.encode("utf-8", "surrogatepass").split(), (~gone).tolist()))
            n_removed.append(int(gone.sum()))
            kept.append(joined.decode("utf-8", "surrogatepass") if text_out else hashlib.sha256(joined).hexdigest())
        yield batch, pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())


def rewrite(texts: DataFrame, text_out: bool = False) -> DataFrame:
    """doc_id, text_key, n_removed and kept (the text, or its SHA-256); texts has doc_id, text_key, text, gone (hashes)."""
    ship(texts.sparkSession)
    kind = texts.schema["doc_id"].dataType.simpleString()

    def run(frames):
        for batch, r, kept in _removed(frames, text_out):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_key"), r, kept], ["doc_id", "text_key", "n_removed", "kept"])

    return texts.select("doc_id", "text_key", "text", "gone").mapInArrow(run, f"doc_id {kind}, text_key long, n_removed long, kept string")


def shared_fingerprints(fps: DataFrame, scratch: Scratch, n_batches: int) -> DataFrame:
    """Fingerprints that two documents share, the table (fp, doc_id) taken in batches of doc_id through one index."""
    index = FingerprintIndex(fps.sparkSession, scratch.path("index"))
    span = fps.agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).first()
    shared = []
    if span["lo"] is not None:
        step = max(1, -(-(span["hi"] - span["lo"] + 1) // n_batches))
        for lo in range(span["lo"], span["hi"] + 1, step):
            shared.append(index.append(fps.filter(F.col("doc_id").between(lo, lo + step - 1)), scratch))
    index.close(keep=False)
    if not shared:
        return fps.select("fp").limit(0)
    every = shared[0]
    for s in shared[1:]:
        every = every.unionByName(s)
    out = scratch.save(every.distinct(), "every")
    scratch.drop(*shared)
    return out


def dedup_passages(docs: DataFrame, n_batches: int = BATCHES, text_out: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept (SHA-256 of the kept words joined by one space, or that text) of every row."""
    scratch = Scratch(docs.sparkSession, "passages")
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("text_key", F.xxhash64("text"))
    rows = scratch.save(sequences(docs, text_out), "rows")
    same = rows.filter("seq is not null and doc_id is not null").groupBy("seq").agg(F.min("doc_id").alias("lowest"), F.max("doc_id").alias("highest"), F.count("*").alias("n")).filter("lowest < highest")
    whole = salted_join(rows, same.drop("highest"), "seq", "doc_id", rows.count(), "left")
    rows_ = scratch.save(whole.select("doc_id", "text_key", "n_words", "kept", F.coalesce(F.col("doc_id") > F.col("lowest"), F.lit(False)).alias("copy")), "rows")
    scratch.drop(rows)
    rows = rows_
    # a doc_id is looked at where some row of it is long enough and no copy
    open_ids = scratch.save(rows.filter(f"doc_id is not null and not copy and n_words >= {WINDOW}").select("doc_id").distinct(), "ids")
    shut = scratch.save(rows.filter("doc_id is not null").select("doc_id").distinct().join(open_ids, "doc_id", "left_anti"), "shut")
    live = docs.filter("doc_id is not null")
    n_shut = shut.count()
    live = live.join(F.broadcast(shut), "doc_id", "left_anti") if n_shut <= BROADCAST_ROWS else only(live, open_ids, "doc_id", open_ids.count())
    fps = scratch.save(fingerprints(live), "fps")
    shared = shared_fingerprints(fps, scratch, n_batches)
    with_shared = scratch.save(fps.join(shared, "fp").groupBy("doc_id").agg(F.collect_list("fp").alias("fps")), "with")
    scratch.drop(fps, shared)
    texts = scratch.save(only(live, with_shared.select("doc_id"), "doc_id", with_shared.count()).join(with_shared.hint("merge"), "doc_id"), "texts")
    scratch.drop(with_shared)
    windows = scratch.save(candidate_windows(texts.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "fps")), "windows")
    first = windows.groupBy("h", "c").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).filter("lo < hi").select("h", "c", "lo")
    first = scratch.save(first, "first")
    gone = windows.join(first, ["h", "c"]).filter("doc_id > lo").groupBy("doc_id").agg(F.collect_list("h").alias("gone"))
    gone = scratch.save(gone, "gone")
    scratch.drop(windows, first)
    changed = only(texts.drop("fps"), gone.select("doc_id"), "doc_id", gone.count()).join(gone.hint("merge"), "doc_id")
    changed = scratch.save(rewrite(changed, text_out), "changed")
    scratch.drop(texts, gone)
    changed = changed.dropDuplicates(["doc_id", "text_key"]).select(F.col("doc_id").alias("x"), F.col("text_key").alias("y"), F.col("n_removed").alias("r"), F.col("kept").alias("k"))
    out = rows.join(changed, (rows.doc_id == F.col("x")) & (rows.text_key == F.col("y")), "left")
    empty = F.lit("") if text_out else F.sha2(F.lit(""), 256)
    removed = F.when(F.col("copy"), F.col("n_words")).otherwise(F.coalesce("r", F.lit(0).cast("long")))
    return out.select("doc_id", "n_words", removed.alias("n_removed"), F.when(F.col("copy"), empty).otherwise(F.coalesce("k", "kept")).alias("kept"))
