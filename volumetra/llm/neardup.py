"""Near duplicates by a multi-index join of b-bit MinHash signatures.

A document's set is its distinct 4-word shingles (64-bit hashes; the words of a
shorter text are one shingle). Equal sets are one class, so exact copies cost
one row. A class has SLOTS minima of 32 bits. Signatures that differ in at most
REACH slots agree but for one slot in at least one of CHUNKS chunks of three
(pigeonhole: 19 errors in 10 chunks leave a chunk with at most one), so each
chunk gives three keys, each with one slot left out: every pair within REACH
shares a key. At a similarity of 0.8 a slot differs with probability 0.2 and
more than 19 of 30 differ once in 3 * 10^7 pairs.

Pairs that share a key are compared on their full sets (linkage.link), which
needs the texts of those documents alone again.

A text without words has an empty set, links with nothing and stays. Rows with
one doc_id and different texts are judged apart. Rows with a null doc_id take
part; the smallest doc_id of a group is then taken among the others, and such a
row is kept only where its group has no doc_id. Classes are known by 64-bit
digests: two of 10^9 different sets share one with a probability of 3 %.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from volumetra.llm.common import Scratch, batches, gram_hashes, mix, only, salted_join, ship, whole_text, word_hashes, word_lists
from volumetra.llm.linkage import link, shared_keys

CHUNKS, PER_CHUNK = 10, 3
SLOTS = CHUNKS * PER_CHUNK
COLUMNS = 4096
REACH = 2 * CHUNKS - 1
_RNG = np.random.default_rng(20240229)
MULTIPLY = _RNG.integers(0, 2**64, SLOTS, np.uint64) | np.uint64(1)
ADD = _RNG.integers(0, 2**64, SLOTS, np.uint64)


def shingle_sets(texts: pa.Array, k: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    flat, offsets = word_lists(texts, lower=True)
    words = word_hashes(flat)
    grams = gram_hashes(words, k)
    out = []
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        if b - a >= k:
            out.append(np.unique(grams[a : b - k + 1]))
        elif b > a:
            out.append(gram_hashes(words[a:b], b - a) ^ np.uint64(b - a))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def class_of(s: np.ndarray) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(s.tobytes(), 7) - (1 << 63)


def signature_keys(sets: list[np.ndarray]) -> np.ndarray:
    """(n x 30) keys of non-empty sets."""
    flat = np.concatenate(sets)
    starts = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
    slots = np.stack([np.minimum.reduceat(flat * m + a, starts) >> np.uint64(32) for m, a in zip(MULTIPLY, ADD)], axis=1)
    keys = []
    for c in range(CHUNKS):
        own = [slots[:, PER_CHUNK * c + j] for j in range(PER_CHUNK)]
        for out in range(PER_CHUNK):
            x, y = [own[j] for j in range(PER_CHUNK) if j != out]
            keys.append(mix(mix((x << np.uint64(32)) | y) + np.uint64(c * PER_CHUNK + out + 1)))
    return np.stack(keys, axis=1)


def features(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, text_key, n_shingles, class, keys (null for an empty set)."""
    ship(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(frames):
        for batch in batches(frames, 4.0):
            sets = shingle_sets(batch.column("text"), k)
            full = [i for i, s in enumerate(sets) if len(s)]
            keys: list = [None] * len(sets)
            if full:
                for i, row in zip(full, signature_keys([sets[i] for i in full]).view(np.int64)):
                    keys[i] = row
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_key"), pa.array([len(s) for s in sets], pa.int64()), pa.array([class_of(s) if len(s) else None for s in sets], pa.int64()), pa.array(keys, pa.list_(pa.int64()))],
                ["doc_id", "text_key", "n_shingles", "class", "keys"],
            )

    return docs.select("doc_id", "text", F.xxhash64(whole_text()).alias("text_key")).mapInArrow(run, f"doc_id {kind}, text_key long, n_shingles long, class long, keys array<long>")


def full_sets(docs: DataFrame, k: int) -> DataFrame:
    """class, set of every row with words."""
    ship(docs.sparkSession)

    def run(frames):
        for batch in batches(frames, 4.0):
            sets = [s for s in shingle_sets(batch.column("text"), k) if len(s)]
            yield pa.RecordBatch.from_arrays([pa.array([class_of(s) for s in sets], pa.int64()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], ["class", "set"])

    return docs.select("text").mapInArrow(run, "class long, set array<long>")


def similar(percent: int):
    def test(a: Column, b: Column) -> Column:
        na, nb = F.size(a["set"]), F.size(b["set"])
        close = 100 * F.least(na, nb) >= percent * F.greatest(na, nb)
        # |A and B| >= p/(100+p) * (|A|+|B|) is 100 |A and B| >= p |A or B|
        return close & ((100 + percent) * F.size(F.array_intersect(a["set"], b["set"])) >= percent * (na + nb))

    return test


def shared_counts(a: pa.ListArray, b: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(n x m) sizes of the intersections of two lists of sets, and the sets' sizes.

    A shingle that both sides hold is a column of two 0/1 matrices; COLUMNS of them are multiplied at a time.
    """
    sides = []
    for x in (a, b):
        at = np.asarray(x.offsets, np.int64)
        sides.append((np.diff(at), np.asarray(x.values)[at[0] : at[-1]]))
    (na, fa), (nb, fb) = sides
    both = np.intersect1d(fa, fb)
    out = np.zeros((len(na), len(nb)), np.float32)
    entries = []
    for n, f in sides:
        at = np.minimum(np.searchsorted(both, f), max(len(both) - 1, 0))
        ok = both[at] == f if len(both) else np.zeros(len(f), bool)
        column, row = at[ok], np.repeat(np.arange(len(n)), n)[ok]
        order = np.argsort(column, kind="stable")
        entries.append((column[order], row[order], len(n)))
    for lo in range(0, len(both), COLUMNS):
        parts = []
        for column, row, n in entries:
            i, j = np.searchsorted(column, (lo, lo + COLUMNS))
            part = np.zeros((n, min(COLUMNS, len(both) - lo)), np.float32)
            part[row[i:j], column[i:j] - lo] = 1
            parts.append(part)
        out += parts[0] @ parts[1].T
    return out.astype(np.int64), na, nb


def set_blocks(percent: int):
    """Compares the blocks of each row (linkage.link) by matrix products of their sets."""

    def run(frames):
        for batch in frames:
            found = []
            sides = [batch.column(c) for c in ("pa", "pb")]
            for i in range(batch.num_rows):
                (la, sa), (lb, sb) = [(np.asarray(x.field("label")), x.field("set")) for x in (side.slice(i, 1).flatten() for side in sides)]
                shared, na, nb = shared_counts(sa, sb)
                hit = ((100 + percent) * shared >= percent * (na[:, None] + nb)) & (la[:, None] != lb)
                x, y = np.nonzero(hit)
                if len(x):
                    found.append(np.unique(np.stack([np.minimum(la[x], lb[y]), np.maximum(la[x], lb[y])], axis=1), axis=0))
            if found:
                a, b = np.unique(np.concatenate(found), axis=0).T
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])
            del batch, sides
            pa.default_memory_pool().release_unused()  # the worker lives on, its blocks need not

    def compare(met: DataFrame) -> DataFrame:
        ship(met.sparkSession)
        sides = [F.transform(c, lambda x: F.struct(x["label"].alias("label"), x["set"].alias("set"))).alias(c) for c in ("pa", "pb")]
        return met.select(*sides).mapInArrow(run, "a long, b long").distinct()

    return compare


def near_duplicates(docs: DataFrame, shingle: int = 4, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of docs (doc_id, text)."""
    return judged(docs, shingle, percent).drop("text_key")


def judged(docs: DataFrame, shingle: int = 4, percent: int = 80) -> DataFrame:
    """The rows of near_duplicates with text_key, the hash of their text: with doc_id it tells rows apart."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "neardup")
    rows = scratch.save(features(docs, shingle), "features")
    classes = rows.filter("class is not null").groupBy("class").agg(F.min("doc_id").alias("lowest"), F.first("keys").alias("keys"), F.count("*").alias("n"))
    classes = scratch.save(classes, "classes")
    members = scratch.save(shared_keys(classes.select(F.explode("keys").alias("key"), F.col("class").alias("id"))), "members")

    def payload(ids: DataFrame) -> DataFrame:
        wanted = scratch.save(classes.join(ids.withColumnRenamed("id", "class"), "class", "left_semi").select("class", "lowest"), "wanted")
        some = wanted.select(F.col("lowest").alias("doc_id")).filter("doc_id is not null").distinct()
        texts = docs.select("doc_id", "text")
        found = only(texts, some, "doc_id", wanted.count()).unionByName(texts.filter("doc_id is null"))
        sets = full_sets(found, shingle).dropDuplicates(["class"])
        return wanted.join(sets, "class").select(F.col("class").alias("id"), F.size("set").alias("size"), "set")

    roots = link(members, payload, similar(percent), scratch, set_blocks(percent), native=False)
    joined = classes.join(roots.withColumnRenamed("id", "class"), "class", "left").select("class", "lowest", "n", F.coalesce("root", "class").alias("root"))
    low = joined.groupBy("root").agg(F.min("lowest").alias("component"), F.count("*").alias("classes"), F.sum("n").alias("rows")).filter("rows > 1")
    of = scratch.save(joined.join(low, "root").select("class", "component", F.lit(True).alias("grouped"), "n"), "components")
    scratch.drop(members, classes)
    narrow = rows.drop("keys")
    out = salted_join(narrow, of, "class", "doc_id", narrow.count(), "left")
    component = F.when(F.col("grouped"), F.col("component")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "text_key", "n_shingles", component.alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
