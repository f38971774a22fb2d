"""Connected groups from candidate buckets, with no unbounded group in one task and no cap.

`link` gets (key, id) rows: ids that share a key may be similar. It works in two
exact steps.

1. In each bucket every id is compared to the smallest and to the hub, the id
   with the fullest buckets, which is the one that copies with a change each have
   in common, and, where comparing is cheap, to the largest too. That is linear
   in the bucket. Verified links give components.
2. Buckets that still hold more than one component are cut into blocks of a
   bounded number of ids and bytes; every two blocks of a bucket meet in one row
   where ids of different components are compared. So every two ids of a bucket
   end up compared or already in one component; nothing is dropped. Ids that
   share many buckets are compared in one: either where `at` says which, or, where
   comparing a whole cluster of buckets once costs less than each of them, in the
   cluster that takes their place.

`components` finds the groups by alternating large and small stars, each round
two joins and two aggregates over the edge table, cut by a written table. A
vertex with more than 1 / HOT of all edges is salted in the joins; there are HOT
of them at most.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from volumetra.llm.common import Scratch, salted_join

#: A block holds about so many ids, and so many elements of their payloads.
BLOCK, BLOCK_SIZE = 256, 150_000
ROUNDS = 60
#: So many edges are joined up in one task before the stars begin, and of so many the stars are made in one task.
LOCAL_EDGES, FEW_EDGES = 2_000_000, 200_000


def _mark(edges: DataFrame) -> tuple:
    r = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x"), F.bit_xor(F.xxhash64("v", "u")).alias("y")).first()
    return r["n"], r["x"], r["y"]


def _contract(frames):
    """Edges of one partition to its stars: (u, v), v the smallest id that u reaches inside the partition."""
    parts = [(b.column("u").to_numpy(), b.column("v").to_numpy()) for b in frames]
    if not parts:
        return
    u, v = (np.concatenate(x) for x in zip(*parts))
    ids, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    root = np.arange(len(ids))
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        while not np.array_equal(new, new[new]):
            new = new[new]
        if np.array_equal(new, root):
            break
        root = new
    child = np.flatnonzero(root != np.arange(len(ids)))
    yield pa.RecordBatch.from_arrays([pa.array(ids[child]), pa.array(ids[root[child]])], ["u", "v"])


def components(edges: DataFrame, scratch: Scratch, native: bool = True) -> DataFrame:
    """(a, b) edges to (id, root) for every id with an edge, but for the roots themselves: root is the smallest id reachable.

    Not native, the edges are first joined up inside partitions of LOCAL_EDGES. Up to FEW_EDGES, 3 MB, lie in one
    partition, and a round needs no exchange.
    """
    e = edges.filter("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e = scratch.save(e, "edges")
    mark = _mark(e)
    done = not mark[0]
    if not native and not done:
        parts = -(-mark[0] // LOCAL_EDGES)
        new = scratch.save(e.coalesce(parts).mapInArrow(_contract, "u long, v long"), "edges")
        scratch.drop(e)
        e, done = new, parts == 1
        mark = _mark(e)
    few = mark[0] <= FEW_EDGES  # their number never grows
    dealt = (lambda df: df.coalesce(1)) if few else (lambda df: df)
    for _ in range(ROUNDS):
        if done:
            break
        total = 0 if few else mark[0]
        e_ = dealt(e)
        both = e_.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e")).select("e.u", "e.v")
        low = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"), F.count("*").alias("n"))
        # (v, u) with v > u becomes (v, the smallest around u)
        large = salted_join(e_.select(F.col("v").alias("u"), F.col("u").alias("v")), low, "u", "v", total).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        small = salted_join(large, low, "u", "v", total)
        small = dealt(small.filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))).distinct()
        new = scratch.save(small, "edges")
        scratch.drop(e)
        e, before, mark = new, mark, _mark(new)
        done = mark == before
    else:
        if not done:
            raise RuntimeError("components did not settle")
    out = e.select(F.col("u").alias("id"), F.col("v").alias("root"))
    out._scratch_path = e._scratch_path
    return out


def _dense(rows: DataFrame, clusters: DataFrame) -> DataFrame:
    """(key, id, n, label) of open buckets, with one row an id, under a key of the cluster, for clusters that are cheaper to compare whole.

    clusters: (id, root) of ids that share buckets, directly or through others. A bucket of n ids costs n * n comparisons.
    """
    rows = rows.join(clusters, "id", "left").withColumn("cluster", F.coalesce("root", "id")).drop("root")
    ids = rows.groupBy("cluster", "id").agg(F.sum("n").alias("work"), F.min("label").alias("label"))
    sizes = ids.groupBy("cluster").agg(F.count("*").alias("size"), F.sum("work").alias("work")).filter("size * size <= work").select("cluster", "size")
    whole = ids.join(sizes, "cluster").select(F.xxhash64("cluster", F.lit("cluster")).alias("key"), "id", F.col("size").alias("n"), "label")
    return rows.join(sizes, "cluster", "left_anti").select("key", "id", "n", "label").unionByName(whole)


def shared_keys(keys: DataFrame, hashed: bool = False) -> DataFrame:
    """key, id, n, lo, hi of the (key, id) rows whose key another id has too. One exchange: both sides of the join read it.

    Hashed, the shared keys of a partition are held in memory, and its rows need no sort: for keys that few ids share.
    """
    keys = keys.repartition("key")
    sizes = keys.groupBy("key").agg(F.count("*").alias("n"), F.min("id").alias("lo"), F.max("id").alias("hi")).filter("n > 1")
    return keys.join(sizes.hint("shuffle_hash") if hashed else sizes, "key")


def native_blocks(similar: Callable[[Column, Column], Column], at: Callable[[Column, Column], Column]) -> Callable[[DataFrame], DataFrame]:
    """Compares the blocks of each row inside the row: (key, same, pa, pb) to distinct (a, b) of labels that are linked."""

    def compare(met: DataFrame) -> DataFrame:
        fits = lambda a, b: (a["label"] != b["label"]) & (~F.col("same") | (a["id"] < b["id"])) & (at(a, b) == F.col("key")) & similar(a, b)
        found = F.transform("pa", lambda a: F.transform(F.filter("pb", lambda b: fits(a, b)), lambda b: F.struct(a["label"].alias("a"), b["label"].alias("b"))))
        return met.select(F.explode(F.array_distinct(F.flatten(found))).alias("e")).select("e.a", "e.b").distinct()

    return compare


def link(
    members: DataFrame,
    payload: Callable[[DataFrame], DataFrame],
    similar: Callable[[Column, Column], Column] | list[Callable[[Column, Column], Column]],
    scratch: Scratch,
    blocks: Callable[[DataFrame], DataFrame] | None = None,
    native: bool = True,
    first: Callable[[Column, Column], Column] | None = None,
    then: Callable[[Column, Column], Column] | None = None,
    at: Callable[[Column, Column], Column] | None = None,
    block_size: int = BLOCK_SIZE,
) -> DataFrame:
    """(key, id, n, lo, hi) rows, a written table of `shared_keys`, to (id, root).

    payload(ids) gives one row (id, size, columns that `similar` reads) for each
    id of a written table; similar(a, b) compares two structs of those columns.
    blocks(met) compares two arrays of such structs, with their labels, a row.
    Where similar is dear, first(a, b) may tell pairs cheaply, null where it does
    not; then(a, b) is asked for those that the links so told do not join. at(a, b)
    is the one key, of all that two ids share, at which blocks compare them. Of
    several similar, each is asked in blocks for those that the ones before have
    not joined: what is cheap or likely comes first. A block holds about block_size
    of the payloads' sizes.
    """
    tests = similar if isinstance(similar, list) else [similar]
    # the hub of a bucket: the id whose buckets hold most
    weights = members.groupBy("id").agg(F.sum("n").alias("w"))
    hubs = members.filter("n > 2").select("key", "id").join(weights, "id").groupBy("key").agg(F.max(F.struct("w", "id")).getField("id").alias("hub"))
    pivots = ("lo", "hub") if at is not None else ("lo", "hi", "hub")
    ends = members.filter("n > 2").join(hubs, "key").select("id", F.explode(F.array_distinct(F.array(*pivots))).alias("other"))
    ends = ends.unionByName(members.filter("n = 2 and id = lo").select("id", F.col("hi").alias("other")))
    star = scratch.save(ends.filter("id != other").select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b")).distinct(), "star")
    ids = scratch.save(members.select("id").distinct(), "ids")
    loads = scratch.save(payload(ids), "payload")
    scratch.drop(ids)

    def both(pairs: DataFrame) -> DataFrame:
        whole = F.struct(*loads.columns)
        return pairs.join(loads.select(F.col("id").alias("a"), whole.alias("pa")), "a").join(loads.select(F.col("id").alias("b"), whole.alias("pb")), "b")

    told = scratch.save(both(star).select("a", "b", (first or tests[0])(F.col("pa"), F.col("pb")).alias("linked")).filter("linked or linked is null"), "told", dear=True)
    links = told.filter("linked").select("a", "b")
    roots = components(links, scratch, native)
    later = None
    if then is not None:
        label = roots.withColumnRenamed("root", "l")
        open_ = told.filter("linked is null").select("a", "b")
        for end in ("a", "b"):
            open_ = open_.join(label.select(F.col("id").alias(end), F.col("l").alias(f"l{end}")), end, "left")
        open_ = open_.filter(F.coalesce("la", "a") != F.coalesce("lb", "b")).select("a", "b")
        later = scratch.save(both(open_).filter(then(F.col("pa"), F.col("pb"))).select("a", "b"), "later", dear=True)
    scratch.drop(told)

    as_edges = lambda df: df.select(F.col("id").alias("a"), F.col("root").alias("b"))
    if later is not None:
        new = components(as_edges(roots).unionByName(later), scratch, native)
        scratch.drop(roots, later)
        roots = new
    rows, dense = members.filter("n > 2").select("key", "id", "n"), None
    for test in tests:
        labelled = rows.join(roots, "id", "left").select("key", "id", "n", F.coalesce("root", "id").alias("label"))
        labelled = scratch.save(labelled, "labelled")
        if dense is not None:
            scratch.drop(dense)
        open_ = labelled.groupBy("key").agg(F.min("label").alias("x"), F.max("label").alias("y")).filter("x != y").select("key")
        dense = scratch.save(labelled.join(open_, "key", "left_semi"), "open")
        scratch.drop(labelled)
        if dense.isEmpty():
            break
        if at is None:
            clusters = components(star, scratch, native)
            left_over, dense = dense, scratch.save(_dense(dense, clusters), "dense")
            scratch.drop(clusters, left_over)
        rows = dense.select("key", "id", "n")
        sized = dense.join(loads.select("id", "size"), "id")
        counts = sized.groupBy("key").agg(F.count("*").alias("n"), F.sum("size").alias("s"))
        counts = counts.select("key", F.greatest(F.ceil(F.col("n") / BLOCK), F.ceil(F.col("s") / block_size)).cast("int").alias("nb"))
        placed = dense.drop("n").join(counts, "key").withColumn("block", F.pmod(F.xxhash64("id"), "nb").cast("int"))
        cut = placed.join(loads, "id").select("key", "nb", "block", F.struct("label", *loads.columns).alias("p"))
        cut = cut.groupBy("key", "nb", "block").agg(F.collect_list("p").alias("ps"))
        cut = scratch.save(cut, "blocks")
        one = cut.select("key", "block", F.explode(F.sequence("block", F.col("nb") - 1)).alias("other"), F.col("ps").alias("pa"))
        two = cut.select("key", F.col("block").alias("other"), F.col("ps").alias("pb"))
        met = one.join(two, ["key", "other"]).select("key", (F.col("block") == F.col("other")).alias("same"), "pa", "pb")
        more = scratch.save((blocks or native_blocks(test, at))(met), "more", dear=True)
        scratch.drop(cut)
        new = components(as_edges(roots).unionByName(more), scratch, native)
        scratch.drop(more, roots)
        roots = new
    scratch.drop(star, loads, dense)
    return roots
