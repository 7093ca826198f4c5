"""Prefix trie of conversations: balanced parentheses in each shard, shared spines merged.

A node is known by its depth and a 128-bit sum of position-bound turn hashes, so
counts of members come from one aggregate. Nodes with many rows below them are
the spine; every subtree that hangs from it is small and belongs to one shard. A
shard writes its subtrees as a sequence of balanced parentheses with range
min-max blocks over the excess: ``findclose`` gives a node's subtree, a rank
of leaf pairs its leaves, and cumulative arrays its members and savings. Sums
of the shards' tops are then merged along the spine.

No conversation, node or group of copies is ever collected: positions and
prefix sums are running sums over range partitions.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import written

#: Rows below a node that make it part of the spine, and rows a shard should have.
SPINE_ROWS, SHARD_ROWS = 50_000, 200_000
#: Seeds of the two turn hashes.
SEEDS = (13, 1013)
#: Parentheses in a leaf block of the range min-max tree; ids hashed as one piece of text.
BLOCK, CHUNK = 64, 4096


# ---- running sums over range partitions ---------------------------------------

def _run_starts(keys: np.ndarray) -> np.ndarray:
    return np.append(0, np.flatnonzero(keys[1:] != keys[:-1]) + 1) if len(keys) else np.zeros(0, np.int64)


def running_sums(df: DataFrame, by: str, order: list, sums: dict[str, str], before: dict[str, str] | None = None) -> DataFrame:
    """Add ``sums[name]`` = running sum of the long column ``name`` (wrapping at 64 bits) within ``by`` in ``order``.

    ``before[name]`` is the same without the row itself. The frame is
    range-partitioned on (by, order), so a key with most of the rows is spread
    over many tasks. A task adds up its own rows; only the sums of each
    partition's last key go to the driver, which returns what each partition's
    first key carries in. ``by`` must be a long without nulls.
    """
    before = before or {}
    sorted_ = written(df.orderBy(by, *order).withColumn("_pid", F.spark_partition_id()))
    names = list(sums)

    def edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid = first = last = None
        tail = np.zeros(len(names), np.int64)
        for b in batches:
            keys = np.asarray(b.column(by))
            if not len(keys):
                continue
            if pid is None:
                pid, first = b.column("_pid")[0].as_py(), int(keys[0])
            if last != int(keys[-1]):
                last, tail = int(keys[-1]), np.zeros(len(names), np.int64)
            tail = tail + np.array([np.asarray(b.column(c))[keys == last].sum() for c in names], np.int64)
        if pid is not None:
            yield pa.RecordBatch.from_pydict({"pid": pa.array([pid], pa.int32()), "first": [first], "last": [last], "tail": pa.array([tail.tolist()], pa.list_(pa.int64()))})

    carried: dict[int, np.ndarray] = {}
    key, total = None, np.zeros(len(names), np.int64)
    for r in sorted(sorted_.mapInArrow(edges, "pid int, first long, last long, tail array<long>").collect(), key=lambda r: r["pid"]):
        carried[r["pid"]] = total if key == r["first"] else np.zeros(len(names), np.int64)
        total = np.array(r["tail"], np.int64) + (carried[r["pid"]] if r["first"] == r["last"] else 0)
        key = r["last"]

    passed, added = df.columns, [*sums.values(), *before.values()]
    out = T.StructType([*df.schema.fields, *[T.StructField(c, T.LongType()) for c in added]])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, so_far = None, None
        for b in batches:
            keys = np.asarray(b.column(by))
            if not len(keys):
                continue
            if so_far is None:
                key, so_far = int(keys[0]), carried[b.column("_pid")[0].as_py()]
            start = _run_starts(keys)
            size = np.diff(np.append(start, len(keys)))
            own = [np.asarray(b.column(c)).astype(np.int64) for c in names]
            runs = []
            for k, values in enumerate(own):
                run = np.cumsum(values)
                run -= np.repeat(run[start] - values[start], size)
                if key == keys[0]:
                    run[:size[0]] += so_far[k]
                runs.append(run)
            key, so_far = int(keys[-1]), np.array([r[-1] for r in runs], np.int64)
            done = [*runs, *[runs[names.index(c)] - own[names.index(c)] for c in before]]
            yield pa.RecordBatch.from_arrays([*map(b.column, passed), *map(pa.array, done)], names=[*passed, *added])

    return sorted_.mapInArrow(add, out)


# ---- balanced parentheses ------------------------------------------------------

class Parentheses:
    """A forest as balanced parentheses, with a tree of excess minima over blocks."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits
        self.excess = np.cumsum(np.where(bits, 1, -1)).astype(np.int64)
        leaves = 1 << max(0, math.ceil(math.log2(max(1, math.ceil(len(bits) / BLOCK)))))
        padded = np.full(leaves * BLOCK, len(bits) + 1, np.int64)
        padded[:len(bits)] = self.excess
        self.blocks = padded.reshape(leaves, BLOCK)
        #: Heap order: node k has the children 2k and 2k + 1; the blocks' minima are the last ``leaves`` entries.
        self.least = np.empty(2 * leaves, np.int64)
        self.least[leaves:] = self.blocks.min(axis=1)
        for k in range(leaves - 1, 0, -1):
            self.least[k] = min(self.least[2 * k], self.least[2 * k + 1])
        self.leaves = leaves
        self.opens = np.flatnonzero(bits)
        self.open_rank = np.append(0, np.cumsum(bits))
        pair = np.append(bits[:-1] & ~bits[1:], False) if len(bits) else bits
        self.leaf_rank = np.append(0, np.cumsum(pair))

    def findclose(self, at: np.ndarray) -> np.ndarray:
        """Place of the parenthesis that closes each opening one at ``at``: the next one of a lower excess."""
        target = self.excess[at] - 1
        column = np.arange(BLOCK)
        block = at // BLOCK

        def inside(which: np.ndarray, above: np.ndarray) -> np.ndarray:
            hit = (self.blocks[block[which]] <= target[which, None]) & (column > above[:, None])
            return np.where(hit.any(axis=1), hit.argmax(axis=1), -1)

        out = np.full(len(at), -1, np.int64)
        for lo in range(0, len(at), 1 << 16):
            part = np.arange(lo, min(len(at), lo + (1 << 16)))
            out[part] = inside(part, at[part] % BLOCK)
        todo = np.flatnonzero(out < 0)
        node = block[todo] + self.leaves
        climbing = np.ones(len(todo), bool)
        while climbing.any():              # up, until a right sibling holds the excess
            sibling = node + 1
            up = (node & 1).astype(bool)
            found = climbing & ~up & (self.least[np.minimum(sibling, 2 * self.leaves - 1)] <= target[todo])
            node = np.where(found, sibling, np.where(climbing, node >> 1, node))
            climbing &= ~found
        while (node < self.leaves).any():  # down to the first block that holds it
            left = 2 * node
            inner = node < self.leaves
            go_left = self.least[np.where(inner, left, 1)] <= target[todo]
            node = np.where(inner, np.where(go_left, left, left + 1), node)
        block[todo] = node - self.leaves
        for lo in range(0, len(todo), 1 << 16):
            part = todo[lo:lo + (1 << 16)]
            out[part] = inside(part, np.full(len(part), -1))
        return block * BLOCK + out


def shard_nodes(conv: np.ndarray, depth: np.ndarray, node: np.ndarray, words: np.ndarray, last: np.ndarray) -> pd.DataFrame:
    """Every node of a shard's subtrees: node, members, least member, leaves, savings, and the ids that end there.

    The arrays are the shard's rows: ``node`` numbers a row's node from 0, ``words``
    those of its last turn, and ``last`` tells whether the conversation ends there.
    """
    order = np.lexsort((depth, conv))
    conv, node, words, last = conv[order], node[order], words[order], last[order]
    first = _run_starts(conv)
    ends = np.append(first[1:], len(conv)) - 1
    key = node.astype(">u4")
    paths = sorted((key[a:b + 1].tobytes(), int(c)) for a, b, c in zip(first.tolist(), ends.tolist(), conv[first].tolist()))
    n = int(node.max()) + 1
    bits: list[np.ndarray] = []
    preorder: list[np.ndarray] = []
    before = np.zeros(0, np.uint32)
    ending: dict[int, list[int]] = {}
    for path, c in paths:
        own = np.frombuffer(path, ">u4").astype(np.int64)
        ending.setdefault(int(own[-1]), []).append(c)
        both = min(len(own), len(before))
        differ = np.flatnonzero(own[:both] != before[:both])
        shared = int(differ[0]) if len(differ) else both
        if shared < len(own):
            bits.append(np.repeat([False, True], [len(before) - shared, len(own) - shared]))
            preorder.append(own[shared:])
            before = own
    bits.append(np.zeros(len(before), bool))
    tree = Parentheses(np.concatenate(bits))
    at = np.concatenate(preorder)                         # node numbers in preorder
    start = tree.opens
    close = tree.findclose(start)
    here, after = tree.open_rank[start], tree.open_rank[close]

    ended = np.zeros(n, np.int64)
    for k, ids in ending.items():
        ended[k] = len(ids)
    members = np.append(0, np.cumsum(ended[at]))
    n_convs = members[after] - members[here]
    words_of = np.zeros(n, np.int64)
    words_of[node] = words
    saved = np.append(0, np.cumsum((n_convs - 1) * words_of[at]))
    least = np.full(n, np.iinfo(np.int64).max)
    np.minimum.at(least, node, conv)
    out = pd.DataFrame({"node": at, "conv_id": least[at], "n_convs": n_convs, "n_leaves": tree.leaf_rank[close] - tree.leaf_rank[start],
                        "saved_tokens": saved[after] - saved[here]})
    out["ends"] = [sorted(ending.get(k, ())) for k in at.tolist()]
    return out


def _ends_hash(ids: list[int]) -> str:
    return hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()


# ---- the rebuilt conversations --------------------------------------------------

def numbered_turns(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, pos from 1, two turn keys, words): turns in order of turn (null first), then role and text.

    Null roles and texts count as empty; rows without a conversation are left out.
    """
    empty = F.lit("")
    own = turns.where(F.col(conv).isNotNull()).select(
        F.col(conv).cast("long").alias("conv"), F.col(turn).alias("turn"), F.coalesce(role, empty).alias("role"), F.coalesce(text, empty).alias("text"))
    parts = F.filter(F.split("text", "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    digests = [F.xxhash64(F.lit(s), F.col("role"), F.col("text")).alias(f"t{k}") for k, s in enumerate(SEEDS)]
    keys = own.select("conv", "turn", *digests, F.size(parts).cast("long").alias("words"), F.lit(1).cast("long").alias("one"),
                      F.sha2(F.concat("role", F.lit("\x00"), "text"), 256).alias("_tie"))
    order = [F.col("turn").asc_nulls_first(), "_tie", F.monotonically_increasing_id()]
    return running_sums(keys, "conv", order, {"one": "pos"}).drop("turn", "one", "_tie")


def shared_openings(turns: DataFrame, group: int = 20, span: int = 4) -> DataFrame:
    """Rebuilt conversations as (conv, depth, t0, t1, words, len): each takes its first turns from its group's first one.

    Conversation c begins with the first h turns of c - c % group, where h is
    crc32(decimal c) % span, and goes on with its own turns after its first h.
    Depth 0 is there for every conversation, even one without turns.
    """
    turns = written(turns)
    sizes = turns.groupBy("conv").agg(F.count(F.lit(1)).alias("n"))
    base = F.col("conv") - F.col("conv") % group
    heads = sizes.select("conv", "n", base.alias("base"), (F.crc32(F.col("conv").cast("string").cast("binary")) % span).alias("h"))
    heads = heads.join(sizes.select(F.col("conv").alias("base"), F.col("n").alias("n_base")), "base", "left")
    taken = F.least("h", F.coalesce("n_base", F.lit(0)))
    heads = written(heads.select("conv", "base", "h", taken.alias("taken"), (taken + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("len")))
    own = (turns.join(heads.drop("base"), "conv").where(F.col("pos") > F.col("h"))
           .select("conv", (F.col("pos") - F.col("h") + F.col("taken")).alias("depth"), "t0", "t1", "words", "len"))
    lent = (heads.join(turns.where(F.col("pos") < span).withColumnRenamed("conv", "base"), "base").where(F.col("pos") <= F.col("h"))
            .select("conv", F.col("pos").alias("depth"), "t0", "t1", "words", "len"))
    zero = F.lit(0).cast("long")
    top = heads.select("conv", zero.alias("depth"), zero.alias("t0"), zero.alias("t1"), zero.alias("words"), "len")
    return own.unionByName(lent).unionByName(top)


# ---- the trie -------------------------------------------------------------------

KEY, UP = ["depth", "p0", "p1"], ["up_depth", "q0", "q1"]
NODE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def _solve_shard(part: pd.DataFrame) -> pd.DataFrame:
    """The nodes of a shard's rows; a node whose parent lies on the spine has no parent_conv_id yet."""
    part = part.sort_values(["conv", "depth"], ignore_index=True)
    number = part.groupby(KEY, sort=False).ngroup().to_numpy()
    found = shard_nodes(part["conv"].to_numpy(), part["depth"].to_numpy(), number, part["words"].to_numpy(), part["last"].to_numpy())
    nodes = found["node"].to_numpy()
    row = np.zeros(len(found), np.int64)
    row[number] = np.arange(len(part))
    row = row[nodes]                                   # one row of each node
    for c in [*KEY, "q0", "q1"]:
        found[c] = part[c].to_numpy()[row]
    inner = found["depth"].to_numpy() > part["left_at"].to_numpy()[row] + 1
    up = number[np.maximum(row - 1, 0)]                # the row before is the parent's, if that lies in the shard
    least = np.zeros(len(found), np.int64)
    least[nodes] = found["conv_id"].to_numpy()
    found["parent_conv_id"] = pd.arrays.IntegerArray(least[up], ~inner)
    found["n_children"] = np.bincount(up[inner], minlength=len(found))[nodes]
    found["ends_sha256"] = [_ends_hash(x) for x in found.pop("ends")]
    return found.drop(columns="node")


def _hash_of_ends(ends: DataFrame) -> DataFrame:
    """(depth, p0, p1, ends_sha256) of ``ends`` (depth, p0, p1, conv): the ids of a node, ascending and comma-joined, hashed.

    A range partition turns its ids into pieces of text; one task then reads a
    node's pieces in order and keeps nothing but the hash.
    """
    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
        for b in batches:
            part = b.to_pandas()
            if not len(part):
                continue
            new = (part[KEY] != part[KEY].shift()).any(axis=1).to_numpy().cumsum()
            piece = [(*own[KEY].iloc[0], own["conv"].iloc[at], ",".join(map(str, own["conv"].iloc[at:at + CHUNK])))
                     for _, own in part.groupby(new) for at in range(0, len(own), CHUNK)]
            yield pa.RecordBatch.from_pandas(pd.DataFrame(piece, columns=[*KEY, "first", "ids"]), preserve_index=False)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for b in batches:
            done = []
            for r in b.to_pylist():
                own = (r["depth"], r["p0"], r["p1"])
                if own == key:
                    state.update(b",")
                else:
                    if state is not None:
                        done.append((*key, state.hexdigest()))
                    key, state = own, hashlib.sha256()
                state.update(r["ids"].encode())
            yield _hash_rows(done)
        if state is not None:
            yield _hash_rows([(*key, state.hexdigest())])

    cut = ends.orderBy(*KEY, "conv").mapInArrow(pieces, "depth long, p0 long, p1 long, first long, ids string")
    return (cut.repartition(*KEY).sortWithinPartitions(*KEY, "first")
            .mapInArrow(digest, "depth long, p0 long, p1 long, ends_sha256 string"))


def _hash_rows(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [(), (), (), ()]
    return pa.RecordBatch.from_arrays([*[pa.array(c, pa.int64()) for c in columns[:3]], pa.array(columns[3], pa.string())], names=[*KEY, "ends_sha256"])


def prefix_trie(rows: DataFrame, spine_rows: int = SPINE_ROWS, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """All nodes of the trie of ``rows`` (conv, depth, t0, t1, words, len; see :func:`shared_openings`).

    A node's row: conv_id (its least member), depth, parent_conv_id (null for the
    root), n_convs, n_children, n_leaves, saved_tokens, ends_sha256. Conversations
    with equal turns end at one node. No rows give no nodes.
    """
    spark = rows.sparkSession
    zero = F.lit(0).cast("long")
    keyed = rows.select("conv", "depth", "words", "len", *[
        F.when(F.col("depth") == 0, zero).otherwise(F.xxhash64(F.lit(s), "depth", "t0", "t1")).alias(f"h{k}") for k, s in enumerate(SEEDS)])
    paths = written(running_sums(keyed, "conv", ["depth"], {"h0": "p0", "h1": "p1"}, {"h0": "q0", "h1": "q1"}).drop("h0", "h1"))
    below = F.col("len") - F.col("depth") + 1
    big = written(paths.groupBy(*KEY)
                  .agg(F.count(F.lit(1)).alias("n_convs"), F.min("conv").alias("conv_id"), F.max("words").alias("words"),
                       F.max("q0").alias("q0"), F.max("q1").alias("q1"), F.sum(below).alias("below"))
                  .where((F.col("below") > spine_rows) | (F.col("depth") == 0)).drop("below"))
    on_spine = paths.join(big.select(*KEY), KEY, "left_semi")
    left_at = written(on_spine.groupBy("conv").agg(F.max("depth").alias("left_at")))

    # Shards: the rows below the spine, dealt by the first node there.
    hanging = paths.join(left_at, "conv").where(F.col("depth") > F.col("left_at"))
    tops = hanging.where(F.col("depth") == F.col("left_at") + 1).select("conv", F.xxhash64(*KEY).alias("top"))
    n_shards = max(1, math.ceil(paths.count() / shard_rows), 2 * spark.sparkContext.defaultParallelism)
    sharded = (hanging.join(tops, "conv")
               .select("conv", *KEY, "q0", "q1", "words", (F.col("depth") == F.col("len")).alias("last"), "left_at",
                       F.pmod("top", F.lit(n_shards)).cast("int").alias("shard"))
               .repartition(n_shards, "shard"))
    solved = written(sharded.groupBy("shard").applyInPandas(
        _solve_shard, "conv_id long, depth long, p0 long, p1 long, q0 long, q1 long, parent_conv_id long, n_convs long, n_children long, "
                      "n_leaves long, saved_tokens long, ends_sha256 string"))
    tops = solved.where(F.col("parent_conv_id").isNull()).drop("parent_conv_id").withColumn("up_depth", F.col("depth") - 1)

    # The spine: what its nodes and the shards' tops hold counts once, at the least member, and is summed from the end of its path upwards.
    spine = big.withColumn("up_depth", F.col("depth") - 1)
    children = (tops.select(*UP).unionByName(spine.where(F.col("depth") > 0).select(*UP))
                .groupBy(*UP).agg(F.count(F.lit(1)).alias("n_children")).toDF(*KEY, "n_children"))
    gain = big.select(F.col("conv_id").alias("conv"), "depth", ((F.col("n_convs") - 1) * F.col("words")).alias("saved"), zero.alias("leaves"))
    ends = big.join(children, KEY, "left_anti").select(F.col("conv_id").alias("conv"), "depth", zero.alias("saved"), F.lit(1).cast("long").alias("leaves"))
    hung = tops.select(F.col("conv_id").alias("conv"), F.col("up_depth").alias("depth"), F.col("saved_tokens").alias("saved"), F.col("n_leaves").alias("leaves"))
    held = gain.unionByName(ends).unionByName(hung).groupBy("conv", "depth").agg(F.sum("saved").alias("saved"), F.sum("leaves").alias("leaves"))
    upwards = (on_spine.join(held.select("conv").distinct(), "conv", "left_semi").join(held, ["conv", "depth"], "left")
               .select("conv", *KEY, (-F.col("depth")).alias("up"), F.coalesce("saved", zero).alias("saved"), F.coalesce("leaves", zero).alias("leaves")))
    sums = (running_sums(upwards, "conv", ["up"], {"saved": "saved_tokens", "leaves": "n_leaves"})
            .groupBy(*KEY).agg(F.sum("saved_tokens").alias("saved_tokens"), F.sum("n_leaves").alias("n_leaves")))
    hashes = _hash_of_ends(on_spine.where(F.col("depth") == F.col("len")).select(*KEY, "conv"))
    names = big.select(*[F.col(a).alias(b) for a, b in zip(KEY, UP)], F.col("conv_id").alias("parent_conv_id"))
    spine = (spine.join(sums, KEY).join(children, KEY, "left").join(hashes, KEY, "left").join(names, UP, "left")
             .withColumns({"n_children": F.coalesce("n_children", zero), "ends_sha256": F.coalesce("ends_sha256", F.lit(_ends_hash([])))}))
    return (solved.where(F.col("parent_conv_id").isNotNull()).select(*NODE)
            .unionByName(tops.join(names, UP).select(*NODE)).unionByName(spine.select(*NODE)))
