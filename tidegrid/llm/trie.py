"""Prefix tries of conversations as double arrays, one per prefix shard, merged where shards share nodes.

A node stands for a distinct sequence of first turns (role, text); the root is the empty sequence. Steps:

1. Conversations become arrays of 128-bit turn hashes with the turns' word counts. Equal conversations become one row:
   how many, the least id, and the SHA-256 of their ids in order, which streams through sorted blocks of ids.
2. Rows are dealt to shards of about ``weight`` turns by their first ``shallow`` turns. A prefix that holds
   more is spread over several shards.
3. A shard numbers its distinct turns densely and packs its trie into BASE and CHECK: the child of node s by turn c is
   slot BASE[s] + c, and CHECK of that slot is s. All rows walk the arrays together, one turn at a time,
   which gives every node its members; sums over subtrees go up the CHECK links.
4. Nodes of fewer than ``shallow`` turns, and all nodes of a spread prefix, may exist in several shards. They are merged
   by the hash of their path. Where several shards share a node, its subtree is summed anew by doubling:
   each round adds the values of descendants twice as far away, so rounds grow with the logarithm of the depth.

A shard is bounded by ``weight`` turns and one conversation, which is the unit of a row and must fit a task.

Null roles and texts are empty, null ids and the rows of conversations that the caller does not name are left out.
Rows with equal turn are ordered by role and text. A conversation without turns is a member of the root and ends there.
An empty table has no nodes, not even a root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidegrid.llm.common import WORD, kept, text_of

#: Turns of the prefix that deals rows to shards, turns of a shard, ids of a block (a power of two: the bits).
SHALLOW = 2
WEIGHT = 4_096
BLOCK_BITS = 12

NODES = (
    "shared boolean, key binary, parent binary, parent_id long, depth long, conv_id long, n_convs long, "
    "n_children long, n_leaves long, saved_tokens long, words long, ends string"
)
ROOT = hashlib.blake2b(b"", digest_size=16).digest()


class DoubleArray:
    """BASE and CHECK of a trie over the codes 0, 1, ...; slot 0 is the root.

    ``grow`` adds the children of one level. A node's base is chosen so that all its children's slots are free: an only
    child takes the next free slot; for several children some bases among the free slots are tried, then the end
    of the array, where any set of codes fits.
    """

    TRIES = 16

    def __init__(self, n_codes: int):
        self.n_codes = max(n_codes, 1)
        self.base = np.zeros(1024, np.int64)
        self.check = np.full(1024, -1, np.int64)
        self.check[0] = 0
        self.free = 1  # every slot before it is taken
        self.end = 1  # every slot from it on is free

    def _room(self, slots: int) -> None:
        if slots > len(self.check):
            size = max(slots, 2 * len(self.check))
            self.base = np.concatenate([self.base, np.zeros(size - len(self.base), np.int64)])
            self.check = np.concatenate([self.check, np.full(size - len(self.check), -1, np.int64)])

    def _free(self, count: int) -> np.ndarray:
        """The first ``count`` free slots."""
        self._room(self.end + count)
        found = self.free + np.flatnonzero(self.check[self.free : self.end + count] < 0)[:count]
        return found

    def _take(self, parents: np.ndarray, slots: np.ndarray) -> None:
        self.check[slots] = parents
        self.end = max(self.end, int(slots.max()) + 1)
        while self.free < self.end and self.check[self.free] >= 0:
            ahead = np.flatnonzero(self.check[self.free : self.free + 4096] < 0)
            self.free += int(ahead[0]) if len(ahead) else min(4096, len(self.check) - self.free)

    def grow(self, parents: np.ndarray, codes: np.ndarray) -> None:
        """Children by (parent, code), distinct and ordered by parent."""
        starts = np.flatnonzero(np.r_[True, parents[1:] != parents[:-1]])
        sizes = np.diff(np.r_[starts, len(parents)])
        only = starts[sizes == 1]
        if len(only):
            slots = self._free(len(only))
            self.base[parents[only]] = slots - codes[only]
            self._take(parents[only], slots)
        for start, size in zip(starts[sizes > 1], sizes[sizes > 1]):
            parent, several = parents[start], np.sort(codes[start : start + size])
            for first in self._free(self.TRIES):
                slots = first + (several - several[0])
                self._room(int(slots[-1]) + 1)
                if (self.check[slots] < 0).all():
                    break
            else:
                slots = self.end + (several - several[0])
                self._room(int(slots[-1]) + 1)
            self.base[parent] = slots[0] - several[0]
            self._take(np.full(size, parent), slots)

    def step(self, states: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """The child of each state by its code, -1 where there is none."""
        slots = self.base[states] + codes
        inside = (slots >= 0) & (slots < len(self.check))
        found = np.full(len(states), -1, np.int64)
        found[inside] = np.where(self.check[slots[inside]] == states[inside], slots[inside], -1)
        found[found == 0] = -1  # the root is nobody's child
        return found


def packed(codes: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[DoubleArray, np.ndarray]:
    """The double array of the sequences ``codes[starts : starts + lengths]`` and the depth of every slot."""
    trie = DoubleArray(int(codes.max()) + 1 if len(codes) else 1)
    depths = np.zeros(1, np.int64)
    states = np.zeros(len(starts), np.int64)
    for d in range(int(lengths.max(initial=0))):
        on = np.flatnonzero(lengths > d)
        here, code = states[on], codes[starts[on] + d]
        edges = np.unique(here * trie.n_codes + code)
        trie.grow(edges // trie.n_codes, edges % trie.n_codes)
        states[on] = trie.step(here, code)
        if len(depths) < len(trie.check):
            depths = np.concatenate([depths, np.zeros(len(trie.check) - len(depths), np.int64)])
        depths[states[on]] = d + 1
    return trie, depths


def _shard(table: pa.Table, shallow: int) -> pa.Table:
    """The nodes of one shard."""
    lists = table["turns"].combine_chunks()
    lengths = np.diff(lists.offsets.to_numpy()).astype(np.int64)
    starts = lists.offsets.to_numpy()[:-1].astype(np.int64) - int(lists.offsets[0].as_py())
    coded = lists.flatten().dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    turns = coded.dictionary.to_pylist()
    words_of_code = np.zeros(len(turns), np.int64)
    words_of_code[codes] = table["words"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
    members, least = table["n"].to_numpy(), table["least"].to_numpy()
    spread = bool(table["spread"][0].as_py())

    trie, depths = packed(codes, starts, lengths)
    size = len(trie.check)
    count, first = np.zeros(size, np.int64), np.full(size, np.iinfo(np.int64).max)
    last, words = np.full(size, -1, np.int64), np.zeros(size, np.int64)
    ends = [None] * size
    states = np.zeros(len(starts), np.int64)
    count[0], first[0] = members.sum(), least.min()
    hashes = table["ends"].to_pylist()
    for d in range(int(lengths.max(initial=0)) + 1):
        for row in np.flatnonzero(lengths == d):
            ends[states[row]] = hashes[row]
        on = np.flatnonzero(lengths > d)
        if not len(on):
            break
        code = codes[starts[on] + d]
        states[on] = trie.step(states[on], code)
        np.add.at(count, states[on], members[on])
        np.minimum.at(first, states[on], least[on])
        last[states[on]], words[states[on]] = code, words_of_code[code]
    nodes = np.r_[0, 1 + np.flatnonzero(trie.check[1:] >= 0)]
    parents = trie.check
    children = np.bincount(parents[nodes[1:]], minlength=size)
    leaves, saved = (children == 0).astype(np.int64), (count - 1) * words
    by_depth = nodes[np.argsort(depths[nodes], kind="stable")]
    levels = np.split(by_depth, np.flatnonzero(np.diff(depths[by_depth])) + 1)
    for level in levels[:0:-1]:  # from the deepest up to the root's children
        np.add.at(leaves, parents[level], leaves[level])
        np.add.at(saved, parents[level], saved[level])

    # paths are hashed as far as other shards may know them
    keys = {0: ROOT}
    reach = int(depths.max()) if spread else shallow - 1
    for level in levels[1 : reach + 1]:
        for node in level:
            keys[node] = hashlib.blake2b(keys[parents[node]] + turns[last[node]], digest_size=16).digest()
    shared = np.array([n in keys for n in nodes])
    own_parent = [None if n == 0 else keys.get(int(parents[n])) for n in nodes]
    return pa.table(
        {
            "shared": shared,
            "key": pa.array([keys.get(n) for n in nodes], pa.binary()),
            "parent": pa.array(own_parent, pa.binary()),
            "parent_id": pa.array(first[parents[nodes]], mask=nodes == 0),
            "depth": depths[nodes],
            "conv_id": first[nodes],
            "n_convs": count[nodes],
            "n_children": children[nodes],
            "n_leaves": leaves[nodes],
            "saved_tokens": saved[nodes],
            "words": words[nodes],
            "ends": pa.array([ends[n] for n in nodes], pa.string()),
        }
    )


def sequences(turns: DataFrame, conversations: DataFrame) -> DataFrame:
    """(conv_id, seq, turns, words): each conversation's turn hashes in order, and a hash of them all.

    ``turns`` has (conv_id, place, role, text) with any number of rows; ``conversations`` has the conv_ids. ``place``
    orders the turns (null first).
    """
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), text_of()
    one = F.struct(
        F.col("place").isNotNull().alias("known"), F.col("place"), role.alias("role_hash"),
        # role and text are kept apart by the role's length
        F.md5(F.concat_ws(":", F.length(role).cast("string"), role, text)).alias("turn"),
        text.alias("text_order"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"),
    )
    ordered = (
        turns.filter("conv_id IS NOT NULL").select("conv_id", one.alias("one"))
        .select("conv_id", "one.known", "one.place", "one.role_hash", "one.text_order", "one.turn", "one.words")
        .withColumn("at", F.row_number().over(W.partitionBy("conv_id").orderBy("known", "place", "role_hash", "text_order")))
        .select("conv_id", F.struct("at", F.unhex("turn").alias("turn"), "words").alias("one"))
    )
    listed = ordered.groupBy("conv_id").agg(F.array_sort(F.collect_list("one")).alias("ones"))
    all_of = conversations.filter("conv_id IS NOT NULL").select("conv_id").distinct().join(listed, "conv_id", "left")
    ones = F.coalesce(F.col("ones"), F.array().cast("array<struct<at:int,turn:binary,words:bigint>>"))
    return all_of.select(
        "conv_id",
        F.md5(F.array_join(F.transform(ones["turn"], F.hex), "").cast("binary")).alias("seq"),
        ones["turn"].alias("turns"),
        ones["words"].alias("words"),
    )


def _streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per sequence from its blocks of ids in order; holds a running digest, never the ids."""
    seq, digest, n, least, out = None, None, 0, None, []

    def batch(rows):
        columns = list(zip(*rows)) if rows else [[], [], [], []]
        types = (pa.string(), pa.int64(), pa.int64(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["seq", "n", "least", "ends"])

    for part in batches:
        for s, count, low, ids in zip(*(part.column(c).to_pylist() for c in ("seq", "n", "low", "ids"))):
            if s != seq:
                if seq is not None:
                    out.append((seq, n, least, digest.hexdigest()))
                seq, digest, n, least = s, hashlib.sha256(ids.encode()), count, low
            else:
                digest.update(b"," + ids.encode())
                n += count
        if len(out) > 10_000:
            yield batch(out)
            out = []
    if seq is not None:
        out.append((seq, n, least, digest.hexdigest()))
    yield batch(out)


def members(of: DataFrame) -> DataFrame:
    """(seq, n, least, ends) from (seq, conv_id): how many conversations are equal, the least id, their ids' SHA-256."""
    block = F.shiftright("conv_id", BLOCK_BITS).alias("block")
    blocks = of.groupBy("seq", block).agg(F.array_sort(F.collect_list("conv_id")).alias("some")).select(
        "seq", "block", F.size("some").cast("long").alias("n"), F.element_at("some", 1).alias("low"),
        F.array_join(F.col("some").cast("array<string>"), ",").alias("ids"),
    )
    return (
        blocks.repartition("seq").sortWithinPartitions("seq", "block")
        .mapInArrow(_streamed, "seq string, n long, least long, ends string")
    )


def _dealt(distinct: DataFrame, shallow: int, weight: int) -> DataFrame:
    """Adds the shard: a bucket of whole prefixes, or one of the parts of a prefix that is too heavy."""
    turns = F.size("turns") + 1
    prefix = F.xxhash64(F.slice("turns", 1, shallow))
    marked = distinct.withColumn("prefix", prefix)
    weights = kept(marked.groupBy("prefix").agg(F.sum(turns).alias("turns_of")), "weights")
    total = weights.agg(F.coalesce(F.sum("turns_of"), F.lit(0))).first()[0]
    buckets = max(1, -(-total // weight))
    parts = F.ceil(F.col("turns_of") / weight)
    heavy = weights.filter(F.col("turns_of") > weight).select("prefix", parts.alias("parts"))
    salt = F.pmod(F.xxhash64("seq"), F.col("parts"))
    spread = F.col("parts").isNotNull()
    shard = F.when(spread, F.xxhash64("prefix", salt)).otherwise(F.pmod(F.xxhash64("prefix", F.lit(1)), F.lit(buckets)))
    return marked.join(heavy, "prefix", "left").select(
        F.struct(spread.alias("spread"), shard.alias("number")).alias("shard"), spread.alias("spread"),
        "n", "least", "ends", "turns", "words",
    )


def _merged(parts: DataFrame) -> DataFrame:
    """All nodes with subtree sums, from those of the shards."""
    shared = kept(
        parts.filter("shared").groupBy("key").agg(
            F.min("parent").alias("parent"), F.min("depth").alias("depth"), F.min("conv_id").alias("conv_id"),
            F.sum("n_convs").alias("n_convs"), F.max("words").alias("words"), F.max("ends").alias("ends"),
            F.count("*").alias("shards"), F.max("n_children").alias("n_children"),
            F.max("n_leaves").alias("n_leaves"), F.max("saved_tokens").alias("saved_tokens"),
        ),
        "shared",
    )
    # a node of one shard is whole there, and so is all below it
    whole = shared.filter("shards = 1")
    below = parts.filter("NOT shared AND parent IS NOT NULL").select("parent", "n_leaves", "saved_tokens").unionByName(
        whole.select("parent", "n_leaves", "saved_tokens")
    )
    from_below = below.groupBy("parent").agg(
        F.count("*").alias("whole_children"), F.sum("n_leaves").alias("leaves_below"), F.sum("saved_tokens").alias("saved_below")
    )
    several = shared.filter("shards > 1")
    open_children = several.groupBy("parent").agg(F.count("*").alias("open_children"))
    some = lambda c: F.coalesce(F.col(c), F.lit(0))
    children = some("whole_children") + some("open_children")
    own = several.select("key", "parent", "depth", "conv_id", "n_convs", "words", "ends").join(
        from_below.withColumnRenamed("parent", "key"), "key", "left"
    ).join(open_children.withColumnRenamed("parent", "key"), "key", "left")
    nodes = kept(
        own.select(
            "key", "parent", "depth", "conv_id", "n_convs", "ends", children.alias("n_children"),
            (some("leaves_below") + (children == 0).cast("long")).alias("n_leaves"),
            (some("saved_below") + (F.col("n_convs") - 1) * F.col("words")).alias("saved_tokens"),
        ),
        "several",
    )
    deepest = nodes.agg(F.coalesce(F.max("depth"), F.lit(0))).first()[0]
    sums, reach = nodes.select("key", F.col("parent").alias("up"), "n_leaves", "saved_tokens"), 1
    while reach <= deepest:
        rising = sums.filter("up IS NOT NULL").groupBy("up").agg(
            F.sum("n_leaves").alias("more_leaves"), F.sum("saved_tokens").alias("more_saved")
        ).withColumnRenamed("up", "key")
        further = sums.select(F.col("key").alias("up"), F.col("up").alias("up_further"))
        sums = kept(
            sums.join(rising, "key", "left").join(further, "up", "left").select(
                "key", F.col("up_further").alias("up"),
                (F.col("n_leaves") + some("more_leaves")).alias("n_leaves"),
                (F.col("saved_tokens") + some("more_saved")).alias("saved_tokens"),
            ),
            "rising",
        )
        reach *= 2
    summed = nodes.drop("n_leaves", "saved_tokens").join(sums.drop("up"), "key")
    # the parents of shared nodes are shared; so are those of the topmost nodes of a shard
    columns = ("depth", "conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends")
    lower = parts.filter("NOT shared")
    hanging = lower.filter("parent IS NOT NULL").select("parent", *columns).unionByName(
        whole.select("parent", *columns)
    ).unionByName(summed.select("parent", *columns))
    parents = shared.select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_id"))
    return lower.filter("parent IS NULL").select("parent_id", *columns).unionByName(
        hanging.join(parents, "parent", "left").select("parent_id", *columns)
    )


def nodes(turns: DataFrame, conversations: DataFrame, shallow: int = SHALLOW, weight: int = WEIGHT) -> DataFrame:
    """One row per node: (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256).

    ``turns``: (conv_id, place, role, text); ``conversations``: (conv_id) of all conversations, those without turns too.
    ``conv_id`` is the least member and names the node together with its depth. ``saved_tokens`` counts the words
    that need not be stored or computed again when the subtree's conversations share their prefixes.
    """
    if shallow < 1 or weight < 1:
        raise ValueError("shallow and weight are at least 1")
    listed = kept(sequences(turns, conversations), "sequences")
    stats = kept(members(listed.select("seq", "conv_id")), "members")
    distinct = listed.select(F.col("conv_id").alias("least"), "turns", "words").join(stats, "least")

    def shard(table: pa.Table) -> pa.Table:
        return _shard(table, shallow)

    parts = kept(_dealt(kept(distinct, "distinct"), shallow, weight).groupBy("shard").applyInArrow(shard, NODES), "nodes")
    return _merged(parts).select(
        "conv_id", "depth", F.col("parent_id").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"),
    )


def branched(conversations: DataFrame, every: int = 20, cuts: int = 4) -> tuple[DataFrame, DataFrame]:
    """(turns, conversations) in which each conversation begins like the first of its ``every`` ids.

    Conversation c takes the first h turns of conversation c - c % every and goes on with its own after its first h;
    h is the CRC-32 of the decimal id modulo ``cuts``.
    """
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), text_of()
    order = W.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "role", "text")
    rows = conversations.filter("conv_id IS NOT NULL").select("conv_id", "turn", role.alias("role"), text.alias("text"))
    placed = rows.withColumn("place", F.row_number().over(order).cast("long")).drop("turn")
    cut: Column = F.crc32(F.col("conv_id").cast("string").cast("binary")) % cuts
    ids = conversations.filter("conv_id IS NOT NULL").select("conv_id").distinct()
    heads = ids.select("conv_id", (F.col("conv_id") - F.col("conv_id") % every).alias("of"), cut.alias("cut")).filter("cut > 0")
    firsts = placed.filter(F.col("place") < cuts).withColumnRenamed("conv_id", "of")
    taken = heads.join(firsts, "of").filter(F.col("place") <= F.col("cut")).select("conv_id", "place", "role", "text")
    own = placed.filter(F.col("place") > cut).select("conv_id", "place", "role", "text")
    return taken.unionByName(own), ids
