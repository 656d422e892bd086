"""The prefix trie of conversations, by whole-sequence collapse.

Identical conversations become one weighted sequence with the list of those that end there. Sequences that are proper
prefixes of others are dropped by an anti-join; what is left are the leaves. The weighted prefixes of the sequences
are the nodes.

A prefix is known by two 60-bit exclusive-ors over its turns, each of a SHA-256 of the place, the turn and a key drawn
for the run. Exclusive-or is associative, so a conversation of any length is split over tasks; nobody who writes
conversations knows the key, so no two prefixes can be made to meet, and by chance they don't.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from starfold.llm.arrow import bounded_batches
from starfold.llm.scratch import Scratch
from starfold.session import shuffle_partitions

CHUNK = 256  # turns of a conversation that a task scans at once
NODE = ["depth", "x1", "x2"]
_EMPTY = hashlib.sha256(b"").hexdigest()


def turn_digest(role: Column, text: Column) -> Column:
    """SHA-256 of a turn, with nulls as empty; the length of the role keeps role and text apart."""
    role, text = F.coalesce(role, F.lit("")), F.coalesce(text, F.lit(""))
    return F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256))


def numbered(conversations: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Turns with their place from 0, and per conversation how many there are.

    Turns are ordered by ``turn``, null first, and equal ones by digest. They are sorted in ranges, so a conversation with a
    third of all turns is spread over tasks; places come from counts per conversation and range.
    """
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("digest")]
    rows = conversations.filter("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", turn_digest(F.col("role"), F.col("text")).alias("digest"),
        F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    ranged = rows.repartitionByRange(shuffle_partitions(scratch.spark), *order).sortWithinPartitions(*order)
    rows = scratch.write(ranged.select("conv_id", "digest", "n_bytes", F.spark_partition_id().alias("range_no"),
                                       F.monotonically_increasing_id().alias("seq")), "turns")
    pieces = rows.groupBy("conv_id", "range_no").agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("first_seq"))
    earlier = Window.partitionBy("conv_id").orderBy("range_no").rowsBetween(Window.unboundedPreceding, -1)
    pieces = scratch.write(pieces.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0))), "pieces")
    places = pieces.select(F.col("conv_id").alias("of_conv"), F.col("range_no").alias("of_range"), "before", "first_seq")
    match = (rows["conv_id"] == places["of_conv"]) & (rows["range_no"] == places["of_range"])
    placed = rows.join(places, match).select("conv_id", (F.col("before") + F.col("seq") - F.col("first_seq")).alias("place"),
                                             "digest", "n_bytes")
    return placed, pieces.groupBy("conv_id").agg(F.sum("n").alias("n_turns"))


def rebuilt(conversations: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Every conversation rebuilt: the first h turns of conversation c - c % 5, then its own turns after its first h.

    h is the CRC-32 of the decimal c, modulo 9. Returns turns (``conv_id``, ``depth`` from 1, ``digest``, ``n_bytes``) and
    conversations (``conv_id``, ``n_turns``), turnless ones included. % takes the sign of c.
    """
    turns, counts = numbered(conversations, scratch)
    borrowed = F.crc32(F.col("conv_id").cast("string").cast("binary")) % 9
    counts = counts.withColumn("h", borrowed).withColumn("base", F.col("conv_id") - F.col("conv_id") % 5)
    bases = counts.filter("conv_id = base").select(F.col("conv_id").alias("of_base"), F.col("n_turns").alias("n_base"))
    counts = scratch.write(counts.join(bases, counts["base"] == bases["of_base"], "left").select(
        "conv_id", "base", "h", F.least("h", F.coalesce("n_base", F.lit(0))).alias("taken"), "n_turns"), "conversations")
    turns = scratch.write(turns, "places")
    shift = counts.select(F.col("conv_id").alias("of_conv"), "h", "taken")
    own = turns.join(shift, turns["conv_id"] == shift["of_conv"]).filter("place >= h").select(
        "conv_id", (F.col("taken") + F.col("place") - F.col("h") + 1).alias("depth"), "digest", "n_bytes")
    # At most eight turns of a base, and nine conversations that take them.
    heads = turns.filter("place < 8 AND conv_id % 5 = 0").withColumnRenamed("conv_id", "of_base")
    takers = counts.filter("taken > 0").select("conv_id", "base", "h")
    lent = takers.join(heads, (takers["base"] == heads["of_base"]) & (F.col("place") < F.col("h"))).select(
        "conv_id", (F.col("place") + 1).alias("depth"), "digest", "n_bytes")
    sizes = counts.select("conv_id", (F.col("taken") + F.greatest(F.col("n_turns") - F.col("h"), F.lit(0))).alias("n_turns"))
    return own.unionByName(lent), sizes


def _scan(rows: DataFrame, names: list[str], total, descending: bool = False) -> DataFrame:
    """Replace ``names`` by their running ``total`` along ``depth`` of each conversation, in pieces of ``CHUNK`` turns.

    ``total`` is an aggregate function and the column function that adds two of its values. Conversations of several
    pieces get the totals of the pieces before.
    """
    aggregate, add = total
    order = F.desc if descending else F.asc
    rows = rows.withColumn("chunk", F.floor((F.col("depth") - 1) / CHUNK))
    within = Window.partitionBy("conv_id", "chunk").orderBy(order("depth")).rowsBetween(Window.unboundedPreceding, 0)
    scanned = rows.withColumns({n: aggregate(n).over(within) for n in names})
    earlier = Window.partitionBy("conv_id").orderBy(order("chunk")).rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.filter(F.col("n_turns") > CHUNK).groupBy("conv_id", "chunk").agg(*[aggregate(n).alias(n) for n in names])
    carried = sums.select(F.col("conv_id").alias("of_conv"), F.col("chunk").alias("of_chunk"),
                          *[F.coalesce(aggregate(n).over(earlier), F.lit(0)).alias(f"carried_{n}") for n in names])
    long = scanned.filter(F.col("n_turns") > CHUNK)
    long = long.join(carried, (F.col("conv_id") == F.col("of_conv")) & (F.col("chunk") == F.col("of_chunk")))
    long = long.withColumns({n: add(F.col(n), F.col(f"carried_{n}")) for n in names}).select(*scanned.columns)
    return scanned.filter(F.col("n_turns") <= CHUNK).unionByName(long).drop("chunk")


_XOR = (F.bit_xor, lambda a, b: a.bitwiseXOR(b))
_SUM = (F.sum, lambda a, b: a + b)


def _lane(digest: Column, at: int) -> Column:
    return F.conv(F.substring(digest, at, 15), 16, 10).cast("long")


def prefixes(turns: DataFrame, sizes: DataFrame) -> DataFrame:
    """Each turn with the key of the prefix that ends in it (``depth``, ``x1``, ``x2``) and of the one before (``p1``, ``p2``)."""
    sizes = sizes.select(F.col("conv_id").alias("of_conv"), "n_turns")
    rows = turns.join(sizes, turns["conv_id"] == sizes["of_conv"])
    keyed = F.sha2(F.concat(F.lit(uuid.uuid4().hex + " "), F.col("depth").cast("string"), F.lit(" "), F.hex("digest")).cast("binary"), 256)
    rows = rows.withColumn("keyed", keyed).select("conv_id", "depth", "n_turns", "digest", "n_bytes", _lane(F.col("keyed"), 1).alias("own1"),
                                                  _lane(F.col("keyed"), 16).alias("own2"))
    rows = _scan(rows.withColumns({"x1": F.col("own1"), "x2": F.col("own2")}), ["x1", "x2"], _XOR)
    return rows.withColumns({"p1": F.col("x1").bitwiseXOR(F.col("own1")), "p2": F.col("x2").bitwiseXOR(F.col("own2"))}).drop("own1", "own2")


def end_lists(ends: DataFrame) -> DataFrame:
    """Per node the SHA-256 of the ids that end there, decimal, ascending, joined by commas.

    A digest has to read its text in order, so the ids of one node go through one task, as a sorted stream: memory
    is bounded by a batch, whatever the number of ids.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, digest = None, None

        def closed(done: list) -> pa.RecordBatch:
            columns = list(zip(*done))
            return pa.RecordBatch.from_pydict({n: pa.array(c, pa.string() if n == "ends_sha256" else pa.int64())
                                               for n, c in zip([*NODE, "ends_sha256"], columns)})

        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.column_stack([batch.column(i).to_numpy() for i in range(3)])
            texts = pc.cast(batch.column(3), pa.string()).to_pylist()
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(texts)]
            done = []
            for start, stop in zip(cuts, cuts[1:]):
                key, piece = tuple(keys[start].tolist()), ",".join(texts[start:stop]).encode()
                if key == node:
                    digest.update(b"," + piece)
                    continue
                if node is not None:
                    done.append((*node, digest.hexdigest()))
                node, digest = key, hashlib.sha256(piece)
            if done:
                yield closed(done)
        if node is not None:
            yield closed([(*node, digest.hexdigest())])

    rows = ends.select(*NODE, "conv_id").repartition(*NODE).sortWithinPartitions(*NODE, "conv_id")
    return rows.mapInArrow(run, "depth long, x1 long, x2 long, ends_sha256 string")


def _on(left: DataFrame, right: DataFrame, names: list[str]) -> Column:
    """Match the key columns ``names`` of ``left`` with those of the same names after ``of_`` in ``right``."""
    match = F.lit(True)
    for n, m in zip(names, NODE):
        match = match & (left[n] == right[f"of_{m}"])
    return match


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """One row per node of the trie of rebuilt conversations (``rebuilt``).

    A node is a distinct sequence of the first ``depth`` turns (role and text), from the root without a turn. ``conv_id`` is
    its smallest member, ``n_convs`` the number of members, ``parent_conv_id`` the parent's ``conv_id`` (root: null),
    ``n_children`` and ``n_leaves`` count children and childless nodes below or at it; ``saved_tokens`` is the sum, over its
    subtree, of (``n_convs`` - 1) times the UTF-8 bytes of each node's last text, ``ends_sha256`` the digest of the ids of the
    conversations that end in it, and ``turn_digest`` that of its last turn (see ``with_texts``).

    Null roles and texts are empty ones. Turns without a ``conv_id`` are left out; repeated turns count as often as they
    occur; other columns are ignored. An empty table gives no node.
    """
    scratch = Scratch(conversations.sparkSession, "trie")
    bounded_batches(scratch.spark, 10_000)
    turns, sizes = rebuilt(conversations.select("conv_id", "turn", "role", "text"), scratch)
    sizes = scratch.write(sizes, "sizes")
    rows = scratch.write(prefixes(turns, sizes), "prefixes")

    # Identical conversations collapse into one sequence, that of the smallest id, with its weight.
    zero = F.lit(0).cast("long")
    ends = rows.filter("depth = n_turns").select(*NODE, "conv_id").unionByName(
        sizes.filter("n_turns = 0").select(zero.alias("depth"), zero.alias("x1"), zero.alias("x2"), "conv_id"))
    sequences = scratch.write(ends.groupBy(*NODE).agg(F.count(F.lit(1)).alias("weight"), F.min("conv_id").alias("conv_id")), "sequences")
    chosen = sequences.select(F.col("conv_id").alias("of_conv"), "weight")
    weighted = scratch.write(rows.join(chosen, rows["conv_id"] == chosen["of_conv"]).drop("of_conv"), "weighted")

    # Sequences that go on are no leaves.
    inner = weighted.filter("depth < n_turns").select(*[F.col(n).alias(f"of_{n}") for n in NODE])
    leaves = sequences.filter("depth > 0").join(inner, _on(sequences, inner, NODE), "left_anti")
    leaves = leaves.select(F.col("conv_id").alias("of_conv"), F.lit(1).alias("leaf"))
    marked = scratch.write(weighted.join(leaves, weighted["conv_id"] == leaves["of_conv"], "left").drop("of_conv"), "marked")

    nodes = marked.groupBy(*NODE).agg(
        F.min("conv_id").alias("conv_id"), F.sum("weight").alias("n_convs"), F.count("leaf").alias("n_leaves"),
        F.min(F.when(F.col("leaf") == 1, F.col("conv_id"))).alias("owner"), F.min("p1").alias("p1"), F.min("p2").alias("p2"),
        F.min("n_bytes").alias("n_bytes"), F.min("digest").alias("turn_digest"))
    nodes = scratch.write(nodes, "nodes")
    own = (F.col("n_convs") - 1) * F.col("n_bytes")

    # Each shared node is owned by one leaf sequence, so that sums along the sequences count it once.
    shared = nodes.filter("n_convs > 1").select(*[F.col(n).alias(f"of_{n}") for n in NODE], "owner", own.alias("own"))
    paths = marked.filter("leaf = 1").select("conv_id", "n_turns", *NODE)
    paths = paths.join(shared, _on(paths, shared, NODE))
    paths = paths.select("conv_id", "n_turns", *NODE, F.when(F.col("owner") == F.col("conv_id"), F.col("own")).otherwise(0).alias("saved_tokens"))
    saved = _scan(paths, ["saved_tokens"], _SUM, descending=True).groupBy(*NODE).agg(F.sum("saved_tokens").alias("saved_tokens"))

    children = nodes.groupBy((F.col("depth") - 1).alias("depth"), F.col("p1").alias("x1"), F.col("p2").alias("x2")).agg(
        F.count(F.lit(1)).alias("n_children"))
    # The root's counts are sums over three tables, each summed in parallel.
    parts = sequences.select("conv_id", "weight", zero.alias("leaf"), zero.alias("own")).unionByName(
        leaves.select(F.lit(None).cast("long").alias("conv_id"), zero.alias("weight"), F.col("leaf").cast("long"), zero.alias("own"))
    ).unionByName(nodes.select(F.lit(None).cast("long").alias("conv_id"), zero.alias("weight"), zero.alias("leaf"), own.alias("own")))
    root = parts.agg(F.min("conv_id").alias("conv_id"), F.sum("weight").alias("n_convs"), F.sum("leaf").alias("leaf"),
                     F.sum("own").alias("root_saved")).filter("n_convs > 0")
    nothing = F.lit(None).cast("long")
    root = root.select(zero.alias("depth"), zero.alias("x1"), zero.alias("x2"), "conv_id", "n_convs",
                       F.greatest("leaf", F.lit(1)).alias("n_leaves"), nothing.alias("p1"), nothing.alias("p2"),
                       F.lit(None).cast("binary").alias("turn_digest"), "root_saved")
    every = nodes.select("depth", "x1", "x2", "conv_id", "n_convs", "n_leaves", "p1", "p2", "turn_digest",
                         nothing.alias("root_saved")).unionByName(root)
    for more in (children, saved, end_lists(ends)):
        renamed = more.select(*[F.col(n).alias(f"of_{n}") for n in NODE], *[c for c in more.columns if c not in NODE])
        every = every.join(renamed, _on(every, renamed, NODE), "left").drop(*[f"of_{n}" for n in NODE])
    every = scratch.write(every, "counted")
    parents = every.select(*[F.col(n).alias(f"of_{n}") for n in NODE], F.col("conv_id").alias("parent_conv_id"))
    match = (every["depth"] - 1 == parents["of_depth"]) & (every["p1"] == parents["of_x1"]) & (every["p2"] == parents["of_x2"])
    return every.join(parents, match, "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", zero).alias("n_children"), "n_leaves",
        F.coalesce("root_saved", "saved_tokens", zero).alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(_EMPTY)).alias("ends_sha256"),
        F.lower(F.hex("turn_digest")).alias("turn_digest"))


def with_texts(nodes: DataFrame, conversations: DataFrame) -> DataFrame:
    """Add ``role`` and ``text`` of each node's last turn to the rows of ``prefix_trie``; null at the root."""
    digest = F.lower(F.hex(turn_digest(F.col("role"), F.col("text"))))
    turns = conversations.select(digest.alias("of_digest"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    turns = turns.groupBy("of_digest").agg(F.first("role").alias("role"), F.first("text").alias("text"))
    return nodes.join(turns, nodes["turn_digest"] == turns["of_digest"], "left").drop("of_digest")
