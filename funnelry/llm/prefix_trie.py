"""Trie of the shared prefixes of rebuilt conversations, by composable fingerprints.

A conversation is rebuilt as a head, the first turns of its base conversation, and
its own turns behind as many. No rebuilt text is made. The fingerprint of a sequence
of turns is the polynomial product sum(e_i * B^i) mod 2^127 - 1, a monoid: that of
s followed by t is f(s) + B^len(s) * f(t). So each conversation's own prefixes are
fingerprinted once, in blocks of ``BLOCK`` turn numbers that are combined
afterwards, and every rebuilt prefix follows from two stored products by one
affine map, f = shift + B^k * own, whose two constants belong to the conversation.

Prefixes of one depth and fingerprint are a node. A node is verified through the
references to its members' last turns: all must have one digest (128 other bits of
SHA-256 over role and text) and one parent. If any node fails, all is done anew with
the next base.

Sums over subtrees take no walk. The smallest member of a node is its owner; the nodes
of one owner are the lower end of its path. So a subtree's sum is the sum over
its members of what each owns, with the owner's own path cut at the node.

Defined cases: rows without a conversation id take no part; null role or text is
empty; turns go by number, null first, ties by role, then text; a repeated row is
a turn each time; ids divide as in SQL (the remainder has the id's sign); an empty table gives no rows; other
columns are not read.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tasks import small_batches, stored

MODULUS = (1 << 127) - 1
#: Bases of the polynomial; a later one is used only if nodes made with an earlier one fail.
BASES = (0x1F3D5B79A2C4E6081B3D5F7A9C2E4F61, 0x2545F4914F6CDD1D9E3779B97F4A7C15, 0x369DEA0F31A53F85D1342543DE82EF95)
#: Turn numbers, or depths, of one block; ids of one chunk of an id list.
BLOCK, CHUNK = 512, 4096
HEAD = 3
_FIRST = -(1 << 63)


def joined(first: int, length: int, second: int, base: int, modulus: int) -> int:
    """The fingerprint of a sequence of ``length`` turns followed by another."""
    return (first + pow(base, length, modulus) * second) % modulus


def _cell(value: int) -> bytes:
    return value.to_bytes(16, "big")


def _number(cell: bytes) -> int:
    return int.from_bytes(cell, "big")


def _halves(value: int) -> tuple[int, int]:
    """The 128 bits as two signed numbers."""
    return struct.unpack(">qq", _cell(value))


def _mapped(rows: DataFrame, schema: str, function: Callable[[Iterator[tuple]], Iterator[tuple]]) -> DataFrame:
    """``rows`` through ``function``, which gets a task's rows one by one, in order, and yields tuples of ``schema``."""
    names = [x.split()[0] for x in schema.split(", ")]
    types = {"long": pa.int64(), "binary": pa.binary(), "string": pa.string()}
    kinds = [types[x.split()[1]] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each():
            for batch in batches:
                yield from zip(*(c.to_pylist() for c in batch.columns))

        out: list[tuple] = []
        for row in function(each()):
            out.append(row)
            if len(out) == 4096:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)

    return rows.mapInArrow(run, schema)


def _own_prefixes(turns: DataFrame, base: int, modulus: int) -> DataFrame:
    """(conv, place, before, value, check_a, check_b, words): each turn with the fingerprints
    of its own conversation's turns before it and up to it. Written."""

    def scan(rows: Iterator[tuple]) -> Iterator[tuple]:
        now, place, value, power = None, 0, 0, 1
        for conv, block, _, role, text in rows:
            if (conv, block) != now:
                now, place, value, power = (conv, block), 0, 0, 1
            role, text = role.encode(), text.encode()
            digest = hashlib.sha256(len(role).to_bytes(8, "big") + role + text).digest()
            before, value = value, (value + power * (_number(digest[:16]) % modulus)) % modulus
            yield (conv, block, place, _cell(before), _cell(value), *_halves(_number(digest[16:])), len(text.split()))
            place, power = place + 1, power * base % modulus

    def add_up(rows: Iterator[tuple]) -> Iterator[tuple]:
        now, first, value = None, 0, 0
        for conv, block, last, cell in rows:
            if conv != now:
                now, first, value = conv, 0, 0
            yield conv, block, first, _cell(value)
            first, value = first + last + 1, joined(value, first, _number(cell), base, modulus)

    def place(rows: Iterator[tuple]) -> Iterator[tuple]:
        for conv, first, head, at, before, value, *rest in rows:
            head = _number(head)
            yield (conv, first + at, *(_cell(joined(head, first, _number(x), base, modulus)) for x in (before, value)), *rest)

    # a block's turns are neighbours in one task; texts end here
    inside = stored(_mapped(turns.repartition("conv", "block").sortWithinPartitions("conv", "block", "turn", "role", "text"),
                            "conv long, block long, place long, before binary, value binary, check_a long, check_b long, words long",
                            scan), "turn-blocks")
    blocks = inside.groupBy("conv", "block").agg(F.max("place").alias("last"), F.max_by("value", "place").alias("value"))
    heads = _mapped(blocks.repartition("conv").sortWithinPartitions("conv", "block"),
                    "conv long, block long, first long, head binary", add_up)
    rows = inside.join(heads, ["conv", "block"]).select(
        "conv", "first", "head", "place", "before", "value", "check_a", "check_b", "words")
    return stored(_mapped(rows, "conv long, place long, before binary, value binary, check_a long, check_b long, words long",
                          place), "turn-prefixes")


def _seams(own: DataFrame, base_of, head_of, longest: int, base: int, modulus: int) -> tuple[DataFrame, DataFrame]:
    """(conv, skip, taken, shift, depth, end_a, end_b): how a conversation is rebuilt, and its end node;
    and (conv, at, source, ...), the turns that it takes from its base. Both written."""
    first = own.where(F.col("place") < longest).groupBy("conv").agg(F.sort_array(F.collect_list(
        F.struct("place", "before", "value", "check_a", "check_b", "words"))).alias("turns"))
    size = own.groupBy("conv").agg(F.count("*").alias("n"), F.max_by("value", "place").alias("total"))
    convs = size.join(first, "conv").withColumn("source", base_of(F.col("conv")).cast("long")) \
        .withColumn("skip", F.least(F.greatest(head_of(F.col("conv")), F.lit(0)), F.lit(longest)).cast("long"))
    heads = first.select(F.col("conv").alias("source"), F.col("turns").alias("head"))
    convs = convs.join(heads, "source", "left").select(
        "conv", "n", "skip", "source", "total",
        F.when(F.col("skip") > 0, F.element_at("turns", F.least("skip", F.size("turns")).cast("int"))["value"]).alias("own_head"),
        F.slice(F.coalesce("head", F.array()), 1, F.col("skip").cast("int")).alias("head"))
    convs = convs.withColumn("taken", F.size("head").cast("long")) \
        .withColumn("base_head", F.when(F.col("taken") > 0, F.element_at("head", -1)["value"]))
    convs = stored(convs, "rebuilt")

    def sew(rows: Iterator[tuple]) -> Iterator[tuple]:
        for conv, n, skip, taken, total, own_head, base_head in rows:
            start = _number(base_head) if taken else 0
            shift, end = start, start
            if n > skip:  # the own turns behind the head keep their place in the product, moved by one power
                move = pow(base, taken - skip, modulus)
                shift = (start - move * (_number(own_head) if skip else 0)) % modulus
                end = (shift + move * _number(total)) % modulus
            yield (conv, skip, taken, _cell(shift), taken + max(0, n - skip), *_halves(end))

    seams = stored(_mapped(convs.select("conv", "n", "skip", "taken", "total", "own_head", "base_head"),
                           "conv long, skip long, taken long, shift binary, depth long, end_a long, end_b long", sew), "seams")
    return seams, convs.select("conv", "source", F.inline("head"))


def _members(own: DataFrame, seams: DataFrame, heads: DataFrame, base: int, modulus: int) -> DataFrame:
    """A row per rebuilt conversation and depth: its node (a, b), its parent node, and its last
    turn: the reference to it (source, place), its digest and its words. Written."""
    schema = ("conv long, depth long, a long, b long, parent_a long, parent_b long, source long, place long, "
              "check_a long, check_b long, words long")

    def move(rows: Iterator[tuple]) -> Iterator[tuple]:
        for conv, skip, taken, shift, place, before, value, *check in rows:
            shift, power = _number(shift), pow(base, taken - skip, modulus)
            here, parent = ((shift + power * _number(x)) % modulus for x in (value, before))
            yield (conv, taken + place - skip + 1, *_halves(here), *_halves(parent), conv, place, *check)

    def take(rows: Iterator[tuple]) -> Iterator[tuple]:
        for conv, source, place, before, value, *check in rows:
            yield (conv, place + 1, *_halves(_number(value)), *_halves(_number(before)), source, place, *check)

    behind = own.join(seams.select("conv", "skip", "taken", "shift"), "conv").where("place >= skip").select(
        "conv", "skip", "taken", "shift", "place", "before", "value", "check_a", "check_b", "words")
    none = [F.lit(0).cast("long").alias(c.split()[0]) for c in schema.split(", ")[1:]]
    return stored(_mapped(behind, schema, move).unionByName(_mapped(heads, schema, take))
                  .unionByName(seams.select("conv", *none)), "trie-members")


def _later_sums(rows: DataFrame, key: str, order: str, values: list[str], block: int) -> DataFrame:
    """``rows`` with each value's sum over the rows of its key from it on, in blocks: no task needs a whole key."""
    rows = rows.withColumn("block", F.floor(F.col(order) / block))
    inside = Window.partitionBy(key, "block").orderBy(F.desc(order)).rowsBetween(Window.unboundedPreceding, 0)
    after = Window.partitionBy(key).orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    later = rows.groupBy(key, "block").agg(*[F.sum(v).alias(f"{v}_block") for v in values]).select(
        key, "block", *[F.coalesce(F.sum(f"{v}_block").over(after), F.lit(0)).alias(f"{v}_after") for v in values])
    sums = rows.select("*", *[F.sum(v).over(inside).alias(f"{v}_inside") for v in values]).join(later, [key, "block"])
    return sums.select(*[c for c in rows.columns if c not in ("block", *values)],
                       *[(F.col(f"{v}_inside") + F.col(f"{v}_after")).alias(v) for v in values])


def _end_digests(seams: DataFrame) -> DataFrame:
    """(depth, a, b, ends_sha256) of the nodes at which conversations end. The ids of a node
    meet as sorted chunks, which one digest takes up one after the other."""
    ids = F.array_join(F.transform(F.sort_array(F.collect_list("conv")), lambda c: c.cast("string")), ",")
    chunks = seams.groupBy("depth", F.col("end_a").alias("a"), F.col("end_b").alias("b"),
                           F.floor(F.col("conv") / CHUNK).alias("chunk")).agg(ids.alias("ids"))

    def digest(rows: Iterator[tuple]) -> Iterator[tuple]:
        now, found = None, None
        for depth, a, b, _, text in rows:
            if (depth, a, b) != now:
                if now is not None:
                    yield (*now, found.hexdigest())
                now, found = (depth, a, b), hashlib.sha256()
            else:
                found.update(b",")
            found.update(text.encode())
        if now is not None:
            yield (*now, found.hexdigest())

    chunks = chunks.repartition("depth", "a", "b").sortWithinPartitions("depth", "a", "b", "chunk")
    return _mapped(chunks, "depth long, a long, b long, ends_sha256 string", digest)


def _nodes(members: DataFrame) -> DataFrame:
    """A row per node, with ``whole``: whether its members have one last turn and one parent. Written."""
    one = ["parent_a", "parent_b", "check_a", "check_b", "words"]
    found = members.groupBy("depth", "a", "b").agg(
        F.min("conv").alias("owner"), F.count("*").alias("n_convs"), *[F.min(c).alias(c) for c in one],
        F.min(F.struct("conv", "source", "place")).alias("turn"), F.expr(" AND ".join(f"min({c}) = max({c})" for c in one)).alias("whole"))
    return stored(found, "trie-nodes")


def _keyed(rows: DataFrame, *keys) -> DataFrame:
    """With a hash of the keys: joins on it exchange both sides, so that adaptive execution can split a hot key."""
    return rows.withColumn("at", F.xxhash64(*keys))


def prefix_trie(turns: DataFrame, base_of: Callable[[Column], Column], head_of: Callable[[Column], Column],
                key: str = "conv_id", order: str = "turn", role: str = "role", text: str = "text", longest_head: int = HEAD,
                block: int = BLOCK, bases: tuple[int, ...] = BASES, modulus: int = MODULUS) -> DataFrame:
    """One row per node: ``key`` (its smallest member), depth, the parent's ``key``, n_convs,
    n_children, n_leaves, saved_tokens, ends_sha256, and the stored turn that is its last
    (turn_source, turn_place: the conversation and the place in it, from 0; null at the root).

    ``base_of`` gives the id of the conversation from which a conversation takes its head,
    ``head_of`` how many turns, at most ``longest_head``.
    """
    small_batches(turns.sparkSession)
    number = F.col(order).cast("long")
    rows = turns.where(F.col(key).isNotNull()).select(
        F.col(key).cast("long").alias("conv"), F.coalesce(F.floor(number / block), F.lit(_FIRST)).alias("block"),
        number.alias("turn"), *[F.coalesce(c, F.lit("")).alias(name) for c, name in ((role, "role"), (text, "text"))])
    for base in bases:
        own = _own_prefixes(rows, base, modulus)
        seams, heads = _seams(own, base_of, head_of, longest_head, base, modulus)
        members = _members(own, seams, heads, base, modulus)
        nodes = _nodes(members)
        if not nodes.where("NOT whole").limit(1).count():
            return _report(members, nodes, seams, key, block)
    raise RuntimeError("nodes of different prefixes share a fingerprint under every base")


def _report(members: DataFrame, nodes: DataFrame, seams: DataFrame, key: str, block: int) -> DataFrame:
    node = ["depth", "a", "b"]
    up = [F.col("depth") - 1, F.col("parent_a"), F.col("parent_b")]
    children = nodes.where("depth > 0").groupBy(*[c.alias(n) for c, n in zip(up, node)]).agg(F.count("*").alias("n_children"))
    counted = nodes.join(children, node, "left").select(
        *node, "owner", "n_convs", F.coalesce("n_children", F.lit(0)).alias("n_children"), "parent_a", "parent_b", "turn",
        ((F.col("n_convs") - 1) * F.col("words")).alias("saved"),
        F.when(F.col("n_children").isNull(), 1).otherwise(0).cast("long").alias("leaves"))
    counted = stored(counted, "trie-counts")
    values = ["saved", "leaves"]
    paths = counted.groupBy("owner").agg(*[F.sum(v).alias(f"all_{v}") for v in values])
    below = _keyed(members.select("conv", *node), "conv").join(
        _keyed(paths, "owner"), "at").where("conv = owner").groupBy(*node).agg(
        *[F.sum(f"all_{v}").alias(f"below_{v}") for v in values])
    rest = _later_sums(counted.select("owner", *node, *values), "owner", "depth", values, block)
    # what its members own, the owner's path from the node on
    sums = rest.join(_keyed(paths, "owner").select(F.col("owner").alias("own"), *[f"all_{v}" for v in values]),
                     F.col("owner") == F.col("own")).join(below, node).select(
        *node, *[(F.col(v) - F.col(f"all_{v}") + F.col(f"below_{v}")).alias(v) for v in values])
    parents = _keyed(nodes, *node).select("at", *[F.col(c).alias(f"p_{c}") for c in node], F.col("owner").alias("parent"))
    up_is = (F.col("p_depth") == up[0]) & (F.col("p_a") == up[1]) & (F.col("p_b") == up[2])
    named = _keyed(counted.drop(*values), *up).alias("n").join(
        parents.alias("p"), (F.col("n.at") == F.col("p.at")) & up_is, "left").drop("at")
    found = named.join(sums, node).join(_end_digests(seams), node, "left")
    real = lambda c: F.when(F.col("depth") > 0, F.col(c))
    return found.select(
        F.col("owner").alias(key), "depth", F.col("parent").alias(f"parent_{key}"), "n_convs", "n_children",
        F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"),
        real("turn.source").alias("turn_source"), real("turn.place").alias("turn_place"))
