"""The prefix trie against a trie built turn by turn."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from funnelry.llm import prefix_trie
from pyspark.sql import functions as F

SCHEMA = "conv_id long, turn long, role string, text string, block string, owner long"


def trie(rows):
    """conv -> rows of (conv_id, depth, parent, n_convs, n_children, n_leaves, saved, ends)."""
    said = defaultdict(list)
    for conv, turn, role, text, *_ in rows:
        if conv is not None:
            said[conv].append((turn is not None, turn or 0, (role or "").encode(), (text or "").encode()))
    said = {c: [t[2:] for t in sorted(own)] for c, own in said.items()}
    rebuilt = {}
    for c, own in said.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (c % 20 if c >= 0 else -(-c % 20))
        rebuilt[c] = tuple(said.get(base, [])[:h] + own[h:])
    members = defaultdict(list)
    for c, turns in rebuilt.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        words = len(node[-1][1].split()) if node else 0
        leaves[node] = sum(leaves[c] for c in children[node]) if children[node] else 1
        saved[node] = (len(members[node]) - 1) * words + sum(saved[c] for c in children[node])
    out = []
    for node, own in members.items():
        ends = ",".join(str(c) for c in sorted(own) if len(rebuilt[c]) == len(node))
        out.append((min(own), len(node), min(members[node[:-1]]) if node else None, len(own), len(children[node]),
                    leaves[node], saved[node], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def built(spark, rows, **options):
    frame = spark.createDataFrame([(*r, "x", -1) for r in rows], SCHEMA)
    found = prefix_trie.prefix_trie(frame, base_of=lambda c: c - c % 20, head_of=lambda c: F.crc32(c.cast("string")) % 4, **options)
    assert found.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
                             "ends_sha256", "turn_source", "turn_place"]
    return found


def plain(found):
    return sorted((tuple(r)[:8] for r in found.collect()), key=str)


def conversations(seed, n, longest):
    rnd = random.Random(seed)
    rows = []
    for c in range(-25, n):
        for t in range(rnd.choice([0, 1, 2, 3, rnd.randint(1, longest)])):
            turn = rnd.choice([t, t, t, None, 1])
            rows.append((c, turn, rnd.choice(["user", "assistant", None]),
                         rnd.choice([None, "", "ok", "ok ok", "go on", " a\tb\u2003c "])))
    return rows


def test_trie_equals_one_built_turn_by_turn(spark):
    rows = conversations(1, 90, 9) + [(None, 0, "user", "x"), (40, 0, "user", "ok"), (40, 0, "user", "ok")]
    rows = [tuple(r) for r in rows]
    assert plain(built(spark, rows)) == trie(rows)
    # small blocks: products are combined across them
    assert plain(built(spark, rows, block=2)) == trie(rows)


def test_many_copies_and_a_long_conversation(spark):
    rows = [(c, t, "user", f"say {t}") for c in range(9000) for t in range(2)] + [(9001, t, "user", f"w {t % 7}") for t in range(1500)]
    assert plain(built(spark, rows)) == trie(rows)


def test_last_turns_are_references_to_stored_turns(spark):
    rows = [(0, 0, "user", "a"), (0, 1, "assistant", "b"), (0, 2, "user", "c"), (1, 0, "user", "z"), (1, 1, "user", "q"), (1, 5, "user", "c")]
    said = defaultdict(list)
    for r in rows:
        said[r[0]].append(r)
    found = built(spark, rows).collect()
    assert all((r.turn_source is None) == (r.depth == 0) for r in found)
    assert all(said[r.turn_source][r.turn_place] for r in found if r.depth)


def test_empty_table_and_rows_without_an_id(spark):
    assert built(spark, []).collect() == []
    assert built(spark, [(None, 1, "user", "x")]).collect() == []


def test_colliding_fingerprints_are_found_out_and_never_merged(spark):
    rows = [(c, t, "user", f"{c} {t}") for c in range(0, 400, 20) for t in range(3)]
    with pytest.raises(RuntimeError):  # 13 values cannot tell 60 prefixes apart under any base
        built(spark, rows, modulus=13, bases=(2, 5))
    # a base that fails is followed by one that does not
    assert plain(built(spark, rows, bases=(0, prefix_trie.BASES[0]))) == trie(rows)


def test_products_compose():
    p, b = prefix_trie.MODULUS, prefix_trie.BASES[0]
    f = lambda s: sum(x * pow(b, i, p) for i, x in enumerate(s)) % p
    s, t = [3, 1, 4, 1, 5], [9, 2, 6]
    assert prefix_trie.joined(f(s), len(s), f(t), b, p) == f(s + t)
