"""Line, near, substring and suffix dedup against brute force on small tables."""

import random

import brute
import numpy as np
import pytest
from funnelry.llm import decontaminate, graph, line_dedup, near_dedup, repeats, rolling, substring_dedup, suffix_dedup
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, kept boolean, n_lines string"


def frame(spark, rows):
    """With columns whose names clash with those of results."""
    return spark.createDataFrame([(k, t, None, "x") for k, t in rows], SCHEMA)


def corpus(seed=3, n=60):
    """Texts that share passages, repeat themselves, copy one another with edits; odd cases; no repeated id."""
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdeé") for _ in range(rnd.randint(1, 4)))
    line = lambda: " ".join(word() for _ in range(rnd.randint(1, 14)))
    passages = [[line() for _ in range(rnd.randint(2, 6))] for _ in range(5)]
    texts = [None, "", " \n\t\n", "one", "One", "one two", "ONE  two\n", "a\x00b \x1c c", "é" * 400, "ab " * 900, "z" * 300]
    while len(texts) < n:
        kind = rnd.random()
        if kind < 0.25 and len(texts) > 14:
            words = (rnd.choice(texts[11:]) or "").split(" ")
            for _ in range(rnd.randint(0, 3)):
                words[rnd.randrange(len(words))] = word()
            texts.append(" ".join(words))
        else:
            body = [line() for _ in range(rnd.randint(1, 12))]
            for _ in range(rnd.randint(0, 2)):
                at = rnd.randrange(len(body) + 1)
                body[at:at] = rnd.choice(passages)
            texts.append("\n".join(body))
    return list(enumerate(texts))


def test_line_dedup_matches_brute_force(spark):
    rows = corpus()
    for n, gram in ((2, 1), (3, 2), (1, 1)):
        got = line_dedup.dedup_lines(frame(spark, rows).drop("n_lines"), min_lines=n, gram=gram)
        got = {r.doc_id: (r.text, r.n_lines, r.n_removed, r.n_runs) for r in got.collect()}
        assert got == {k: v for (k, _), v in zip(rows, brute.line_dedup(rows, n))}
    short = line_dedup.dedup_lines(frame(spark, rows), passage_words=8).collect()
    assert {r.doc_id: (r.text, r.n_lines, r.n_removed, r.n_runs) for r in short} == {
        k: v for (k, _), v in zip(rows, brute.line_dedup(rows, 2, 8))}
    assert any(v[2] for v in got.values())


def test_line_dedup_order_of_nulls_repeats_and_clashing_columns(spark):
    rows = [(5, "a\nb\nc"), (None, "x\na\nb"), (5, "a\nb\nc"), (7, "a \n\n b\nd"), (8, None)]
    got = line_dedup.dedup_lines(frame(spark, rows))
    assert got.columns == ["doc_id", "kept", "text", "n_lines", "n_removed", "n_runs"]
    got = sorted(((r.doc_id, r.text, r.n_lines, r.n_removed) for r in got.collect()), key=str)
    assert got == sorted([(None, "x\na\nb", 3, 0), (5, "c", 3, 2), (5, "c", 3, 2), (7, "\nd", 3, 2), (8, None, 0, 0)], key=str)


def test_line_dedup_passage_in_one_line(spark):
    passage = " ".join(f"w{i}" for i in range(60))
    rows = [(1, f"a\n{passage}\nb"), (2, f"c\n {passage} \nd\ncookies"), (3, passage), (4, "cookies\nx\na\nb"), (5, "y\na\nb"),
            (6, f"e\n{passage}\n\n{passage}\nf")]
    run = lambda **kw: {r.doc_id: (r.text, r.n_removed, r.n_runs) for r in line_dedup.dedup_lines(
        spark.createDataFrame(rows, "doc_id long, text string"), **kw).collect()}
    assert run() == run(passage_words=60) == {
        1: (f"a\n{passage}\nb", 0, 0), 2: ("c\nd\ncookies", 1, 1), 3: ("", 1, 1), 4: ("cookies\nx\na\nb", 0, 0), 5: ("y", 2, 1),
        6: ("e\n\nf", 2, 1)}
    assert run(passage_words=61) == run(passage_words=None)
    assert {k: v[0] for k, v in run(passage_words=None).items()} == {**dict(rows), 5: "y"}


def test_columns_with_dots_and_names_of_results_pass_through(spark):
    row = spark.createDataFrame([(1, "a\nb", 2, "x", ("y",))], "doc_id long, text string, `a.b` int, `c``d` string, `e f` struct<`g.h`:string>")
    for done in (line_dedup.dedup_lines(row), decontaminate.find_leaks(row, spark.createDataFrame([(1, "q")], "item_id long, text string"), whole_rows=True)):
        got = done.first()
        assert (got["a.b"], got["c`d"], got["e f"]["g.h"], got["text"]) == (2, "x", "y", "a\nb")


@pytest.mark.parametrize("hot, chunk", [(repeats.HOT, 8 << 20), (2, 700), (5, 4000)])
def test_substring_dedup_matches_brute_force(spark, hot, chunk):
    rows = corpus(4) + [(None, "p q " * 30), (3, "one")]
    for length, seed in ((6, 3), (35, 10)):
        got = substring_dedup.drop_repeats(frame(spark, rows), length=length, seed=seed, hot=hot, chunk_bytes=chunk)
        got = sorted(((r.doc_id, r.n_words, r.n_removed, r.kept) for r in got.collect()), key=str)
        assert got == sorted(((k, *v) for (k, _), v in zip(rows, brute.drop_repeats(rows, length))), key=str)


@pytest.mark.parametrize("hot, chunk", [(repeats.HOT, 8 << 20), (2, 700), (5, 4000)])
def test_suffix_dedup_matches_brute_force(spark, hot, chunk):
    rows = corpus(5) + [(None, "é" * 60), (3, "one"), (12, "é" * 90)]
    for length, seed in ((11, 4), (50, 16)):
        got = suffix_dedup.drop_later_copies(frame(spark, rows), length=length, seed=seed, hot=hot, chunk_bytes=chunk)
        got = sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got.collect()), key=str)
        assert got == sorted(((k, *v) for (k, _), v in zip(rows, brute.drop_later_copies(rows, length))), key=str)


def test_suffix_dedup_compares_bytes_of_strings_that_hash_alike(monkeypatch):
    """With one hash for all spans, bytes alone tell strings apart."""
    import pyarrow as pa

    monkeypatch.setattr(rolling, "span_hashes", lambda data, starts, ends: np.zeros(len(starts), np.uint64))
    monkeypatch.setattr(suffix_dedup, "COMPARED", 40)
    length, k = 11, 4
    rows = [(i, t) for i, t in corpus(5) if t]
    chunks = [pa.table({"chunk": pa.array([c] * len(rows[c::2]), pa.int64()), "id": [i for i, _ in rows[c::2]],
                        "version": [0] * len(rows[c::2]), "text": [t for _, t in rows[c::2]]}) for c in (0, 1)]
    seeds = np.unique(np.concatenate([repeats.anchor_runs(
        *suffix_dedup._byte_units(*repeats.texts_of(c)), k, length)[0] for c in chunks]))
    shared = pa.table({"seeds": [repeats.packed_seeds(seeds)], "hot": [repeats.blob(np.zeros(len(seeds)), "u1")]})
    sent = pa.concat_tables(suffix_dedup._sender(1, length, k)(c, shared) for c in chunks)
    hits = pa.concat_tables(suffix_dedup._sorter(length)(sent.filter(pa.compute.equal(sent.column("group"), g)))
                            for g in sent.column("group").unique().to_pylist())
    got = {}
    for i, chunk in enumerate(chunks):
        own = hits.filter(pa.compute.equal(hits.column("chunk"), i))
        for r in suffix_dedup._cutter(length)(chunk, own).to_pylist():
            got[r["id"]] = (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept"])
    assert got == {i: v for (i, _), v in zip(rows, brute.drop_later_copies(rows, length))}


def test_deep_shallow_groups_are_the_equal_windows():
    rnd = np.random.default_rng(1)
    data = np.concatenate([rnd.integers(97, 99, 300), np.full(200, 97), np.tile(rnd.integers(97, 100, 30), 6)]).astype(np.uint8)
    for length, shallow in ((20, 16), (20, 8), (50, 16), (5, 16), (9, 0)):
        starts = np.arange(len(data) - length + 1)
        labels = suffix_dedup.deep_shallow_groups(data, starts, length, shallow)
        by_text, by_label = {}, {}
        for s, label in zip(starts, labels):
            by_text.setdefault(data[s:s + length].tobytes(), set()).add(int(s))
            by_label.setdefault(int(label), set()).add(int(s))
        assert sorted(map(sorted, by_text.values())) == sorted(map(sorted, by_label.values()))


def test_near_dedup_matches_brute_force(spark):
    rows = corpus(6, 90)
    for words, percent in ((3, 85), (5, 80)):
        got = {r.doc_id: (r.n_shingles, r.component_id, r.kept)
               for r in near_dedup.near_duplicates(frame(spark, rows), words=words, percent=percent).collect()}
        assert got == {k: (n, c, k == c) for k, (n, c) in brute.components(rows, words, percent).items()}
    assert sum(not v[2] for v in got.values()) > 3


def test_near_dedup_chain_of_copies_that_only_neighbours_link(spark):
    """Components that the comparison with a bucket's smallest member alone would miss."""
    words = [f"w{i}" for i in range(400)]
    rows = [(100 - i, " ".join(words[8 * i:8 * i + 200])) for i in range(20)] + [(500, " ".join(words[:200]))]
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(frame(spark, rows), words=3, percent=85).collect()}
    assert got == {k: c for k, (_, c) in brute.components(rows, 3, 85).items()}
    assert set(got.values()) == {81}


def test_near_dedup_nulls_and_repeated_rows(spark):
    text = "a b c d e f g"
    rows = [(None, text), (4, text), (4, text), (4, "other words here now and then"), (9, text.upper()), (10, None), (11, None)]
    got = near_dedup.near_duplicates(frame(spark, rows), words=3, percent=85)
    got = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got.collect()), key=str)
    assert got == sorted([(None, 5, 4, False), (4, 5, 4, True), (4, 5, 4, True), (4, 4, 4, True), (9, 5, 4, False),
                          (10, 0, 10, True), (11, 0, 11, True)], key=str)


def test_sketch_agreement_estimates_similarity():
    rnd = np.random.default_rng(2)
    for n in (1, 3, 40, 190, 3000):
        a = rnd.integers(1, 1 << 62, n).astype(np.uint64)
        b = a.copy()
        b[: n // 5] = rnd.integers(1, 1 << 62, n // 5).astype(np.uint64)
        x, y = near_dedup.sketch(np.unique(a)), near_dedup.sketch(np.unique(b))
        assert (x != near_dedup._EMPTY).all()
        true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        assert abs((x == y).mean() - true) < 0.15
        assert (near_dedup.sketch(np.unique(a)) == x).all()


def test_parse_follows_the_reference_and_marks_every_repeated_window():
    rnd = np.random.default_rng(6)
    for _ in range(40):
        strings = [rnd.integers(0, 4, rnd.integers(1, 12)).astype(np.uint64) for _ in range(rnd.integers(1, 15))]
        times = rnd.choice([1, 1, 3], len(strings))
        n, hashes = np.array([len(x) for x in strings]), np.concatenate(strings)
        seeds = rnd.integers(0, 2, len(strings)).astype(np.uint64)
        follows, begins = substring_dedup.parse_block(seeds, n, hashes, times)
        run = np.repeat(np.arange(len(n)), n)
        key = list(zip(hashes.tolist(), seeds[run].tolist()))
        for i, place in enumerate(follows.tolist()):
            known = sum(int(times[run[j]]) for j, k in enumerate(key) if k == key[i])
            assert (place >= 0) == (known > 1)
            if place >= 0:
                assert key[place] == key[i] and (place != i or times[run[i]] > 1)
                goes_on = i and run[i - 1] == run[i] and follows[i - 1] >= 0 and follows[i - 1] + 1 == place and run[place - 1] == run[place]
                assert begins[i] != bool(goes_on)
                if begins[i] and i and run[i - 1] == run[i] and follows[i - 1] >= 0:  # greedy: the factor before could not go on
                    after = int(follows[i - 1]) + 1
                    assert after >= len(run) or run[after] != run[after - 1] or key[after] != key[i]


@pytest.mark.parametrize("module", ["substring_dedup", "suffix_dedup"])
def test_groups_follow_chunks_and_not_the_occurrences_of_a_passage(spark, module, monkeypatch, tmp_path):
    """One passage in a third of all documents: what a bucket gets about it is a string a chunk."""
    passage, rnd = " ".join(f"p{i}" for i in range(60)), random.Random(2)
    rows = [(i, " ".join(f"{rnd.randrange(10 ** 9)}" for _ in range(6)) + (" " + passage if i % 3 == 0 else "")) for i in range(3000)]
    module = {"substring_dedup": substring_dedup, "suffix_dedup": suffix_dedup}[module]
    seen, own = str(tmp_path), module._parser if module is substring_dedup else module._sorter(50)

    def spy(table):
        group = table.column("group")[0].as_py()
        size = [sum(len(b.as_py() or b"") for b in table.column(c)) for c in ("seeds", "docs")]
        with open(f"{seen}/{group}", "w") as f:
            f.write(f"{table.num_rows} {size[0]} {size[1]}")
        return own(table)

    monkeypatch.setattr(module, "_parser" if module is substring_dedup else "_sorter", spy if module is substring_dedup else lambda _: spy)
    done = (substring_dedup.drop_repeats if module is substring_dedup else suffix_dedup.drop_later_copies)(
        spark.createDataFrame(rows, "doc_id long, text string"), chunk_bytes=20_000)
    removed = {r.doc_id: r.n_removed for r in done.collect()}
    first = 0 if module is suffix_dedup else None
    assert all((removed[i] > 0) == (i % 3 == 0 and i != first) for i, _ in rows)
    chunks = -(-sum(len(t) for _, t in rows) // 20_000)
    told = {int(f.name): tuple(map(int, f.read_text().split())) for f in tmp_path.iterdir()}
    assert max(rows for g, (rows, *_) in told.items() if g >= 0) <= chunks
    assert max(seeds for g, (_, seeds, _) in told.items() if g >= 0) <= chunks * 6 * 400  # strings of the passage, not documents
    assert all(docs == 0 for g, (_, _, docs) in told.items() if g >= 0)


def test_members_of_one_root_hardly_meet(spark):
    rows = [(1, 0, i) for i in range(500)] + [(1, 1, 1000)] + [(2, 0, i) for i in range(500)]   # shingle 2 has one root
    rows += [(3, r, 100 * r + i) for r in range(4) for i in range(10 * (r + 1))]
    first = spark.createDataFrame(rows, "shingle long, root long, node long")
    second = first.select("shingle", F.col("root").alias("other_root"), F.col("node").alias("other"))
    got = near_dedup.cross_root_pairs(first, second).select("shingle", "root", "other_root", "node", "other")
    across = {(s, a, b, x, y) for s, a, x in rows for t, b, y in rows if s == t and a != b}
    found = {tuple(r) for r in got.collect()}
    assert across <= found and got.count() == len(found) <= 2 * len(across)
    assert got.where("shingle = 1").count() == 1000 + 1 and got.where("shingle = 2").count() == 0


def test_near_copies_beside_an_outlier_keep_all_links(spark):
    rnd = random.Random(12)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(150):
        words = list(base)
        words[rnd.randrange(120)] = f"x{i}"
        rows.append((i, " ".join(words)))
    for i, changed in ((500, 4), (501, 7), (502, 60)):
        words = list(base)
        for at in range(changed):
            words[at * 120 // changed] = f"y{i}{at}"
        rows.append((i, " ".join(words)))
    rows.append((503, rows[-1][1] + " more"))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(
        spark.createDataFrame(rows, "doc_id long, text string"), words=3, percent=85).collect()}
    assert got == {k: (n, c) for k, (n, c) in brute.components(rows, 3, 85).items()}


def test_components_of_paths_and_stars(spark):
    rnd = random.Random(8)
    links = [(i, i + 1) for i in range(0, 40)] + [(100, 100 + i) for i in range(1, 20)] + [(300, 300), (7, 6)]
    links = [(a, b) if rnd.random() < 0.5 else (b, a) for a, b in links]
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, **{100 + i: 100 for i in range(1, 20)}}


@pytest.mark.parametrize("run", [
    lambda d: line_dedup.dedup_lines(d), lambda d: near_dedup.near_duplicates(d),
    lambda d: substring_dedup.drop_repeats(d), lambda d: suffix_dedup.drop_later_copies(d)])
def test_empty_tables(spark, run):
    assert run(frame(spark, [])).collect() == []


words = st.lists(st.sampled_from([0, 1, 2, 3]), max_size=60)


@settings(max_examples=60, deadline=None)
@given(st.lists(words, min_size=1, max_size=5), st.integers(1, 4), st.integers(0, 6))
def test_equal_windows_have_equal_seeds_at_equal_offsets(docs, k, more):
    units = np.array([w + 11 for d in docs for w in d], np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    bounds = np.cumsum([0, *map(len, docs)])
    length, seen, starts = k + more, {}, []
    for s, a in rolling.window_anchors(units, bounds, k, length):
        starts += s.tolist()
        for i, j in zip(s, a):
            assert i <= j <= i + length - k
            assert seen.setdefault(units[i:i + length].tobytes(), j - i) == j - i
    assert starts == [b + i for b, d in zip(bounds, docs) for i in range(len(d) - length + 1)]


@settings(max_examples=40, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(st.sampled_from("aé \t\n\x1c 　")))))
def test_word_spans_are_the_rules_words(texts):
    import pyarrow as pa

    data, bounds = rolling.utf8_bytes(pa.array(texts, pa.string()))
    starts, ends, own = rolling.word_spans(data, bounds)
    got = [[data[s:e].tobytes().decode() for s, e in zip(starts[a:b], ends[a:b])] for a, b in zip(own[:-1], own[1:])]
    assert got == [brute.BLANK.findall(t or "") for t in texts]
