"""The pipeline's stages, each against brute force on its own input, and the registered queries."""

import brute
import corpus_pipeline
import duckdb
import pytest
from funnelry.llm import queries
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """The rows after each stage, written and read again."""
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    out.append(docs.collect())
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path_factory.mktemp("stage") / str(i))
        stage(spark, docs, SF).write.parquet(path)
        docs = spark.read.parquet(path)
        if i < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == COLUMNS
        out.append(docs.collect())
    return out


def texts(rows):
    return {r.doc_id: r.text for r in rows}


def test_names_and_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "quality classifier", "line dedup", "MinHash near-dedup", "benchmark decontamination", "packing"]


def test_quality_stage_rejects_bad_and_keeps_good_rows_whole(spark, stages):
    labels = dict(map(tuple, spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "quality").collect()))
    before, after = texts(stages[0]), texts(stages[1])
    assert all(before[k] == t for k, t in after.items())
    good = [k for k in before if labels.get(k) == 1]
    bad = [k for k in before if labels.get(k) == 0]
    assert sum(k in after for k in good) >= 0.95 * len(good)
    assert sum(k in after for k in bad) <= 0.2 * len(bad)


def test_line_stage(stages):
    rows = sorted(texts(stages[1]).items())
    want = {k: t for (k, _), (t, _, removed, _) in zip(rows, brute.line_dedup(rows, 2)) if not removed or t.strip(" \t\n\x0b\x0c\r")}
    assert texts(stages[2]) == want
    assert all(r.n_chars == len(r.text) for r in stages[2])


def test_near_stage_keeps_one_of_each_group(stages):
    rows = list(texts(stages[2]).items())
    want = {c for _, c in brute.components(rows, 5, 80).values()}
    assert texts(stages[3]) == {k: t for k, t in rows if k in want}


def test_benchmark_stage(spark, stages):
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    rows = list(texts(stages[3]).items())
    assert texts(stages[4]) == {k: t for (k, t), (_, hits, _) in zip(rows, brute.leaks(rows, items)) if not hits}


def test_packing_stage_has_every_document(stages):
    pieces = {}
    for p in stages[5]:
        pieces.setdefault(p.doc_id, []).append((p.start, p.length, p.doc_tokens))
    assert pieces.keys() == texts(stages[4]).keys()
    assert all(sum(n for _, n, _ in own) == own[0][2] for own in pieces.values())


def test_run_gives_the_stages_rows(spark, stages):
    total = lambda rows: {(r.doc_id, r.doc_tokens) for r in rows}
    assert total(corpus_pipeline.run(spark, SF).collect()) == total(stages[5])


def test_stages_pass_empty_tables_and_odd_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame([(None, None, None, None, None), (5, "", "en", "s", 0), (5, "", "en", "s", 0)], docs.schema)
    for rows in (docs.limit(0), odd):
        for _, stage in corpus_pipeline.STAGES[1:]:
            rows = stage(spark, rows, SF)
        rows.collect()
    assert corpus_pipeline.quality_stage(spark, docs.limit(0), SF).collect() == []
    assert corpus_pipeline.quality_stage(spark, odd, SF).count() <= 3


def test_columns_of_any_name_pass_through_every_stage(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = {"quality_score": 1, "score": 2, "n_lines": 3, "n_removed": 4, "n_runs": 5, "__version": 6, "n_words": 7, "n_hit": 8,
           "items": 9, "a.b": 10, "row": 11, "version": 12, "kept": 13, "hit_spans": 14, "c`d": 15, "id": 16, "others": 17}
    more = docs.select(*docs.columns, *[F.lit(v).alias(c) for c, v in odd.items()])
    for (name, stage), (_, plain) in zip(corpus_pipeline.STAGES[:-1], corpus_pipeline.STAGES):
        got, want = stage(spark, more, SF), plain(spark, docs, SF)
        assert got.columns == more.columns, name
        assert [tuple(r) for r in got.select(*["`" + c.replace("`", "``") + "`" for c in odd]).distinct().collect()] == [tuple(odd.values())]
        assert sorted(map(tuple, got.select(*COLUMNS).collect()), key=str) == sorted(map(tuple, want.collect()), key=str)


def test_rows_of_one_id_and_text_leave_the_same_one(spark):
    docs = spark.createDataFrame([(1, "a b c d e f", x, "s", 1) for x in ("en", "de", "fr", "es")], "doc_id long, text string, lang string, source string, n_chars long")
    first = corpus_pipeline.near_stage(spark, docs, SF).collect()
    again = corpus_pipeline.near_stage(spark, docs.orderBy("lang"), SF).collect()
    assert len(first) == 1 and first == again


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_queries_match_their_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "benchmark", "labels", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = queries.QUERIES[name](spark, SF)
    want = con.sql(queries.ORACLE_SQL[name])
    assert got.columns == want.columns
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want.fetchall(), key=str)


def test_every_operator_has_a_query():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))
