"""Searches and judgements go to where the texts lie: neither shuffles nor the shared folder get the texts of the table."""

from pathlib import Path

import pytest

from tessaline.operators import overlap, retrieval
from tessaline.plans import catalog
from tessaline.plans.analytics import _BM25
from tessaline.runtime import shared_folder
from tests.test_bm25 import compare, odd  # noqa: F401


@pytest.fixture(scope="module")
def long_texts(spark, tmp_path_factory):
    """2,000 records of 2 KB that don't compress, 4 MB in all; three questions that repeat one of them, and one of a few words."""
    base = tmp_path_factory.mktemp("long")
    text = "concat('Every record about thing', id % 40, if(id % 3 = 0, '? ', ' '), concat_ws(' ', transform(sequence(1, 60), i -> md5(concat(id, ':', i)))))"
    docs = spark.range(2_000).selectExpr(
        "concat('d', id) as id", f"{text} as content", "if(id % 4 = 0, 'Conversation', 'Task') as memory_type", "array('Rust', concat('t', id % 7)) as tags",
        "timestamp'2025-05-20 00:00:00' + make_interval(0, 0, 0, 0, 0, id % 900) as created_at",
    )
    docs.write.parquet(str(base / "smoke_corpus.parquet"))
    spark.range(4).selectExpr("50 * id as request_id", f"if(id = 3, 'Every record', {text}) as query_text").write.parquet(str(base / "recall_requests.parquet"))
    (duck := compare.duckdb.connect()).sql("SET TimeZone='UTC'")
    for t in ("smoke_corpus", "recall_requests"):
        duck.sql(f"CREATE VIEW {t} AS FROM '{base}/{t}.parquet/*.parquet'")
    return str(base), duck


def moved(spark):
    """Bytes shuffled and bytes in the shared folder so far."""
    jvm = spark.sparkContext._jvm
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    none, quantiles = jvm.java.util.ArrayList(), spark.sparkContext._gateway.new_array(jvm.double, 0)
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(none, False, False, quantiles, none)
    folder = Path(shared_folder(spark).removeprefix("file:"))
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size())) + sum(p.stat().st_size for p in folder.rglob("*") if p.is_file())


NAMES = ["r08_layers", "m09_ablation", "m01_hits_at", "r06_bm25_fields", "r28_tracked", "r13_linguistic_boost", "w11_rank_of_gold", "r11_companions", "r12_frozen_anchors", "j12_boosted_inside", "r02_lexical_filtered", "j01_fused_lists", "r07_dynamic_fusion", "k04_paged_recall"]


@pytest.mark.parametrize("name", NAMES)
def test_texts_stay_where_they_lie(name, long_texts, spark):
    (base, duck), registry, before = long_texts, catalog.registry(), moved(spark)
    df = registry.queries[name](spark, base)
    got = compare.rows(df.columns, df.collect())
    went, want = moved(spark) - before, duck.sql(registry.sql[name])
    assert got == compare.rows(want.columns, want.fetchall()) and got
    assert went < 2_000_000


@pytest.mark.parametrize("limits", [{}, {"SENT_ENTRIES": 0}, {"SENT_KEYS": 0}])
def test_keys_apart_or_in_blocks_equal_sql(odd, spark, monkeypatch, limits):  # noqa: F811
    for name, most in limits.items():
        monkeypatch.setattr(retrieval, name, most)
    base, duck = odd
    docs, asked = spark.read.parquet(f"{base}/smoke_corpus.parquet"), spark.read.parquet(f"{base}/recall_requests.parquet").withColumnRenamed("request_id", "query_id")
    want = duck.sql(_BM25 + " SELECT query_id, id, score, rank FROM lexical WHERE rank <= 8")
    want = compare.rows(want.columns, want.fetchall())
    for arrow in ("true", "false"):
        monkeypatch.setattr(retrieval, "BLOCK_DOCUMENTS", 32_768 if arrow == "true" else 20)
        spark.conf.set("spark.sql.execution.arrow.pyspark.enabled", arrow)
        try:
            got = retrieval.bm25(docs, asked, "id", "content", 8)
            assert compare.rows(got.columns, got.collect()) == want
        finally:
            spark.conf.set("spark.sql.execution.arrow.pyspark.enabled", "true")


def test_no_documents_and_no_questions(spark):
    docs, asked = spark.createDataFrame([], "doc_id string, text string"), spark.createDataFrame([(1, "a b")], "query_id long, query_text string")
    assert retrieval.bm25(docs, asked).count() == 0
    assert retrieval.bm25(spark.createDataFrame([("d", "a")], "doc_id string, text string"), asked.limit(0)).count() == 0


def test_judged_in_blocks_equals_where_they_lie(spark, monkeypatch):
    left = spark.range(30).selectExpr("id as l", "array(concat('w', id % 5), concat('x', id % 3), 'all') as a")
    right = spark.range(90).selectExpr("id as r", "array(concat('w', id % 5), concat('x', id % 4), 'some') as b")
    both = lambda: {(x.l, x.n) for x in overlap.dice_counts(left, right, "l", "r", 0.6).collect()}, lambda: {(x.l, x.r) for x in overlap.dice_pairs(left, right, "l", "r", 0.6).collect()}
    want = [f() for f in both]
    monkeypatch.setattr(overlap, "SENT_WORDS", 0)
    assert [f() for f in both] == want and all(want)
