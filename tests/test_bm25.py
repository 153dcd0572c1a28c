"""BM25 in blocks: the rows of the SQL twin for repeated and null keys, and no row for each document that a query meets."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1] / "tools"))

import compare  # noqa: E402

from tessaline.operators import retrieval  # noqa: E402
from tessaline.plans import catalog  # noqa: E402
from tessaline.plans.analytics import _BM25  # noqa: E402


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """Records with one id at equal and at other lengths, without id, text or words; requests that came twice, without text, without known words."""
    base = tmp_path_factory.mktemp("odd")
    docs = [(f"d{i:03}", f"the {'alpha' if i % 3 else 'beta'} run {'gamma ' * (i % 4)}{i % 7}") for i in range(150)]
    docs += [("d007", "the alpha run gamma gamma 9"), ("d007", "alpha alpha alpha"), ("d008", "beta beta beta beta"), (None, "beta run"), (None, "gamma run the end"), ("x1", None), ("x2", " .. "), ("x3", "")]
    asked = [(50, "The alpha, alpha"), (100, "beta gamma 3"), (100, "gamma 5"), (150, "alpha the"), (200, None), (250, "unheard"), (300, "..."), (400, "the run 5"), (450, "beta unheard")]
    spark.createDataFrame(docs, "id string, content string").write.parquet(str(base / "smoke_corpus.parquet"))
    spark.createDataFrame(asked, "request_id bigint, query_text string").write.parquet(str(base / "recall_requests.parquet"))
    (duck := compare.duckdb.connect()).sql(f"CREATE VIEW smoke_corpus AS FROM '{base}/smoke_corpus.parquet/*.parquet'")
    duck.sql(f"CREATE VIEW recall_requests AS FROM '{base}/recall_requests.parquet/*.parquet'")
    return str(base), duck


@pytest.mark.parametrize("sizes", [(32_768, 8_192, 4_194_304), (20, 2, 50)])
def test_equals_sql_on_odd_rows(odd, spark, monkeypatch, sizes):
    for name, size in zip(("BLOCK_DOCUMENTS", "BLOCK_SETS", "HELD_SCORES"), sizes, strict=True):
        monkeypatch.setattr(retrieval, name, size)
    base, duck = odd
    docs, asked = spark.read.parquet(f"{base}/smoke_corpus.parquet"), spark.read.parquet(f"{base}/recall_requests.parquet").withColumnRenamed("request_id", "query_id")
    got = retrieval.bm25(docs, asked, "id", "content", 8)
    want = duck.sql(_BM25 + " SELECT query_id, id, score, rank FROM lexical WHERE rank <= 8")
    assert compare.rows(got.columns, got.collect()) == compare.rows(want.columns, want.fetchall())


def shuffled(spark):
    jvm = spark.sparkContext._jvm
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    none, quantiles = jvm.java.util.ArrayList(), spark.sparkContext._gateway.new_array(jvm.double, 0)
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(none, False, False, quantiles, none)
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


def test_pairs_of_queries_and_documents_are_not_shuffled(spark):
    """Each of 300 queries meets each of 3,000 documents in a word that all have."""
    docs = spark.range(3_000).selectExpr("concat('d', id) as id", "concat('all word', id % 40) as content")
    asked = spark.range(300).selectExpr("id as query_id", "concat('all word', id % 40, ' x', id) as query_text")
    before = shuffled(spark)
    assert retrieval.bm25(docs, asked, "id", "content", 5).count() == 1_500
    assert shuffled(spark) - before < 60_000


FUSED = ["j01_fused_lists", "r07_dynamic_fusion", "r08_layers", "m09_ablation"]


@pytest.mark.parametrize("name", FUSED)
def test_the_lexical_leg_is_searched_once(spark, base, monkeypatch, name):
    calls, search = [], retrieval.bm25
    monkeypatch.setattr(retrieval, "bm25", lambda *a, **k: calls.append(1) or search(*a, **k))
    catalog.registry().queries[name](spark, base).count()
    assert len(calls) == 1


@pytest.fixture(scope="module")
def crowded(spark, tmp_path_factory):
    """Each of 200 questions meets each of 2,000 records, and every record is relevant to it: 400,000 pairs."""
    base = tmp_path_factory.mktemp("crowded")
    docs = spark.range(2_000).selectExpr(
        "concat('d', id) as id", "concat('every record about thing', id % 40, if(id % 3 = 0, '?', '')) as content", "if(id % 4 = 0, 'Conversation', 'Task') as memory_type",
        "array('Rust', concat('t', id % 7)) as tags", "timestamp'2025-05-20 00:00:00' + make_interval(0, 0, 0, 0, 0, id % 900) as created_at",
    )
    docs.write.parquet(str(base / "smoke_corpus.parquet"))
    spark.range(200).selectExpr("50 * id as request_id", "concat('Every record about thing', id % 40, ' x', id) as query_text").write.parquet(str(base / "recall_requests.parquet"))
    (duck := compare.duckdb.connect()).sql("SET TimeZone='UTC'")
    for t in ("smoke_corpus", "recall_requests"):
        duck.sql(f"CREATE VIEW {t} AS FROM '{base}/{t}.parquet/*.parquet'")
    return str(base), duck


def leg_of(name, crowded, spark):
    """Its rows are those of SQL; how many rows it shuffles."""
    (base, duck), registry, before = crowded, catalog.registry(), shuffled(spark)
    df = registry.queries[name](spark, base)
    got = compare.rows(df.columns, df.collect())
    moved, want = shuffled(spark) - before, duck.sql(registry.sql[name])
    assert got == compare.rows(want.columns, want.fetchall()) and got
    return moved


LEG = ["r08_layers", "r12_frozen_anchors", "j12_boosted_inside", "r02_lexical_filtered", "r07_dynamic_fusion", "r11_companions", "j01_fused_lists", "r06_bm25_fields", "r13_linguistic_boost", "k04_paged_recall", "r28_tracked"]


@pytest.mark.parametrize("name", LEG)
def test_a_query_on_the_lexical_leg_shuffles_no_pairs(name, crowded, spark):
    assert leg_of(name, crowded, spark) < 100_000
