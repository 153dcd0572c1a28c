"""c01_consolidated on one large cluster: its rows meet their leader, not each other."""

from tessaline.plans import catalog
from tests.test_bm25 import shuffled


def test_alike_pairs_are_not_shuffled(spark, tmp_path):
    """2,000 old records of one wording, two million pairs; three of another, too few above a thousand records; one that is too young."""
    content = "case when id < 2000 then concat('every night seven freight drones carry water over distant hills word', id) when id < 2003 then 'quite other words about nothing' else 'every night seven freight drones' end"
    docs = spark.range(2_004).selectExpr("concat('r', lpad(id, 5, '0')) as id", f"{content} as content", "if(id = 2003, timestamp'2025-05-31 00:00:00', timestamp'2025-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, id)) as created_at")
    docs.write.parquet(str(tmp_path / "smoke_corpus.parquet"))
    before = shuffled(spark)
    assert [tuple(x) for x in catalog.registry().queries["c01_consolidated"](spark, str(tmp_path)).collect()] == [("r00000", 2_000)]
    assert shuffled(spark) - before < 100_000
