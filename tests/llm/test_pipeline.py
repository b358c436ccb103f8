import os

import pytest

import corpus_pipeline as P
from marlpit.llm import common, decontam, queries, simhash, toxicity

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")


def test_stages(spark):
    docs = common.table(spark, DIR, "documents")
    columns = docs.columns
    assert [n for n, _ in P.STAGES] == ["toxicity", "simhash", "decontamination", "mixing", "sharding"]
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}
    before = docs
    model = toxicity.train(toxicity.labelled_rows(docs, common.table(spark, DIR, "labels")))
    for name, stage in P.STAGES:
        after = common.materialise(stage(spark, before, DIR), f"test-{name}")
        had, has = ids(before), ids(after)
        assert has <= had
        if name == "toxicity":
            assert had - has == {r.doc_id for r in toxicity.score(before, model).collect() if r.score >= 0.7}
        if name == "simhash":
            assert has == {r.doc_id for r in simhash.near_duplicates(before).collect() if r.doc_id == r.component_id}
        if name == "decontamination":
            assert had - has == ids(decontam.contaminated(before, common.table(spark, DIR, "benchmark")))
        if name != "sharding":
            assert after.columns == columns
        else:
            assert after.columns == [*columns, "shard", "slot"] and after.count() == before.count()
        before = after
    assert before.count() == P.run(spark, DIR).count()


def test_queries_cover_the_operators():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 11))


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_runs(spark, name):
    assert queries.QUERIES[name](spark, DIR).count() >= 0
