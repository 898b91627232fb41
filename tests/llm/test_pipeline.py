import pytest

pipeline = pytest.importorskip("corpus_pipeline")

from .fixtures import SF, clashing, docs  # noqa: E402


def test_stages(spark):
    from lakewright.session import table

    before = table(spark, SF, "documents")
    ids = {r["doc_id"] for r in before.collect()}
    for name, stage in pipeline.STAGES[:-1]:
        after = stage(spark, before, SF).checkpoint()
        assert after.columns == before.columns, name
        kept = {r["doc_id"] for r in after.collect()}
        assert kept and kept <= ids, name
        before, ids = after, kept
    packed = pipeline.STAGES[-1][1](spark, before, SF)
    assert {r["doc_id"] for r in packed.collect()} == ids


def test_awkward_rows(spark):
    df = clashing(docs(spark))
    for name, stage in pipeline.STAGES:
        after = stage(spark, df, SF).checkpoint()
        assert after.count(), name
        if name != pipeline.STAGES[-1][0]:
            assert after.columns == df.columns, name


def test_registered():
    import __spark_entry__ as entry

    names = entry.queries()
    assert "pipeline" in names and all(sum(n.startswith(f"op{k}_") for n in names) == 1 for k in range(1, 11))
