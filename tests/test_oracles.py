"""Every query with an SQL twin equals it on the smallest tables."""

import oracle
import pytest

from emberline import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return oracle.duck(SF)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_twin(spark, con, name):
    assert oracle.differences(spark, con, catalog.queries()[name], catalog.oracle_sql()[name], SF) is None


def test_without_twin():
    """What SQL cannot say is held against a brute-force version elsewhere."""
    assert set(catalog.queries()) - set(catalog.oracle_sql()) == {"bootstrap_interval"}


#: Twins that give a row of totals, and those whose rule picks nothing from the smallest tables.
FEW = {"dataset_summary", "macro_f1", "ece", "auc", "alarm_threshold", "geojson_report", "quality_counts", "split_disjointness", "sync_consistency", "replay_verdict", "run_summary", "cover_prefetch", "bbox_filter"}


def test_twins_have_rows():
    """A comparison of nothing with nothing proves nothing."""
    big = oracle.duck("/root/testdata/sf0.01")
    for name, sql in catalog.oracle_sql().items():
        assert big.execute(f"SELECT count(*) FROM ({sql}) q").fetchone()[0] >= (1 if name in FEW else 2), name


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
