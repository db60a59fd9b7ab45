"""Every core query against its SQL on the smallest tables."""

import os

import pytest
from oracle import connect, rows_of_spark, rows_of_sql

from loomstone.plans.queries import ORACLES, QUERIES

SF = os.environ.get("LOOMSTONE_TESTDATA", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    names, rows = rows_of_sql(duck, ORACLES[name])
    assert sorted(df.columns) == names
    assert rows_of_spark(df) == rows


@pytest.mark.parametrize("name", ["lemmatize", "pipeline_roundtrip", "curate_catalogue", "build_vocabulary", "demo_table", "linear_coefficients"])
def test_query_runs(spark, name):
    larger = SF.replace("sf0.001", "sf0.01")  # the pipelines prune all of the smallest tables
    assert QUERIES[name](spark, larger if os.path.isdir(larger) else SF).count() > 0


@pytest.mark.parametrize("name", ["svm_ovr", "logreg", "sgd_classifier"])
def test_classifier_reaches_the_held_out_documents(spark, name):
    got = QUERIES[name](spark, SF).filter("label IS NOT NULL").collect()
    assert len(got) > 10 and sum(r.label == r.predicted for r in got) / len(got) > 0.7  # the smallest tables hold some 70 texts to learn from


#: Scans and hash exchanges that a plan may have; without AQE's reuse, broadcasts aside.
PLANS = {"detect_language": (1, 0), "mwe_join": (1, 0), "explain_keywords": (4, 7), "centroid_predict": (3, 6), "stratified_split": (4, 6)}


@pytest.mark.parametrize("name", sorted(PLANS))
def test_plans_stay_small(spark, name):
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    scans, exchanges = PLANS[name]
    assert plan.count("FileScan parquet") <= scans, plan.count("FileScan parquet")
    assert plan.count("Exchange hashpartitioning") <= exchanges


def test_entry(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.queries()["curated_source_counts"](spark, SF).columns == ["source", "n"]


def test_a_language_is_told_once_a_text(spark):
    plan = QUERIES["keep_english"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace") <= 10  # a filter on the language would repeat them in each other's place
