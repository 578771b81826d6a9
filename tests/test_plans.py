"""The plans Spark makes are the ones meant for large data."""

import pytest

from splitlab.functions.outcomes import not_other
from splitlab.operators import design, plate, rates
from splitlab.plans import catalog, testbed

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def optimized(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.fixture(scope="module")
def events(spark):
    return catalog.batting(spark, SF)


def test_marks_are_limited_below_the_shuffle(events):
    text = plan(events.select("timesthrough"))
    assert "row_number(), 19, Partial" in text


def test_unread_parts_are_pruned(spark, events):
    table = rates.rate_table(events, "batter", testbed.constants(spark))
    text = plan(table)
    assert "WindowGroupLimit" not in text and "gamesite" not in text
    assert text.count("FileScan") == 2
    for unread in ("l_tax_", "l_extendedprice", "l_comment", "p_name", "p_size"):
        assert unread not in text.split("ReadSchema")[1]


def test_class_filter_is_above_the_running_count(events):
    text = optimized(events.filter(not_other()).select("timesthrough", "event"))
    marks = text[text.index("Aggregate") :]
    assert "OTHER" not in marks


def test_splits_take_one_aggregate(spark, events):
    text = plan(rates.split_rates(events, ["batter", "pitcher", "pitcherhand"]))
    assert text.count("Expand") == 1 and text.count("partial_count(1)") == 1


def test_gram_counts_before_the_shuffle(events):
    text = plan(design.gram(events, ["batter", "pitcher"]))
    assert text.count("Expand") == 1 and "partial_count(1)" in text


def test_no_query_pairs_all_rows(spark):
    """No cartesian product anywhere; solves are left out, they run many plans."""
    slow = {k for k in catalog.queries() if "check" in k or k in SLOW}
    for key, query in catalog.queries().items():
        if key not in slow:
            text = plan(query(spark, SF))
            assert "CartesianProduct" not in text, key
            assert "NestedLoop" not in text, key


SLOW = (
    "ols_fit", "gram_rank", "estimates_ridge", "ridge_single_split", "logistic_means", "logistic_shares",
    "lasso_single_split",
)


def test_top_list_is_not_a_full_sort(spark):
    assert "TakeOrderedAndProject" in plan(catalog.top_batters(spark, SF))


def test_plate_whitelist_names():
    assert set(plate.MODEL_SPLITS) < set(plate.SPLITS)
