"""Queries that name contacts or their match keys several times read them from a table, where each is worked out once."""

import pytest

from millrace.queries import entity as q


@pytest.mark.parametrize("name", ["d_blocks", "d_candidates", "d_scores", "d_golden"])
def test_cleaning_is_not_in_the_plans_of_what_comes_after_it(spark, sf_dir, name):
    found = q.QUERIES[name](spark, sf_dir)
    assert "regexp_replace" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert found.head() is not None
