"""What several steps of a query read is made once and read back, not made again by each of them."""

import pytest

from quire.plans import QUERIES

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize(("name", "step"), [("mail_bootstrap", "parse_mail"), ("sticky_passage", "posexplode")])
def test_made_once(spark, name, step):
    plan = QUERIES[name](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString().lower()
    assert "parquet" in plan and step not in plan
