"""Every query with SQL gives the SQL's rows."""

import pytest
from oracle import compare

from folioflow.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, name):
    assert compare(spark, "/root/testdata/sf0.001", QUERIES[name], ORACLES[name]) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, name):
    assert QUERIES[name](spark, "/root/testdata/sf0.001").count() > 0


def test_validate_where_the_ratio_is_a_tie(spark, tmp_path):
    pairs = [(m, n) for n in (32, 40, 200) for m in range(1, 800, 2)]
    rows = [(i, t, r, c * k) for i, (m, n) in enumerate(pairs) for t, (r, c, k) in enumerate([("user", "y", n), ("assistant", "x", m)])]
    spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    assert compare(spark, str(tmp_path), QUERIES["v1_v6_validate"], ORACLES["v1_v6_validate"]) is None
