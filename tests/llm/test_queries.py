import pytest

from rollframe.llm import queries
from tests import parity

pytestmark = pytest.mark.skipif(not parity.os.path.isdir(parity.DATA), reason="no test data")


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_same_rows_as_sql(spark, name):
    parity.same(spark, parity.database(), queries.QUERIES[name], queries.SQL[name])


COLUMNS = {
    "p1_found": {"case_id": "string", "rank_no": "int", "rollout_id": "bigint"},
    "p2_found": {"run_id": "string", "scenario_type": "string"},
    "p3_found": {"rollout_id_a": "bigint", "rollout_id_b": "bigint"},
    "p5_found": {"rollout_id": "bigint", "defect": "string"},
    "p6_found": {"doc_id": "bigint", "item_id": "bigint"},
    "p7_found": {"source": "string"},
    "p8_found": {"doc_id": "bigint"},
}


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns(spark, name):
    assert dict(queries.QUERIES[name](spark, parity.DATA).dtypes) == COLUMNS[name]


def test_percentiles_of_the_whole_table_and_of_each_run(spark):
    got = {(r.run_id, r.scenario_type): (r.n, r.p10, r.p50, r.p99) for r in queries.p2_percentiles(spark, parity.DATA).collect()}
    exact = """WITH r AS (SELECT DISTINCT rollout_id, run_id, lower(trim(scenario_type)) AS s, environment_reward AS v FROM rollouts
                          WHERE trim(scenario_type) <> '' AND environment_reward IS NOT NULL AND NOT isnan(environment_reward))
               SELECT run_id, s, count(*), quantile_disc(v, 0.1), quantile_disc(v, 0.5), quantile_disc(v, 0.99) FROM r {} GROUP BY ALL"""
    rows = parity.database().execute(exact.format("WHERE run_id IS NOT NULL")).fetchall()
    rows += parity.database().execute(exact.format("").replace("SELECT run_id, s", "SELECT NULL, s")).fetchall()
    assert len(rows) > 20 and got == {(run, s): tuple(v) for run, s, *v in rows}  # so few values are held exactly
