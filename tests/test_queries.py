import pytest

from rollframe.plans import registry
from tests import parity

pytestmark = pytest.mark.skipif(not parity.os.path.isdir(parity.DATA), reason="no test data")


@pytest.fixture(scope="module")
def database():
    return parity.database()


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_same_rows_as_sql(spark, database, name):
    parity.same(spark, database, registry.QUERIES[name], registry.SQL[name])


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.SQL)))
def test_runs(spark, name):
    assert registry.QUERIES[name](spark, parity.DATA).schema.names


def test_stream_equals_batch(spark):
    keep = ["user_id", "attempts", "trailing", "final"]
    batch = registry.QUERIES["episode_fold"](spark, parity.DATA).select(keep)
    assert sorted(map(tuple, registry.QUERIES["stream_episodes"](spark, parity.DATA).select(keep).collect())) == sorted(map(tuple, batch.collect()))
