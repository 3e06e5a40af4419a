import pytest
from session import local_session


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = local_session()
    session.conf.set("spark.sql.shuffle.partitions", "4")
    yield session


def rows(df, *order):
    """Collected rows as tuples, ordered."""
    return [tuple(r) for r in df.orderBy(*order).collect()] if order else sorted(tuple(r) for r in df.collect())
