import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(__file__), ".."))

from tablelore.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, shuffle_partitions=4)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def shop(spark):
    """A small shop: two keys into regions, two children of customers."""
    from datasets import shop_tables
    from tablelore.plans.dataset import prepare

    return prepare(spark, shop_tables(spark))


@pytest.fixture(scope="session")
def billing(spark):
    """Opaque names, natural keys and a staging copy whose ids overlap."""
    from datasets import billing_tables
    from tablelore.plans.dataset import prepare

    return prepare(spark, billing_tables(spark))
