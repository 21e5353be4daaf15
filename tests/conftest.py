import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from tests.check_oracle import session

    return session()


@pytest.fixture
def table(spark):
    """Build a table of the input contracts from dicts; columns left out are null."""
    from runlore.schemas import TABLES

    def build(name, rows):
        schema = spark.createDataFrame([], TABLES[name]).schema
        data = [tuple(r.get(f.name) for f in schema.fields) for r in rows]
        return spark.createDataFrame(data, schema)

    return build
