"""Every registered query against its SQL; the ones without SQL must return rows."""

import os

import pytest

import oracle
from seqweave.plans import catalog

FOLDER = os.environ.get("CHECK_DIR", "/root/testdata/sf0.001")
QUERIES, SQL = catalog.queries(), catalog.oracles()


@pytest.fixture(scope="module")
def db():
    if not os.path.exists(f"{FOLDER}/events.parquet"):
        pytest.skip("no test tables")
    return oracle.connect(FOLDER)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, db, name):
    if name in SQL:
        problem = oracle.compare(spark, db, FOLDER, QUERIES[name], SQL[name])
        assert problem in (None, "both empty"), problem
    else:
        assert QUERIES[name](spark, FOLDER).count() > 0
