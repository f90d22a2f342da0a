from __future__ import annotations

import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from biotrace.schema import SCHEMAS, Tables  # noqa: E402
from biotrace.session import local_session  # noqa: E402

TESTDATA = os.environ.get("TESTDATA_DIR", "/root/testdata")


@pytest.fixture(scope="session")
def spark():
    session = local_session(8)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def make_tables(spark):
    """Domain tables from lists of tuples; tables not given are empty."""

    def make(**rows) -> Tables:
        return Tables(
            **{
                name: spark.createDataFrame(rows.get(name, []), schema)
                for name, schema in SCHEMAS.items()
            }
        )

    return make


def rows_of(df, *columns) -> list[tuple]:
    """All rows as sorted tuples."""
    picked = df.select(*columns) if columns else df
    return sorted((tuple(row) for row in picked.collect()), key=repr)
