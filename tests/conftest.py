import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from kodagraf.runtime import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = local_session("4", shuffle_partitions=4, app="tests")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture
def make_units(spark):
    """Unit rows from (id, kind, start, end, signature, body, docstring)."""

    def build(rows):
        full = [(i, k, i.rsplit(":", 1)[0], 0, 0, s, e, sig, body, doc, "python") for i, k, s, e, sig, body, doc in rows]
        from kodagraf.schema import CODE_UNITS

        return spark.createDataFrame(full, CODE_UNITS)

    return build


@pytest.fixture
def make_edges(spark):
    def build(pairs):
        rows = [(p[0], p[1], p[2] if len(p) > 2 else "CALLS") for p in pairs]
        return spark.createDataFrame(rows, "source_id string, target_id string, edge_type string")

    return build
