"""Every registered query of the library beside its DuckDB oracle on sf0.01; those without one must run and give rows."""

from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))
from compare import difference  # noqa: E402

from pairwright.plans import registry  # noqa: E402

SF = "/root/testdata/sf0.01"
QUERIES, ORACLES = registry.queries(), registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_oracle(spark, name):  # noqa: ANN001
    assert difference(spark, name, QUERIES[name], ORACLES[name], SF) == ""


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, name):  # noqa: ANN001
    assert QUERIES[name](spark, SF).count() > 0


def test_entry(spark):  # noqa: ANN001
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
