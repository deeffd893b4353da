"""The driver's contract."""

from __future__ import annotations

import os
import re

import pytest

import __spark_entry__ as e


def test_names():
    assert set(e.oracle_sql()) <= set(e.queries())
    assert len({n for n in e.queries() if re.match(r"op\d+_", n)}) in (0, 13)


@pytest.mark.skipif(not os.path.exists(e.SMALL), reason="the tables aren't there")
def test_entry(spark):
    assert e.entry(spark).count() == 5
