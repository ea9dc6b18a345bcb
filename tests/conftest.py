"""Shared session and the comparison of Spark rows with another engine's."""

from __future__ import annotations

import datetime as dt
import sys
from decimal import Decimal
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))

from yardline.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(name="yardline-tests")
    yield session
    session.stop()


def plain(value):
    """One text per value, so that 1, 1.0 and Decimal('1.00') agree only where they should."""
    if value is None:
        return None
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, (int, Decimal)):
        return format(Decimal(value).normalize(), "f")
    if isinstance(value, float):
        return repr(value)
    if isinstance(value, (dt.date, dt.datetime)):
        return value.isoformat()
    return str(value)


def sorted_rows(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    texts = [tuple(plain(row[i]) for i in order) for row in rows]
    return sorted(texts, key=lambda row: tuple((v is not None, v or "") for v in row))
