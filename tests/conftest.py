from __future__ import annotations

import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))

from reelyard.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, 4)
    yield session
    session.stop()


@pytest.fixture()
def rows():
    """Collected rows as plain dicts, sorted by their text."""

    def collect(df):
        return sorted((r.asDict(recursive=True) for r in df.collect()), key=str)

    return collect
