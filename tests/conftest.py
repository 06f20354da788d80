from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from shelflife.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    # Four attempts per task, so that tests can lose some.
    session = local_session("8,4", "tests")
    yield session
    session.stop()


@pytest.fixture
def base(tmp_path):
    """A base folder with the default roots, all empty."""
    from shelflife.sources.tree import DEFAULT_ROOTS

    for name in DEFAULT_ROOTS:
        (tmp_path / "logs" / name).mkdir(parents=True)
    return tmp_path / "logs"
