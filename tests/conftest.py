from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark():
    from tessera.session import build_session, guard_unions

    s = build_session("tests", "local[4]", 4)
    s.sparkContext.setLogLevel("ERROR")
    guard_unions(s)
    yield s
    s.stop()


@pytest.fixture(scope="session")
def small():
    return "/root/testdata/sf0.001"


def rows(df) -> list[tuple]:
    return sorted((tuple(r) for r in df.collect()), key=str)
