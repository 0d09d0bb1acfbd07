from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from docquarry.session import build_session

    session = build_session(
        "docquarry-tests",
        "local[8]",
        spark__sql__shuffle__partitions="8",
        spark__driver__memory="8g",
        spark__driver__host="127.0.0.1",
    )
    yield session
    session.stop()


@pytest.fixture(scope="session")
def folder():
    return DATA
