from __future__ import annotations

import os
import sys
from pathlib import Path

import pytest

REPO = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(REPO))
os.environ.setdefault("TZ", "UTC")


@pytest.fixture(scope="session")
def spark():
    from larkspur.session import get_spark

    session = get_spark(
        "tests",
        "local[4]",
        spark__sql__shuffle__partitions="4",
        spark__driver__memory="4g",
        spark__ui__showConsoleProgress="false",
        spark__sql__files__maxPartitionBytes="1m",
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def data() -> str:
    return os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
