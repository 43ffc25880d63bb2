"""Shared test session."""

from __future__ import annotations

import pathlib
import sys
import tempfile

import pytest

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parent.parent))

from postwise.session import build_session  # noqa: E402


def test_session():
    spark = build_session(
        "postwise-tests",
        spark__master="local[8]",
        spark__sql__shuffle__partitions="8",
        spark__ui__enabled="false",
        spark__driver__memory="8g",
        spark__sql__streaming__forceDeleteTempCheckpointLocation="true",
    )
    spark.sparkContext.setLogLevel("ERROR")
    if not spark.conf.get("spark.checkpoint.dir", None):
        spark.conf.set("spark.checkpoint.dir", tempfile.mkdtemp(prefix="postwise-tests-"))
    return spark


test_session.__test__ = False


@pytest.fixture(scope="session")
def spark():
    session = test_session()
    yield session
    session.stop()
