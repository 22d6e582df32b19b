import json
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from meterwork.session import build_session  # noqa: E402

LINES = "file string, block_start bigint, line_no bigint, pos bigint, value string, mtime string"


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "local[4]",
        app="tests",
        **{"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.driver.memory": "4g"},
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def lines(spark):
    """Log lines of several files: {file: [object or raw text, ...]}."""

    def make(files, mtime="2026-07-20T00:00:00.000Z"):
        rows = [
            (name, 0, i, 0, x if isinstance(x, str) else json.dumps(x), mtime)
            for name, content in files.items()
            for i, x in enumerate(content)
        ]
        return spark.createDataFrame(rows, LINES)

    return make


def records(df):
    return [r.asDict(recursive=True) for r in df.collect()]


def by_session(usage):
    """{session: {model: (input, cache read, cache write, output, turns)}}"""
    from meterwork.plans.reports import usage_by

    out = {}
    for r in records(usage_by(usage, ["session_id", "model"])):
        out.setdefault(r["session_id"], {})[r["model"]] = (
            r["input_tokens"], r["cache_read_tokens"], r["cache_write_tokens"], r["output_tokens"], r["turns"],
        )
    return out
