import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path[:0] = [str(ROOT), str(ROOT / "tests")]

from admeter.model import EVENT_SCHEMA  # noqa: E402
from admeter.session import build  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build(
        "tests",
        "local[4]",
        **{
            "spark.sql.shuffle.partitions": "4",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "4g",
            "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared")),
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def events(spark):
    """Build canonical events from dicts; fields not named are null, ``seq`` counts up."""

    def make(rows):
        names = EVENT_SCHEMA.fieldNames()
        full = [{**dict.fromkeys(names), "seq": i, **r} for i, r in enumerate(rows)]
        return spark.createDataFrame([tuple(r[n] for n in names) for r in full], EVENT_SCHEMA)

    return make
