import sys
from datetime import date
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from duskline.session import local_session  # noqa: E402

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("checkpoints"))
    # A zone far from UTC: no result may depend on the session zone.
    return local_session(
        "duskline-tests",
        "4",
        **{
            "spark.sql.session.timeZone": "Asia/Tokyo",
            "spark.checkpoint.dir": folder,
            "spark.sql.shuffle.partitions": "4",
        },
    )


@pytest.fixture(scope="session")
def sf_dir():
    return SF_DIR


def day(text):
    return date.fromisoformat(text)


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


def plan(df):
    """Text of the physical plan before it runs."""
    return df._jdf.queryExecution().executedPlan().toString()


def final_plan(df):
    """Text of the physical plan as it ran."""
    df.collect()
    return plan(df)
