import os
import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
# workers import what this process imports, wherever it found it
os.environ["PYTHONPATH"] = os.pathsep.join(dict.fromkeys(str(Path(p).resolve()) for p in sys.path))
os.environ["PYSPARK_PYTHON"] = sys.executable


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.checkpoint.dir", f"file://{tmp_path_factory.mktemp('shared')}")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()


def same_rows(left, right):
    """Whether two pandas frames hold the same rows, in any order; doubles to the last bit."""

    def plain(x):
        if x is None or x != x:
            return "null"
        return str(x) if isinstance(x, (str, bool)) or type(x).__name__ == "bool_" else repr(float(x)) if isinstance(x, (int, float)) else str(x)

    def rows(df):
        df = df[sorted(df.columns)].astype(object)
        df = df.where(df.notna(), None)
        return sorted(str(tuple(map(plain, r))) for r in df.itertuples(index=False, name=None))

    return sorted(left.columns) == sorted(right.columns) and rows(left) == rows(right)
