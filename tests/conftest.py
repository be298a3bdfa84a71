import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from pairlens.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    return local_session("tests", 4, partitions=4, memory="6g", folder=str(tmp_path_factory.mktemp("shared")))


@pytest.fixture
def one(spark):
    """Evaluate a column over literal values: one(column_fn, *values)."""
    from pyspark.sql import functions as F

    def run(fn, *values):
        names = [f"c{i}" for i in range(len(values))]
        schema = ", ".join(f"{n} {'int' if isinstance(v, int) and not isinstance(v, bool) else 'string'}" for n, v in zip(names, values))
        df = spark.createDataFrame([tuple(values)], schema)
        return df.select(fn(*[F.col(n) for n in names]).alias("r")).first()["r"]

    return run
