import os
import sys
import tempfile
from pathlib import Path

import pytest

HERE = Path(__file__).resolve().parent
sys.path.insert(0, str(HERE.parent))
# Python workers load the client factories of the tests by module name.
os.environ["PYTHONPATH"] = os.pathsep.join([str(HERE.parent), str(HERE), os.environ.get("PYTHONPATH", "")])

from mendery.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("tests", cores=4, **{"spark.sql.shuffle.partitions": "4", "spark.driver.memory": "4g", "spark.checkpoint.dir": tempfile.mkdtemp(prefix="mendery-tests-")})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


BASE = {
    "order_id": "ORD-000001",
    "customer_id": "CUST-0001",
    "order_date": "2026-01-01",
    "amount": "49.99",
    "currency": "USD",
    "status": "pending",
}


@pytest.fixture
def base():
    return dict(BASE)


@pytest.fixture(scope="session")
def known(spark):
    return spark.createDataFrame([(f"CUST-{i:04d}",) for i in range(1, 201)], "customer_id string")


@pytest.fixture(scope="session")
def make_rows(spark):
    """Row frame from dicts of overrides; ``run_id`` and ``row_index`` may be given too."""

    def make(*changes):
        rows = []
        for i, change in enumerate(changes):
            row = {**BASE, "order_id": f"ORD-{i + 1:06d}", "run_id": 1, "row_index": i, **change}
            rows.append(tuple(row[c] for c in ("run_id", "row_index", *BASE)))
        schema = "run_id bigint, row_index bigint, " + ", ".join(f"{c} string" for c in BASE)
        return spark.createDataFrame(rows, schema)

    return make
