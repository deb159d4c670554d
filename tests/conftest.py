import os
import sys
import tempfile
from datetime import datetime
from decimal import Decimal

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


@pytest.fixture(scope="session")
def spark():
    from carledger.session import get_session
    s = get_session("local[4]", 4, app="carledger-tests", extra={"spark.driver.memory": "4g"})
    if not s.conf.get("spark.checkpoint.dir", None) and not s.sparkContext.getCheckpointDir():
        # Tests only: a cluster names a shared folder in spark.checkpoint.dir.
        s.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="carledger-test-"))
    yield s
    s.stop()


def D(day, hour=0, minute=0):
    """January 2024, as in the hand-computed fixture."""
    return datetime(2024, 1, day, hour, minute)


def M(x):
    return Decimal(str(x)).quantize(Decimal("0.01"))


@pytest.fixture(scope="session")
def fixture_tables(spark):
    from carledger import schema as S
    from carledger.operators.quality import car_states
    cars = spark.createDataFrame([
        ("A000000001", 2, "red", "bmw", "sedan", M(1000), D(1)),
        ("A000000002", 1, "blue", "kia", "micro", M(800), D(1)),
        ("A000000003", 3, "white", "audi", "coupe", M(1500), D(10)),
        ("A000000004", 1, "black", "jeep", "pickup", M(2000), D(20)),
    ], S.CARS)
    clients = spark.createDataFrame([
        ("1000000001", "ann"), ("1000000002", "bob"), ("1000000003", "eve")], S.CLIENTS)
    orders = spark.createDataFrame([
        (2, "1000000002", "A000000001", D(10), D(12, 12), M(2500))], S.ORDERS)
    c1, c2 = "1000000001", "1000000002"
    history = spark.createDataFrame([
        (1, 1, D(5), c1, "A000000001", D(5), D(8), "0", M(3000), None, "U"),
        (2, 1, D(6), c1, "A000000001", D(5), D(9), "0", M(4000), None, "U"),
        (3, 1, D(7), c1, "A000000002", D(5), D(9), "0", M(3600), None, "U"),
        (4, 1, D(8), c1, "A000000002", D(5), D(9), "1", M(3600), None, "U"),
        (5, 2, D(10), c2, "A000000001", D(10), D(12, 12), "0", M(2500), None, "U"),
    ], S.ORDERS_HISTORY)
    return {"cars": cars, "clients": clients, "orders": orders, "history": history,
            "car_states": car_states(spark)}
