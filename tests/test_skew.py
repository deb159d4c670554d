"""Hot keys: orders with very many events are split into seq-range pieces;
results must equal the plain one-window-per-order computation."""

from datetime import datetime, timedelta
from decimal import Decimal

import pytest

from carledger import schema as S
from carledger.operators import history as H


@pytest.fixture()
def low_hot_threshold(spark):
    spark.conf.set("carledger.hotKeyRows", "50")
    yield
    spark.conf.unset("carledger.hotKeyRows")


def _events(spark):
    t0 = datetime(2024, 5, 1)
    rows, seq = [], 0
    for oid, n in [(1, 1200), (2, 3), (3, 400), (4, 1)]:
        for k in range(n):
            seq += 1 + (k % 3)
            op = "I" if k == 0 else ("D" if k == n - 1 and oid != 4 else "U")
            car = f"C{(k // 7) % 5:09d}"
            client = f"{oid:010d}" if k % 50 else f"{oid + 100:010d}"
            ret = t0 + timedelta(days=k // 3)
            rows.append((seq, t0 + timedelta(minutes=seq), op, oid, client, car, t0, ret,
                         Decimal(1000 + k).scaleb(-1).quantize(Decimal("0.01")), "u"))
    return spark.createDataFrame(rows, S.ORDER_EVENTS)


def test_change_log_split_equals_plain(spark, low_hot_threshold):
    ev = _events(spark)
    from carledger.plans.skew import hot_keys
    assert sorted(r.order_id for r in hot_keys(ev, "order_id", "seq").collect()) == [1, 3]
    plain = sorted(tuple(r) for r in H.order_change_log(ev, split_hot=False).collect())
    split = sorted(tuple(r) for r in H.order_change_log(ev, split_hot=True).collect())
    assert len(plain) == 1604
    assert split == plain
