"""Second-engine SQL of the queries over stored layouts, states and files."""

from __future__ import annotations

from carledger import params as P
from carledger.functions import fixed as X
from carledger.oracle_sql import _reports, q_ts, with_adapter
from carledger.oracle_sql_commands import CMD
from carledger.oracle_sql_journal import LOG, ORDERS, PLAN, UPDATES, _COLS, _fold, journal

HISTORY = "id, order_id, changed_at, client_pass, car_reg_num, rented_at, returned_at, status, total_price, note, v_user"


def _run(body: str, source: list, after: list = ()) -> str:
    return with_adapter(body, *source, *PLAN.items(), (f"r(kind, k, {', '.join(_COLS)}) USING KEY (kind, k)", _fold()), *after, recursive=True)


def _numbered(sql: str, order: str) -> str:
    """A report of ``_reports`` with the place of each row."""
    i = sql.rindex("\nSELECT")
    body = sql[i + 1:sql.rindex("ORDER BY")]
    j = body.index("\nFROM")
    return sql[:i + 1] + body[:j] + f", row_number() OVER (ORDER BY {order}) - 1 AS position" + body[j:]


def statements() -> dict[str, str]:
    rep, out = _reports(), {}
    out["orders_diff_log"] = _run(f"""
SELECT CAST({P.DIFF_ID_OFFSET} + coalesce(a.id, b.id) AS BIGINT) AS id, coalesce(a.id, b.id) AS order_id, {q_ts(P.AS_OF)} AS changed_at,
       CASE WHEN a.id IS NULL THEN b.client_pass ELSE a.client_pass END AS client_pass,
       CASE WHEN a.id IS NULL THEN b.car_reg_num ELSE a.car_reg_num END AS car_reg_num,
       CASE WHEN a.id IS NULL THEN b.rented_at ELSE a.rented_at END AS rented_at,
       CASE WHEN a.id IS NULL THEN b.returned_at ELSE a.returned_at END AS returned_at,
       CASE WHEN a.id IS NULL THEN '1' ELSE '0' END AS status,
       CASE WHEN a.id IS NULL THEN b.total_price ELSE a.total_price END AS total_price,
       CASE WHEN b.id IS NULL THEN '{X.NOTE_CREATED}' WHEN a.id IS NULL THEN '{X.NOTE_RETURNED}'
            WHEN a.car_reg_num <> b.car_reg_num THEN '{X.NOTE_CAR_CHANGED}' WHEN a.returned_at <> b.returned_at THEN '{X.NOTE_RENEWED}'
            WHEN a.client_pass <> b.client_pass THEN '{X.NOTE_CLIENT_CHANGED}' END AS note, '{P.V_USER}' AS v_user
FROM rent_orders b FULL JOIN after_calls a ON a.id = b.id
WHERE a.id IS NULL OR b.id IS NULL OR a.client_pass IS DISTINCT FROM b.client_pass OR a.car_reg_num IS DISTINCT FROM b.car_reg_num
   OR a.rented_at IS DISTINCT FROM b.rented_at OR a.returned_at IS DISTINCT FROM b.returned_at
   OR a.total_price IS DISTINCT FROM b.total_price""", [("jr", journal())], [("after_calls", ORDERS)])
    for name in ("orders_changes", "orders_changes_report", "cars_report"):
        out[f"rolling_{name}"] = rep[name]
    out["client_history"] = with_adapter(f"SELECT {HISTORY} FROM rent_history WHERE client_pass IN (SELECT client_pass FROM rent_orders)")
    out["car_history"] = with_adapter(f"SELECT {HISTORY} FROM rent_history WHERE car_reg_num IN (SELECT reg_num FROM cars WHERE state_id = 2)")
    few = lambda keys: ", ".join(f"'{k}'" for k in keys)
    out["client_lookup"] = with_adapter(f"SELECT {HISTORY} FROM rent_history WHERE client_pass IN ({few(f'{k:010X}' for k in P.LOOKUP_KEYS)})")
    out["car_lookup"] = with_adapter(f"SELECT {HISTORY} FROM rent_history WHERE car_reg_num IN ({few(f'C{k:09X}' for k in P.LOOKUP_KEYS)})")

    # Batch 1: the order updates; batch 2: closes of the orders as they are then.
    source = [("ofc", CMD["ofc"]), ("order_updates", CMD["order_updates"]), ("jr", UPDATES)]
    closes = CMD["od1"].replace("rent_orders", "orders1"), CMD["order_deletes"].replace("rent_orders", "orders1")
    after = [("orders1", ORDERS), ("log1", LOG), ("od1", closes[0]), ("order_deletes", closes[1]),
             ("h1", f"SELECT {HISTORY} FROM rent_history UNION ALL SELECT id + (SELECT max(id) FROM rent_history), "
                    f"{HISTORY.removeprefix('id, ')} FROM log1")]
    out["stored_batches_history"] = _run(f"""
SELECT {HISTORY} FROM h1
UNION ALL
SELECT d.seq + (SELECT max(id) FROM h1), o.id, d.ts, o.client_pass, o.car_reg_num, o.rented_at, o.returned_at, '1', o.total_price,
       '{X.NOTE_RETURNED}', '{P.V_USER}'
FROM orders1 o JOIN (SELECT id, min(seq) AS seq, arg_min(ts, seq) AS ts FROM order_deletes GROUP BY id) d ON d.id = o.id""", source, after)
    out["stored_batches_orders"] = _run("SELECT * FROM orders1 WHERE id NOT IN (SELECT id FROM order_deletes)", source, after)

    out["orders_history_csv"] = _numbered(rep["orders_history_export"], "rented_at, id")
    out["cars_history_csv"] = _numbered(rep["cars_history_export"], "order_id, client_pass, car_reg_num")

    dup = lambda t, rule, old, new, key: (
        f"SELECT '{t}' AS table_name, '{rule}' AS rule, count(*) AS violations FROM (SELECT k FROM (SELECT CAST({key} AS VARCHAR) AS k, 0 AS b "
        f"FROM {old} UNION ALL SELECT CAST({key} AS VARCHAR), 1 FROM {new}) u WHERE k IS NOT NULL GROUP BY k "
        f"HAVING count(*) > 1 AND count(*) - sum(b) <= 1) g")
    rows = lambda t, rule, bad, new: f"SELECT '{t}', '{rule}', count(*) FROM {new} WHERE {bad}"
    nulls = lambda cols: " OR ".join(f"{c.strip()} IS NULL" for c in cols)
    order_cols = "id, client_pass, car_reg_num, rented_at, returned_at, total_price".split(",")
    parts = [dup("orders", r, "rent_orders", "new_orders", k) for r, k in
             (("pk_id", "id"), ("unique_client_pass", "client_pass"), ("unique_car_reg_num", "car_reg_num"))]
    parts += [
        dup("orders_history", "pk_id", "rent_history", "new_history", "id"),
        rows("orders", "not_null", nulls(order_cols), "new_orders"),
        rows("orders_history", "not_null", nulls([c for c in HISTORY.split(",") if c.strip() != "note"]), "new_history"),
        rows("orders_history", "check_status", "status NOT IN ('0', '1')", "new_history"),
        rows("orders_history", "widths", "length(note) > 100 OR length(v_user) > 10", "new_history"),
        rows("orders", "fk_client_pass", "client_pass IS NOT NULL AND client_pass NOT IN (SELECT pass FROM clients)", "new_orders"),
        rows("orders", "fk_car_reg_num", "car_reg_num IS NOT NULL AND car_reg_num NOT IN (SELECT reg_num FROM cars)", "new_orders"),
    ]
    out["batch_violations"] = with_adapter("\nUNION ALL\n".join(parts), ("order_adds", CMD["order_adds"]), ("new_orders", f"""
SELECT CAST({P.ORDER_ID_OFFSET} + seq // 2 AS BIGINT) AS id, client_pass, car_reg_num, ts AS rented_at, returned_at, 1 AS total_price
FROM order_adds"""), ("new_history", """
SELECT id * 1000000 + 1 AS id, id AS order_id, rented_at AS changed_at, client_pass, car_reg_num, rented_at, returned_at,
       CASE WHEN id % 2 = 0 THEN '0' ELSE 'x' END AS status, total_price, CAST(NULL AS VARCHAR) AS note, 'A long user name' AS v_user
FROM rent_orders"""))
    out["client_report_parts"] = with_adapter(f"""
SELECT p.client_pass, CAST(p.part_no AS BIGINT) AS part_no, CAST(ceil(g.cars / {P.PART_CARS}.0) AS BIGINT) AS parts, p.car_list, g.revenue, g.closed_revenue
FROM (SELECT client_pass, (rn - 1) // {P.PART_CARS} AS part_no, string_agg(car_reg_num, ', ' ORDER BY car_reg_num) AS car_list
      FROM (SELECT client_pass, car_reg_num, row_number() OVER (PARTITION BY client_pass ORDER BY car_reg_num) AS rn
            FROM (SELECT DISTINCT client_pass, car_reg_num FROM rent_history) d) n GROUP BY ALL) p
JOIN (SELECT client_pass, count(DISTINCT car_reg_num) AS cars,
             CAST(count(*) * sum(CASE WHEN status = '1' THEN total_price END) AS DECIMAL(38,2)) AS revenue,
             CAST(sum(CASE WHEN status = '1' THEN total_price END) AS DECIMAL(38,2)) AS closed_revenue
      FROM rent_history GROUP BY client_pass HAVING count(CASE WHEN status = '1' THEN 1 END) > 0) g ON g.client_pass = p.client_pass""")
    return out
