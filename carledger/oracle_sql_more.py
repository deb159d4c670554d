"""Second-engine SQL for history, fleet rules, checks and commands."""

from __future__ import annotations

from carledger import params as P
from carledger.oracle_sql import (
    DAY_US, q_cents, q_hi, q_key, q_micros, q_money, q_ts, with_adapter,
)

EVENTS = ("ev", """
SELECT id AS seq, changed_at AS ts,
       CASE WHEN id = min(id) OVER (PARTITION BY order_id) THEN 'I'
            WHEN status = '1' THEN 'D' ELSE 'U' END AS op,
       order_id, client_pass, car_reg_num, rented_at, returned_at, total_price, v_user
FROM rent_history""")


def statements() -> dict[str, str]:
    out = {}
    wb = "(PARTITION BY order_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    cols = ["client_pass", "car_reg_num", "rented_at", "returned_at", "total_price"]
    prev = ",\n       ".join(f"last_value(CASE WHEN val THEN {c} END IGNORE NULLS) OVER {wb} AS p_{c}"
                            for c in cols)
    pick = ",\n       ".join(f"CASE WHEN op = 'D' THEN p_{c} ELSE {c} END AS {c}" for c in cols[:4])
    out["order_change_log"] = with_adapter(f"""
SELECT seq AS id, order_id, ts AS changed_at,
       {pick},
       CASE WHEN op = 'D' THEN '1' ELSE '0' END AS status,
       CASE WHEN op = 'D' THEN p_total_price ELSE total_price END AS total_price,
       CASE WHEN op = 'D' THEN 'client returned a car.'
            WHEN op = 'I' THEN 'order was created.'
            WHEN p_car_reg_num <> car_reg_num THEN 'client changed a car.'
            WHEN p_returned_at <> returned_at THEN 'client renewed a car.'
            WHEN p_client_pass <> client_pass THEN 'client was changed.'
       END AS note,
       v_user
FROM (SELECT *, {prev}
      FROM (SELECT *, eff AND op IN ('I', 'U') AS val
            FROM (SELECT *, (op = 'I' AND NOT ex) OR (op IN ('U', 'D') AND ex) AS eff
                  FROM (SELECT *, coalesce(last_value(m IGNORE NULLS) OVER {wb} = 'I', false) AS ex
                        FROM (SELECT *, CASE WHEN op IN ('I', 'D') THEN op END AS m FROM ev) e1) e2) e3) e4) e5
WHERE eff AND (op = 'D' OR order_id > 0)""", EVENTS)
    # The streamed change log must equal the batch one row for row.
    out["order_change_stream"] = out["order_change_log"]

    exp = q_ts(P.EXPIRE_AT)
    out["expired_orders"] = with_adapter(f"""
SELECT CAST({P.EXPIRE_ID_OFFSET} + id AS BIGINT) AS id, id AS order_id, {exp} AS changed_at,
       client_pass, car_reg_num, rented_at, returned_at, '1' AS status, total_price,
       'client returned a car.' AS note, '{P.V_USER}' AS v_user
FROM rent_orders WHERE returned_at <= {exp}""")
    out["expired_orders_left"] = with_adapter(f"""
SELECT id, client_pass, car_reg_num, rented_at, returned_at, total_price
FROM rent_orders WHERE NOT (returned_at <= {exp})""")

    t = q_ts(P.TICK_AT)
    due = f"(s1 = 1 AND {q_micros(t, 'tech_serv_date')} >= {20 * DAY_US})"
    out["fleet_tick"] = with_adapter(f"""
SELECT reg_num,
       CAST(CASE WHEN {due} THEN 3
                 WHEN s1 = 3 AND {t} > tech_serv_date + INTERVAL 1 DAY THEN 1
                 ELSE s1 END AS INTEGER) AS state_id,
       color, mark, type, price,
       CASE WHEN {due} THEN date_trunc('second', {t}) ELSE tech_serv_date END AS tech_serv_date
FROM (SELECT c.*, CASE WHEN e.reg_num IS NOT NULL THEN 1 ELSE c.state_id END AS s1
      FROM cars c
      LEFT JOIN (SELECT DISTINCT car_reg_num AS reg_num FROM rent_orders WHERE returned_at <= {t}) e
        ON e.reg_num = c.reg_num) c1""")

    out["pick_free_car"] = with_adapter(f"""
SELECT reg_num, state_id, color, mark, type, price, tech_serv_date
FROM cars WHERE state_id = 1
ORDER BY md5(reg_num || '{P.PICK_SEED}'), reg_num LIMIT 1""")

    num = (f"{q_cents('o.total_price')} * {DAY_US} + {q_hi(q_micros('o.returned_at', 's.ts'))} * "
           f"({q_cents('cn.price')} - {q_cents('co.price')})")
    out["swap_quote"] = with_adapter(f"""
SELECT s.id, o.car_reg_num AS old_car, s.first_car AS new_car, s.ts, {q_money(num)} AS total_price
FROM (SELECT id, first_car, rented_at + INTERVAL 1 DAY AS ts FROM open_orders) s
JOIN rent_orders o ON o.id = s.id
JOIN cars co ON co.reg_num = o.car_reg_num
JOIN cars cn ON cn.reg_num = s.first_car""")

    out["renew_quote"] = with_adapter("""
SELECT o.id, o.car_reg_num, date_trunc('second', o.returned_at) + INTERVAL 1 DAY AS returned_at,
       o.total_price + c.price AS total_price
FROM rent_orders o JOIN cars c ON c.reg_num = o.car_reg_num""")

    # Two calls for each open order, most for unknown ones; the first counts.
    closes = [("calls", """
SELECT id * 10 + 7 + i.i AS seq, rented_at + to_days(1 + i.i) AS ts, CASE WHEN id % 3 = 0 THEN id ELSE -id END AS id
FROM rent_orders, (VALUES (0), (1)) i(i)"""), ("closes", """
SELECT seq, ts, id FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY seq) AS turn FROM calls) c WHERE turn = 1""")]
    out["close_early"] = with_adapter(f"""
SELECT CAST(c.seq AS BIGINT) AS id, o.id AS order_id, c.ts AS changed_at,
       client_pass, car_reg_num, rented_at, returned_at, '1' AS status, total_price,
       'client returned a car.' AS note, '{P.V_USER}' AS v_user
FROM rent_orders o JOIN closes c ON c.id = o.id""", *closes)
    out["close_early_orders"] = with_adapter("""
SELECT id, client_pass, car_reg_num, rented_at, returned_at, total_price FROM rent_orders
WHERE id NOT IN (SELECT id FROM closes)""", *closes)
    out["close_early_cars"] = with_adapter("""
SELECT reg_num, CAST(CASE WHEN reg_num IN (SELECT car_reg_num FROM rent_orders o JOIN closes c ON c.id = o.id) THEN 1
                          ELSE state_id END AS INTEGER) AS state_id, color, mark, type, price, tech_serv_date
FROM cars""", *closes)

    def dup(table, rule, src, key):
        return (f"SELECT '{table}' AS table_name, '{rule}' AS rule, CAST(count(*) AS BIGINT) AS violations "
                f"FROM (SELECT {key} FROM {src} WHERE {key} IS NOT NULL GROUP BY {key} HAVING count(*) > 1) x")

    def rows(table, rule, src, bad):
        return (f"SELECT '{table}' AS table_name, '{rule}' AS rule, "
                f"CAST(count(CASE WHEN {bad} THEN 1 END) AS BIGINT) AS violations FROM {src}")

    def fk(table, rule, src, key, parent, pkey):
        return (f"SELECT '{table}' AS table_name, '{rule}' AS rule, CAST(count(*) AS BIGINT) AS violations "
                f"FROM {src} s WHERE s.{key} IS NOT NULL AND NOT EXISTS "
                f"(SELECT 1 FROM {parent} p WHERE p.{pkey} = s.{key})")

    def nulls(*cols):
        return "(" + " OR ".join(f"{c} IS NULL" for c in cols) + ")"

    car_cols = ["reg_num", "state_id", "color", "mark", "type", "price", "tech_serv_date"]
    ord_cols = ["id", "client_pass", "car_reg_num", "rented_at", "returned_at", "total_price"]
    hist_cols = ["id", "order_id", "changed_at", "client_pass", "car_reg_num", "rented_at", "returned_at",
                 "status", "total_price", "v_user"]
    parts = [
        dup("carstates", "pk_id", "car_states", "id"),
        dup("carstates", "unique_state", "car_states", "state"),
        dup("cars", "pk_reg_num", "cars", "reg_num"),
        rows("carstates", "not_null", "car_states", nulls("id", "state")),
        rows("cars", "not_null", "cars", nulls(*car_cols)),
        rows("cars", "widths", "cars", "length(reg_num) > 10 OR length(color) > 20 OR length(mark) > 20 OR length(type) > 20"),
        fk("cars", "fk_state_id", "cars", "state_id", "car_states", "id"),
        dup("clients", "pk_pass", "clients", "pass"),
        rows("clients", "not_null", "clients", nulls("pass", "name")),
        rows("clients", "widths", "clients", "length(pass) > 10 OR length(name) > 40"),
        dup("orders", "pk_id", "rent_orders", "id"),
        dup("orders", "unique_client_pass", "rent_orders", "client_pass"),
        dup("orders", "unique_car_reg_num", "rent_orders", "car_reg_num"),
        rows("orders", "not_null", "rent_orders", nulls(*ord_cols)),
        fk("orders", "fk_client_pass", "rent_orders", "client_pass", "clients", "pass"),
        fk("orders", "fk_car_reg_num", "rent_orders", "car_reg_num", "cars", "reg_num"),
        dup("orders_history", "pk_id", "rent_history", "id"),
        rows("orders_history", "not_null", "rent_history", nulls(*hist_cols)),
        rows("orders_history", "check_status", "rent_history", "status NOT IN ('0', '1')"),
        rows("orders_history", "widths", "rent_history", "length(note) > 100 OR length(v_user) > 10"),
    ]
    out["constraint_violations"] = with_adapter("\nUNION ALL\n".join(parts))

    from carledger import oracle_sql_commands
    out.update(oracle_sql_commands.statements())
    from carledger import oracle_sql_journal, oracle_sql_stored
    out.update(oracle_sql_journal.statements())
    out.update(oracle_sql_stored.statements())

    out["free_keys"] = with_adapter(f"""
SELECT k.pass FROM (SELECT DISTINCT {q_key('', 'p_partkey')} AS pass FROM part) k
WHERE NOT EXISTS (SELECT 1 FROM clients c WHERE c.pass = k.pass)""")
    return out
