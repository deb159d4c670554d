"""Second-engine SQL for the command verbs over the derived command tables."""

from __future__ import annotations

from carledger import params as P
from carledger.functions import fixed as X
from carledger.oracle_sql import q_add, q_cents, q_hi, q_key, q_micros, q_money, q_ts, with_adapter

AS_OF = q_ts(P.AS_OF)


def at(h: str) -> str:
    return q_add(AS_OF, "0", h)


def newkey(prefix: str, k: str) -> str:
    return q_key(prefix, k)


def carkey(k: str) -> str:
    return newkey("C", k)


def clientkey(k: str) -> str:
    return q_key("", k)


K, C = "p_partkey", "c_custkey"

CMD = {
    "car_adds": f"""
SELECT CAST({K} AS BIGINT) AS seq, {at(f'{K} % 24')} AS ts,
       CASE WHEN {K} % 5 = 0 THEN {carkey(K)} WHEN {K} % 7 = 0 THEN {newkey('N', f'{K} - 1')}
            ELSE {newkey('N', K)} END AS reg_num,
       CASE WHEN {K} % 17 <> 0 THEN split_part(p_name, ' ', 2) END AS color, p_brand AS mark, p_type AS type,
       CASE WHEN {K} % 11 <> 0 THEN CAST(CAST(p_retailprice AS DECIMAL(10,2)) + 100 AS DECIMAL(10,2)) END AS price
FROM part""",
    "car_added": """
SELECT reg_num, color, mark, type, price, ts, seq
FROM (SELECT *, row_number() OVER (PARTITION BY reg_num ORDER BY seq) AS turn FROM car_adds a
      WHERE color IS NOT NULL AND mark IS NOT NULL AND type IS NOT NULL AND price IS NOT NULL
        AND length(reg_num) <= 10 AND length(color) <= 20 AND length(mark) <= 20 AND length(type) <= 20
        AND abs(price) < 100000000 AND NOT EXISTS (SELECT 1 FROM cars c WHERE c.reg_num = a.reg_num)) x
WHERE turn = 1""",
    "cu1": f"""
SELECT CAST({K} AS BIGINT) * 2 AS seq, {at(f'{K} % 24')} AS ts,
       CASE WHEN {K} % 13 = 0 THEN {newkey('X', K)} ELSE {carkey(K)} END AS reg_num,
       CAST(CASE WHEN {K} % 8 = 3 THEN 9 WHEN {K} % 4 = 0 THEN NULL WHEN {K} % 4 = 1 THEN 1
                 WHEN {K} % 4 = 2 THEN 3 ELSE 2 END AS INTEGER) AS state_id,
       CASE WHEN {K} % 3 = 0 THEN 'mixed' END AS color,
       CAST(NULL AS VARCHAR) AS mark, CAST(NULL AS VARCHAR) AS type,
       CASE WHEN {K} % 2 = 0 THEN CAST(CAST(p_retailprice AS DECIMAL(10,2)) - 50 AS DECIMAL(10,2)) END AS price,
       CASE WHEN {K} % 5 = 0 THEN {AS_OF} END AS tech_serv_date
FROM part""",
    "car_updates": f"""
SELECT * FROM cu1
UNION ALL
SELECT seq + 1, ts + INTERVAL 1 DAY, reg_num, CAST(NULL AS INTEGER),
       CASE WHEN seq % 12 = 0 THEN 'repainted' END, mark, CASE WHEN seq % 12 = 0 THEN 'rebuilt' END,
       CAST(NULL AS DECIMAL(10,2)), CAST(NULL AS TIMESTAMP)
FROM cu1""",
    "cd1": f"""
SELECT CAST({K} AS BIGINT) * 2 AS seq, {at(f'{K} % 24')} AS ts,
       CASE WHEN {K} % 13 = 0 THEN {newkey('X', K)} ELSE {carkey(K)} END AS reg_num
FROM part""",
    "car_deletes": f"SELECT * FROM cd1 UNION ALL SELECT seq + 1, ts, reg_num FROM cd1",
    "car_gone": """
SELECT reg_num, seq
FROM (SELECT d.*, row_number() OVER (PARTITION BY d.reg_num ORDER BY d.seq) AS turn FROM car_deletes d
      JOIN cars k ON k.reg_num = d.reg_num
      WHERE k.state_id <> 2 AND NOT EXISTS (SELECT 1 FROM rent_orders o WHERE o.car_reg_num = d.reg_num)) x
WHERE turn = 1""",
    "client_adds": f"""
SELECT CAST({C} AS BIGINT) AS seq, {at(f'{C} % 24')} AS ts,
       CASE WHEN {C} % 5 = 0 THEN {clientkey(C)} WHEN {C} % 7 = 0 THEN {newkey('N', f'{C} - 1')}
            ELSE {newkey('N', C)} END AS pass,
       CASE WHEN {C} % 9 > 1 THEN c_name END AS name
FROM customer""",
    "client_added": """
SELECT pass, name, seq
FROM (SELECT *, row_number() OVER (PARTITION BY pass ORDER BY seq) AS turn FROM client_adds a
      WHERE name IS NOT NULL AND length(pass) <= 10 AND length(name) <= 40
        AND NOT EXISTS (SELECT 1 FROM clients c WHERE c.pass = a.pass)) x
WHERE turn = 1""",
    "cl1": f"""
SELECT CAST({C} AS BIGINT) * 2 AS seq, {at(f'{C} % 24')} AS ts,
       CASE WHEN {C} % 11 = 0 THEN {newkey('X', C)} ELSE {clientkey(C)} END AS pass,
       CASE WHEN {C} % 2 = 0 THEN upper(c_name) END AS name, c_name
FROM customer""",
    "client_updates": f"""
SELECT seq, ts, pass, name FROM cl1
UNION ALL SELECT seq + 1, ts, pass, CASE WHEN seq % 12 = 0 THEN c_name || ' jr' END FROM cl1""",
    "client_deletes": f"""
SELECT CAST({C} AS BIGINT) AS seq, {at(f'{C} % 24')} AS ts, {clientkey(C)} AS pass FROM customer""",
    "order_adds": f"""
SELECT seq, ts, client_pass, car_reg_num,
       CASE WHEN k % 10 = 0 THEN ts - INTERVAL 1 DAY
            WHEN k % 17 = 0 THEN CAST(NULL AS TIMESTAMP)
            ELSE {q_add('ts', 'k % 7 + 1', '(k % 4) * 6')} END AS returned_at
FROM (SELECT {C} AS k, CAST({C} AS BIGINT) * 3 AS seq, {at(f'{C} % 24')} AS ts, {clientkey(C)} AS client_pass,
             {carkey(f'CASE WHEN {C} % 6 = 0 THEN greatest({C} - 1, 0) ELSE {C} END')} AS car_reg_num
      FROM customer) x
UNION ALL
SELECT CAST(f.k AS BIGINT) * 3 + 1 + i.i, {at('f.k % 24')}, f.client_pass, g.car_reg_num,
       {q_add(at('f.k % 24'), 'f.k % 5 + 1')}
FROM (SELECT {C} AS k, {clientkey(C)} AS client_pass, CAST(floor({C} / 1000) AS BIGINT) AS block,
             row_number() OVER (PARTITION BY floor({C} / 1000) ORDER BY {C}) AS rank
      FROM customer WHERE {clientkey(C)} NOT IN (SELECT client_pass FROM rent_orders)) f
CROSS JOIN (VALUES (0), (1)) i(i)
JOIN (SELECT {carkey(K)} AS car_reg_num, CAST(floor({K} / 1000) AS BIGINT) AS block,
             row_number() OVER (PARTITION BY floor({K} / 1000) ORDER BY {K}) AS rank
      FROM part WHERE {carkey(K)} NOT IN (SELECT car_reg_num FROM rent_orders)) g
  ON g.block = f.block AND g.rank = f.rank + i.i""",
    "ofc": "SELECT * FROM open_orders",
    "order_updates": f"""
SELECT id * 10 AS seq, rented_at + INTERVAL 1 DAY AS ts, id,
       CASE WHEN id % 2 = 0 THEN first_car END AS car_reg_num,
       CAST(NULL AS TIMESTAMP) AS rented_at,
       CASE WHEN id % 5 = 0 THEN returned_at - INTERVAL 9 DAY
            WHEN id % 5 < 3 THEN returned_at + INTERVAL 2 DAY END AS returned_at
FROM ofc
UNION ALL
SELECT id * 10 + 5, {q_add('rented_at', '0', '36')}, id,
       CASE WHEN id % 3 = 0 THEN first_car END,
       CASE WHEN id % 7 = 0 THEN {q_add('rented_at', '0', '-1')} END,
       CASE WHEN id % 2 = 1 THEN returned_at + INTERVAL 4 DAY END
FROM ofc
UNION ALL
SELECT id * 10 + 9, rented_at + INTERVAL 1 DAY, -id, CAST(NULL AS VARCHAR), CAST(NULL AS TIMESTAMP),
       returned_at + INTERVAL 1 DAY
FROM ofc""",
    "od1": """
SELECT id * 10 + 3 AS seq, rented_at + INTERVAL 1 DAY AS ts, CASE WHEN id % 4 <> 0 THEN id ELSE -id END AS id FROM rent_orders""",
    "order_deletes": """
SELECT * FROM od1
UNION ALL SELECT seq + 1, ts, id FROM od1
UNION ALL SELECT id * 10 + 5, rented_at + INTERVAL 1 DAY, -id FROM rent_orders""",
}

def _with(body: str, *names: str, table: dict = CMD) -> str:
    return with_adapter(body, *[(n, table[n]) for n in names])


def statements() -> dict[str, str]:
    out = {}
    out["add_cars"] = _with("""
SELECT reg_num, state_id, color, mark, type, price, tech_serv_date FROM cars
UNION ALL
SELECT reg_num, 1, color, mark, type, price, date_trunc('second', ts)
FROM car_added""", "car_adds", "car_added")
    out["add_cars_rejects"] = _with(f"""
SELECT seq, 'add_car' AS op, reg_num AS key, '{X.ERR_ADD_CAR}' AS err FROM car_adds
WHERE seq NOT IN (SELECT seq FROM car_added)""", "car_adds", "car_added")

    car_update_ok = """EXISTS (SELECT 1 FROM cars c WHERE c.reg_num = u.reg_num)
    AND (state_id IS NULL OR EXISTS (SELECT 1 FROM car_states s WHERE s.id = u.state_id))
    AND (color IS NULL OR length(color) <= 20) AND (mark IS NULL OR length(mark) <= 20)
    AND (type IS NULL OR length(type) <= 20) AND (price IS NULL OR abs(price) < 100000000)"""
    last = "arg_max({c}, seq) FILTER (WHERE {c} IS NOT NULL) AS {c}"
    cols = ["state_id", "color", "mark", "type", "price", "tech_serv_date"]
    out["update_cars"] = _with(f"""
SELECT c.reg_num, {', '.join(
        f'coalesce(g.{x}, c.{x}) AS {x}' if x in cols else f'c.{x}'
        for x in ['state_id', 'color', 'mark', 'type', 'price', 'tech_serv_date'])}
FROM cars c LEFT JOIN (
  SELECT reg_num, {', '.join(last.format(c=x) for x in cols)}
  FROM car_updates u WHERE {car_update_ok}
  GROUP BY reg_num) g ON g.reg_num = c.reg_num""", "cu1", "car_updates")
    out["update_cars_rejects"] = _with(f"""
SELECT seq, 'update_car' AS op, reg_num AS key, '{X.ERR_UPDATE_CAR}' AS err FROM car_updates u
WHERE NOT ({car_update_ok})""", "cu1", "car_updates")

    out["delete_cars"] = _with("""
SELECT c.reg_num, c.state_id, c.color, c.mark, c.type, c.price, c.tech_serv_date FROM cars c
WHERE c.reg_num NOT IN (SELECT reg_num FROM car_gone)""", "cd1", "car_deletes", "car_gone")
    out["delete_cars_rejects"] = _with(f"""
SELECT d.seq, 'del_car' AS op, d.reg_num AS key,
       CASE WHEN k.state_id = 2 THEN '{X.ERR_DEL_CAR_BUSY}' ELSE '{X.ERR_DEL_CAR}' END AS err
FROM car_deletes d LEFT JOIN cars k ON k.reg_num = d.reg_num
WHERE d.seq NOT IN (SELECT seq FROM car_gone)""", "cd1", "car_deletes", "car_gone")

    out["add_clients"] = _with("""
SELECT pass, name FROM clients
UNION ALL
SELECT pass, name
FROM client_added""", "client_adds", "client_added")
    out["add_clients_rejects"] = _with(f"""
SELECT seq, 'add_client' AS op, pass AS key, '{X.ERR_ADD_CLIENT}' AS err FROM client_adds
WHERE seq NOT IN (SELECT seq FROM client_added)""", "client_adds", "client_added")

    out["update_clients"] = _with("""
SELECT c.pass, coalesce(g.name, c.name) AS name
FROM clients c LEFT JOIN (
  SELECT pass, arg_max(name, seq) FILTER (WHERE name IS NOT NULL) AS name FROM client_updates u
  WHERE EXISTS (SELECT 1 FROM clients c WHERE c.pass = u.pass) AND (name IS NULL OR length(name) <= 40)
  GROUP BY pass) g ON g.pass = c.pass""", "cl1", "client_updates")
    out["update_clients_rejects"] = _with(f"""
SELECT seq, 'update_client' AS op, pass AS key, '{X.ERR_UPDATE_CLIENT}' AS err FROM client_updates u
WHERE NOT (EXISTS (SELECT 1 FROM clients c WHERE c.pass = u.pass) AND (name IS NULL OR length(name) <= 40))""",
                                          "cl1", "client_updates")

    out["delete_clients"] = _with("""
SELECT c.pass, c.name FROM clients c
WHERE NOT EXISTS (SELECT 1 FROM client_deletes d WHERE d.pass = c.pass
                  AND NOT EXISTS (SELECT 1 FROM rent_orders o WHERE o.client_pass = d.pass))""", "client_deletes")
    out["delete_clients_rejects"] = _with(f"""
SELECT seq, 'del_client' AS op, pass AS key, '{X.ERR_DEL_CLIENT}' AS err FROM client_deletes d
WHERE EXISTS (SELECT 1 FROM rent_orders o WHERE o.client_pass = d.pass)""", "client_deletes")

    total = q_money(f"{q_hi(q_micros('oa.returned_at', 'oa.ts'))} * {q_cents('c.price')}")
    # One call at a time, in seq order: the taken clients and cars are
    # carried as lists through a recursive CTE.
    take = "(c.valid AND NOT list_contains(r.tc, c.client_pass) AND NOT list_contains(r.tk, c.car_reg_num))"
    steps = (
        ("order_adds", CMD["order_adds"]),
        ("v", f"""
SELECT a.*, coalesce(price IS NOT NULL AND client_ok AND returned_at IS NOT NULL
                     AND NOT client_busy AND NOT car_busy AND abs(total_price) < 100000000, false) AS valid
FROM (SELECT oa.*, c.price,
             EXISTS (SELECT 1 FROM clients k WHERE k.pass = oa.client_pass) AS client_ok,
             EXISTS (SELECT 1 FROM rent_orders o WHERE o.client_pass = oa.client_pass) AS client_busy,
             EXISTS (SELECT 1 FROM rent_orders o WHERE o.car_reg_num = oa.car_reg_num) AS car_busy,
             {total} AS total_price
      FROM order_adds oa LEFT JOIN cars c ON c.reg_num = oa.car_reg_num) a"""),
        ("c", "SELECT row_number() OVER (ORDER BY seq) AS rn, seq, client_pass, car_reg_num, valid FROM v"),
        ("r", f"""
SELECT CAST(0 AS BIGINT) AS rn, CAST(NULL AS BIGINT) AS seq, CAST(NULL AS BOOLEAN) AS ok,
       CAST([] AS VARCHAR[]) AS tc, CAST([] AS VARCHAR[]) AS tk
UNION ALL
SELECT c.rn, c.seq, {take},
       CASE WHEN {take} THEN list_append(r.tc, c.client_pass) ELSE r.tc END,
       CASE WHEN {take} THEN list_append(r.tk, c.car_reg_num) ELSE r.tk END
FROM r JOIN c ON c.rn = r.rn + 1"""))
    new_id = f"CAST({P.ORDER_ID_OFFSET} + v.seq AS BIGINT)"
    out["add_orders"] = with_adapter(f"""
SELECT id, client_pass, car_reg_num, rented_at, returned_at, total_price FROM rent_orders
UNION ALL
SELECT {new_id}, v.client_pass, v.car_reg_num, v.ts, v.returned_at, CAST(v.total_price AS DECIMAL(10,2))
FROM v JOIN r ON r.seq = v.seq WHERE r.ok""", *steps, recursive=True)
    out["add_orders_log"] = with_adapter(f"""
SELECT v.seq AS id, {new_id} AS order_id, v.ts AS changed_at, v.client_pass, v.car_reg_num, v.ts AS rented_at,
       v.returned_at, '0' AS status, CAST(v.total_price AS DECIMAL(10,2)) AS total_price,
       '{X.NOTE_CREATED}' AS note, '{P.V_USER}' AS v_user
FROM v JOIN r ON r.seq = v.seq WHERE r.ok""", *steps, recursive=True)
    out["add_orders_rejects"] = with_adapter(f"""
SELECT v.seq, 'add_order' AS op, v.client_pass AS key, '{X.ERR_ADD_ORDER}' AS err
FROM v JOIN r ON r.seq = v.seq WHERE NOT r.ok""", *steps, recursive=True)

    out["close_orders"] = _with(f"""
SELECT CAST(d.seq AS BIGINT) AS id, o.id AS order_id, d.ts AS changed_at, o.client_pass, o.car_reg_num,
       o.rented_at, o.returned_at, '1' AS status, o.total_price, 'client returned a car.' AS note,
       '{P.V_USER}' AS v_user
FROM rent_orders o
JOIN (SELECT * FROM order_deletes x WHERE seq = (SELECT min(seq) FROM order_deletes y WHERE y.id = x.id)) d
  ON d.id = o.id""", "od1", "order_deletes")
    out["close_orders_table"] = _with("""
SELECT id, client_pass, car_reg_num, rented_at, returned_at, total_price FROM rent_orders
WHERE id NOT IN (SELECT id FROM order_deletes)""", "od1", "order_deletes")
    return out
