"""Second-engine SQL of calls applied one by one (the journal of mixed calls
and the order updates).

A call waits for the calls before it that touch a key it touches: its car,
client and order, and every car and the client that its order may have by
then. Its level is the longest chain of such calls before it; calls of one
level touch no common key, so a step of the recursion applies a whole level.
"""

from __future__ import annotations

from carledger import params as P
from carledger.functions import fixed as X
from carledger.oracle_sql import DAY_US, q_add, q_cents, q_hi, q_micros, q_round_ratio, with_adapter
from carledger.oracle_sql_commands import CMD, at, carkey, clientkey, newkey

ARGS = ("seq", "ts", "verb", "reg_num", "color", "mark", "type", "price", "state_id", "tech_serv_date", "pass", "name", "id",
        "rented_at", "returned_at")
_TYPES = dict(zip(ARGS, ("BIGINT", "TIMESTAMP", "VARCHAR", "VARCHAR", "VARCHAR", "VARCHAR", "VARCHAR", "DECIMAL(10,2)", "INTEGER", "TIMESTAMP",
                         "VARCHAR", "VARCHAR", "BIGINT", "TIMESTAMP", "TIMESTAMP")))


def calls(source: str, seq: str, ts: str, verb: str, **args: str) -> str:
    args |= {"seq": seq, "ts": ts, "verb": f"'{verb}'"}
    if "pass_" in args:
        args["pass"] = args.pop("pass_")
    return "SELECT " + ", ".join(f"CAST({args.get(a, 'NULL')} AS {_TYPES[a]}) AS {a}" for a in ARGS) + f" FROM {source}"


def turn(k: str, kind: int, i: int) -> str:
    return f"(CAST({k} AS BIGINT) * 3 + {kind}) * 16 + {i}"


def journal() -> str:
    k, b = "p_partkey", "c_custkey"
    t, u, o = at(f"{k} % 24"), at(f"{b} % 24"), "rented_at + INTERVAL 1 DAY"
    price = "CAST(p_retailprice AS DECIMAL(10,2))"
    near = lambda d: f"{b} - {b} % 8 + ({b} + {d}) % 8"
    mine = f"{P.ORDER_ID_OFFSET} + ({turn(b, 1, 2)})"
    rows = [
        calls("part", turn(k, 0, 0), t, "add_car", reg_num=newkey("N", k), color="split_part(p_name, ' ', 2)", mark="p_brand", type="p_type",
              price=f"CASE WHEN {k} % 11 <> 0 THEN {price} + 100 END"),
        calls("part", turn(k, 0, 1), t, "update_car", reg_num=carkey(k), price=f"CASE WHEN {k} % 2 = 0 THEN {price} - 50 END",
              state_id=f"CASE WHEN {k} % 8 = 3 THEN 9 WHEN {k} % 4 = 1 THEN 1 WHEN {k} % 4 = 2 THEN 3 END",
              color=f"CASE WHEN {k} % 3 = 0 THEN 'mixed' END"),
        calls("part", turn(k, 0, 8), t, "del_car", reg_num=f"CASE WHEN {k} % 3 = 0 THEN {carkey(k)} ELSE {newkey('N', k)} END"),
        calls("customer", turn(b, 1, 0), u, "add_client", pass_=newkey("N", b), name=f"CASE WHEN {b} % 9 <> 0 THEN c_name END"),
        calls("customer", turn(b, 1, 1), u, "update_client", pass_=clientkey(b), name=f"CASE WHEN {b} % 2 = 0 THEN upper(c_name) END"),
        calls("customer", turn(b, 1, 2), u, "add_order", pass_=newkey("N", b), reg_num=newkey("N", f"{b} - {b} % 2"),
              returned_at=f"CASE WHEN {b} % 13 <> 0 THEN {q_add(u, f'{b} % 7 + 1', f'({b} % 4) * 6')} END"),
        calls("customer", turn(b, 1, 3), u, "add_order", pass_=clientkey(b), reg_num=newkey("N", near(3)), returned_at=q_add(u, "2")),
        calls("customer", turn(b, 1, 4), u, "update_order", id=mine, reg_num=newkey("N", near(5)), returned_at=q_add(u, f"{b} % 5 + 1")),
        calls("customer", turn(b, 1, 5), u, "del_order", id=f"CASE WHEN {b} % 3 <> 0 THEN {mine} ELSE -{b} END"),
        calls("customer", turn(b, 1, 6), u, "del_client", pass_=f"CASE WHEN {b} % 4 = 0 THEN {clientkey(b)} ELSE {newkey('N', b)} END"),
        calls("open_orders", turn("id", 2, 0), o, "update_order", id="id", reg_num="CASE WHEN id % 2 = 0 THEN first_car END",
              returned_at="returned_at + INTERVAL 2 DAY"),
        calls("open_orders", turn("id", 2, 1), o, "update_order", id="id",
              returned_at=q_add("returned_at", "CASE WHEN id % 5 = 0 THEN -9 ELSE -1 END")),
        calls("open_orders", turn("id", 2, 2), o, "del_order", id="CASE WHEN id % 3 <> 0 THEN id ELSE -id END"),
    ]
    return "\nUNION ALL ".join(rows)


UPDATES = calls("order_updates", "seq", "ts", "update_order", id="id", reg_num="car_reg_num", rented_at="rented_at", returned_at="returned_at")

FITS = ("(coalesce(length(color) <= 20, true) AND coalesce(length(mark) <= 20, true) AND coalesce(length(type) <= 20, true) "
        "AND coalesce(abs(price) < 100000000, true))")

PLAN = {
    "jc": f"""
SELECT *, CASE verb WHEN 'add_order' THEN {P.ORDER_ID_OFFSET} + seq WHEN 'update_order' THEN id WHEN 'del_order' THEN id END AS oid,
       CASE WHEN verb IN ('add_car', 'update_car', 'del_car', 'add_order', 'update_order') THEN reg_num END AS car,
       CASE WHEN verb IN ('add_client', 'update_client', 'del_client', 'add_order') THEN pass END AS client,
       coalesce(CASE verb WHEN 'add_car' THEN length(reg_num) <= 10 AND color IS NOT NULL AND mark IS NOT NULL AND type IS NOT NULL
                                          AND price IS NOT NULL AND {FITS}
                          WHEN 'update_car' THEN (state_id IS NULL OR state_id IN (SELECT id FROM car_states)) AND {FITS}
                          WHEN 'add_client' THEN length(pass) <= 10 AND length(name) <= 40
                          WHEN 'update_client' THEN name IS NULL OR length(name) <= 40
                          WHEN 'add_order' THEN returned_at IS NOT NULL
                          WHEN 'update_order' THEN returned_at IS NULL OR returned_at >= ts ELSE true END, false) AS own
FROM jr""",
    "may_have": """
SELECT id AS oid, 'k' || car_reg_num AS node, -1 AS since FROM rent_orders
UNION ALL SELECT id, 'c' || client_pass, -1 FROM rent_orders
UNION ALL SELECT oid, 'k' || car, seq FROM jc WHERE verb IN ('add_order', 'update_order') AND car IS NOT NULL
UNION ALL SELECT oid, 'c' || client, seq FROM jc WHERE verb = 'add_order' AND client IS NOT NULL""",
    "touch": """
SELECT seq, 'k' || car AS node FROM jc WHERE car IS NOT NULL
UNION SELECT seq, 'c' || client FROM jc WHERE client IS NOT NULL
UNION SELECT seq, 'o' || CAST(oid AS VARCHAR) FROM jc WHERE oid IS NOT NULL
UNION SELECT j.seq, m.node FROM jc j JOIN may_have m ON m.oid = j.oid AND m.since < j.seq WHERE j.verb IN ('update_order', 'del_order')""",
    "waits": """
SELECT DISTINCT prev, seq FROM (SELECT seq, lag(seq) OVER (PARTITION BY node ORDER BY seq) AS prev FROM touch) t WHERE prev IS NOT NULL""",
    "lv(seq, lv) USING KEY (seq)": """
SELECT seq, CAST(0 AS BIGINT) FROM jc
UNION SELECT w.seq, max(lv.lv) + 1 FROM lv JOIN waits w ON w.prev = lv.seq GROUP BY w.seq""",
    "jl": "SELECT jc.*, lv.lv FROM jc JOIN lv ON lv.seq = jc.seq",
}

_COLS = {"alive": "BOOLEAN", "car": "VARCHAR", "client": "VARCHAR", "color": "VARCHAR", "mark": "VARCHAR", "type": "VARCHAR",
         "price": "DECIMAL(10,2)", "state": "INTEGER", "served": "TIMESTAMP", "name": "VARCHAR", "rented": "TIMESTAMP",
         "returned": "TIMESTAMP", "tot": "HUGEINT", "err": "VARCHAR", "prev_car": "VARCHAR", "prev_ret": "TIMESTAMP"}


def _row(kind: str, key: str, **cols: str) -> str:
    return f"SELECT '{kind}' AS kind, {key} AS k, " + ", ".join(f"CAST({cols.get(c, 'NULL')} AS {t}) AS {c}" for c, t in _COLS.items())


def _fold() -> str:
    add = q_round_ratio(f"{q_hi(q_micros('j.returned_at', 'j.ts'))} * {q_cents('kc.price')}", str(DAY_US), 0)
    new = "CASE WHEN j.reg_num IS NULL THEN ko.price ELSE kc.price END"
    end = "coalesce(j.returned_at, o.returned)"
    num = (f"(o.tot * {DAY_US} + {q_hi(q_micros('o.returned', 'j.ts'))} * ({q_cents(new)} - {q_cents('ko.price')})"
           f" + {q_hi(q_micros(end, 'o.returned'))} * {q_cents(new)})")
    upd = q_round_ratio(num, str(DAY_US), 0)
    err = f"""CASE j.verb
  WHEN 'add_car' THEN CASE WHEN NOT j.own OR kc.k IS NOT NULL THEN '{X.ERR_ADD_CAR}' END
  WHEN 'update_car' THEN CASE WHEN NOT j.own OR kc.k IS NULL THEN '{X.ERR_UPDATE_CAR}' END
  WHEN 'del_car' THEN CASE WHEN kc.state = 2 THEN '{X.ERR_DEL_CAR_BUSY}' WHEN kc.k IS NULL OR hk.n > 0 THEN '{X.ERR_DEL_CAR}' END
  WHEN 'add_client' THEN CASE WHEN NOT j.own OR cc.k IS NOT NULL THEN '{X.ERR_ADD_CLIENT}' END
  WHEN 'update_client' THEN CASE WHEN NOT j.own OR cc.k IS NULL THEN '{X.ERR_UPDATE_CLIENT}' END
  WHEN 'del_client' THEN CASE WHEN hc.n > 0 THEN '{X.ERR_DEL_CLIENT}' END
  WHEN 'add_order' THEN CASE WHEN NOT j.own OR kc.k IS NULL OR cc.k IS NULL OR o.k IS NOT NULL OR hk.n > 0 OR hc.n > 0
                                  OR abs({add}) >= 10000000000 THEN '{X.ERR_ADD_ORDER}' END
  WHEN 'update_order' THEN CASE WHEN NOT j.own OR o.k IS NULL OR ko.k IS NULL OR (j.reg_num IS NOT NULL AND kc.k IS NULL)
                                     OR coalesce(hk.n, 0) - CASE WHEN o.car = j.reg_num THEN 1 ELSE 0 END > 0
                                     OR abs({upd}) >= 10000000000 THEN '{X.ERR_UPDATE_ORDER}' END END"""
    step = f"""
SELECT j.seq, j.verb, j.ts, j.oid, {err} AS err, j.verb NOT LIKE 'del%' AS alive,
       CASE split_part(j.verb, '_', 2) WHEN 'car' THEN 'k' WHEN 'client' THEN 'c' ELSE 'o' END AS kind,
       CASE split_part(j.verb, '_', 2) WHEN 'car' THEN j.reg_num WHEN 'client' THEN j.pass ELSE CAST(j.oid AS VARCHAR) END AS k,
       CASE j.verb WHEN 'add_order' THEN j.reg_num WHEN 'update_order' THEN coalesce(j.reg_num, o.car) ELSE o.car END AS car,
       CASE j.verb WHEN 'add_order' THEN j.pass ELSE o.client END AS client,
       coalesce(j.color, kc.color) AS color, coalesce(j.mark, kc.mark) AS mark, coalesce(j.type, kc.type) AS type,
       coalesce(j.price, kc.price) AS price, CASE j.verb WHEN 'add_car' THEN 1 ELSE coalesce(j.state_id, kc.state) END AS state,
       CASE j.verb WHEN 'add_car' THEN date_trunc('second', j.ts) ELSE coalesce(j.tech_serv_date, kc.served) END AS served,
       coalesce(j.name, cc.name) AS name,
       CASE j.verb WHEN 'add_order' THEN j.ts WHEN 'update_order' THEN coalesce(j.rented_at, o.rented) ELSE o.rented END AS rented,
       CASE j.verb WHEN 'add_order' THEN j.returned_at WHEN 'update_order' THEN {end} ELSE o.returned END AS returned,
       CASE j.verb WHEN 'add_order' THEN {add} WHEN 'update_order' THEN {upd} ELSE o.tot END AS tot,
       o.car AS prev_car, o.returned AS prev_ret, o.k IS NOT NULL AS had
FROM (SELECT CAST(tot AS BIGINT) AS lv FROM r WHERE kind = 't') n
JOIN jl j ON j.lv = n.lv
LEFT JOIN (SELECT * FROM recurring.r WHERE kind = 'k' AND alive) kc ON kc.k = j.car
LEFT JOIN (SELECT * FROM recurring.r WHERE kind = 'c' AND alive) cc ON cc.k = j.client
LEFT JOIN (SELECT * FROM recurring.r WHERE kind = 'o' AND alive) o ON o.k = CAST(j.oid AS VARCHAR)
LEFT JOIN (SELECT * FROM recurring.r WHERE kind = 'k' AND alive) ko ON ko.k = o.car
LEFT JOIN (SELECT car, count(*) AS n FROM recurring.r WHERE kind = 'o' AND alive GROUP BY car) hk ON hk.car = j.car
LEFT JOIN (SELECT client, count(*) AS n FROM recurring.r WHERE kind = 'o' AND alive GROUP BY client) hc ON hc.client = j.client"""
    cols = ", ".join(f"CAST(x.{c} AS {t})" for c, t in _COLS.items())
    # 's': the outcome of a call (alive: a row of the log), else the entity it changes.
    out = cols.replace("CAST(x.alive AS BOOLEAN)", "CASE WHEN w.s THEN x.err IS NULL AND x.kind = 'o' AND (x.verb <> 'del_order' OR x.had) ELSE x.alive END")
    return ("SELECT * FROM (" + _row("o", "CAST(id AS VARCHAR)", alive="true", car="car_reg_num", client="client_pass", rented="rented_at", returned="returned_at",
                 tot="total_price * 100") + " FROM rent_orders\nUNION ALL "
            + _row("k", "reg_num", alive="true", color="color", mark="mark", type="type", price="price", state="state_id",
                   served="tech_serv_date") + " FROM cars\nUNION ALL "
            + _row("c", "pass", alive="true", name="name") + " FROM clients\nUNION ALL " + _row("t", "''", tot="0") + f""") start
UNION
SELECT * FROM (SELECT CASE WHEN w.s THEN 's' ELSE x.kind END, CASE WHEN w.s THEN CAST(x.seq AS VARCHAR) ELSE x.k END, {out}
FROM ({step}) x JOIN (VALUES (true), (false)) w(s) ON w.s OR (x.err IS NULL AND (x.alive OR x.kind <> 'o' OR x.had))
UNION ALL """ + _row("t", "''", tot="r.tot + 1") + " FROM r WHERE r.kind = 't' AND r.tot < (SELECT max(lv) FROM jl)) step")


def _run(body: str, *source: tuple[str, str]) -> str:
    return with_adapter(body, *source, *PLAN.items(), (f"r(kind, k, {', '.join(_COLS)}) USING KEY (kind, k)", _fold()), recursive=True)


TOTAL = "CAST(CAST(r.tot AS DECIMAL(38,0)) * 0.01 AS DECIMAL(10,2))"
ORDERS = f"""
SELECT CAST(r.k AS BIGINT) AS id, r.client AS client_pass, r.car AS car_reg_num, r.rented AS rented_at, r.returned AS returned_at,
       {TOTAL} AS total_price
FROM r WHERE r.kind = 'o' AND r.alive"""
LOG = f"""
SELECT j.seq AS id, CAST(j.oid AS BIGINT) AS order_id, j.ts AS changed_at, r.client AS client_pass, r.car AS car_reg_num, r.rented AS rented_at,
       r.returned AS returned_at, CASE j.verb WHEN 'del_order' THEN '1' ELSE '0' END AS status, {TOTAL} AS total_price,
       CASE j.verb WHEN 'add_order' THEN '{X.NOTE_CREATED}' WHEN 'del_order' THEN '{X.NOTE_RETURNED}'
                   ELSE CASE WHEN r.prev_car <> r.car THEN '{X.NOTE_CAR_CHANGED}' WHEN r.prev_ret <> r.returned THEN '{X.NOTE_RENEWED}' END
       END AS note, '{P.V_USER}' AS v_user
FROM r JOIN jc j ON r.k = CAST(j.seq AS VARCHAR) WHERE r.kind = 's' AND r.alive"""
REJECTS = """
SELECT j.seq, j.verb AS op, CASE WHEN j.client IS NOT NULL THEN j.client WHEN j.oid IS NOT NULL THEN CAST(j.oid AS VARCHAR) ELSE j.car END AS key,
       r.err
FROM r JOIN jc j ON r.k = CAST(j.seq AS VARCHAR) WHERE r.kind = 's' AND r.err IS NOT NULL"""


def statements() -> dict[str, str]:
    jr = ("jr", journal())
    upd = [("ofc", CMD["ofc"]), ("order_updates", CMD["order_updates"]), ("jr", UPDATES)]
    return {
        "apply_journal": _run(ORDERS, jr),
        "apply_journal_cars": _run("""
SELECT r.k AS reg_num, r.state AS state_id, r.color, r.mark, r.type, r.price, r.served AS tech_serv_date
FROM r WHERE r.kind = 'k' AND r.alive""", jr),
        "apply_journal_clients": _run("SELECT r.k AS pass, r.name FROM r WHERE r.kind = 'c' AND r.alive", jr),
        "apply_journal_log": _run(LOG, jr),
        "apply_journal_rejects": _run(REJECTS, jr),
        "update_orders": _run(ORDERS, *upd),
        "update_orders_log": _run(LOG, *upd),
        "update_orders_rejects": _run(REJECTS, *upd),
    }
