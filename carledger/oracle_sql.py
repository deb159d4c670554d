"""Second-engine SQL (DuckDB dialect) for every registered query.

Each statement rebuilds the fleet tables from the driver tables with the
same deterministic mapping as ``carledger.sources.driver_tables`` (as
CTEs, named so as not to clash with the driver's own ``orders`` view) and
then computes the query with plain SQL. Money uses the same integer
formulas (cents x microseconds, one exact division, half-away rounding).
"""

from __future__ import annotations

from decimal import Decimal

from carledger import params as P

DAY_US = 86_400_000_000

# ---------------------------------------------------------------- helpers


def q_ts(v: str) -> str:
    return f"TIMESTAMP '{v}'"


def q_micros(a: str, b: str) -> str:
    return f"date_diff('microsecond', {b}, {a})"


def q_hi(x: str) -> str:
    return f"CAST({x} AS HUGEINT)"


def q_cents(p: str) -> str:
    return f"CAST({p} * 100 AS HUGEINT)"


def q_round_ratio(n: str, d: str, scale: int = 2) -> str:
    k = 2 * 10 ** scale
    return (f"(CAST(sign({q_hi(n)}) AS HUGEINT) * ((abs({q_hi(n)}) * {k} + {q_hi(d)}) "
            f"// (2 * {q_hi(d)})))")


def q_round_ratio_up(n: str, d: str, scale: int = 2) -> str:
    """floor((n*k + d) / 2d), exact for negative n too."""
    k = 2 * 10 ** scale
    a, b = f"({q_hi(n)} * {k} + {q_hi(d)})", f"(2 * {q_hi(d)})"
    return f"(({a} - ((({a}) % {b}) + {b}) % {b}) // {b})"


def q_units(u: str, scale: int = 2) -> str:
    step = str(Decimal(1).scaleb(-scale))
    return f"CAST(CAST({u} AS DECIMAL(38,0)) * {step} AS DECIMAL(38,{scale}))"


def q_ratio_decimal(n: str, d: str, scale: int = 2) -> str:
    return f"(CASE WHEN {d} > 0 THEN {q_units(q_round_ratio(n, d, scale), scale)} END)"


def q_money(cents_micros: str, scale: int = 2) -> str:
    return q_units(q_round_ratio(cents_micros, str(DAY_US * 100), scale), scale)


def q_days(a: str, b: str) -> str:
    return f"({q_micros(a, b)} / {float(DAY_US)})"


def q_fmt17(ts: str) -> str:
    return f"strftime({ts}, '%d.%m.%y %H:%M:%S')"


def q_add(ts: str, days: str = "0", hours: str = "0") -> str:
    return f"({ts} + to_days(CAST({days} AS INTEGER)) + to_hours(CAST({hours} AS INTEGER)))"


def q_key(prefix: str, k: str) -> str:
    """A key of 10 characters: prefix and hexadecimal digits, or an error."""
    digits = 10 - len(prefix)
    return (f"(CASE WHEN ({k}) BETWEEN 0 AND {16 ** digits - 1} THEN '{prefix}' || "
            f"lpad(to_hex(CAST({k} AS BIGINT)), {digits}, '0') WHEN ({k}) IS NOT NULL THEN error('key too long') END)")


# ------------------------------------------------------------- adapter CTEs

LINE_ORDER = ("l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_shipdate, "
              "l_returnflag, l_linestatus, l_discount, l_tax")

ADAPTER = {
    "cars": f"""
SELECT {q_key('C', 'p_partkey')} AS reg_num,
       CAST(p_partkey % 3 + 1 AS INTEGER) AS state_id,
       split_part(p_name, ' ', 1) AS color,
       p_brand AS mark,
       p_type AS type,
       CAST(p_retailprice AS DECIMAL(10,2)) AS price,
       {q_add(q_ts('1995-01-01 00:00:00'), 'p_partkey % 60')} AS tech_serv_date
FROM part""",
    "clients": f"""
SELECT {q_key('', 'c_custkey')} AS pass, c_name AS name FROM customer""",
    "car_states": """
SELECT * FROM (VALUES (1, 'waiting'), (2, 'rented'), (3, 'onserving')) AS t(id, state)""",
    "rh_seq": f"""
SELECT l.l_orderkey, l.l_partkey, l.l_extendedprice, o.o_custkey, o.o_orderstatus, o.o_orderdate,
       row_number() OVER w AS seq,
       count(*) OVER (PARTITION BY l.l_orderkey) AS n,
       lag(l.l_partkey) OVER w AS prev_partkey
FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
WINDOW w AS (PARTITION BY l.l_orderkey ORDER BY {LINE_ORDER})""",
    "rh_cols": f"""
SELECT CAST(l_orderkey AS BIGINT) * 1000000 + CASE WHEN seq < 1000000 THEN seq ELSE error('too many lines') END AS id,
       CAST(l_orderkey AS BIGINT) AS order_id,
       seq,
       {q_add('o_orderdate', '0', 'seq - 1')} AS changed_at,
       {q_key('', 'CASE WHEN l_orderkey % 50 = 0 AND seq >= 4 THEN greatest(o_custkey - 1, 0) ELSE o_custkey END')}
           AS client_pass,
       {q_key('C', 'CASE WHEN seq % 2 = 0 THEN prev_partkey ELSE l_partkey END')} AS car_reg_num,
       {q_add('o_orderdate', 'CASE WHEN seq % 5 = 0 THEN -1 ELSE 0 END')} AS rented_at,
       {q_add('o_orderdate', 'CASE WHEN seq % 4 = 0 THEN seq - 1 ELSE seq END', '3 * (l_orderkey % 8)')}
           AS returned_at,
       CASE WHEN seq = n AND o_orderstatus <> 'O' THEN '1' ELSE '0' END AS status,
       CAST(l_extendedprice AS DECIMAL(10,2)) AS total_price
FROM rh_seq""",
    "rent_history": """
SELECT id, order_id, changed_at, client_pass, car_reg_num, rented_at, returned_at, status, total_price,
       CASE WHEN seq = 1 THEN 'order was created.'
            WHEN status = '1' THEN 'client returned a car.'
            WHEN lag(car_reg_num) OVER w <> car_reg_num THEN 'client changed a car.'
            WHEN lag(returned_at) OVER w <> returned_at THEN 'client renewed a car.'
            WHEN lag(client_pass) OVER w <> client_pass THEN 'client was changed.'
       END AS note,
       'LOADER' AS v_user
FROM rh_cols
WINDOW w AS (PARTITION BY order_id ORDER BY seq)""",
    "open_orders": """
SELECT order_id AS id,
       arg_max(client_pass, id) AS client_pass,
       arg_max(car_reg_num, id) AS car_reg_num,
       arg_max(rented_at, id) AS rented_at,
       arg_max(returned_at, id) AS returned_at,
       arg_max(total_price, id) AS total_price,
       arg_min(car_reg_num, id) AS first_car
FROM rent_history GROUP BY order_id HAVING max(status) = '0'""",
    "rent_orders": """
SELECT id, client_pass, car_reg_num, rented_at, returned_at, total_price FROM open_orders""",
}


def with_adapter(body: str, *extra: tuple[str, str], recursive: bool = False) -> str:
    """``WITH <adapter CTEs>, <extra CTEs> <body>``; DuckDB drops unused CTEs."""
    ctes = list(ADAPTER.items()) + list(extra)
    head = "WITH RECURSIVE " if recursive else "WITH "
    return head + ",\n".join(f"{n} AS ({s})" for n, s in ctes) + "\n" + body


# ------------------------------------------------------------------ reports

SPANS = ("spans", """
SELECT s.order_id, s.client_pass, s.car_reg_num, s.rented_at, s.returned_at, c.price, c.tech_serv_date,
       date_diff('microsecond', s.rented_at, s.returned_at) AS span_micros
FROM (SELECT order_id, client_pass, car_reg_num, min(rented_at) AS rented_at, max(returned_at) AS returned_at
      FROM rent_history GROUP BY order_id, client_pass, car_reg_num) s
JOIN cars c ON c.reg_num = s.car_reg_num""")


def _reports() -> dict[str, str]:
    out = {}
    out["orders_history_export"] = with_adapter(f"""
SELECT id, order_id AS "order id", {q_fmt17('changed_at')} AS "changed at", client_pass AS client,
       car_reg_num AS "reg number of car", {q_fmt17('rented_at')} AS "rented at",
       {q_fmt17('returned_at')} AS "returned at",
       CASE WHEN status = '1' THEN 'returned' WHEN status = '0' THEN 'rented' END AS status,
       total_price AS total, note, v_user
FROM rent_history ORDER BY rented_at, id""")
    rev6 = q_money(f"{q_hi('span_micros')} * {q_cents('price')}", 6)
    out["cars_history_export"] = with_adapter(f"""
SELECT car_reg_num, order_id, client_pass, {q_fmt17('rented_at')} AS rented_at,
       {q_fmt17('returned_at')} AS returned_at, {rev6} AS revenue
FROM spans ORDER BY order_id, client_pass, car_reg_num""", SPANS)
    out["cars_rents"] = with_adapter(f"""
SELECT car_reg_num, order_id, client_pass, rented_at, returned_at,
       span_micros / {float(DAY_US)} AS rented_time, {rev6} AS revenue
FROM spans""", SPANS)
    as_of = q_ts(P.AS_OF)
    out["cars_report"] = with_adapter(f"""
SELECT car_reg_num AS reg_num,
       count(DISTINCT order_id) AS orders_num,
       count(DISTINCT client_pass) AS clients_num,
       {q_money(f"sum({q_hi('span_micros')} * {q_cents('price')})")} AS total_revenue,
       {q_ratio_decimal("sum(span_micros)", str(DAY_US))} AS total_rented_time,
       {q_ratio_decimal(q_micros(as_of, 'tech_serv_date'), str(DAY_US))} AS days_since_service
FROM spans GROUP BY car_reg_num, tech_serv_date""", SPANS)
    out["orders_changes"] = with_adapter(f"""
SELECT order_id, count(*) AS changed_times, count(DISTINCT car_reg_num) AS used_cars,
       {q_days('max(returned_at)', 'min(returned_at)')} AS renews_on,
       CASE WHEN max(status) = '1' THEN 'closed' WHEN max(status) = '0' THEN 'open' END AS status
FROM rent_history GROUP BY order_id""")
    out["orders_changes_report"] = with_adapter(f"""
SELECT a.distinct_orders + b.open_orders AS total_orders, a.distinct_orders, b.open_orders,
       {q_ratio_decimal('a.sum_changes', 'a.distinct_orders')} AS avg_changes,
       {q_ratio_decimal('a.sum_cars', 'a.distinct_orders')} AS avg_cars,
       {q_ratio_decimal('a.sum_renew', f'a.n_renew * {DAY_US}')} AS avg_renew,
       a.min_price,
       {q_ratio_decimal(q_cents('a.closed_sum'), 'a.n_closed * 100')} AS avg_price,
       a.max_price
FROM (SELECT count(*) AS distinct_orders, sum(n) AS sum_changes, sum(cars) AS sum_cars,
             sum(CASE WHEN renew > 0 THEN renew END) AS sum_renew,
             count(CASE WHEN renew > 0 THEN 1 END) AS n_renew,
             sum(closed_n) AS n_closed, sum(closed_sum) AS closed_sum,
             min(closed_min) AS min_price, max(closed_max) AS max_price
      FROM (SELECT order_id, count(*) AS n, count(DISTINCT car_reg_num) AS cars,
                   {q_micros('max(returned_at)', 'min(returned_at)')} AS renew,
                   count(CASE WHEN status = '1' THEN 1 END) AS closed_n,
                   sum(CASE WHEN status = '1' THEN total_price END) AS closed_sum,
                   min(CASE WHEN status = '1' THEN total_price END) AS closed_min,
                   max(CASE WHEN status = '1' THEN total_price END) AS closed_max
            FROM rent_history GROUP BY order_id) po) a,
     (SELECT count(*) AS open_orders FROM rent_orders) b""")
    out["fin_report"] = with_adapter(f"""
SELECT {q_ts(P.FIN_START)} AS start_ts, {q_ts(P.FIN_END)} AS end_ts,
       CAST(sum(total_price) AS DECIMAL(38,2)) AS revenue
FROM rent_history
WHERE status = '1' AND returned_at BETWEEN {q_ts(P.FIN_START)} AND {q_ts(P.FIN_END)}""")
    out["client_report"] = with_adapter("""
SELECT client_pass, string_agg(DISTINCT car_reg_num, ', ' ORDER BY car_reg_num) AS car_list,
       CAST(count(*) * sum(CASE WHEN status = '1' THEN total_price END) AS DECIMAL(38,2)) AS revenue,
       CAST(sum(CASE WHEN status = '1' THEN total_price END) AS DECIMAL(38,2)) AS closed_revenue
FROM rent_history GROUP BY client_pass
HAVING count(CASE WHEN status = '1' THEN 1 END) > 0""")
    out["autopark_status"] = with_adapter("""
SELECT g.state_id, s.state, g.num
FROM (SELECT state_id, count(*) AS num FROM cars GROUP BY state_id) g
LEFT JOIN car_states s ON s.id = g.state_id""")
    find = """
SELECT c.reg_num, c.state_id, s.state, c.color, c.type, c.mark, c.price
FROM cars c LEFT JOIN car_states s ON s.id = c.state_id WHERE {where}"""
    out["find_car_default"] = with_adapter(find.format(where="c.state_id = 1"))
    out["find_car_by_type"] = with_adapter(find.format(
        where=f"c.state_id = 1 AND c.type = '{P.FIND_TYPE}'"))
    out["find_car_any_state"] = with_adapter(find.format(
        where=f"c.type = '{P.FIND_TYPE}' AND c.color = '{P.FIND_COLOR}'"))
    out["list_cars"] = with_adapter("""
SELECT c.reg_num, c.state_id, s.state, c.color, c.mark, c.type, c.price, c.tech_serv_date
FROM cars c LEFT JOIN car_states s ON s.id = c.state_id""")
    out["list_clients"] = with_adapter("SELECT pass, name FROM clients")
    out["list_orders"] = with_adapter("""
SELECT id, client_pass, car_reg_num, rented_at, returned_at, total_price FROM rent_orders ORDER BY id""")
    return out


def q_num_text(x: str) -> str:
    s = f"CAST({x} AS VARCHAR)"
    s = f"regexp_replace({s}, '(\\.[0-9]*?)0+$', '\\1')"
    s = f"regexp_replace({s}, '\\.$', '')"
    return f"regexp_replace({s}, '^(-?)0\\.', '\\1.')"


def q_cat(*parts: str) -> str:
    return "concat(" + ", ".join(parts) + ")"


def _lines() -> dict[str, str]:
    rep = _reports()
    out = {}

    def over(name: str) -> str:
        body = rep[name]
        i = body.rindex("\nSELECT")
        return body[:i] + f",\nrep AS ({body[i + 1:]})\n"

    n = q_num_text
    out["cars_report_lines"] = over("cars_report") + "SELECT reg_num, " + q_cat(
        "'Reg num '", "reg_num", "': '", n("orders_num"), "' orders, '", n("clients_num"),
        "' clients, revenue '", n("total_revenue"), "' P, '", n("total_rented_time"), "' days in rent, '",
        n("days_since_service"), "' from last serving'") + " AS line FROM rep"
    out["client_report_lines"] = over("client_report") + "SELECT client_pass, 0 AS line_no, " + q_cat(
        "'Client: '", "client_pass", "', used cars: '", "car_list") + " AS line FROM rep UNION ALL " + \
        "SELECT client_pass, 1, " + q_cat("'  Revenue: '", n("revenue")) + " FROM rep"
    labels = [("Total orders: ", "total_orders"), ("Open orders: ", "open_orders"),
              ("Avg changing of order: ", "avg_changes"), ("Avg number of usage cars: ", "avg_cars"),
              ("Avg renew time (in days): ", "avg_renew")]
    parts = [f"SELECT {i} AS line_no, " + q_cat(f"'{t}'", f"coalesce({n(c)}, '')") + " AS line FROM rep"
             for i, (t, c) in enumerate(labels)]
    parts.append("SELECT 5, " + q_cat("'Revenue by order(min, avg, max): '", f"coalesce({n('min_price')}, '')",
                                      "' '", f"coalesce({n('avg_price')}, '')", "' '",
                                      f"coalesce({n('max_price')}, '')") + " FROM rep")
    out["orders_changes_report_lines"] = over("orders_changes_report") + " UNION ALL ".join(parts)
    out["fin_report_lines"] = over("fin_report") + "SELECT " + q_cat(
        "'Fin report for '", q_fmt17("start_ts"), "' - '", q_fmt17("end_ts"), "': '",
        f"coalesce({n('revenue')}, '')", "' P'") + " AS line FROM rep"
    out["find_car_lines"] = over("find_car_by_type") + "SELECT reg_num, " + q_cat(
        "'['", "coalesce(state, '')", "']'", "reg_num", "': '", "color", "', '", "type", "', '", "mark",
        "' - '", n("price"), "'P'") + " AS line FROM rep"
    out["list_cars_lines"] = over("list_cars") + "SELECT reg_num, " + q_cat(
        "'['", "coalesce(state, '')", "']'", "reg_num", "': '", "color", "', '", "mark", "', '", "type",
        "' - \ufffd'", n("price")) + " AS line FROM rep"
    out["list_clients_lines"] = with_adapter("SELECT pass, pass || ': ' || name AS line FROM clients")
    ts = "'%d.%m.%y %H:%M:%S,%f'"
    out["list_orders_lines"] = with_adapter("SELECT id, " + q_cat(
        "'['", "CAST(id AS VARCHAR)", "'], ('", "client_pass", "':'", "car_reg_num", "'), ('",
        f"strftime(rented_at, {ts})", "' - '", f"strftime(returned_at, {ts})", "') - \ufffd'",
        n("total_price")) + " AS line FROM rent_orders")
    out["autopark_status_lines"] = over("autopark_status") + "SELECT state_id, " + q_cat(
        "'['", "coalesce(state, '')", "'] '", n("num")) + " AS line FROM rep"
    return out


def oracle_sql() -> dict[str, str]:
    out = {}
    out.update(_reports())
    out.update(_lines())
    from carledger import oracle_sql_more
    out.update(oracle_sql_more.statements())
    return out
