"""The same queries in DuckDB's SQL, worked out another way where there is one:
stock, queues and texts are folded step by step instead of by closed form."""

from __future__ import annotations

from tillroll.functions.text import SYLLABLES

_SYL = "[" + ", ".join(f"'{s}'" for s in SYLLABLES) + "]"


def _last(n: str) -> str:
    return f"({_SYL}[({n})//100%10+1] || {_SYL}[({n})//10%10+1] || {_SYL}[({n})%10+1])"


def _address(prefix: str, kind: str, n: str) -> str:
    return (
        f"'street1-{kind}-' || {n} AS {prefix}street1, 'street2-{kind}-' || {n} AS {prefix}street2, "
        f"'city-{kind}-' || {n} AS {prefix}city, ({n} % 100)::varchar AS {prefix}state, "
        f"lpad(({n} % 10000)::varchar, 4, '0') || '11111' AS {prefix}zip"
    )


# name -> (names it needs, body)
_PARTS: dict[str, tuple[list[str], str]] = {
    "item": ([], """SELECT p_partkey AS item, p_name AS item_name, p_retailprice::decimal(12,2) AS price
        FROM part WHERE p_partkey % 100 <> 99"""),
    "cust": ([], f"""SELECT c_custkey AS c, c_nationkey + 1 AS w, c_custkey % 10 + 1 AS d, c_name AS first,
        {_last('c_custkey % 20')} AS last, CASE WHEN c_custkey // 10 % 10 = 0 THEN 'BC' ELSE 'GC' END AS credit,
        lpad(c_custkey::varchar, 16, '0') AS phone, (c_custkey % 6) / 10000.0 AS discount,
        rpad('Customer ' || c_custkey || ' from warehouse ' || (c_nationkey + 1) || ', district ' || (c_custkey % 10 + 1), 500, '*') AS opening
        FROM customer"""),
    "wh": ([], f"""SELECT n_nationkey + 1 AS w, 'WHOUSE' || (n_nationkey + 1) AS w_name,
        {_address('w_', 'WAREHOUSE', '(n_nationkey + 1)')}, ((n_nationkey + 1) % 200) / 1000.0 AS w_tax FROM nation"""),
    "dist": ([], f"""SELECT n_nationkey + 1 AS w, i AS d, 'DISTR-' || i AS d_name,
        {_address('d_', 'DISTRICT', 'i')}, (i % 20) / 100.0 AS d_tax FROM nation, range(1, 11) t(i)"""),
    "req": (["cust"], """SELECT o_orderkey AS txn, epoch_ms(o_orderdate) AS ts, c, d, w
        FROM orders JOIN cust ON c = o_custkey"""),
    "ln": (["req"], """SELECT l_orderkey AS txn, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber,
          l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) - 1 AS line, l_partkey AS item,
        (l_quantity::int - 1) % 10 + 1 AS q, req.ts, req.c, req.d, req.w,
        CASE WHEN l_suppkey % 10 = 0 THEN s_nationkey + 1 ELSE req.w END AS sw
        FROM lineitem JOIN req ON txn = l_orderkey JOIN supplier ON s_suppkey = l_suppkey"""),
    "bad": (["ln", "item"], "SELECT DISTINCT txn FROM ln WHERE item NOT IN (SELECT item FROM item)"),
    "aln": (["ln", "bad"], "SELECT * FROM ln WHERE txn NOT IN (SELECT txn FROM bad)"),
    "pln": (["aln", "item"], "SELECT aln.*, item_name, price, price * q AS amount FROM aln JOIN item USING (item)"),
    "acc": (["req", "bad", "pln"], """SELECT req.*, coalesce(t.total, 0) AS total, coalesce(t.n, 0) AS n_lines
        FROM req LEFT JOIN (SELECT txn, sum(amount) AS total, count(*) AS n FROM pln GROUP BY txn) t USING (txn)
        WHERE txn NOT IN (SELECT txn FROM bad)"""),
    "num": (["acc"], "SELECT acc.*, count(*) OVER (PARTITION BY w, d ORDER BY ts, txn) AS order_id FROM acc"),
    "dlv": (["req"], """SELECT w * 1000000 + year(m) * 100 + month(m) AS txn, epoch_ms(m + INTERVAL 1 MONTH) AS ts,
        w, month(m) % 10 + 1 AS carrier
        FROM (SELECT DISTINCT w, date_trunc('month', make_timestamp(ts * 1000)) AS m FROM req)"""),
    "steps": (["acc", "dlv"], """SELECT *, row_number() OVER (PARTITION BY w, d ORDER BY ts, kind, txn) AS k FROM (
        SELECT w, d, ts, 0 AS kind, txn, NULL AS carrier FROM acc
        UNION ALL SELECT w, i AS d, ts, 1 AS kind, txn, carrier FROM dlv, range(1, 11) t(i))"""),
    "fifo": (["steps"], """SELECT w, d, ts, kind, txn, carrier, k, CASE WHEN kind = 0 THEN 1 ELSE 0 END AS arrived,
          0 AS done, NULL::bigint AS popped FROM steps WHERE k = 1
        UNION ALL
        SELECT s.w, s.d, s.ts, s.kind, s.txn, s.carrier, s.k,
          f.arrived + CASE WHEN s.kind = 0 THEN 1 ELSE 0 END,
          f.done + CASE WHEN s.kind = 1 AND f.arrived > f.done THEN 1 ELSE 0 END,
          CASE WHEN s.kind = 1 AND f.arrived > f.done THEN f.done + 1 END
        FROM fifo f JOIN steps s ON s.w = f.w AND s.d = f.d AND s.k = f.k + 1"""),
    "dd": (["fifo", "num"], """SELECT f.w, f.d, f.popped AS order_id, f.txn, f.ts, f.carrier, num.c, num.total
        FROM fifo f JOIN num ON num.w = f.w AND num.d = f.d AND num.order_id = f.popped"""),
    "pend": (["num", "dd"], """SELECT num.* FROM num
        WHERE NOT EXISTS (SELECT 1 FROM dd WHERE dd.w = num.w AND dd.d = num.d AND dd.order_id = num.order_id)"""),
    "mid": (["cust"], "SELECT w, d, last, list(c ORDER BY first, c)[count(*) // 2 + 1] AS c FROM cust GROUP BY ALL"),
    "midsql": (["cust"], "SELECT w, d, last, list(c ORDER BY first, c)[(count(*) + 1) // 2] AS c FROM cust GROUP BY ALL"),
    "payreq": (["cust"], f"""SELECT event_id AS txn, (epoch_us(ts) // 1000 - 1704067200000) * 80 + 788918400000 AS ts,
        value::decimal(12,2) AS amount, CASE WHEN event_id % 5 >= 3 THEN user_id END AS c,
        CASE WHEN event_id % 5 < 3 THEN {_last('user_id % 20')} END AS last, cust.d AS c_d, cust.w AS c_w, cust.d AS d,
        CASE WHEN event_id % 7 = 0 THEN cust.w % 25 + 1 ELSE cust.w END AS w
        FROM events JOIN cust ON cust.c = user_id WHERE event_type = 'purchase'"""),
    "pay": (["payreq", "mid"], """SELECT p.* EXCLUDE (c), coalesce(p.c, mid.c) AS c FROM payreq p
        LEFT JOIN mid ON mid.w = c_w AND mid.d = c_d AND mid.last = p.last"""),
    "paysql": (["payreq", "midsql"], """SELECT p.* EXCLUDE (c), coalesce(p.c, m.c) AS c FROM payreq p
        LEFT JOIN midsql m ON m.w = c_w AND m.d = c_d AND m.last = p.last"""),
    "chg": (["pay", "dd"], """SELECT c_w AS w, c_d AS d, c, ts, 2 AS kind, txn, -amount AS change FROM pay
        UNION ALL SELECT w, d, c, ts, 1, txn, total FROM dd"""),
    "bal": (["chg"], """SELECT *, -10 + sum(change) OVER (PARTITION BY w, d, c ORDER BY ts, kind, txn
        ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS balance FROM chg"""),
    "curbal": (["chg"], "SELECT w, d, c, -10 + sum(change) AS balance FROM chg GROUP BY ALL"),
    "mv": (["aln"], """SELECT sw AS stock_w, item, ts, txn, line, q, q AS taken, CASE WHEN sw = w THEN 'home' ELSE 'supply' END AS role, w FROM aln
        UNION ALL SELECT w, item, ts, txn, line, q, 0, 'look', w FROM aln WHERE sw <> w"""),
    "mvk": (["mv"], "SELECT *, row_number() OVER (PARTITION BY stock_w, item ORDER BY ts, txn, line) AS k FROM mv"),
    "st": (["mvk"], """SELECT mvk.*, (item % 90 + 10) - taken + CASE WHEN taken > 0 AND (item % 90 + 10) - taken < 10 THEN 91 ELSE 0 END AS level
        FROM mvk WHERE k = 1
        UNION ALL SELECT m.*, st.level - m.taken + CASE WHEN m.taken > 0 AND st.level - m.taken < 10 THEN 91 ELSE 0 END
        FROM st JOIN mvk m ON m.stock_w = st.stock_w AND m.item = st.item AND m.k = st.k + 1"""),
    "stk": ([], "SELECT n_nationkey + 1 AS w, p_partkey AS item, p_partkey % 90 + 10 AS quantity FROM part, nation"),
    "lev": (["st"], "SELECT stock_w, item, arg_max(level, k) AS level FROM st GROUP BY ALL"),
    "bcpay": (["pay", "cust"], """SELECT p.txn, p.c, p.c_w, p.c_d, opening,
        p.c::varchar || p.c_d || p.c_w || p.d || p.w || p.amount AS prefix,
        row_number() OVER (PARTITION BY p.c ORDER BY p.ts, p.txn) AS k
        FROM pay p JOIN cust ON cust.c = p.c WHERE credit = 'BC'"""),
    "txt": (["bcpay"], """SELECT txn, c, c_w, c_d, k, left(prefix || opening, 500) AS data FROM bcpay WHERE k = 1
        UNION ALL SELECT b.txn, b.c, b.c_w, b.c_d, b.k, left(b.prefix || txt.data, 500)
        FROM txt JOIN bcpay b ON b.c = txt.c AND b.k = txt.k + 1"""),
    "lastord": (["num"], "SELECT * FROM num n WHERE order_id = (SELECT max(order_id) FROM num m WHERE m.w = n.w AND m.d = n.d AND m.c = n.c)"),
    "state": (["lastord", "dd", "curbal"], """SELECT l.w, l.d, l.c, l.order_id, l.ts, l.txn, dd.carrier, dd.ts AS delivered,
        coalesce(b.balance, -10) AS balance FROM lastord l
        LEFT JOIN dd ON dd.w = l.w AND dd.d = l.d AND dd.order_id = l.order_id
        LEFT JOIN curbal b ON b.c = l.c AND b.w = l.w AND b.d = l.d"""),
    "rec": (["num"], "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY w, d ORDER BY order_id DESC) AS r FROM num) WHERE r <= 20"),
    "thr": (["dist"], "SELECT w, d, (w * 10 + d) % 11 + 10 AS threshold FROM dist"),
    "fan": (["acc", "aln"], "SELECT txn, w FROM acc UNION SELECT txn, sw FROM aln"),
    "decided": (["req", "bad"], "SELECT txn, ts, txn NOT IN (SELECT txn FROM bad) AS approved FROM req"),
    "shipped": (["num", "dd"], """SELECT num.txn, num.ts, dd.ts AS result FROM num
        LEFT JOIN dd ON dd.w = num.w AND dd.d = num.d AND dd.order_id = num.order_id"""),
    "bulk": (["mvk"], "SELECT * REPLACE (taken * 25 AS taken, q * 25 AS q) FROM mvk"),
    "bulkst": (["bulk"], """SELECT bulk.*, (item % 90 + 10) - taken + CASE WHEN role <> 'look' AND (item % 90 + 10) - taken < 10 THEN 91 ELSE 0 END AS level
        FROM bulk WHERE k = 1
        UNION ALL SELECT m.*, s.level - m.taken + CASE WHEN m.role <> 'look' AND s.level - m.taken < 10 THEN 91 ELSE 0 END
        FROM bulkst s JOIN bulk m ON m.stock_w = s.stock_w AND m.item = s.item AND m.k = s.k + 1"""),
    "allreq": (["req", "dlv", "payreq"], """SELECT 'neworder' AS type, 0 AS kind, txn, ts, w FROM req
        UNION ALL SELECT 'delivery', 1, txn, ts, w FROM dlv UNION ALL SELECT 'payment', 2, txn, ts, c_w FROM payreq"""),
    "gord": (["cust"], """SELECT w, d, c, row_number() OVER (PARTITION BY w, d ORDER BY c) AS order_id,
        count(*) OVER (PARTITION BY w, d) AS n FROM cust"""),
}


def _with(names: list[str], body: str) -> str:
    needed: list[str] = []

    def add(name):
        for other in _PARTS[name][0]:
            add(other)
        if name not in needed:
            needed.append(name)

    for name in names:
        add(name)
    # parts read more than once are worked out once
    parts = ",\n".join(
        f"{n} AS {'' if n in ('fifo', 'st', 'txt', 'bulkst') else 'MATERIALIZED '}({_PARTS[n][1]})" for n in needed
    )
    return f"WITH RECURSIVE {parts}\n{body}" if parts else body


def _b(*columns: str) -> str:
    return ", ".join(f"{c}::bigint AS {c}" for c in columns)


def _m(*columns: str) -> str:
    return ", ".join(f"{c}::double AS {c}" for c in columns)


_W_ADDR = ", ".join(f"w_{x}" for x in ("street1", "street2", "city", "state", "zip"))
_D_ADDR = ", ".join(f"d_{x}" for x in ("street1", "street2", "city", "state", "zip"))

# the parts of results, each from the warehouse that has it
_RESULT_PARTS = """SELECT 'neworder' AS type, txn, ts::bigint AS ts, num.w::bigint AS w, (-1)::bigint AS line, 0::bigint AS seq,
          (1 + 2 * n_lines)::bigint AS parts, order_id::bigint AS order_id, last, credit, discount::double AS discount,
          w_tax::double AS w_tax, d_tax::double AS d_tax, NULL::varchar AS item_name, NULL::double AS price, NULL::double AS amount,
          NULL::bigint AS stock_quantity, num.c::bigint AS c, NULL::double AS balance, NULL::varchar AS data, num.d::bigint AS d, NULL::bigint AS carrier
        FROM num JOIN cust ON cust.c = num.c JOIN wh ON wh.w = num.w JOIN dist ON dist.w = num.w AND dist.d = num.d
        UNION ALL SELECT 'neworder', txn, ts, w, line, 0, NULL, NULL, NULL, NULL, NULL, NULL, NULL, item_name, price, amount, NULL, NULL, NULL, NULL, NULL, NULL FROM pln
        UNION ALL SELECT 'neworder', txn, ts, stock_w, line, 1, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, level, NULL, NULL, NULL, NULL, NULL
          FROM st WHERE role <> 'look'
        UNION ALL SELECT 'delivery', dlv.txn, dlv.ts, dlv.w, i, 0, 10, dd.order_id, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, i, dlv.carrier
          FROM dlv CROSS JOIN range(1, 11) t(i) LEFT JOIN dd ON dd.txn = dlv.txn AND dd.d = i
        UNION ALL SELECT 'payment', pay.txn, pay.ts, c_w, -1, 0, 1, NULL, cust.last, credit, discount, NULL, NULL, NULL, NULL, amount, NULL, pay.c, b.balance,
          left(x.data, 200), c_d, NULL
          FROM pay JOIN (SELECT txn, balance FROM bal WHERE kind = 2) b USING (txn) JOIN cust ON cust.c = pay.c AND cust.w = c_w AND cust.d = c_d
          LEFT JOIN (SELECT txn, data FROM txt) x ON x.txn = pay.txn"""
_LAST_PARTS = ", ".join(
    f"arg_max({f}, seq) AS {f}" for f in (
        "order_id", "last", "credit", "discount", "w_tax", "d_tax", "item_name", "price", "amount", "stock_quantity", "c", "balance",
        "data", "d", "carrier",
    )
)

ORACLES: dict[str, str] = {
    "request_log": _with(["allreq"], f"SELECT type, {_b('kind', 'txn', 'ts', 'w')} FROM allreq"),
    "route_counts": _with(["allreq"], f"SELECT type, {_b('w')}, count(*) AS n FROM allreq GROUP BY ALL"),
    "results_for_connection": _with(["decided"], """SELECT txn * 4294967296 + txn % 8 AS id, txn % 8 AS connection, txn, approved
        FROM decided WHERE txn % 2 = 0"""),
    "result_log": _with(["allreq", "bad", "fan"], """SELECT type, txn, true AS is_approval, NULL::bigint AS w,
          type <> 'neworder' OR txn NOT IN (SELECT txn FROM bad) AS approved FROM allreq
        UNION ALL SELECT 'neworder', txn, false, w, NULL FROM fan
        UNION ALL SELECT type, txn, false, w, NULL FROM allreq WHERE type <> 'neworder'"""),
    "log_peek": _with(["bad"], "SELECT txn, false AS approved FROM bad"),
    "json_decode": _with(["req", "ln", "payreq", "dlv"], f"""SELECT 'neworder' AS type, {_b('txn', 'w', 'd', 'c')}, NULL AS last,
          NULL::double AS amount, ts::bigint AS date, NULL::bigint AS carrier, coalesce(n, 0)::bigint AS n_lines,
          coalesce(s, 0)::bigint AS quantity
        FROM req LEFT JOIN (SELECT txn, count(*) AS n, sum(q) AS s FROM ln GROUP BY txn) USING (txn)
        UNION ALL SELECT 'payment', txn, w, d, c, last, amount, NULL, NULL, NULL, NULL FROM payreq
        UNION ALL SELECT 'delivery', txn, w, NULL, NULL, NULL, NULL, ts, carrier, NULL, NULL FROM dlv"""),
    "json_nested_orders": _with(["ln"], f"""SELECT txn, line // 15 AS part, {_b('w', 'd', 'c')}, ts::bigint AS date, line, item,
        sw::bigint AS supply_w, q::bigint AS quantity FROM ln"""),
    "json_props": "SELECT event_id, (props::json->>'k')::bigint AS k, props::json->>'missing' AS missing FROM events",
    "json_roundtrip": _with(["payreq"], """SELECT txn, c IS NOT NULL AS has_id, last IS NOT NULL AS has_name, c, last,
        amount::double AS amount FROM payreq"""),
    "binary_keys": _with(["req"], """SELECT txn, printf('%016X%08X', -txn - 1, w) AS key, -txn - 1 AS id, w::bigint AS w,
        printf('%016X%04X0000', -txn - 1, w) AS modification_key FROM req"""),
    "txn_id_codec": """SELECT o_orderkey AS txn, o_orderkey * 4294967296 + (o_orderkey % 8 - 4 + 4294967296) % 4294967296 AS id,
        o_orderkey AS serial, o_orderkey % 8 - 4 AS connection FROM orders""",
    "accepted_fanout": _with(["fan", "payreq", "dlv"], f"""SELECT {_b('txn', 'w')}, 'neworder' AS type FROM fan
        UNION ALL SELECT txn, c_w, 'payment' FROM payreq UNION ALL SELECT txn, w, 'delivery' FROM dlv"""),
    "partition_assign": _with(["fan"], f"""SELECT {_b('txn', 'w')}, (w % 4)::bigint AS part,
        (((txn % 8 - 4) % 5 + 5) % 5)::bigint AS result_part FROM fan"""),
    "dedup_log": _with(["fan"], f"SELECT {_b('txn', 'w')}, 0::bigint AS copy FROM fan"),
    "compact_log": """SELECT user_id, value FROM (SELECT user_id, CASE WHEN event_type <> 'error' THEN value END AS value,
        row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events) WHERE r = 1 AND value IS NOT NULL""",
    "modification_log": _with(["num", "st", "bal", "pay", "dd", "pln", "txt", "cust"], """SELECT 'neworder' AS type, txn, 20::bigint AS modification_id, ts::bigint AS ts,
          w::bigint AS w, d::bigint AS d, c, order_id, total::double AS amount, NULL::bigint AS item, NULL::bigint AS stock_level,
          NULL::double AS balance, NULL::bigint AS carrier, NULL::bigint AS line, NULL::bigint AS supply_w, NULL::bigint AS quantity,
          NULL::varchar AS dist_info, NULL::varchar AS customer_data FROM num
        UNION ALL SELECT 'neworder-line', txn, 20, pln.ts, pln.w, pln.d, NULL, NULL, pln.amount, pln.item, level, NULL, NULL, line, pln.sw,
          pln.q, rpad(pln.sw || '.' || pln.d || '.' || pln.item, 24, '*'), NULL
          FROM pln JOIN (SELECT txn, line, level FROM st WHERE role <> 'supply') USING (txn, line)
        UNION ALL SELECT 'remote-stock', txn, line, ts, stock_w, NULL, NULL, NULL, NULL, item, level, NULL, NULL, NULL, NULL, NULL, NULL, NULL
          FROM st WHERE role = 'supply'
        UNION ALL SELECT 'payment', txn, 0, pay.ts, pay.c_w, pay.c_d, pay.c, NULL, amount, NULL, NULL, balance, NULL, NULL, NULL, NULL, NULL,
          coalesce(t.data, cust.opening)
          FROM pay JOIN (SELECT txn, balance FROM bal WHERE kind = 2) USING (txn) LEFT JOIN (SELECT txn, data FROM txt) t USING (txn)
          LEFT JOIN cust ON cust.c = pay.c AND cust.w = pay.c_w AND cust.d = pay.c_d
        UNION ALL SELECT 'delivery', txn, d, ts, w, d, c, order_id, total, NULL, NULL, NULL, carrier, NULL, NULL, NULL, NULL, NULL FROM dd"""),
    "verify_orders": _with(["req", "bad"], "SELECT txn, txn NOT IN (SELECT txn FROM bad) AS approved FROM req"),
    "verify_all": _with(["allreq", "bad"], """SELECT type, txn, type <> 'neworder' OR txn NOT IN (SELECT txn FROM bad) AS approved FROM allreq
        UNION ALL SELECT 'view', event_id, false FROM events WHERE event_type = 'view'"""),
    "unknown_items": _with(["item"], """SELECT l_orderkey AS txn, l_partkey AS item, count(*) AS n FROM lineitem
        WHERE l_partkey NOT IN (SELECT item FROM item) GROUP BY ALL"""),
    "missing_keys": _with(["item"], "SELECT DISTINCT l_partkey AS item FROM lineitem WHERE l_partkey NOT IN (SELECT item FROM item)"),
    "lookup_warehouse": _with(["wh", "payreq"], f"""SELECT {_b('w')}, w_name, {_W_ADDR}, {_m('w_tax')} FROM wh
        WHERE w IN (SELECT w FROM payreq)"""),
    "lookup_district": _with(["dist", "payreq"], f"""SELECT {_b('w', 'd')}, d_name, {_D_ADDR}, {_m('d_tax')} FROM dist
        WHERE (w, d) IN (SELECT (w, d) FROM payreq)"""),
    "lookup_customer": _with(["cust", "payreq"], f"""SELECT {_b('w', 'd')}, c, first, last, credit, {_m('discount')}, phone,
        1514764800000::bigint AS since FROM cust WHERE c IN (SELECT c FROM payreq WHERE c IS NOT NULL)"""),
    "lookup_item": _with(["item"], f"SELECT item, item_name, {_m('price')} FROM item WHERE item IN (SELECT l_partkey FROM lineitem)"),
    "lookup_stock": _with(["aln", "stk"], f"SELECT {_b('w', 'quantity')}, item FROM stk WHERE (w, item) IN (SELECT (sw, item) FROM aln)"),
    "lookup_pending": _with(["pend"], f"""SELECT {_b('w', 'd', 'order_id')}, txn, c, {_m('total')} FROM pend p
        WHERE order_id = (SELECT min(order_id) FROM pend o WHERE o.w = p.w AND o.d = p.d)"""),
    "order_ids": _with(["num"], f"SELECT txn, {_b('w', 'd', 'ts', 'order_id')}, c FROM num"),
    "order_lines": _with(["pln", "num"], f"""SELECT txn, pln.line::bigint AS line, item, pln.q::bigint AS quantity, {_b('w', 'd')},
        sw::bigint AS supply_w, {_m('amount')}, rpad(sw || '.' || d || '.' || item, 24, '*') AS dist_info, order_id
        FROM pln JOIN (SELECT txn, order_id FROM num) USING (txn)"""),
    "enrich_lines": _with(["pln"], f"SELECT txn, {_b('line')}, item, item_name, {_m('price', 'amount')}, q::bigint AS quantity FROM pln"),
    "line_dist_info": _with(["aln"], f"""SELECT sw::bigint AS supply_w, item, {_b('d')}, rpad(sw || '.' || d || '.' || item, 24, '*') AS dist_info,
        count(*) AS n FROM aln GROUP BY ALL"""),
    "neworder_header": _with(["num", "cust", "wh", "dist"], f"""SELECT txn, num.w::bigint AS w, num.d::bigint AS d, num.c, order_id,
        ts::bigint AS ts, {_m('w_tax', 'd_tax', 'discount')}, last, credit
        FROM num JOIN cust ON cust.c = num.c JOIN wh ON wh.w = num.w JOIN dist ON dist.w = num.w AND dist.d = num.d"""),
    "order_summary": _with(["acc", "aln"], f"""SELECT txn, {_b('w', 'd')}, c, total::double AS amount, n_lines,
        coalesce(a, true) AS all_local FROM acc LEFT JOIN (SELECT txn, bool_and(sw = w) AS a FROM aln GROUP BY txn) USING (txn)"""),
    "order_amount_sql": _with(["acc"], "SELECT txn, CASE WHEN n_lines > 0 THEN total END::double AS amount FROM acc"),
    "new_orders": _with(["req", "bad", "ln", "num", "cust", "wh", "dist"], f"""SELECT req.txn, req.w::bigint AS w, req.d::bigint AS d, req.c, req.ts::bigint AS ts,
        req.txn NOT IN (SELECT txn FROM bad) AS approved, coalesce(l.n, 0) AS n_lines, num.total::double AS total, num.order_id,
        {_m('w_tax', 'd_tax', 'discount')}, last, credit
        FROM req LEFT JOIN num ON num.txn = req.txn LEFT JOIN (SELECT txn, count(*) AS n FROM ln GROUP BY txn) l ON l.txn = req.txn
        JOIN cust ON cust.c = req.c JOIN wh ON wh.w = req.w JOIN dist ON dist.w = req.w AND dist.d = req.d"""),
    "stream_order_status": _with(["state"], f"SELECT {_b('w', 'd', 'order_id', 'ts', 'txn', 'carrier', 'delivered')}, c, {_m('balance')} FROM state"),
    "stream_recent_orders": _with(["rec"], f"SELECT {_b('w', 'd', 'order_id')}, txn, c FROM rec"),
    "stream_deliveries": _with(["dd"], f"SELECT {_b('w', 'd', 'order_id', 'txn', 'ts', 'carrier')}, c, {_m('total')} FROM dd"),
    "stream_balances": _with(["bal"], f"SELECT {_b('w', 'd', 'ts', 'kind', 'txn')}, c, {_m('change', 'balance')} FROM bal"),
    "stream_result_log": _with(["num", "cust", "wh", "dist", "pln", "st", "pay", "bal", "txt", "dlv", "dd"], _RESULT_PARTS),
    "stream_results": _with(["num", "cust", "wh", "dist", "pln", "st", "pay", "bal", "txt", "dlv", "dd"], f"""
        SELECT type, txn, line, 'complete' AS status, max(ts) AS ts, arg_max(w, seq) AS w, max(seq) AS seq, {_LAST_PARTS}
        FROM ({_RESULT_PARTS}) GROUP BY type, txn, line"""),
    "stream_views": _with(["state"], f"SELECT {_b('w', 'd', 'order_id', 'ts', 'txn', 'carrier', 'delivered')}, c, {_m('balance')} FROM state"),
    "stream_credit_data": _with(["txt"], f"SELECT txn, c, {_b('c_w', 'c_d')}, data FROM txt"),
    "recent_orders": _with(["rec"], f"SELECT {_b('w', 'd', 'order_id')}, txn, c FROM rec"),
    "latest_orders": _with(["lastord"], f"SELECT {_b('w', 'd', 'order_id', 'ts')}, txn, c FROM lastord"),
    "latest_order_lines": _with(["lastord", "pln"], """SELECT txn, l.w::bigint AS w, l.d::bigint AS d, l.c, order_id, line::bigint AS line, item,
        sw::bigint AS supply_w, q::bigint AS quantity, amount::double AS amount FROM lastord l JOIN pln USING (txn)"""),
    "stock_levels": _with(["st"], f"SELECT {_b('stock_w', 'ts', 'line', 'level')}, item, txn, q::bigint AS quantity FROM st WHERE role <> 'look'"),
    "home_stock_asof": _with(["st"], f"SELECT txn, {_b('line', 'w', 'level')}, item FROM st WHERE role <> 'supply'"),
    "remote_stock": _with(["st"], f"SELECT txn, {_b('line', 'stock_w', 'level')}, item FROM st WHERE role = 'supply'"),
    "view_stock": _with(["lev"], f"SELECT {_b('stock_w', 'level')}, item FROM lev"),
    "stock_level": _with(["rec", "aln", "lev", "thr"], f"""SELECT {_b('w', 'd', 'threshold')}, coalesce(n, 0) AS low FROM thr LEFT JOIN (
        SELECT r.w, r.d, count(DISTINCT aln.item) AS n FROM rec r JOIN aln USING (txn) JOIN lev ON lev.stock_w = r.w AND lev.item = aln.item
        JOIN thr ON thr.w = r.w AND thr.d = r.d WHERE level < threshold GROUP BY ALL) USING (w, d)"""),
    "stock_level_sql": _with(["num", "aln", "lev", "thr"], f"""SELECT {_b('w', 'd', 'threshold')}, coalesce(n, 0) AS low FROM thr LEFT JOIN (
        SELECT r.w, r.d, count(*) AS n FROM num r JOIN aln USING (txn) JOIN lev ON lev.stock_w = r.w AND lev.item = aln.item
        JOIN thr ON thr.w = r.w AND thr.d = r.d
        JOIN (SELECT w, d, max(order_id) + 1 AS next_id FROM num GROUP BY ALL) x ON x.w = r.w AND x.d = r.d
        WHERE level < threshold AND order_id >= next_id - 20 GROUP BY ALL) USING (w, d)"""),
    "stock_counters": _with(["aln"], """SELECT sw::bigint AS supply_w, item, sum(q)::bigint AS ytd, count(*) AS order_count,
        count(*) FILTER (sw <> w) AS remote_count FROM aln GROUP BY ALL"""),
    "fifo_deliveries": _with(["fifo"], f"SELECT {_b('w', 'd', 'ts', 'txn')}, popped::bigint AS order_id FROM fifo WHERE kind = 1"),
    "deliveries": _with(["dd"], f"SELECT {_b('w', 'd', 'order_id', 'txn', 'ts', 'carrier')}, c, {_m('total')} FROM dd"),
    "deliveries_in_two_runs": _with(["dd"], f"SELECT {_b('w', 'd', 'order_id', 'txn', 'ts', 'carrier')}, c, {_m('total')} FROM dd"),
    "delivery_result": _with(["dlv", "dd"], """SELECT dlv.txn::bigint AS txn, dlv.w::bigint AS w, dlv.carrier::bigint AS carrier,
        dd.d::bigint AS d, dd.order_id::bigint AS order_id FROM dlv LEFT JOIN dd ON dd.txn = dlv.txn"""),
    "pending_orders": _with(["pend"], f"SELECT {_b('w', 'd', 'order_id')}, txn, c, {_m('total')} FROM pend"),
    "oldest_pending": _with(["pend"], """SELECT w::bigint AS w, d::bigint AS d, min(order_id) AS order_id,
        arg_min(txn, order_id) AS txn, arg_min(c, order_id) AS c FROM pend GROUP BY w, d"""),
    "customers_by_name": _with(["cust"], f"""SELECT {_b('w', 'd')}, last, first, c,
        row_number() OVER (PARTITION BY w, d, last ORDER BY first, c) AS position FROM cust"""),
    "middle_customer": _with(["mid"], f"SELECT {_b('w', 'd')}, last, c FROM mid"),
    "middle_customer_sql": _with(["midsql"], f"SELECT {_b('w', 'd')}, last, c FROM midsql"),
    "balances": _with(["bal"], f"SELECT {_b('w', 'd', 'ts', 'kind', 'txn')}, c, {_m('change', 'balance')} FROM bal"),
    "credit_data": _with(["txt"], f"SELECT txn, c, {_b('c_w', 'c_d')}, data FROM txt"),
    "payments": _with(["pay", "bal"], f"""SELECT txn, pay.c, {_b('c_w', 'c_d')}, {_m('amount', 'balance')}, last IS NOT NULL AS by_name
        FROM pay JOIN (SELECT txn, balance FROM bal WHERE kind = 2) USING (txn)"""),
    "payment_result": _with(["pay", "bal", "txt", "cust", "wh", "dist"], f"""SELECT pay.txn, pay.ts::bigint AS ts, pay.c, pay.w::bigint AS w, pay.d::bigint AS d,
        pay.c_w::bigint AS c_w, pay.c_d::bigint AS c_d, {_m('amount', 'balance', 'discount', 'w_tax', 'd_tax')}, 50000::double AS credit_limit,
        first, 'OE' AS middle, cust.last, credit, phone, 1514764800000::bigint AS since, left(txt.data, 200) AS data,
        {_address('c_', 'CUSTOMER', 'cust.c')}, w_name, d_name, {_W_ADDR}, {_D_ADDR}
        FROM pay JOIN cust ON cust.c = pay.c JOIN (SELECT txn, balance FROM bal WHERE kind = 2) b ON b.txn = pay.txn
        LEFT JOIN txt ON txt.txn = pay.txn JOIN wh ON wh.w = pay.w JOIN dist ON dist.w = pay.w AND dist.d = pay.d"""),
    "customer_ytd": _with(["pay", "dd"], """SELECT w::bigint AS w, d::bigint AS d, c, sum(amount)::double AS paid,
        count(*) FILTER (k = 'p') AS payments, count(*) FILTER (k = 'd') AS deliveries FROM (
        SELECT c_w AS w, c_d AS d, c, amount, 'p' AS k FROM pay UNION ALL SELECT w, d, c, 0, 'd' FROM dd) GROUP BY w, d, c"""),
    "ytd_by_district": _with(["payreq"], "SELECT w::bigint AS w, d::bigint AS d, sum(amount)::double AS ytd, count(*) AS ytd_compat FROM payreq GROUP BY w, d"),
    "history": _with(["pay", "wh", "dist"], f"""SELECT txn, c, {_b('c_d', 'c_w', 'ts')}, pay.d::bigint AS d, pay.w::bigint AS w, {_m('amount')},
        w_name || '    ' || d_name AS data FROM pay JOIN wh ON wh.w = pay.w JOIN dist ON dist.w = pay.w AND dist.d = pay.d"""),
    "view_balance": _with(["state"], f"SELECT {_b('w', 'd')}, c, {_m('balance')} FROM state"),
    "view_balance_compat": _with(["lastord", "pay", "dd"], """SELECT l.w::bigint AS w, l.d::bigint AS d, l.c, (-10 + coalesce(s, 0))::double AS balance
        FROM lastord l LEFT JOIN (SELECT w, d, c, sum(x) AS s FROM (SELECT w, d, c, -amount AS x FROM pay
        UNION ALL SELECT w, d, c, total FROM dd) GROUP BY ALL) t ON t.w = l.w AND t.d = l.d AND t.c = l.c"""),
    "order_status": _with(["state", "cust"], f"""SELECT s.w::bigint AS w, s.d::bigint AS d, s.c, {_b('order_id', 'ts', 'txn', 'carrier', 'delivered')},
        {_m('balance')}, first, 'OE' AS middle, last FROM state s JOIN cust ON cust.c = s.c"""),
    "order_status_by_name": _with(["state", "cust", "mid"], f"""SELECT s.w::bigint AS w, s.d::bigint AS d, s.c, {_b('order_id', 'ts', 'txn', 'carrier', 'delivered')},
        {_m('balance')}, first, 'OE' AS middle, cust.last FROM state s JOIN cust ON cust.c = s.c JOIN mid ON mid.c = s.c"""),
    "order_status_lines": _with(["state", "pln"], """SELECT s.w::bigint AS w, s.d::bigint AS d, s.c, order_id, s.txn, delivered::bigint AS delivered,
        line::bigint AS line, item, sw::bigint AS supply_w, q::bigint AS quantity, amount::double AS amount
        FROM state s JOIN pln ON pln.txn = s.txn"""),
    "merge_results": _with(["pln", "st"], f"""SELECT pln.txn, pln.line::bigint AS line, item_name, {_m('price', 'amount')}, level::bigint AS stock_quantity,
        true AS complete FROM pln JOIN st ON st.txn = pln.txn AND st.line = pln.line AND role <> 'look'"""),
    "txn_status": _with(["req", "shipped", "bad"], f"""SELECT req.txn, {_b('w', 'd')}, CASE WHEN result <= 883612800000 THEN 'complete'
        WHEN req.ts > 883612800000 THEN 'written' WHEN req.txn IN (SELECT txn FROM bad) THEN 'rejected' ELSE 'accepted' END AS status
        FROM req LEFT JOIN shipped ON shipped.txn = req.txn"""),
    "stage_latency": _with(["shipped"], """SELECT txn, 0::bigint AS written_ms, (first - ts)::bigint AS accepted_ms,
        (last - ts)::bigint AS routed_ms, (result - ts)::bigint AS result_ms FROM shipped
        JOIN (SELECT l_orderkey AS txn, epoch_ms(min(l_shipdate)) AS first, epoch_ms(max(l_shipdate)) AS last FROM lineitem GROUP BY 1) USING (txn)
        WHERE result IS NOT NULL"""),
    "timeouts": _with(["shipped"], """SELECT txn, ts::bigint AS sent, result::bigint AS result FROM shipped
        WHERE result IS NULL OR result - ts > 2592000000"""),
    "bulk_stock_levels": _with(["bulkst"], f"SELECT {_b('stock_w', 'ts', 'line', 'level')}, item, txn, q::bigint AS quantity FROM bulkst WHERE role <> 'look'"),
    "bulk_stock": _with(["bulkst"], "SELECT stock_w::bigint AS stock_w, item, arg_max(level, k)::bigint AS level FROM bulkst GROUP BY ALL"),
    "duration_stats": """SELECT event_type AS event, epoch_ms(date_trunc('day', ts)::timestamp)::bigint AS start, count(*) AS n,
        sum(value::decimal(12,2))::double / count(*) AS mean, count(*) FILTER (value > 90) AS over_limit,
        quantile_cont(value, 0.5) AS p50, quantile_cont(value, 0.95) AS p95 FROM events GROUP BY ALL""",
    "state_as_of": _with(["fifo"], """SELECT w::bigint AS w, d::bigint AS d, (arg_max(arrived, k) + 1)::bigint AS next_id,
        (arg_max(arrived, k) - arg_max(done, k))::bigint AS pending FROM fifo WHERE ts <= 883612800000 GROUP BY w, d"""),
    "rebuild_equals_live": _with(["lev"], "SELECT stock_w::bigint AS stock_w, item, level::bigint AS rebuilt, level::bigint AS live FROM lev"),
    "updated_orders": _with(["num", "aln", "dd"], f"""SELECT num.w::bigint AS w, num.d::bigint AS d, num.order_id, num.c, num.ts::bigint AS ts, n_lines,
        coalesce(a, true) AS all_local, dd.carrier::bigint AS carrier FROM num
        LEFT JOIN (SELECT txn, bool_and(sw = w) AS a FROM aln GROUP BY txn) l ON l.txn = num.txn
        LEFT JOIN dd ON dd.w = num.w AND dd.d = num.d AND dd.order_id = num.order_id"""),
    "sql_order_lines": _with(["pln", "num", "dd"], """SELECT pln.txn, item, sw::bigint AS supply_w, q::bigint AS quantity, amount::double AS amount,
        num.w::bigint AS w, num.d::bigint AS d, num.order_id, line::bigint + 1 AS number, dd.ts::bigint AS delivered
        FROM pln JOIN num ON num.txn = pln.txn LEFT JOIN dd ON dd.w = num.w AND dd.d = num.d AND dd.order_id = num.order_id"""),
    "sql_stock": _with(["aln", "lev", "stk"], """SELECT stk.w::bigint AS w, stk.item, coalesce(level, quantity)::bigint AS quantity,
        coalesce(y, 0)::bigint AS ytd, coalesce(n, 0) AS order_count, coalesce(r, 0) AS remote_count FROM stk
        LEFT JOIN lev ON stock_w = stk.w AND lev.item = stk.item
        LEFT JOIN (SELECT sw, item, sum(q) AS y, count(*) AS n, count(*) FILTER (sw <> w) AS r FROM aln GROUP BY ALL) a
          ON sw = stk.w AND a.item = stk.item"""),
    "updated_customers": _with(["cust", "paysql", "dd"], """, pk AS (SELECT p.*, opening, p.c::varchar || p.c_d || p.c_w || p.d || p.w || p.amount AS prefix
          FROM paysql p JOIN cust ON cust.c = p.c WHERE credit = 'BC'),
        tx AS (SELECT c, left(string_agg(prefix, '' ORDER BY ts DESC, txn DESC) || any_value(opening), 500) AS data FROM pk GROUP BY c)
        SELECT cust.w::bigint AS w, cust.d::bigint AS d, cust.c, cust.last, credit,
          (-10 - coalesce(paid, 0) + coalesce(owed, 0))::double AS balance, coalesce(paid, 0)::double AS paid,
          coalesce(p.n, 0) AS payments, coalesce(g.n, 0) AS deliveries, coalesce(tx.data, opening) AS data
        FROM cust LEFT JOIN (SELECT c, sum(amount) AS paid, count(*) AS n FROM paysql GROUP BY c) p ON p.c = cust.c
        LEFT JOIN (SELECT c, sum(total) AS owed, count(*) AS n FROM dd GROUP BY c) g ON g.c = cust.c
        LEFT JOIN tx ON tx.c = cust.c"""),
    "sql_districts": _with(["dist", "num", "payreq"], f"""SELECT {_b('w', 'd')}, d_name, {_m('d_tax')}, coalesce(n, 0) + 1 AS next_id,
        (30000 + coalesce(y, 0))::double AS ytd FROM dist
        LEFT JOIN (SELECT w, d, max(order_id) AS n FROM num GROUP BY ALL) USING (w, d)
        LEFT JOIN (SELECT w, d, sum(amount) AS y FROM payreq GROUP BY ALL) USING (w, d)"""),
    "sql_warehouses": _with(["wh", "payreq"], f"""SELECT {_b('w')}, w_name, {_m('w_tax')}, (300000 + coalesce(y, 0))::double AS ytd
        FROM wh LEFT JOIN (SELECT w, sum(amount) AS y FROM payreq GROUP BY w) USING (w)"""),
    "check_next_id": _with(["num", "pend"], """SELECT w::bigint AS w, d::bigint AS d, n + 1 AS next_id, newest, true AS ok
        FROM (SELECT w, d, count(*) AS n FROM num GROUP BY ALL) JOIN (SELECT w, d, max(order_id) AS newest FROM pend GROUP BY ALL) USING (w, d)"""),
    "check_contiguous": _with(["pend"], """SELECT w::bigint AS w, d::bigint AS d, min(order_id) AS oldest, max(order_id) AS newest, count(*) AS n,
        true AS ok FROM pend GROUP BY w, d"""),
    "check_carrier": _with(["state"], f"SELECT {_b('w', 'd', 'order_id', 'carrier')}, c, carrier IS NULL AS waiting, true AS ok FROM state"),
    "check_delivery_date": _with(["state", "pln"], """SELECT s.w::bigint AS w, s.d::bigint AS d, s.c, s.txn, line::bigint AS line,
        delivered::bigint AS delivered, carrier::bigint AS carrier, true AS ok FROM state s JOIN pln ON pln.txn = s.txn"""),
    "check_payment_delta": _with(["bal"], """SELECT w::bigint AS w, d::bigint AS d, c, txn::bigint AS txn, (balance - change)::double AS before,
        balance::double AS balance, true AS ok FROM bal WHERE kind = 2"""),
    "last_names": f"SELECT c_custkey AS c, {_last('c_custkey % 1000')} AS last FROM customer",
    "nurand_expr": """SELECT (((l_partkey % 256) | (l_orderkey % 1000)) + 128) % 1000 AS drawn, count(*) AS n FROM lineitem GROUP BY ALL""",
    "padded_fields": _with(["cust"], "SELECT c, phone, opening AS data FROM cust"),
    "gen_item": """SELECT p_partkey AS item, p_partkey % 10000 + 1 AS image, 'Item number ' || p_partkey AS name,
        p_partkey + (p_partkey % 100)::double / 100 AS price, 'Data for item number ' || p_partkey AS data FROM part""",
    "gen_warehouse": _with(["wh"], """SELECT w::bigint AS w, w_name AS name, w_street1 AS street1, w_street2 AS street2, w_city AS city,
        w_state AS state, w_zip AS zip, w_tax::double AS tax FROM wh"""),
    "gen_district": _with(["dist"], """SELECT w::bigint AS w, d::bigint AS d, d_name AS name, d_street1 AS street1, d_street2 AS street2,
        d_city AS city, d_state AS state, d_zip AS zip, d_tax::double AS tax FROM dist"""),
    "gen_customer": _with(["cust"], f"""SELECT {_b('w', 'd')}, c, 'OE' AS middle, c || '-FIRSTNAME' AS first,
        {_last('((c - 1) % 20 + 20) % 20')} AS last, {_address('', 'CUSTOMER', 'c')}, phone, 1514764800000::bigint AS since,
        CASE WHEN c % 10 = 0 THEN 'BC' ELSE 'GC' END AS credit, {_m('discount')}, opening AS data,
        50000::double AS credit_limit, -100::double AS balance FROM cust"""),
    "gen_stock": """SELECT w, p_partkey AS item, p_partkey % 90 + 10 AS quantity, """
        + ", ".join(f"lpad(p_partkey::varchar, 24, '0') AS dist_{n:02d}" for n in range(1, 11))
        + """, 'Data for stock number ' || p_partkey AS data
        FROM part, (SELECT n_nationkey::bigint + 1 AS w FROM nation)""",
    "gen_orders": _with(["gord"], """SELECT w::bigint AS w, d::bigint AS d, order_id, i AS line,
        ((order_id * 10 + i + (SELECT count(*) FROM part) - 1) % (SELECT count(*) FROM part)) + 1 AS item, w::bigint AS supply_w,
        ((order_id * 10 + i + (SELECT count(*) FROM part) - 1) % (SELECT count(*) FROM part) + 1) % 90 + 10 AS home_level,
        5::bigint AS quantity, CASE WHEN order_id * 10 <= n * 7 THEN 0 ELSE (order_id + i / 100.0) END::double AS amount,
        CASE WHEN order_id * 10 <= n * 7 THEN 1546300800000 + order_id * 1000 END AS delivery_ms,
        rpad(w || '.' || d || '.' || order_id || '.' || i, 24, '*') AS dist_info, c, 1546300800000 + order_id * 1000 AS entered,
        CASE WHEN order_id * 10 <= n * 7 THEN order_id % 10 + 1 END AS carrier
        FROM gord, range(0, 15) t(i) WHERE i < 5 + order_id % 11"""),
}

ORACLES["home_stock_joined"] = ORACLES["home_stock_asof"]
ORACLES["stream_modification_log"] = ORACLES["modification_log"]
ORACLES["stream_stock_level"] = ORACLES["stock_level"]


# ---- draws: a digest of seed and key, taken here by the database -----------------------------------


def _unit(seed: int, *key: str) -> str:
    return f"(('0x' || substr(md5(concat_ws(':', {', '.join([str(seed), *key])})), 1, 13))::bigint::double / {1 << 52}::double)"


def _uniform(low: int, high: int | str, seed: int, *key: str) -> str:
    return f"(floor({_unit(seed, *key)} * ({high} - {low} + 1))::bigint + {low})"


def _nurand(a: int, low: int, high: int | str, seed: int, *key: str) -> str:
    return f"((({_uniform(0, a, seed, *key)} | {_uniform(low, high, seed + 1, *key)}) + 128) % ({high} - {low} + 1) + {low})"


def _text(low: int, high: int, seed: int, *key: str) -> str:
    digest = f"md5(concat_ws(':', {', '.join([str(seed), *key])}, (i - 1) // 8))"
    one = f"chr((('0x' || substr({digest}, (i - 1) % 8 * 4 + 1, 4))::bigint % 95 + 32)::int)"
    return f"array_to_string(list_transform(range(1, {_uniform(low, high, seed + 1, *key)} + 1), lambda i: {one}), '')"


def _shuffled(at: str, n: str, seed: int, *key: str) -> str:
    other = f"((floor({_unit(seed, *key, 'r')} * {n})::bigint - x + {n}) % {n})"
    swap = f"CASE WHEN {_unit(seed + 1, *key, 'r', f'greatest(x, {other})')} < 0.5 THEN {other} ELSE x END"
    return f"list_reduce(list_prepend(({at})::bigint, range(1, 33)), lambda x, r: {swap})"


_HOMES = "(SELECT count(*) FROM nation)"
_DRAWN = f"""asked AS MATERIALIZED (SELECT o_orderkey AS txn, o_orderkey % {_HOMES} + 1 AS w, {_unit(100, 'o_orderkey')} * 100 AS u FROM orders),
    drawn AS (SELECT txn, w, CASE WHEN u < 4.2::double THEN 'stocklevel' WHEN u < 8.4::double THEN 'orderstatus'
        WHEN u < 12.6::double THEN 'delivery' WHEN u < 55.8::double THEN 'payment' ELSE 'neworder' END AS type FROM asked)"""


def _elsewhere(seed: int, *key: str) -> str:
    return f"((w - 1 + {_uniform(1, _HOMES + ' - 1', seed, *key)}) % {_HOMES} + 1)"


ORACLES |= {
    "drawn_requests": f"WITH {_DRAWN} SELECT * FROM drawn",
    "drawn_new_orders": f"""WITH {_DRAWN}, o AS (SELECT txn, w, {_uniform(1, 10, 200, 'txn')} AS d, {_nurand(1023, 1, 3000, 201, 'txn')} AS c,
            {_uniform(5, 15, 203, 'txn')} AS n_lines, {_unit(204, 'txn')} * 100 < 1 AS spoiled FROM drawn WHERE type = 'neworder'),
        l AS (SELECT * FROM o, range(0, 15) t(line) WHERE line < n_lines)
        SELECT txn, w, d, c, n_lines, line,
            CASE WHEN spoiled AND line = n_lines - 1 THEN 2147483647
                ELSE {_nurand(8191, 1, '(SELECT count(*) FROM part)', 300, 'txn', 'line')} END AS item,
            CASE WHEN {_unit(302, 'txn', 'line')} * 100 < 1 THEN {_elsewhere(303, 'txn', 'line')} ELSE w END AS supply_w,
            {_uniform(1, 10, 304, 'txn', 'line')} AS quantity FROM l""",
    "drawn_payments": f"""WITH {_DRAWN}, p AS (SELECT txn, w, {_uniform(1, 10, 400, 'txn')} AS d, {_unit(401, 'txn')} * 100 < 15 AS remote,
            {_unit(402, 'txn')} * 100 < 60 AS named, {_nurand(255, 0, 999, 403, 'txn')} AS n, {_elsewhere(405, 'txn')} AS other,
            {_uniform(1, 10, 406, 'txn')} AS other_d, {_nurand(1023, 1, 3000, 407, 'txn')} AS c,
            {_uniform(100, 5000000, 409, 'txn')} AS cents FROM drawn WHERE type = 'payment')
        SELECT txn, w, d, cents / 100.0::double AS amount, CASE WHEN remote THEN other ELSE w END AS c_w,
            CASE WHEN remote THEN other_d ELSE d END AS c_d, CASE WHEN NOT named THEN c END AS c,
            CASE WHEN named THEN {_last('n')} END AS last FROM p""",
    "drawn_other_requests": f"""WITH {_DRAWN}
        SELECT txn, type, w, {_uniform(1, 10, 700, 'txn')} AS carrier, NULL::bigint AS d, NULL::bigint AS threshold,
            NULL::bigint AS c, NULL::varchar AS last FROM drawn WHERE type = 'delivery'
        UNION ALL SELECT txn, type, w, NULL, {_uniform(1, 10, 710, 'txn')}, {_uniform(10, 20, 711, 'txn')}, NULL, NULL
            FROM drawn WHERE type = 'stocklevel'
        UNION ALL SELECT txn, type, w, NULL, {_uniform(1, 10, 720, 'txn')}, NULL,
            CASE WHEN {_unit(721, 'txn')} * 100 >= 60 THEN {_nurand(1023, 1, 3000, 724, 'txn')} END,
            CASE WHEN {_unit(721, 'txn')} * 100 < 60 THEN {_last(_nurand(255, 0, 999, 722, 'txn'))} END
            FROM drawn WHERE type = 'orderstatus'""",
    "drawn_items": f"""WITH i AS (SELECT p_partkey AS item, {_text(26, 50, 500, 'p_partkey')} AS t, {_unit(502, 'p_partkey')} AS u,
            {_unit(503, 'p_partkey')} * 100 < 10 AS marked FROM part)
        SELECT item, {_uniform(1, 10000, 504, 'item')} AS image, {_text(14, 24, 505, 'item')} AS name,
            {_uniform(1, 10000, 507, 'item')} / 100.0::double AS price,
            CASE WHEN marked THEN substr(t, 1, floor(u * (length(t) - 8))::int) || 'ORIGINAL'
                || substr(t, floor(u * (length(t) - 8))::int + 9) ELSE t END AS data FROM i""",
    "drawn_orders": _with(["gord"], f"""SELECT w::bigint AS w, d::bigint AS d, c, order_id, n_lines, 1546300800000::bigint AS entered,
        order_id * 10 <= n * 7 AS delivered, CASE WHEN order_id * 10 <= n * 7 THEN carrier END AS carrier FROM (
            SELECT *, {_uniform(5, 15, 600, 'w', 'd', 'order_id')} AS n_lines, {_uniform(1, 10, 601, 'w', 'd', 'order_id')} AS carrier FROM (
                SELECT w, d, c, n, {_shuffled('order_id - 1', 'n', 602, 'w', 'd')} + 1 AS order_id FROM gord))"""),
}
