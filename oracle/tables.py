"""DuckDB side of the checks: the canonical tables as common table expressions.

Written from the mapping rules alone, in SQL; nothing here is generated from the Spark plans.
"""

from __future__ import annotations

DAY = "86400000000"


def uid(key: str) -> str:
    return f"format('{{:024x}}', {key})"


def days(start: str, end: str) -> str:
    return f"((epoch_us({end}) - epoch_us({start})) / 8.64e10)"


def rounded_days(x: str) -> str:
    return f"round_even({x}, 0)::INT"


def days_ago(t: str, at: str) -> str:
    r = rounded_days(days(t, at))
    return f"CASE WHEN {r} >= 0 THEN {r} END"


def days_since(t: str, at: str) -> str:
    return (
        f"CASE WHEN {t} IS NULL THEN 9999 ELSE {rounded_days(f'greatest(0.0, {days(t, at)})')} END"
    )


def whole_days(t: str, at: str) -> str:
    return f"floor({days(t, at)})::INT"


def half_even(x: str, digits: int) -> str:
    scale = f"1e{digits}"
    return f"(round_even(({x}) * {scale}, 0) / {scale})"


CTE = {
    "ord": """SELECT o_orderkey AS k, o_custkey AS c, o_orderstatus AS st, o_totalprice AS price,
        o_orderdate + to_hours(o_orderkey % 24) AS tsp, CAST(substr(o_orderpriority, 1, 1) AS INT) AS pr
        FROM orders""",
    "line": """SELECT l.*, o.o_custkey AS c, l.l_shipdate + to_hours(l.l_linenumber) AS tsp
        FROM lineitem l JOIN orders o ON o.o_orderkey = l.l_orderkey""",
    "tm": """SELECT date_trunc('day', max(tsp))::TIMESTAMP AS ref,
        (date_trunc('day', max(tsp)) - INTERVAL 90 DAY)::TIMESTAMP AS cut FROM ord""",
    "users": """SELECT c_custkey AS c, s.created, s.login, s.n_orders, c_acctbal, c_mktsegment,
        CASE WHEN c_nationkey <> 7 THEN n_name END AS country
        FROM customer LEFT JOIN (SELECT c, min(tsp) AS created, max(tsp) AS login, count(*) AS n_orders
            FROM ord GROUP BY c) s ON s.c = c_custkey
        LEFT JOIN nation ON n_nationkey = c_nationkey""",
    "chars": """SELECT k, c, tsp AS created, tsp + to_days((k % 60)::INT) AS updated,
        CASE WHEN pr <> 5 THEN pr - 1 END AS class,
        CASE WHEN k % 11 <> 0 THEN floor(price / 10000) END AS level, floor(price) AS experience,
        CASE WHEN st = 'F' THEN k % 5 END AS arena, CASE WHEN st <> 'O' THEN k % 100 END AS medals,
        CASE WHEN k % 6 < 4 THEN k % 6 IN (0, 2) END AS custom,
        (k % 7) * 10 AS talent, least((k % 7) * 10, k % 37) AS spent,
        floor(price / 100) AS attack, floor(price / 120) AS defense,
        CASE WHEN k % 8 <> 0 THEN (k % 17) / 2.0 END AS critical,
        bit_count((k & 63)::INT) AS slots, bit_count((k & 127)::INT) AS looks
        FROM ord WHERE k % 97 <> 0""",
    "devices": """SELECT c, CASE WHEN st = 'F' THEN 'android' WHEN st = 'O' THEN 'ios'
            WHEN k % 2 = 1 THEN 'windows' END AS platform,
        CASE WHEN k % 31 <> 0 THEN 'model-' || pr END AS model, tsp AS created,
        CASE WHEN k % 17 <> 0 THEN tsp + to_days((k % 200)::INT) END AS updated FROM ord""",
    "cons": """SELECT c, tsp AS bought,
        CASE WHEN p_type = 'ECONOMY' THEN 'gems_economy' ELSE lower(p_type) END AS product
        FROM line JOIN part ON p_partkey = l_partkey WHERE l_discount = 0 AND l_tax >= 0.04""",
    "subs": """SELECT c, tsp AS bought, CASE pr WHEN 1 THEN 'subs_monthly' WHEN 2 THEN 'subs_3_months'
            ELSE 'subs_12_months' END AS product,
        CASE WHEN k % 23 <> 0 THEN tsp + to_days(CASE pr WHEN 1 THEN 30 WHEN 2 THEN 90 ELSE 365 END) END
            AS ends,
        CASE WHEN k % 19 <> 0 THEN (price > 450000)::INT END AS trial
        FROM ord WHERE pr <= 3 AND price > 400000""",
    "rewards": """SELECT k, c, tsp AS created,
        CASE WHEN k % 29 <> 0 THEN tsp + to_days((k % 50)::INT) END AS updated,
        CASE WHEN k % 21 <> 0 THEN day(tsp) - 1 END AS cur, k % 3 AS sets,
        CASE WHEN k % 4 = 0 THEN 0 ELSE least(day(tsp), 20) END AS claimed,
        CASE WHEN k % 10 <> 0 THEN tsp + INTERVAL 1 HOUR END AS claim_time,
        CASE WHEN pr = 1 THEN day(tsp) ELSE 0 END AS prem,
        CASE WHEN pr = 5 AND st = 'F' THEN day(tsp) WHEN pr <> 4 THEN 0 END AS ad FROM ord""",
    "items": """SELECT c, l_partkey AS def, tsp AS created, nullif(round_even(l_discount * 100, 0), 0.0) AS critical,
        floor(l_extendedprice) AS attack,
        CASE WHEN l_linenumber <> 7 THEN l_quantity * 1900 END AS defense,
        CASE WHEN l_quantity = 50 THEN round_even(l_tax * 100, 0)
            ELSE least(round_even(l_tax * 100, 0), 2.0) END::INT AS enhance FROM line""",
    "coll": "SELECT c, l_partkey AS def, tsp AS created FROM line WHERE l_quantity <> 13",
    "feedback": """SELECT user_id AS c, event_type AS kind, ts - INTERVAL 8302 DAY AS created
        FROM events""",
    "currency": """SELECT CASE WHEN user_id % 11 = 7 THEN user_id + 1000000000 ELSE user_id END AS c,
        CASE WHEN NOT (event_type = 'error' AND user_id % 10 = 4) THEN event_type END AS concept,
        'coin-' || floor(json_extract_string(props, '$.k')::INT / 25.0)::INT AS currency,
        value - CASE user_id % 3 WHEN 0 THEN 0.0 WHEN 1 THEN 10.0 ELSE 50.0 END AS quantity,
        CASE user_id % 7 WHEN 3 THEN ts - INTERVAL 8247 DAY WHEN 5 THEN ts - INTERVAL 8216 DAY
            WHEN 1 THEN date_trunc('day', ts - INTERVAL 8218 DAY)::TIMESTAMP ELSE ts - INTERVAL 8218 DAY END
            AS created FROM events""",
    "cur_w": """SELECT currency.* FROM currency, tm
        WHERE created >= ref - INTERVAL 30 DAY AND created <= ref""",
    "fights": """SELECT l.l_orderkey AS k, l.l_shipdate + to_hours(l.l_linenumber) AS tsp,
        CASE l_returnflag WHEN 'R' THEN 'FIGHT_TYPE_ARENA' WHEN 'A' THEN 'FIGHT_TYPE_DUNGEON'
            ELSE 'FIGHT_TYPE_TOWER' END AS kind,
        CASE WHEN l_linenumber <> 7 THEN (l_linestatus = 'F')::INT END AS won, l_returnflag AS flag
        FROM lineitem l""",
    "fight_w": """SELECT chars.c, fights.* FROM fights JOIN chars ON chars.k = fights.k, tm
        WHERE tsp >= ref - INTERVAL 30 DAY AND tsp <= ref""",
    "live": """SELECT c_custkey AS c, ((c_custkey * 37 + 11) % 1009) / 1008.0::DOUBLE AS p7,
        ((c_custkey * 53 + 5) % 1009) / 1008.0::DOUBLE AS p14,
        ((c_custkey * 71) % 1009) / 1008.0::DOUBLE AS p30 FROM customer""",
    "oof": """SELECT c,
        least(1.0, greatest(0.0, p7 + move)) AS q7, least(1.0, greatest(0.0, p14 + move)) AS q14,
        least(1.0, greatest(0.0, p30 + move)) AS q30
        FROM (SELECT *, CASE WHEN c % 7 < 4 THEN 0.03125 ELSE -0.34375 END::DOUBLE AS move FROM live)
        WHERE c % 3 <> 0""",
    "arch": """SELECT c_custkey AS c, CASE WHEN c_custkey % 41 <> 0 THEN ((c_custkey * 7) % 6)::INT END
        AS code FROM customer""",
}
NEEDS = {
    "tm": ["ord"], "users": ["ord"], "chars": ["ord"], "devices": ["ord"], "cons": ["line"],
    "subs": ["ord"], "rewards": ["ord"], "items": ["line"], "coll": ["line"],
    "cur_w": ["currency", "tm"], "fight_w": ["fights", "chars", "tm"], "oof": ["live"],
}


def closure(names: list[str], defs: dict[str, str], needs: dict[str, list[str]]) -> list[str]:
    order: list[str] = []

    def visit(n: str) -> None:
        for m in needs.get(n, []):
            visit(m)
        if n not in order:
            order.append(n)

    for n in names:
        visit(n)
    return order
