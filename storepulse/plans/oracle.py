"""Oracle SQL (DuckDB dialect) for each registered query.

Each text inlines the fixture views as CTEs over the pre-registered driver
tables, and names every output column like the Spark query does.
"""

from __future__ import annotations

from .inputs import (AS_OF, BONUS_MIN_LONG, BONUS_MIN_SHORT, DEAL_DISCOUNT, DEAL_MONTHS, DEAL_REQUESTS,
                     PRICE_UPDATE_N, PRICE_UPDATE_SEED)
from ..functions import texts
from ..operators.deals import DEALS_PER_MESSAGE, LONGEST_PERIOD, period_start
from ..sources.logs import REASONS

# Fixture views (FIXTURES.md section 3, products as versions per key).
CTE = {
    "se": """SELECT event_id, ts, CAST(user_id AS VARCHAR) AS user_id, event_type, value,
       'store_' || CAST(k // 20 AS VARCHAR) AS store_id, CAST(k % 20 AS VARCHAR) AS product_id
  FROM (SELECT *, TRY_CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)""",
    "buys": "SELECT store_id, user_id, product_id, ts AS datetime FROM se WHERE event_type = 'purchase'",
    "views": "SELECT store_id, user_id, product_id, ts AS datetime FROM se WHERE event_type = 'view'",
    "purch": """SELECT user_id, store_id, product_id, CAST(value AS FLOAT) AS price, ts AS datetime
  FROM se WHERE event_type = 'purchase'""",
    "prod": """SELECT p_partkey AS id_product, CAST(p_partkey % 20 AS VARCHAR) AS id,
       'store_' || CAST((p_partkey // 20) % 5 AS VARCHAR) AS store_id, p_name AS name,
       CAST(p_retailprice AS DECIMAL(10,2)) AS price FROM part""",
    "cur": """SELECT id_product, id, store_id, name, price FROM (
  SELECT *, row_number() OVER (PARTITION BY id, store_id ORDER BY id_product DESC) AS rn FROM prod) WHERE rn = 1""",
    "stk": """SELECT CAST(l_partkey AS VARCHAR) AS product_id, 'store_' || CAST(l_suppkey % 5 AS VARCHAR) AS store_id,
       CAST(100 - SUM(CAST(l_quantity AS INTEGER)) AS BIGINT) AS quantity FROM lineitem GROUP BY 1, 2""",
    "hist": """SELECT CAST(l_partkey AS VARCHAR) AS product_id, 'store_' || CAST(l_suppkey % 5 AS VARCHAR) AS store_id,
       CAST(CAST((2 * CAST(ROUND(l_extendedprice * 100) AS BIGINT) + CAST(l_quantity AS BIGINT))
                 // (2 * CAST(l_quantity AS BIGINT)) AS DECIMAL(12,0)) * 0.01 AS DECIMAL(10,2)) AS price,
       l_shipdate AS recorded_at FROM lineitem""",
    "cat": """SELECT CAST(p_partkey AS VARCHAR) AS id, 'store_' || CAST(s AS VARCHAR) AS store_id, p_name AS name,
       p_retailprice AS price FROM (SELECT *, unnest(range(5)) AS s FROM part)""",
}
CTE["lr"] = """SELECT CAST(epoch_us(ts) * 1000 AS VARCHAR) AS timestamp,
       CASE WHEN event_type = 'error' THEN 'Error' ELSE store_id END AS store_id,
       CASE WHEN event_type = 'error' THEN CAST(event_id % 6 AS VARCHAR)
            WHEN event_type IN ('signup', 'purchase') THEN 'Audit' ELSE 'User' END AS type,
       CASE WHEN event_type = 'error' THEN NULL ELSE user_id END AS content,
       CASE event_type WHEN 'signup' THEN 'LOGIN' WHEN 'purchase' THEN 'BUY' WHEN 'view' THEN 'ZOOM'
                       WHEN 'click' THEN 'CLICK' END AS extra_1,
       CASE event_type WHEN 'purchase' THEN product_id WHEN 'view' THEN 'VIEW_PRODUCT ' || product_id || '.'
                       WHEN 'click' THEN 'CART with ' || product_id || '.' END AS extra_2
  FROM se"""
CTE["msg"] = """SELECT event_id AS id, CASE WHEN event_type = 'error'
         THEN CAST(epoch_us(ts) * 1000 AS VARCHAR) || ';Error;' || CAST(event_id % 6 AS VARCHAR)
         ELSE CAST(epoch_us(ts) * 1000 AS VARCHAR) || ';' || store_id || ';User;' || user_id || ';' ||
              CASE event_type WHEN 'signup' THEN 'SCROLLING;HOME.'
                              WHEN 'view' THEN 'ZOOM;VIEW_PRODUCT ' || product_id || '.'
                              WHEN 'click' THEN 'CLICK;CART with ' || product_id || '.'
                              WHEN 'purchase' THEN 'CLICK;BUY-' || product_id || '-' || CAST(value AS VARCHAR) || '.' END
       END || chr(10) AS message FROM se"""
CTE["pe"] = """SELECT id, p[1] AS timestamp, CASE WHEN p[2] <> 'Error' THEN p[2] END AS store_id,
       CASE WHEN p[2] = 'Error' THEN 'error' ELSE p[3] END AS type, p[4] AS user_id, p[5] AS action,
       CASE WHEN p[2] = 'Error' THEN p[3] ELSE p[6] END AS details, make_timestamp(TRY_CAST(p[1] AS BIGINT) // 1000) AS datetime
  FROM (SELECT id, string_split(rtrim(message, chr(10)), ';') AS p FROM msg)"""
CTE["bd"] = """SELECT id, user_id, store_id, string_split(details, '-')[2] AS product_id,
       TRY_CAST(regexp_replace(string_split(details, '-')[3], '[\\s.]+$', '') AS FLOAT) AS price, datetime
  FROM pe WHERE starts_with(details, 'BUY')"""
DEPS = {"buys": ["se"], "views": ["se"], "purch": ["se"], "cur": ["prod"], "lr": ["se"], "msg": ["se"],
        "pe": ["msg"], "bd": ["pe"]}


def with_ctes(names: list[str], extra: list[tuple[str, str]], select: str) -> str:
    order: list[str] = []

    def add(n):
        for d in DEPS.get(n, []):
            add(d)
        if n not in order:
            order.append(n)
    for n in names:
        add(n)
    parts = [f"{n} AS ({CTE[n]})" for n in order] + [f"{n} AS ({sql})" for n, sql in extra]
    return "WITH " + ",\n".join(parts) + "\n" + select


def _store_all() -> str:
    return "CASE WHEN GROUPING(store_id) = 1 THEN 'All' ELSE store_id END AS store_id"


def _win(interval: str) -> tuple[str, str]:
    return (f"time_bucket(INTERVAL {interval}, datetime)",
            f"CAST(w AS VARCHAR) AS window_start, w + INTERVAL {interval} AS window_end")


def _ppm_sql(interval: str = "1 MINUTE") -> str:
    b, out = _win(interval)
    return (f"SELECT {out}, {_store_all()}, COUNT(*) AS count "
            f"FROM (SELECT {b} AS w, store_id FROM buys) GROUP BY GROUPING SETS ((w, store_id), (w))")


def _view_join(interval: str, cols: str) -> str:
    return (f"SELECT time_bucket(INTERVAL {interval}, v.datetime) AS w, v.store_id, v.user_id, {cols} "
            f"FROM views v LEFT JOIN cur c ON v.product_id = c.id AND v.store_id = c.store_id")


def _vrh_sql() -> str:
    _, out = _win("1 HOUR")
    return (f"SELECT {out}, name, {_store_all()}, COUNT(*) AS views FROM ({_view_join('1 HOUR', 'c.name')}) "
            f"GROUP BY GROUPING SETS ((w, name, store_id), (w, name))")


def _unique_sql(interval: str, distinct_all: bool) -> str:
    _, out = _win(interval)
    if distinct_all:
        return (f"SELECT {out}, name, {_store_all()}, COUNT(DISTINCT user_id) AS unique_users "
                f"FROM ({_view_join(interval, 'c.name')}) GROUP BY GROUPING SETS ((w, name, store_id), (w, name))")
    return (f"SELECT {out}, name, {_store_all()}, COUNT(*) AS unique_users "
            f"FROM (SELECT DISTINCT w, name, store_id, user_id FROM ({_view_join(interval, 'c.name')})) "
            f"GROUP BY GROUPING SETS ((w, name, store_id), (w, name))")


def _vbb_sql() -> str:
    return ("SELECT views, " + _store_all() + ", COUNT(*) AS count FROM ("
            "SELECT b.store_id, COALESCE(vc.views, 0) AS views FROM buys b LEFT JOIN "
            "(SELECT user_id, product_id, store_id, COUNT(*) AS views FROM views GROUP BY ALL) vc "
            "ON b.user_id = vc.user_id AND b.product_id = vc.product_id AND b.store_id = vc.store_id) "
            "GROUP BY GROUPING SETS ((views, store_id), (views))")


def _deals_sql(discount: float = DEAL_DISCOUNT) -> str:
    start = period_start(AS_OF, DEAL_MONTHS)
    factor = 1 - discount / 100
    return (f"SELECT c.id AS product_id, c.name, c.store_id, c.price, a.avg_price FROM cat c JOIN "
            f"(SELECT product_id, store_id, {_exact_avg('price')} AS avg_price FROM hist "
            f"WHERE recorded_at >= TIMESTAMP '{start:%Y-%m-%d %H:%M:%S}' GROUP BY ALL) a "
            f"ON c.id = a.product_id AND c.store_id = a.store_id WHERE c.price < a.avg_price * {factor!r}")


def _price_update_sql() -> str:
    return (f"SELECT c.id_product, c.id, c.store_id, c.name, CASE WHEN pc.cents IS NULL THEN c.price ELSE "
            f"GREATEST(CAST(1 AS DECIMAL(10,2)), CAST(c.price + CAST(pc.cents / 100 AS DECIMAL(10,2)) AS DECIMAL(10,2))) END AS price "
            f"FROM prod c LEFT JOIN (SELECT id_product, (CAST('0x' || substr(h, 1, 8) AS BIGINT) % 110001) - 10000 AS cents "
            f"FROM (SELECT id_product, md5(CAST(id_product AS VARCHAR) || ':' || '{PRICE_UPDATE_SEED}') AS h FROM prod "
            f"ORDER BY h LIMIT {PRICE_UPDATE_N})) pc ON c.id_product = pc.id_product")


_SPEND = "CAST(CAST(price AS DOUBLE) AS DECIMAL(20,6))"


def _bonus_totals_sql() -> str:
    parts = []
    for h, iv in (("10m", "10 MINUTE"), ("6h", "6 HOUR")):
        parts.append(f"SELECT '{h}' AS horizon, CAST(w AS VARCHAR) AS window_start, w + INTERVAL {iv} AS window_end, "
                     f"user_id, store_id, CAST(SUM({_SPEND}) AS DOUBLE) AS total "
                     f"FROM (SELECT time_bucket(INTERVAL {iv}, datetime) AS w, user_id, store_id, price FROM purch) "
                     f"GROUP BY w, user_id, store_id")
    return " UNION ALL ".join(parts)


def _bonus_eligible_sql() -> str:
    c6 = f"COUNT(*) FILTER (WHERE horizon = '6h' AND total > {BONUS_MIN_LONG!r})"
    c10 = f"COUNT(*) FILTER (WHERE horizon = '10m' AND total > {BONUS_MIN_SHORT!r})"
    return (f"SELECT user_id, store_id, {c6} AS windows_6h, {c10} AS windows_10m, {c6} * {c10} AS pairs "
            f"FROM ({_bonus_totals_sql()}) GROUP BY user_id, store_id HAVING {c6} > 0 AND {c10} > 0")


def _exact_avg(x: str) -> str:
    """Average of a DECIMAL(10,2) column, half-up at 6 decimals, from integer cents."""
    return (f"CAST((CAST(SUM({x}) * 100 AS HUGEINT) * 20000 + COUNT({x})) // (2 * COUNT({x})) AS DOUBLE) / 1000000")


def _sql_text(t: str) -> str:
    """A fixed text as the body of a SQL string literal."""
    return t.replace("'", "''")


def _money(x: str) -> str:
    return (f"CASE WHEN {x} IS NULL THEN 'N/A' ELSE "
            f"CAST(CAST(ROUND(CAST({x} AS DECIMAL(20,6)), 2) AS DECIMAL(20,2)) AS VARCHAR) END")


def _ts(t) -> str:
    return f"TIMESTAMP '{t:%Y-%m-%d %H:%M:%S}'"


def build() -> dict[str, str]:
    from .queries import FIRST_NEW_CYCLE, LATE_EVERY, PASS_DAYS, REJECT_EVERY, REWRITTEN, SCAN_FROM, SCAN_STORE, STOCK_DAYS
    q: dict[str, str] = {}
    b1, out1 = _win("1 MINUTE")
    q["purchases_per_minute"] = with_ctes(["buys"], [], _ppm_sql())
    q["revenue_per_minute"] = with_ctes(["views", "cur"], [], (
        f"SELECT {out1}, {_store_all()}, CAST(SUM(FLOOR(price)) AS BIGINT) AS amount_earned "
        f"FROM ({_view_join('1 MINUTE', 'c.price')}) GROUP BY GROUPING SETS ((w, store_id), (w))"))
    q["revenue_from_buys"] = with_ctes(["buys", "cur"], [], (
        f"SELECT {out1}, {_store_all()}, CAST(SUM(price) AS DOUBLE) AS amount_earned FROM ("
        f"SELECT time_bucket(INTERVAL 1 MINUTE, b.datetime) AS w, b.store_id, c.price FROM buys b "
        f"LEFT JOIN cur c ON b.product_id = c.id AND b.store_id = c.store_id) GROUP BY GROUPING SETS ((w, store_id), (w))"))
    q["unique_users_per_minute"] = with_ctes(["views", "cur"], [], _unique_sql("1 MINUTE", False))
    q["unique_users_per_day"] = with_ctes(["views", "cur"], [], _unique_sql("1 DAY", False))
    q["unique_users_distinct_all"] = with_ctes(["views", "cur"], [], _unique_sql("1 DAY", True))
    q["view_ranking_per_hour"] = with_ctes(["views", "cur"], [], _vrh_sql())
    q["views_before_buy"] = with_ctes(["buys", "views"], [], _vbb_sql())
    q["sold_without_stock"] = with_ctes(["stk"], [("ps", "SELECT store_id, COUNT(*) AS products_sold_without_stock "
                                                         "FROM stk WHERE quantity < 0 GROUP BY store_id")],
                                        "SELECT store_id, products_sold_without_stock FROM ps UNION ALL "
                                        "SELECT 'All', CAST(SUM(products_sold_without_stock) AS BIGINT) FROM ps")
    q["in_stock"] = with_ctes(["stk"], [], "SELECT product_id, store_id, quantity FROM stk WHERE quantity > 0")
    hist_cum = ("SELECT store_id, views, count, SUM(count) OVER (PARTITION BY store_id ORDER BY views "
                "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum, SUM(count) OVER (PARTITION BY store_id) AS total FROM h")
    q["median_views_ref"] = with_ctes(["buys", "views"], [("h", _vbb_sql()), ("r", hist_cum)], (
        "SELECT store_id, MIN(CASE WHEN cum >= total // 2 THEN views END) AS median_views, MIN(views) AS min_views, "
        "MAX(views) AS max_views, CAST(ANY_VALUE(total) AS BIGINT) AS total_buys FROM r GROUP BY store_id"))
    q["median_views"] = with_ctes(["buys", "views"], [("h", _vbb_sql()), ("r", hist_cum)], (
        "SELECT store_id, CAST(lo + (hi - lo) * (pos - FLOOR(pos)) AS DOUBLE) AS median_views FROM ("
        "SELECT store_id, ANY_VALUE((total - 1) * 0.5) AS pos, "
        "MIN(CASE WHEN cum > FLOOR((total - 1) * 0.5) THEN views END) AS lo, "
        "MIN(CASE WHEN cum > CEIL((total - 1) * 0.5) THEN views END) AS hi FROM r GROUP BY store_id)"))
    last = "SELECT store_id, MAX(window_end) AS m FROM ppm GROUP BY store_id"
    q["last_window"] = with_ctes(["buys"], [("ppm", _ppm_sql()), ("l", last)],
                                 "SELECT p.* FROM ppm p JOIN l ON p.store_id = l.store_id WHERE p.window_end = l.m")
    q["older_windows"] = with_ctes(["buys"], [("ppm", _ppm_sql()), ("l", last)],
                                   "SELECT p.* FROM ppm p JOIN l ON p.store_id = l.store_id WHERE p.window_end < l.m")
    q["top10_viewed"] = with_ctes(["views", "cur"], [
        ("vr", _vrh_sql()), ("l", "SELECT store_id, MAX(window_end) AS m FROM vr GROUP BY store_id")], (
        "SELECT store_id, rank, name, views, window_start, window_end FROM ("
        "SELECT v.*, CAST(row_number() OVER (PARTITION BY v.store_id ORDER BY v.views DESC NULLS LAST, "
        "v.name ASC NULLS FIRST) AS INTEGER) AS rank FROM vr v JOIN l ON v.store_id = l.store_id "
        "WHERE v.window_end = l.m) WHERE rank <= 10"))
    q["merge_partials"] = with_ctes(["buys"], [], _ppm_sql("1 DAY"))
    q["merge_unique_users"] = q["unique_users_per_day"]
    q["unique_users_bitmaps"] = q["unique_users_per_day"]
    rev = (f"SELECT {out1}, {_store_all()}, CAST(SUM(FLOOR(price)) AS BIGINT) AS amount_earned "
           f"FROM ({_view_join('1 MINUTE', 'c.price')}) GROUP BY GROUPING SETS ((w, store_id), (w))")
    q["metrics_incremental"] = with_ctes(["buys", "views", "cur"], [("a", _ppm_sql()), ("b", rev), ("c", _vrh_sql())], (
        "SELECT 'purchases' AS metric, window_start, window_end, store_id, CAST(NULL AS VARCHAR) AS name, count AS value FROM a UNION ALL "
        "SELECT 'revenue', window_start, window_end, store_id, NULL, amount_earned FROM b UNION ALL "
        "SELECT 'views', window_start, window_end, store_id, name, views FROM c"))
    own = f"CASE WHEN day(ts) < {PASS_DAYS[0]} THEN 0 WHEN day(ts) < {PASS_DAYS[1]} THEN 1 ELSE 2 END"
    q["metrics_late"] = with_ctes(["buys"], [
        ("a", _ppm_sql()),
        ("e", f"SELECT *, least({own} + CASE WHEN event_id % {LATE_EVERY} = 0 THEN 1 ELSE 0 END, 2) AS arrives FROM se "
              "WHERE event_type IN ('view', 'purchase')"),
        ("m", "SELECT arrives + 1 AS p, MAX(ts) AS newest FROM e GROUP BY arrives"),
        ("k", "SELECT p, MAX(newest) OVER (ORDER BY p) AS newest FROM m"),
        ("f", "SELECT DISTINCT CAST(time_bucket(INTERVAL 1 MINUTE, ts) AS VARCHAR) AS s FROM e JOIN k ON p = arrives "
              "WHERE ts < newest - INTERVAL 10 MINUTE AND event_type = 'purchase'")], (
        "SELECT a.*, window_start IN (SELECT s FROM f) AS corrected FROM a"))
    q["store_list"] = with_ctes(["se"], [], "SELECT DISTINCT store_id FROM se")

    q["current_products"] = with_ctes(["cur"], [], "SELECT id_product, id, store_id, name, price FROM cur")
    q["order_rollup"] = with_ctes(["buys"], [
        ("o", "SELECT *, CASE WHEN datetime < lag(datetime) OVER k + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM buys "
              "WINDOW k AS (PARTITION BY user_id, product_id, store_id ORDER BY datetime)"),
        ("n", "SELECT *, SUM(fresh) OVER (PARTITION BY user_id, product_id, store_id ORDER BY datetime "
              "RANGE UNBOUNDED PRECEDING) AS order_no FROM o")], (
        "SELECT user_id, product_id, store_id, MIN(datetime) AS ordered_at, COUNT(*) AS quantity FROM n "
        "GROUP BY user_id, product_id, store_id, order_no"))
    sales = "SELECT product_id, store_id, COUNT(*) AS sold FROM buys GROUP BY ALL"
    q["stock_after_sales"] = with_ctes(["stk", "buys"], [("d", sales)], (
        "SELECT s.product_id, s.store_id, s.quantity - COALESCE(d.sold, 0) AS quantity FROM stk s "
        "LEFT JOIN d ON s.product_id = d.product_id AND s.store_id = d.store_id"))
    q["stock_merge"] = q["stock_after_sales"]
    cut = STOCK_DAYS[0]
    q["stock_merge_changes"] = with_ctes(["stk", "buys"], [
        ("d", f"SELECT product_id, store_id, COUNT(*) FILTER (WHERE day(datetime) < {cut}) AS a, COUNT(*) FILTER (WHERE day(datetime) >= {cut}) AS b "
              "FROM buys GROUP BY ALL"),
        ("j", "SELECT s.product_id, s.store_id, s.quantity, d.a, d.b FROM stk s JOIN d ON s.product_id = d.product_id AND s.store_id = d.store_id")], (
        "SELECT product_id, store_id, quantity AS before, quantity - a AS after, 0 AS batch FROM j WHERE a > 0 UNION ALL "
        "SELECT product_id, store_id, quantity - a, quantity - a - b, 1 FROM j WHERE b > 0"))
    q["unmatched_sales"] = with_ctes(["stk", "buys"], [("d", sales)], (
        "SELECT d.product_id, d.store_id, d.sold FROM d ANTI JOIN stk s "
        "ON s.product_id = d.product_id AND s.store_id = d.store_id"))
    q["price_update"] = with_ctes(["prod"], [], _price_update_sql())
    q["price_merge"] = with_ctes(["prod"], [("nw", _price_update_sql())], (
        f"SELECT n.id_product, n.id, n.store_id, n.name, n.price, CASE WHEN n.price <> o.price THEN {_ts(AS_OF)} END AS recorded_at "
        "FROM nw n JOIN prod o ON n.id_product = o.id_product"))
    q["price_changes"] = with_ctes(["prod"], [("nw", _price_update_sql())], (
        f"SELECT n.id AS product_id, n.price, n.store_id, {_ts(AS_OF)} AS recorded_at FROM nw n "
        f"JOIN prod o ON n.id_product = o.id_product WHERE n.price <> o.price"))
    q["price_snapshot"] = with_ctes(["cur"], [], f"SELECT id AS product_id, price, store_id, {_ts(AS_OF)} AS recorded_at FROM cur")

    q["price_deals"] = with_ctes(["cat", "hist"], [("d", _deals_sql())],
                                 "SELECT product_id, name, store_id, price, avg_price AS average_price FROM d")
    values = ", ".join(f"({n}, '{v}')" for n, v in enumerate(DEAL_REQUESTS))
    q["deal_requests"] = with_ctes(["cat", "hist"], [
        ("raw", f"SELECT * FROM (VALUES {values}) t(request_id, value)"),
        ("req", "SELECT request_id, CAST(json_extract(value, '$.time_window') AS INTEGER) AS months, "
                "CAST(json_extract(value, '$.discount_percentage') AS DOUBLE) AS discount FROM raw"),
        ("a", f"SELECT r.request_id, r.months, r.discount, h.product_id, h.store_id, {_exact_avg('h.price')} AS avg_price "
              f"FROM hist h JOIN req r ON h.recorded_at >= {_ts(AS_OF)} - LEAST(r.months, {LONGEST_PERIOD}) * 30 * INTERVAL 1 DAY "
              f"WHERE r.discount > 0 AND r.months BETWEEN 1 AND {LONGEST_PERIOD} GROUP BY ALL")], (
        "SELECT a.request_id, a.months, a.discount, c.id AS product_id, c.name, c.store_id, c.price, "
        "a.avg_price AS average_price FROM cat c JOIN a ON c.id = a.product_id AND c.store_id = a.store_id "
        "WHERE c.price < a.avg_price * (1 - a.discount / 100)"))

    q["bonus_totals"] = with_ctes(["purch"], [], _bonus_totals_sql())
    q["bonus_eligible"] = with_ctes(["purch"], [], _bonus_eligible_sql())
    q["bonus_contained"] = with_ctes(["purch"], [
        ("s", "SELECT time_bucket(INTERVAL 10 MINUTE, datetime) AS s, user_id, store_id, "
              f"SUM({_SPEND}) AS total_10m FROM purch GROUP BY ALL"),
        ("l", f"SELECT time_bucket(INTERVAL 6 HOUR, s) AS l, user_id, store_id, SUM(total_10m) AS total_6h, "
              f"COUNT(*) FILTER (WHERE total_10m > {BONUS_MIN_SHORT!r}) AS windows_10m FROM s GROUP BY ALL")], (
        f"SELECT user_id, store_id, CAST(l AS VARCHAR) AS window_start, l + INTERVAL 6 HOUR AS window_end, "
        f"CAST(total_6h AS DOUBLE) AS total_6h, windows_10m FROM l WHERE total_6h > {BONUS_MIN_LONG!r} AND windows_10m > 0"))
    def best(step_us, k, name):
        return (f"SELECT user_id, store_id, MAX(win) AS {name} FROM (SELECT user_id, store_id, SUM(s) OVER ("
                f"PARTITION BY user_id, store_id ORDER BY b RANGE BETWEEN {k - 1} PRECEDING AND CURRENT ROW) AS win "
                f"FROM (SELECT user_id, store_id, epoch_us(datetime) // {step_us} AS b, "
                f"SUM({_SPEND}) AS s FROM purch GROUP BY ALL)) GROUP BY ALL")
    q["bonus_sliding"] = with_ctes(["purch"], [("a", best(60_000_000, 10, "best_10m")),
                                               ("c", best(600_000_000, 36, "best_6h"))], (
        f"SELECT a.user_id, a.store_id, CAST(a.best_10m AS DOUBLE) AS best_10m, CAST(c.best_6h AS DOUBLE) AS best_6h FROM a JOIN c "
        f"ON a.user_id = c.user_id AND a.store_id = c.store_id "
        f"WHERE a.best_10m > {BONUS_MIN_SHORT!r} AND c.best_6h > {BONUS_MIN_LONG!r}"))
    q["bonus_messages"] = with_ctes(["purch"], [("e", _bonus_eligible_sql())], (
        "SELECT CAST(json_object('user_id', user_id, 'store_id', store_id) AS VARCHAR) AS value, "
        f"printf('{texts.COUPON_LINE}', user_id, store_id) AS line FROM e"))
    q["coupon_lines"] = with_ctes(["purch"], [("e", _bonus_eligible_sql())], (
        f"SELECT user_id, store_id, printf('{texts.COUPON_LINE}', user_id, store_id) AS line FROM e"))
    q["bonus_count"] = with_ctes(["purch"], [("e", _bonus_eligible_sql())], "SELECT COUNT(*) AS eligible_users FROM e")
    q["views_strictly_before_buy"] = with_ctes(["buys", "views"], [], (
        "SELECT views, " + _store_all() + ", COUNT(*) AS count FROM (SELECT b.store_id, (SELECT COUNT(*) FROM views v "
        "WHERE v.user_id = b.user_id AND v.product_id = b.product_id AND v.store_id = b.store_id "
        "AND v.datetime < b.datetime) AS views FROM buys b) GROUP BY GROUPING SETS ((views, store_id), (views))"))
    q["log_scan"] = with_ctes(["lr"], [], (
        "SELECT timestamp, store_id, type, content, extra_1, extra_2, "
        "make_timestamp(TRY_CAST(timestamp AS BIGINT) // 1000) AS datetime FROM lr"))
    q["event_split"] = with_ctes(["lr"], [], (
        "SELECT 'buy' AS kind, store_id, content AS user_id, extra_2 AS product_id, "
        "make_timestamp(TRY_CAST(timestamp AS BIGINT) // 1000) AS datetime FROM lr WHERE type = 'Audit' AND extra_1 = 'BUY' "
        "UNION ALL SELECT 'view', store_id, content, regexp_replace(replace(extra_2, 'VIEW_PRODUCT ', ''), '\\.$', ''), "
        "make_timestamp(TRY_CAST(timestamp AS BIGINT) // 1000) FROM lr WHERE type = 'User' AND extra_1 = 'ZOOM'"))
    q["csv_round_trip"] = with_ctes(["lr"], [], "SELECT timestamp, store_id, type, content, extra_1, extra_2 FROM lr")
    q["new_files"] = with_ctes(["lr"], [], (
        "SELECT DISTINCT store_id AS store, strftime(make_timestamp(TRY_CAST(timestamp AS BIGINT) // 1000), '%Y-%m-%d') AS cycle "
        "FROM lr WHERE make_timestamp(TRY_CAST(timestamp AS BIGINT) // 1000) >= TIMESTAMP '2024-01-20 00:00:00'"))
    day = "strftime(make_timestamp(TRY_CAST(timestamp AS BIGINT) // 1000), '%Y-%m-%d')"
    q["new_files_passes"] = with_ctes(["lr"], [("c", f"SELECT DISTINCT store_id AS store, {day} AS cycle FROM lr")], (
        f"SELECT store, cycle, 0 AS pass FROM c WHERE cycle < '{FIRST_NEW_CYCLE}' UNION ALL "
        f"SELECT store, cycle, 1 FROM c WHERE cycle < '{FIRST_NEW_CYCLE}' UNION ALL "
        f"SELECT store, cycle, 2 FROM c WHERE cycle >= '{FIRST_NEW_CYCLE}' OR (store = '{REWRITTEN[0]}' AND cycle = '{REWRITTEN[1]}')"))
    q["log_scan_store"] = with_ctes(["lr"], [], (
        f"SELECT timestamp, store_id, type, content, extra_1, extra_2, store_id AS store, {day} AS cycle, "
        "make_timestamp(TRY_CAST(timestamp AS BIGINT) // 1000) AS datetime FROM lr "
        f"WHERE store_id = '{SCAN_STORE}' AND {day} >= '{SCAN_FROM}'"))
    q["log_rejects"] = with_ctes(["se"], [("b", (
        f"SELECT *, (event_id // {REJECT_EVERY}) % 3 AS kind, CAST(epoch_us(ts) * 1000 AS VARCHAR) AS t FROM se WHERE event_id % {REJECT_EVERY} = 0"))], (
        f"SELECT t || ';' || store_id AS line, '{REASONS[0]}' AS reason FROM b WHERE kind = 0 UNION ALL "
        f"SELECT t || ';' || store_id || ';Audit;' || user_id || ';BUY;7;x', '{REASONS[1]}' FROM b WHERE kind = 1 UNION ALL "
        f"SELECT 'at ' || event_id || ';' || store_id || ';Audit;' || user_id || ';BUY;7', '{REASONS[2]}' FROM b WHERE kind = 2 UNION ALL "
        "SELECT CAST(COUNT(*) AS VARCHAR), 'accepted' FROM se"))
    q["batch_message"] = with_ctes(["msg"], [], (
        "SELECT id // 100 AS chunk, CAST(to_json(list(message ORDER BY id)) AS VARCHAR) AS message FROM msg GROUP BY id // 100"))
    q["log_purchases_per_minute"] = q["purchases_per_minute"]
    q["ingest"] = with_ctes(["msg"], [], "SELECT id, message FROM msg")
    q["parse_events"] = with_ctes(["pe"], [], "SELECT * FROM pe")
    q["buy_details"] = with_ctes(["bd"], [], "SELECT * FROM bd")
    q["bonus_from_messages"] = with_ctes(["bd"], [("purch", "SELECT user_id, store_id, product_id, price, datetime FROM bd")],
                                         _bonus_eligible_sql())
    trans = ("SELECT src, dst, n, n / SUM(n) OVER (PARTITION BY src) AS prob FROM (SELECT src, dst, COUNT(*) AS n FROM ("
             "SELECT {s} AS src, lead({s}) OVER (PARTITION BY store_id, user_id ORDER BY ts, event_id) AS dst FROM se) "
             "WHERE dst IS NOT NULL GROUP BY ALL)")
    q["flow_transitions"] = with_ctes(["se"], [], trans.format(s="event_type"))
    from ..operators.flow import EVENT_NODE, REFERENCE_EDGES
    node = "CASE event_type " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in EVENT_NODE) + " END"
    edges = ", ".join(f"('{a}', '{b}', {p!r})" for a, b, p in REFERENCE_EDGES)
    q["flow_drift"] = with_ctes(["se"], [("seen", trans.format(s=node)),
                                         ("expected", f"SELECT src, dst, CAST(p AS DOUBLE) AS expected_prob FROM (VALUES {edges}) t(src, dst, p)")], (
        "SELECT COALESCE(e.src, s.src) AS src, COALESCE(e.dst, s.dst) AS dst, e.expected_prob, s.n AS seen_n, "
        "s.prob AS seen_prob FROM expected e FULL OUTER JOIN seen s ON e.src = s.src AND e.dst = s.dst"))
    _add_insight_sql(q)
    return q


def _last_sql(src: str) -> str:
    return (f"SELECT p.* FROM {src} p JOIN (SELECT store_id, MAX(window_end) AS m FROM {src} GROUP BY store_id) l "
            f"ON p.store_id = l.store_id WHERE p.window_end = l.m")


def _task_ctes() -> list[tuple[str, str]]:
    b, out = _win("1 MINUTE")
    rev = (f"SELECT {out}, {_store_all()}, CAST(SUM(FLOOR(price)) AS BIGINT) AS amount_earned "
           f"FROM ({_view_join('1 MINUTE', 'c.price')}) GROUP BY GROUPING SETS ((w, store_id), (w))")
    sws = ("SELECT store_id, products_sold_without_stock FROM (SELECT store_id, COUNT(*) AS products_sold_without_stock "
           "FROM stk WHERE quantity < 0 GROUP BY store_id) UNION ALL SELECT 'All', CAST(SUM(n) AS BIGINT) FROM "
           "(SELECT COUNT(*) AS n FROM stk WHERE quantity < 0 GROUP BY store_id)")
    return [("ppm", _ppm_sql()), ("t1", _last_sql("ppm")), ("rv", rev), ("t2", _last_sql("rv")),
            ("uu", _unique_sql("1 MINUTE", False)), ("t3", _last_sql("uu")),
            ("vr", _vrh_sql()), ("t4", _last_sql("vr")), ("t5", _vbb_sql()), ("t6", sws)]


# task name, source CTE, detail fields, order inside a store
_TASKS = [
    ("purchases_per_minute", "t1", ["count", "window_start", "window_end"], "window_start"),
    ("revenue_per_minute", "t2", ["amount_earned", "window_start", "window_end"], "window_start"),
    ("unique_users_per_minute", "t3", ["name", "unique_users", "window_start", "window_end"],
     "unique_users DESC NULLS LAST, name ASC NULLS FIRST"),
    ("ranking_viewed_products_per_hour", "t4", ["name", "views", "window_start", "window_end"],
     "views DESC NULLS LAST, name ASC NULLS FIRST"),
    ("median_views_before_buy", "t5", ["count", "views"], "views ASC"),
    ("without_stock", "t6", ["products_sold_without_stock"], "store_id ASC"),
]


def _payload_sql(task: str, src: str, fields: list[str], order: str, keys: str = "store_id") -> str:
    obj = ", ".join(f"'{f}', " + (f"CAST({f} AS VARCHAR)" if f == "window_end" else f) for f in fields)
    return (f"SELECT '{task}' AS task_name, {keys}, '{{' || string_agg('\"' || CAST(rk AS VARCHAR) || '\":' || "
            f"CAST(json_object({obj}) AS VARCHAR), ',' ORDER BY rk) || '}}' AS payload FROM ("
            f"SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY {order}) - 1 AS rk FROM {src})"
            + ("" if task == "median_views_before_buy" else " WHERE rk < 10") + f" GROUP BY {keys}")


def _add_insight_sql(q: dict[str, str]) -> None:
    base = ["buys", "views", "cur", "stk"]
    payload = " UNION ALL ".join(_payload_sql(*t) for t in _TASKS)
    q["insight_payload"] = with_ctes(base, _task_ctes(), payload)
    q["store_pass"] = with_ctes(base, _task_ctes() + [("pl", payload)], (
        "SELECT task_name, '{\"task_name\":\"' || task_name || '\"' || "
        "string_agg(',\"' || store_id || '\":' || payload, '' ORDER BY store_id) || '}' AS message FROM pl GROUP BY task_name"))
    q["task_messages_decoded"] = q["insight_payload"]
    q["log_store_pass"] = q["insight_payload"]
    q["insight_decode"] = with_ctes(base, _task_ctes() + [("pl", payload)], (
        "SELECT task_name, store_id, CAST(k AS INTEGER) AS rank, "
        "CAST(json_extract(payload, '$.\"' || k || '\"') AS VARCHAR) AS detail "
        "FROM (SELECT task_name, store_id, payload, unnest(json_keys(payload)) AS k FROM pl)"))
    q["latest_insight"] = with_ctes(["buys"], [("ppm", _ppm_sql()), ("t1", _last_sql("ppm"))], (
        "SELECT task_name, store_id, payload, window_end FROM ("
        + _payload_sql("purchases_per_minute", "t1", ["count", "window_start", "window_end"], "window_start",
                       keys="store_id, window_end") + ")"))
    we = "CAST(window_end AS VARCHAR)"
    hist_cum = ("SELECT store_id, views, count, SUM(count) OVER (PARTITION BY store_id ORDER BY views "
                "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum, SUM(count) OVER (PARTITION BY store_id) AS total FROM t5")
    med = ("SELECT store_id, MIN(CASE WHEN cum >= total // 2 THEN views END) AS m, MIN(views) AS lo, MAX(views) AS hi, "
           "ANY_VALUE(total) AS total FROM r GROUP BY store_id")

    def ranking(src, task, header, line, metric):
        rk = (f"SELECT *, CAST(row_number() OVER (PARTITION BY store_id ORDER BY {metric} DESC NULLS LAST, "
              f"name ASC NULLS FIRST) AS INTEGER) AS rank FROM {src}")
        return (f"SELECT store_id, '{task}' AS task, 0 AS line_no, printf('{header}', window_start, {we}) "
                f"FROM ({rk}) WHERE rank = 1 UNION ALL "
                f"SELECT store_id, '{task}', rank, printf('{line}', rank, COALESCE(name, '{texts.MISSING_NAME}'), {metric}) "
                f"FROM ({rk}) WHERE rank <= 10")
    lines = [
        f"SELECT store_id, 'purchases_per_minute' AS task, 0 AS line_no, "
        f"printf('{texts.PURCHASES_LINE}', window_start, {we}, CAST(count AS VARCHAR)) AS line FROM t1",
        f"SELECT store_id, 'revenue_per_minute', 0, printf('{texts.REVENUE_LINE}', window_start, {we}, "
        f"{_money('amount_earned')}) FROM t2",
        ranking("t3", "unique_users_per_minute", texts.UNIQUE_USERS_HEADER, texts.UNIQUE_USERS_LINE, "unique_users"),
        ranking("t4", "ranking_viewed_products_per_hour", texts.MOST_VIEWED_HEADER, texts.MOST_VIEWED_LINE, "views"),
        f"SELECT store_id, 'median_views_before_buy', 0, printf('{texts.MEDIAN_LINE}', m, lo, hi, total) FROM med",
        f"SELECT store_id, 'without_stock', 0, printf('{texts.WITHOUT_STOCK_LINE}', "
        f"COALESCE(CAST(products_sold_without_stock AS VARCHAR), '0')) FROM t6",
    ]
    tasks = ", ".join(f"('{t[0]}')" for t in _TASKS)
    q["store_report"] = with_ctes(base, _task_ctes() + [("r", hist_cum), ("med", med), ("rp", (
        "SELECT store_id, task, CAST(line_no AS INTEGER) AS line_no, line FROM (" + " UNION ALL ".join(lines) + ")"))], (
        f"SELECT * FROM rp UNION ALL SELECT s.store_id, t.task, 0, 'No data available.' FROM "
        f"(SELECT DISTINCT store_id FROM rp) s CROSS JOIN (VALUES {tasks}) t(task) "
        "WHERE NOT EXISTS (SELECT 1 FROM rp WHERE rp.store_id = s.store_id AND rp.task = t.task)"))
    q["store_report_one"] = "SELECT * FROM (" + q["store_report"] + ") WHERE store_id = 'store_2'"
    head = ("SELECT 0 AS section, CAST(NULL AS DOUBLE) AS evaluated_discount, "
            f"printf('{texts.DEALS_HEADER}', {DEAL_MONTHS}, '{{d}}', '{AS_OF:%Y-%m-%d %H:%M:%S}') AS line")
    body = ("SELECT 1 AS section, ROUND((avg_price - price) / avg_price * 100, 6) AS evaluated_discount, "
            f"printf('{_sql_text(texts.DEAL_LINE)}', name, product_id, "
            f"{_money('avg_price')}, {_money('price')}, {_money('(avg_price - price) / avg_price * 100')}, "
            "store_id) AS line FROM d")
    none = (f"SELECT 2 AS section, CAST(NULL AS DOUBLE) AS evaluated_discount, '{texts.NO_DEALS}' AS line "
            "FROM (SELECT COUNT(*) AS n FROM d) WHERE n = 0")
    q["deal_report"] = with_ctes(["cat", "hist"], [("d", _deals_sql())],
                                 " UNION ALL ".join([head.format(d=DEAL_DISCOUNT), body, none]))
    q["deal_report_empty"] = with_ctes(["cat", "hist"], [("d", _deals_sql(100.0))],
                                       " UNION ALL ".join([head.format(d=100.0), body.replace(
                                           "ROUND((avg_price - price) / avg_price * 100, 6)",
                                           "(avg_price - price) / avg_price * 100"), none]))
    entry = ("CAST(json_object('id', product_id, 'name', name, 'store_id', store_id, "
             "'price', CAST(CAST(price AS DECIMAL(10,2)) AS VARCHAR), "
             "'average_price', CAST(CAST(avg_price AS DECIMAL(20,6)) AS VARCHAR)) AS VARCHAR)")
    rank = "row_number() OVER (ORDER BY (avg_price - price) / avg_price * 100 DESC, product_id, store_id)"
    q["deal_messages"] = with_ctes(["cat", "hist"], [
        ("d", _deals_sql()), ("dr", f"SELECT d.*, {rank} AS rank FROM d"),
        ("g", f"SELECT (rank - 1) // {DEALS_PER_MESSAGE} AS part, string_agg({entry}, ',' ORDER BY rank) AS deals FROM dr GROUP BY part"),
        ("n", f"SELECT greatest(1, (COUNT(*) + {DEALS_PER_MESSAGE - 1}) // {DEALS_PER_MESSAGE}) AS parts FROM d")], (
        "SELECT r.part, '{\"status\":\"success\",\"task_name\":\"price_monitor_job_results\",\"deals\":[' || "
        f"COALESCE(g.deals, '') || '],\"time_window\":{DEAL_MONTHS},\"discount_percentage\":{float(DEAL_DISCOUNT)!r},"
        f"\"timestamp\":\"{AS_OF.isoformat()}\",\"part\":' || r.part || ',\"parts\":' || r.parts || ',\"first_rank\":' || "
        f"(r.part * {DEALS_PER_MESSAGE} + 1) || '}}' AS message "
        "FROM (SELECT parts, unnest(range(parts)) AS part FROM n) r LEFT JOIN g ON r.part = g.part"))
    q["deal_messages_empty"] = with_ctes(["cat", "hist"], [("d", _deals_sql(100.0))], (
        f"SELECT CAST(NULL AS DOUBLE) AS evaluated_discount, '{texts.NO_DEALS}' AS line FROM (SELECT COUNT(*) AS n FROM d) WHERE n = 0"))
    q["deal_messages_decoded"] = with_ctes(["cat", "hist"], [("d", _deals_sql())], (
        f"SELECT {rank} AS rank, product_id, store_id, ROUND((avg_price - price) / avg_price * 100, 6) AS evaluated_discount, "
        f"printf('{_sql_text(texts.DEAL_LINE)}', name, product_id, "
        f"{_money('avg_price')}, {_money('price')}, {_money('(avg_price - price) / avg_price * 100')}, "
        f"store_id) AS line, {DEAL_MONTHS} AS months, CAST({float(DEAL_DISCOUNT)!r} AS DOUBLE) AS discount, "
        f"{_ts(AS_OF)} AS answered_at FROM d"))
    q["deals_ranked"] = with_ctes(["cat", "hist"], [("d", _deals_sql())], (
        f"SELECT {rank} AS rank, product_id, store_id, ROUND((avg_price - price) / avg_price * 100, 6) AS evaluated_discount, "
        f"printf('{_sql_text(texts.DEAL_LINE)}', name, product_id, "
        f"{_money('avg_price')}, {_money('price')}, {_money('(avg_price - price) / avg_price * 100')}, "
        "store_id) AS line FROM d"))
