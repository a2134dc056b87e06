"""Common table expressions shared by the check queries."""

HOUR = 3_600_000_000_000


def bars(every: int = HOUR) -> str:
    res = {HOUR: "1h", 24 * HOUR: "1d", HOUR // 60: "1m"}[every]
    return f"""bars AS (
  SELECT event_type AS symbol, '{res}' AS resolution, (epoch_us(ts) * 1000 // {every}) * {every} AS ts_ns,
         first(value ORDER BY ts, event_id) AS open, max(value) AS high, min(value) AS low,
         last(value ORDER BY ts, event_id) AS close, CAST(count(*) AS DOUBLE) AS volume, avg(value) AS vwap
  FROM events GROUP BY 1, 2, 3 HAVING min(value) > 0)"""


def hist(every: int = HOUR) -> str:
    n = f"(ts_ns // {every})"
    return f"""{bars(every)}, hist AS (
  SELECT *, CASE WHEN {n} % 11 = 0 THEN NULL WHEN {n} % 13 = 0 THEN 0.0 ELSE close * 0.5 END AS adj_close,
    CASE WHEN {n} % 17 = 0 THEN 0.5 WHEN {n} % 19 = 0 THEN NULL ELSE 1.0 END::DOUBLE AS split_factor,
    CASE WHEN {n} % 23 = 0 THEN NULL ELSE ({n} % 5) * 0.25 END::DOUBLE AS dividend_amount
  FROM bars)"""


def raw() -> str:
    n = f"(ts_ns // {HOUR})"
    return f"""{bars()}, raw AS (
  SELECT symbol, resolution, ts_ns, CASE WHEN {n} % 29 = 0 THEN -open ELSE open END AS open,
    CASE WHEN {n} % 7 = 0 THEN low * 0.5 ELSE high END AS high, low, close,
    CASE WHEN {n} % 31 = 0 THEN -1.0 ELSE volume END AS volume,
    CASE WHEN {n} % 13 = 0 THEN 0.0
         WHEN {n} % 37 = 0 THEN (CASE WHEN {n} % 7 = 0 THEN low * 0.5 ELSE high END) * 3 ELSE vwap END AS vwap
  FROM bars)"""


UNIVERSE = ["click", "error", "purchase", "signup", "view"]


def aligned(kind: str = "simple", every: int = HOUR, source: str = "hist") -> str:
    step = "ln(now / prev)" if kind == "log" else "(now - prev) / prev"
    base = hist(every) if source == "hist" else bars(every)
    price = "coalesce(nullif(adj_close, 0), close)" if source == "hist" else "close"
    return f"""{base}, grid AS (
  SELECT t.ts_ns, s.symbol, CASE WHEN p.price > 0 THEN p.price END AS price
  FROM (SELECT DISTINCT ts_ns FROM bars) t CROSS JOIN (SELECT DISTINCT symbol FROM bars) s
  LEFT JOIN (SELECT symbol, ts_ns, {price} AS price FROM {source}) p
    ON p.symbol = s.symbol AND p.ts_ns = t.ts_ns),
filled AS (
  SELECT symbol, ts_ns, last_value(price IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ts_ns) AS now FROM grid),
stepped AS (SELECT *, lag(now) OVER (PARTITION BY symbol ORDER BY ts_ns) AS prev,
            row_number() OVER (PARTITION BY symbol ORDER BY ts_ns) AS k FROM filled),
aligned AS (SELECT symbol, ts_ns, coalesce({step}, 0.0) AS ret FROM stepped WHERE k > 1)"""
