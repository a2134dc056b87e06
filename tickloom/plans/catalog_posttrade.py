"""Registered queries: lots, ledger, financing and execution analytics."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.operators import execution, holds, lots
from tickloom.plans.catalog_series import rounded
from tickloom.sources import fixtures as fx

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return keep


ORDER = ["ts_ns", "order_id", "line", "part_id"]
FILLS = """fills AS (SELECT l_suppkey AS portfolio_id, l_returnflag AS symbol, CASE WHEN l_linestatus = 'O' THEN 'BUY' ELSE 'SELL' END AS side, l_quantity AS quantity,
  l_extendedprice / l_quantity * 1.000371937::DOUBLE AS price, epoch_us(l_shipdate) * 1000 AS ts_ns, l_orderkey AS order_id, l_linenumber AS line, l_partkey AS part_id FROM lineitem),
sg AS (SELECT *, CASE WHEN side = 'BUY' THEN quantity ELSE -quantity END AS q, row_number() OVER (PARTITION BY portfolio_id, symbol ORDER BY ts_ns, order_id, line, part_id) AS fill_no FROM fills),
ps AS (SELECT *, sum(q) OVER (PARTITION BY portfolio_id, symbol ORDER BY fill_no) AS pos FROM sg),
sp AS (SELECT *, CASE WHEN q * (pos - q) < 0 THEN least(quantity, abs(pos - q)) ELSE 0.0 END AS cq, quantity - CASE WHEN q * (pos - q) < 0 THEN least(quantity, abs(pos - q)) ELSE 0.0 END AS oq FROM ps)"""
MATCH = f"""{FILLS}, op AS (SELECT portfolio_id, symbol, CASE WHEN q > 0 THEN 'LONG' ELSE 'SHORT' END AS lot_side, fill_no, ts_ns, price, oq,
  sum(oq) OVER (PARTITION BY portfolio_id, symbol, q > 0 ORDER BY fill_no) AS hi FROM sp WHERE oq > 0),
cl AS (SELECT portfolio_id, symbol, CASE WHEN q > 0 THEN 'SHORT' ELSE 'LONG' END AS lot_side, fill_no, ts_ns, price, cq,
  sum(cq) OVER (PARTITION BY portfolio_id, symbol, q > 0 ORDER BY fill_no) AS hi FROM sp WHERE cq > 0),
mt AS (SELECT o.portfolio_id, o.symbol, o.lot_side, o.fill_no AS open_no, c.fill_no AS close_no, o.ts_ns AS ots, c.ts_ns AS cts, o.price AS opx, c.price AS cpx,
  least(o.hi, c.hi) - greatest(o.hi - oq, c.hi - cq) AS qty FROM op o JOIN cl c USING (portfolio_id, symbol, lot_side) WHERE least(o.hi, c.hi) > greatest(o.hi - oq, c.hi - cq)),
tr AS (SELECT *, CASE WHEN lot_side = 'LONG' THEN 'SELL' ELSE 'COVER' END AS trade_side, round(qty * opx, 4) AS cost_basis,
  round(CASE WHEN lot_side = 'LONG' THEN qty * cpx - qty * opx ELSE qty * opx - qty * cpx END, 4) AS pnl FROM mt)"""


def split(spark, d):
    return lots.split_fills(fx.fills(spark, d).drop("fee"), ORDER)


def fifo(spark, d):
    return lots.fifo_matches(split(spark, d))


@query("fifo_matches", f"""WITH {MATCH} SELECT portfolio_id, symbol, trade_side, open_no, close_no, qty AS quantity, round(cpx, 4) AS execution_price, cost_basis,
  pnl AS realized_pnl, round(greatest((cts - ots) / 1e9, 0), 1) AS holding_seconds FROM tr""")
def _(spark, d):
    return fifo(spark, d).select("portfolio_id", "symbol", "trade_side", "open_no", "close_no", "quantity", "execution_price", "cost_basis", "realized_pnl", "holding_seconds")


TAKE = "greatest(0, least(lots[i]['q'], cq - coalesce(list_sum(list_transform(lots[1:i - 1], lambda x: x['q'])), 0)))"
# the lots of a book in the order in which closes take them: latest time first, of equal times the lower number
LIFO = f"""{FILLS}, run AS (
  SELECT DISTINCT portfolio_id, symbol, CAST(0 AS BIGINT) AS k, CAST([] AS STRUCT(no BIGINT, ts BIGINT, px DOUBLE, q DOUBLE)[]) AS lots, CAST([] AS STRUCT(no BIGINT, px DOUBLE, q DOUBLE)[]) AS hits, 0.0::DOUBLE AS px, 0.0::DOUBLE AS dir FROM sp
  UNION ALL SELECT portfolio_id, symbol, fill_no, list_filter(rest, lambda x: x['ts'] >= ts_ns) || CASE WHEN oq > 1e-8 THEN [{{'no': fill_no, 'ts': ts_ns, 'px': price, 'q': oq}}] ELSE [] END || list_filter(rest, lambda x: x['ts'] < ts_ns), hits, price, q
  FROM (SELECT sp.portfolio_id, sp.symbol, fill_no, ts_ns, price, oq, q,
      list_filter(list_transform(range(1, len(lots) + 1), lambda i: {{'no': lots[i]['no'], 'ts': lots[i]['ts'], 'px': lots[i]['px'], 'q': lots[i]['q'] - {TAKE}}}), lambda x: x['q'] > 1e-8) AS rest,
      list_filter(list_transform(range(1, len(lots) + 1), lambda i: {{'no': lots[i]['no'], 'px': lots[i]['px'], 'q': {TAKE}}}), lambda x: x['q'] > 1e-8) AS hits
    FROM run JOIN sp ON sp.portfolio_id = run.portfolio_id AND sp.symbol = run.symbol AND sp.fill_no = run.k + 1))"""


@query("lifo_matches", f"""WITH RECURSIVE {LIFO}, m AS (SELECT portfolio_id, symbol, k, px, dir, unnest(hits) AS h FROM run)
SELECT portfolio_id, symbol, CASE WHEN dir < 0 THEN 'SELL' ELSE 'COVER' END AS trade_side, h['no'] AS open_no, k AS close_no, h['q'] AS quantity,
  round(CASE WHEN dir < 0 THEN h['q'] * px - h['q'] * h['px'] ELSE h['q'] * h['px'] - h['q'] * px END, 4) AS realized_pnl FROM m""")
def _(spark, d):
    return lots.lifo_matches(split(spark, d)).select("portfolio_id", "symbol", "trade_side", "open_no", "close_no", "quantity", "realized_pnl")


LOTS = f"""{MATCH}, us AS (SELECT portfolio_id, symbol, open_no AS fill_no, sum(qty) AS used FROM mt GROUP BY 1, 2, 3),
lt AS (SELECT o.*, oq - coalesce(used, 0) AS remaining FROM op o LEFT JOIN us USING (portfolio_id, symbol, fill_no) WHERE oq - coalesce(used, 0) > 1e-6),
mk AS (SELECT symbol, avg(price) AS mark FROM fills GROUP BY 1)"""


def marks(spark, d):
    return fx.fills(spark, d).groupBy("symbol").agg(F.avg("price").alias("mark"))


@query("open_lots", f"WITH {LOTS} SELECT portfolio_id, symbol, fill_no, lot_side, remaining, round(price, 4) AS price FROM lt")
def _(spark, d):
    return rounded(lots.fifo_open_lots(split(spark, d)).select("portfolio_id", "symbol", "fill_no", "lot_side", "remaining", "price"), 4, "price")


@query("positions_unrealized", f"""WITH {LOTS} SELECT portfolio_id, symbol, sum(CASE WHEN lot_side = 'LONG' THEN remaining ELSE -remaining END) AS position,
  round(sum(CASE WHEN lot_side = 'LONG' THEN 1 ELSE -1 END * remaining * (mark - price)), 4) AS unrealized_pnl FROM lt JOIN mk USING (symbol) GROUP BY 1, 2""")
def _(spark, d):
    return lots.positions(lots.fifo_open_lots(split(spark, d)), marks(spark, d))


@query("inventory_check", f"""WITH {FILLS} SELECT count(DISTINCT portfolio_id || symbol) AS books, 0::BIGINT AS violations FROM fills""")
def _(spark, d):
    s = split(spark, d)
    f = fx.fills(spark, d)
    bad = lots.inventory_violations(f, lots.fifo_open_lots(s))
    books = f.select("portfolio_id", "symbol").distinct().select(F.lit(1).alias("b"), F.lit(0).alias("v"))
    both = books.unionByName(bad.select(F.lit(0).alias("b"), F.lit(1).alias("v")))
    return both.agg(F.sum("b").alias("books"), F.sum("v").alias("violations"))


JN = f"""{MATCH}, jl AS (
  SELECT portfolio_id, symbol, close_no AS fill_no, round(qty * round(cpx, 4), 4) AS v, cost_basis AS cb, trade_side FROM tr),
je AS (SELECT portfolio_id, symbol, fill_no, 'ASSET_CASH' AS account, CASE WHEN trade_side = 'SELL' THEN 'DEBIT' ELSE 'CREDIT' END AS entry_type, v AS amount FROM jl
  UNION ALL SELECT portfolio_id, symbol, fill_no, CASE WHEN trade_side = 'SELL' THEN 'ASSET_INVENTORY_' ELSE 'LIABILITY_SHORT_' END || symbol, CASE WHEN trade_side = 'SELL' THEN 'CREDIT' ELSE 'DEBIT' END, cb FROM jl
  UNION ALL SELECT portfolio_id, symbol, fill_no, CASE WHEN g > 0 THEN 'REVENUE_REALIZED_GAIN' ELSE 'EXPENSE_REALIZED_LOSS' END, CASE WHEN g > 0 THEN 'CREDIT' ELSE 'DEBIT' END, abs(g)
    FROM (SELECT *, round(CASE WHEN trade_side = 'SELL' THEN v - cb ELSE cb - v END, 4) AS g FROM jl) WHERE abs(g) > 1e-4
  UNION ALL SELECT portfolio_id, symbol, fill_no, CASE WHEN lot_side = 'LONG' THEN 'ASSET_INVENTORY_' ELSE 'LIABILITY_SHORT_' END || symbol, CASE WHEN lot_side = 'LONG' THEN 'DEBIT' ELSE 'CREDIT' END, round(oq * price, 4) FROM op
  UNION ALL SELECT portfolio_id, symbol, fill_no, 'ASSET_CASH', CASE WHEN lot_side = 'LONG' THEN 'CREDIT' ELSE 'DEBIT' END, round(oq * price, 4) FROM op)"""


@query("journal_accounts", f"WITH {JN} SELECT portfolio_id, account, entry_type, count(*) AS lines, round(sum(amount), 0) AS amount FROM je GROUP BY 1, 2, 3")
def _(spark, d):
    s = split(spark, d)
    return lots.journal(s, lots.fifo_matches(s)).groupBy("portfolio_id", "account", "entry_type").agg(
        F.count(F.lit(1)).alias("lines"), F.round(F.sum("amount"), 0).alias("amount"))


@query("journal_balance", f"WITH {FILLS} SELECT count(*) AS transactions, 0::BIGINT AS unbalanced FROM fills")
def _(spark, d):
    s = split(spark, d)
    e = lots.journal(s, lots.fifo_matches(s))
    return lots.transactions(e).agg(F.count(F.lit(1)).alias("transactions"), F.count_if("unbalanced").alias("unbalanced"))


@query("cash_balance", f"""WITH {FILLS}, c AS (SELECT portfolio_id, order_id, line, part_id, ts_ns, symbol, 1000000 + sum(CASE WHEN side = 'BUY' THEN -1 ELSE 1 END * round(quantity * price, 4))
  OVER (PARTITION BY portfolio_id ORDER BY ts_ns, order_id, line, part_id) AS cash FROM fills)
SELECT portfolio_id, order_id, line::BIGINT AS line, part_id, round(cash, 4) AS cash, round(greatest(0, -cash), 4) AS margin_debt FROM c""")
def _(spark, d):
    c = lots.cash_balance(fx.fills(spark, d), ORDER, 1e6).select("portfolio_id", "order_id", "line", "part_id", "cash", "margin_debt")
    return rounded(c, 4, "cash", "margin_debt")


def accounts(spark, d):
    """End-of-year cash and positions per supplier from its line items."""
    f = fx.fills(spark, d).withColumn("date", F.date_format(F.timestamp_micros(F.expr("ts_ns div 1000")), "yyyy"))
    sign = F.when(F.col("side") == "BUY", 1.0).otherwise(-1.0)
    cash = f.groupBy("portfolio_id", "date").agg(F.round(F.sum(-sign * F.col("quantity") * F.col("price")), 2).alias("cash"))
    held = f.groupBy("portfolio_id", "date", "symbol").agg(F.sum(sign * F.col("quantity")).alias("quantity"), F.avg("price").alias("price"))
    return cash, held


def exact(x: str, digits: int) -> str:
    """SQL for the decimal nearest to the exact value of ``x``, ties to even; round() scales first, which can make a tie."""
    return f"CAST(printf('%.{digits}f', CAST({x} AS DOUBLE)) AS DOUBLE)"


RATE = "-qty * price * CASE WHEN symbol = 'R' THEN 0.15 ELSE 0.005 END::DOUBLE / 360.0"
FIN = f"""{FILLS}, y AS (SELECT *, strftime(make_timestamp(ts_ns // 1000), '%Y') AS date FROM sg),
ca AS (SELECT portfolio_id, date, {exact('sum(-q * price)', 2)} AS cash FROM y GROUP BY 1, 2), he AS (SELECT portfolio_id, date, symbol, sum(q) AS qty, avg(price) AS price FROM y GROUP BY 1, 2, 3),
fe AS (SELECT portfolio_id, date, {exact('sum(' + exact(RATE, 4) + ')', 4)} AS borrow_fees, {exact('sum(-qty * price)', 2)} AS short_notional FROM he WHERE qty < 0 GROUP BY 1, 2),
fi AS (SELECT portfolio_id, date, cash, coalesce(borrow_fees, 0) AS borrow_fees, coalesce(short_notional, 0) AS short_notional, {exact('greatest(0, -cash) * 0.06::DOUBLE / 360.0', 4)} AS margin_interest FROM ca LEFT JOIN fe USING (portfolio_id, date))"""


def accrued(spark, d):
    cash, held = accounts(spark, d)
    rates = spark.sql("SELECT 'R' AS symbol, 0.15D AS rate")
    return lots.financing(cash, held, rates)


@query("financing_accrual", f"WITH {FIN} SELECT portfolio_id, date, cash, borrow_fees, short_notional, margin_interest, {exact('cash - ' + exact('margin_interest + borrow_fees', 4), 4)} AS cash_after FROM fi")
def _(spark, d):
    return accrued(spark, d).select("portfolio_id", "date", "cash", "borrow_fees", "short_notional", "margin_interest", "cash_after")


@query("financing_entries", f"""WITH {FIN}, e AS (SELECT 'EXPENSE_MARGIN_INTEREST' AS account, 'DEBIT' AS entry_type, margin_interest AS a FROM fi WHERE margin_interest > 1e-6 UNION ALL
  SELECT 'ASSET_CASH', 'CREDIT', margin_interest FROM fi WHERE margin_interest > 1e-6 UNION ALL SELECT 'EXPENSE_SHORT_BORROW', 'DEBIT', borrow_fees FROM fi WHERE borrow_fees > 1e-6 UNION ALL
  SELECT 'ASSET_CASH', 'CREDIT', borrow_fees FROM fi WHERE borrow_fees > 1e-6) SELECT account, entry_type, count(*) AS lines, round(sum(a), 1) AS amount FROM e GROUP BY 1, 2""")
def _(spark, d):
    return lots.financing_entries(accrued(spark, d)).groupBy("account", "entry_type").agg(F.count(F.lit(1)).alias("lines"), F.round(F.sum("amount"), 1).alias("amount"))


@query("eod_snapshot", f"""WITH {LOTS}, po AS (SELECT portfolio_id, symbol, any_value(mark) AS mark, sum(CASE WHEN lot_side = 'LONG' THEN remaining ELSE -remaining END) AS p,
  sum(CASE WHEN lot_side = 'LONG' THEN 1 ELSE -1 END * remaining * (mark - price)) AS u FROM lt JOIN mk USING (symbol) GROUP BY 1, 2),
a AS (SELECT portfolio_id, sum(p * mark) AS h, sum(abs(p) * mark) AS g, sum(u) AS u FROM po GROUP BY 1), c AS (SELECT portfolio_id, 1000000 + sum(-q * price) AS cash FROM sg GROUP BY 1),
r AS (SELECT portfolio_id, sum(pnl) AS rp FROM tr GROUP BY 1)
SELECT portfolio_id, round(cash + coalesce(h, 0), 0) AS nav, round(coalesce(g, 0), 0) AS gross_notional, round(coalesce(rp, 0), 0) AS realized_pnl, round(coalesce(u, 0), 0) AS unrealized_pnl
FROM c LEFT JOIN a USING (portfolio_id) LEFT JOIN r USING (portfolio_id)""")
def _(spark, d):
    s = split(spark, d)
    m = lots.fifo_matches(s)
    p = lots.positions(lots.fifo_open_lots(s), marks(spark, d)).join(marks(spark, d), "symbol")
    sign = F.when(F.col("side") == "BUY", -1.0).otherwise(1.0)
    cash = fx.fills(spark, d).groupBy("portfolio_id").agg((F.lit(1e6) + F.sum(sign * F.col("quantity") * F.col("price"))).alias("cash"))
    e = lots.eod_snapshot(cash, p, m).select("portfolio_id", "nav", "gross_notional", "realized_pnl", "unrealized_pnl")
    return rounded(e, 0, "nav", "gross_notional", "realized_pnl", "unrealized_pnl")


def parents(spark, d):
    o = fx.table(spark, d, "orders")
    return o.select(
        F.col("o_orderkey").alias("parent_id"), F.when(F.col("o_orderkey") % 2 == 0, "BUY").otherwise("SELL").alias("side"),
        F.lit(120.0).alias("total_quantity"), (F.lit(1000.0) + F.col("o_custkey") % 500).alias("arrival_price"),
        (F.lit(1010.0) + F.col("o_custkey") % 500).alias("decision_price"), fx.to_ns("o_orderdate").alias("start_ns"))


def children(spark, d):
    return fx.fills(spark, d).select(F.col("order_id").alias("parent_id"), "quantity", "price", "fee", "ts_ns",
                                     (F.col("quantity") * 0.01).alias("spread_slippage"))


ROLL = """pa AS (SELECT o_orderkey AS parent_id, CASE WHEN o_orderkey % 2 = 0 THEN 1.0 ELSE -1.0 END AS sd, 120.0::DOUBLE AS tq, 1000.0::DOUBLE + o_custkey % 500 AS ap, 1010.0::DOUBLE + o_custkey % 500 AS dp, epoch_us(o_orderdate) AS st FROM orders),
ch AS (SELECT l_orderkey AS parent_id, sum(l_quantity) AS fq, sum(l_quantity * (l_extendedprice / l_quantity * 1.000371937::DOUBLE)) AS n, sum(l_extendedprice * l_tax * 0.01 * 1.000371937::DOUBLE) AS fees, min(epoch_us(l_shipdate)) AS ft FROM lineitem GROUP BY 1),
ro AS (SELECT pa.*, coalesce(fq, 0) AS fq, coalesce(fees, 0) AS fees, CASE WHEN fq > 0 THEN n / fq ELSE 0.0 END AS av, greatest(0, tq - coalesce(fq, 0)) AS lv, coalesce(fq, 0) > tq + 1e-7 AS ov, coalesce(ft < st, false) AS ea FROM pa LEFT JOIN ch USING (parent_id))"""


@query("fill_rollup", f"WITH {ROLL} SELECT parent_id, fq AS filled, round(av, 4) AS average_price, round(fees, 4) AS fees, lv AS leaves, ov AS over_filled, ea AS early_fill FROM ro")
def _(spark, d):
    r = execution.fill_rollup(parents(spark, d), children(spark, d))
    return rounded(r.select("parent_id", "filled", "average_price", "fees", "leaves", "over_filled", "early_fill"), 4, "average_price", "fees")


@query("implementation_shortfall", f"""WITH {ROLL}, c AS (SELECT *, CASE WHEN fq > 0 THEN sd * fq * (dp - ap) ELSE 0 END AS dc, CASE WHEN fq > 0 THEN sd * fq * (av - dp) ELSE 0 END AS pi,
  CASE WHEN lv > 0 THEN sd * lv * (CASE WHEN fq > 0 THEN av ELSE ap END - ap) ELSE 0 END AS oc FROM ro)
SELECT parent_id, round(dc, 2) AS delay_cost, round(pi, 2) AS price_impact, round(oc, 2) AS opportunity_cost, round((dc + pi + fees + oc) * 10000 / (tq * ap), 3) AS total_shortfall_bps FROM c""")
def _(spark, d):
    s = execution.shortfall(execution.fill_rollup(parents(spark, d), children(spark, d)))
    s = s.select("parent_id", "delay_cost", "price_impact", "opportunity_cost", "total_shortfall_bps")
    return rounded(rounded(s, 2, "delay_cost", "price_impact", "opportunity_cost"), 3, "total_shortfall_bps")


def tick_fills(spark, d):
    """Every third event is a fill at its value, the others are quotes."""
    t = fx.ticks(spark, d).filter("price > 0")
    f = t.filter("event_id % 3 = 0").select("symbol", "event_id", "ts_ns", "price", F.when(F.col("event_id") % 2 == 0, "BUY").otherwise("SELL").alias("side"),
                                            F.concat(F.lit("V"), (F.col("user_id") % 4).cast("string")).alias("venue"))
    q = t.filter("event_id % 3 <> 0").select("symbol", "ts_ns", F.col("price").alias("midpoint"))
    return f, q


MO = """fl AS (SELECT event_type AS symbol, event_id, epoch_us(ts) * 1000 AS ts_ns, value AS price, CASE WHEN event_id % 2 = 0 THEN 1 ELSE -1 END AS sd, 'V' || (user_id % 4) AS venue FROM events WHERE event_id % 3 = 0 AND value > 0),
qu AS (SELECT event_type AS symbol, epoch_us(ts) * 1000 AS ts_ns, value AS mid FROM events WHERE event_id % 3 <> 0 AND value > 0),
mo AS (SELECT f.*, q.mid, sd * (q.mid - price) / price * 10000 AS bps FROM (SELECT *, ts_ns + 60000000000 AS t FROM fl) f ASOF LEFT JOIN qu q ON f.symbol = q.symbol AND f.t <= q.ts_ns)"""


@query("markouts", f"WITH {MO} SELECT event_id, venue, round(bps, 4) AS markout_bps FROM mo")
def _(spark, d):
    m = execution.markouts(*tick_fills(spark, d), 60_000_000_000)
    return rounded(m.select("event_id", "venue", "markout_bps"), 4, "markout_bps")


@query("venue_markouts", f"WITH {MO} SELECT venue, count(*) AS fills, round(avg(bps), 3) AS average_markout_bps FROM mo WHERE bps IS NOT NULL GROUP BY 1")
def _(spark, d):
    return rounded(execution.venue_markouts(execution.markouts(*tick_fills(spark, d), 60_000_000_000)), 3, "average_markout_bps")


@query("venue_quarantine", f"""WITH RECURSIVE {MO}, f AS MATERIALIZED (SELECT venue, event_id, ts_ns, bps, row_number() OVER (PARTITION BY venue ORDER BY ts_ns, event_id) AS k FROM mo WHERE bps IS NOT NULL),
run AS (SELECT DISTINCT venue, CAST(0 AS BIGINT) AS event_id, CAST(0 AS BIGINT) AS ts_ns, 0.0::DOUBLE AS bps, CAST(0 AS BIGINT) AS k, CAST(0 AS BIGINT) AS streak, CAST(0 AS BIGINT) AS until_ns FROM f UNION ALL
  SELECT venue, event_id, ts_ns, bps, k, streak, CASE WHEN streak >= 3 THEN ts_ns + 7200000000000 ELSE held END FROM (
    SELECT f.*, CASE WHEN f.bps >= -2 THEN 0 WHEN r.until_ns > 0 AND f.ts_ns >= r.until_ns THEN 1 ELSE r.streak + 1 END AS streak, CASE WHEN f.ts_ns >= r.until_ns THEN 0 ELSE r.until_ns END AS held
    FROM run r JOIN f ON f.venue = r.venue AND f.k = r.k + 1))
SELECT venue, event_id, ts_ns, round(bps, 4) AS markout_bps, streak, until_ns > 0 AS quarantined, until_ns FROM run WHERE k > 0""")
def _(spark, d):
    m = execution.markouts(*tick_fills(spark, d), 60_000_000_000)
    return rounded(holds.quarantines(m, ["ts_ns", "event_id"], hold_ns=7_200_000_000_000), 4, "markout_bps")


@query("quote_metrics", """WITH q AS (SELECT event_id, value AS b, value + 0.01::DOUBLE * (1 + event_id % 9) AS a, (event_id % 50)::DOUBLE AS bq, (event_id % 30)::DOUBLE AS aq FROM events)
SELECT event_id, round((a + b) / 2, 6) AS midpoint, round((a - b) / ((a + b) / 2) * 10000, 4) AS spread_bps, CASE WHEN bq + aq > 0 THEN round((bq - aq) / (bq + aq), 6) ELSE 0.0 END AS imbalance,
  bq * 1.5::DOUBLE AS bid_depth, aq * 1.5::DOUBLE AS ask_depth FROM q""")
def _(spark, d):
    b, a = (F.col("event_id") % 50).cast("double"), (F.col("event_id") % 30).cast("double")
    leg = lambda k: F.struct((b * k).alias("bid"), (a * k).alias("ask"))
    q = fx.ticks(spark, d).select("event_id", F.col("price").alias("bid_price"), (F.col("price") + 0.01 * (1 + F.col("event_id") % 9)).alias("ask_price"),
                                  b.alias("bid_quantity"), a.alias("ask_quantity"), F.create_map(F.lit("X"), leg(1.0), F.lit("Y"), leg(0.5)).alias("venue_depths"))
    m = execution.quote_metrics(q).select("event_id", "midpoint", "spread_bps", "imbalance", "bid_depth", "ask_depth")
    return rounded(rounded(m, 6, "midpoint", "imbalance"), 4, "spread_bps")


STATES = list(execution.TRANSITIONS)
LEGAL = ", ".join(f"('{a}', '{b}')" for a, bs in execution.TRANSITIONS.items() for b in bs)


@query("illegal_transitions", f"""WITH e AS (SELECT user_id AS order_id, event_id AS step, ({STATES!r})[1 + (event_id * 7 + user_id) % 8] AS state FROM events),
p AS (SELECT *, lag(state) OVER (PARTITION BY order_id ORDER BY step) AS prev_state FROM e)
SELECT order_id, step, prev_state, state FROM p WHERE prev_state IS NOT NULL AND (prev_state, state) NOT IN ({LEGAL})""")
def _(spark, d):
    s = F.get(F.array(*[F.lit(x) for x in STATES]), ((F.col("event_id") * 7 + F.col("user_id")) % 8).cast("int"))
    h = fx.ticks(spark, d).select(F.col("user_id").alias("order_id"), F.col("event_id").alias("step"), s.alias("state"))
    return execution.illegal_transitions(h).select("order_id", "step", "prev_state", "state")


NAMESPACE = "6ba7b810-9dad-11d1-80b4-00c04fd430c8"


@query("duplicate_orders", """WITH k AS (SELECT l_returnflag || ':' || l_suppkey || ':' || l_linestatus || ':' || (epoch_us(l_shipdate) * 1000) || ':0' AS k FROM lineitem)
SELECT count(*) AS keys, CAST(sum(c) AS BIGINT) AS copies FROM (SELECT k, count(*) AS c FROM k GROUP BY 1 HAVING count(*) > 1)""")
def _(spark, d):
    f = fx.table(spark, d, "lineitem")
    cid = execution.client_order_id(NAMESPACE, F.col("l_returnflag"), F.col("l_suppkey").cast("string"), F.col("l_linestatus"), fx.to_ns("l_shipdate"), F.lit(0))
    return execution.duplicate_orders(f.select(cid.alias("cl_ord_id"))).agg(F.count(F.lit(1)).alias("keys"), F.sum("copies").alias("copies"))


@query("heartbeat_report", """WITH b AS (SELECT event_type AS gateway, event_id, epoch_us(ts) * 1000 AS ts_ns, event_id // 5 + CASE WHEN event_id % 7 = 0 THEN 2 ELSE 1 END AS sequence, value AS lat FROM events),
w AS (SELECT *, max(sequence) OVER (PARTITION BY gateway ORDER BY ts_ns, sequence ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top, lag(ts_ns) OVER (PARTITION BY gateway ORDER BY ts_ns, sequence) AS p FROM b)
SELECT event_id, coalesce(top, 0) + 1 AS expected, sequence <> coalesce(top, 0) + 1 AS sequence_gap, coalesce(floor((ts_ns - p) / 1e9 / 600), 0)::BIGINT AS misses, lat >= 100 AS degraded_latency,
  coalesce((ts_ns - p) / 1e9 >= 1800 OR floor((ts_ns - p) / 1e9 / 600) >= 3, false) AS disconnected_before FROM w""")
def _(spark, d):
    b = fx.ticks(spark, d).select(F.col("symbol").alias("gateway"), "event_id", "ts_ns", (F.expr("event_id div 5") + F.when(F.col("event_id") % 7 == 0, 2).otherwise(1)).alias("sequence"),
                                  F.col("price").alias("latency_ms"))
    return execution.heartbeat_report(b, 600.0, 1800.0).select("event_id", "expected", "sequence_gap", "misses", "degraded_latency", "disconnected_before")
