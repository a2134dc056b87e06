"""Registered queries: labels, calibration and cross-validation."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.operators import crossval, labels, series
from tickloom.plans import sqltext as S
from tickloom.plans.catalog_series import PARK, rounded
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


def labels_sql(sides: bool) -> str:
    """Band join and first touch; ``sides`` gives every bar a side in turn."""
    pick = "TRUE" if sides else "e.seq >= 22 AND n.seq + 60 <= m.n"
    side = "CASE WHEN e.seq % 3 = 0 THEN -1 WHEN e.seq % 3 = 1 THEN 0 ELSE 1 END" if sides else "1"
    return f"""{PARK}, m AS (SELECT symbol, max(seq) AS n FROM park GROUP BY 1),
ev AS (SELECT e.symbol, e.seq, e.ts_ns AS event_ns, n.ts_ns AS entry_ns, n.seq AS k0, n.open AS p, {side} AS side,
  greatest(1e-4, least(0.5, n.parkinson)) AS sigma, least(m.n, n.seq + 60) AS kmax FROM park e
  JOIN park n ON n.symbol = e.symbol AND n.seq = e.seq + 1 JOIN m ON m.symbol = e.symbol WHERE {pick}),
lv AS (SELECT *, exp(ln(p) + CASE WHEN side = -1 THEN 1 ELSE 2 END * sigma) AS u, exp(ln(p) - CASE WHEN side = -1 THEN 2 ELSE 1 END * sigma) AS l FROM ev),
hits AS (SELECT v.symbol, v.seq, b.seq AS k, CASE WHEN b.open >= v.u THEN 1 WHEN b.open <= v.l THEN 2 WHEN b.high >= v.u AND b.low <= v.l THEN 3
    WHEN b.high >= v.u THEN 4 WHEN b.low <= v.l THEN 5 END AS how FROM lv v JOIN park b ON b.symbol = v.symbol AND b.seq BETWEEN v.k0 AND v.kmax),
ft AS (SELECT symbol, seq, min(k) AS k, arg_min(how, k) AS how FROM hits WHERE how IS NOT NULL GROUP BY 1, 2),
ex AS (SELECT v.*, coalesce(ft.k, v.kmax) AS kx, ft.how FROM lv v LEFT JOIN ft USING (symbol, seq)),
px AS (SELECT x.*, b.ts_ns AS exit_ns, CASE WHEN how IS NULL THEN b.close WHEN how <= 2 THEN b.open WHEN how = 3 THEN CASE WHEN side = -1 THEN u ELSE l END
    WHEN how = 4 THEN u ELSE l END AS exit_price,
  CASE WHEN how IS NULL THEN 'VERTICAL' WHEN how IN (1, 4) THEN 'UPPER' WHEN how = 3 THEN 'COLLISION_STOP' ELSE 'LOWER' END AS touch_reason
  FROM ex x JOIN park b ON b.symbol = x.symbol AND b.seq = x.kx),
lab AS (SELECT symbol, seq, event_ns, entry_ns, exit_ns, p * CASE side WHEN 1 THEN 1 + 0.0003 WHEN -1 THEN 1 - 0.0003 ELSE 1 END AS entry_price, exit_price,
  side::BIGINT AS side, CASE WHEN touch_reason = 'UPPER' THEN CASE WHEN side = -1 THEN -1 ELSE 1 END WHEN touch_reason = 'VERTICAL' THEN 0
    ELSE CASE WHEN side = -1 THEN 1 ELSE -1 END END::BIGINT AS label,
  CASE side WHEN 1 THEN (exit_price - p) / p WHEN -1 THEN -(exit_price - p) / p ELSE abs((exit_price - p) / p) END - 0.0006 AS realized_return,
  touch_reason, kx - k0 AS holding_bars, sigma AS volatility, u AS upper_barrier, l AS lower_barrier FROM px)"""


OUT = ["entry_price", "exit_price", "realized_return", "volatility", "upper_barrier", "lower_barrier"]
ROUNDED = "symbol, seq, event_ns, entry_ns, exit_ns, side, label, touch_reason, holding_bars, " + ", ".join(f"round({c}, 6) AS {c}" for c in OUT)


def sided(spark, d):
    b = fx.bars(spark, d)
    seq = series.sequenced(b).select("symbol", "seq", F.when(F.expr("seq % 3 = 0"), -1).when(F.expr("seq % 3 = 1"), 0).otherwise(1).alias("side"))
    return labels.triple_barrier(b, events=seq)


@query("triple_barrier", f"WITH {labels_sql(False)} SELECT {ROUNDED} FROM lab")
def _(spark, d):
    return rounded(labels.triple_barrier(fx.bars(spark, d)), 6, *OUT)


@query("triple_barrier_sides", f"WITH {labels_sql(True)} SELECT {ROUNDED} FROM lab")
def _(spark, d):
    return rounded(sided(spark, d), 6, *OUT)


@query("label_summary", f"""WITH {labels_sql(False)} SELECT symbol, count(*) AS events, count(*) FILTER (label = 1) AS tp_hits,
  count(*) FILTER (label = -1) AS sl_hits, count(*) FILTER (label = 0) AS vertical_hits,
  round(count(*) FILTER (label = 1) / count(*) * 100.0, 1) AS tp_pct, round(count(*) FILTER (label = -1) / count(*) * 100.0, 1) AS sl_pct,
  round(count(*) FILTER (label = 0) / count(*) * 100.0, 1) AS vertical_pct, round(avg(holding_bars), 1) AS mean_holding,
  round(avg(realized_return) * 100.0, 3) AS mean_return_pct FROM lab GROUP BY 1""")
def _(spark, d):
    return labels.label_summary(labels.triple_barrier(fx.bars(spark, d)))


META = """meta AS (SELECT *, CASE WHEN seq % 2 = 0 THEN 1 ELSE -1 END AS sig FROM lab),
ml AS (SELECT symbol, seq, entry_ns, exit_ns, holding_bars, sig::BIGINT AS primary_side, CASE WHEN side = 0 THEN sig * realized_return WHEN sig = side THEN realized_return ELSE -realized_return END AS payoff,
  CASE WHEN upper_barrier > entry_price AND lower_barrier < entry_price THEN greatest(0.1, CASE WHEN sig = 1 THEN (upper_barrier - entry_price) / greatest(1e-6, entry_price - lower_barrier)
    ELSE (entry_price - lower_barrier) / greatest(1e-6, upper_barrier - entry_price) END) ELSE 1.0 END AS payoff_odds FROM meta)"""


def metas(spark, d):
    return labels.meta_labels(sided(spark, d), F.when(F.col("seq") % 2 == 0, 1).otherwise(-1))


@query("meta_labels", f"""WITH {labels_sql(True)}, {META} SELECT symbol, seq, primary_side, round(payoff, 6) AS payoff,
  (payoff > 0)::BIGINT AS meta_label, round(payoff_odds, 6) AS payoff_odds FROM ml""")
def _(spark, d):
    out = metas(spark, d).select("symbol", "seq", "primary_side", "payoff", "meta_label", "payoff_odds")
    return rounded(out, 6, "payoff", "payoff_odds")


@query("label_concurrency", f"""WITH {labels_sql(True)} SELECT a.symbol, a.seq, greatest(1, count(b.seq)) AS concurrency FROM lab a
LEFT JOIN lab b ON b.symbol = a.symbol AND b.entry_ns <= a.entry_ns AND b.exit_ns > a.entry_ns GROUP BY 1, 2""")
def _(spark, d):
    return labels.concurrency(sided(spark, d)).select("symbol", "seq", "concurrency")


def scored(spark, d):
    """Quality labels with the text length as the score."""
    docs = fx.table(spark, d, "documents").select("doc_id", (F.col("n_chars") / 5000.0).alias("score"))
    lab = fx.table(spark, d, "labels").select("doc_id", F.col("quality").alias("label"))
    return docs.join(lab, "doc_id")


@query("calibration_fit")
def _(spark, d):
    return labels.fit_calibration(scored(spark, d))


@query("calibration_score", """WITH s AS (SELECT d.doc_id, 1.0 / (1 + exp(least(50, greatest(-50, -1.5::DOUBLE * (n_chars / 5000.0) + 0.25)))) AS p, quality AS y
  FROM documents d JOIN labels l ON l.doc_id = d.doc_id), c AS (SELECT y, least(greatest(p, 1e-6), 1 - 1e-6) AS p FROM s)
SELECT round(avg(pow(y - p, 2)), 8) AS brier, round(avg(y) * (1 - avg(y)), 8) AS base_brier, avg(y) * (1 - avg(y)) - avg(pow(y - p, 2)) >= 0 AS is_valid FROM c""")
def _(spark, d):
    s = scored(spark, d).withColumn("prob", labels.calibrated(F.col("score"), -1.5, 0.25))
    return rounded(labels.brier(s), 8, "brier", "base_brier")


@query("bet_size", f"""WITH {labels_sql(True)}, {META}, p AS (SELECT *, 0.35 + 0.3 * ((seq * 7) % 10) / 10.0 AS prob, 1 + seq % 4 AS live FROM ml),
e AS (SELECT *, (prob * payoff_odds - (1 - prob)) / payoff_odds AS edge FROM p)
SELECT symbol, seq, round(CASE WHEN edge <= 0 THEN 0 ELSE least(1, greatest(0, 0.5 * edge / greatest(0.1, sqrt(greatest(1, holding_bars) / 10.0)) / live)) END, 6) AS size FROM e""")
def _(spark, d):
    prob = 0.35 + 0.3 * ((F.col("seq") * 7) % 10) / 10.0
    size = labels.bet_size(prob, F.col("payoff_odds"), F.col("holding_bars").cast("double"), 1 + F.col("seq") % 4)
    return metas(spark, d).select("symbol", "seq", F.round(size, 6).alias("size"))


FOLDS = crossval.Folds(embargo_pct=0.01)
SPAN = 86_400_000_000_000


def samples(spark, d):
    """One sample per event: it lives from its time for value minutes."""
    ev = fx.ticks(spark, d)
    s = ev.select(F.col("event_id").alias("sample_id"), F.col("ts_ns").alias("start"),
                  (F.col("ts_ns") + F.floor(F.col("price") * 60.0).cast("long") * 1_000_000_000).alias("end"), "price")
    return crossval.assign_groups(s, "sample_id", FOLDS.groups, F.floor(F.col("sample_id") / 100_000).cast("long"))


GROUPS = """g AS (SELECT event_id AS sample_id, epoch_us(ts) * 1000 AS st, epoch_us(ts) * 1000 + floor(value * 60.0)::BIGINT * 1000000000 AS en, value,
  ntile(6) OVER (ORDER BY event_id) - 1 AS grp FROM events)"""


@query("cv_groups", f"WITH {GROUPS} SELECT sample_id, grp FROM g")
def _(spark, d):
    return samples(spark, d).select("sample_id", "grp")


ROLES = f"""{GROUPS}, iv AS (SELECT grp, arg_min(st, sample_id) AS t0, arg_max(en, sample_id) AS t1 FROM g GROUP BY 1),
sp AS (SELECT a.grp AS a, b.grp AS b, row_number() OVER (ORDER BY a.grp, b.grp) - 1 AS split_id FROM iv a JOIN iv b ON a.grp < b.grp),
w AS (SELECT (arg_max(en, sample_id) - arg_min(st, sample_id)) * 0.01::DOUBLE AS emb FROM g),
r AS (SELECT sp.split_id, g.sample_id, g.grp, CASE WHEN g.grp IN (sp.a, sp.b) THEN 'test'
  WHEN (g.st <= x.t1 AND g.en >= x.t0) OR (g.st <= y.t1 AND g.en >= y.t0) THEN 'purged'
  WHEN (g.st > x.t1 AND g.st <= x.t1 + w.emb) OR (g.st > y.t1 AND g.st <= y.t1 + w.emb) THEN 'embargoed' ELSE 'train' END AS role
  FROM g CROSS JOIN sp JOIN iv x ON x.grp = sp.a JOIN iv y ON y.grp = sp.b CROSS JOIN w)"""


@query("cv_roles", f"WITH {ROLES} SELECT split_id, sample_id, grp, role FROM r")
def _(spark, d):
    return crossval.roles(samples(spark, d), FOLDS)


@query("cv_split_report", f"""WITH {ROLES} SELECT split_id, count(*) FILTER (role = 'train') AS train, count(*) FILTER (role = 'test') AS test,
  count(*) FILTER (role = 'purged') AS purged, count(*) FILTER (role = 'embargoed') AS embargoed, count(*) FILTER (role = 'train') / count(*) >= 0.2 AS enough_train FROM r GROUP BY 1""")
def _(spark, d):
    return crossval.split_report(crossval.roles(samples(spark, d), FOLDS), FOLDS)


FWD = crossval.Folds(forward=True, embargo_bars=3_600_000_000_000.0)


@query("cv_forward_roles", f"""WITH {GROUPS}, iv AS (SELECT grp, arg_min(st, sample_id) AS t0, arg_max(en, sample_id) AS t1 FROM g GROUP BY 1),
sp AS (SELECT grp - 1 AS split_id, grp AS a, grp + 1 AS b FROM iv WHERE grp BETWEEN 1 AND 4)
SELECT sp.split_id, g.sample_id, g.grp, CASE WHEN g.grp IN (a, b) THEN 'test' WHEN g.grp > a THEN 'unused'
  WHEN (g.st <= x.t1 AND g.en >= x.t0) OR (g.st <= y.t1 AND g.en >= y.t0) THEN 'purged'
  WHEN (g.st > x.t1 AND g.st <= x.t1 + 3600000000000) OR (g.st > y.t1 AND g.st <= y.t1 + 3600000000000) THEN 'embargoed' ELSE 'train' END AS role
FROM g CROSS JOIN sp JOIN iv x ON x.grp = sp.a JOIN iv y ON y.grp = sp.b""")
def _(spark, d):
    return crossval.roles(samples(spark, d), FWD)


def paths(spark, d):
    """Predictions of every fold for its test samples; return and signal from the event value."""
    s = samples(spark, d)
    test = crossval.roles(s, FOLDS).filter("role = 'test'")
    pred = test.join(s.select("sample_id", ((F.col("price") - 50.0) / 5000.0).alias("ret")), "sample_id").withColumn(
        "pred", F.when((F.col("sample_id") + F.col("split_id")) % 3 == 0, -1.0).otherwise(1.0))
    return crossval.path_predictions(pred, FOLDS)


PATHS = f"""{GROUPS}, iv AS (SELECT DISTINCT grp FROM g), sp AS (SELECT a.grp AS a, b.grp AS b, row_number() OVER (ORDER BY a.grp, b.grp) - 1 AS split_id FROM iv a JOIN iv b ON a.grp < b.grp),
tg AS (SELECT split_id, a AS grp FROM sp UNION ALL SELECT split_id, b FROM sp), pt AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY split_id) - 1 AS path_id FROM tg),
pr AS (SELECT path_id, split_id, sample_id, CASE WHEN (sample_id + split_id) % 3 = 0 THEN -1.0 ELSE 1.0 END::DOUBLE AS pred, (value - 50.0) / 5000.0 AS ret FROM g JOIN pt USING (grp)),
sh AS (SELECT path_id, avg(pred * ret) / stddev_samp(pred * ret) * sqrt(252.0) AS sharpe FROM pr GROUP BY 1)"""


@query("cv_paths", f"WITH {PATHS} SELECT path_id, sample_id, split_id, pred FROM pr")
def _(spark, d):
    return paths(spark, d).select("path_id", "sample_id", "split_id", "pred")


@query("cv_path_sharpes", f"WITH {PATHS} SELECT path_id, round(sharpe, 6) AS sharpe FROM sh")
def _(spark, d):
    return rounded(crossval.path_sharpes(paths(spark, d)), 6, "sharpe")


@query("cv_sharpe_distribution", f"WITH {PATHS} SELECT count(*) AS paths, round(avg(sharpe), 6) AS mean_sharpe, round(var_samp(sharpe), 6) AS var_sharpe FROM sh")
def _(spark, d):
    return rounded(crossval.sharpe_distribution(crossval.path_sharpes(paths(spark, d))), 6, "mean_sharpe", "var_sharpe")
