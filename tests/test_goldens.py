"""Hand-computed results and brute-force checks on small inputs."""

import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tickloom.functions import money, special, text
from tickloom.operators import execution, kernels, labels, lots, news, portfolio, ranking, series, stats, tail
from tickloom.streaming import sinks

DAY = 86_400_000_000_000


def bars_of(spark, rows):
    return spark.createDataFrame(rows, "symbol string, ts_ns long, adj_close double, close double")


def test_aligned_gap(spark):
    b = bars_of(spark, [("A", 1 * DAY, 100.0, 1.0), ("A", 2 * DAY, 105.0, 1.0), ("A", 3 * DAY, 110.0, 1.0), ("B", 1 * DAY, 200.0, 1.0), ("B", 3 * DAY, 220.0, 1.0)])
    got = {(r.symbol, r.ts_ns // DAY): r.ret for r in series.aligned_returns(b, ["A", "B"], span_ns=DAY).collect()}
    assert got == pytest.approx({("A", 2): 0.05, ("A", 3): 5 / 105, ("B", 2): 0.0, ("B", 3): 0.10})


def test_log_return(spark):
    b = bars_of(spark, [("A", DAY, 100.0, 1.0), ("A", 2 * DAY, 120.0, 1.0)])
    assert series.aligned_returns(b, ["A"], kind="log").first().ret == pytest.approx(math.log(1.2))


FILL = "portfolio_id long, symbol string, side string, quantity double, price double, ts_ns long, n long"


def fills_of(spark, rows):
    return spark.createDataFrame([(1, "X", s, float(q), float(p), i * 1_000_000_000, i) for i, (s, q, p) in enumerate(rows)], FILL)


def test_fifo_golden(spark):
    s = lots.split_fills(fills_of(spark, [("BUY", 100, 100), ("BUY", 50, 110), ("SELL", 120, 120)]), ["ts_ns", "n"])
    m = lots.fifo_matches(s)
    assert sorted((r.quantity, r.realized_pnl) for r in m.collect()) == [(20.0, 200.0), (100.0, 2000.0)]
    assert lots.open_lots(s, m).first().remaining == 30.0


def queue_matches(rows, lifo):
    book, out = [], []
    for i, (side, q, p) in enumerate(rows):
        d = 1 if side == "BUY" else -1
        while q > 0 and book and book[0][0] != d:
            lot = book[-1 if lifo else 0]
            take = min(q, lot[1])
            out.append((lot[3], i + 1, take, round(take * (p - lot[2]) * lot[0], 4)))
            lot[1] -= take
            q -= take
            if lot[1] == 0:
                book.remove(lot)
        if q > 0:
            book.append([d, q, p, i + 1])
    return sorted(out)


@pytest.mark.parametrize("lifo", [False, True])
def test_lots_against_a_queue(spark, lifo):
    rng = random.Random(5)
    rows = [(rng.choice(["BUY", "SELL"]), rng.randint(1, 40), rng.randint(50, 150)) for _ in range(300)]
    s = lots.split_fills(fills_of(spark, rows), ["ts_ns", "n"], block_rows=4)
    m = lots.lifo_matches(s, block_fills=16, fan=4) if lifo else lots.fifo_matches(s, block_rows=5)
    got = sorted((r.open_no, r.close_no, r.quantity, r.realized_pnl) for r in m.collect())
    assert got == queue_matches(rows, lifo)
    assert lots.inventory_violations(s, lots.open_lots(s, m)).count() == 0


def test_shortfall_identity(spark):
    p = spark.createDataFrame([(1, "BUY", 100.0, 10.0, 10.5, 0), (2, "SELL", 50.0, 20.0, 19.0, 0)],
                              "parent_id long, side string, total_quantity double, arrival_price double, decision_price double, start_ns long")
    c = spark.createDataFrame([(1, 60.0, 11.0, 0.3, 1, 0.0)], "parent_id long, quantity double, price double, fee double, ts_ns long, spread_slippage double")
    r = {x.parent_id: x for x in execution.shortfall(execution.fill_rollup(p, c)).collect()}
    assert r[1].delay_cost == pytest.approx(30.0) and r[1].price_impact == pytest.approx(30.0) and r[1].opportunity_cost == pytest.approx(40.0)
    assert r[1].total_shortfall == pytest.approx(100.3) and r[2].total_shortfall == 0.0


def test_special_functions():
    assert special.t_quantile(5.0, 0.99) == pytest.approx(3.364930, abs=1e-5)
    assert special.t_quantile(2.1, 0.975) == pytest.approx(special.t_quantile(2.1, 0.975))
    assert special.t_cdf(10.0, 1.812461) == pytest.approx(0.95, abs=1e-6)


def test_exact_quantiles_with_a_hot_value(spark):
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(size=400), np.zeros(300), rng.normal(size=77) * 1e-7])
    d = spark.createDataFrame(pd.DataFrame({"k": "a", "v": x}))
    r = stats.quantiles(d, ["k"], "v", {"lo": 0.05, "mid": 0.5, "hi": 0.995}).first()
    assert [r.lo, r.mid, r.hi] == pytest.approx(list(np.quantile(x, [0.05, 0.5, 0.995])), abs=1e-12)


def test_psr_and_hurdle(spark):
    d = spark.range(1).select(
        stats.probabilistic_sharpe(F.lit(1.0), F.lit(0.0), F.lit(0.0), F.lit(3.0), F.lit(253), 252.0).alias("psr"),
        stats.expected_max_sharpe(F.lit(10.0), F.lit(1.0), F.lit(0.0)).alias("h")).first()
    s = 1 / math.sqrt(252)
    z = s / math.sqrt((1 + 0.5 * s * s) / 252)
    assert d.psr == pytest.approx(0.5 * math.erfc(-z / math.sqrt(2)), abs=1e-9)
    assert d.h == pytest.approx(1.5746, abs=1e-3)


def test_tail_cascade_methods(spark):
    rng = np.random.default_rng(1)
    pdf = pd.concat([pd.DataFrame({"book": b, "loss": rng.standard_t(6, size=n)}) for b, n in (("small", 20), ("mid", 120), ("big", 1500))])
    r = {x.book: x for x in tail.risk_cascade(spark.createDataFrame(pdf), ["book"]).collect()}
    assert {b: x.method for b, x in r.items()} == {"small": "EMPIRICAL", "mid": "STUDENT_T", "big": "EVT_PWM"}
    small = pdf[pdf.book == "small"].loss.to_numpy()
    assert r["small"].var == pytest.approx(np.percentile(small, 99))
    y = pdf[pdf.book == "big"].loss.to_numpy()
    u = y.mean() + 1.645 * y.std(ddof=1)
    e = np.sort(y[y > u] - u)
    k = len(e)
    m0, m1 = e.mean(), ((np.arange(k, 0, -1) - 0.65) / k**2 * e).sum()
    xi, beta = 2 - m0 / (m0 - 2 * m1), 2 * m0 * m1 / (m0 - 2 * m1)
    xi, beta = (0.001, m0) if xi <= 0 else (xi, beta)
    assert r["big"].var == pytest.approx(u + beta / xi * ((len(y) / k * 0.01) ** -xi - 1), rel=1e-9)


@pytest.mark.parametrize("sentence, sign", [
    ("Company beats earnings, record profit", 1), ("Shares plunge on fraud probe", -1), ("Loss narrowed this quarter", 1),
    ("Firm failed to deliver growth", -1), ("Plain words only", 0), ("They didn't miss", 1)])
def test_polarity_cases(spark, sentence, sign):
    p = spark.createDataFrame([(sentence,)], "t string").select(text.polarity(F.col("t")).alias("p")).first().p
    assert (p > 0) - (p < 0) == sign


def test_html_entities(spark):
    raw = "<p>A&amp;lt;B &#39;x&#x27; &#8364;&nbsp;5</p>"
    assert spark.createDataFrame([(raw,)], "t string").select(text.clean_html(F.col("t")).alias("c")).first().c == "A&lt;B 'x' € 5"


def test_decay_kernel(spark):
    got = spark.range(1).select(*[text.decay(F.lit(float(s)), F.lit(0.5)).alias(f"c{i}") for i, s in enumerate((-1, 0, 3600, 604801))]).first()
    assert list(got) == pytest.approx([0.0, 1.0, 0.5 * math.exp(-2) + 0.5 / (1 + 1 / 24), 0.0])


def test_projection_is_unit_and_seeded(spark):
    e = spark.createDataFrame([(1, [float(i) for i in range(20)])], "event_id long, embedding array<double>")
    e = e.select("*", *[F.lit(0.5).alias(c) for c in ("polarity", "subjectivity", "novelty", "urgency", "centrality")])
    f = np.array(news.project(e, 20).first().features)
    want = np.arange(20.0) @ np.random.default_rng(42).normal(0, 0.25, size=(20, 16))
    assert np.allclose(f[:16], want / np.linalg.norm(want)) and list(f[16:]) == [0.5] * 5


def test_novelty_history(spark):
    sec = 1_000_000_000
    rows = [(1, 0, "alpha beta gamma"), (2, 60, "alpha beta gamma"), (3, 120, "alpha beta delta"), (4, 9000, "alpha beta gamma now"), (5, 9001, "")]
    a = spark.createDataFrame([(i, t * sec, h, "s", "src") for i, t, h in rows], "article_id long, available_ns long, headline string, summary string, source string")
    got = {r.article_id: r.novelty for r in news.novelty(a).collect()}
    assert got == pytest.approx({1: 1.0, 2: 0.1, 3: math.exp(-1.0), 4: 1.0, 5: 1.0})


def test_front_across_blocks(spark):
    x = np.random.default_rng(2).random((400, 3))
    d = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "id long, a double, b double, c double").repartition(5)
    brute = {i for i in range(400) if not ((x >= x[i]).all(1) & (x > x[i]).any(1)).any()}
    assert {r.id for r in ranking.pareto_front(d, ["a", "b", "c"], block=8).collect()} == brute


def test_cap_weights(spark):
    d = spark.createDataFrame([(1, s, w) for s, w in zip("abcd", (8.0, 1.0, 1.0, 0.5))], "ts_ns long, symbol string, raw_weight double")
    w = {r.symbol: r.weight for r in kernels.cap_weights(d, cap=0.4).collect()}
    assert w["a"] == pytest.approx(0.4) and sum(w.values()) == pytest.approx(1.0) and max(w.values()) <= 0.4 + 1e-12


def test_kalman_block_size(spark):
    rng = np.random.default_rng(4)
    x = 50 + rng.normal(size=200).cumsum()
    rows = [(s, (i + 1) * 1000, float(v)) for s, p in (("y", 2 * x + rng.normal(size=200)), ("x", x)) for i, v in enumerate(p)]
    b = spark.createDataFrame(rows, "symbol string, ts_ns long, close double")
    one = kernels.kalman_hedge(b, "y", "x", span_ns=10**9).orderBy("ts_ns").toPandas()
    cut = kernels.kalman_hedge(b, "y", "x", span_ns=40_000).orderBy("ts_ns").toPandas()
    assert np.allclose(one[["spread", "beta"]], cut[["spread", "beta"]], atol=1e-6)


def test_calibration_optimum(spark):
    rng = np.random.default_rng(6)
    s = rng.normal(size=500)
    y = (rng.random(500) < 1 / (1 + np.exp(-(1.5 * s + 0.3)))).astype(int)
    r = labels.fit_calibration(spark.createDataFrame([(float(a), int(b)) for a, b in zip(s, y)], "score double, label int")).first()
    t = np.where(y == 1, (y.sum() + 1) / (y.sum() + 2), 1 / (len(y) - y.sum() + 2))
    p = 1 / (1 + np.exp(r.a * s + r.b))
    assert abs(((t - p) * s).sum() + 1e-3 * r.a) < 0.05 and abs((t - p).sum()) < 0.05


def test_adf_separates(spark):
    rng = np.random.default_rng(7)
    walk, noise = rng.normal(size=800).cumsum(), rng.normal(size=800)
    rows = [(k, i + 1, float(v)) for k, p in (("walk", walk), ("noise", noise)) for i, v in enumerate(p)]
    d = spark.createDataFrame(rows, "symbol string, seq long, v double")
    got = {r.symbol: r.adf_stat for r in kernels.adf_statistic(d, "v", ["symbol"]).collect()}
    assert got["noise"] < -10 and got["walk"] > -3.5


def test_stationarity_of_a_symbol_ignores_longer_symbols(spark):
    rng = np.random.default_rng(12)
    rows = [(s, (i + 1) * DAY, float(v)) for s, n in (("long", 400), ("short", 16), ("tiny", 5)) for i, v in enumerate(100 + rng.normal(size=n).cumsum())]
    bars = spark.createDataFrame(rows, "symbol string, ts_ns long, close double")
    grid = (0.0, 0.4, 1.0)

    def found(b):
        stat, best = kernels.stationarity_search(b, grid)
        return {(r.symbol, r.d): (r.n, r.lags, round(r.adf_stat, 6)) for r in stat.collect()}, {r.symbol: r.optimal_d for r in best.collect()}

    stat, best = found(bars)
    assert set(stat) == {(s, d) for s in ("long", "short", "tiny") for d in grid} and set(best) == {"long", "short", "tiny"}
    # 16 rows allow 5 lags at d = 0: the sample starts at row 7
    assert stat["short", 0.0][0] == 10 and not np.isnan(stat["short", 0.0][2])
    for s in ("short", "long"):
        alone, alone_best = found(bars.filter(bars.symbol == s))
        assert all(str(stat[k]) == str(v) for k, v in alone.items()) and best[s] == alone_best[s]


def test_regime_rows(spark):
    rng = np.random.default_rng(8)
    rows = [(s, (i + 1) * DAY, float(v)) for s in "ab" for i, v in enumerate(rng.normal(scale=0.01, size=90))]
    r = spark.createDataFrame(rows, "symbol string, ts_ns long, ret double")
    one = kernels.regime_filter(r, ["a", "b"], span_ns=1000 * DAY).orderBy("ts_ns").toPandas()
    cut = kernels.regime_filter(r, ["a", "b"], span_ns=20 * DAY).orderBy("ts_ns").toPandas()
    cols = ["p_calm", "p_trend", "p_panic"]
    assert len(one) == 90 and np.allclose(one[cols].sum(axis=1), 1.0) and np.allclose(one[cols], cut[cols], atol=1e-6)
    x = np.array([v for _, _, v in rows]).reshape(2, 90)
    size = np.minimum(np.arange(1, 91), 60) * one[cols].max(axis=1)
    heat = np.maximum(x.std(axis=0), 1e-4) * np.sqrt(np.log(100.0) / np.maximum(size, 2.0))
    assert np.allclose(one["effective_sample_size"], size) and np.allclose(one["temperature"], np.clip(heat, 1e-4, 10.0))
    tight = kernels.regime_filter(r, ["a", "b"], temperatures=(0.002, 0.003)).toPandas()["temperature"]
    assert tight.min() >= 0.002 and tight.max() <= 0.003


def test_tiers_step_down_after_dwell(spark):
    shocks = [0.1, 0.95] + [0.2] * 6 + [0.5, 0.2, 0.1]
    rows = [("b", (i + 1) * DAY, s, 0.8, False) for i, s in enumerate(shocks)]
    d = spark.createDataFrame(rows, "book string, ts_ns long, shock double, haircut double, panic boolean")
    want = ["NORMAL"] + ["HALT"] * 5 + ["DERISK"] * 5
    bars = [1, 1, 2, 3, 4, 5, 1, 2, 3, 4, 5]
    for size in (2, 1000):
        got = kernels.tier_hysteresis(d, block_rows=size).orderBy("ts_ns").collect()
        assert [r.tier for r in got] == want and [r.bars_in_tier for r in got] == bars


def test_shrunk_covariance_trailing_window(spark):
    x = np.random.default_rng(9).normal(size=(40, 2))
    rows = [(s, (i + 1) * DAY, float(v)) for i, r in enumerate(x) for s, v in zip("ab", r)]
    c = kernels.rolling_shrunk_covariance(spark.createDataFrame(rows, "symbol string, ts_ns long, ret double"), ["a", "b"], window=10)
    got = {(r.s1, r.s2): r.cov for r in c.filter(F.col("ts_ns") == 40 * DAY).collect()}
    s = np.cov(x[30:], rowvar=False, bias=True)
    tr, tr2 = np.trace(s), (s * s).sum()
    rho = min(1.0, tr * tr / ((10 + 1 - 1) * (tr2 - tr * tr / 2)))
    want = (1 - rho) * s + rho * tr / 2 * np.eye(2)
    assert got[("a", "a")] == pytest.approx(want[0, 0]) and got[("a", "b")] == pytest.approx(want[0, 1])


def test_lifo_takes_the_first_of_equal_times(spark):
    rows = [(1, "X", "BUY", 10.0, 100.0, 5, 1), (1, "X", "BUY", 10.0, 200.0, 5, 2), (1, "X", "SELL", 10.0, 300.0, 9, 3)]
    s = lots.split_fills(spark.createDataFrame(rows, FILL), ["ts_ns", "n"])
    for block in (1, 4096):
        m = lots.lifo_matches(s, block_fills=block, fan=2).collect()
        assert [(r.open_no, r.close_no, r.realized_pnl) for r in m] == [(1, 3, 2000.0)]


def test_aligned_prices_with_a_repeated_key(spark):
    b = bars_of(spark, [("A", DAY, 100.0, 1.0), ("A", DAY, 100.0, 1.0), ("A", 2 * DAY, 110.0, 1.0)])
    assert [r.ret for r in series.aligned_returns(b, ["A"]).collect()] == pytest.approx([0.1])


def test_centrality_of_all_tags(spark):
    d = spark.createDataFrame([("IBM beats", "also APPLE", ["IBM", "XOM"])], "h string, s string, t array<string>")
    got = d.select(text.centrality(F.col("h"), F.col("s"), F.col("t"), F.lit("GENERAL_MARKET")).alias("c")).first().c
    assert {(c.ticker, c.centrality) for c in got} == {("IBM", 1.0), ("AAPL", 0.5), ("XOM", 0.3)}


def test_novelty_without_words(spark):
    rows = [(k, k * 1_000_000_000, h, "", "w", ["A"]) for k, h in enumerate(["!!!", "!!!", "fed cut", "fed cut"], 1)]
    d = spark.createDataFrame(rows, "article_id long, available_ns long, headline string, summary string, source string, tickers array<string>")
    assert {r.article_id: r.novelty for r in news.novelty(d).collect()} == {1: 1.0, 2: 1.0, 3: 1.0, 4: 0.1}


def test_html_references(spark):
    d = spark.createDataFrame([("<b>A&amp;lt;B</b> &frac12;&#x41;&#66; &copy 5&middot;6",)], "t string")
    assert d.select(text.clean_html(F.col("t")).alias("c")).first().c == "A&lt;B ½AB © 5·6"


def test_adf_p_values():
    # critical values of the distribution with a constant
    assert [round(kernels.adf_p_value(x), 2) for x in (-3.43, -2.86, -2.57)] == [0.01, 0.05, 0.10]
    assert kernels.adf_p_value(-30.0) == 0.0 and kernels.adf_p_value(5.0) == 1.0


def test_subspace_novelty_against_numpy(spark):
    rng = np.random.default_rng(3)
    elites, x = rng.normal(size=(70, 80)), rng.normal(size=(4, 80))
    long = lambda m: spark.createDataFrame([(i, p, float(v)) for i, r in enumerate(m) for p, v in enumerate(r)], "id long, pos long, value double")
    unit = lambda m: (m - m.mean(1, keepdims=True)) / np.linalg.norm(m - m.mean(1, keepdims=True), axis=1, keepdims=True)
    _, s, vt = np.linalg.svd(unit(elites), full_matrices=False)
    k = min(int(np.searchsorted(np.cumsum(s**2) / (s**2).sum(), 0.99)) + 1, 50)
    want = 1 - ((unit(x) @ vt[:k].T) ** 2).sum(1)
    viable = spark.createDataFrame([(0,), (1,), (2,)], "id long")
    got = {r.id: r.novelty for r in ranking.subspace_novelty(long(x), long(elites), viable=viable).collect()}
    assert [got[i] for i in range(3)] == pytest.approx(want[:3]) and got[3] == 0.0
    none = {r.id: r.novelty for r in ranking.subspace_novelty(long(x), long(elites).limit(0), viable=viable).collect()}
    assert none == {0: 1.0, 1: 1.0, 2: 1.0, 3: 0.0}


def test_strategy_weights_across_blocks(spark):
    rng = np.random.default_rng(6)
    rows = [("b", (i + 1) * DAY, ("bull", "PANIC", "odd")[i % 3], *map(float, rng.normal(size=4))) for i in range(50)]
    d = spark.createDataFrame(rows, "book string, ts_ns long, regime string, a double, b double, c double, d double")
    w, want = np.full(4, 0.25), []
    for _, _, regime, *r in rows:
        w = w * np.exp(0.05 * np.array(r))
        w = 0.8 * w / w.sum() + 0.2 * np.array(portfolio.REGIME_PRIORS.get(regime.upper(), portfolio.REGIME_PRIORS["NORMAL"]))
        want.append(w)
    for span in (1000 * DAY, 7 * DAY):
        got = portfolio.strategy_weights(d, ["a", "b", "c", "d"], span_ns=span).orderBy("ts_ns").toPandas()
        assert np.allclose(got[["a", "b", "c", "d"]], want)


def test_upsert_sink_keeps_the_last_write(spark, tmp_path):
    write = sinks.upsert_sink(str(tmp_path / "t"), ["k"], buckets=2, order=["at"])
    batch = lambda rows: spark.createDataFrame(rows, "k long, at long, v string")
    write(batch([(1, 1, "a"), (1, 3, "c"), (1, 2, "b"), (2, 1, "x")]), 0)
    write(batch([(1, 0, "late")]), 1)
    write(batch([(1, 0, "late")]), 1)
    assert {(r.k, r.v) for r in spark.read.parquet(str(tmp_path / "t")).collect()} == {(1, "late"), (2, "x")}


def test_money_rounds_like_exact_arithmetic(spark):
    rng = random.Random(8)
    values = [2.675, 0.125, 0.375, -0.125, 1.005, 0.615, 1e17, 0.0, -2.5, 5.015, 8.345]
    values += [rng.randrange(10**9) / 1000 for _ in range(300)] + [rng.uniform(-1e6, 1e6) for _ in range(300)] + [rng.randrange(-10**5, 10**5) / 8 for _ in range(300)]
    d = spark.createDataFrame([(v,) for v in values], "v double")
    for n in (0, 1, 2, 4, 6):
        got = [r[0] for r in d.select(money.round_even("v", n)).collect()]
        assert got == [float(round(v, n)) for v in values]


@pytest.mark.parametrize("n", [10, 120, 300])
def test_rolling_cascade_is_the_cascade_of_each_window(spark, n):
    x = np.random.default_rng(n).standard_t(4, size=n) * 0.01
    rows = [("A", (i + 1) * DAY, float(v)) for i, v in enumerate(x)]
    d = spark.createDataFrame(rows, "symbol string, ts_ns long, loss double")
    got = {r.ts_ns: r for r in tail.rolling_cascade(d, capacity=280).collect()}
    assert len(got) == n - 1
    last = tail.risk_cascade(spark.createDataFrame(rows[-280:], d.schema), ["symbol"]).first()
    assert (got[n * DAY].method, got[n * DAY].var, got[n * DAY].cvar) == (last.method, pytest.approx(last["var"]), pytest.approx(last.cvar))


def test_classify_reads_texts_without_filter(spark):
    """No filter evaluates the word rules on the texts a second time."""
    rows = [(1, "Apple beats earnings", "strong growth", "s", 0, ["AAPL"]), (2, "Fed hints rate cut", "", "s", 60, []), (3, "Market wrap", None, "s", 120, [])]
    a = spark.createDataFrame(rows, "article_id long, headline string, summary string, source string, available_ns long, tickers array<string>")
    out = news.classify(a.repartition(2))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in plan.splitlines() if "Filter" in line and "ontains(" in line]
    assert {(r.article_id, r.ticker) for r in out.collect()} == {(1, "AAPL"), (2, "SPY"), (2, "QQQ"), (3, "SPY")}
    assert {r.article_id for r in news.classify(a, proxy=False).collect()} == {1, 2}


def test_novelty_against_all_pairs(spark):
    """Blocks of 3 articles; the history, the horizon and equal times cut the comparisons."""
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice("abcdefg") for _ in range(rng.randint(1, 5))), "", "s", rng.randint(0, 60) * 1_000_000_000) for i in range(80)]
    a = spark.createDataFrame(rows, "article_id long, headline string, summary string, source string, available_ns long")
    want, firsts = {}, []
    for i, head, _, _, at in sorted(rows, key=lambda r: (r[4], r[0])):
        if head in {h for _, h, _ in firsts}:
            want[i] = 0.1
            continue
        words = set(head.split())
        near = [len(words & w) / len(words | w) for t, _, w in firsts[-3:] if at - t < 5_000_000_000]
        want[i] = max(0.1, math.exp(-2 * max(near, default=0.0)))
        firsts.append((at, head, words))
    got = {r.article_id: r.novelty for r in news.novelty(a, horizon_s=5.0, history=3).collect()}
    assert got == pytest.approx(want)


def test_small_books_are_dealt_once(spark):
    """Whole books: fills move once, and open lots follow the scan; with large books among them the results stay."""
    rng = random.Random(9)
    rows = [(b, "X", rng.choice(["BUY", "SELL"]), float(rng.randint(1, 40)), float(rng.randint(50, 150)), i, i) for i in range(200) for b in (1, 2, 2, 2)]
    fills = spark.createDataFrame([(*r[:6], k) for k, r in enumerate(rows)], FILL)
    found = []
    for limit in (None, 300, 5):
        s = lots.split_fills(fills, ["ts_ns", "n"], block_rows=limit)
        m = lots.fifo_matches(s, block_rows=limit)
        if limit is None:
            assert m._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
        held = sorted(lots.fifo_open_lots(s, block_rows=limit).collect())
        assert held == sorted(lots.open_lots(s, m).collect())
        found.append((sorted(m.collect()), held))
    assert found[0] == found[1] == found[2]


def test_crowding_with_ties(spark):
    """Equal values stand by id; only their first and last row have a gap."""
    rng = random.Random(4)
    rows = [(1 + i % 3, i, float(rng.randint(0, 6)), rng.random(), 2.5) for i in range(150)] + [(9, 900, 1.0, 1.0, 1.0), (8, 901, 1.0, 2.0, 1.0), (8, 902, 1.0, 2.0, 1.0)]
    d = spark.createDataFrame(rows, "rank long, id long, o1 double, o2 double, o3 double")
    want = {}
    for rank in {r[0] for r in rows}:
        for m in (2, 3, 4):
            front = sorted((r[m], r[1]) for r in rows if r[0] == rank)
            width = front[-1][0] - front[0][0]
            for k, (_, i) in enumerate(front):
                inner = 0 < k < len(front) - 1
                part = math.inf if not inner else (front[k + 1][0] - front[k - 1][0]) / width if width > 1e-8 else 0.0
                want[i] = want.get(i, 0.0) + part
    out = ranking.crowding(d, ["o1", "o2", "o3"])
    assert {r.id: r.crowding for r in out.collect()} == pytest.approx(want)
    # no row of the front carries a number of its place: the values are put in order, not the rows
    assert "seq" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_sentiment_of_one_day_is_dealt(spark):
    """A symbol and day is no single join key, and the parts add up to the whole."""
    rng = random.Random(6)
    events = [("A", rng.randint(0, 20) * DAY // 8, rng.randint(-10, 10) / 10.0, rng.randint(0, 9) / 10.0, 0.25) for _ in range(60)]
    e = spark.createDataFrame(events, "symbol string, ts_ns long, polarity double, urgency double, centrality double")
    g = spark.createDataFrame([("A", k * DAY // 6) for k in range(18)] + [("B", 0)], "symbol string, ts_ns long")
    by = {p: sorted(portfolio.sentiment_signals(g, e, parts=p).select("symbol", "ts_ns", "active_events", "target_weight").collect()) for p in (1, 16)}
    assert by[1] == by[16] and len(by[1]) == 19
    plan = portfolio.sentiment_signals(g, e)._jdf.queryExecution().optimizedPlan().toString()
    assert any("Join Inner" in line and "_part" in line for line in plan.splitlines())
