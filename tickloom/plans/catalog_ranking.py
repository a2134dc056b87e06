"""Registered queries: population ranking."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.operators import ranking, series
from tickloom.plans import sqltext as S
from tickloom.plans.catalog_series import rounded, small_returns
from tickloom.sources import fixtures as fx

QUERIES: dict = {}
SQL: dict[str, str] = {}
U = S.UNIVERSE


def query(name: str, sql: str | None = None):
    def keep(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return keep


def population(spark, d):
    """Suppliers as strategies: scores from their account balance, key and nation."""
    k = F.col("s_suppkey")
    return fx.table(spark, d, "supplier").select(
        k.alias("id"), F.when(k % 11 != 0, F.col("s_acctbal") / 10000.0).alias("dsr"), F.when(k % 13 != 0, (k * 37 % 101) / 101.0).alias("mdd"),
        ((k * 53 % 97) / 97.0).alias("regret"), F.when(k % 7 != 0, F.col("s_nationkey") / 25.0).alias("novelty"))


POP = """pop AS (SELECT s_suppkey AS id, CASE WHEN s_suppkey % 11 <> 0 THEN s_acctbal / 10000.0 END AS dsr, CASE WHEN s_suppkey % 13 <> 0 THEN (s_suppkey * 37 % 101) / 101.0 END AS mdd,
  (s_suppkey * 53 % 97) / 97.0 AS regret, CASE WHEN s_suppkey % 7 <> 0 THEN s_nationkey / 25.0 END AS novelty FROM supplier),
ob AS (SELECT id, coalesce(dsr, 0) AS o1, -coalesce(mdd, 1) AS o2, -regret AS o3, coalesce(novelty, 0) AS o4 FROM pop)"""
DOM = "b.o1 >= a.o1 AND b.o2 >= a.o2 AND b.o3 >= a.o3 AND b.o4 >= a.o4 AND (b.o1 > a.o1 OR b.o2 > a.o2 OR b.o3 > a.o3 OR b.o4 > a.o4)"


def objectives(spark, d):
    return population(spark, d).select("id", F.coalesce("dsr", F.lit(0.0)).alias("o1"), (-F.coalesce("mdd", F.lit(1.0))).alias("o2"),
                                       (-F.col("regret")).alias("o3"), F.coalesce("novelty", F.lit(0.0)).alias("o4"))


OBJ = ["o1", "o2", "o3", "o4"]


@query("scalar_fitness", """SELECT p_partkey AS id, round((p_retailprice / 2000) * exp(-2.0::DOUBLE * greatest(p_size / 50.0, 0)) - 0.3 * greatest((p_partkey % 7 - 2) / 10.0, 0) + 0.2 * (p_partkey % 5), 6) AS fitness FROM part""")
def _(spark, d):
    k = F.col("p_partkey")
    f = ranking.fitness(F.col("p_retailprice") / 2000, F.col("p_size") / 50.0, (k % 7 - 2) / 10.0, (k % 5).cast("double"))
    return fx.table(spark, d, "part").select(k.alias("id"), F.round(f, 6).alias("fitness"))


PART = """pt AS (SELECT p_partkey AS id, p_retailprice AS o1, p_size::DOUBLE AS o2, (p_partkey * 7919 % 1009)::DOUBLE AS o3 FROM part)"""


def part_objectives(spark, d):
    return fx.table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_retailprice").alias("o1"), F.col("p_size").cast("double").alias("o2"),
                                             (F.col("p_partkey") * 7919 % 1009).cast("double").alias("o3"))


@query("pareto_front", f"""WITH {PART} SELECT id, o1, o2, o3 FROM pt a WHERE NOT EXISTS (SELECT 1 FROM pt b WHERE b.o1 >= a.o1 AND b.o2 >= a.o2 AND b.o3 >= a.o3 AND (b.o1 > a.o1 OR b.o2 > a.o2 OR b.o3 > a.o3))""")
def _(spark, d):
    return ranking.pareto_front(part_objectives(spark, d), ["o1", "o2", "o3"], block=128)


RANKS = f"""{POP}, dm AS (SELECT a.id AS lo, b.id AS hi FROM ob a JOIN ob b ON {DOM}),
ch AS (SELECT id, 1 AS r FROM ob UNION SELECT d.lo, c.r + 1 FROM ch c JOIN dm d ON d.hi = c.id),
rk AS (SELECT id, max(r)::BIGINT AS rank FROM ch GROUP BY 1)"""


@query("pareto_ranks", f"WITH RECURSIVE {RANKS} SELECT id, rank FROM rk")
def _(spark, d):
    return ranking.pareto_ranks(objectives(spark, d), OBJ).select("id", "rank")


CROWD = f"""{RANKS}, lg AS (SELECT rank, id, unnest([o1, o2, o3, o4]) AS v, unnest([1, 2, 3, 4]) AS m FROM ob JOIN rk USING (id)),
nb AS (SELECT *, lag(v) OVER w AS a, lead(v) OVER w AS z, row_number() OVER w AS i, count(*) OVER (PARTITION BY rank, m) AS n, max(v) OVER (PARTITION BY rank, m) - min(v) OVER (PARTITION BY rank, m) AS wd
  FROM lg WINDOW w AS (PARTITION BY rank, m ORDER BY v, id)),
cw AS (SELECT rank, id, sum(CASE WHEN n <= 2 OR i = 1 OR i = n THEN 'inf'::DOUBLE WHEN wd <= 1e-8 THEN 0 ELSE (z - a) / wd END) AS crowding FROM nb GROUP BY 1, 2)"""


@query("population_ranking", f"WITH RECURSIVE {CROWD} SELECT id, rank, CASE WHEN isinf(crowding) THEN 'inf'::DOUBLE ELSE round(crowding, 6) END AS crowding FROM cw")
def _(spark, d):
    r = ranking.rank_population(population(spark, d))
    return r.withColumn("crowding", F.when(F.col("crowding") == float("inf"), F.col("crowding")).otherwise(F.round("crowding", 6)))


@query("crowding_distance", """WITH lg AS (SELECT l_linenumber::BIGINT AS rank, l_orderkey * 8 + l_linenumber AS id, sum(l_extendedprice) AS o1, sum(l_quantity) AS o2 FROM lineitem GROUP BY 1, 2),
u AS (SELECT rank, id, unnest([o1, o2]) AS v, unnest([1, 2]) AS m FROM lg),
nb AS (SELECT *, lag(v) OVER w AS a, lead(v) OVER w AS z, row_number() OVER w AS i, count(*) OVER (PARTITION BY rank, m) AS n, max(v) OVER (PARTITION BY rank, m) - min(v) OVER (PARTITION BY rank, m) AS wd FROM u WINDOW w AS (PARTITION BY rank, m ORDER BY v, id))
SELECT rank, id, round(sum(CASE WHEN i = 1 OR i = n THEN 1e9 ELSE (z - a) / wd END), 6) AS crowding FROM nb GROUP BY 1, 2""")
def _(spark, d):
    li = fx.table(spark, d, "lineitem").groupBy(F.col("l_linenumber").cast("long").alias("rank"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("id")).agg(
        F.round(F.sum("l_extendedprice"), 2).alias("o1"), F.sum("l_quantity").alias("o2"))
    c = ranking.crowding(li, ["o1", "o2"])
    return c.withColumn("crowding", F.when(F.col("crowding") == float("inf"), 1e9).otherwise(F.round("crowding", 6)))


@query("novelty_pick", """WITH a AS (SELECT p_partkey AS id, p_size * 100.0::DOUBLE AS f, p_retailprice * 10 AS s FROM part WHERE p_partkey % 3 <> 0), e AS (SELECT p_size * 100.0::DOUBLE AS f, p_retailprice * 10 AS s FROM part WHERE p_partkey % 3 = 0),
d AS (SELECT a.id, round(avg(abs(a.f - e.f) / 3600 + abs(a.s - e.s) / 86400), 9) AS n FROM a CROSS JOIN e GROUP BY 1) SELECT id, round(n, 6) AS novelty FROM d ORDER BY n DESC, id LIMIT 1""")
def _(spark, d):
    p = fx.table(spark, d, "part").select(F.col("p_partkey").alias("id"), (F.col("p_size") * 100.0).alias("fast"), (F.col("p_retailprice") * 10).alias("slow"))
    return rounded(ranking.novelty_pick(p.filter("id % 3 <> 0"), p.filter("id % 3 = 0"), {"fast": 3600.0, "slow": 86400.0}), 6, "novelty")


@query("tolerant_front", f"""WITH {S.aligned()}, sm AS (SELECT symbol, ts_ns, ret / 100 AS ret FROM aligned), c AS (SELECT symbol AS id, avg(ret) / stddev_samp(ret) AS dsr, length(symbol) / 10.0 AS m1, ascii(symbol) / 100.0 AS m2 FROM sm GROUP BY 1),
pr AS (SELECT a.symbol AS s1, b.symbol AS s2, count(*) AS n, least(0.9999, greatest(-0.9999, corr(a.ret, b.ret))) AS rho FROM sm a JOIN sm b USING (ts_ns) WHERE a.symbol <> b.symbol GROUP BY 1, 2),
j AS (SELECT x.id AS a, y.id AS b, x.dsr AS da, y.dsr AS db, x.m1 AS a1, y.m1 AS b1, x.m2 AS a2, y.m2 AS b2, sqrt(greatest(0, (2 * (1 - rho) + 0.5 * (x.dsr * x.dsr + y.dsr * y.dsr - 2 * rho * rho * x.dsr * y.dsr)) / n)) AS se FROM pr JOIN c x ON x.id = s1 JOIN c y ON y.id = s2),
l AS (SELECT DISTINCT b FROM j WHERE a1 <= b1 + 1e-9 AND a2 <= b2 + 1e-9 AND (a1 < b1 - 1e-4 OR a2 < b2 - 1e-4 OR -da < -db) AND -da <= -db + se AND (-da < -db - se OR a1 < b1 - 1e-4 OR a2 < b2 - 1e-4))
SELECT id, round(dsr, 6) AS dsr FROM c WHERE id NOT IN (SELECT b FROM l)""")
def _(spark, d):
    r = small_returns(spark, d)
    c = r.groupBy(F.col("symbol").alias("id")).agg((F.avg("ret") / F.stddev_samp("ret")).alias("dsr")).select(
        "id", "dsr", F.lit(True).alias("feasible"), (-F.col("dsr")).alias("m0"), (F.length("id") / 10.0).alias("m1"), (F.ascii("id") / 100.0).alias("m2"))
    return rounded(ranking.tolerant_front(c, r, U).select("id", "dsr"), 6, "dsr")


@query("cohort_split", """WITH c AS (SELECT p_partkey AS id, 1 + p_size % 4 AS rank, p_retailprice / 1500 AS dsr, p_partkey % 9 <> 0 AS ok, (p_partkey * 31 % 977)::DOUBLE AS score FROM part), v AS (SELECT * FROM c WHERE ok AND dsr >= 0.5),
t AS (SELECT greatest(1, ceil(0.4 * count(*))) AS target, count(*) FILTER (rank = 1) AS f1 FROM v), s AS (SELECT id, row_number() OVER (ORDER BY score, id) AS r FROM v WHERE rank = 2)
SELECT v.id, v.rank::BIGINT AS rank, CASE WHEN v.rank = 1 OR r <= target - f1 THEN 'ALPHA' ELSE 'ASPIRANT' END AS cohort FROM v LEFT JOIN s USING (id) CROSS JOIN t""")
def _(spark, d):
    k = F.col("p_partkey")
    p = fx.table(spark, d, "part").select(k.alias("id"), (1 + F.col("p_size") % 4).cast("long").alias("rank"), (F.col("p_retailprice") / 1500).alias("dsr"),
                                          (k % 9 != 0).alias("feasible"), (k * 31 % 977).cast("double").alias("score"))
    return ranking.cohort_split(p, 0.4)


@query("cohort_split_unranked", """WITH v AS (SELECT p_partkey AS id, p_retailprice / 1500 AS dsr FROM part WHERE p_partkey % 9 <> 0 AND p_retailprice / 1500 >= 0.5)
SELECT id, CAST(NULL AS BIGINT) AS rank, CASE WHEN row_number() OVER (ORDER BY dsr DESC, id) <= greatest(1, ceil(0.2 * (SELECT count(*) FROM v))) THEN 'ALPHA' ELSE 'ASPIRANT' END AS cohort FROM v""")
def _(spark, d):
    """Without any front the best ratios lead."""
    k = F.col("p_partkey")
    return ranking.cohort_split(fx.table(spark, d, "part").select(
        k.alias("id"), F.lit(None).cast("long").alias("rank"), (F.col("p_retailprice") / 1500).alias("dsr"), (k % 9 != 0).alias("feasible"), F.lit(None).cast("double").alias("score")))


@query("phenotype_distance", """WITH g AS (SELECT p_partkey AS id, p_brand, [p_size::DOUBLE, p_retailprice] AS g FROM part), f AS (SELECT p_brand, arg_min(g, id) AS e FROM g GROUP BY 1)
SELECT id, round(sqrt((pow(least(1, greatest(0, (g[1] - 5) / 40)) - least(1, greatest(0, (e[1] - 5) / 40)), 2) + pow(least(1, greatest(0, (g[2] - 900) / 500)) - least(1, greatest(0, (e[2] - 900) / 500)), 2)) / 2), 6) AS distance FROM g JOIN f USING (p_brand)""")
def _(spark, d):
    p = fx.table(spark, d, "part").select(F.col("p_partkey").alias("id"), "p_brand", F.array(F.col("p_size").cast("double"), "p_retailprice").alias("g"))
    first = p.groupBy("p_brand").agg(F.min_by("g", "id").alias("e"))
    dist = ranking.phenotype_distance(F.col("g"), F.col("e"), [(5.0, 45.0), (900.0, 1400.0)])
    return p.join(first, "p_brand").select("id", F.round(dist, 6).alias("distance"))


@query("subspace_novelty")
def _(spark, d):
    e = fx.table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.posexplode(F.col("embedding").cast("array<double>")).alias("pos", "value"))
    e = e.withColumn("pos", F.col("pos").cast("long"))
    return rounded(ranking.subspace_novelty(e.filter("id % 2 = 0"), e.filter("id % 2 = 1")), 6, "novelty")
