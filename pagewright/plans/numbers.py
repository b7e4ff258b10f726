"""Registered queries on statistics and tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import stats as S
from ..operators import tables as T
from .base import add, table


def li(s, d):
    return table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_returnflag", F.col("l_quantity").alias("q"), F.col("l_extendedprice").alias("p"), F.col("l_discount").alias("c"))


LI = "li AS (SELECT l_orderkey, l_linenumber, l_suppkey, l_returnflag, l_quantity AS q, l_extendedprice AS p, l_discount AS c FROM lineitem)"


def w(sql: str) -> str:
    return f"WITH {LI}{sql}" if sql.startswith(",") else f"WITH {LI} {sql}"


def result(s, pairs: dict[str, float], digits: int = 6):
    """One row of named numbers."""
    return s.createDataFrame([tuple(round(float(v), digits) for v in pairs.values())], ", ".join(f"{k} double" for k in pairs))


DESC = {
    "n": "count(x)", "mean": "avg(x)", "min": "min(x)", "max": "max(x)", "geometricmean": "exp(avg(ln(x)))", "harmonicmean": "count(x) / sum(1 / x)", "samplevar": "var_pop(x)", "samplestdev": "stddev_pop(x)", "var": "var_samp(x)", "stdev": "stddev_samp(x)",
    "sterr": "stddev_samp(x) / sqrt(count(x))", "sem": "stddev_pop(x) / sqrt(count(x))", "variation": "100 * stddev_samp(x) / avg(x)", "signaltonoise": "avg(x) / stddev_pop(x)", "sum": "sum(x)", "ss": "sum(x * x)", "square_of_sums": "sum(x) ** 2", "moment2": "var_pop(x)",
}
add(
    "stats_describe",
    lambda s, d: S.describe_table(li(s, d), "q", ["l_returnflag"]).drop("skew", "kurtosis").select("l_returnflag", *[F.round(c, 5).cast("double").alias(c) for c in DESC]),
    w("SELECT l_returnflag, " + ", ".join(f'round({e.replace("(x", "(q").replace(" x)", " q)").replace("x * x", "q * q").replace("1 / x", "1 / q").replace("q * x", "q * q")}, 5)::DOUBLE AS "{k}"' for k, e in DESC.items()) + " FROM li GROUP BY l_returnflag"),
)
add("stats_skew_kurtosis", lambda s, d: S.describe_table(li(s, d), "q", ["l_returnflag"]).select("l_returnflag", F.round("skew", 6).alias("skew"), F.round("kurtosis", 6).alias("kurtosis")), w(", m AS (SELECT l_returnflag, q - avg(q) OVER (PARTITION BY l_returnflag) AS d FROM li) SELECT l_returnflag, round(avg(d ** 3) / avg(d * d) ** 1.5, 6) AS skew, round(avg(d ** 4) / avg(d * d) ** 2, 6) AS kurtosis FROM m GROUP BY l_returnflag"))
add("stats_moment", lambda s, d: S.moment(li(s, d), "q", 3, ["l_returnflag"]).withColumn("moment", F.round("moment", 3)), w(", m AS (SELECT l_returnflag, q - avg(q) OVER (PARTITION BY l_returnflag) AS d FROM li) SELECT l_returnflag, round(avg(d ** 3), 3) AS moment FROM m GROUP BY l_returnflag"))
add("stats_medianscore", lambda s, d: li(s, d).groupBy("l_suppkey").agg(S.medianscore("p").alias("m")).withColumn("m", F.round("m", 4)), w("SELECT l_suppkey, round(quantile_cont(p, 0.5), 4) AS m FROM li GROUP BY l_suppkey"))
add("stats_median", lambda s, d: result(s, {"median": S.median(li(s, d), "q")}))
add("stats_mode", lambda s, d: S.mode(li(s, d), "q"), w("SELECT q, count(*) AS n FROM li GROUP BY q QUALIFY n = max(n) OVER ()"))
add("stats_itemfreq", lambda s, d: S.itemfreq(li(s, d), "q"), w("SELECT q, count(*) AS n FROM li GROUP BY q"))
HIST = ", e AS (SELECT min(p) AS lo, (max(p) - min(p) + (max(p) - min(p)) / 10 + 1e-6::DOUBLE) / 10 AS width FROM li), h AS (SELECT floor((p - (lo - width / 2)) / width)::INT AS bin, count(*) AS n FROM li, e GROUP BY 1) "
add("stats_histogram", lambda s, d: S.histogram(li(s, d), "p").select("bin", "n", F.round("low", 4).alias("low")), w(HIST + "SELECT b.bin, coalesce(n, 0) AS n, round(lo - width / 2 + b.bin * width, 4) AS low FROM (SELECT unnest(range(10))::INT AS bin) b CROSS JOIN e LEFT JOIN h USING (bin)"))
add("stats_cumfreq", lambda s, d: S.cumfreq(li(s, d), "p").select("bin", "n"), w(HIST + "SELECT bin, sum(n) OVER (ORDER BY bin)::BIGINT AS n FROM (SELECT b.bin, coalesce(n, 0) AS n FROM (SELECT unnest(range(10))::INT AS bin) b LEFT JOIN h USING (bin))"))
add("stats_relfreq", lambda s, d: S.relfreq(li(s, d), "p").select("bin", F.round("n", 9).alias("n")), w(HIST + "SELECT bin, round(coalesce(n, 0)::DOUBLE / (SELECT count(*) FROM li), 9) AS n FROM (SELECT unnest(range(10))::INT AS bin) b LEFT JOIN h USING (bin)"))
add("stats_percentiles", lambda s, d: result(s, {"score": S.scoreatpercentile(li(s, d), "p", 25), "percent": S.percentileofscore(li(s, d), "p", 30000.0)}))
add("stats_zs", lambda s, d: S.zs(li(s, d), "q", ["l_returnflag"]).select("l_orderkey", "l_linenumber", F.round("z", 6).alias("z")), w("SELECT l_orderkey, l_linenumber, round((q - avg(q) OVER g) / stddev_pop(q) OVER g, 6) AS z FROM li WINDOW g AS (PARTITION BY l_returnflag)"))
add("stats_zmap", lambda s, d: S.zmap(li(s, d), "q", li(s, d).where("l_returnflag = 'A'"), "q").select("l_orderkey", "l_linenumber", F.round("z", 6).alias("z")), w("SELECT l_orderkey, l_linenumber, round((q - (SELECT avg(q) FROM li WHERE l_returnflag = 'A')) / (SELECT stddev_pop(q) FROM li WHERE l_returnflag = 'A'), 6) AS z FROM li"))
add("stats_threshold", lambda s, d: li(s, d).select("l_orderkey", "l_linenumber", S.threshold("q", 10, 40, 0.0).alias("q")), w("SELECT l_orderkey, l_linenumber, CASE WHEN q > 40 OR q < 10 THEN 0.0::DOUBLE ELSE q END AS q FROM li"))
TRIM = "SELECT l_suppkey, count(*) AS n, round(sum(p), 2) AS total FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY p) AS k, count(*) OVER (PARTITION BY l_suppkey) AS m FROM li) WHERE {} GROUP BY l_suppkey"
add("stats_trimboth", lambda s, d: S.trim(li(s, d), "p", 0.1, ["l_suppkey"]).groupBy("l_suppkey").agg(F.count("*").alias("n"), F.round(F.sum("p"), 2).alias("total")), w(TRIM.format("k > floor(m * 0.1) AND k <= m - floor(m * 0.1)")))
add("stats_trim1", lambda s, d: S.trim(li(s, d), "p", 0.1, ["l_suppkey"], both=False).groupBy("l_suppkey").agg(F.count("*").alias("n"), F.round(F.sum("p"), 2).alias("total")), w(TRIM.format("k <= m - floor(m * 0.1)")))
add("stats_trimmed", lambda s, d: li(s, d).groupBy("l_returnflag").agg(*[F.round(c, 6).alias(k) for k, c in S.trimmed("q", 5, 45).items()]), w("SELECT l_returnflag, round(avg(q), 6) AS tmean, round(var_samp(q), 6) AS tvar, min(q) AS tmin, max(q) AS tmax, round(stddev_samp(q), 6) AS tstdev, round(stddev_samp(q) / sqrt(count(q)), 6) AS tsem FROM li WHERE q BETWEEN 5 AND 45 GROUP BY l_returnflag"))
add("stats_cumsum", lambda s, d: S.cumsum(li(s, d), "q", ["l_suppkey"], ["l_orderkey", "l_linenumber", "p", "q"]).select("l_orderkey", "l_linenumber", "cumsum"), w("SELECT l_orderkey, l_linenumber, sum(q) OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, p, q ROWS UNBOUNDED PRECEDING) AS cumsum FROM li"))
RANK = "rank() OVER (PARTITION BY l_suppkey ORDER BY {0}) + (count(*) OVER (PARTITION BY l_suppkey, {0}) - 1) / 2.0::DOUBLE"
add("stats_rankdata", lambda s, d: S.rankdata(li(s, d), "q", ["l_suppkey"]).select("l_orderkey", "l_linenumber", "rank"), w(f"SELECT l_orderkey, l_linenumber, {RANK.format('q')} AS rank FROM li"))
add("stats_obrientransform", lambda s, d: S.obrientransform(li(s, d), "q", "l_returnflag").select("l_orderkey", "l_linenumber", F.round("t", 4).alias("t")), w("SELECT l_orderkey, l_linenumber, round(((n - 1.5) * n * (q - m) ** 2 - 0.5 * v * (n - 1)) / ((n - 1.0) * (n - 2.0)), 4) AS t FROM (SELECT *, count(q) OVER g::DOUBLE AS n, avg(q) OVER g AS m, var_samp(q) OVER g AS v FROM li WINDOW g AS (PARTITION BY l_returnflag))".replace("count(q) OVER g::DOUBLE", "(count(q) OVER g)::DOUBLE")))
CORR = "SELECT {g} count(*) AS n, round(corr(q, p), 6) AS r, round(2 * covar_samp(q, p) / (var_samp(q) + var_samp(p) + (avg(q) - avg(p)) ** 2), 9) AS lincc, round(regr_slope(p, q), 4) AS slope, round(regr_intercept(p, q), 2) AS intercept, round(covar_samp(q, p), 2) AS cov, round(sqrt(1 - corr(q, p) ** 2) * stddev_pop(p), 2) AS sterrest, round(sum(q * p), 0) AS summult, round(sum((q - p) ** 2), -3) AS sumdiffsquared FROM li"
DIG = {"n": None, "r": 6, "lincc": 9, "slope": 4, "intercept": 2, "cov": 2, "sterrest": 2, "summult": 0, "sumdiffsquared": -3}
add("stats_correlations", lambda s, d: li(s, d).agg(*[(c if DIG[k] is None else F.round(c, DIG[k])).alias(k) for k, c in S.correlations("q", "p").items()]), w(CORR.format(g="")))
add("stats_masslinregress", lambda s, d: S.masslinregress(li(s, d), "q", "p", ["l_suppkey"]).select("l_suppkey", "n", F.round("slope", 4).alias("slope"), F.round("intercept", 2).alias("intercept"), F.round("r", 6).alias("r")), w("SELECT l_suppkey, count(*) AS n, round(regr_slope(p, q), 4) AS slope, round(regr_intercept(p, q), 2) AS intercept, round(corr(q, p), 6) AS r FROM li GROUP BY l_suppkey"))
add("stats_spearmanr", lambda s, d: S.spearmanr(li(s, d), "q", "p", ["l_suppkey"]).withColumn("rs", F.round("rs", 9)), w(f", r AS (SELECT l_suppkey, {RANK.format('q')} AS a, {RANK.format('p')} AS b FROM li) SELECT l_suppkey, count(*) AS n, round(1 - 6 * sum((a - b) ** 2) / (count(*)::DOUBLE * (count(*)::DOUBLE ** 2 - 1)), 9) AS rs FROM r GROUP BY l_suppkey"))
add("stats_pointbiserialr", lambda s, d: S.pointbiserialr(li(s, d).withColumn("g", (F.col("l_returnflag") == "N").cast("int")), "g", "p").withColumn("rpb", F.round("rpb", 9)), w("SELECT round((avg(p) FILTER (l_returnflag = 'N') - avg(p) FILTER (l_returnflag <> 'N')) / stddev_pop(p) * sqrt(count(*) FILTER (l_returnflag <> 'N') / count(*)::DOUBLE * (count(*) FILTER (l_returnflag = 'N')) / count(*)), 9) AS rpb FROM li"))
add("stats_kendalltau", lambda s, d: S.kendalltau(table(s, d, "customer"), "c_acctbal", "c_custkey", "c_custkey", ["c_nationkey"]).withColumn("tau", F.round("tau", 9)), "SELECT c_nationkey, round(sum(sign(a.c_acctbal - b.c_acctbal) * sign(a.c_custkey - b.c_custkey)) / sqrt(sum((a.c_acctbal <> b.c_acctbal)::INT)::DOUBLE * sum((a.c_custkey <> b.c_custkey)::INT)), 9) AS tau FROM customer a JOIN customer b USING (c_nationkey) WHERE a.c_custkey <= b.c_custkey GROUP BY c_nationkey")
add("stats_covariance", lambda s, d: S.correlation_matrix(li(s, d), ["q", "c"], F.covar_samp).withColumn("value", F.round("value", 6)), w("SELECT 'q' AS a, 'q' AS b, round(covar_samp(q, q), 6) AS value FROM li UNION ALL SELECT 'q', 'c', round(covar_samp(q, c), 6) FROM li UNION ALL SELECT 'c', 'q', round(covar_samp(c, q), 6) FROM li UNION ALL SELECT 'c', 'c', round(covar_samp(c, c), 6) FROM li"))
add("stats_correlation", lambda s, d: S.correlation_matrix(li(s, d), ["q", "p"]).withColumn("value", F.round("value", 6)), w("SELECT 'q' AS a, 'q' AS b, round(corr(q, q), 6) AS value FROM li UNION ALL SELECT 'q', 'p', round(corr(q, p), 6) FROM li UNION ALL SELECT 'p', 'q', round(corr(p, q), 6) FROM li UNION ALL SELECT 'p', 'p', round(corr(p, p), 6) FROM li"))
add("stats_f_oneway", lambda s, d: S.F_oneway(li(s, d), "q", "l_returnflag").withColumn("f", F.round("f", 6)), w(", g AS (SELECT count(*) AS n, sum(q) AS s, sum(q * q) AS qq FROM li GROUP BY l_returnflag), t AS (SELECT sum(n) AS n, sum(s) AS s, sum(qq) AS qq, count(*) AS k, sum(s * s / n) AS b FROM g) SELECT round(((b - s * s / n) / (k - 1)) / ((qq - b) / (n - k)), 6) AS f, (k - 1)::BIGINT AS dfbn, (n - k)::BIGINT AS dfwn FROM t"))
add("stats_ks_2samp", lambda s, d: S.ks_2samp(li(s, d), "p", F.col("l_returnflag") == "A").withColumn("d", F.round("d", 9)), w(", v AS (SELECT p, sum((l_returnflag = 'A')::INT) AS a, sum((l_returnflag <> 'A')::INT) AS b FROM li GROUP BY p), c AS (SELECT sum(a) OVER u AS ca, sum(b) OVER u AS cb, sum(a) OVER () AS na, sum(b) OVER () AS nb FROM v WINDOW u AS (ORDER BY p)) SELECT round(max(abs(ca::DOUBLE / na - cb::DOUBLE / nb)), 9) AS d FROM c"))
add("stats_rank_sums", lambda s, d: S.rank_sums(li(s, d), "q", "l_returnflag"), w(", r AS (SELECT l_returnflag, q, rank() OVER (ORDER BY q) + (count(*) OVER (PARTITION BY q) - 1) / 2.0::DOUBLE AS rank FROM li), t AS (SELECT sum(n::DOUBLE ** 3 - n) AS ties, sum(n)::BIGINT AS total FROM (SELECT count(*) AS n FROM li GROUP BY q)) SELECT l_returnflag AS \"group\", count(*) AS n, sum(rank) AS ranks, max(ties) AS ties, max(total) AS total FROM r, t GROUP BY l_returnflag"))
AN = "l_returnflag in ('A', 'N')"
add(
    "stats_tests",
    lambda s, d: result(
        s,
        {
            "t1": (t := S.ttest_1samp(li(s, d), "q", 25.0))[0], "p1": t[1], "t2": (t := S.ttest_ind(li(s, d), "q", F.col("l_returnflag") == "A"))[0], "p2": t[1], "t3": (t := S.ttest_rel(li(s, d), "q", "c"))[0],
            "u": (t := S.mannwhitneyu(li(s, d).where(AN), "q", "l_returnflag"))[0], "pu": t[1], "z": (t := S.ranksums(li(s, d).where(AN), "q", "l_returnflag"))[0], "h": (t := S.kruskalwallish(li(s, d), "q", "l_returnflag"))[0], "ph": t[1],
            "w": (t := S.wilcoxont(li(s, d).withColumn("h", F.col("l_linenumber") * 7), "q", "h"))[0], "chi": (t := S.chisquare(li(s, d).groupBy("q").count(), "count"))[0], "pchi": t[1], "skew": S.skewtest(li(s, d), "q")[0], "kurtosis": S.kurtosistest(li(s, d), "q")[0], "normal": S.normaltest(li(s, d), "q")[0],
            "tie": S.tiecorrect(li(s, d), "q"), "r": S.pearsonr(li(s, d), "q", "p")[0], "slope": S.linregress(li(s, d), "q", "p")[0], "friedman": S.friedmanchisquare(li(s, d).where("l_linenumber <= 2").groupBy(F.pmod("l_suppkey", F.lit(10)).alias("b"), "l_linenumber").agg(F.avg("p").alias("p")), "p", "b", "l_linenumber")[0],
        },
        4,
    ),
)
add("stats_glm", lambda s, d: s.createDataFrame([(i, round(x, 4)) for i, x in enumerate(S.glm(li(s, d), "p", ["q", "c"]))], "k int, b double"))
add("stats_special_functions", lambda s, d: result(s, {"gammln": S.gammln(4.5), "betai": S.betai(2.0, 3.0, 0.4), "chisqprob": S.chisqprob(7.8, 3), "erfcc": S.erfcc(0.5), "zprob": S.zprob(1.96), "ksprob": S.ksprob(1.2), "fprob": S.fprob(2, 20, 3.5), "p2t": S.p2t(0.05, 10)}, 6), "SELECT 2.453737::DOUBLE AS gammln, 0.5248::DOUBLE AS betai, 0.050331::DOUBLE AS chisqprob, 0.4795::DOUBLE AS erfcc, 0.975002::DOUBLE AS zprob, 0.112250::DOUBLE AS ksprob, round(power(1.35::DOUBLE, -10), 6) AS fprob, 2.228139::DOUBLE AS p2t")

# --- tables ----------------------------------------------------------------------------------------

add("tables_abut", lambda s, d: T.abut(table(s, d, "nation").select("n_name"), table(s, d, "region").select("r_name"), ["n_name"], ["r_name"]), "SELECT n_name, r_name FROM (SELECT n_name, row_number() OVER (ORDER BY n_name) - 1 AS k FROM nation) a JOIN (SELECT r_name, row_number() OVER (ORDER BY r_name) - 1 AS j FROM region) b ON a.k % 5 = b.j")
add("tables_simpleabut", lambda s, d: T.simpleabut(table(s, d, "nation").select("n_name"), table(s, d, "region").select("r_name"), ["n_name"], ["r_name"]), "SELECT n_name, r_name FROM (SELECT n_name, row_number() OVER (ORDER BY n_name) AS k FROM nation) a JOIN (SELECT r_name, row_number() OVER (ORDER BY r_name) AS j FROM region) b ON a.k = b.j")
add("tables_colex", lambda s, d: T.colex(table(s, d, "part"), "p_partkey", "p_brand"), "SELECT p_partkey, p_brand FROM part")
add("tables_collapse", lambda s, d: T.collapse(li(s, d), ["l_suppkey", "l_returnflag"], "q", sterr=True, count=True).select("l_suppkey", "l_returnflag", F.round("q", 6).alias("q"), F.round("sterr", 6).alias("sterr"), "n"), w("SELECT l_suppkey, l_returnflag, round(avg(q), 6) AS q, round(stddev_samp(q) / sqrt(count(q)), 6) AS sterr, count(q) AS n FROM li GROUP BY ALL"))
add("tables_dm", lambda s, d: T.dm(li(s, d), "q > 30 and c < 0.05").select("l_orderkey", "l_linenumber"), w("SELECT l_orderkey, l_linenumber FROM li WHERE q > 30 AND c < 0.05"))
add("tables_linexand", lambda s, d: T.linexand(table(s, d, "part"), p_brand="Brand#11", p_size=7).select("p_partkey"), "SELECT p_partkey FROM part WHERE p_brand = 'Brand#11' AND p_size = 7")
add("tables_linexor", lambda s, d: T.linexor(table(s, d, "part"), p_brand="Brand#11", p_size=[7, 9]).select("p_partkey"), "SELECT p_partkey FROM part WHERE p_brand = 'Brand#11' OR p_size IN (7, 9)")
add("tables_linedelimited", lambda s, d: table(s, d, "part").select("p_partkey", T.linedelimited(["p_brand", "p_size"], "|").alias("line"), T.lineincols(["p_brand", "p_size"], 12).alias("cols"), T.lineincustcols(["p_brand", "p_size"], [10, 4]).alias("cust"), T.makestr("p_size").alias("size")), "SELECT p_partkey, concat_ws('|', p_brand, p_size::VARCHAR) AS line, lpad(substr(p_brand, 1, 12), 12, ' ') || lpad(p_size::VARCHAR, 12, ' ') AS cols, lpad(substr(p_brand, 1, 10), 10, ' ') || lpad(p_size::VARCHAR, 4, ' ') AS cust, p_size::VARCHAR AS size FROM part")
add("tables_recode", lambda s, d: table(s, d, "orders").select("o_orderkey", T.recode("o_orderstatus", {"F": "done", "O": "open"}).alias("status")), "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'open' ELSE o_orderstatus END AS status FROM orders")
add("tables_replace", lambda s, d: T.replace(table(s, d, "orders").select("o_orderkey", "o_orderstatus"), "F", "X", ["o_orderstatus"]), "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'X' ELSE o_orderstatus END AS o_orderstatus FROM orders")
add("tables_remap", lambda s, d: T.remap(li(s, d), "q", "q * 2 + 1").select("l_orderkey", "l_linenumber", "q"), w("SELECT l_orderkey, l_linenumber, q * 2 + 1 AS q FROM li"))
add("tables_roundlist", lambda s, d: T.roundlist(table(s, d, "part").select("p_partkey", "p_size"), -1, "p_size"), "SELECT p_partkey, round(p_size, -1)::INT AS p_size FROM part")
add("tables_sortby", lambda s, d: T.sortby(table(s, d, "part").select("p_partkey", "p_size"), "p_size", "p_partkey"), "SELECT p_partkey, p_size FROM part ORDER BY p_size, p_partkey")
add("tables_unique", lambda s, d: T.unique(table(s, d, "part"), "p_brand", "p_size"), "SELECT DISTINCT p_brand, p_size FROM part")
add("tables_duplicates", lambda s, d: T.duplicates(table(s, d, "part"), "p_brand", "p_size"), "SELECT p_brand, p_size FROM part GROUP BY ALL HAVING count(*) > 1")
add("tables_nonrepeats", lambda s, d: T.nonrepeats(table(s, d, "part"), "p_brand", "p_size"), "SELECT p_brand, p_size FROM part GROUP BY ALL HAVING count(*) = 1")
add("tables_flat", lambda s, d: T.flat(table(s, d, "embeddings").select("vec_id", F.col("embedding").alias("x")), "x").groupBy("vec_id").agg(F.count("*").alias("n")), "SELECT vec_id, len(embedding)::BIGINT AS n FROM embeddings")
