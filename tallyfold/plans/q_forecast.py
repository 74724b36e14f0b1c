"""2.11 forecasting, 2.12 evaluation, with the paired join and weighted coverage of 2.3 and 2.4."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyfold.functions import calendar, cleaning
from tallyfold.operators import evaluate, intervals, models, panels, reconcile, selection
from tallyfold.plans.testbed import CALENDAR, PANEL, WEEKLY, WHOLE, Section, Tables, area_reporters, calendar_table, panel, sql_fields, weekly_visits
from tallyfold.sources import readers

section = Section()
#: The first 60 bits of the hash of a row of ``lineitem``.
PRINT = "CAST('0x' || substr(sha256(" + sql_fields("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate") + "), 1, 15) AS BIGINT)"
KEYS = ["model", "origin", "horizon"]
HORIZONS = list(range(1, 9))
VALUE_COLS = "round(y_pred, 6) AS y_pred, round(lo, 6) AS lo, round(hi, 6) AS hi"


def backtest(t: Tables) -> DataFrame:
    """Predictions of both naive models; most questions use them several times."""
    return t.kept("backtest", lambda: models.backtest(panel(t), ["naive", "drift"], HORIZONS))


def hybrid(t: Tables) -> DataFrame:
    return models.level_hybrid(backtest(t), "drift", "naive")


BACK = f"""{PANEL}, origins AS (SELECT CAST(m - 8 - 4 * i AS INTEGER) AS origin FROM (SELECT max(t) AS m FROM panel), generate_series(0, 12) g(i)),
    res AS (SELECT a.series_id, a.level, a.t, a.y - b.y AS r FROM panel a JOIN panel b ON b.series_id = a.series_id AND b.t = a.t - 52),
    q AS (SELECT series_id, origin, quantile_cont(r, 0.1) AS low, quantile_cont(r, 0.9) AS high, avg(r) FILTER (t > origin - 13) AS change FROM res, origins WHERE t <= origin GROUP BY ALL),
    raw AS (SELECT m.model, q.origin, CAST(h AS INTEGER) AS horizon, p.series_id, p.level, p.service, p.t, p.y AS y_real, greatest(s.y + CASE WHEN model = 'drift' THEN change ELSE 0 END, 0)::DOUBLE AS y_pred, low, high
        FROM (VALUES ('naive'), ('drift')) m(model), q, generate_series(1, 8) g(h), panel p, panel s WHERE p.series_id = q.series_id AND p.t = q.origin + h AND s.series_id = p.series_id AND s.t = p.t - 52),
    back AS (SELECT model, origin, horizon, series_id, level, service, t, y_real, y_pred, greatest(y_pred + low, 0) AS lo, greatest(y_pred + high, greatest(y_pred + low, 0)) AS hi FROM raw)"""
HYBRID = f"{BACK}, hybrid AS (SELECT 'hybrid' AS model, origin, horizon, series_id, level, service, t, y_real, y_pred, lo, hi FROM back WHERE CASE WHEN level = 'total' THEN model = 'drift' ELSE model = 'naive' END)"
SCALES = "scales AS (SELECT series_id, nullif(avg(abs(r)), 0) AS mase_scale, nullif(avg(r * r), 0) AS rmsse_scale FROM res WHERE t <= (SELECT min(origin) FROM origins) GROUP BY 1)"


def fitted_backtest(t: Tables) -> DataFrame:
    """Predictions of the fitted models from the same origins."""
    return t.kept("fitted-backtest", lambda: models.backtest(with_reporters(t), ["poisson", "trees"], HORIZONS))


def fitted_hybrid(t: Tables) -> DataFrame:
    return reconcile.structural(models.level_hybrid(fitted_backtest(t), "poisson", "trees"), KEYS)


def scales(t: Tables) -> DataFrame:
    p = panel(t)
    first = models.origins(p, 8, 13, 4).agg(F.min("origin").alias("t"))
    return evaluate.scales(p, first)


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


def show(df: DataFrame) -> DataFrame:
    return rounded(df, "y_pred", "lo", "hi").select("origin", "horizon", "series_id", "y_pred", "lo", "hi")


@section(f"WITH {PANEL} SELECT * FROM panel")
def l1_hierarchical_panel(t: Tables) -> DataFrame:
    return panel(t)


def _supervised(h: int) -> str:
    means = ", ".join(f"avg(y) OVER w{w} AS mean_{w}, stddev_samp(y) OVER w{w} AS sd_{w}" for w in (4, 13))
    windows = ", ".join(f"w{w} AS (PARTITION BY series_id ORDER BY t ROWS BETWEEN {h + w - 1} PRECEDING AND {h} PRECEDING)" for w in (4, 13))
    return f"""SELECT series_id, {h} AS horizon, t, y, {', '.join(f'lag(y, {h + k}) OVER s AS lag_{k}' for k in range(4))}, lag(y, 52) OVER s AS season, lag(y, {h}) OVER s - lag(y, {h + 52}) OVER s AS year_change, {means}, lag(reporters, {h}) OVER s AS reporters_0, lag(reporters, {h + 1}) OVER s AS reporters_1
        FROM covered WINDOW s AS (PARTITION BY series_id ORDER BY t), {windows}"""


_REPORTERS = """seen AS (SELECT DISTINCT area, region, facility, year, week FROM weekly), who AS (SELECT 'A' || lpad(CAST(area AS VARCHAR), 2, '0') AS series_id, year, week, count(*) AS n FROM seen GROUP BY ALL
    UNION ALL SELECT 'S' || CAST(region AS VARCHAR), year, week, count(*) FROM seen GROUP BY ALL UNION ALL SELECT 'TOTAL', year, week, count(*) FROM seen GROUP BY ALL),
    covered AS (SELECT p.*, CAST(coalesce(n, 0) AS BIGINT) AS reporters FROM panel p LEFT JOIN who USING (series_id, year, week))"""


def with_reporters(t: Tables) -> DataFrame:
    """The panel with a covariate: how many facilities of the series reported."""
    by_area = t.kept("area-reporters", lambda: area_reporters(t))
    # sums of the areas, so that the total is no hot key
    by_region = by_area.groupBy("region", "year", "week").agg(F.sum("n").alias("n"))
    total = by_region.groupBy("year", "week").agg(F.sum("n").alias("n"))
    name = lambda df, sid: df.select(sid.alias("series_id"), "year", "week", "n")
    who = name(by_area, F.concat(F.lit("A"), F.lpad(F.col("area").cast("string"), 2, "0"))).unionByName(name(by_region, F.concat(F.lit("S"), F.col("region").cast("string")))).unionByName(name(total, F.lit("TOTAL")))
    return t.kept("covered", lambda: panel(t).join(who, ["series_id", "year", "week"], "left").withColumn("reporters", F.coalesce("n", F.lit(0)).cast("long")).drop("n"))


def supervised(t: Tables) -> DataFrame:
    """Rows of all horizons and series."""
    return t.kept("supervised", lambda: panels.supervised(with_reporters(t), HORIZONS, covariates=("reporters",)))


@section(f"""WITH {PANEL}, {_REPORTERS}, x AS ({' UNION ALL '.join(map(_supervised, range(1, 9)))})
    SELECT series_id, horizon, t, y, lag_0, lag_3, season, year_change, round(mean_4, 6) AS mean_4, round(sd_13, 6) AS sd_13, reporters_0, reporters_1 FROM x WHERE year_change IS NOT NULL AND season IS NOT NULL""")
def l2_supervised(t: Tables) -> DataFrame:
    """Every horizon; features and covariates use nothing after the origin of their row."""
    return rounded(supervised(t), "mean_4", "sd_13").select("series_id", "horizon", "t", "y", "lag_0", "lag_3", "season", "year_change", "mean_4", "sd_13", "reporters_0", "reporters_1")


_UNIVERSE = f"""{WEEKLY}, {CALENDAR}, {WHOLE}, full_years AS (SELECT year, count(*) OVER () AS all_years FROM whole WHERE week <= 52 GROUP BY year HAVING count(*) = 52),
    u AS (SELECT facility, year, sum(total) AS total FROM weekly JOIN full_years USING (year) WHERE week <= 52 AND cause = 'AF' GROUP BY ALL), s AS (SELECT s_suppkey AS facility, count(year) AS years, coalesce(sum(total), 0) AS total, min(total) AS least, (SELECT max(all_years) FROM full_years) AS all_years FROM supplier LEFT JOIN u ON facility = s_suppkey GROUP BY 1)"""


@section(f"""WITH {_UNIVERSE} SELECT facility, CASE WHEN years < all_years THEN 'missing years' WHEN total / (52 * all_years) < 9.5 THEN 'low mean' WHEN least / 52 < 6.5 THEN 'low year' ELSE 'kept' END AS reason FROM s""")
def l3_universe(t: Tables) -> DataFrame:
    """Facilities with facts in every year that is covered whole, and with enough of them."""

    full = calendar_table(t).where("week <= 52").where(calendar.whole(F.col("first_day"), F.col("last_day"))).groupBy("year").agg(F.count("*").alias("weeks")).where("weeks = 52").select("year")
    # years, a few dozen at most
    by_year = weekly_visits(t).where("week <= 52 and cause = 'AF'").join(F.broadcast(full), "year").groupBy("facility", "year").agg(F.sum("total").alias("total"))
    s = t.supplier.select(F.col("s_suppkey").alias("facility")).join(by_year, "facility", "left").groupBy("facility").agg(F.count("year").alias("years"), F.coalesce(F.sum("total"), F.lit(0)).alias("total"), F.min("total").alias("least"))
    s = s.crossJoin(F.broadcast(full.agg(F.count("*").alias("all_years"))))
    return s.select("facility", cleaning.first_label([(F.col("years") < F.col("all_years"), "missing years"), (F.col("total") / (52 * F.col("all_years")) < 9.5, "low mean"), (F.col("least") / 52 < 6.5, "low year")], "kept").alias("reason"))


@section(f"""WITH {WEEKLY}, w AS (SELECT year, week FROM weekly WHERE year = (SELECT max(year) FROM weekly) AND week <= 52 GROUP BY ALL HAVING count(DISTINCT day) = 7), n AS (SELECT count(*) AS n FROM w), f AS (SELECT facility, count(DISTINCT week) AS weeks, sum(total) AS total FROM weekly JOIN w USING (year, week) GROUP BY 1)
    SELECT facility, weeks, weeks >= n - 2 AS kept, sum(CASE WHEN weeks < n - 2 THEN total ELSE 0 END) OVER () / sum(total) OVER () AS lost_share FROM f, n""")
def l4_fixed_universe(t: Tables) -> DataFrame:
    """Units of the partial year without more than two silent whole weeks, and the share of volume that is lost."""
    newest = t.lineitem.agg(F.year(F.to_date(F.max("l_shipdate"))).alias("year"))
    w = weekly_visits(t).join(F.broadcast(newest), "year").where("week <= 52")
    whole = w.groupBy("year", "week").agg(F.count_distinct("day").alias("days")).where("days = 7").drop("days")
    rows = w.join(whole, ["year", "week"])
    n = whole.agg(F.count("*").alias("n"))
    f = t.kept("fixed-units", lambda: rows.groupBy("facility").agg(F.count_distinct("week").alias("weeks"), F.sum("total").alias("total")).crossJoin(F.broadcast(n)).withColumn("kept", F.col("weeks") >= F.col("n") - 2))
    # one row
    lost = f.agg((F.sum(F.when(~F.col("kept"), F.col("total")).otherwise(0)) / F.sum("total")).alias("lost_share"))
    return f.crossJoin(F.broadcast(lost)).select("facility", "weeks", "kept", "lost_share")


@section(f"WITH {BACK} SELECT origin, horizon, series_id, {VALUE_COLS} FROM back WHERE model = 'naive'")
def l5_naive(t: Tables) -> DataFrame:
    return show(models.backtest(panel(t), ["naive"], HORIZONS))


@section(f"WITH {BACK} SELECT origin, horizon, series_id, {VALUE_COLS} FROM back WHERE model = 'drift'")
def l6_drift(t: Tables) -> DataFrame:
    return show(models.backtest(panel(t), ["drift"], HORIZONS))


@section()
def l7_poisson_glm(t: Tables) -> DataFrame:
    """Fitted anew at all 13 origins, for every horizon and series, with intervals of its own dispersion."""
    return rounded(models.backtest(with_reporters(t), ["poisson"], HORIZONS), "y_pred", digits=3).select("origin", "horizon", "series_id", "y_real", "y_pred", "lo", "hi")


@section(f"""WITH {BACK}, x AS (SELECT series_id, (y_real - y_pred) ** 2 / y_pred AS x FROM back WHERE model = 'naive' AND y_pred > 0) SELECT series_id, round(greatest(CASE WHEN count(*) >= 10 THEN avg(x) ELSE (SELECT avg(x) FROM x) END, 1), 6) AS phi FROM x GROUP BY 1""")
def l8_dispersion(t: Tables) -> DataFrame:
    return rounded(intervals.dispersion(models.backtest(panel(t), ["naive"], HORIZONS)), "phi")


_TERMS = ["lag_0", "lag_1", "lag_2", "lag_3", "season", "year_change", "mean_4", "sd_4", "mean_13", "sd_13", "reporters_0", "reporters_1"]


def _score_sql(origins: str) -> str:
    """Sums of features times targets, and of targets by series, over the training rows of each regression."""
    waves = {f"{n}_{k}": f"{n}({k} * 2 * pi() * week / 52)" for k in (1, 2) for n in ("sin", "cos")}
    return f"""WITH {PANEL}, {_REPORTERS}, x AS ({' UNION ALL '.join(map(_supervised, range(1, 9)))}), {origins},
    used AS (SELECT series_id, horizon, t, y, {', '.join(f'{c}::DOUBLE AS {c}' for c in _TERMS)}, {', '.join(f'{v} AS {n}' for n, v in waves.items())} FROM x JOIN periods USING (t) WHERE {' AND '.join(f'{c} IS NOT NULL' for c in _TERMS)}),
    long AS (UNPIVOT used ON {', '.join([*_TERMS, *waves])} INTO NAME term VALUE v), by_t AS (SELECT horizon, t, term, sum(v * y) AS s FROM long GROUP BY ALL UNION ALL SELECT horizon, t, series_id, sum(y)::DOUBLE FROM used GROUP BY ALL)
    SELECT origin, horizon, term, round(sum(s), 1) AS fitted FROM by_t, origins WHERE t <= origin GROUP BY ALL"""


def _scores(t: Tables, origins: list[int]) -> DataFrame:
    return rounded(models.poisson_scores(with_reporters(t), origins, HORIZONS).where("term <> 'early'"), "fitted", digits=1)


@section(_score_sql("origins AS (SELECT CAST(m - 8 - 4 * i AS INTEGER) AS origin FROM (SELECT max(t) AS m FROM panel), generate_series(0, 12) g(i))"))
def l7_score_equations(t: Tables) -> DataFrame:
    """What the fitted regressions of the 13 origins say of each feature's and series' sum; the data's own sums, if the fits are right."""
    return _scores(t, [r.origin for r in models.origins(panel(t), 8, 13, 4).select("origin").collect()])


_MU = "mu AS (SELECT c_nationkey AS area, count(*) / 84.0::DOUBLE AS m, CASE WHEN c_nationkey % 2 = 0 THEN 1.0::DOUBLE ELSE 1.5::DOUBLE END AS f FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1)"


@section(f"""WITH {_MU}, e AS (SELECT area, m, f, unnest(generate_series(0, CAST(ceil(m + 12 * sqrt(f * m) + 30) AS BIGINT))) AS k FROM mu),
    l AS (SELECT area, k, sum(CASE WHEN k = 0 THEN CASE WHEN f > 1 THEN m * ln(1 / f) / (f - 1) ELSE -m END WHEN f > 1 THEN ln((m / (f - 1) + k - 1) / k * (1 - 1 / f)) ELSE ln(m / k) END) OVER (PARTITION BY area ORDER BY k) AS lp FROM e),
    c AS (SELECT area, k, sum(exp(lp)) OVER (PARTITION BY area ORDER BY k) AS cdf FROM l), b AS (SELECT area, CAST(min(k) FILTER (cdf >= 0.1) AS INTEGER) AS lo, CAST(min(k) FILTER (cdf >= 0.9) AS INTEGER) AS hi FROM c GROUP BY 1)
    SELECT area, lo, hi, round((SELECT cdf FROM c WHERE c.area = b.area AND k = hi) - coalesce((SELECT cdf FROM c WHERE c.area = b.area AND k = lo - 1), 0), 6) AS covered FROM b""")
def l9_count_quantiles(t: Tables) -> DataFrame:
    mu = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).groupBy(F.col("c_nationkey").alias("area")).agg((F.count("*") / 84.0).alias("mu"))
    mu = mu.withColumn("phi", F.when(F.col("area") % 2 == 0, 1.0).otherwise(1.5))
    return rounded(intervals.count_quantiles(mu, "area", "mu", "phi", 0.8), "covered").withColumns({c: F.col(c).cast("int") for c in ("lo", "hi")})


@section()
def l10_boosted_trees(t: Tables) -> DataFrame:
    """Grown at all 13 origins, for every horizon and series, with quantiles of their relative errors."""
    back = models.backtest(with_reporters(t), ["trees"], HORIZONS)
    return rounded(back, "y_pred", "lo", "hi", digits=3).select("origin", "horizon", "series_id", "y_real", "y_pred", "lo", "hi")


_RELATIVE = ["lag_0", "lag_1", "lag_2", "lag_3", "season", "year_change", "mean_4", "sd_4", "sd_13"]
_ROOT = f"""{PANEL}, {_REPORTERS}, x AS ({' UNION ALL '.join(map(_supervised, range(1, 9)))}), origins AS (SELECT CAST(m - 8 - 4 * i AS INTEGER) AS origin FROM (SELECT max(t) AS m FROM panel), generate_series(0, 12) g(i)),
    full_ AS (SELECT * FROM x WHERE {' AND '.join(f'{c} IS NOT NULL' for c in [*_RELATIVE, 'mean_13', 'reporters_0', 'reporters_1'])}),
    rel AS (SELECT series_id, t, y, mean_13 + 0.5::DOUBLE AS mu, {', '.join(f'{c} / (mean_13 + 0.5::DOUBLE) AS {c}' for c in _RELATIVE)}, mean_13, reporters_0::DOUBLE AS reporters_0, reporters_1::DOUBLE AS reporters_1, horizon::DOUBLE AS horizon FROM full_),
    long AS (UNPIVOT rel ON {', '.join([*_RELATIVE, 'mean_13', 'reporters_0', 'reporters_1', 'horizon'])} INTO NAME feature VALUE v),
    edges AS (SELECT feature, list_sort(list_distinct(quantile_disc(v, [{', '.join(f'{k / 32}' for k in range(1, 32))}]))) AS e FROM long WHERE t <= (SELECT min(origin) - 26 FROM origins) GROUP BY 1),
    by_bin AS (SELECT feature, t, len(list_filter(e, lambda z: z < v)) AS place, sum(mu - y) AS g, sum(mu) AS h, count(*) AS n FROM long JOIN edges USING (feature) GROUP BY ALL),
    by_series AS (SELECT origin, series_id, sum(mu - y) AS g, sum(mu) AS h, count(*) AS n FROM rel, origins WHERE t <= origin GROUP BY ALL),
    cells AS (SELECT origin, feature, place, sum(g) AS g, sum(h) AS h, sum(n) AS n FROM by_bin, origins WHERE t <= origin GROUP BY ALL
        UNION ALL SELECT origin, 'series', row_number() OVER (PARTITION BY origin ORDER BY g / (h + 1), series_id), g, h, n FROM by_series),
    run AS (SELECT origin, feature, place, sum(g) OVER w AS gl, sum(h) OVER w AS hl, sum(n) OVER w AS nl, sum(g) OVER (PARTITION BY origin, feature) AS g, sum(h) OVER (PARTITION BY origin, feature) AS h, sum(n) OVER (PARTITION BY origin, feature) AS n FROM cells WINDOW w AS (PARTITION BY origin, feature ORDER BY place)),
    best AS (SELECT origin, arg_max(struct_pack(feature, place, gl, hl, g, h), gl ** 2 / (hl + 1) + (g - gl) ** 2 / (h - hl + 1) - g ** 2 / (h + 1)) AS b FROM run WHERE nl >= 20 AND n - nl >= 20 GROUP BY 1)
    SELECT origin, b.feature AS feature, round(CASE WHEN b.feature = 'series' THEN b.place ELSE (SELECT e[CAST(b.place AS INTEGER) + 1] FROM edges x WHERE x.feature = b.feature) END, 6) AS cut, round(-b.gl / (b.hl + 1), 6) AS left_value, round(-(b.g - b.gl) / (b.h - b.hl + 1), 6) AS right_value FROM best"""


@section(f"WITH {_ROOT}")
def l10_first_split(t: Tables) -> DataFrame:
    """The first cut of the trees of each origin: the best of all features and bins, with the score equations' solution on its sides."""
    p = with_reporters(t)
    splits = models.first_splits(p, models.origins(p, 8, 13, 4), HORIZONS)
    return splits.select("origin", "feature", F.round("cut", 6).alias("cut"), F.round("left", 6).alias("left_value"), F.round("right", 6).alias("right_value"))


@section(f"WITH {HYBRID} SELECT origin, horizon, series_id, {VALUE_COLS} FROM hybrid")
def l11_level_hybrid(t: Tables) -> DataFrame:
    return show(hybrid(t))


_CALIBRATION = f"""{BACK}, cal AS (SELECT o.origin, r.level, r.r / sqrt(greatest(b.y, 1)) AS score FROM res r JOIN panel b ON b.series_id = r.series_id AND b.t = r.t - 52, origins o WHERE r.t > o.origin - 26 AND r.t <= o.origin),
    k AS (SELECT origin, level, score, row_number() OVER (PARTITION BY origin, level ORDER BY score) AS k, count(*) OVER (PARTITION BY origin, level) AS n FROM cal),
    bounds AS (SELECT origin, level, max(score) FILTER (k = greatest(floor(round((n + 1) * 0.1, 9)), 1)) AS low, max(score) FILTER (k = least(ceil(round((n + 1) * 0.9, 9)), n)) AS high FROM k GROUP BY ALL),
    conf AS (SELECT b.model, origin, horizon, series_id, b.level, service, t, y_real, y_pred, greatest(y_pred + low * sqrt(greatest(y_pred, 1)), 0) AS lo, high FROM back b JOIN bounds USING (origin, level) WHERE model = 'naive'),
    conformal AS (SELECT model, origin, horizon, series_id, level, service, t, y_real, y_pred, lo, greatest(y_pred + high * sqrt(greatest(y_pred, 1)), lo) AS hi FROM conf)"""


def conformal(t: Tables) -> DataFrame:
    """The naive forecasts of every origin with bounds from the 26 periods before it, by level."""
    p = panel(t)
    season = p.select("series_id", (F.col("t") + 52).alias("t"), F.col("y").cast("double").alias("y_pred"))
    errors = p.join(season.hint("merge"), ["series_id", "t"]).withColumnRenamed("y", "y_real")
    return intervals.conformal(backtest(t).where("model = 'naive'"), intervals.recent(errors, models.origins(p, 8, 13, 4)))


@section(f"WITH {_CALIBRATION} SELECT origin, horizon, series_id, {VALUE_COLS} FROM conformal")
def l12_conformal(t: Tables) -> DataFrame:
    return show(conformal(t))


_SUMS = "lsums AS (SELECT origin, horizon, service, sum(y_pred) AS p, sum(lo) AS l, sum(hi) AS h FROM {leaves} WHERE level = 'leaf' GROUP BY ALL), tot AS (SELECT origin, horizon, sum(p) AS p, sum(l) AS l, sum(h) AS h FROM lsums GROUP BY ALL)"


def _resum(source: str, keep_total: bool = False) -> str:
    total = f"SELECT origin, horizon, series_id, y_pred, lo, hi FROM hybrid WHERE level = 'total'" if keep_total else "SELECT x.origin, x.horizon, series_id, p, l, h FROM hybrid x JOIN tot ON tot.origin = x.origin AND tot.horizon = x.horizon WHERE level = 'total'"  # noqa: F541
    return f"{_SUMS.format(leaves=source)}, out_ AS (SELECT origin, horizon, series_id, y_pred, lo, hi FROM {source} WHERE level = 'leaf' UNION ALL SELECT x.origin, x.horizon, series_id, p, l, h FROM hybrid x JOIN lsums ON lsums.origin = x.origin AND lsums.horizon = x.horizon AND lsums.service = x.service WHERE level = 'service' UNION ALL {total}) SELECT origin, horizon, series_id, {VALUE_COLS} FROM out_"


@section(f"WITH {HYBRID}, {_resum('hybrid')}")
def l13_bottom_up(t: Tables) -> DataFrame:
    return show(reconcile.bottom_up(hybrid(t), KEYS))


_TOP = "f AS (SELECT origin, horizon, max(y_pred) FILTER (level = 'total') / nullif(sum(y_pred) FILTER (level = 'leaf'), 0) AS f FROM hybrid GROUP BY ALL), scaled AS (SELECT x.origin, x.horizon, series_id, level, service, y_pred * coalesce(f, 1) AS y_pred, lo * coalesce(f, 1) AS lo, hi * coalesce(f, 1) AS hi FROM hybrid x JOIN f USING (origin, horizon) WHERE level = 'leaf')"


@section(f"WITH {HYBRID}, {_TOP}, {_resum('scaled', keep_total=True)}")
def l14_top_down(t: Tables) -> DataFrame:
    return show(reconcile.top_down(hybrid(t), KEYS))


_MIDDLE = """m AS (SELECT origin, horizon, series_id, level, service, y_pred * CASE WHEN level = 'service' THEN 1.1::DOUBLE ELSE 1 END AS y_pred, lo, hi FROM hybrid), f AS (SELECT origin, horizon, service, max(y_pred) FILTER (level = 'service') / nullif(sum(y_pred) FILTER (level = 'leaf'), 0) AS f FROM m WHERE level <> 'total' GROUP BY ALL),
    out_ AS (SELECT m.origin, m.horizon, series_id, y_pred * coalesce(f, 1) AS y_pred, lo * coalesce(f, 1) AS lo, hi * coalesce(f, 1) AS hi FROM m JOIN f USING (origin, horizon, service) WHERE level = 'leaf' UNION ALL SELECT origin, horizon, series_id, y_pred, lo, hi FROM m WHERE level = 'service'
    UNION ALL SELECT origin, horizon, 'TOTAL', sum(y_pred), sum(lo), sum(hi) FROM m WHERE level = 'service' GROUP BY ALL)"""


@section(f"WITH {HYBRID}, {_MIDDLE} SELECT origin, horizon, series_id, {VALUE_COLS} FROM out_")
def l15_middle_out(t: Tables) -> DataFrame:
    """Services are raised by a tenth first, so that they differ from the sums of their leaves."""
    rows = hybrid(t).withColumn("y_pred", F.when(F.col("level") == "service", F.col("y_pred") * 1.1).otherwise(F.col("y_pred")))
    return show(reconcile.middle_out(rows, KEYS))


_WLS = """a AS (SELECT *, sum(y_pred) FILTER (level = 'leaf') OVER s AS ls, max(y_pred) FILTER (level = 'service') OVER s AS vs, count(*) FILTER (level = 'leaf') OVER s AS ns, sum(y_pred) FILTER (level = 'leaf') OVER w AS l_, sum(y_pred) FILTER (level = 'service') OVER w AS v_, max(y_pred) FILTER (level = 'total') OVER w AS r_, count(*) FILTER (level = 'leaf') OVER w AS m_
    FROM hybrid WINDOW w AS (PARTITION BY origin, horizon), s AS (PARTITION BY origin, horizon, service)),
    leaf AS (SELECT origin, horizon, series_id, service, greatest(y_pred + (vs - ls) / (2 * ns) + (2 * r_ - l_ - v_) / (6 * m_), 0) AS new FROM a WHERE level = 'leaf'),
    every AS (SELECT origin, horizon, series_id, new FROM leaf UNION ALL SELECT origin, horizon, 'S' || CAST(service AS VARCHAR), sum(new) FROM leaf GROUP BY origin, horizon, service UNION ALL SELECT origin, horizon, 'TOTAL', sum(new) FROM leaf GROUP BY origin, horizon)
    SELECT x.origin, x.horizon, series_id, round(new, 6) AS y_pred, round(greatest(lo + new - y_pred, 0), 6) AS lo, round(greatest(hi + new - y_pred, greatest(lo + new - y_pred, 0)), 6) AS hi FROM hybrid x JOIN every USING (origin, horizon, series_id)"""


@section(f"WITH {HYBRID}, {_WLS}")
def l16_structural(t: Tables) -> DataFrame:
    return show(reconcile.structural(hybrid(t), KEYS))


@section(f"WITH {HYBRID} SELECT horizon, avg(abs(r - l)) AS gap, round(avg(100 * abs(r - l) / r), 6) AS gap_percent FROM (SELECT origin, horizon, max(y_pred) FILTER (level = 'total') AS r, sum(y_pred) FILTER (level = 'leaf') AS l FROM hybrid GROUP BY ALL) GROUP BY 1".replace("avg(abs(r - l)) AS gap", "round(avg(abs(r - l)), 6) AS gap"))
def l17_coherence_gap(t: Tables) -> DataFrame:
    gap = reconcile.coherence_gap(hybrid(t), KEYS)
    return gap.groupBy("horizon").agg(F.round(F.avg(F.abs("gap")), 6).alias("gap"), F.round(F.avg("gap_percent"), 6).alias("gap_percent"))


@section(f"WITH {BACK} SELECT model, origin, horizon, series_id, t, y_real, round(y_pred, 6) AS y_pred FROM back")
def l18_rolling_origin(t: Tables) -> DataFrame:
    return rounded(backtest(t), "y_pred").select("model", "origin", "horizon", "series_id", "t", "y_real", "y_pred")


@section()
def l18_model_comparison(t: Tables) -> DataFrame:
    """MASE and coverage of 80 % intervals of naive and fitted models by level, over the same 13 origins and 8 horizons."""
    back = backtest(t).unionByName(fitted_backtest(t))
    s = evaluate.by_series(back, scales(t), 0.8, ["model"])
    return s.groupBy("model", "level").agg(F.sum("n").alias("n"), F.round(F.avg("mase"), 4).alias("mase"), F.round(F.avg("rmsse"), 4).alias("rmsse"), F.round(F.sum(F.col("covered") * F.col("n")) / F.sum("n"), 4).alias("coverage"))


@section(f"""WITH {PANEL}, m AS (SELECT max(t) AS m FROM panel), res AS (SELECT a.series_id, a.t, a.y - b.y AS r FROM panel a JOIN panel b ON b.series_id = a.series_id AND b.t = a.t - 52), q AS (SELECT series_id, quantile_cont(r, 0.1) AS low, quantile_cont(r, 0.9) AS high FROM res GROUP BY 1)
    SELECT series_id, CAST(t + 52 AS INTEGER) AS t, CAST(t + 52 - m AS INTEGER) AS horizon, y::DOUBLE AS y_pred, round(greatest(y + low, 0), 6) AS lo, round(greatest(y + high, greatest(y + low, 0)), 6) AS hi FROM panel JOIN q USING (series_id), m WHERE t + 52 > m AND t + 52 <= m + 8""")
def l19_forecast(t: Tables) -> DataFrame:
    return rounded(models.forecast(panel(t), "naive", 8), "lo", "hi").select("series_id", "t", "horizon", "y_pred", "lo", "hi")


@section()
def l19_forecast_fitted(t: Tables) -> DataFrame:
    """What the Poisson regressions say of the periods after the panel's end."""
    return rounded(models.forecast(with_reporters(t), "poisson", 8), "y_pred", digits=3).select("series_id", "t", "horizon", "y_pred", "lo", "hi")


@section(_score_sql("origins AS (SELECT CAST(max(t) AS INTEGER) AS origin FROM panel)"))
def l19_score_equations(t: Tables) -> DataFrame:
    """As ``l7_score_equations``, for the regressions that say what comes after the panel's end."""
    return _scores(t, [panel(t).agg(F.max("t")).first()[0]])


def _people(t: Tables) -> DataFrame:
    return t.customer.groupBy(F.concat(F.lit("A"), F.lpad(F.col("c_nationkey").cast("string"), 2, "0")).alias("series_id")).agg(F.count("*").alias("people"))


@section()
def l20_seasonal_poisson(t: Tables) -> DataFrame:
    """The total by harmonics, areas by shrunken shares of it, and quantiles of both, eight weeks ahead."""
    rows = panel(t).where("level <> 'service'").join(calendar_table(t).select("year", "week", "days"), ["year", "week"])
    origin = rows.agg(F.max("t")).first()[0] - 8
    return rounded(models.sparse_hierarchy(rows, _people(t), origin, HORIZONS), "y_pred", "share", "covered", digits=3)


@section(f"""WITH {PANEL}, o AS (SELECT max(t) - 8 AS origin FROM panel), x AS (SELECT 0.5::DOUBLE ^ ((origin - t) / 104.0::DOUBLE) * y AS wy, 1.0::DOUBLE AS one, {', '.join(f'{n}({k} * 2 * pi() * week / 52) AS {n}_{k}' for k in (1, 2) for n in ('sin', 'cos'))} FROM panel, o WHERE level = 'total' AND t <= origin),
    long AS (UNPIVOT x ON one, sin_1, cos_1, sin_2, cos_2 INTO NAME term VALUE v) SELECT term, round(sum(v * wy), 2) AS fitted FROM long GROUP BY 1""")
def l20_score_equations(t: Tables) -> DataFrame:
    """Weighted sums of each term times the fitted total; the data's own sums, if the fit is right."""
    total = panel(t).where("level = 'total'").join(calendar_table(t).select("year", "week", "days"), ["year", "week"])
    origin = total.agg(F.max("t")).first()[0] - 8
    return rounded(models.seasonal_scores(total, origin), "fitted", digits=2)


_SHAPE = """c AS (SELECT c_nationkey AS k, count(*) FILTER (o_orderpriority = '1-URGENT') AS n, count(*) AS all_ FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1), e AS (SELECT k, n::DOUBLE AS n, sum(n) OVER () * all_::DOUBLE / sum(all_) OVER () AS e FROM c)"""
_LIK = "sum(lgamma(n + exp(x)) - lgamma(exp(x)) + exp(x) * ln(exp(x) / (exp(x) + e)) + n * ln(e / (exp(x) + e)))"


def _grid(k: int, low: str, high: str) -> str:
    return f"g{k} AS (SELECT x, {_LIK} AS l FROM e, (SELECT {low} + i * (({high}) - ({low})) / 60.0::DOUBLE AS x FROM generate_series(0, 60) s(i)) GROUP BY x), b{k} AS (SELECT arg_max(x, (l, -x)) AS x FROM g{k})"


@section(f"WITH {_SHAPE}, {_grid(1, '-3.0::DOUBLE', '12.0::DOUBLE')}, {_grid(2, '(SELECT greatest(x - 0.25, -3) FROM b1)', '(SELECT least(x + 0.25, 12) FROM b1)')}, {_grid(3, '(SELECT greatest(x - 1 / 120.0::DOUBLE, -3) FROM b2)', '(SELECT least(x + 1 / 120.0::DOUBLE, 12) FROM b2)')} SELECT round(x, 4) AS log_shape, round(l, 4) AS log_likelihood FROM g3 WHERE x = (SELECT x FROM b3)")
def l21_gamma_shape(t: Tables) -> DataFrame:
    n = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).groupBy("c_nationkey").agg(F.count_if(F.col("o_orderpriority") == "1-URGENT").alias("n"), F.count("*").alias("all"))
    every = W.partitionBy()
    counts = n.withColumn("expected", F.sum("n").over(every) * F.col("all") / F.sum("all").over(every))
    return rounded(models.gamma_shape(counts), "log_shape", "log_likelihood", digits=4)


@section(f"WITH {BACK} SELECT series_id, count(*) AS n, round(avg(abs(y_real)), 6) AS mae FROM back WHERE model = 'naive' GROUP BY 1")
def l22_zero(t: Tables) -> DataFrame:
    return models.backtest(panel(t), ["zero"], HORIZONS).groupBy("series_id").agg(F.count("*").alias("n"), F.round(F.avg(F.abs(F.col("y_real") - F.col("y_pred"))), 6).alias("mae"))


@section(f"WITH {PANEL}, m AS (SELECT max(t) AS m FROM panel), a AS (SELECT series_id, avg(y) AS y_pred FROM panel, m WHERE t <= m - 8 GROUP BY 1) SELECT series_id, t, round(y_pred, 6) AS y_pred FROM panel JOIN a USING (series_id), m WHERE t > m - 8")
def l23_user_model(t: Tables) -> DataFrame:
    """A model of the user by pandas, one series at a time: the mean of the training rows."""

    def mean(rows):
        known = rows["y"].dropna()
        return rows[rows["y"].isna()][["series_id", "t"]].assign(y_pred=float(known.mean()))

    p = panel(t)
    cut = p.agg(F.max("t")).first()[0] - 8
    est = models.ByPandas(mean, "series_id string, t int, y_pred double")
    return rounded(est.fit_predict(p.where(F.col("t") <= cut), p.where(F.col("t") > cut)), "y_pred")


@section(f"WITH {PANEL}, m AS (SELECT CAST(max(t) AS INTEGER) AS m, count(DISTINCT series_id) AS n FROM panel), h AS (SELECT {PRINT} AS h FROM lineitem) SELECT 'naive' AS model, 4 * n AS rows, 4 AS horizon, m AS origin, (SELECT 'lineitem=' || CAST(bit_xor(h) AS VARCHAR) FROM h) AS inputs FROM m")
def l24_manifest(t: Tables) -> DataFrame:
    """What was forecast, from which inputs."""
    made = models.forecast(panel(t), "naive", 4).agg(F.count("*").alias("rows"), F.max("horizon").alias("horizon"), F.max("origin").alias("origin"))
    prints = readers.fingerprint(t.lineitem).select(F.concat(F.lit("lineitem="), F.col("xor_hash").cast("string")).alias("inputs"))
    return made.crossJoin(F.broadcast(prints)).select(F.lit("naive").alias("model"), "rows", "horizon", "origin", "inputs")


@section(f"WITH {BACK} SELECT origin, horizon, series_id, round(a.y_pred, 6) AS a, round(b.y_pred, 6) AS b FROM back a JOIN back b USING (origin, horizon, series_id) WHERE a.model = 'naive' AND b.model = 'drift'")
def c14_paired_predictions(t: Tables) -> DataFrame:
    rows = backtest(t)
    pick = lambda m, n: rows.where(F.col("model") == m).select("origin", "horizon", "series_id", F.round("y_pred", 6).alias(n))
    return pick("naive", "a").join(pick("drift", "b"), ["origin", "horizon", "series_id"])


@section(f"WITH {BACK}, c AS (SELECT model, level, horizon, count(*) AS n, avg(CASE WHEN y_real BETWEEN lo AND hi THEN 1.0::DOUBLE ELSE 0 END) AS c FROM back GROUP BY ALL) SELECT model, level, round(sum(c * n) / sum(n), 9) AS coverage FROM c GROUP BY ALL")
def d29_weighted_coverage(t: Tables) -> DataFrame:
    c = backtest(t).groupBy("model", "level", "horizon").agg(*evaluate.coverage_and_width(0.8))
    return c.groupBy("model", "level").agg(F.round(F.sum(F.col("coverage") * F.col("n")) / F.sum("n"), 9).alias("coverage"))


@section(f"WITH {BACK} SELECT model, level, round(avg(abs(y_real - y_pred)), 6) AS mae, round(sqrt(avg((y_real - y_pred) ** 2)), 6) AS rmse, round(100 * avg(abs((y_real - y_pred) / nullif(y_real, 0))), 6) AS mape FROM back GROUP BY ALL")
def n1_point_errors(t: Tables) -> DataFrame:
    return rounded(backtest(t).groupBy("model", "level").agg(*evaluate.point_errors()), "mae", "rmse", "mape")


@section(f"WITH {BACK}, {SCALES} SELECT series_id, round(mase_scale, 6) AS mase_scale, round(rmsse_scale, 6) AS rmsse_scale FROM scales")
def n2_scales(t: Tables) -> DataFrame:
    return rounded(scales(t), "mase_scale", "rmsse_scale")


BY_SERIES = f"""{BACK}, {SCALES}, by_series AS (SELECT model, series_id, level, count(*) AS n, avg(abs(y_real - y_pred)) / any_value(mase_scale) AS mase, sqrt(avg((y_real - y_pred) ** 2) / any_value(rmsse_scale)) AS rmsse, avg(CASE WHEN y_real BETWEEN lo AND hi THEN 1.0::DOUBLE ELSE 0 END) AS covered, avg(hi - lo) AS width,
    avg(hi - lo + 10 * greatest(lo - y_real, 0) + 10 * greatest(y_real - hi, 0)) AS score FROM back JOIN scales USING (series_id) GROUP BY ALL)"""


def by_level(s: DataFrame) -> DataFrame:
    """(model, error_total, error_leaf, calibrated_total, calibrated_leaf) for the selection rule."""
    of = lambda level, c: F.when(F.col("level") == level, c)
    near = lambda level: F.abs(F.sum(of(level, F.col("covered") * F.col("n"))) / F.sum(of(level, F.col("n"))) - 0.8) <= 0.1
    return s.groupBy("model").agg(*(F.avg(of(k, F.col("rmsse"))).alias(f"error_{k}") for k in ("total", "leaf")), *(near(k).alias(f"calibrated_{k}") for k in ("total", "leaf")))


def by_series(t: Tables) -> DataFrame:
    return evaluate.by_series(backtest(t), scales(t), 0.8, ["model"])


@section(f"WITH {BY_SERIES} SELECT model, series_id, n, round(mase, 6) AS mase, round(rmsse, 6) AS rmsse, round(covered, 6) AS covered, round(width, 4) AS width, round(score, 4) AS score FROM by_series")
def n3_evaluation_table(t: Tables) -> DataFrame:
    return rounded(rounded(by_series(t), "mase", "rmsse", "covered"), "width", "score", digits=4).drop("level")


@section(f"WITH {BACK} SELECT model, level, horizon, count(*) AS n, round(avg(CASE WHEN y_real BETWEEN lo AND hi THEN 1.0::DOUBLE ELSE 0 END), 6) AS coverage, round(avg(hi - lo), 4) AS width, round(1.96::DOUBLE * sqrt(0.8::DOUBLE * 0.2 / count(*)), 6) AS tolerance FROM back GROUP BY ALL")
def n4_coverage(t: Tables) -> DataFrame:
    return rounded(rounded(backtest(t).groupBy("model", "level", "horizon").agg(*evaluate.coverage_and_width(0.8)), "coverage", "tolerance"), "width", digits=4)


@section(f"WITH {BACK} SELECT model, level, round(avg(hi - lo + 10 * greatest(lo - y_real, 0) + 10 * greatest(y_real - hi, 0)), 4) AS score FROM back GROUP BY ALL")
def n5_interval_score(t: Tables) -> DataFrame:
    return backtest(t).groupBy("model", "level").agg(F.round(F.avg(evaluate.interval_score(0.8)), 4).alias("score"))


@section(f"WITH {BACK}, {SCALES}, s AS (SELECT model, level, horizon, series_id, avg(abs(y_real - y_pred)) / any_value(mase_scale) AS mase FROM back JOIN scales USING (series_id) GROUP BY ALL) SELECT model, level, horizon, round(quantile_cont(mase, 0.5), 6) AS mase FROM s GROUP BY ALL")
def n6_level_summary(t: Tables) -> DataFrame:
    s = evaluate.by_series(backtest(t), scales(t), 0.8, ["model", "horizon"])
    return selection.quantiles(s, ["model", "level", "horizon"], "mase", [0.5]).select("model", "level", "horizon", F.round(F.col("quantiles")[0], 6).alias("mase"))


PAIRS = f"{BACK}, {SCALES}, pairs AS (SELECT a.origin, a.horizon, a.series_id, a.level, abs(a.y_real - a.y_pred) / mase_scale AS a, abs(b.y_real - b.y_pred) / mase_scale AS b, abs(b.y_real - b.y_pred) / mase_scale - abs(a.y_real - a.y_pred) / mase_scale AS d FROM back a JOIN back b USING (origin, horizon, series_id) JOIN scales USING (series_id) WHERE a.model = 'naive' AND b.model = 'drift')"


def pairs(t: Tables, squared: bool = False) -> DataFrame:
    rows = backtest(t)
    return evaluate.paired(rows.where("model = 'naive'"), rows.where("model = 'drift'"), scales(t), squared)


_TAIL = "(0.5 * (1 / (1 + 0.3275911 * x)) * (0.254829592 + (1 / (1 + 0.3275911 * x)) * (-0.284496736 + (1 / (1 + 0.3275911 * x)) * (1.421413741 + (1 / (1 + 0.3275911 * x)) * (-1.453152027 + (1 / (1 + 0.3275911 * x)) * 1.061405429)))) * exp(-x * x))"
#: Numbers of sets of the ranks 1 to n by their sum, rank by rank.
_EXACT = """least(2 * list_sum(list_slice(list_reduce([list_transform(range(1, 1277), lambda j: CASE WHEN j = 1 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)] || list_transform(range(1, CAST(n AS BIGINT) + 1), lambda i: [i::DOUBLE]),
    lambda c, r: list_transform(range(1, 1277), lambda j: c[j] + CASE WHEN j > r[1] THEN c[j - CAST(r[1] AS BIGINT)] ELSE 0 END)), 1, CAST(floor(w) AS BIGINT) + 1)) / pow(2::DOUBLE, n), 1)"""
def _signed_rank(source: str, by: str) -> str:
    return f"""d AS (SELECT {by}, round(d, 9) AS d FROM {source} WHERE round(d, 9) <> 0), r AS (SELECT {by}, d, rank() OVER (PARTITION BY {by} ORDER BY abs(d)) + (count(*) OVER (PARTITION BY {by}, abs(d)) - 1) / 2.0::DOUBLE AS rank, count(*) OVER (PARTITION BY {by}, abs(d)) AS ties FROM d),
    s AS (SELECT {by}, count(*)::DOUBLE AS n, least(sum(rank) FILTER (d > 0), sum(rank) FILTER (d < 0)) AS w, sum(ties * ties - 1)::DOUBLE AS tied FROM r GROUP BY ALL), z AS (SELECT *, (w - n * (n + 1) / 4) / sqrt(n * (n + 1) * (2 * n + 1) / 24 - tied / 48) AS z FROM s), x AS (SELECT *, abs(z) / sqrt(2::DOUBLE) AS x FROM z), wilcoxon AS (SELECT {by}, CAST(n AS BIGINT) AS n, w, z, CASE WHEN n <= 50 AND tied = 0 THEN {_EXACT} ELSE least(2 * {_TAIL}, 1) END AS p FROM x)"""


WILCOXON = f"{PAIRS}, {_signed_rank('pairs', 'level, horizon')}"


@section(f"WITH {WILCOXON}, e AS (SELECT level, horizon, avg(a) AS a, avg(b) AS b, avg(CASE WHEN b < a THEN 1.0::DOUBLE ELSE 0 END) AS wins FROM pairs GROUP BY ALL) SELECT level, horizon, n, w, round(z, 6) AS z, round(p, 6) AS p, round(100 * (b / a - 1), 6) AS change, round(wins, 6) AS wins FROM wilcoxon JOIN e USING (level, horizon)")
def n7_wilcoxon(t: Tables) -> DataFrame:
    both = t.kept("pairs", lambda: pairs(t))
    tests, means = evaluate.wilcoxon(both, ["level", "horizon"]), evaluate.paired_summary(both, ["level", "horizon"])
    return rounded(tests.join(means, ["level", "horizon"]), "z", "p", "change", "wins").select("level", "horizon", "n", "w", "z", "p", "change", "wins")


@section(f"""WITH {PAIRS}, d AS (SELECT level, origin, avg(d) AS d FROM pairs GROUP BY ALL), c AS (SELECT *, d - avg(d) OVER (PARTITION BY level) AS c FROM d), g AS (SELECT *, lag(c) OVER (PARTITION BY level ORDER BY origin) AS c1 FROM c), s AS (SELECT level, count(*)::DOUBLE AS n, avg(d) AS mean, sum(c * c) AS g0, sum(c * c1) AS g1 FROM g GROUP BY 1)
    SELECT level, CAST(n AS BIGINT) AS n, round(mean / sqrt((g0 / n + 2 * 0.5::DOUBLE * g1 / n) / n) * sqrt((n + 1 - 4 + 2 / n) / n), 6) AS statistic FROM s""")
def n8_diebold_mariano(t: Tables) -> DataFrame:
    return rounded(evaluate.diebold_mariano(pairs(t), ["level"], 1), "statistic").select("level", "n", "statistic")


@section(f"WITH {WILCOXON}, h AS (SELECT *, least((count(*) OVER (PARTITION BY level) - row_number() OVER (PARTITION BY level ORDER BY p, horizon) + 1) * p, 1) AS x FROM wilcoxon) SELECT level, horizon, round(max(x) OVER (PARTITION BY level ORDER BY p, horizon ROWS UNBOUNDED PRECEDING), 6) AS adjusted FROM h")
def n9_holm(t: Tables) -> DataFrame:
    tests = evaluate.wilcoxon(pairs(t), ["level", "horizon"])
    return rounded(evaluate.holm(tests, ["level"], "p", "horizon"), "adjusted").select("level", "horizon", "adjusted")


_TABLE = f"{BY_SERIES}, tab AS (SELECT model, avg(rmsse) FILTER (level = 'total') AS error_total, avg(rmsse) FILTER (level = 'leaf') AS error_leaf, abs(sum(covered * n) FILTER (level = 'total') / sum(n) FILTER (level = 'total') - 0.8) <= 0.1 AS calibrated_total, abs(sum(covered * n) FILTER (level = 'leaf') / sum(n) FILTER (level = 'leaf') - 0.8) <= 0.1 AS calibrated_leaf FROM by_series GROUP BY 1)"


@section(f"WITH {_TABLE}, r AS (SELECT t.model, t.error_total + t.error_leaf AS e, CASE WHEN t.model = 'naive' THEN 3 WHEN t.error_total < b.error_total AND t.error_leaf < b.error_leaf THEN CASE WHEN t.calibrated_total AND t.calibrated_leaf THEN 1 ELSE 2 END END AS k FROM tab t, tab b WHERE b.model = 'naive') SELECT model, CASE k WHEN 1 THEN 'calibrated' WHEN 2 THEN 'most accurate' ELSE 'baseline' END AS rule FROM r WHERE k IS NOT NULL ORDER BY k, e, model LIMIT 1")
def n10_selection(t: Tables) -> DataFrame:
    return evaluate.select_model(by_level(by_series(t)), "naive")


@section()
def l11_fitted_hybrid(t: Tables) -> DataFrame:
    """Total by Poisson regression, leaves by trees, made to add up by weighted least squares."""
    return show(fitted_hybrid(t))


@section()
def n10_fitted_selection(t: Tables) -> DataFrame:
    """Naive and fitted models and the coherent hybrid side by side, by level: scaled errors, coverage, a paired test against
    the naive model (adjusted over all models and levels), and the model that the selection rule takes."""
    every = t.kept("every-model", lambda: backtest(t).unionByName(fitted_backtest(t)).unionByName(fitted_hybrid(t)))
    s = t.kept("every-series", lambda: evaluate.by_series(every, scales(t), 0.8, ["model"]))
    shown = s.groupBy("model", "level").agg(F.sum("n").alias("n"), F.avg("mase").alias("mase"), F.avg("rmsse").alias("rmsse"), (F.sum(F.col("covered") * F.col("n")) / F.sum("n")).alias("coverage"))
    naive, others = every.where("model = 'naive'"), ("drift", "poisson", "trees", "hybrid")
    pairs = None
    for m in others:
        part = evaluate.paired(naive, every.where(F.col("model") == m), scales(t)).withColumn("model", F.lit(m))
        pairs = part if pairs is None else pairs.unionByName(part)
    tests = evaluate.wilcoxon(t.kept("every-pair", lambda: pairs), ["model", "level"]).withColumns({"family": F.lit(1), "test": F.concat_ws("/", "model", "level")})
    tests = evaluate.holm(tests, ["family"], "p", "test").select("model", "level", "adjusted")
    # a row for each model and level, and one row
    chosen = evaluate.select_model(by_level(s), "naive").select(F.col("model").alias("chosen"), "rule")
    out = shown.join(F.broadcast(tests), ["model", "level"], "left").crossJoin(F.broadcast(chosen))
    out = out.withColumn("rule", F.when(F.col("model") == F.col("chosen"), F.col("rule"))).drop("chosen")
    return rounded(out, "mase", "rmsse", "coverage", "adjusted", digits=4)


@section(f"WITH {_CALIBRATION}, both_ AS (SELECT 'conformal' AS kind, level, y_real, lo, hi FROM conformal UNION ALL SELECT 'residual', level, y_real, lo, hi FROM back WHERE model = 'naive') SELECT kind, level, count(*) AS n, round(avg(CASE WHEN y_real BETWEEN lo AND hi THEN 1.0::DOUBLE ELSE 0 END), 6) AS coverage, round(avg(hi - lo), 4) AS width FROM both_ GROUP BY ALL")
def n11_conformal_effect(t: Tables) -> DataFrame:
    plain = backtest(t).where("model = 'naive'")
    rows = conformal(t).withColumn("kind", F.lit("conformal")).unionByName(plain.withColumn("kind", F.lit("residual")))
    out = rows.groupBy("kind", "level").agg(*evaluate.coverage_and_width(0.8)).drop("tolerance")
    return rounded(rounded(out, "coverage"), "width", digits=4)


_SUMMED = "SELECT '{m}' AS method, origin, horizon, series_id, y_pred FROM {s} WHERE level = 'leaf' UNION ALL SELECT '{m}', origin, horizon, 'S' || CAST(service AS VARCHAR), sum(y_pred) FROM {s} WHERE level = 'leaf' GROUP BY origin, horizon, service"
_GAINS = f"""{HYBRID}, {SCALES}, {_TOP.replace('f AS (', 'tf AS (', 1).replace('JOIN f USING', 'JOIN tf USING')}, {_WLS[: _WLS.index('SELECT x.origin')].rstrip()}, m AS ({_SUMMED.format(m='bottom_up', s='hybrid')} UNION ALL SELECT 'bottom_up', origin, horizon, 'TOTAL', sum(y_pred) FROM hybrid WHERE level = 'leaf' GROUP BY origin, horizon
    UNION ALL {_SUMMED.format(m='top_down', s='scaled')} UNION ALL SELECT 'top_down', origin, horizon, series_id, y_pred FROM hybrid WHERE level = 'total' UNION ALL SELECT 'structural', origin, horizon, series_id, new FROM every),
    gains AS (SELECT method, h.level, abs(h.y_real - h.y_pred) / mase_scale AS a, abs(h.y_real - m.y_pred) / mase_scale AS b, abs(h.y_real - m.y_pred) / mase_scale - abs(h.y_real - h.y_pred) / mase_scale AS d FROM hybrid h JOIN m USING (origin, horizon, series_id) JOIN scales USING (series_id)), {_signed_rank('gains', 'method, level')}"""


@section(f"WITH {_GAINS}, e AS (SELECT method, level, avg(a) AS a, avg(b) AS b, avg(CASE WHEN b < a THEN 1.0::DOUBLE ELSE 0 END) AS wins FROM gains GROUP BY ALL) SELECT e.method, e.level, n, round(p, 5) AS p, round(100 * (b / a - 1), 6) AS change, round(wins, 6) AS wins FROM e LEFT JOIN wilcoxon w ON w.method = e.method AND w.level = e.level")
def n11_reconciliation_gain(t: Tables) -> DataFrame:
    """What each reconciliation gains over the forecasts that it starts from, by level, with a paired test."""
    base, scale = t.kept("hybrid", lambda: hybrid(t)), scales(t)
    methods = {"bottom_up": reconcile.bottom_up, "top_down": reconcile.top_down, "structural": reconcile.structural}
    made = None
    for name, method in methods.items():
        rows = evaluate.paired(base, method(base, KEYS), scale).withColumn("method", F.lit(name))
        made = rows if made is None else made.unionByName(rows)
    both = t.kept("gains", lambda: made)
    tests, means = evaluate.wilcoxon(both, ["method", "level"]), evaluate.paired_summary(both, ["method", "level"])
    # a row for each method and level
    out = means.join(F.broadcast(tests.select("method", "level", "n", "p")), ["method", "level"], "left")
    return rounded(rounded(out, "change", "wins"), "p", digits=5).select("method", "level", "n", "p", "change", "wins")


@section(f"""WITH {BACK}, {SCALES}, p AS (SELECT model, level, CASE WHEN origin >= (SELECT max(origin) - 8 FROM origins) THEN 'holdout' ELSE 'backtest' END AS part, avg(abs(y_real - y_pred) / mase_scale) AS mase FROM back JOIN scales USING (series_id) GROUP BY ALL)
    SELECT a.level, a.part, round(1 - a.mase / b.mase, 6) AS skill FROM p a JOIN p b ON a.level = b.level AND a.part = b.part WHERE a.model = 'drift' AND b.model = 'naive'""")
def n12_skill_degradation(t: Tables) -> DataFrame:
    # one row
    rows = backtest(t).join(scales(t), "series_id").crossJoin(F.broadcast(backtest(t).agg(F.max("origin").alias("last"))))
    part = F.when(F.col("origin") >= F.col("last") - 8, "holdout").otherwise("backtest")
    p = rows.groupBy("model", "level", part.alias("part")).agg(F.avg(F.abs(F.col("y_real") - F.col("y_pred")) / F.col("mase_scale")).alias("mase"))
    a, b = (p.where(F.col("model") == m).select("level", "part", F.col("mase").alias(n)) for m, n in (("drift", "a"), ("naive", "b")))
    return a.join(b, ["level", "part"]).select("level", "part", F.round(1 - F.try_divide("a", "b"), 6).alias("skill"))


@section(f"""WITH {BY_SERIES}, v AS (SELECT series_id, sum(y) AS volume FROM panel WHERE level = 'leaf' GROUP BY 1), g AS (SELECT a.series_id, a.mase AS a, b.mase AS b, CASE WHEN volume < 50000 THEN 'small' WHEN volume < 60000 THEN 'middle' ELSE 'large' END AS bin FROM by_series a JOIN by_series b USING (series_id) JOIN v USING (series_id) WHERE a.model = 'drift' AND b.model = 'naive')
    SELECT bin, count(*) AS n, round(quantile_cont(a, 0.5), 6) AS mase, avg(CASE WHEN a < b THEN 1.0::DOUBLE ELSE 0 END) AS wins FROM g GROUP BY 1""")
def n13_skill_by_volume(t: Tables) -> DataFrame:
    s = by_series(t)
    volume = panel(t).where("level = 'leaf'").groupBy("series_id").agg(F.sum("y").alias("volume"))
    a, b = (s.where(F.col("model") == m).select("series_id", F.col("mase").alias(n)) for m, n in (("drift", "a"), ("naive", "b")))
    bins = F.when(F.col("volume") < 50000, "small").when(F.col("volume") < 60000, "middle").otherwise("large")
    return a.join(b, "series_id").join(volume, "series_id").groupBy(bins.alias("bin")).agg(F.count("*").alias("n"), F.round(F.percentile("a", F.lit(0.5)), 6).alias("mase"), F.avg((F.col("a") < F.col("b")).cast("double")).alias("wins"))


@section(f"WITH {PANEL}, c AS (SELECT series_id, t, y - avg(y) OVER (PARTITION BY series_id) AS c FROM panel), k AS (SELECT CAST(k AS INTEGER) AS lag FROM generate_series(0, 53) g(k)) SELECT a.series_id, lag, round(sum(a.c * b.c) / any_value(v), 6) AS acf FROM c a CROSS JOIN k JOIN c b ON b.series_id = a.series_id AND b.t = a.t - lag JOIN (SELECT series_id, sum(c * c) AS v FROM c GROUP BY 1) s ON s.series_id = a.series_id GROUP BY ALL")
def n14_autocorrelation(t: Tables) -> DataFrame:
    return evaluate.autocorrelation(panel(t), 53).select("series_id", F.posexplode("acf").alias("lag", "acf")).select("series_id", "lag", F.round("acf", 6).alias("acf"))


_PACF = f"""c AS (SELECT series_id, t, y - avg(y) OVER (PARTITION BY series_id) AS c FROM panel), p AS (SELECT series_id, {', '.join(f'c * lag(c, {k}) OVER w AS p{k}' for k in range(21))} FROM c WINDOW w AS (PARTITION BY series_id ORDER BY t)),
    a AS (SELECT series_id, [{', '.join(f'sum(p{k}) / sum(p0)' for k in range(1, 21))}] AS r FROM p GROUP BY 1),
    l AS (SELECT series_id, r, 1 AS k, r[1] AS new, [r[1]] AS phi FROM a UNION ALL
        SELECT series_id, r, k + 1, x, list_append(list_transform(range(1, k + 1), lambda j: phi[j] - x * phi[k + 1 - j]), x) FROM (SELECT *, (r[k + 1] - list_sum(list_transform(range(1, k + 1), lambda j: phi[j] * r[k + 1 - j]))) / (1 - list_sum(list_transform(range(1, k + 1), lambda j: phi[j] * r[j]))) AS x FROM l WHERE k < 20))"""


@section(f"WITH RECURSIVE {PANEL}, {_PACF} SELECT series_id, k AS lag, round(new, 6) AS pacf FROM l")
def n14_partial_autocorrelation(t: Tables) -> DataFrame:
    a = evaluate.autocorrelation(panel(t), 20)
    return a.select("series_id", F.posexplode(evaluate.partial_autocorrelation(F.col("acf"), 20)).alias("lag", "pacf")).select("series_id", (F.col("lag") + 1).alias("lag"), F.round("pacf", 6).alias("pacf"))


_MOMENTS = ", ".join(f"covar_pop({a}, {b}) * count(*) AS {a}{b}" for a, b in (("x", "x"), ("x", "z"), ("z", "z"), ("x", "dv"), ("z", "dv"), ("dv", "dv")))
_KPSS_P = "CASE WHEN kpss <= 0.347 THEN 0.10 WHEN kpss <= 0.463 THEN 0.10 - (kpss - 0.347) * (0.05 / 0.116) WHEN kpss <= 0.574 THEN 0.05 - (kpss - 0.463) * (0.025 / 0.111) WHEN kpss <= 0.739 THEN 0.025 - (kpss - 0.574) * (0.015 / 0.165) ELSE 0.01 END::DOUBLE"


@section(f"""WITH {PANEL}, b AS (SELECT series_id, t, y::DOUBLE AS y, y - lag(y) OVER (PARTITION BY series_id ORDER BY t) AS d FROM panel), v AS (SELECT series_id, 'level' AS kind, t, y AS v FROM b UNION ALL SELECT series_id, 'difference', t, d::DOUBLE FROM b WHERE d IS NOT NULL),
    x AS (SELECT *, lag(v) OVER w AS x, v - lag(v) OVER w AS dv FROM v WINDOW w AS (PARTITION BY series_id, kind ORDER BY t)), z AS (SELECT *, lag(dv) OVER (PARTITION BY series_id, kind ORDER BY t) AS z FROM x), m AS (SELECT series_id, kind, count(*) AS m, {_MOMENTS} FROM z WHERE z IS NOT NULL GROUP BY ALL),
    f AS (SELECT *, xx * zz - xz * xz AS det FROM m), g AS (SELECT *, (zz * xdv - xz * zdv) / det AS b, (xx * zdv - xz * xdv) / det AS o FROM f), df AS (SELECT series_id, kind, b / sqrt((dvdv - b * xdv - o * zdv) / (m - 3) * zz / det) AS df FROM g),
    c AS (SELECT *, v - avg(v) OVER (PARTITION BY series_id, kind) AS c FROM v), s AS (SELECT *, sum(c) OVER w AS s, {', '.join(f'c * lag(c, {k}) OVER w AS p{k}' for k in range(6))} FROM c WINDOW w AS (PARTITION BY series_id, kind ORDER BY t)), k AS (SELECT series_id, kind, count(*)::DOUBLE AS n, sum(s * s) AS ss, {', '.join(f'sum(p{k}) AS p{k}' for k in range(6))} FROM s GROUP BY ALL),
    q AS (SELECT series_id, kind, CAST(n AS BIGINT) AS n, ss / (n * n * (p0 / n{''.join(f' + 2 * (1 - {k} / 6.0::DOUBLE) * p{k} / n' for k in range(1, 6))})) AS kpss FROM k)
    SELECT series_id, kind, n, round(df, 4) AS df, df >= -2.86 AS unit_root, round(kpss, 6) AS kpss, round({_KPSS_P}, 6) AS kpss_p FROM q JOIN df USING (series_id, kind)""")
def n15_stationarity(t: Tables) -> DataFrame:
    return rounded(evaluate.stationarity(panel(t)), "kpss", "kpss_p").withColumn("df", F.round("df", 4))


@section(f"""WITH {PANEL}, a AS (SELECT series_id, t, week, y, avg(y) OVER w AS trend, count(*) OVER w AS n FROM panel WINDOW w AS (PARTITION BY series_id ORDER BY t ROWS BETWEEN 26 PRECEDING AND 26 FOLLOWING)), b AS (SELECT *, y - trend AS d FROM a WHERE n = 53), s AS (SELECT *, avg(d) OVER (PARTITION BY series_id, week) - avg(d) OVER (PARTITION BY series_id) AS seasonal FROM b)
    SELECT series_id, round(greatest(1 - var_pop(d - seasonal) / var_pop(trend + d - seasonal), 0), 6) AS trend_strength, round(greatest(1 - var_pop(d - seasonal) / var_pop(seasonal + d - seasonal), 0), 6) AS seasonal_strength FROM s GROUP BY 1""")
def n16_strengths(t: Tables) -> DataFrame:
    return rounded(evaluate.strengths(panel(t)), "trend_strength", "seasonal_strength")


@section()
def n17_harmonic_test(t: Tables) -> DataFrame:
    """Deviance of every series by 0 to 3 harmonics, likelihood ratios and their chi-square tails (two degrees each)."""
    return rounded(rounded(evaluate.harmonic_test(evaluate.harmonic_fits(panel(t), 3)), "p"), "deviance", "ratio", digits=3)


def _fourier(harmonics: int) -> dict[str, str]:
    return {f"{n}_{k}": f"{n}({k} * 2 * pi() * week / 52)" for k in range(1, harmonics + 1) for n in ("sin", "cos")}


_HARMONIC = " UNION ALL ".join(f"SELECT series_id, k, {j} AS place, {x} AS v, y FROM panel, ks WHERE k >= {(j + 1) // 2}" for j, x in enumerate(["1.0::DOUBLE", *_fourier(3).values()]))


@section(f"WITH {PANEL}, ks AS (SELECT CAST(k AS INTEGER) AS k FROM generate_series(0, 3) g(k)), x AS ({_HARMONIC}) SELECT series_id, k AS harmonics, place, round(sum(v * y), 2) AS fitted FROM x GROUP BY ALL")
def n17_score_equations(t: Tables) -> DataFrame:
    """Sums of each term times the fitted mean, for every series and number of harmonics; the data's own sums, if the fits are right."""
    fits = evaluate.harmonic_fits(panel(t), 3)
    return fits.select("series_id", "harmonics", F.posexplode("fitted").alias("place", "fitted")).withColumn("fitted", F.round("fitted", 2))


@section(f"WITH {BACK} SELECT series_id, horizon, round(avg(abs(y_real - y_pred)), 6) AS mae, round(sqrt(avg((y_real - y_pred) ** 2)), 6) AS rmse, round(100 * avg(abs((y_real - y_pred) / nullif(y_real, 0))), 6) AS mape FROM back WHERE model = 'naive' GROUP BY ALL")
def n18_naive_check(t: Tables) -> DataFrame:
    return rounded(models.backtest(panel(t), ["naive"], HORIZONS).groupBy("series_id", "horizon").agg(*evaluate.point_errors()), "mae", "rmse", "mape")


