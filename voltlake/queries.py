"""The engine's queries, bound to the star-schema and events tables, each with its SQL where SQL can express it.

events stands for an entity's measurements (user_id, ts, value; ts is unique), lineitem for bus-like and line-like rows, trade
between nations for a graph. Doubles are rounded on both sides.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .operators import clean, correlation, dimensionality, electrical, forest, fuse, generate, graph, inject, labels, quality, rolling, scale, spectral, split, stats, windows
from .operators import select as selection

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _round(df: DataFrame, places: int = 6) -> DataFrame:
    return df.select(*((F.round(c, places) + 0.0).alias(c) if k == "double" else F.col(c) for c, k in df.dtypes))


def _r(x: str, name: str, places: int = 6) -> str:
    return f"round(({x})::DOUBLE, {places}) + 0.0 AS {name}"


def _long(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("long") for c in columns})


STAMP = "yyyy-MM-dd HH:mm:ss"
BUS = "SELECT l_orderkey, l_partkey, l_suppkey, 1 + (l_discount - 0.05) AS v, l_quantity AS p, l_tax * 100 AS q FROM lineitem"
LINE = "SELECT l_orderkey, l_partkey, l_suppkey, l_extendedprice / 1000 AS a, l_extendedprice * (1 - l_discount) / 1000 AS b, l_quantity * 2 AS x FROM lineitem"
DAILY = "SELECT user_id, date_trunc('day', ts)::TIMESTAMP AS d, avg(value) AS x FROM events GROUP BY 1, 2"
SERIES = "SELECT date_trunc('day', ts)::TIMESTAMP AS t, avg(value) AS x FROM events GROUP BY 1"
HOURS = "SELECT date_trunc('hour', ts)::TIMESTAMP AS t, avg(value) AS x FROM events GROUP BY 1"


def _day(c: str = "ts"):
    return F.col(c).cast("date").cast("timestamp_ntz")


def _hour(c: str = "ts"):
    return F.to_timestamp_ntz(F.date_format(c, "yyyy-MM-dd HH:00:00"))


def _events(s, d):
    return _t(s, d, "events").select("event_id", "ts", "user_id", "value", "event_type")


def _bus(s, d):
    return _t(s, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", (1 + (F.col("l_discount") - 0.05)).alias("v"), F.col("l_quantity").alias("p"), (F.col("l_tax") * 100).alias("q"))


def _line(s, d):
    return _t(s, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", (F.col("l_extendedprice") / 1000).alias("a"), (F.col("l_extendedprice") * (1 - F.col("l_discount")) / 1000).alias("b"), (F.col("l_quantity") * 2).alias("x"))


def _series(s, d):
    return stats.aggregate_system(_events(s, d).withColumn("t", _day()), "value", "t")


def _hourly(s, d):
    return stats.aggregate_system(_events(s, d).withColumn("t", _hour()), "value", "t")


def _grid(s, d):
    """User by day, with gaps as nulls."""
    daily = _events(s, d).groupBy("user_id", _day().alias("d")).agg(F.avg("value").alias("x"))
    days = daily.agg(F.min("d").alias("a"), F.max("d").alias("b")).select(F.explode(F.sequence(F.col("a").cast("date"), F.col("b").cast("date"))).alias("dd"))
    users = daily.select("user_id").distinct()
    return users.crossJoin(F.broadcast(days)).withColumn("d", F.col("dd").cast("timestamp_ntz")).drop("dd").join(daily, ["user_id", "d"], "left")  # the days of a month


GRID = f"WITH daily AS ({DAILY}), days AS (SELECT DISTINCT d FROM daily), users AS (SELECT DISTINCT user_id FROM daily), grid AS (SELECT u.user_id, g.d, x FROM users u CROSS JOIN days g LEFT JOIN daily ON daily.user_id = u.user_id AND daily.d = g.d)"


# --- rolling and global statistics

_OVER = "(PARTITION BY user_id ORDER BY ts ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)"


def _rolling_sql(over: str) -> str:
    n = f"count(value) OVER {over}"
    same = f"max(value) OVER {over} = min(value) OVER {over}"
    m = {k: f"avg({'value' + ' * value' * (k - 1)}) OVER {over}" for k in (1, 2)}
    parts = {
        "mean": m[1], "std": f"stddev_samp(value) OVER {over}", "variance": f"var_samp(value) OVER {over}", "rms": f"sqrt({m[2]})",
        "skewness": f"CASE WHEN {n} < 3 THEN NULL WHEN {same} THEN 0 ELSE skewness(value) OVER {over} END", "kurtosis": f"CASE WHEN {n} < 4 THEN NULL WHEN {same} THEN -3 ELSE kurtosis(value) OVER {over} END",
        "min": f"min(value) OVER {over}", "max": f"max(value) OVER {over}", "range": f"max(value) OVER {over} - min(value) OVER {over}",
    }
    return "SELECT event_id, " + ", ".join(_r(f"CASE WHEN {n} >= 2 THEN {v} END", f"value_rolling_{k}", 5 if k in ("skewness", "kurtosis") else 8) for k, v in parts.items()) + " FROM events"


def _rolled(df: DataFrame) -> DataFrame:
    few = {f"value_rolling_{k}": F.round(f"value_rolling_{k}", 5) for k in ("skewness", "kurtosis")}
    return _round(df.withColumns(few).drop("ts", "user_id", "value", "event_type"), 8)


@query(_rolling_sql(_OVER))
def rolling_stats(s, d):
    out = rolling.rolling_statistics(_events(s, d), ["value"], ["ts"], ["user_id"])
    return _rolled(out)


@query(_rolling_sql("(ORDER BY ts ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)"))
def rolling_stats_unpartitioned(s, d):
    """Events of the same ts, whose order the SQL leaves open, are in the order of their ids."""
    out = rolling.rolling_statistics(_events(s, d), ["value"], ["ts", "event_id"])
    return _rolled(out)


def _describe(x: str, of: str, name: str) -> str:
    q = ", ".join(_r(f"quantile_cont({x}, {a})", b) for a, b in ((0.25, "q1"), (0.5, "median"), (0.75, "q3")))
    return f"SELECT '{name}' AS feature, count({x}) AS count, {_r(f'avg({x})', 'mean')}, {_r(f'stddev_samp({x})', 'std')}, {_r(f'min({x})', 'min')}, {q}, {_r(f'max({x})', 'max')}, {_r(f'var_samp({x})', 'variance', 4)}, {_r(f'skewness({x})', 'skewness', 5)}, {_r(f'kurtosis({x})', 'kurtosis', 5)} FROM {of}"


@query(" UNION ALL ".join(_describe(x, "lineitem", x) for x in ("l_quantity", "l_discount", "l_tax")))
def global_statistics(s, d):
    out = rolling.global_statistics(_t(s, d, "lineitem"), ["l_quantity", "l_discount", "l_tax"])
    return _round(_round(out.withColumns({"variance": F.round("variance", 4), "skewness": F.round("skewness", 5), "kurtosis": F.round("kurtosis", 5)})))


# --- electrical projections

_KEYS = "l_orderkey, l_partkey, l_suppkey"


@query(
    f"SELECT {_KEYS}, " + ", ".join([_r("v - 1.0", "voltage_deviation_pu"), _r("abs(v - 1.0)", "absolute_voltage_deviation_pu"), _r("(v - 1.0) / 1.0", "relative_voltage_deviation"), _r("v - 0.975", "lower_voltage_margin_pu"), _r("1.033 - v", "upper_voltage_margin_pu"), "(v < 0.975)::INT AS undervoltage", "(v > 1.033)::INT AS overvoltage", "(v < 0.975 OR v > 1.033)::INT AS voltage_violation", _r("sqrt(p*p + q*q)", "apparent_power_mva"), _r("least(1.0, abs(p) / (sqrt(p*p + q*q) + 1e-8))", "power_factor"), _r("degrees(atan2(q, p))", "power_factor_angle_deg"), _r("p / (abs(q) + 1e-8)", "pq_ratio", 2), _r("sqrt(p*p + q*q)", "pq_magnitude")]) + f" FROM ({BUS})"
)
def electrical_bus(s, d):
    out = electrical.bus_features(_bus(s, d), electrical.Limits(voltage_min=0.975, voltage_max=1.033), "v", "p", "q").drop("v", "p", "q")
    return _round(out.withColumn("pq_ratio", F.round("pq_ratio", 2)))


@query(f"SELECT {_KEYS}, " + ", ".join([_r("abs(a)", "absolute_current_from_ka", 9), _r("abs(b)", "absolute_current_to_ka", 9), _r("(abs(a) + abs(b)) / 2", "mean_current_ka", 9), _r("abs(a) - abs(b)", "current_difference_ka", 9), _r("abs(abs(a) - abs(b))", "absolute_current_difference_ka", 9), _r("abs(abs(a) - abs(b)) / (greatest(abs(a), abs(b)) + 1e-8)", "current_imbalance", 9), _r("100 - x", "loading_margin_percent", 9), _r("x / 100", "loading_ratio", 9), "(x > 100)::INT AS thermal_overload, (x >= 90)::INT AS loading_above_90, (x >= 95)::INT AS loading_above_95"]) + f" FROM ({LINE})")
def electrical_line(s, d):
    return _round(electrical.line_features(_line(s, d), electrical.Limits(), "a", "b", "x").drop("a", "b", "x"), 9)


@query(f"SELECT {_KEYS}, " + ", ".join([_r("(abs(a) + abs(b)) / 2", "mean_edge_current_ka", 9), _r("abs(abs(a) - abs(b))", "edge_current_difference_ka", 9), _r("abs(abs(a) - abs(b)) / (greatest(abs(a), abs(b)) + 1e-8)", "edge_current_imbalance", 9), _r("x / 100", "edge_loading_ratio", 9), _r("x / 100", "edge_stress", 9), "(x > 100)::INT AS edge_overloaded"]) + f" FROM ({LINE})")
def flow_features(s, d):
    return _round(electrical.flow_features(_line(s, d), electrical.Limits(), "a", "b", "x").drop("a", "b", "x"), 9)


# --- system aggregates and exploratory statistics


def _system(name: str, sql: str) -> None:
    def f(s, d):
        out = stats.aggregate_system(_events(s, d).withColumn("t", _hour()), "value", "t", name)
        return _round(out.select(F.date_format("t", STAMP).alias("t"), "value"))

    f.__name__ = f"system_aggregate_{name}"
    query(f"SELECT strftime(date_trunc('hour', ts)::TIMESTAMP, '%Y-%m-%d %H:%M:%S') AS t, {_r(sql, 'value')} FROM events GROUP BY 1")(f)


for _n, _q in {"mean": "avg(value)", "median": "quantile_cont(value, 0.5)", "min": "min(value)", "max": "max(value)", "std": "stddev_samp(value)"}.items():
    _system(_n, _q)


@query(f"SELECT extract(hour FROM t)::INT AS hour, {_r('avg(x)', 'mean')}, {_r('stddev_samp(x)', 'std')}, {_r('min(x)', 'min')}, {_r('max(x)', 'max')} FROM ({HOURS}) GROUP BY 1")
def hourly_profile(s, d):
    return _round(stats.hourly_profile(_hourly(s, d), "t"))


@query(f"SELECT strftime(t, '%H:%M') AS time, strftime(t, '%Y-%m-%d') AS date, {_r('x', 'value')} FROM ({HOURS})")
def daily_profile(s, d):
    return _round(stats.daily_profile(_hourly(s, d), "t"))


def _dist(x: str) -> str:
    return f"""SELECT '{x}' AS feature, count(*) AS count, {_r(f'avg({x})', 'mean')}, {_r('any_value(md)', 'median')}, {_r(f'stddev_samp({x})', 'std')}, {_r(f'min({x})', 'min')}, {_r('any_value(q1)', 'q1')}, {_r('any_value(q3)', 'q3')}, {_r(f'max({x})', 'max')}, {_r(f'skewness({x})', 'skewness', 5)}, {_r(f'kurtosis({x})', 'kurtosis', 5)},
    count(*) FILTER ({x} < q1 - 1.5 * (q3 - q1) OR {x} > q3 + 1.5 * (q3 - q1)) AS outliers, {_r(f'count(*) FILTER ({x} < q1 - 1.5 * (q3 - q1) OR {x} > q3 + 1.5 * (q3 - q1))::DOUBLE / count(*)', 'outlier_fraction')}
    FROM lineitem, (SELECT quantile_cont({x}, 0.25) AS q1, quantile_cont({x}, 0.5) AS md, quantile_cont({x}, 0.75) AS q3 FROM lineitem) q"""


@query(" UNION ALL ".join(map(_dist, ("l_extendedprice", "l_quantity"))))
def distribution_stats(s, d):
    out = stats.distribution_stats(_t(s, d, "lineitem"), ["l_extendedprice", "l_quantity"])
    return _round(out.withColumns({"skewness": F.round("skewness", 5), "kurtosis": F.round("kurtosis", 5)}))


@query(f"WITH e AS (SELECT min(value) AS lo, max(value) AS hi, count(*) AS n FROM events), c AS (SELECT least(39, floor((value - lo) * 40 / (hi - lo)))::INT AS bin, count(*) AS count FROM events, e GROUP BY 1) SELECT b.bin::INT AS bin, {_r('lo + b.bin * ((hi - lo) / 40)', 'low')}, {_r('lo + (b.bin + 1) * ((hi - lo) / 40)', 'high')}, coalesce(c.count, 0)::BIGINT AS count, {_r('coalesce(c.count, 0) / (n * ((hi - lo) / 40))', 'density')} FROM (SELECT unnest(range(40)) AS bin) b CROSS JOIN e LEFT JOIN c ON b.bin = c.bin")
def histogram(s, d):
    return _round(stats.histogram(_events(s, d), "value"))


@query(f"SELECT event_type, 'value' AS feature, {_r('min(value)', 'min')}, {_r('quantile_cont(value, 0.25)', 'q1')}, {_r('quantile_cont(value, 0.5)', 'median')}, {_r('quantile_cont(value, 0.75)', 'q3')}, {_r('max(value)', 'max')} FROM events GROUP BY 1")
def box_plot(s, d):
    return _round(stats.box_plot(_events(s, d), ["value"], ["event_type"]))


def _per(x: str, also: list[str]) -> str:
    return ", ".join([_r(f"avg({x})", f"{x}_mean"), _r(f"stddev_samp({x})", f"{x}_std"), _r(f"min({x})", f"{x}_min"), _r(f"max({x})", f"{x}_max"), _r(f"max({x}) - min({x})", f"{x}_range"), *(z for c in also for z in (_r(f"avg({c})", f"{c}_mean"), _r(f"stddev_samp({c})", f"{c}_std")))])


@query(f"SELECT l_suppkey, {_per('v', ['q'])} FROM ({BUS}) GROUP BY 1")
def per_bus_stats(s, d):
    return _round(stats.per_entity(_bus(s, d), "l_suppkey", "v", ["q"]))


@query(f"SELECT l_suppkey, {_per('x', ['a', 'b'])} FROM ({LINE}) GROUP BY 1")
def per_line_stats(s, d):
    return _round(stats.per_entity(_line(s, d), "l_suppkey", "x", ["a", "b"]))


@query(f"SELECT strftime(date_trunc('day', ts)::TIMESTAMP, '%Y-%m-%d') AS t, {_r('min(value)', 'min')}, {_r('avg(value)', 'mean')}, {_r('max(value)', 'max')} FROM events GROUP BY 1")
def system_envelope(s, d):
    return _round(stats.envelope(_events(s, d).withColumn("t", F.date_format("ts", "yyyy-MM-dd")), "value", "t"))


@query(f"SELECT user_id, {_r('max(value) - min(value)', 'variation')} FROM events GROUP BY 1 ORDER BY max(value) - min(value) DESC, user_id LIMIT 5")
def topk_variation(s, d):
    return _round(stats.top_variation(_events(s, d), "user_id", "value"))


@query("SELECT event_id, user_id, value FROM events WHERE user_id IN (SELECT user_id FROM events GROUP BY 1 ORDER BY max(value) - min(value) DESC, user_id LIMIT 5)")
def topk_variation_profiles(s, d):
    return stats.top_variation_rows(_events(s, d), "user_id", "value").select("event_id", "user_id", "value")


@query(f"SELECT user_id, {_r('max(value) - min(value)', 'variation')} FROM events GROUP BY 1")
def sorted_variation(s, d):
    return _round(_events(s, d).groupBy("user_id").agg((F.max("value") - F.min("value")).alias("variation")).orderBy(F.col("variation").desc(), "user_id"))


@query(f"SELECT count(v) AS count, count(*) FILTER (v < 0.975) AS below, count(*) FILTER (v > 1.033) AS above, {_r('count(*) FILTER (v < 0.975)::DOUBLE / count(v)', 'below_fraction')}, {_r('count(*) FILTER (v > 1.033)::DOUBLE / count(v)', 'above_fraction')} FROM ({BUS})")
def limit_statistics(s, d):
    return _round(stats.limit_statistics(_bus(s, d), "v", 0.975, 1.033))


@query("SELECT count(*) AS rows, 6::BIGINT AS columns, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last, count(DISTINCT user_id) AS entities FROM events")
def dataset_summary(s, d):
    return stats.dataset_summary(_t(s, d, "events"), "ts", "user_id").withColumns({c: F.date_format(c, STAMP) for c in ("first", "last")})


# --- cleaning and time


@query("SELECT DISTINCT l_returnflag, l_linestatus, l_quantity, l_linenumber FROM lineitem")
def dedup_full(s, d):
    return clean.dedup_full(_t(s, d, "lineitem").select("l_returnflag", "l_linestatus", "l_quantity", "l_linenumber"))


@query("SELECT event_id, user_id, strftime(date_trunc('hour', ts)::TIMESTAMP, '%Y-%m-%d %H:%M:%S') AS t, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, date_trunc('hour', ts) ORDER BY event_id) AS n FROM events) WHERE n = 1")
def dedup_keep_first(s, d):
    return clean.dedup_keep_first(_events(s, d).withColumn("t", _hour()), ["user_id", "t"], ["event_id"]).select("event_id", "user_id", F.date_format("t", STAMP).alias("t"), "value")


@query("SELECT event_id, try_cast(event_type AS DOUBLE) AS event_type, round(value, 6) + 0.0 AS value FROM events")
def numeric_coercion(s, d):
    return _round(clean.coerce(_events(s, d), ["event_type", "value", "absent"]).select("event_id", "event_type", "value"))


@query(GRID + f""", n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY d) AS i FROM grid),
known AS (SELECT user_id, i, x FROM n WHERE x IS NOT NULL),
pre AS (SELECT n.user_id, n.i, max(k.i) AS pi FROM n JOIN known k ON k.user_id = n.user_id AND k.i <= n.i GROUP BY ALL),
nxt AS (SELECT n.user_id, n.i, min(k.i) AS ni FROM n JOIN known k ON k.user_id = n.user_id AND k.i >= n.i GROUP BY ALL)
SELECT n.user_id, strftime(n.d, '%Y-%m-%d') AS d, {_r('coalesce(n.x, a.x + (b.x - a.x) * (n.i - a.i) / nullif(b.i - a.i, 0), a.x, b.x)', 'x')} FROM n LEFT JOIN pre ON pre.user_id = n.user_id AND pre.i = n.i LEFT JOIN nxt ON nxt.user_id = n.user_id AND nxt.i = n.i LEFT JOIN known a ON a.user_id = n.user_id AND a.i = pre.pi LEFT JOIN known b ON b.user_id = n.user_id AND b.i = nxt.ni""")
def interpolate_linear(s, d):
    return _round(clean.interpolate(_grid(s, d), ["x"], ["user_id"], ["d"]).select("user_id", F.date_format("d", "yyyy-MM-dd").alias("d"), "x"))


@query(GRID + f" SELECT user_id, strftime(d, '%Y-%m-%d') AS d, {_r('last_value(x IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY d ROWS UNBOUNDED PRECEDING)', 'x')} FROM grid")
def forward_fill(s, d):
    return _round(clean.interpolate(_grid(s, d), ["x"], ["user_id"], ["d"], "forward_fill").select("user_id", F.date_format("d", "yyyy-MM-dd").alias("d"), "x"))


_H, _W = "(extract(hour FROM ts) + extract(minute FROM ts) / 60.0)", "((extract(dow FROM ts) + 6) % 7)"


@query(f"SELECT event_id, {_r(_H, 'hour')}, {_W}::INT AS day_of_week, extract(doy FROM ts)::INT AS day_of_year, {_r(f'sin(2 * pi() * {_H} / 24)', 'hour_sin')}, {_r(f'cos(2 * pi() * {_H} / 24)', 'hour_cos')}, {_r(f'sin(2 * pi() * {_W} / 7)', 'day_of_week_sin')}, {_r(f'cos(2 * pi() * {_W} / 7)', 'day_of_week_cos')} FROM events")
def time_features(s, d):
    return _round(clean.time_features(_events(s, d), "ts").drop("ts", "user_id", "value", "event_type"))


@query("WITH g AS (SELECT l_orderkey, l_linenumber, l_quantity, l_tax FROM lineitem), u AS (SELECT DISTINCT * FROM g), k AS (SELECT DISTINCT l_orderkey, l_linenumber FROM u) SELECT (SELECT count(*) FROM g) AS rows_before, (SELECT count(*) FROM g) - (SELECT count(*) FROM u) AS equal_rows, (SELECT count(*) FROM u) - (SELECT count(*) FROM k) AS repeated_keys, 0::BIGINT AS missing_before, (SELECT count(*) FROM k) AS rows_after, 0::BIGINT AS missing_after")
def preprocess_report(s, d):
    rows = _t(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_tax")
    after = clean.dedup_keep_first(clean.dedup_full(rows), ["l_orderkey", "l_linenumber"], ["l_quantity", "l_tax"])
    return clean.report(rows, after, ["l_orderkey", "l_linenumber"])


_FRAME = "(ORDER BY t ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)"


@query(f"""WITH s AS ({HOURS}), w AS (SELECT t, x, x - lag(x) OVER (ORDER BY t) AS dx, lag(x) OVER (ORDER BY t) AS x1, lag(x, 4) OVER (ORDER BY t) AS x4, CASE WHEN count(x) OVER {_FRAME} >= 4 THEN stddev_samp(x) OVER {_FRAME} END AS sd FROM s),
st AS (SELECT epoch(max(t) - min(t)) AS g FROM (SELECT t FROM s ORDER BY t LIMIT 2))
SELECT {_r('avg(x)', 'mean')}, {_r('stddev_samp(x)', 'std')}, {_r('min(x)', 'min')}, {_r('max(x)', 'max')}, {_r('avg(abs(dx))', 'mean_abs_change')}, {_r('max(abs(dx))', 'max_abs_change')}, {_r('avg(abs(dx)) / max(g)', 'mean_abs_ramp')}, {_r('max(abs(dx)) / max(g)', 'max_abs_ramp')}, {_r('corr(x, x1)', 'acf_1')}, {_r('corr(x, x4)', 'acf_4')}, {_r('avg(sd)', 'rolling_std_mean')}, {_r('max(sd)', 'rolling_std_max')} FROM w, st""")
def temporal_statistics(s, d):
    return _round(stats.temporal_statistics(_hourly(s, d), "t"))


@query(f"WITH s AS (SELECT t, x, row_number() OVER (ORDER BY t) AS i FROM ({HOURS})) SELECT k.lag::INT AS lag, {_r('corr(a.x, b.x)', 'acf')} FROM (SELECT unnest(range(25)) AS lag) k JOIN s a ON true JOIN s b ON b.i = a.i - k.lag GROUP BY 1")
def autocorrelation(s, d):
    return _round(stats.autocorrelation(_hourly(s, d), "t"))


@query(f"SELECT strftime(t, '%Y-%m-%d %H:%M:%S') AS t, {_r('dx', 'change')}, {_r('g', 'seconds')}, {_r('dx / g', 'ramp')} FROM (SELECT t, x - lag(x) OVER (ORDER BY t) AS dx, epoch(t - lag(t) OVER (ORDER BY t)) AS g FROM ({HOURS})) WHERE g IS NOT NULL")
def ramp_rate(s, d):
    return _round(stats.ramp_rate(_hourly(s, d), "t").select(F.date_format("t", STAMP).alias("t"), "change", "seconds", "ramp"))


@query(f"SELECT event_id, {_r('CASE WHEN count(value) OVER ' + _OVER + ' >= 4 THEN avg(value) OVER ' + _OVER + ' END', 'rolling_mean')}, {_r('CASE WHEN count(value) OVER ' + _OVER + ' >= 4 THEN stddev_samp(value) OVER ' + _OVER + ' END', 'rolling_std')} FROM events")
def rolling_mean_std(s, d):
    return _round(stats.rolling_mean_std(_events(s, d), "ts", "value", 4, ["user_id"]).select("event_id", "rolling_mean", "rolling_std"))


@query(f"SELECT user_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, 8::INT AS n, {_r('first', 'first_value')}, {_r('value', 'last_value')} FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS i, lag(value::FLOAT::DOUBLE, 7) OVER (PARTITION BY user_id ORDER BY ts) AS first FROM (SELECT user_id, ts, value::FLOAT::DOUBLE AS value FROM events)) WHERE i >= 8 AND (i - 8) % 4 = 0")
def sliding_windows(s, d):
    out = windows.sliding_windows(_events(s, d), ["value"], "user_id", "ts", 8, 4)
    return _round(out.select("user_id", F.date_format("ts", STAMP).alias("ts"), F.size("window").alias("n"), F.col("window")[0][0].cast("double").alias("first_value"), F.col("window")[7][0].cast("double").alias("last_value")))


# --- split, scaling, selection

_SPLIT = "WITH u AS (SELECT ts, row_number() OVER (ORDER BY ts) AS i, count(*) OVER () AS n FROM (SELECT DISTINCT ts FROM events)), sp AS (SELECT e.*, CASE WHEN i <= floor(n * 0.6) THEN 'train' WHEN i <= floor(n * 0.6) + floor(n * 0.2) THEN 'validation' ELSE 'test' END AS split FROM events e JOIN u ON u.ts = e.ts)"


def _split(s, d):
    return split.temporal_split(_events(s, d), "ts")


@query(_SPLIT + " SELECT event_id, split FROM sp")
def temporal_split(s, d):
    return _split(s, d).select("event_id", "split")


@query(_SPLIT + " SELECT split, count(*) AS rows, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last, count(DISTINCT ts) AS timestamps FROM sp GROUP BY 1")
def split_summary(s, d):
    return split.summarize(_split(s, d), "ts").withColumns({c: F.date_format(c, STAMP) for c in ("first", "last")})


@query(_SPLIT + " SELECT count(*) AS leaks FROM (SELECT ts FROM sp GROUP BY ts HAVING count(DISTINCT split) > 1)")
def split_leakage(s, d):
    return split.leakage(_split(s, d), "ts").agg(F.count("*").alias("leaks"))


@query("SELECT strftime(t, '%Y-%m-%d %H:%M:%S') AS t, splits FROM (SELECT date_trunc('hour', ts)::TIMESTAMP AS t, count(DISTINCT CASE WHEN event_id % 50 = 0 THEN 'test' ELSE 'train' END) AS splits FROM events GROUP BY 1) WHERE splits > 1")
def split_leakage_found(s, d):
    """The check on a split that leaks: rows were taken for the test by their id, not by time."""
    rows = _events(s, d).select(_hour().alias("t"), F.when(F.col("event_id") % 50 == 0, "test").otherwise("train").alias("split"))
    return split.leakage(rows, "t").withColumn("t", F.date_format("t", STAMP))


_COLS = ("l_quantity", "l_extendedprice", "l_tax")
_TRAIN = "l_orderkey % 5 < 3"


def _scaled(method: str, center: str, scale_sql: str):
    def f(s, d):
        rows = _t(s, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", *_COLS, F.when(F.expr(_TRAIN), "train").otherwise("test").alias("split"))
        _, out = scale.scale_split(rows, method, list(_COLS))
        return _round(out.drop("split"))

    f.__name__ = f"scale_{method}"
    params = ", ".join(f"{center.format(c)} AS c_{c}, {scale_sql.format(c)} AS s_{c}" for c in _COLS)
    query(f"WITH m AS (SELECT {params} FROM lineitem WHERE {_TRAIN}) SELECT {_KEYS}, " + ", ".join(_r(f"({c} - c_{c}) / CASE WHEN abs(s_{c}) < 1e-12 THEN 1 ELSE s_{c} END", c) for c in _COLS) + " FROM lineitem, m")(f)


_scaled("standard", "avg({})", "stddev_pop({})")
_scaled("minmax", "min({})", "max({0}) - min({0})")
_scaled("robust", "quantile_cont({}, 0.5)", "quantile_cont({0}, 0.75) - quantile_cont({0}, 0.25)")


@query(f"SELECT {_KEYS}, " + ", ".join(_r(c, c, 4) for c in _COLS) + " FROM lineitem")
def scale_inverse(s, d):
    rows = _t(s, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", *_COLS)
    model, out = scale.fit_transform(rows, "standard", list(_COLS))
    return _round(model.inverse_transform(out), 4)


_WIDE = ("value", "twice", "gap", "flat", "late")
_WIDE_SQL = "SELECT event_id, value, value * 2 + 1 AS twice, CASE WHEN event_id % 2 = 0 THEN value * value END AS gap, 7.0::DOUBLE AS flat, (event_id % 97)::DOUBLE AS late FROM events"


def _wide(s, d):
    v = F.col("value")
    return _events(s, d).select("event_id", v, (v * 2 + 1).alias("twice"), F.when(F.col("event_id") % 2 == 0, v * v).alias("gap"), F.lit(7.0).alias("flat"), (F.col("event_id") % 97).cast("double").alias("late"))


@query(" UNION ALL ".join(f"SELECT '{c}' AS feature, {_r(f'avg(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0.0 END)', 'missing')}, avg(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0.0 END) <= 0.3 AS kept FROM ({_WIDE_SQL})" for c in _WIDE))
def missing_filter(s, d):
    return _round(selection.missing_filter(_wide(s, d), list(_WIDE)))


@query(" UNION ALL ".join(f"SELECT '{c}' AS feature, {_r(f'var_samp({c})', 'variance', 3)}, var_samp({c}) > 1e-8 AS kept FROM ({_WIDE_SQL})" for c in _WIDE))
def variance_filter(s, d):
    return _round(selection.variance_filter(_wide(s, d), list(_WIDE)), 3)


@query(f"WITH w AS ({_WIDE_SQL}) SELECT 'twice' AS feature FROM w HAVING abs(corr(value, twice)) > 0.95 UNION ALL SELECT 'late' FROM w HAVING abs(corr(value, late)) > 0.95 OR abs(corr(twice, late)) > 0.95")
def correlation_prune(s, d):
    return selection.correlation_prune(_wide(s, d), ["value", "twice", "late"])


@query(f"WITH w AS ({_WIDE_SQL}) SELECT event_id, {_r('value', 'value')}, {_r('late', 'late')} FROM w")
def select_transform_mean_fill(s, d):
    rows = _wide(s, d)
    return _round(selection.fit(rows, list(_WIDE)).transform(rows, ["event_id"]))


_HOLES = "SELECT event_id, value, CASE WHEN event_id % 10 <> 0 THEN (event_id % 89)::DOUBLE END AS hole, CASE WHEN event_id % 7 <> 0 THEN sqrt(abs(value)) * (event_id % 5) END AS other FROM events"


@query(f"WITH w AS ({_HOLES}) SELECT event_id, {_r('value', 'value')}, {_r('coalesce(hole, avg(hole) OVER ())', 'hole')}, {_r('coalesce(other, avg(other) OVER ())', 'other')} FROM w")
def select_transform_fills(s, d):
    """Kept columns with nulls: the training mean takes their place."""
    v, i = F.col("value"), F.col("event_id")
    rows = _events(s, d).select("event_id", "value", F.when(i % 10 != 0, (i % 89).cast("double")).alias("hole"), F.when(i % 7 != 0, F.sqrt(F.abs(v)) * (i % 5)).alias("other"))
    return _round(selection.fit(rows, ["value", "hole", "other"]).transform(rows, ["event_id"]))


_SCORED = _SPLIT + ", th AS (SELECT quantile_cont(value, 0.95) AS c FROM sp WHERE split = 'validation')"


def _scored(s, d):
    rows = _split(s, d)
    return forest.predict(rows, forest.threshold(rows.where("split = 'validation'"), "value"), "value")


@query(_SCORED + f" SELECT {_r('c', 'threshold')} FROM th")
def quantile_threshold(s, d):
    return _round(_split(s, d).where("split = 'validation'").agg(F.percentile("value", F.lit(0.95)).alias("threshold")))


@query(_SCORED + " SELECT event_id, (value >= c)::INT AS prediction FROM sp, th")
def threshold_predict(s, d):
    return _scored(s, d).select("event_id", "prediction")


@query(_SCORED + f" SELECT split, count(*) AS rows, {_r('avg(value)', 'mean_score')}, (count(*) FILTER (value >= c))::BIGINT AS anomalies, {_r('(count(*) FILTER (value >= c))::DOUBLE / count(*)', 'anomaly_fraction')} FROM sp, th GROUP BY 1")
def score_summary(s, d):
    return _round(forest.score_summary(_scored(s, d), score="value"))


# --- joins, injection, labels, validation

_TOPOLOGY = "SELECT s_suppkey AS line_id, s_nationkey AS from_bus, (s_suppkey * 7) % 25 AS to_bus, s_acctbal > 0 AS in_service FROM supplier"


def _topology(s, d):
    return _t(s, d, "supplier").select(F.col("s_suppkey").alias("line_id"), F.col("s_nationkey").alias("from_bus"), (F.col("s_suppkey") * 7 % 25).alias("to_bus"), (F.col("s_acctbal") > 0).alias("in_service"))


@query(f"SELECT line_id::BIGINT AS line_id, from_bus::BIGINT AS from_bus, to_bus::BIGINT AS to_bus, in_service FROM ({_TOPOLOGY}) WHERE in_service")
def topology_active_lines(s, d):
    return graph.active_lines(_topology(s, d))


_EDGES = f"SELECT DISTINCT least(from_bus, to_bus)::BIGINT AS src, greatest(from_bus, to_bus)::BIGINT AS dst FROM ({_TOPOLOGY}) WHERE from_bus <> to_bus"
_BOTH = f"e AS ({_EDGES}), bw AS (SELECT src, dst FROM e UNION ALL SELECT dst, src FROM e), deg AS (SELECT src AS node, count(*) AS k FROM bw GROUP BY 1)"


def _graph(s, d):
    return graph.edges(_topology(s, d), ("from_bus", "to_bus"))


@query(_EDGES)
def graph_edges(s, d):
    return _graph(s, d)


@query(f"WITH {_BOTH} SELECT node, k AS node_degree, k::DOUBLE AS node_weighted_degree FROM deg")
def node_degree(s, d):
    return graph.degrees(_graph(s, d))


@query(f"WITH {_BOTH}, tri AS (SELECT x.src AS a, x.dst AS b, y.dst AS c FROM e x JOIN e y ON x.dst = y.src JOIN e z ON z.src = x.src AND z.dst = y.dst), cnt AS (SELECT node, count(*) AS t FROM (SELECT a AS node FROM tri UNION ALL SELECT b FROM tri UNION ALL SELECT c FROM tri) GROUP BY 1) SELECT deg.node, {_r('CASE WHEN k > 1 THEN 2.0 * coalesce(t, 0) / (k * (k - 1)) ELSE 0 END', 'local_clustering_coefficient')} FROM deg LEFT JOIN cnt ON cnt.node = deg.node")
def clustering_coefficient(s, d):
    return _round(graph.clustering(_graph(s, d)))


def _pagerank_sql(rounds: int = 8) -> str:
    steps = [f"WITH {_BOTH}, n AS (SELECT count(*) AS n FROM deg), r0 AS (SELECT node, 1.0::DOUBLE / n AS r FROM deg, n)"]
    for i in range(rounds):
        steps.append(f"r{i + 1} AS (SELECT b.dst AS node, 0.15::DOUBLE / max(n) + 0.85::DOUBLE * sum(r / k) AS r FROM bw b JOIN r{i} ON r{i}.node = b.src JOIN deg ON deg.node = b.src, n GROUP BY 1)")
    return ", ".join(steps) + f" SELECT node, {_r('r', 'pagerank')} FROM r{rounds}"


@query(_pagerank_sql())
def pagerank_fixed_iter(s, d):
    return _round(graph.pagerank(_graph(s, d), iterations=8))


def _reach_sql(rounds: int = 6) -> str:
    steps = [f"WITH {_BOTH}, p0 AS (SELECT node AS a, node AS v, 0 AS d FROM deg)"]
    for i in range(rounds):
        steps.append(f"p{i + 1} AS (SELECT a, v, min(d) AS d FROM (SELECT a, v, d FROM p{i} UNION ALL SELECT a, b.dst, d + 1 FROM p{i} JOIN bw b ON b.src = v) GROUP BY 1, 2)")
    return ", ".join(steps)


@query(_reach_sql() + f", n AS (SELECT count(*) AS n FROM deg) SELECT a AS node, {_r('(count(*) - 1)::DOUBLE / sum(d) * (count(*) - 1) / (max(n) - 1)', 'closeness_centrality')} FROM p6, n GROUP BY 1")
def closeness(s, d):
    return _round(graph.closeness(_graph(s, d)))


@query(_reach_sql() + " SELECT a AS node, min(v) AS component FROM p6 GROUP BY 1")
def connected_components(s, d):
    return graph.connected_components(_graph(s, d))


def _paths_sql(rounds: int = 12) -> str:
    """All (s, v, steps d, shortest paths n), level by level."""
    steps = [f"WITH {_BOTH}, v0 AS (SELECT node AS s, node AS v, 0 AS d, 1.0::DOUBLE AS n FROM deg)"]
    for i in range(rounds):
        seen = " UNION ALL ".join(f"SELECT s, v FROM v{j}" for j in range(max(0, i - 1), i + 1))
        steps.append(f"v{i + 1} AS (SELECT x.s, b.dst AS v, {i + 1} AS d, sum(n) AS n FROM v{i} x JOIN bw b ON b.src = x.v ANTI JOIN ({seen}) y ON y.s = x.s AND y.v = b.dst GROUP BY 1, 2)")
    return ", ".join(steps) + ", p AS (" + " UNION ALL ".join(f"SELECT * FROM v{i}" for i in range(rounds + 1)) + "), m AS (SELECT count(*) AS m FROM deg)"


@query(_paths_sql() + f", b AS (SELECT x.v AS node, sum(x.n * y.n / z.n) AS b FROM p x JOIN p y ON x.v = y.s JOIN p z ON z.s = x.s AND z.v = y.v AND z.d = x.d + y.d WHERE x.d > 0 AND y.d > 0 GROUP BY 1) SELECT deg.node, {_r('coalesce(b, 0) / ((m - 1) * (m - 2))', 'betweenness_centrality')} FROM deg LEFT JOIN b ON b.node = deg.node, m")
def betweenness(s, d):
    return _round(graph.node_features(_graph(s, d)).select("node", "betweenness_centrality"))


@query(_paths_sql() + f", w AS (SELECT least(e.src, e.dst) AS src, greatest(e.src, e.dst) AS dst, sum(x.n * y.n / z.n) AS b FROM p x JOIN bw e ON e.src = x.v JOIN p y ON e.dst = y.s JOIN p z ON z.s = x.s AND z.v = y.v AND z.d = x.d + y.d + 1 GROUP BY 1, 2) SELECT w.src, w.dst, f.k AS from_bus_degree, t.k AS to_bus_degree, {_r('b / (m * (m - 1))', 'edge_betweenness_centrality')} FROM w JOIN deg f ON f.node = w.src JOIN deg t ON t.node = w.dst, m")
def edge_betweenness(s, d):
    return _round(graph.edge_features(_graph(s, d)))


@query(f"WITH RECURSIVE {_BOTH}, ids AS (SELECT node, row_number() OVER (ORDER BY node) AS i FROM deg), near AS (SELECT list(js ORDER BY i) AS near FROM (SELECT a.i, list(b.i ORDER BY b.i) AS js FROM bw JOIN ids a ON a.node = bw.src JOIN ids b ON b.node = bw.dst GROUP BY 1)), it(k, x) AS (SELECT 0, list_transform(near, lambda a: 1.0::DOUBLE / len(near)) FROM near UNION ALL SELECT k + 1, list_transform(y, lambda v: v / sqrt(list_sum(list_transform(y, lambda u: u * u)))) FROM (SELECT k, list_transform(range(1, len(x) + 1), lambda i: x[i] + list_sum(list_transform(near[i], lambda j: x[j]))) AS y FROM it, near WHERE k < 500)) SELECT node, {_r('x[i]', 'eigenvector_centrality')} FROM it, ids WHERE k = 500")
def eigenvector_centrality(s, d):
    """To convergence: the reference's tolerance of 1e-6 a node would leave its trace in the sixth digit."""
    return _round(graph.node_features(_graph(s, d), tolerance=1e-12).select("node", "eigenvector_centrality"))


@query(f"WITH {_BOTH} SELECT c_custkey, c_nationkey, k AS node_degree, k::DOUBLE AS node_weighted_degree FROM customer LEFT JOIN deg ON deg.node = c_nationkey")
def node_feature_join(s, d):
    rows = _t(s, d, "customer").select("c_custkey", "c_nationkey")
    return fuse.join_node_features(rows, graph.degrees(_graph(s, d)), "c_nationkey").select("c_custkey", "c_nationkey", "node_degree", "node_weighted_degree")


@query(f"SELECT {_KEYS}, l_linenumber, from_bus, to_bus, in_service FROM lineitem LEFT JOIN ({_TOPOLOGY}) t ON t.line_id = l_suppkey")
def line_topology_join(s, d):
    rows = _t(s, d, "lineitem").select("l_orderkey", "l_partkey", F.col("l_suppkey").alias("line_id"), "l_linenumber")
    return fuse.join_topology(rows, _topology(s, d)).withColumnRenamed("line_id", "l_suppkey")


def _edge_join(canonical: bool):
    def f(s, d):
        return fuse.join_edge_features(_topology(s, d).select("line_id", "from_bus", "to_bus"), _graph(s, d).withColumn("feature", (F.col("src") * 100 + F.col("dst")).cast("double")), canonical=canonical)

    on = "src = least(from_bus, to_bus) AND dst = greatest(from_bus, to_bus)" if canonical else "src = from_bus AND dst = to_bus"
    f.__name__ = "edge_join_canonical" if canonical else "edge_join_directed"
    query(f"WITH e AS ({_EDGES}) SELECT line_id, from_bus, to_bus, (src * 100 + dst)::DOUBLE AS feature FROM ({_TOPOLOGY}) LEFT JOIN e ON {on}")(f)


_edge_join(True)
_edge_join(False)


@query(f"WITH a AS (SELECT user_id, date_trunc('day', ts)::TIMESTAMP AS d, avg(value) AS x FROM events GROUP BY 1, 2), b AS (SELECT user_id, date_trunc('day', ts)::TIMESTAMP AS d, max(value) AS y FROM events WHERE event_type = 'error' GROUP BY 1, 2), c AS (SELECT user_id, date_trunc('day', ts)::TIMESTAMP AS d, count(*) AS n FROM events GROUP BY 1, 2) SELECT a.user_id, strftime(a.d, '%Y-%m-%d') AS d, {_r('x', 'x')}, {_r('y', 'y')}, n FROM a LEFT JOIN b ON a.user_id = b.user_id AND a.d = b.d LEFT JOIN c ON a.user_id = c.user_id AND a.d = c.d")
def feature_fusion(s, d):
    e, keys = _events(s, d).withColumn("d", _day()), ["user_id", "d"]
    a = e.groupBy(*keys).agg(F.avg("value").alias("x"))
    b = e.where("event_type = 'error'").groupBy(*keys).agg(F.max("value").alias("y"), F.min("value").alias("x"))
    c = e.groupBy(*keys).agg(F.count("*").alias("n"))
    return _round(fuse.fuse(a, [b, c], keys).withColumn("d", F.date_format("d", "yyyy-MM-dd")))


def _injection(name: str, expression: str, run):
    def f(s, d):
        rows = _grid(s, d).where("x is not null").withColumn("y", F.col("x") + 1)
        out = run(inject.Injector("d", "user_id", "user_id"), rows, datetime(2024, 1, 5))
        return _round(out.select("user_id", F.date_format("d", "yyyy-MM-dd").alias("d"), "x", "y"))

    f.__name__ = f"inject_{name}"
    steps = 1 if name == "sensor_spike" else 3
    hit = f"user_id = 7 AND d >= TIMESTAMP '2024-01-05' AND d < TIMESTAMP '2024-01-05' + INTERVAL {steps} DAY"
    both = name in ("power_spike", "line_overload")
    query(f"SELECT user_id, strftime(d, '%Y-%m-%d') AS d, {_r(f'CASE WHEN {hit} THEN x {expression} ELSE x END', 'x')}, {_r(f'CASE WHEN {hit} THEN (x + 1) {expression} ELSE x + 1 END' if both else 'x + 1', 'y')} FROM ({DAILY})")(f)


_injection("voltage_deviation", "- 0.1", lambda i, rows, t: i.voltage_deviation(rows, 7, t, 3, 0.1, "x"))
_injection("power_spike", "* 1.5", lambda i, rows, t: i.power_spike(rows, 7, t, 3, 1.5, ("x", "y")))
_injection("sensor_spike", "+ 0.2", lambda i, rows, t: i.sensor_spike(rows, 7, t, 0.2, "x"))
_injection("line_overload", "* 1.4", lambda i, rows, t: i.line_overload(rows, 7, t, 3, 1.4, ("x", "y")))

_INCIDENTS = "ev AS (SELECT event_id, user_id, ts AS a, ts + INTERVAL 6 HOUR AS b, value FROM events WHERE event_type = 'error')"
_LABELLED = f"WITH {_INCIDENTS}, hit AS (SELECT e.event_id, e.user_id, e.ts, ev.event_id AS inc, ev.value AS sev, row_number() OVER (PARTITION BY e.event_id ORDER BY ev.event_id DESC) AS n FROM events e LEFT JOIN ev ON ev.user_id = e.user_id AND e.ts BETWEEN ev.a AND ev.b), lab AS (SELECT * FROM hit WHERE n = 1)"


def _labelled(s, d):
    e = _events(s, d)
    six = F.expr("INTERVAL 6 HOURS")
    events = e.where("event_type = 'error'").select("event_id", F.lit("error").alias("anomaly_type"), F.lit("user").alias("entity_type"), F.col("user_id").alias("entity_id"), F.col("ts").alias("start_timestamp"), (F.col("ts") + six).alias("end_timestamp"), F.col("value").alias("severity"), F.lit("value").alias("affected_measurement"))
    return labels.label(e, events, "user_id", "ts")


@query(_LABELLED + f" SELECT event_id, (inc IS NOT NULL)::INT AS is_anomaly, coalesce(inc, -1)::BIGINT AS anomaly_event_id, CASE WHEN inc IS NULL THEN 'normal' ELSE 'error' END AS anomaly_type, {_r('coalesce(sev, 0)', 'anomaly_severity')}, CASE WHEN inc IS NULL THEN '' ELSE 'value' END AS affected_measurement FROM lab")
def label_range_join(s, d):
    return _round(_labelled(s, d).drop("ts", "user_id", "value", "event_type"))


@query(_LABELLED + f" SELECT inc AS anomaly_event_id, 'error' AS anomaly_type, any_value(user_id) AS entity_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start_timestamp, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS end_timestamp, {_r('any_value(sev)', 'severity')}, 'value' AS affected_measurement, count(*) AS number_of_rows FROM lab WHERE inc IS NOT NULL GROUP BY 1")
def event_summary(s, d):
    return _round(labels.event_summary(_labelled(s, d), "user_id", "ts").withColumns({c: F.date_format(c, STAMP) for c in ("start_timestamp", "end_timestamp")}))


_RULES = quality.Rules("l_shipdate", "l_suppkey", ("l_quantity", "l_tax"), {"l_quantity": (2.0, 45.0), "l_tax": (0.0, None)}, None)


#: lineitem with faults: missing values, ids and numbers that are words, and infinities.
FAULTY = """SELECT CASE WHEN l_orderkey % 97 = 0 THEN NULL ELSE l_shipdate END AS l_shipdate, CASE WHEN l_orderkey % 89 = 0 THEN 'S-' || l_suppkey WHEN l_orderkey % 101 = 0 THEN NULL ELSE l_suppkey::VARCHAR END AS l_suppkey,
CASE WHEN l_orderkey % 83 = 0 THEN 'n/a' WHEN l_orderkey % 79 = 0 THEN 'Infinity' ELSE l_quantity::VARCHAR END AS l_quantity, CASE WHEN l_orderkey % 71 = 0 THEN NULL WHEN l_orderkey % 73 = 0 THEN '-Infinity'::DOUBLE WHEN l_orderkey % 67 = 0 THEN -l_tax ELSE l_tax END AS l_tax, nullif(l_returnflag, 'R') AS l_returnflag FROM lineitem"""


def _faulty(s, d):
    by = lambda n: F.col("l_orderkey") % n == 0
    text = lambda c: F.col(c).cast("string")
    return _t(s, d, "lineitem").select(
        F.when(~by(97), F.col("l_shipdate")).alias("l_shipdate"), F.when(by(89), F.concat(F.lit("S-"), text("l_suppkey"))).when(by(101), None).otherwise(text("l_suppkey")).alias("l_suppkey"),
        F.when(by(83), "n/a").when(by(79), "Infinity").otherwise(text("l_quantity")).alias("l_quantity"), F.when(by(71), None).when(by(73), float("-inf")).when(by(67), -F.col("l_tax")).otherwise(F.col("l_tax")).alias("l_tax"), F.nullif(F.col("l_returnflag"), F.lit("R")).alias("l_returnflag"),
    )


def _checks(name: str, prefix: str, sql: str):
    def f(s, d):
        row = quality.counts(_faulty(s, d), _RULES)
        parts = [F.struct(F.lit(c.split(":")[1]).alias("column"), F.col(f"`{c}`").alias("count")) for c in row.columns if c.startswith(prefix)]
        return row.select(F.explode(F.array(*parts)).alias("r")).select("r.*")

    f.__name__ = f"validate_{name}"
    query(f"WITH faulty AS ({FAULTY}) {sql}")(f)


_checks("missing", "missing", " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) FILTER ({c} IS NULL) AS count FROM faulty" for c in ("l_shipdate", "l_suppkey", "l_quantity", "l_tax", "l_returnflag")))
_checks("ranges", "range", "SELECT 'l_quantity' AS \"column\", count(*) FILTER (try_cast(l_quantity AS DOUBLE) < 2 OR try_cast(l_quantity AS DOUBLE) > 45) AS count FROM faulty UNION ALL SELECT 'l_tax', count(*) FILTER (l_tax < 0) FROM faulty")
_checks("numeric", "not_numeric", " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) FILTER ({c} IS NOT NULL AND try_cast({c} AS DOUBLE) IS NULL) AS count FROM faulty" for c in ("l_quantity", "l_tax")))
_checks("infinite", "infinite", " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) FILTER (isinf(try_cast({c} AS DOUBLE))) AS count FROM faulty" for c in ("l_quantity", "l_tax")))
_checks("ids", "id_", "SELECT 'l_suppkey' AS \"column\", count(*) FILTER (l_suppkey IS NULL) AS count FROM faulty UNION ALL SELECT 'l_suppkey', count(*) FILTER (l_suppkey IS NOT NULL AND try_cast(l_suppkey AS DOUBLE) IS NULL) FROM faulty")


@query("SELECT coalesce(sum(n), 0)::BIGINT AS count FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)")
def validate_duplicates(s, d):
    return quality.duplicates(_t(s, d, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("SELECT count(*) AS count FROM (SELECT lag(ts) OVER (ORDER BY event_id) > ts AS back FROM events) WHERE back")
def validate_timestamps(s, d):
    return quality.disorder(_events(s, d), quality.Rules("ts", "user_id", (), {}, "event_id"))


@query("SELECT count(*) AS count FROM (SELECT lag(ts) OVER (PARTITION BY user_id ORDER BY event_id) > ts AS back FROM events) WHERE back")
def validate_timestamps_by_entity(s, d):
    return quality.disorder(_events(s, d), quality.Rules("ts", "user_id", (), {}, "event_id"), per_entity=True)


@query(f"SELECT line_id, from_bus, to_bus, 'to_bus' AS missing_end FROM ({_TOPOLOGY}) WHERE to_bus NOT IN (SELECT n_nationkey FROM nation WHERE n_nationkey < 20) UNION ALL SELECT line_id, from_bus, to_bus, 'from_bus' FROM ({_TOPOLOGY}) WHERE from_bus NOT IN (SELECT n_nationkey FROM nation WHERE n_nationkey < 20)")
def referential_integrity(s, d):
    return quality.referential_integrity(_topology(s, d).drop("in_service"), _t(s, d, "nation").where("n_nationkey < 20"), ("from_bus", "to_bus"), "n_nationkey")


# --- correlations

_PAIRS = [(a, b) for i, a in enumerate(("l_quantity", "l_extendedprice", "l_discount", "l_tax")) for b in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")[i:]]
_NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query(" UNION ALL ".join(f"SELECT '{a}' AS feature_1, '{b}' AS feature_2, {_r(f'corr({a}, {b})', 'r')} FROM lineitem" for a, b in _PAIRS))
def pearson_matrix(s, d):
    return _round(correlation.pearson(_t(s, d, "lineitem"), _NUM))


@query("WITH k AS (SELECT " + ", ".join(f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0 AS {c}" for c in _NUM) + " FROM lineitem) " + " UNION ALL ".join(f"SELECT '{a}' AS feature_1, '{b}' AS feature_2, {_r(f'corr({a}::DOUBLE, {b}::DOUBLE)', 'r')} FROM k" for a, b in _PAIRS))
def spearman_matrix(s, d):
    return _round(correlation.spearman(_t(s, d, "lineitem"), _NUM))


@query(" UNION ALL ".join(f"SELECT l_suppkey, '{a}' AS feature_1, '{b}' AS feature_2, {_r(f'corr({a}, {b})', 'r')} FROM lineitem GROUP BY 1" for a, b in [("l_quantity", "l_quantity"), ("l_quantity", "l_tax"), ("l_tax", "l_tax")]))
def per_entity_pearson(s, d):
    return _round(correlation.pearson(_t(s, d, "lineitem"), ["l_quantity", "l_tax"], ["l_suppkey"]))


_CELLS = "SELECT date_trunc('day', ts)::TIMESTAMP AS t, user_id % 10 AS e, avg(value) AS x FROM events GROUP BY 1, 2"


@query(f"WITH c AS ({_CELLS}) SELECT a.e AS entity_1, b.e AS entity_2, {_r('corr(a.x, b.x)', 'r')} FROM c a JOIN c b ON a.t = b.t AND a.e <= b.e GROUP BY 1, 2")
def entity_correlation(s, d):
    return _round(correlation.entity_correlation(_events(s, d).withColumn("e", F.col("user_id") % 10).withColumn("t", _day()), "e", "t", "value"))


@query(f"WITH c AS (SELECT date_trunc('day', ts)::TIMESTAMP AS t, user_id AS e, avg(value) AS x FROM events GROUP BY 1, 2) SELECT a.e AS entity_1, b.e AS entity_2, {_r('corr(a.x, b.x)', 'r')} FROM c a JOIN c b ON a.t = b.t AND a.e <= b.e GROUP BY 1, 2")
def entity_correlation_users(s, d):
    """entity_correlation over the users themselves, not over ten groups of them. F.round would take most of the time."""
    out = correlation.entity_correlation(_events(s, d).withColumn("t", _day()), "user_id", "t", "value")
    return out.withColumn("r", F.rint(F.col("r") * 1e6) / 1e6 + 0.0)


@query("SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{a}' AS feature_1, '{b}' AS feature_2, {_r(f'corr({a}, {b})', 'r')} FROM lineitem" for a, b in _PAIRS if a != b) + ") ORDER BY abs(r) DESC LIMIT 2")
def strongest_pairs(s, d):
    return _round(correlation.strongest(correlation.pearson(_t(s, d, "lineitem"), _NUM), _NUM, 2))


# --- spectra


@query(f"WITH u AS (SELECT DISTINCT t FROM ({HOURS})), g AS (SELECT epoch(t - lag(t) OVER (ORDER BY t)) AS s FROM u) SELECT {_r('quantile_cont(s, 0.5)', 'interval_seconds')} FROM g WHERE s > 0")
def sampling_interval(s, d):
    return _round(spectral.sampling_interval(_hourly(s, d), "t"))


_DFT = f"WITH s AS (SELECT x - avg(x) OVER () AS v, row_number() OVER (ORDER BY t) - 1 AS i, count(*) OVER () AS n FROM ({SERIES})), b AS (SELECT n, k, sum(v * cos(2 * pi() * i * k / n)) AS re, sum(-v * sin(2 * pi() * i * k / n)) AS im FROM s, (SELECT unnest(range(16)) AS k) GROUP BY n, k), f AS (SELECT k::INT AS k, k / (n * 86400.0) AS hz, sqrt(re * re + im * im) * 2 / n * CASE WHEN k = 0 OR 2 * k = n THEN 0.5 ELSE 1 END AS amp FROM b)"


def _fft(s, d):
    return spectral.system_fft(_series(s, d), "value", "t", 86400.0)


@query(_DFT + f" SELECT k, {_r('hz * 1e6', 'frequency_uhz')}, {_r('hz * 3600', 'frequency_cph')}, {_r('CASE WHEN k > 0 THEN 1 / (hz * 3600) END', 'period_hours')}, {_r('amp', 'amplitude')} FROM f")
def fft_system(s, d):
    return _round(_fft(s, d).withColumn("frequency_uhz", F.col("frequency_hz") * 1e6).drop("frequency_hz"))


@query(_DFT + f" SELECT k, {_r('1 / (hz * 3600)', 'period_hours')}, {_r('amp', 'amplitude')}, {_r('(SELECT sum(amp * amp) FROM f)', 'energy')} FROM f WHERE k > 0 ORDER BY amp DESC, k LIMIT 1")
def dominant_frequency(s, d):
    return _round(spectral.dominant(_fft(s, d)).drop("frequency_hz"))


@query(_DFT + f" SELECT k, {_r('1 / (hz * 3600)', 'period_hours')}, {_r('amp', 'amplitude')} FROM f WHERE k > 0 AND 1 / (hz * 3600) BETWEEN 48 AND 240")
def period_spectrum(s, d):
    return _round(spectral.periods(_fft(s, d), 48.0, 240.0).select("k", "period_hours", "amplitude"))


_HANN = f"""WITH s AS (SELECT (x - avg(x) OVER ()) * (0.5 - 0.5 * cos(2 * pi() * (row_number() OVER (ORDER BY t) - 1) / (count(*) OVER () - 1))) AS v, row_number() OVER (ORDER BY t) - 1 AS i, count(*) OVER () AS n FROM ({SERIES})),
b AS (SELECT n, k, sum(v * cos(2 * pi() * i * k / n)) AS re, sum(-v * sin(2 * pi() * i * k / n)) AS im FROM s, (SELECT unnest(range(1, 16)) AS k) GROUP BY n, k), p AS (SELECT k, k / (n * 24.0) AS f, re * re + im * im AS p FROM b),
c AS (SELECT sum(f * p) / sum(p) AS c, sum(p) AS t, max(p) AS m FROM p), z AS (SELECT p.*, c.*, p / t AS q, lag(p) OVER (ORDER BY k) AS a, lead(p) OVER (ORDER BY k) AS b FROM p, c)"""


@query(_HANN + f" SELECT {_r('arg_max(f, p)', 'dominant_frequency_cph')}, {_r('1 / arg_max(f, p)', 'dominant_period_hours')}, {_r('max(p)', 'dominant_power', 3)}, {_r('sum(p)', 'total_spectral_energy', 3)}, {_r('max(c)', 'spectral_centroid_cph')}, {_r('sqrt(sum(p * (f - c) * (f - c)) / sum(p))', 'spectral_bandwidth_cph')}, {_r('sum(-q * ln(q)) / ln(count(*))', 'spectral_entropy')}, {_r('coalesce(sum(p) FILTER (f <= 0.01), 0)', 'low_frequency_energy', 3)}, {_r('coalesce(sum(p) FILTER (f >= 0.015), 0)', 'high_frequency_energy', 3)}, {_r('coalesce(sum(p) FILTER (f <= 0.01), 0) / sum(p)', 'low_frequency_energy_ratio')}, {_r('coalesce(sum(p) FILTER (f >= 0.015), 0) / sum(p)', 'high_frequency_energy_ratio')}, (count(*) FILTER (p > a AND p > b AND p >= 0.1 * m))::DOUBLE AS spectral_peak_count FROM z")
def spectral_features_window(s, d):
    out = spectral.series_features(_series(s, d), "value", "t", 86400.0, spectral.SpectralConfig(low_cph=0.01, high_cph=0.015))
    return _round(out.withColumns({c: F.round(c, 3) for c in ("dominant_power", "total_spectral_energy", "low_frequency_energy", "high_frequency_energy")}))


@query(_HANN + f" SELECT {_r('sum(-q * ln(q)) / ln(count(*))', 'spectral_entropy')} FROM z")
def spectral_entropy(s, d):
    return _round(spectral.series_features(_series(s, d), "value", "t", 86400.0).select("spectral_entropy"))


_ENERGIES = ("dominant_power", "total_spectral_energy", "low_frequency_energy", "high_frequency_energy")
_SPECTRA_SQL = f"""WITH e AS (SELECT event_id, user_id, ts, value AS v, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS i FROM events),
st AS (SELECT user_id, quantile_cont(g, 0.5) AS step FROM (SELECT user_id, epoch(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts)) AS g FROM (SELECT DISTINCT user_id, ts FROM events)) WHERE g > 0 GROUP BY 1),
w AS (SELECT a.event_id, any_value(step) AS step, list(b.v ORDER BY b.i) AS x, count(b.v) AS n, avg(b.v) AS m FROM e a JOIN e b ON b.user_id = a.user_id AND b.i BETWEEN a.i - 95 AND a.i JOIN st ON st.user_id = a.user_id GROUP BY 1 HAVING count(b.v) >= 32),
h AS (SELECT event_id, step, n, list_transform(x, lambda v, j: (v - m) * (0.5 - 0.5 * cos(2 * pi() * (j - 1) / (n - 1)))) AS x FROM w),
c AS (SELECT n, k, list_transform(range(0, n), lambda j: cos(2 * pi() * ((j * k) % n) / n)) AS c, list_transform(range(0, n), lambda j: sin(2 * pi() * ((j * k) % n) / n)) AS s FROM (SELECT n, unnest(range(1, n // 2 + 1)) AS k FROM (SELECT DISTINCT n FROM h))),
p AS (SELECT event_id, k, k * 3600 / (h.n * step) AS f, pow(list_dot_product(x, c), 2) + pow(list_dot_product(x, s), 2) AS p FROM h JOIN c ON c.n = h.n),
q AS (SELECT *, lag(p) OVER o AS a, lead(p) OVER o AS b, sum(p) OVER t AS total, max(p) OVER t AS most, sum(f * p) OVER t / sum(p) OVER t AS centre, sum(p) FILTER (p > 1e-12) OVER t AS live FROM p WINDOW o AS (PARTITION BY event_id ORDER BY k), t AS (PARTITION BY event_id)),
r AS (SELECT event_id, arg_max(f, p) AS f, max(p) AS p, any_value(total) AS total, any_value(centre) AS centre, sqrt(sum(p * pow(f - centre, 2)) / any_value(total)) AS spread,
  CASE WHEN count(*) FILTER (p > 1e-12) > 1 THEN -sum(p / live * ln(p / live)) FILTER (p > 1e-12) / ln(count(*) FILTER (p > 1e-12)) ELSE 0 END AS entropy,
  coalesce(sum(p) FILTER (f <= 1), 0) AS low, coalesce(sum(p) FILTER (f >= 2), 0) AS high, count(*) FILTER (p > a AND p > b AND p >= 0.1 * most) AS peaks FROM q WHERE total > 1e-12 GROUP BY 1)
SELECT e.event_id, """ + ", ".join(_r(x, f"value_{c}", 1 if c in _ENERGIES else 6) for c, x in zip(spectral.FEATURES, ("r.f * (1 + 1e-9)", "(1 + 1e-9) / r.f", "r.p", "total", "centre", "spread", "entropy", "low", "high", "low / total", "high / total", "peaks"))) + " FROM e LEFT JOIN r ON r.event_id = e.event_id"


@query(_SPECTRA_SQL)
def rolling_spectral_features(s, d):
    rows = _events(s, d)
    out = spectral.rolling_features(rows, "value", ["user_id"], "ts").drop("ts", "user_id", "value", "event_type")
    # a hair off, as in the SQL: quotients of whole seconds can lie halfway between two roundings
    off = {f"value_{c}": F.col(f"value_{c}") * (1 + 1e-9) for c in spectral.FEATURES[:2]}
    return _round(out.withColumns({**off, **{f"value_{c}": F.round(f"value_{c}", 1) for c in _ENERGIES}}))


# --- generators and models

_TIMES = "t AS (SELECT TIMESTAMP '2026-01-01' + INTERVAL 15 MINUTE * i AS ts, ((15 * i) % 1440) / 60.0 AS h FROM (SELECT unnest(range(96)) AS i))"
_LOAD = "ld AS (SELECT ts, greatest(0.72 + 0.20 * exp(-0.5 * ((h - 8) / 2) * ((h - 8) / 2)) + 0.35 * exp(-0.5 * ((h - 19) / 3) * ((h - 19) / 3)) + 0.08 * exp(-0.5 * ((h - 13) / 4) * ((h - 13) / 4)), 0.1) AS raw FROM t)"
_SUN = "sl AS (SELECT ts, CASE WHEN h >= 6 AND h <= 18 THEN pow(greatest(sin(pi() * (h - 6) / 12), 0), 1.5) ELSE 0 END AS pu FROM t)"


def _times(s):
    return generate.time_grid(s, "2026-01-01 00:00:00", 96)


@query(f"WITH {_TIMES}, {_LOAD} SELECT strftime(ts, '%Y-%m-%d %H:%M:%S') AS timestamp, {_r('raw / (SELECT max(raw) FROM ld)', 'load_mw')}, {_r('raw / (SELECT max(raw) FROM ld)', 'load_pu')} FROM ld")
def load_profile(s, d):
    return _round(generate.load_profile(_times(s)).withColumn("timestamp", F.date_format("timestamp", STAMP)))


@query(f"WITH {_TIMES}, {_SUN} SELECT strftime(ts, '%Y-%m-%d %H:%M:%S') AS timestamp, {_r('pu', 'solar_mw')}, {_r('pu', 'solar_pu')} FROM sl")
def solar_profile(s, d):
    return _round(generate.solar_profile(_times(s)).withColumn("timestamp", F.date_format("timestamp", STAMP)))


@query(f"WITH {_TIMES}, {_LOAD}, {_SUN} SELECT strftime(ld.ts, '%Y-%m-%d %H:%M:%S') AS timestamp, {_r('raw / (SELECT max(raw) FROM ld)', 'load_mw')}, {_r('raw / (SELECT max(raw) FROM ld)', 'load_pu')}, {_r('pu', 'solar_mw')}, {_r('pu', 'solar_pu')} FROM ld JOIN sl ON ld.ts = sl.ts")
def profiles_join(s, d):
    return _round(generate.profiles(_times(s)).withColumn("timestamp", F.date_format("timestamp", STAMP)))


@query()
def isolation_forest_scores(s, d):
    rows = _t(s, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", *_NUM)
    model = forest.fit(rows.where(_TRAIN), _NUM, ["l_orderkey", "l_partkey", "l_suppkey"])
    return _round(model.score(rows).drop(*_NUM))


_JACOBI = "WITH RECURSIVE c AS (SELECT [" + ", ".join("1.0::DOUBLE" if a == b else f"corr({a}, {b})" for a in _NUM for b in _NUM) + """] AS m FROM lineitem),
it(k, m) AS (SELECT 0, m FROM c UNION ALL SELECT k + 1, list_transform(range(0, 16), lambda o: list_sum(list_transform(range(0, 16), lambda e: g[(e // 4) * 4 + o // 4 + 1] * m[e + 1] * g[(e % 4) * 4 + o % 4 + 1]))) FROM (
  SELECT k, m, list_transform(range(0, 16), lambda e: CASE WHEN e // 4 = p AND e % 4 = p OR e // 4 = q AND e % 4 = q THEN c WHEN e // 4 = p AND e % 4 = q THEN c * t WHEN e // 4 = q AND e % 4 = p THEN -c * t WHEN e // 4 = e % 4 THEN 1.0 ELSE 0.0 END) AS g FROM (
  SELECT *, 1 / sqrt(t * t + 1) AS c FROM (SELECT *, CASE WHEN abs(x) < 1e-15 THEN 0.0 ELSE (CASE WHEN y >= 0 THEN 1 ELSE -1 END) / (abs(y) + sqrt(y * y + 1)) END AS t FROM (
  SELECT *, CASE WHEN abs(x) < 1e-15 THEN 0.0 ELSE (m[q * 5 + 1] - m[p * 5 + 1]) / (2 * x) END AS y FROM (SELECT *, m[p * 4 + q + 1] AS x FROM (SELECT k, m, [0, 0, 0, 1, 1, 2][k % 6 + 1] AS p, [1, 2, 3, 2, 3, 3][k % 6 + 1] AS q FROM it WHERE k < 60)))))))"""


@query(_JACOBI + f" SELECT row_number() OVER (ORDER BY v DESC)::INT AS component, {_r('v / 4', 'explained_variance_ratio')}, {_r('sum(v) OVER (ORDER BY v DESC) / 4', 'cumulative')} FROM (SELECT unnest([m[1], m[6], m[11], m[16]]) AS v FROM it WHERE k = 60)")
def pca_explained(s, d):
    return _round(dimensionality.explained(_t(s, d, "lineitem"), _NUM))


@query()
def tsne_embedding(s, d):
    return dimensionality.tsne(_t(s, d, "supplier").select("s_suppkey", "s_acctbal", F.col("s_nationkey").cast("double").alias("k")), ["s_acctbal", "k"], ["s_suppkey"])


FEEDER = generate.Network([(0, 0, 1, 0.1, 0.05, 0.4), (1, 1, 2, 0.5, 0.25, 0.4), (2, 2, 3, 0.4, 0.2, 0.3), (3, 1, 4, 0.2, 0.2, 0.3)], {1: (0.1, 0.06), 2: (0.09, 0.04), 3: (0.12, 0.08), 4: (0.06, 0.03)}).with_solar(3, 0.05)
BENCHMARK = generate.benchmark_network().with_solar(17, 0.5)


def _flow_sql(net: generate.Network, rounds: int = 60) -> str:
    """A radial network whose lines point away from bus 0: impedances by common path, then V = 1 - Z conj(S / V) again and again."""
    lines = ", ".join(f"({x[0]}, {x[1]}, {x[2]}, {x[3] / net.kv**2!r}::DOUBLE, {x[4] / net.kv**2!r}::DOUBLE)" for x in net.in_service)
    buses = ", ".join(f"({i}, {b}, {net.loads.get(b, (0.0, 0.0))[0]!r}::DOUBLE, {net.loads.get(b, (0.0, 0.0))[1]!r}::DOUBLE, {net.solar_mw if b == net.solar_bus else 0.0!r}::DOUBLE)" for i, b in enumerate(net.buses[1:], 1))
    return f"""WITH RECURSIVE {_TIMES}, {_LOAD}, {_SUN}, prof AS (SELECT ld.ts, raw / (SELECT max(raw) FROM ld) AS lp, pu AS sp FROM ld JOIN sl ON sl.ts = ld.ts),
ln(line_id, a, b, r, x) AS (VALUES {lines}), bus(i, b, p, q, solar) AS (VALUES {buses}),
up(bus, node) AS (SELECT b, b FROM ln UNION ALL SELECT up.bus, ln.a FROM up JOIN ln ON ln.b = up.node WHERE ln.a <> 0),
c AS (SELECT u.bus AS bi, w.bus AS bj, sum(r) AS r, sum(x) AS x FROM up u JOIN up w ON u.node = w.node JOIN ln ON ln.b = u.node GROUP BY 1, 2),
z AS (SELECT list(zr ORDER BY i) AS zr, list(zx ORDER BY i) AS zx FROM (SELECT p.i, list(coalesce(c.r, 0) ORDER BY q.i) AS zr, list(coalesce(c.x, 0) ORDER BY q.i) AS zx FROM bus p CROSS JOIN bus q LEFT JOIN c ON c.bi = p.b AND c.bj = q.b GROUP BY 1)),
s AS (SELECT ts, list(p * lp - solar * sp ORDER BY i) AS p, list(q * lp ORDER BY i) AS q FROM bus, prof GROUP BY 1),
it(ts, k, re, im) AS (SELECT ts, 0, list_transform(p, lambda v: 1.0::DOUBLE), list_transform(p, lambda v: 0.0::DOUBLE) FROM s UNION ALL
  SELECT ts, k + 1, list_transform(zr, lambda row, i: 1 - list_dot_product(row, cr) + list_dot_product(zx[i], ci)), list_transform(zr, lambda row, i: -list_dot_product(row, ci) - list_dot_product(zx[i], cr)) FROM (
  SELECT it.ts, k, list_transform(re, lambda v, j: (p[j] * v + q[j] * im[j]) / (v * v + im[j] * im[j])) AS cr, list_transform(re, lambda v, j: (p[j] * im[j] - q[j] * v) / (v * v + im[j] * im[j])) AS ci FROM it JOIN s ON s.ts = it.ts WHERE k < {rounds}), z),
v AS (SELECT it.ts, re, im, p, q FROM it JOIN s ON s.ts = it.ts WHERE k = {rounds}),
out AS (SELECT ts, bus.b AS bus_id, sqrt(re[i] * re[i] + im[i] * im[i]) AS u, degrees(atan2(im[i], re[i])) AS a, v.p[i] AS p, v.q[i] AS q FROM v, bus
  UNION ALL SELECT ts, 0, 1.0, 0.0, -list_sum(list_transform(re, lambda x, j: (p[j] * x + q[j] * im[j]) / (x * x + im[j] * im[j]))), list_sum(list_transform(re, lambda x, j: (p[j] * im[j] - q[j] * x) / (x * x + im[j] * im[j]))) FROM v)
SELECT strftime(ts, '%Y-%m-%d %H:%M:%S') AS timestamp, bus_id::INT AS bus_id, {_r('u', 'voltage_pu')}, {_r('a', 'angle_deg')}, {_r('p', 'active_power_mw')}, {_r('q', 'reactive_power_mvar')} FROM out"""


def _flow(s, net):
    return _round(generate.power_flow(generate.profiles(_times(s)), net)[0].withColumn("timestamp", F.date_format("timestamp", STAMP)))


@query(_flow_sql(FEEDER))
def power_flow(s, d):
    return _flow(s, FEEDER)


@query(_flow_sql(BENCHMARK))
def benchmark_power_flow(s, d):
    """The 33-bus feeder with a solar plant at bus 17."""
    return _flow(s, BENCHMARK)


@query()
def anomaly_scenario(s, d):
    """The events of the scripted evening on the benchmark network's measurements, and how many rows each changes."""
    bus, line = generate.power_flow(generate.profiles(_times(s)), BENCHMARK)
    changed_bus, changed_line, events = inject.scenario(bus, line, datetime(2026, 1, 1))
    marked = [labels.label(rows, labels.check_events(events), entity, "timestamp", kind) for rows, entity, kind in ((changed_bus, "bus_id", "bus"), (changed_line, "line_id", "line"))]
    hit = marked[0].select("anomaly_event_id", "is_anomaly").union(marked[1].select("anomaly_event_id", "is_anomaly")).where("is_anomaly = 1").groupBy("anomaly_event_id").agg(F.count("*").alias("number_of_rows"))
    stamps = {c: F.date_format(c, STAMP) for c in ("start_timestamp", "end_timestamp")}
    return _round(events.join(hit, events["event_id"] == hit["anomaly_event_id"], "left").drop("anomaly_event_id").withColumns(stamps))
