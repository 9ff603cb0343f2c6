"""Queries over hourly series."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.operators import timeseries as ts
from quern.plans.registry import query

ORIGIN = "2024-01-01 00:00:00"
KEYS = ["user_id", "event_type"]
BASE = """WITH e AS (SELECT *, floor((epoch(ts) - epoch(TIMESTAMP '2024-01-01')) / 3600)::INTEGER AS hour FROM events),
h AS (SELECT user_id, event_type, hour, avg(value) AS value FROM e WHERE value IS NOT NULL GROUP BY ALL),
k AS (SELECT DISTINCT user_id, event_type FROM h),
grid AS (SELECT k.user_id, k.event_type, g.hour, h.value FROM k CROSS JOIN (SELECT unnest(range(48))::INTEGER AS hour) g LEFT JOIN h USING (user_id, event_type, hour)),
f AS (SELECT user_id, event_type, hour, coalesce(last_value(value IGNORE NULLS) OVER (PARTITION BY user_id, event_type ORDER BY hour ROWS UNBOUNDED PRECEDING), 0.0) AS value FROM grid)
"""


def events(spark, d):
    return ts.with_hour(spark.read.parquet(f"{d}/events.parquet"), ORIGIN)


def series(spark, d):
    return ts.hourly(events(spark, d), KEYS, "value")


def filled(spark, d):
    return ts.locf(ts.dense_grid(series(spark, d), KEYS, 48), KEYS)


def rounded(df, *names):
    return df.withColumns({n: F.round(n, 6) for n in names})


@query(BASE + "SELECT user_id, event_type, hour, round(value, 6) AS value FROM h")
def hourly_mean(spark, d):
    return rounded(series(spark, d), "value")


@query(BASE + "SELECT user_id, event_type, hour, arg_min(value, (ts, event_id)) AS value FROM e WHERE value IS NOT NULL GROUP BY ALL")
def hourly_first(spark, d):
    return ts.hourly_first(events(spark, d), KEYS, "value", ["ts", "event_id"])


@query(BASE + "SELECT user_id, event_type, hour, arg_max(value, (ts, event_id)) AS value FROM e WHERE value IS NOT NULL GROUP BY ALL")
def hourly_last(spark, d):
    return ts.hourly_last(events(spark, d), KEYS, "value", ["ts", "event_id"])


@query(BASE + "SELECT user_id, event_type, hour, round(value, 6) AS value FROM f")
def locf(spark, d):
    return rounded(filled(spark, d), "value")


@query(BASE + """SELECT user_id, event_type, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, round(min(value), 6) AS min, round(max(value), 6) AS max,
  round(quantile_cont(value, 0.5), 6) AS median, round(count(value) / 48, 6) AS availability FROM f GROUP BY ALL""")
def series_stats(spark, d):
    return rounded(ts.series_stats(filled(spark, d), KEYS), "mean", "std", "min", "max", "median", "availability")


@query(BASE + """SELECT user_id, event_type, hour, round(CASE WHEN max(value) OVER w > min(value) OVER w THEN (value - min(value) OVER w) / (max(value) OVER w - min(value) OVER w) ELSE 0.0 END, 6) AS value
  FROM h WINDOW w AS (PARTITION BY user_id, event_type)""")
def minmax_norm(spark, d):
    return rounded(ts.minmax(series(spark, d), KEYS), "value")


@query(BASE + "SELECT user_id, event_type, (hour - 300 - least(min(hour - 300) OVER (PARTITION BY user_id, event_type), 0))::INTEGER AS hour, round(value, 6) AS value FROM h")
def shift_negative(spark, d):
    return rounded(ts.shift_negative(series(spark, d).withColumn("hour", F.col("hour") - 300), KEYS), "value")


@query("SELECT event_type, n, round(100.0 * n / sum(n) OVER (), 6) AS pct, (SELECT count(DISTINCT event_type) FROM events) AS items FROM (SELECT event_type, count(*) AS n FROM events GROUP BY 1) ORDER BY n DESC, event_type LIMIT 3")
def top_items(spark, d):
    counts = events(spark, d).groupBy("event_type").agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("n"), F.count("*").alias("k"))
    whole = counts.select("event_type", "n", (100 * F.col("n") / total.select("n").scalar()).alias("pct"), total.select("k").scalar().alias("items"))
    return rounded(whole.orderBy(F.desc("n"), "event_type").limit(3), "pct")


@query(BASE + """SELECT event_type, count(*) AS entities FROM (SELECT user_id, event_type FROM h GROUP BY ALL HAVING count(*) >= 10) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 50""")
def frequent_items_two_level(spark, d):
    often = events(spark, d).filter("value IS NOT NULL").groupBy(*KEYS).agg(F.countDistinct("hour").alias("h")).filter("h >= 10")
    return often.groupBy("event_type").agg(F.count("*").alias("entities")).orderBy(F.desc("entities"), "event_type").limit(50)


@query(BASE + "SELECT user_id, count(DISTINCT hour) AS hours FROM e GROUP BY 1 HAVING count(DISTINCT hour) >= 24")
def coverage_having(spark, d):
    return events(spark, d).groupBy("user_id").agg(F.countDistinct("hour").alias("hours")).filter("hours >= 24")


@query(BASE + "SELECT user_id, round(count(value) / (count(DISTINCT event_type) * 48), 6) AS density FROM grid GROUP BY 1")
def density(spark, d):
    return rounded(ts.density(ts.dense_grid(series(spark, d), KEYS, 48), "user_id", "event_type", 48), "density")


@query("SELECT user_id, arg_min(event_type, (-n, event_type)) AS mode, max(n) AS n FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL) GROUP BY 1")
def mode_per_entity(spark, d):
    return ts.mode(events(spark, d), ["user_id"], "event_type")


@query(BASE + "SELECT user_id, event_type, hour, round(value, 6) AS value FROM h WHERE hour < 48")
def first_n_hours(spark, d):
    return rounded(series(spark, d).filter("hour < 48"), "value")


@query(BASE + "SELECT user_id, event_type, hour, round(value, 6) AS value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY hour DESC) AS r FROM h) WHERE r <= 3")
def last_k_readings(spark, d):
    return rounded(ts.last_k(series(spark, d), KEYS, 3), "value")


@query(BASE + "SELECT user_id, event_type, string_agg(value::BIGINT::VARCHAR || ' at hour ' || (hour + 1)::VARCHAR, ', ' ORDER BY hour) AS text FROM (SELECT user_id, event_type, hour, floor(value) AS value FROM h) GROUP BY ALL")
def temporal_text(spark, d):
    return ts.temporal_text(series(spark, d), KEYS, F.floor("value"))


@query(BASE + """SELECT user_id, event_type, count(*) AS n, sum(floor(value))::DOUBLE AS total FROM h GROUP BY ALL""")
def parse_temporal(spark, d):
    numbers = ts.parse_temporal(F.concat("text", F.lit(", None at hour 99")))
    return ts.temporal_text(series(spark, d), KEYS, F.floor("value")).select(*KEYS, F.size(numbers).cast("long").alias("n"), F.aggregate(numbers, F.lit(0.0), lambda a, x: a + x).alias("total"))


@query("""SELECT event_id, CASE lower(trim('  ' || event_type || ' ')) WHEN 'view' THEN 1.0 WHEN 'click' THEN 2.0 WHEN 'purchase' THEN 3.0 END::DOUBLE AS loose, CASE event_type WHEN 'View' THEN 1.0 WHEN 'click' THEN 2.0 WHEN 'purchase' THEN 3.0 END::DOUBLE AS exact FROM events""")
def ordinal_map(spark, d):
    text = F.concat(F.lit("  "), "event_type", F.lit(" "))
    return events(spark, d).select("event_id", ts.ordinal(text, {"View": 1, "click": 2, "purchase": 3}).alias("loose"), ts.ordinal(F.col("event_type"), {"View": 1, "click": 2, "purchase": 3}, exact=True).alias("exact"))


@query("""WITH m AS (SELECT user_id, event_type, avg(value) AS mean FROM events GROUP BY ALL),
f AS (SELECT user_id, CASE WHEN event_type = 'view' AND mean > 50 THEN 'high view' WHEN event_type = 'click' AND mean < 45 THEN 'low click' WHEN event_type = 'purchase' AND mean > 52 THEN 'high purchase' END AS flag FROM m)
SELECT user_id, coalesce(string_agg(DISTINCT flag, ',' ORDER BY flag), '') AS flags FROM f GROUP BY 1""")
def threshold_flags(spark, d):
    means = events(spark, d).groupBy(*KEYS).agg(F.avg("value").alias("mean"))
    rules = [("view", "high view", ">", 50.0), ("click", "low click", "<", 45.0), ("purchase", "high purchase", ">", 52.0)]
    return ts.flags(means, rules, "event_type", "user_id")


@query("SELECT event_id, date_trunc('hour', ts)::TIMESTAMP AS hour FROM events")
def truncate_hour(spark, d):
    return events(spark, d).select("event_id", F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour"))


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN NULL ELSE value END AS value FROM events")
def safe_cast(spark, d):
    dirty = F.when(F.col("event_id") % 3 == 0, F.lit("abc")).otherwise(F.col("value").cast("string"))
    return events(spark, d).select("event_id", dirty.try_cast("double").alias("value"))


@query("SELECT event_id, (props->>'$.k')::BIGINT AS k FROM events")
def json_props(spark, d):
    return events(spark, d).select("event_id", F.get_json_object("props", "$.k").try_cast("long").alias("k"))


@query(BASE + """, u AS (SELECT user_id, least(max(hour) + 1, 48)::INTEGER AS n FROM h GROUP BY 1 HAVING least(max(hour) + 1, 48) > 0)
SELECT k.user_id, k.event_type, g.hour, round(h.value, 6) AS value FROM k JOIN u USING (user_id) JOIN (SELECT unnest(range(48))::INTEGER AS hour) g ON g.hour < u.n LEFT JOIN h USING (user_id, event_type, hour)""")
def hourly_capped(spark, d):
    return rounded(ts.capped_grid(series(spark, d), "user_id", KEYS, 48), "value")


@query(BASE + """, a AS (SELECT user_id, event_type, list(value ORDER BY hour) AS v FROM h GROUP BY ALL)
SELECT user_id, event_type, greatest(len(v), 3)::INTEGER AS n, round(v[-1], 6) AS last, round(list_sum(v) + greatest(3 - len(v), 0) * v[-1], 6) AS total FROM a""")
def padded_series(spark, d):
    v = F.transform(F.sort_array(F.collect_list(F.struct("hour", "value"))), lambda x: x["value"])
    a = series(spark, d).groupBy(*KEYS).agg(v.alias("v")).withColumn("v", ts.padded(F.col("v")))
    out = a.select(*KEYS, F.size("v").alias("n"), F.element_at("v", -1).alias("last"), F.aggregate("v", F.lit(0.0), lambda s, x: s + x).alias("total"))
    return rounded(out, "last", "total")
