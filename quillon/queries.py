"""Registered queries of the core and their SQL, by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon import queries_functions, queries_models, queries_more, queries_tables, queries_training  # noqa: F401
from quillon.operators import nested_xml, reject_rows, rolling, spatial, spikes
from quillon.registry import QUERIES, SQL, query
from quillon.session import folded, materialise, scratch, table

__all__ = ["QUERIES", "SQL"]

# --- 1 rows that fail to parse -------------------------------------------------------------------

_LINES = """
WITH l AS (SELECT line_id, feed, CASE WHEN line_text LIKE '%' || chr(13) THEN left(line_text, length(line_text) - 1) ELSE line_text END AS t FROM raw_lines),
b AS (SELECT line_id, feed, CASE WHEN starts_with(t, chr(65279)) THEN substr(t, 2) ELSE t END AS t FROM l),
k AS (SELECT line_id, feed, t, regexp_full_match(t, '(?s)(?:"(?:[^"]|"")*"|[^"\t]*)(?:\t(?:"(?:[^"]|"")*"|[^"\t]*))*') AS sound FROM b
      WHERE NOT regexp_full_match(t, ' *') AND NOT (feed = 'test_data' AND t = 'sensor' || chr(9) || 'volume') AND NOT (feed = 'wtraining_converted' AND t = concat_ws(chr(9), 'Count', 'Date', 'Color', 'Automaker'))),
f AS (SELECT line_id, feed, sound, list_transform(regexp_extract_all(t || chr(9), '(?s)("(?:[^"]|"")*"|[^"\t]*)\t', 1), lambda x: trim(CASE WHEN x LIKE '"%' THEN replace(substr(x, 2, length(x) - 2), '""', '"') ELSE x END, ' ')) AS c FROM k),
g AS (SELECT line_id, feed, c, CASE WHEN NOT sound THEN 'quoting' WHEN len(c) <> CASE feed WHEN 'test_data' THEN 2 ELSE 4 END THEN 'columns'
  WHEN feed = 'test_data' AND NOT regexp_full_match(c[2], '[0-9]{0,9}') THEN 'value'
  WHEN feed <> 'test_data' AND (NOT regexp_full_match(c[1], '[0-9]{0,9}') OR NOT (c[2] = '' OR (regexp_full_match(c[2], '[0-9]{4}-[0-9]{2}-[0-9]{2}') AND try_cast(c[2] AS DATE) IS NOT NULL))) THEN 'value' END AS reason FROM f)
"""


def _parsed(spark: SparkSession, d: str) -> DataFrame:
    return reject_rows.split_lines(table(spark, d, "raw_lines"))


@query("p1_found", _LINES + "SELECT DISTINCT line_id, reason FROM g WHERE reason IS NOT NULL")
def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return reject_rows.rejects(_parsed(spark, d))


@query("p1_sound_counts", _LINES + "SELECT DISTINCT line_id, try_cast(nullif(c[1], '') AS BIGINT) AS \"count\", try_cast(nullif(c[2], '') AS DATE) AS \"date\", c[3] AS color, c[4] AS automaker FROM g WHERE reason IS NULL AND feed = 'wtraining_converted'")
def p1_sound_counts(spark: SparkSession, d: str) -> DataFrame:
    rows = reject_rows.sound_rows(_parsed(spark, d), reject_rows.FEEDS[1])
    return rows.withColumns({c: F.trim(F.col(c)) for c in ("color", "automaker")})


@query("p1_sound_volumes", _LINES + "SELECT DISTINCT line_id, c[1] AS sensor, try_cast(nullif(c[2], '') AS BIGINT) AS volume FROM g WHERE reason IS NULL AND feed = 'test_data'")
def p1_sound_volumes(spark: SparkSession, d: str) -> DataFrame:
    return reject_rows.sound_rows(_parsed(spark, d), reject_rows.FEEDS[0]).withColumn("sensor", F.trim("sensor"))


# --- 2 points near points, points in regions --------------------------------------------------------

_POINTS = """
WITH u AS (SELECT record_id AS id, arg_min(struct_pack(lat, longitude, range_km), zulutime) AS p FROM signal_events
  WHERE lat IS NOT NULL AND longitude IS NOT NULL AND abs(lat) <= 90 AND longitude >= -180 AND longitude < 360 AND NOT (lat = 0 AND longitude = 0) GROUP BY 1),
p AS (SELECT id, p.lat AS lat, CASE WHEN p.longitude >= 180 THEN p.longitude - 360 ELSE p.longitude END AS lon, p.range_km AS r FROM u),
"""
_NEAR = """
n AS (SELECT * FROM p WHERE r > 0),
s AS (SELECT *, CAST(floor(lat * 4) AS INTEGER) AS b FROM n),
m AS (SELECT max(r) AS m FROM n),
near AS (SELECT 'near' AS found_kind, x.id AS left_id, y.id AS right_id FROM s x JOIN (SELECT s.*, unnest([b - 1, b, b + 1]) AS bb FROM s) y ON x.b = y.bb AND x.id < y.id
  WHERE (SELECT m FROM m) < 27 AND abs(x.lat - y.lat) * 111.19 <= least(x.r, y.r) + 0.01 AND 2 * 6371.0088 * asin(sqrt(least(1, pow(sin(radians(y.lat - x.lat) / 2), 2) + cos(radians(x.lat)) * cos(radians(y.lat)) * pow(sin(radians(y.lon - x.lon) / 2), 2)))) <= least(x.r, y.r)),
"""
_INSIDE = """
rings AS (SELECT region_id, generate_subscripts(rr, 1) AS ring, unnest(rr) AS body FROM (SELECT region_id, regexp_extract_all(boundary, '\\(([^()]+)\\)', 1) AS rr FROM aoi_regions)),
pts AS (SELECT region_id, ring, list_transform(string_split(body, ','), lambda t: struct_pack(x := CAST(string_split(trim(t), ' ')[1] AS DOUBLE), y := CAST(string_split(trim(t), ' ')[2] AS DOUBLE))) AS q FROM rings),
edges AS (SELECT region_id, q[i].x AS x1, q[i].y AS y1, q[i + 1].x AS x2, q[i + 1].y AS y2 FROM (SELECT region_id, q, unnest(range(1, len(q))) AS i FROM pts)),
box AS (SELECT region_id, min(least(x1, x2)) AS w, max(greatest(x1, x2)) AS e, min(least(y1, y2)) AS s, max(greatest(y1, y2)) AS n FROM edges GROUP BY 1),
cand AS (SELECT p.id, b.region_id, p.lat, p.lon + t.t AS lon FROM p, (SELECT unnest([-360, 0, 360]) AS t) t, box b WHERE p.lat BETWEEN b.s AND b.n AND p.lon + t.t BETWEEN b.w AND b.e),
inside AS (SELECT DISTINCT 'inside' AS found_kind, id AS left_id, region_id AS right_id FROM (SELECT c.id, c.region_id, c.lon FROM cand c JOIN edges e ON c.region_id = e.region_id AND (e.y1 > c.lat) <> (e.y2 > c.lat) AND c.lon < e.x1 + (e.x2 - e.x1) * ((c.lat - e.y1) / (e.y2 - e.y1)) GROUP BY ALL HAVING count(*) % 2 = 1))
"""


def _points(spark: SparkSession, d: str) -> DataFrame:
    return spatial.usable_points(table(spark, d, "signal_events"))


@query("p2_found", _POINTS + _NEAR + _INSIDE + "SELECT * FROM near UNION ALL SELECT * FROM inside")
def p2_found(spark: SparkSession, d: str) -> DataFrame:
    # Used three times: the ids are settled once.
    points = materialise(_points(spark, d), "points")
    near = spatial.near_pairs(points).select(F.lit("near").alias("found_kind"), "left_id", "right_id")
    inside = spatial.inside_regions(points, table(spark, d, "aoi_regions"))
    return near.unionByName(inside.select(F.lit("inside").alias("found_kind"), F.col("id").alias("left_id"), F.col("region").alias("right_id")))


@query("p2_inside", _POINTS + _INSIDE + "SELECT left_id AS id, right_id AS region FROM inside")
def p2_inside(spark: SparkSession, d: str) -> DataFrame:
    return spatial.inside_regions(_points(spark, d), table(spark, d, "aoi_regions"))


# --- 3 implausible readings --------------------------------------------------------------------------


@query("p3_found")
def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return spikes.faulty_readings(table(spark, d, "test_data")).select("reading_id", "fault")


_HARD = """
WITH o AS (SELECT reading_id, arg_min(struct_pack(sensor, volume, lanes, period_s, read_at), arrived_at) AS r FROM test_data GROUP BY 1),
s AS (SELECT reading_id, lower(trim(r.sensor, ' ' || chr(9) || chr(10) || chr(13))) AS sensor, r.volume AS v, r.lanes * r.period_s AS most, r.read_at AS t FROM o WHERE r.volume IS NOT NULL AND r.read_at IS NOT NULL),
b AS (SELECT *, CASE WHEN v = lag(v) OVER (PARTITION BY sensor ORDER BY t, reading_id) THEN 0 ELSE 1 END AS n FROM s),
g AS (SELECT *, sum(n) OVER (PARTITION BY sensor ORDER BY t, reading_id ROWS UNBOUNDED PRECEDING) AS run FROM b),
c AS (SELECT *, count(*) OVER (PARTITION BY sensor, run) AS k FROM g)
SELECT reading_id, CASE WHEN v < 0 OR v > most THEN 'impossible' ELSE 'stuck' END AS fault FROM c WHERE v < 0 OR v > most OR k >= 8
"""


@query("p3_hard_faults", _HARD)
def p3_hard_faults(spark: SparkSession, d: str) -> DataFrame:
    """The faults that SQL can tell as well: all but spikes."""
    return p3_found(spark, d).where("fault <> 'spike'")


# --- 4 rolling totals -----------------------------------------------------------------------------------

_ROLLED = """
WITH o AS (SELECT arg_min(struct_pack(automaker, sale_date, cnt), recorded_at) AS r FROM wtraining_converted GROUP BY row_id),
t AS (SELECT lower(trim(r.automaker, ' ' || chr(9) || chr(10) || chr(13))) AS automaker, r.sale_date AS day, sum(coalesce(r.cnt, 0)) AS total, count(r.cnt) AS n FROM o WHERE r.sale_date IS NOT NULL AND r.automaker IS NOT NULL GROUP BY 1, 2),
c AS (SELECT automaker, unnest(generate_series(min(day), max(day), INTERVAL 1 DAY))::DATE AS day FROM t GROUP BY 1),
f AS (SELECT c.automaker, c.day, coalesce(t.total, 0) AS total, coalesce(t.n, 0) AS n, row_number() OVER (PARTITION BY c.automaker ORDER BY c.day) AS day_no FROM c LEFT JOIN t USING (automaker, day)),
w AS (SELECT automaker, day, day_no, total, sum(total) OVER s7 AS total_7, sum(n) OVER s7 AS amounts_7, sum(total) OVER s30 AS total_30, sum(n) OVER s30 AS amounts_30 FROM f
  WINDOW s7 AS (PARTITION BY automaker ORDER BY day ROWS 6 PRECEDING), s30 AS (PARTITION BY automaker ORDER BY day ROWS 29 PRECEDING))
"""


def _rolled(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "wtraining_converted")
    daily = rolling.daily_totals(rows, folded(F.col("automaker")), F.col("sale_date"), F.col("cnt"), F.col("row_id"), F.col("recorded_at"))
    # Calendar and totals both need the days; the rows are read once for them.
    return rolling.trailing(materialise(daily, "daily"))


@query("p4_found", _ROLLED + "SELECT automaker, strftime(day, '%Y-%m-%d') AS sale_day, CASE WHEN total_7 = 0 THEN 'quiet' ELSE 'surge' END AS day_kind FROM w WHERE day_no >= 30 AND ((total_7 = 0 AND total_30 <> 0) OR total_7 * 30 > 2 * 7 * total_30)")
def p4_found(spark: SparkSession, d: str) -> DataFrame:
    found = rolling.remarkable_days(_rolled(spark, d))
    return found.select(F.col("entity").alias("automaker"), F.date_format("day", "yyyy-MM-dd").alias("sale_day"), "day_kind")


@query("p4_trailing", _ROLLED + "SELECT automaker, day, day_no, CAST(total AS BIGINT) AS day_total, CAST(total_7 AS BIGINT) AS total_7, CAST(amounts_7 AS BIGINT) AS amounts_7, total_7 / nullif(amounts_7, 0) AS mean_7, CAST(total_30 AS BIGINT) AS total_30, CAST(amounts_30 AS BIGINT) AS amounts_30, total_30 / nullif(amounts_30, 0) AS mean_30 FROM w")
def p4_trailing(spark: SparkSession, d: str) -> DataFrame:
    rolled = _rolled(spark, d).withColumnRenamed("entity", "automaker")
    return rolled.select("automaker", "day", F.col("day_no").cast("long").alias("day_no"), "day_total", "total_7", "amounts_7", "mean_7", "total_30", "amounts_30", "mean_30")


# --- 5 nested records -----------------------------------------------------------------------------------


def _tagged(spark: SparkSession, d: str) -> DataFrame:
    """The emission of both origins, each file parsed once, written partitioned by tag and read back."""
    models = nested_xml.tagged_rows(table(spark, d, "models"), "models", "model_name", "pmmlfile")
    both = models.unionByName(nested_xml.tagged_rows(table(spark, d, "configs"), "configs", "config_name", "configfile"))
    return nested_xml.write_tables(both, scratch(spark, "nested"))


@query("p5_found")
def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return _tagged(spark, d).select("origin", "file_name", F.col("tag").alias("link_kind"), F.col("parent_pk").alias("parent_path"), F.col("pk").alias("child_path")).distinct()


@query("p5_count_table")
def p5_count_table(spark: SparkSession, d: str) -> DataFrame:
    return nested_xml.flat_table(_tagged(spark, d), "count")


@query("p5_bin_table")
def p5_bin_table(spark: SparkSession, d: str) -> DataFrame:
    return nested_xml.flat_table(_tagged(spark, d), "bin")
