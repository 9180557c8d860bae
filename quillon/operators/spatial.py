"""Points near other points, and the regions containing them.

Near: every point enters a grid whose cell size follows its own range (a power of four). As a pair counts
only within the smaller of the two ranges, the point of the smaller range looks for partners at its own
level, and each point is registered at its level and those finer ones that the data has. Candidates therefore stay in
proportion to the result whatever the mix of ranges, and no row is capped. A cell is one packed number.

Inside: polygon edges are binned into latitude strips and longitude tiles, points join the edges of their
bin, and the ray crossings are counted by point and region. Points on a boundary are handled explicitly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.session import materialise

EARTH_KM = 6371.0088
KM_PER_DEGREE = EARTH_KM * 3.141592653589793 / 180
#: Grid levels: ranges up to 4**level km, from 4 m to more than half the globe.
FINEST = -4
COARSEST = 8


def usable_points(df: DataFrame, id_col: str = "record_id", lat: str = "lat", lon: str = "longitude", range_col: str = "range_km", arrival: str = "zulutime") -> DataFrame:
    """(id, lat, lon, range_km) of the usable positions, each id once (its first delivery).

    Longitudes of 180 and above mean 360 less. Null, NaN, impossible and 0/0 positions are dropped, null ids too.
    """
    rows = df.select(F.col(id_col).alias("id"), F.col(lat).cast("double").alias("lat"), F.col(lon).cast("double").alias("lon"), F.col(range_col).cast("double").alias("range_km"), F.col(arrival).alias("arrival"))
    rows = rows.filter("id is not null and abs(lat) <= 90 and lon >= -180 and lon < 360 and not (lat = 0 and lon = 0)")
    rows = rows.groupBy("id").agg(F.min(F.struct("arrival", "lat", "lon", "range_km")).alias("p")).select("id", "p.lat", "p.lon", "p.range_km")
    return rows.withColumn("lon", F.when(F.col("lon") >= 180, F.col("lon") - 360).otherwise(F.col("lon")))


def great_circle_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Haversine distance."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return F.asin(F.sqrt(F.least(F.lit(1.0), a))) * (2 * EARTH_KM)


def _level(range_km: Column) -> Column:
    return F.greatest(F.lit(FINEST), F.least(F.lit(COARSEST), F.ceil(F.log2(range_km) / 2))).cast("int")


def _size(level: Column) -> Column:
    # Twice the longest range of the level: a circle then meets two or three cells on average, not five.
    return F.pow(F.lit(4.0), level.cast("double")) * 2


def _row_of(lat: Column, level: Column) -> Column:
    return F.floor((lat + 90) * KM_PER_DEGREE / _size(level))


def _columns_in(row: Column, level: Column) -> Column:
    """Cells around a latitude row: as many as fit its shortest parallel at the level's size."""
    height = _size(level) / KM_PER_DEGREE
    far = F.least(F.lit(90.0), F.greatest(F.abs(row * height - 90), F.abs((row + 1) * height - 90)))
    return F.greatest(F.lit(1.0), F.floor(F.cos(F.radians(far)) * (360 * KM_PER_DEGREE) / _size(level))).cast("long")


def _packed(level: Column, row: Column, cell: Column) -> Column:
    """Level, row and cell as one number: they need 4, 24 and 24 bits."""
    return ((level - FINEST).cast("long") * (1 << 24) + row + 1) * (1 << 24) + cell


def near_pairs(points: DataFrame, hot_cell: int = 4000, broadcast_rows: int = 200_000) -> DataFrame:
    """(left_id, right_id), left_id < right_id, of points within the smaller of both ranges of each other.

    Points whose range is null, NaN or not above 0 take no part. Points at one place pair like any others.
    Cells of more than ``hot_cell`` registered points are split into that many salted parts, so that no
    task meets a whole hot cell; their probes are repeated for each part.
    """
    ranged = points.filter("range_km > 0 and not isnan(range_km)")
    # At most thirteen levels come back.
    present = sorted(r["at"] for r in ranged.select(_level(F.col("range_km")).alias("at")).distinct().collect())
    finer = F.filter(F.array(*[F.lit(v) for v in present]).cast("array<int>"), lambda v: v <= _level(F.col("range_km")))
    regs = ranged.withColumn("at", F.explode(finer)).withColumn("row", _row_of(F.col("lat"), F.col("at")))
    regs = regs.withColumn("cols", _columns_in(F.col("row"), F.col("at")))
    cell = F.pmod(F.floor((F.col("lon") + 180) / 360 * F.col("cols")), F.col("cols"))
    regs = regs.select(_packed(F.col("at"), F.col("row"), cell).alias("cell"), F.col("id").alias("id2"), F.col("lat").alias("lat2"), F.col("lon").alias("lon2"), F.col("range_km").alias("range2"))

    # A little more than the range, so that rounding loses no cell.
    reach = F.col("range_km") / EARTH_KM * (1 + 1e-9) + 1e-12
    up = F.degrees(reach)
    level = _level(F.col("range_km"))
    probes = ranged.withColumn("row", F.explode(F.sequence(_row_of(F.greatest(F.lit(-90.0), F.col("lat") - up), level), _row_of(F.least(F.lit(90.0), F.col("lat") + up), level))))
    probes = probes.withColumn("cols", _columns_in(F.col("row"), level))
    # Half width in longitude of the circle of range; all around where it holds a pole.
    polar = (F.abs(F.radians("lat")) + reach >= F.lit(1.5707963267948966)) | (reach >= F.lit(1.57))
    half = F.when(polar, F.lit(180.0)).otherwise(F.degrees(F.asin(F.least(F.lit(1.0), F.sin(reach) / F.cos(F.radians("lat"))))) * (1 + 1e-9) + 1e-9)
    probes = probes.withColumn("half", half)
    left, right = (F.floor((F.col("lon") + 180 + s * F.col("half")) / 360 * F.col("cols")) for s in (-1, 1))
    probes = probes.withColumn("lo", left).withColumn("hi", right)
    around = F.when(F.col("hi") - F.col("lo") + 1 >= F.col("cols"), F.sequence(F.lit(0).cast("long"), F.col("cols") - 1)).otherwise(F.transform(F.sequence("lo", "hi"), lambda c: F.pmod(c, F.col("cols"))))
    probes = probes.withColumn("c", F.explode(around)).select(_packed(level, F.col("row"), F.col("c")).alias("cell"), "id", "lat", "lon", "range_km")

    hot = regs.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > hot_cell)
    hot = hot.select("cell", F.ceil(F.col("n") / hot_cell).cast("int").alias("parts"))
    hot = materialise(hot, "hot-cells")
    n_hot = hot.count()
    if n_hot:
        # Counted, so known to be small enough to send to all; else the cells are joined like any table.
        hot = F.broadcast(hot) if n_hot <= broadcast_rows else hot
        regs = regs.join(hot, "cell", "left").withColumn("salt", F.coalesce(F.pmod(F.xxhash64("id2"), F.col("parts")), F.lit(0)).cast("int")).drop("parts")
        probes = probes.join(hot, "cell", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("parts"), F.lit(1)) - 1))).drop("parts")
    pairs = probes.join(regs, ["cell", "salt"] if n_hot else ["cell"])
    # Of two points on one level both look for the other; the smaller id keeps the pair.
    once = (_level(F.col("range2")) > _level(F.col("range_km"))) | (F.col("id") < F.col("id2"))
    pairs = pairs.filter((F.col("id") != F.col("id2")) & (F.abs(F.col("lat") - F.col("lat2")) * KM_PER_DEGREE <= F.col("range_km") * (1 + 1e-9) + 1e-9) & once)
    pairs = pairs.filter(great_circle_km(F.col("lat"), F.col("lon"), F.col("lat2"), F.col("lon2")) <= F.least("range_km", "range2"))
    return pairs.select(F.least("id", "id2").alias("left_id"), F.greatest("id", "id2").alias("right_id"))


def region_edges(regions: DataFrame, id_col: str = "region_id", wkt: str = "boundary") -> DataFrame:
    """(region, ring, x1, y1, x2, y2) of WKT polygons; parts past 180 degrees come a second time, turned by 360.

    Null or unreadable boundaries give no edges. Rings need not be closed explicitly.
    """
    num = r"[-+0-9.eE]+"
    rings = regions.select(F.col(id_col).alias("region"), F.posexplode(F.regexp_extract_all(F.col(wkt), F.lit(r"\(([^()]+)\)"), F.lit(1))).alias("ring", "body"))
    pts = rings.select("region", "ring", F.regexp_extract_all("body", F.lit(rf"({num}\s+{num})"), F.lit(1)).alias("p"))
    xy = F.transform("p", lambda t: F.struct(F.expr("0D").alias("z"), F.split(F.trim(t), r"\s+")[0].try_cast("double").alias("x"), F.split(F.trim(t), r"\s+")[1].try_cast("double").alias("y")))
    pts = pts.select("region", "ring", xy.alias("p")).filter(F.size("p") >= 3)
    pts = pts.withColumn("p", F.when(F.col("p")[0] == F.element_at("p", -1), F.col("p")).otherwise(F.concat("p", F.array(F.col("p")[0]))))
    edges = pts.select("region", "ring", F.explode(F.transform(F.sequence(F.lit(0), F.size("p") - 2), lambda i: F.struct(F.col("p")[i].alias("a"), F.col("p")[i + 1].alias("b")))).alias("e"))
    edges = edges.select("region", "ring", F.col("e.a.x").alias("x1"), F.col("e.a.y").alias("y1"), F.col("e.b.x").alias("x2"), F.col("e.b.y").alias("y2"))
    turns = F.array(F.lit(0.0), F.lit(-360.0), F.lit(360.0))
    box = edges.groupBy("region").agg(F.min(F.least("x1", "x2")).alias("west"), F.max(F.greatest("x1", "x2")).alias("east"))
    edges = edges.join(box, "region").withColumn("turn", F.explode(turns))
    edges = edges.filter((F.col("west") + F.col("turn") < 180) & (F.col("east") + F.col("turn") >= -180))
    return edges.select("region", "ring", "turn", *((F.col(c) + F.col("turn")).alias(c) for c in ("x1", "x2", "west", "east")), "y1", "y2")


def inside_regions(points: DataFrame, regions: DataFrame, strip: float = 0.25, tile: float = 1.0, salts: int = 16, boundary_inside: bool = True, broadcast_rows: int = 500_000, **region_cols: str) -> DataFrame:
    """(id, region) for every region whose polygon, without its holes, contains the point.

    A ray runs east from the point; an edge is crossed when exactly one end lies above the point, so a
    vertex counts once. Points on an edge are told apart exactly: ``boundary_inside`` says whether they
    belong. An edge is binned into each latitude strip it spans and each longitude tile from its region's
    west end to its own east end, as only points there can cross it. Binned edges are counted: up to
    ``broadcast_rows`` they are sent to all points; beyond, points are salted and edges repeated ``salts``
    times, so that a strip with a third of all points is spread.
    """
    edges = region_edges(regions, **region_cols)
    edges = edges.withColumn("strip", F.explode(F.sequence(F.floor(F.least("y1", "y2") / strip), F.floor(F.greatest("y1", "y2") / strip))))
    edges = edges.withColumn("tile", F.explode(F.sequence(F.floor(F.greatest(F.col("west"), F.lit(-180.0)) / tile), F.floor(F.least(F.greatest("x1", "x2"), F.lit(180.0)) / tile))))
    edges = materialise(edges, "edges")
    pts = points.select("id", "lat", "lon", F.floor(F.col("lat") / strip).alias("strip"), F.floor(F.col("lon") / tile).alias("tile"))
    keys = ["strip", "tile"]
    if edges.count() <= broadcast_rows:
        edges = F.broadcast(edges)
    else:
        edges = edges.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        pts = pts.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(salts)).cast("int"))
        keys.append("salt")
    x, y = F.col("lon"), F.col("lat")
    low, high = F.least("y1", "y2"), F.greatest("y1", "y2")
    at = F.col("x1") + (F.col("x2") - F.col("x1")) * F.try_divide(y - F.col("y1"), F.col("y2") - F.col("y1"))
    crosses = (low <= y) & (high > y) & (x < at)
    on = F.when(F.col("y1") == F.col("y2"), (y == F.col("y1")) & x.between(F.least("x1", "x2"), F.greatest("x1", "x2"))).otherwise(y.between(low, high) & (x == at))
    hits = pts.join(edges, keys).filter(x.between(F.col("west"), F.col("east")))
    hits = hits.select("id", "region", "turn", crosses.cast("int").alias("c"), on.cast("int").alias("o")).filter("c = 1 or o = 1")
    by = hits.groupBy("id", "region", "turn").agg(F.sum("c").alias("c"), F.max("o").alias("o"))
    found = (F.col("o") == 1) if boundary_inside else F.lit(False)
    return by.filter(found | ((F.col("o") == 0) & (F.col("c") % 2 == 1))).select("id", "region").distinct()
