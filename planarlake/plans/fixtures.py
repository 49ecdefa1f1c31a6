"""Layout tables made from the relational test tables, in Spark and in SQL; both use the same arithmetic."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import grid as G
from ..functions import point as P
from ..functions import ring

c = F.col


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def polygons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order of three lines or more is a polygon, its lines the vertices."""
    key = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    d = table(spark, sf_dir, "lineitem").groupBy(c("l_orderkey").alias("elem_id")).agg(F.array_sort(F.collect_list(key)).alias("v")).where(F.size("v") >= 3)
    pts = F.transform("v", lambda v: P.point(v["l_quantity"], v["l_extendedprice"] / 1000))
    d = d.select("elem_id", (c("elem_id") % 256).cast("int").alias("layer"), (c("elem_id") % 8).cast("int").alias("data_type"), pts.alias("points"))
    return d.withColumn("points", ring.closed(c("points")))


POLYGONS = """polygons AS (SELECT elem_id, layer, data_type, CASE WHEN v[1].x = v[len(v)].x AND v[1].y = v[len(v)].y THEN v ELSE list_append(v, v[1]) END AS p FROM (
  SELECT l_orderkey AS elem_id, (l_orderkey % 256)::INT AS layer, (l_orderkey % 8)::INT AS data_type,
    list({'x': l_quantity, 'y': l_extendedprice / 1000} ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS v
  FROM lineitem GROUP BY l_orderkey HAVING count(*) >= 3))"""


def paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's events are a path over hours and values."""
    x = F.timestamp_diff("MICROSECOND", F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"), c("ts").cast("timestamp_ntz")) / 3.6e9
    d = table(spark, sf_dir, "events").select("user_id", F.struct("ts", "event_id", P.point(x, c("value")).alias("p")).alias("e"))
    d = d.groupBy(c("user_id").alias("elem_id")).agg(F.transform(F.array_sort(F.collect_list("e")), lambda e: e["p"]).alias("points")).where(F.size("points") >= 2)
    u = c("elem_id")
    return d.select(
        "elem_id", (u % 256).cast("int").alias("layer"), (u % 8).cast("int").alias("data_type"), F.when(u % 4 != 0, (u % 3).cast("int")).alias("path_type"),
        F.when(u % 5 != 0, (u % 10) / 2.0).alias("width"), "points",
    )


PATHS = """paths AS (SELECT user_id AS elem_id, (user_id % 256)::INT AS layer, (user_id % 8)::INT AS data_type, CASE WHEN user_id % 4 <> 0 THEN (user_id % 3)::INT END AS path_type,
    CASE WHEN user_id % 5 <> 0 THEN (user_id % 10) / 2.0::DOUBLE END AS width, list({'x': (epoch_us(ts) - 1704067200000000) / 3.6e9::DOUBLE, 'y': "value"} ORDER BY ts, event_id) AS p
  FROM events GROUP BY user_id HAVING count(*) >= 2)"""


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = c("p_partkey")
    return table(spark, sf_dir, "part").select(
        k.alias("elem_id"), c("p_name").alias("text"), P.point(c("p_size"), c("p_retailprice") / 100).alias("origin"), (k % 256).cast("int").alias("layer"),
        (1 + k % 5).cast("double").alias("magnification"), ((k % 8) * 45).cast("double").alias("angle"), (k % 2 == 1).alias("x_reflection"),
        (k % 3).cast("int").alias("vertical_presentation"), (F.floor(k / 3) % 3).cast("int").alias("horizontal_presentation"),
    )


TEXTS = """texts AS (SELECT p_partkey AS elem_id, p_name AS "text", p_size::DOUBLE AS ox, p_retailprice / 100 AS oy, (p_partkey % 256)::INT AS layer, (1 + p_partkey % 5)::DOUBLE AS magnification,
    ((p_partkey % 8) * 45)::DOUBLE AS angle, p_partkey % 2 = 1 AS x_reflection, (p_partkey % 3)::INT AS v, (p_partkey // 3 % 3)::INT AS h FROM part)"""


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = spark.createDataFrame([("TOP",), ("EMPTY",)], "cell_name string")
    return top.union(table(spark, sf_dir, "region").select("r_name")).union(table(spark, sf_dir, "nation").select("n_name"))


CELLS = """cells AS (SELECT 'TOP' AS cell_name UNION ALL SELECT 'EMPTY' UNION ALL SELECT r_name FROM region UNION ALL SELECT n_name FROM nation)"""


def references(spark: SparkSession, sf_dir: str) -> DataFrame:
    r, n = c("r_regionkey"), c("n_nationkey")
    regions, nations = table(spark, sf_dir, "region"), table(spark, sf_dir, "nation")
    top = regions.select(
        F.lit("TOP").alias("cell_name"), r.cast("long").alias("elem_id"), F.lit("cell").alias("target_kind"), c("r_name").alias("target_cell"), F.lit(None).cast("long").alias("target_elem_id"),
        G.grid(P.point(r * 1000, 0), 1, 1 + r % 2, (0, 0), (0, 500), 1 + r % 2, (r % 4) * 90, r % 2 == 1).alias("grid"),
    )
    low = nations.join(regions, c("n_regionkey") == r).select(
        c("r_name").alias("cell_name"), (100 + n).cast("long").alias("elem_id"), F.lit("cell").alias("target_kind"), c("n_name").alias("target_cell"), F.lit(None).cast("long").alias("target_elem_id"),
        G.grid(P.point(n * 10, c("n_regionkey") * 5), 1 + n % 3, 1 + n % 2, (20, 0), (0, 15), 1 + n % 2, (n % 4) * 90, n % 2 == 1).alias("grid"),
    )
    return top.union(low)


REFS = """refs AS (SELECT 'TOP' AS cell_name, r_regionkey::BIGINT AS elem_id, r_name AS target_cell, (r_regionkey * 1000)::DOUBLE AS ox, 0.0::DOUBLE AS oy, 1 AS cols, 1 + r_regionkey % 2 AS rws,
    0.0::DOUBLE AS sxx, 0.0::DOUBLE AS sxy, 0.0::DOUBLE AS syx, 500.0::DOUBLE AS syy, (1 + r_regionkey % 2)::DOUBLE AS mag, ((r_regionkey % 4) * 90)::DOUBLE AS ang, r_regionkey % 2 = 1 AS refl FROM region
  UNION ALL SELECT r_name, (100 + n_nationkey)::BIGINT, n_name, (n_nationkey * 10)::DOUBLE, (n_regionkey * 5)::DOUBLE, 1 + n_nationkey % 3, 1 + n_nationkey % 2, 20.0, 0.0, 0.0, 15.0,
    (1 + n_nationkey % 2)::DOUBLE, ((n_nationkey % 4) * 90)::DOUBLE, n_nationkey % 2 = 1 FROM nation JOIN region ON n_regionkey = r_regionkey)"""


def leaf_polygons(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = c("s_suppkey")
    x, y, s = k % 50, k % 30, 1 + k % 5
    d = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), c("s_nationkey") == c("n_nationkey"))
    corners = F.array(P.point(x, y), P.point(x + s, y), P.point(x + s, y + s), P.point(x, y + s), P.point(x, y))
    return d.select(c("n_name").alias("cell_name"), k.alias("elem_id"), (k % 4).cast("int").alias("layer"), (k % 2).cast("int").alias("data_type"), corners.alias("points"))


LEAVES = """leaves AS (SELECT n_name AS cell_name, s_suppkey AS elem_id, (s_suppkey % 4)::INT AS layer, (s_suppkey % 2)::INT AS data_type,
    (s_suppkey % 50)::DOUBLE AS x0, (s_suppkey % 30)::DOUBLE AS y0, (1 + s_suppkey % 5)::DOUBLE AS side FROM supplier JOIN nation ON s_nationkey = n_nationkey),
  corners AS (SELECT cell_name, elem_id, layer, data_type, i, x0 + side * (i % 4 IN (1, 2))::INT AS x, y0 + side * (i % 4 IN (2, 3))::INT AS y FROM leaves, range(5) t(i))"""


def leaf_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = c("p_partkey")
    d = table(spark, sf_dir, "part").join(table(spark, sf_dir, "nation"), k % 25 == c("n_nationkey"))
    return d.select(
        c("n_name").alias("cell_name"), k.alias("elem_id"), (k % 4).cast("int").alias("layer"), c("p_name").alias("text"), P.point(c("p_size"), k % 17).alias("origin"),
        (1 + k % 5).cast("double").alias("magnification"), ((k % 8) * 45).cast("double").alias("angle"), F.lit(False).alias("x_reflection"),
        F.lit(1).alias("vertical_presentation"), F.lit(1).alias("horizontal_presentation"),
    )


LEAF_TEXTS = """leaf_texts AS (SELECT n_name AS cell_name, p_partkey AS elem_id, (p_partkey % 4)::INT AS layer, p_name AS "text", p_size::DOUBLE AS x, (p_partkey % 17)::DOUBLE AS y,
    (1 + p_partkey % 5)::DOUBLE AS magnification, ((p_partkey % 8) * 45)::DOUBLE AS angle FROM part JOIN nation ON p_partkey % 25 = n_nationkey)"""


def leaf_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A customer is a path of three points in the nation's cell; every fifth has no width, every fourth no end type."""
    k = c("c_custkey")
    x, y = k % 40, k % 23
    d = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), c("c_nationkey") == c("n_nationkey"))
    points = F.array(P.point(x, y), P.point(x + 3 + k % 4, y), P.point(x + 3 + k % 4, y + 5 - k % 2 * 9))
    return d.select(
        c("n_name").alias("cell_name"), k.alias("elem_id"), (k % 4).cast("int").alias("layer"), (k % 2).cast("int").alias("data_type"),
        F.when(k % 4 != 0, (k % 3).cast("int")).alias("path_type"), F.when(k % 5 != 0, (k % 6) / 2.0).alias("width"), points.alias("points"),
    )


LEAF_PATHS = """leaf_paths AS (SELECT n_name AS cell_name, c_custkey AS elem_id, (c_custkey % 4)::INT AS layer, (c_custkey % 2)::INT AS data_type, CASE WHEN c_custkey % 4 <> 0 THEN (c_custkey % 3)::INT END AS path_type,
    CASE WHEN c_custkey % 5 <> 0 THEN (c_custkey % 6) / 2.0::DOUBLE END AS width, (c_custkey % 40)::DOUBLE AS x0, (c_custkey % 23)::DOUBLE AS y0, (3 + c_custkey % 4)::DOUBLE AS run, (5 - c_custkey % 2 * 9)::DOUBLE AS rise
    FROM customer JOIN nation ON c_nationkey = n_nationkey),
  bends AS (SELECT *, i, x0 + run * (i > 0)::INT AS x, y0 + rise * (i > 1)::INT AS y FROM leaf_paths, range(3) t(i))"""


def no_paths(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "cell_name string, elem_id long, layer int, data_type int, path_type int, width double, points array<struct<x:double,y:double>>")


def probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(c("event_id").alias("pt_id"), (c("value") / 10).alias("px"), (c("event_id") % 100).cast("double").alias("py"))


PROBES = """probes AS (SELECT event_id AS pt_id, "value" / 10 AS px, (event_id % 100)::DOUBLE AS py FROM events)"""


def spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The polygons at a tenth of their size, all over a plane of some 1000 by 1000."""
    k = c("elem_id")
    return polygons(spark, sf_dir).select("elem_id", ring.move_by(ring.scale(c("points"), 0.1), P.point(k % 997, (k * 7) % 991)).alias("points"))


def spread_probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = c("event_id")
    return table(spark, sf_dir, "events").select(k.alias("pt_id"), ((k * 13) % 10007 / 10).alias("px"), ((k * 29) % 9973 / 10).alias("py"))


SPREAD = """spread AS (SELECT elem_id, [{'x': v.x * 0.1 + elem_id % 997, 'y': v.y * 0.1 + (elem_id * 7) % 991} for v in p] AS p FROM polygons),
  spread_probes AS (SELECT event_id AS pt_id, ((event_id * 13) % 10007) / 10 AS px, ((event_id * 29) % 9973) / 10 AS py FROM events)"""


def crowded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The spread polygons, nine of ten of them at a hundredth of their size within one unit, and a large one a layer."""
    p = spread(spark, sf_dir)
    spot = F.when(c("elem_id") % 10 > 0, 0.001).when(c("elem_id") % 1000 == 0, 40.0).otherwise(1.0)
    return p.select("elem_id", ring.scale(c("points"), spot).alias("points"))


def crowded_probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = F.when(c("pt_id") % 4 > 0, 0.001).otherwise(1.0)
    return spread_probes(spark, sf_dir).select("pt_id", (c("px") * near).alias("px"), (c("py") * near).alias("py"))


CROWDED = """crowded AS (SELECT elem_id, [{'x': v.x * k, 'y': v.y * k} for v in p] AS p FROM (SELECT *, CASE WHEN elem_id % 10 > 0 THEN 0.001::DOUBLE WHEN elem_id % 1000 = 0 THEN 40.0::DOUBLE ELSE 1.0::DOUBLE END AS k FROM spread)),
  crowded_probes AS (SELECT pt_id, px * k AS px, py * k AS py FROM (SELECT *, CASE WHEN pt_id % 4 > 0 THEN 0.001::DOUBLE ELSE 1.0::DOUBLE END AS k FROM spread_probes))"""


def one_cell(df: DataFrame, name: str) -> DataFrame:
    return df.withColumn("cell_name", F.lit(name))


def chain(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(references, polygons) of 75 cells, each in the one before it, turned and moved; each has a square."""
    three = F.sequence(c("n_nationkey") * 3, c("n_nationkey") * 3 + 2)
    d = table(spark, sf_dir, "nation").select(F.explode(three.cast("array<bigint>")).alias("k"))
    name = lambda v: F.concat(F.lit("deep"), v.cast("string"))
    refs = d.where("k < 74").select(
        name(c("k")).alias("cell_name"), (c("k") + 5000).alias("elem_id"), F.lit("cell").alias("target_kind"), name(c("k") + 1).alias("target_cell"), F.lit(None).cast("long").alias("target_elem_id"),
        G.grid(P.point(c("k") % 3, 1), 1, 1, (0, 0), (0, 0), 1, (c("k") % 4) * 90, c("k") % 5 == 2).alias("grid"),
    )
    corners = F.array(*[P.point(c("k") + x, y) for x, y in ((0, 0), (1, 0), (1, 1), (0, 1), (0, 0))])
    return refs, d.select(name(c("k")).alias("cell_name"), c("k").alias("elem_id"), (c("k") % 4).cast("int").alias("layer"), F.lit(0).alias("data_type"), corners.alias("points"))


def diamonds(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(cells, references): two cells under each nation's, and both over the next nation's: ways double at each."""
    d = table(spark, sf_dir, "nation").select(c("n_nationkey").alias("k"))
    at = lambda p, v: F.concat(F.lit(p), v.cast("string"))
    pairs = [(at("top", c("k")), at(side, c("k"))) for side in ("left", "right")] + [(at(side, c("k")), at("top", c("k") + 1)) for side in ("left", "right")]
    refs = d.select(F.explode(F.array(*[F.struct(a.alias("cell_name"), b.alias("target_cell")) for a, b in pairs])).alias("e")).select("e.*")
    refs = refs.select("cell_name", F.xxhash64("cell_name", "target_cell").alias("elem_id"), F.lit("cell").alias("target_kind"), "target_cell", F.lit(None).cast("long").alias("target_elem_id"), G.grid().alias("grid"))
    return refs.select("cell_name").union(refs.select("target_cell")).distinct(), refs


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pair of points of each embedding's first four numbers."""
    e = c("embedding")
    d = lambda i: e[i].cast("double")
    return table(spark, sf_dir, "embeddings").select("vec_id", P.point(d(0), d(1)).alias("p"), P.point(d(2), d(3)).alias("q"))


POINTS = """points AS (SELECT vec_id, embedding[1]::DOUBLE AS px, embedding[2]::DOUBLE AS py, embedding[3]::DOUBLE AS qx, embedding[4]::DOUBLE AS qy FROM embeddings)"""

PAIRS = [(1, 1), (3, 1), (0, 0)]
PAIRS_SQL = "((layer = 1 AND data_type = 1) OR (layer = 3 AND data_type = 1) OR (layer = 0 AND data_type = 0))"
#: All but the polygons on layer 2.
MOST = [(0, 0), (1, 1), (3, 1), (2, 9)]
MOST_SQL = "((layer = 0 AND data_type = 0) OR (layer = 1 AND data_type = 1) OR (layer = 3 AND data_type = 1) OR (layer = 2 AND data_type = 9))"
