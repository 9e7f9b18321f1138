"""Readers of raw positions, roads, areas and other uploads. Bad rows are kept apart with a reason."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import filters
from .features import objects

FIELDS = ["date", "time", "record_type", "plate_number", "longitude", "latitude", "speed", "heading", "reserved_field", "location_flag"]
_ROAD = "type string, id string, properties struct<name: string, highway: string>, geometry struct<type: string, coordinates: string>"


def parse_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """Ten comma-separated fields to typed columns; reject_reason is null for good rows."""
    # a generated column is made once, where a projected one would be repeated in each that uses it
    split = lines.select("*", F.explode(F.array(F.split(column, ",", -1))).alias("_f"))
    get = lambda i: F.trim(F.get("_f", F.lit(i)))
    kinds = {"longitude": "double", "latitude": "double", "speed": "double", "heading": "double", "location_flag": "int"}
    # no field may turn a neighbour's error into its own
    typed = [get(i).try_cast(kinds[n]).alias(n) if n in kinds else get(i).alias(n) for i, n in enumerate(FIELDS)]
    when = F.try_to_timestamp(F.concat(get(0), text.pad_time(get(1))), F.lit("yyyyMMddHHmmss")).cast("timestamp_ntz")
    when = F.when(F.length(get(0)) == 8, when)
    rest = [c for c in lines.columns if c not in (*FIELDS, "datetime", "is_valid", "reject_reason")]
    fields = F.inline(F.array(F.struct(*typed, when.alias("datetime"), F.size("_f").alias("_n"))))
    out = split.select(*rest, fields).withColumn("is_valid", F.col("location_flag") == 1)
    bad = F.col("longitude").isNull() | F.col("latitude").isNull() | F.col("speed").isNull() | F.col("heading").isNull() | F.col("location_flag").isNull()
    blank = (F.col("_n") == 1) & (F.col("date") == "")
    reason = F.when(blank, "blank").when(F.col("_n") != 10, "field_count").when(F.col("datetime").isNull(), "time").when(bad, "parse").when(~filters.valid_coordinate(), "coordinate")
    return out.withColumn("reject_reason", reason).drop("_n")


def gps_text(spark: SparkSession, path: str, *, glob: str = "*-utf.txt", recursive: bool = True) -> DataFrame:
    """All matching files below path; day is the last number of the folder a file is in."""
    lines = spark.read.option("recursiveFileLookup", recursive).option("pathGlobFilter", glob).text(path)
    folder = F.regexp_extract("_metadata.file_path", r"([^/]+)/[^/]+$", 1)
    named = lines.select("value", F.col("_metadata.file_name").alias("source_file"), F.coalesce(F.nullif(F.regexp_extract(folder, r"(\d+)$", 1), F.lit("")), F.lit("data")).alias("day"))
    return parse_lines(named).drop("value")


def split_rejects(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    return parsed.where("reject_reason IS NULL").drop("reject_reason"), parsed.where("reject_reason IS NOT NULL")


def new_files(parsed: DataFrame, stored: DataFrame) -> DataFrame:
    """Rows of files that the store has nothing of; a day's files are its own."""
    return parsed.join(stored.select("day", "source_file").distinct(), ["day", "source_file"], "left_anti")


def _points(c: Column, swap: bool = False) -> Column:
    return F.transform(c, lambda p: F.struct(F.get(p, F.lit(1 if swap else 0)).alias("x"), F.get(p, F.lit(0 if swap else 1)).alias("y")))


def roads_geojson(features: DataFrame, *, merge_parts: bool = False, column: str = "value") -> DataFrame:
    """road_id, road_name, road_type and coords of Feature texts. Parts of a MultiLineString are roads of their own, or one."""
    f = features.select(F.from_json(column, _ROAD).alias("f")).where("f.type = 'Feature'").select("f.*")
    line = F.from_json("geometry.coordinates", "array<array<double>>")
    multi = F.from_json("geometry.coordinates", "array<array<array<double>>>")
    parts = F.when(F.col("geometry.type") == "LineString", F.array(line)).when(F.col("geometry.type") == "MultiLineString", F.array(F.flatten(multi)) if merge_parts else multi)
    out = f.select(F.col("id").alias("road_id"), F.coalesce("properties.name", F.lit("未命名道路")).alias("road_name"), F.coalesce("properties.highway", F.lit("unknown")).alias("road_type"), F.explode(parts).alias("c"))
    return out.select("road_id", "road_name", "road_type", _points(F.col("c")).alias("coords")).where(F.size("coords") >= 2)


def points_geojson(features: DataFrame, column: str = "value") -> DataFrame:
    """longitude, latitude and properties (a map of texts) of Point features."""
    f = features.select(F.from_json(column, "type string, properties map<string, string>, geometry struct<type: string, coordinates: array<double>>").alias("f"))
    return flat_location(f.where("f.type = 'Feature' AND f.geometry.type = 'Point'").select("f.properties", F.col("f.geometry").alias("location")))


def flat_location(documents: DataFrame, column: str = "location") -> DataFrame:
    """longitude and latitude of a GeoJSON point, whose coordinates are in that order, instead of it."""
    at = lambda i: F.get(f"{column}.coordinates", F.lit(i))
    return documents.withColumns({"longitude": at(0), "latitude": at(1)}).drop(column)


def collection(spark: SparkSession, path: str) -> DataFrame:
    """The features of FeatureCollection files, one text each; a file of any size is read by many tasks."""
    return objects(spark, path).select("value")


#: fixed values: the classes that a street query asks for
HIGHWAYS = ("motorway", "trunk", "primary", "secondary", "tertiary", "residential", "unclassified")


def highways(roads: DataFrame, classes: tuple[str, ...] = HIGHWAYS) -> DataFrame:
    """Roads of exactly these classes; links to them are others."""
    return roads.where(F.col("road_type").isin(*classes))


_ELEMENT = "type string, id long, lat double, lon double, nodes array<long>, geometry array<struct<lon: double, lat: double>>, tags struct<name: string, highway: string>"


def overpass(spark: SparkSession, path: str) -> DataFrame:
    """road_id, road_name, road_type and coords of the ways in answers of a street query.

    A way has its places with it, or the ids of nodes that stand elsewhere in the same answers: these are joined by id, and
    nodes that are missing are left out, as are places that are null. Ways of fewer than two places are no roads. A way
    without name is named by its id; without class it is unknown.
    """
    e = objects(spark, path).select(F.from_json("value", _ELEMENT).alias("e")).select("e.*")
    ways = e.where("type = 'way'").select("id", "tags", "geometry", "nodes")
    given = ways.where("geometry IS NOT NULL").select("id", "tags", F.transform(F.filter("geometry", lambda p: p["lon"].isNotNull() & p["lat"].isNotNull()), lambda p: F.struct(p["lon"].alias("x"), p["lat"].alias("y"))).alias("coords"))
    nodes = e.where("type = 'node' AND lat IS NOT NULL AND lon IS NOT NULL").groupBy(F.col("id").alias("node")).agg(F.min(F.struct(F.col("lon").alias("x"), F.col("lat").alias("y"))).alias("p"))
    named = ways.where("geometry IS NULL AND nodes IS NOT NULL")
    placed = named.select("id", F.posexplode("nodes").alias("i", "node")).join(nodes, "node").groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "p"))), lambda x: x["p"]).alias("coords"))
    both = given.unionByName(named.select("id", "tags").join(placed, "id")).where(F.size("coords") >= 2)
    return both.select(F.concat(F.lit("osm_way_"), F.col("id")).alias("road_id"), F.coalesce("tags.name", F.concat(F.lit("未命名道路_"), F.col("id"))).alias("road_name"), F.coalesce("tags.highway", F.lit("unknown")).alias("road_type"), "coords")


def areas_geojson(spark: SparkSession, path: str) -> DataFrame:
    """gb_code, name and the exterior rings of the first feature of each file, which must be a MultiPolygon: any other is an error when it is read."""
    schema = "type string, properties struct<gb: string, name: string>, geometry struct<type: string, coordinates: string>"
    first = objects(spark, path).groupBy("file").agg(F.min(F.struct("start", "at", "value"))["value"].alias("value"))
    f = first.select(F.from_json("value", schema).alias("f"))
    rings = F.from_json("f.geometry.coordinates", "array<array<array<array<double>>>>")
    kind = F.col("f.geometry.type")
    rings = F.when(kind == "MultiPolygon", rings).otherwise(F.raise_error(F.concat(F.lit("no MultiPolygon: "), F.coalesce(kind, F.lit("nothing")))))
    return f.select(F.col("f.properties.gb").alias("gb_code"), F.col("f.properties.name").alias("name"), F.transform(rings, lambda p: _points(F.get(p, F.lit(0)))).alias("polygons"))


def upsert_areas(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """The store with areas of the same code replaced; of fresh ones that share a code the last by name stays."""
    one = fresh.groupBy("gb_code").agg(F.max_by(F.struct(*[c for c in fresh.columns if c != "gb_code"]), "name").alias("a")).select("gb_code", "a.*")
    return stored.join(one.select("gb_code"), "gb_code", "left_anti").unionByName(one)


def to_wkt(polygons: Column) -> Column:
    """MULTIPOLYGON text of exterior rings."""
    ring = lambda r: F.concat(F.lit("(("), F.array_join(F.transform(r, lambda p: F.concat_ws(" ", p["x"], p["y"])), ", "), F.lit("))"))
    return F.concat(F.lit("MULTIPOLYGON("), F.array_join(F.transform(polygons, ring), ", "), F.lit(")"))


def gpx(spark: SparkSession, path: str) -> DataFrame:
    """Track points: latitude, longitude, elevation, datetime, and speed, heading and accuracy where they are told. A point with a coordinate of 0 is none."""
    told = "ele double, time string, speed double, course double, hdop double"
    rows = spark.read.format("xml").option("rowTag", "trkpt").schema(f"_lat double, _lon double, {told}, extensions struct<speed: double, course: double>").load(path)
    return rows.select(
        F.col("_lat").alias("latitude"), F.col("_lon").alias("longitude"), F.coalesce("ele", F.lit(0.0)).alias("elevation"), text.parse_time(F.col("time")).alias("datetime"),
        F.coalesce("speed", "extensions.speed").alias("speed"), F.coalesce("course", "extensions.course").alias("heading"), F.col("hdop").alias("accuracy"),
    ).where("latitude <> 0 AND longitude <> 0")


#: fixed values: by what a header is recognised
HEADERS = {"latitude": ("lat", "纬度"), "longitude": ("lon", "lng", "经度"), "datetime": ("time", "时间"), "elevation": ("ele", "海拔")}


def csv(spark: SparkSession, path: str) -> DataFrame:
    """A file with a header that names latitude and longitude somehow; rows where these are no numbers are left out."""
    raw = spark.read.csv(path, header=True)
    of = {k: next((c for c in raw.columns if any(w in c.lower() for w in words)), None) for k, words in HEADERS.items()}
    if not of["latitude"] or not of["longitude"]:
        raise ValueError("no latitude or longitude in the header")
    number = lambda k: F.col(f"`{of[k]}`").try_cast("double") if of[k] else F.lit(None).cast("double")
    when = text.parse_time(F.col(f"`{of['datetime']}`")) if of["datetime"] else F.lit(None).cast("timestamp_ntz")
    return raw.select(number("latitude").alias("latitude"), number("longitude").alias("longitude"), number("elevation").alias("elevation"), when.alias("datetime")).where("latitude IS NOT NULL AND longitude IS NOT NULL AND NOT isnan(latitude) AND NOT isnan(longitude)")


def taxi(spark: SparkSession, path: str) -> DataFrame:
    return split_rejects(parse_lines(spark.read.text(path)).drop("value"))[0]


READERS: dict[str, Callable[[SparkSession, str], DataFrame]] = {"gpx": gpx, "csv": csv, "txt": taxi}


def read(spark: SparkSession, path: str) -> DataFrame:
    kind = path.rsplit(".", 1)[-1].lower() if "." in path else ""
    if kind not in READERS:
        raise ValueError(f"cannot read .{kind} files; there are {', '.join(sorted(READERS))}")
    return READERS[kind](spark, path)


def file_info(spark: SparkSession, path: str, most: int = 100 << 20) -> DataFrame:
    """Name, size, MD5 and whether the size is allowed."""
    name = F.substring_index("path", "/", -1)
    return spark.read.format("binaryFile").load(path).select(name.alias("name"), text.extension(name).alias("extension"), F.col("length").alias("size"), F.md5("content").alias("md5"), (F.col("length") <= most).alias("allowed"))


def reject_counts(parsed: DataFrame) -> DataFrame:
    """How many rows of each file were good, and how many bad for each reason."""
    return parsed.groupBy("source_file", F.coalesce("reject_reason", F.lit("ok")).alias("outcome")).agg(F.count("*").alias("n"))
