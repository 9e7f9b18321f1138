"""Writers: partitioned tables, insert-if-absent, CSV exports and GeoJSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import sequence as seq
from ..plans import service
from . import readers
from .store import Store, unique


#: a batch of parsed rows is one table, whose folders tell good rows from bad ones and days apart
_OUTCOME = "good boolean, day string"


def write_points(parsed: DataFrame, path: str, batch: str) -> bool:
    """Stores a batch of parsed rows, good ones and others with their reasons, in one pass and all at once; whether the batch was new. Running it again changes nothing."""
    return Store(parsed.sparkSession, path).append(batch, {"points": parsed.withColumn("good", F.col("reject_reason").isNull())}, {"points": ["good", "day"]})


def stored_points(spark: SparkSession, path: str, schema: str, good: bool = True) -> DataFrame:
    """The good (or the rejected) rows of all batches. schema: the columns asked for, without day."""
    return Store(spark, path).read("points", f"{schema}, {_OUTCOME}").where(F.col("good") == good).drop("good")


def ingest(parsed: DataFrame, path: str, batch: str) -> bool:
    """As write_points(), but for the rows of files that the store already has some of."""
    return write_points(readers.new_files(parsed, Store(parsed.sparkSession, path).read("points", "source_file string, day string")), path, batch)


def write_new(trajectories: DataFrame, path: str, batch: str, overwrite: bool = False) -> bool:
    """Trajectories (or rows of them) of vehicles' days and types that are not stored yet; or all, instead of what is stored. Whether the batch was new.

    Of several trajectories with one day, plate and type (or without types), the one with most points is stored, then the one that is
    greatest by its other columns. A batch is stored as a whole or not at all, and once.
    """
    store, keys = Store(trajectories.sparkSession, path), [*seq.KEYS, *(["type"] if "type" in trajectories.columns else [])]
    fresh = unique(trajectories, keys, [c for c in ("point_count",) if c in trajectories.columns]) if "trajectory_points" in trajectories.columns else trajectories
    if not overwrite:
        known = store.read("trajectories", trajectories.schema).select(*[F.col(c).alias(f"_{c}") for c in keys]).distinct()
        same = F.lit(True)
        for c in keys:
            same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
        fresh = fresh.join(known, same, "left_anti")
    return store.append(batch, {"trajectories": fresh}, {"trajectories": ["day"]}, overwrite)


def stored_trajectories(spark: SparkSession, path: str, schema) -> DataFrame:
    return Store(spark, path).read("trajectories", schema)


EXPORT = ["day", "plate_number", "datetime", "longitude", "latitude", "speed", "heading", "road_id", "road_type"]


#: what a second matching adds, where it has been made
REMATCHED = ["rematch_method", "rematch_score"]


def rematched(corrected: DataFrame, matches: DataFrame, method: str) -> DataFrame:
    """corrected with the method and the confidence of a second matching; nulls where it found nothing."""
    again = matches.select("event_id", F.lit(method).alias("rematch_method"), F.col("confidence").alias("rematch_score"))
    return corrected.drop(*REMATCHED).join(again, "event_id", "left")


def export_csv(corrected: DataFrame, path: str) -> None:
    more = [c for c in REMATCHED if c in corrected.columns]
    corrected.select(*EXPORT, *more).withColumn("datetime", F.date_format("datetime", "yyyy-MM-dd HH:mm:ss")).write.mode("overwrite").option("header", True).csv(path)


def export_rates(points: DataFrame, corrected: DataFrame, path: str) -> None:
    service.correction_rate(points, corrected).write.mode("overwrite").option("header", True).csv(path)


def sample(points: DataFrame, corrected: DataFrame, vehicles: int = 100) -> DataFrame:
    """Rows of each day's first vehicles in the order in which they came in, original and corrected, where both exist."""
    came = points.groupBy(*seq.KEYS).agg(F.min("event_id").alias("_first"))
    first = came.withColumn("_r", F.row_number().over(Window.partitionBy("day").orderBy("_first"))).where(F.col("_r") <= vehicles).select(*seq.KEYS)
    both = first.join(corrected.select(*seq.KEYS).distinct(), list(seq.KEYS), "left_semi")
    tagged = lambda df, kind: df.join(both, list(seq.KEYS), "left_semi").select(*seq.KEYS, "event_id", "longitude", "latitude", F.lit(kind).alias("kind"))
    return tagged(points, "original").union(tagged(corrected, "corrected"))


def geojson(lines: DataFrame) -> DataFrame:
    """One Feature text per road."""
    coordinates = F.transform("coords", lambda p: F.array(p["x"], p["y"]))
    return lines.select(F.to_json(F.struct(
        F.lit("Feature").alias("type"), F.col("road_id").alias("id"), F.struct(F.col("road_name").alias("name"), F.col("road_type").alias("highway")).alias("properties"),
        F.struct(F.lit("LineString").alias("type"), coordinates.alias("coordinates")).alias("geometry"),
    )).alias("value"))


def gps_lines(points: DataFrame, *more: str) -> DataFrame:
    """Positions as raw text lines, beside the columns asked for."""
    n = lambda c: F.col(c).cast("string")
    return points.select(*more, F.concat_ws(",", F.date_format("datetime", "yyyyMMdd"), F.date_format("datetime", "HHmmss"), F.lit("H"), "plate_number", n("longitude"), n("latitude"), n("speed"), F.col("heading").cast("int").cast("string"), F.lit("0"), n("location_flag")).alias("value"))


def write_lines(points: DataFrame, path: str) -> None:
    """Raw text files, a folder for each day."""
    gps_lines(points, "day").write.mode("overwrite").partitionBy("day").text(path)


def _document(head: str, foot: str, between: str = ""):
    """One row for each partition that has rows: a whole document of its lines. A partition's lines pass one at a time."""

    def run(batches):
        import pyarrow as pa

        begun = False
        for batch in batches:
            if batch.num_rows:
                lines = batch.column(0).to_pylist()
                lines = [*([between + lines[0]] if begun else [head, lines[0]]), *(between + x for x in lines[1:])]
                yield pa.RecordBatch.from_pydict({"value": lines})
                begun = True
        if begun:
            yield pa.RecordBatch.from_pydict({"value": [foot]})

    return run


#: fixed values: what stands around the points of a document
_GPX = '<?xml version="1.0" encoding="UTF-8"?>\n<gpx version="1.1" creator="trackmill" xmlns="http://www.topografix.com/GPX/1/1"><trk><trkseg>', "</trkseg></trk></gpx>"
_KML = '<?xml version="1.0" encoding="UTF-8"?>\n<kml xmlns="http://www.opengis.net/kml/2.2"><Document>', "</Document></kml>"


def write_members(texts: DataFrame, path: str, head: str = '{"type":"FeatureCollection","features":[') -> None:
    """JSON texts as the members of documents, a document a task: each file is one by itself."""
    texts.mapInArrow(_document(head, "]}", ","), "value string").write.mode("overwrite").text(path)


def download(points: DataFrame, kind: str, path: str) -> None:
    """points as csv, geojson, gpx or kml files; each file is a document by itself."""
    if kind == "csv":
        points.write.mode("overwrite").option("header", True).csv(path)
    elif kind == "geojson":
        geometry = F.struct(F.lit("Point").alias("type"), F.array("longitude", "latitude").alias("coordinates"))
        rest = F.struct(*[c for c in points.columns if c not in ("longitude", "latitude")])
        write_members(points.select(F.to_json(F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), rest.alias("properties"))).alias("value")), path)
    elif kind in ("gpx", "kml"):
        has = lambda c: c in points.columns
        time = F.date_format("datetime", "yyyy-MM-dd'T'HH:mm:ss'Z'") if has("datetime") else F.lit(None).cast("string")
        tag = lambda name, c: F.when(c.isNotNull(), F.concat(F.lit(f"<{name}>"), c, F.lit(f"</{name}>"))).otherwise("")
        lat, lon = F.col("latitude").cast("string"), F.col("longitude").cast("string")
        if kind == "gpx":
            more = [tag("time", time), *[tag(name, F.col(c).cast("string")) for name, c in (("speed", "speed"), ("course", "heading")) if has(c)]]
            value = F.concat(F.lit('<trkpt lat="'), lat, F.lit('" lon="'), lon, F.lit('">'), *more, F.lit("</trkpt>"))
        else:
            value = F.concat(F.lit("<Placemark>"), F.when(time.isNotNull(), F.concat(F.lit("<TimeStamp>"), tag("when", time), F.lit("</TimeStamp>"))).otherwise(""), F.lit("<Point><coordinates>"), lon, F.lit(","), lat, F.lit("</coordinates></Point></Placemark>"))
        head, foot = _GPX if kind == "gpx" else _KML
        points.where("latitude IS NOT NULL AND longitude IS NOT NULL").select(value.alias("value")).mapInArrow(_document(head, foot), "value string").write.mode("overwrite").text(path)
    else:
        raise ValueError(f"no download as {kind}")
