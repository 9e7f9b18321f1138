import json
from xml.etree import ElementTree

import pytest
from pyspark.sql import functions as F

from trackmill import fixtures
from trackmill.functions import text
from trackmill.operators import correction, roads
from trackmill.plans import service
from trackmill.sources import readers, sinks, workspace
from trackmill.streaming import ingest

GOOD = ["20190504,204510,H,P1,113.9,22.61,51.5,305,0,1", "20190505,9,H,P2,114.05,22.645,17.25,77,0,1", "20190505,73005,H,P2,114.1,22.6,17.25,78,0,0"]
BAD = {"a,b": "field_count", "20190431,000000,H,P,114.1,22.6,3.5,12,0,1": "time", "20190505,9,H,P,x,22.6,3.5,12,0,1": "parse", "20190505,9,H,P,0.0,0.0,3.5,12,0,1": "coordinate", "20190505,1234567,H,P,114.1,22.6,1,1,0,1": "time"}


def test_lines(spark):
    rows = readers.parse_lines(spark.createDataFrame([(x,) for x in [*GOOD, *BAD]], "value string")).collect()
    assert [str(r.datetime) for r in rows[:3]] == ["2019-05-04 20:45:10", "2019-05-05 00:00:09", "2019-05-05 07:30:05"]
    assert [r.is_valid for r in rows[:3]] == [True, True, False] and all(r.reject_reason is None for r in rows[:3])
    assert [r.reject_reason for r in rows[3:]] == list(BAD.values())


@pytest.fixture
def folder(tmp_path):
    for day in ("01", "02"):
        (tmp_path / "in" / f"d{day}").mkdir(parents=True)
        (tmp_path / "in" / f"d{day}" / "x-utf.txt").write_text("\n".join([*GOOD, *BAD]) + "\n")
    (tmp_path / "in" / "other.txt").write_text(GOOD[0])
    return tmp_path


def test_files_points_and_skipping(spark, folder):
    parsed = readers.gps_text(spark, f"{folder}/in")
    assert parsed.count() == 2 * (len(GOOD) + len(BAD)) and {r.day for r in parsed.select("day").distinct().collect()} == {"01", "02"}
    told = "source_file string, plate_number string, reject_reason string"
    for batch, new in (("a", True), ("a", False), ("b", True)):  # a batch counts once, a file as well
        assert sinks.ingest(parsed, f"{folder}/points", batch) is new
    stored = sinks.stored_points(spark, f"{folder}/points", told)
    assert stored.count() == 6 and stored.where("reject_reason IS NOT NULL").count() == 0
    assert sorted(r.reject_reason for r in sinks.stored_points(spark, f"{folder}/points", told, good=False).collect()) == sorted([*BAD.values()] * 2)
    assert readers.new_files(parsed, stored).count() == 0
    assert readers.reject_counts(parsed).where("outcome = 'ok'").agg(F.sum("n")).first()[0] == 6


def test_stream_ingest_is_exactly_once(spark, folder):
    for _ in range(2):
        ingest.ingest(ingest.lines(spark, f"{folder}/in"), f"{folder}/out", f"{folder}/ck").awaitTermination()
    assert spark.read.parquet(f"{folder}/out").count() == 6
    (folder / "in" / "d02" / "y-utf.txt").write_text(GOOD[0])
    ingest.ingest(ingest.lines(spark, f"{folder}/in"), f"{folder}/out", f"{folder}/ck").awaitTermination()
    assert spark.read.parquet(f"{folder}/out").count() == 7


def test_geojson(spark):
    line = '{"type":"Feature","id":"a","properties":{"name":"N","highway":"trunk_link"},"geometry":{"type":"LineString","coordinates":[[1,2],[3,4]]}}'
    multi = '{"type":"Feature","id":"b","properties":{},"geometry":{"type":"MultiLineString","coordinates":[[[1,2],[3,4]],[[5,6]],[[7,8],[9,10]]]}}'
    df = spark.createDataFrame([(line,), (multi,), ('{"type":"Other"}',)], "value string")
    parts = readers.roads_geojson(df)
    assert sorted((r.road_id, len(r.coords)) for r in parts.collect()) == [("a", 2), ("b", 2), ("b", 2)]
    assert sorted((r.road_id, len(r.coords)) for r in readers.roads_geojson(df, merge_parts=True).collect()) == [("a", 2), ("b", 5)]
    assert parts.where("road_id = 'b'").first().road_name == "未命名道路" and readers.highways(parts).count() == 0
    assert roads.segments_of(parts).count() == 3


def test_areas(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"features":[{"properties":{"gb":"1","name":"A"},"geometry":{"type":"MultiPolygon","coordinates":[[[[0,0],[1,0],[1,1]],[[0.1,0.1],[0.2,0.1],[0.2,0.2]]]]}}]}')
    fresh = readers.areas_geojson(spark, str(tmp_path / "a.json"))
    assert fresh.select(readers.to_wkt(F.col("polygons"))).first()[0] == "MULTIPOLYGON(((0.0 0.0, 1.0 0.0, 1.0 1.0)))"
    old = spark.createDataFrame([("1", "old"), ("2", "B")], "gb_code string, name string").withColumn("polygons", F.lit(None).cast(fresh.schema["polygons"].dataType))
    assert sorted((r.gb_code, r.name) for r in readers.upsert_areas(old, fresh).collect()) == [("1", "A"), ("2", "B")]


def test_gpx_csv_and_dispatch(spark, tmp_path):
    (tmp_path / "t.gpx").write_text('<?xml version="1.0"?><gpx><trk><trkseg><trkpt lat="1.0" lon="1.5"><ele>3</ele><time>2020-01-02T03:04:05Z</time><speed>4.5</speed><course>90</course><hdop>2</hdop></trkpt><trkpt lat="2" lon="3"/><trkpt lat="0.0" lon="3"/></trkseg></trk></gpx>')
    (tmp_path / "t.csv").write_text("id,纬度,Lng,时间\n1,22.5,114.0,2020-01-01 00:00:00\n2,x,114.0,\n")
    (tmp_path / "u.csv").write_text("a,b\n1,2\n")
    (tmp_path / "t.txt").write_text("\n".join(GOOD))
    rows = readers.read(spark, str(tmp_path / "t.gpx")).orderBy("latitude").collect()
    assert [(r.latitude, r.elevation, str(r.datetime), r.speed, r.heading, r.accuracy) for r in rows] == [(1.0, 3.0, "2020-01-02 03:04:05", 4.5, 90.0, 2.0), (2.0, 0.0, "None", None, None, None)]
    assert [r.longitude for r in readers.read(spark, str(tmp_path / "t.csv")).collect()] == [114.0]
    assert readers.read(spark, str(tmp_path / "t.txt")).first().longitude == 113.9
    with pytest.raises(ValueError):
        readers.read(spark, str(tmp_path / "u.csv"))
    with pytest.raises(ValueError):
        readers.read(spark, "x.kml")
    info = readers.file_info(spark, str(tmp_path / "u.csv")).first()
    assert info.size == 8 and info.extension == "csv" and info.allowed


def test_times_and_texts(spark):
    rows = spark.createDataFrame([("2020-01-02T03:04:05",), ("2020-01-02 03:04:05Z",), ("2020-01-02T03:04:05+08:00",), ("2020/01/02 03:04:05",), ("20200102030405",), ("2020-01-02",), ("nonsense",), (None,)], "t string")
    got = [str(r[0]) for r in rows.select(text.parse_time(F.col("t"))).collect()]
    assert got[:5] == ["2020-01-02 03:04:05"] * 5 and got[5:] == ["2020-01-02 00:00:00", "None", "None"]
    n = spark.createDataFrame([(0,), (512,), (1536,), (5 << 20,)], "n long").select(text.size_text(F.col("n"))).collect()
    assert [x[0] for x in n] == ["0 Bytes", "512.0 Bytes", "1.5 KB", "5.0 MB"]


def test_sinks(spark, small, tmp_path):
    p = fixtures.gps_points(spark, small)
    built = service.build(p)
    for batch, rows in (("a", built.where("plate_number < 'B0007'").unionByName(built.where("plate_number < 'B0007'"))), ("b", built), ("b", built), ("c", built)):
        sinks.write_new(rows, f"{tmp_path}/t", batch)
    stored = sinks.stored_trajectories(spark, f"{tmp_path}/t", built.schema)
    assert stored.count() == stored.select("day", "plate_number").distinct().count() == built.count()
    sinks.write_new(built.limit(3), f"{tmp_path}/t", "d", overwrite=True)
    assert sinks.stored_trajectories(spark, f"{tmp_path}/t", built.schema).count() == 3
    c = correction.correct(p)
    counters = correction.Counters()
    sinks.export_csv(correction.correct(p, counters=counters), f"{tmp_path}/csv")
    want = service.correction_counters(p.withColumn("is_valid", F.lit(True))).first()
    assert counters.get == {"valid": p.count(), "anomalous": want.anomalous, "duplicates": want.duplicates, "saved_points": c.count()} and want.saved_points == c.count()
    sinks.export_rates(p, c, f"{tmp_path}/rates")
    assert spark.read.csv(f"{tmp_path}/csv", header=True).columns == sinks.EXPORT
    assert spark.read.csv(f"{tmp_path}/rates", header=True).count() == 3
    some = p.select("longitude", "latitude", "event_id", "datetime").repartition(3)
    n = some.count()
    for kind in ("gpx", "kml"):
        sinks.download(some, kind, f"{tmp_path}/{kind}")
        docs = [ElementTree.fromstring(f.read_bytes()) for f in (tmp_path / kind).glob("part-*")]
        local = [x.tag.rsplit("}", 1)[-1] for doc in docs for x in doc.iter()]
        assert local.count("trkpt" if kind == "gpx" else "coordinates") == local.count("time" if kind == "gpx" else "when") == n and {doc.tag.rsplit("}", 1)[-1] for doc in docs} == {kind}
    sinks.download(some, "geojson", f"{tmp_path}/geojson")
    docs = [json.loads(f.read_text()) for f in (tmp_path / "geojson").glob("part-*")]
    assert all(d["type"] == "FeatureCollection" for d in docs) and sum(len(d["features"]) for d in docs) == n
    assert readers.points_geojson(readers.collection(spark, f"{tmp_path}/geojson")).count() == n
    again = sinks.rematched(c, p.where("event_id % 2 = 0").select("event_id", F.lit(0.5).alias("confidence")), "hmm")
    sinks.export_csv(again, f"{tmp_path}/again")
    back = spark.read.csv(f"{tmp_path}/again", header=True)
    assert back.columns == sinks.EXPORT + sinks.REMATCHED and back.count() == c.count() and back.where("rematch_method = 'hmm' AND rematch_score = '0.5'").count() == c.where("event_id % 2 = 0").count()
    with pytest.raises(ValueError):
        sinks.download(some, "xlsx", f"{tmp_path}/x")


def test_a_wrong_geometry_is_refused(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"features":[{"properties":{"gb":"1","name":"A"},"geometry":{"type":"Polygon","coordinates":[[[0,0],[1,0],[1,1]]]}}]}')
    with pytest.raises(Exception, match="no MultiPolygon"):
        readers.areas_geojson(spark, str(tmp_path / "a.json")).collect()


def test_a_cluster_must_name_a_shared_folder():
    class Session:
        class conf:  # noqa: N801
            get = staticmethod(lambda *_: None)

        class sparkContext:  # noqa: N801
            master = "spark://host:7077"

    with pytest.raises(ValueError):
        workspace.shared_dir(Session)
