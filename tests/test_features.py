"""Objects of large documents, read in parts."""

import json
import random

import pytest

from trackmill.sources import features, readers


def messy(rng, n):
    text = lambda: "".join(rng.choice(['"', "\\", "{", "}", "[", "]", ",", "é", "日", "a", "\\\"", "\n", "\t"]) for _ in range(rng.randrange(12)))
    return [{"type": "Feature", "id": f"f{i}", "properties": {text(): text(), "more": {"deep": [text(), {}]}}, "geometry": {"type": "LineString", "coordinates": [[rng.random(), 1]] * rng.choice([1, 2, 30])}} for i in range(n)]


@pytest.mark.parametrize("size", [150, 1 << 20])
@pytest.mark.parametrize("indent", [None, 1])
def test_objects_are_whole_however_the_file_is_split(spark, tmp_path, size, indent):
    rng = random.Random(size)
    want = {}
    for name, n in (("a.json", 25), ("b.json", 1), ("c.json", 0)):
        want[name] = messy(rng, n)
        document = {"type": "FeatureCollection", "crs": {"type": "name", "properties": ["{"]}, "features": want[name], "after": [1, "}"]}
        (tmp_path / name).write_text(json.dumps(document, indent=indent, ensure_ascii=False) + "\n" * (name == "a.json"))
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", 0)
        found = features.objects(spark, str(tmp_path))
        if size == 150:
            assert features._pieces(spark, str(tmp_path)).rdd.getNumPartitions() > 30
        rows = found.orderBy("file", "start", "at").collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    for name, own in want.items():
        assert [json.loads(r.value) for r in rows if r.file.endswith(name)] == own


def test_ways_with_places_and_with_node_references(spark, tmp_path):
    node = lambda i, y, x: {"type": "node", "id": i, "lat": y, "lon": x}
    elements = [
        {"type": "way", "id": 1, "tags": {"highway": "primary", "name": "A"}, "geometry": [{"lat": 1.0, "lon": 2.0}, None, {"lat": 3.0, "lon": 4.0}]},
        {"type": "way", "id": 2, "tags": {"highway": "motorway_link"}, "nodes": [12, 11, 12, 99]}, {"type": "way", "id": 3, "nodes": [11, 99]}, {"type": "way", "id": 4, "geometry": [{"lat": 1.0, "lon": 2.0}]},
        {"type": "way", "id": 5}, {"type": "relation", "id": 6, "members": [{"type": "way", "geometry": [{"lat": 1, "lon": 1}]}]}, {"type": "way", "id": 7, "geometry": [{"lat": 5, "lon": 6}] * 2},
        node(11, 1.5, 2.5), node(12, 3.5, 4.5), node(12, 3.5, 4.5), {"type": "node", "id": 99},
    ]
    (tmp_path / "answer.json").write_text(json.dumps({"version": 0.6, "osm3s": {"copyright": "x"}, "elements": elements}))
    got = {r.road_id: r for r in readers.overpass(spark, str(tmp_path)).collect()}
    assert {k: (r.road_name, r.road_type, [tuple(p) for p in r.coords]) for k, r in got.items()} == {
        "osm_way_1": ("A", "primary", [(2.0, 1.0), (4.0, 3.0)]), "osm_way_2": ("未命名道路_2", "motorway_link", [(4.5, 3.5), (2.5, 1.5), (4.5, 3.5)]), "osm_way_7": ("未命名道路_7", "unknown", [(6.0, 5.0)] * 2),
    }
    assert [r.road_id for r in readers.highways(readers.overpass(spark, str(tmp_path))).collect()] == ["osm_way_1"]
