"""Steps of a stream equal those of the batch operator, in whatever order rows come."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from trackmill.operators import sequence as seq
from trackmill.streaming import ingest


@pytest.fixture
def store(spark):
    spark.conf.set(*ingest.PROVIDER)
    spark.conf.set("spark.sql.shuffle.partitions", 2)
    yield
    spark.conf.unset(ingest.PROVIDER[0])
    spark.conf.set("spark.sql.shuffle.partitions", 4)


def line(plate, when, lon, lat):
    return f"{when:%Y%m%d},{when:%H%M%S},H,{plate},{lon!r},{lat!r},17.25,77,0,1"


def run(spark, folder, name):
    q = ingest.steps(ingest.lines(spark, f"{folder}/in")).writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/ck").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()


def test_shuffled_arrival_late_rows_and_silence(spark, store, tmp_path):
    rng, begun = random.Random(8), datetime(2019, 5, 4, 6)
    rows = [(f"P{v}", begun + timedelta(seconds=60 * i + rng.randrange(50)), round(114 + rng.random() / 100, 6), round(22 + rng.random() / 100, 6)) for v in range(4) for i in range(30)]
    rows += [("gap", begun + timedelta(seconds=s), 114.0, 22.0 + s / 1e6) for s in (0, 30, 5000, 5010)]
    (tmp_path / "in").mkdir()
    # within a file any order; across files rows are at most some minutes early
    ordered = sorted(rows, key=lambda r: r[1] + timedelta(seconds=rng.randrange(400)))
    for i in range(0, len(ordered), 50):
        (tmp_path / "in" / f"{i:03}-utf.txt").write_text("\n".join(line(*r) for r in ordered[i : i + 50]))
        run(spark, tmp_path, f"s{i}")
    (tmp_path / "in" / "y-utf.txt").write_text(line("end", begun + timedelta(hours=9), 1.0, 1.0))
    run(spark, tmp_path, "y")
    (tmp_path / "in" / "z-utf.txt").write_text(line("P0", begun, 1.0, 1.0) + "\n" + line("P0", begun + timedelta(hours=9), 114.0, 22.0))  # too late; after a long silence
    run(spark, tmp_path, "z")
    (tmp_path / "in" / "zz-utf.txt").write_text(line("end", begun + timedelta(hours=19), 1.0, 1.0))
    run(spark, tmp_path, "zz")
    got = {(r.plate_number, r.datetime): r for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    batch = spark.createDataFrame([("d", *r, i) for i, r in enumerate(rows)], "day string, plate_number string, datetime timestamp_ntz, longitude double, latitude double, event_id long")
    want = {(r.plate_number, r.datetime): r for r in seq.steps(batch).collect()}
    assert set(want) < set(got) and ("P0", begun) not in got
    for k, w in want.items():
        forgotten = k[0] == "gap" and w.step_ms > 3_600_000
        assert abs(got[k].step_m - (0 if forgotten else w.step_m)) < 1e-6 and got[k].step_ms == (0 if forgotten else w.step_ms), k
    late = got["P0", begun + timedelta(hours=9)]
    assert late.step_m == 0 and late.step_ms == 0 and late.kept


def test_the_state_store_is_asked_for(spark):
    with pytest.raises(ValueError):
        ingest.steps(spark.range(1).select(F.lit(None).cast("string").alias("reject_reason")))
