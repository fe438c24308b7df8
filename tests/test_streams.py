"""Windowed predictions on a stream of several micro-batches against a plain loop."""

import datetime as dt
import os

import pytest

from tidemark import catalog
from tidemark.catalog import analysis
from tidemark.streaming import bars

T0 = dt.datetime(2024, 1, 1)
ROCKS = "spark.sql.streaming.stateStore.providerClass"


@pytest.fixture
def rocks(spark):
    before = spark.conf.get(ROCKS)
    spark.conf.set(ROCKS, bars.ROCKS)
    yield spark
    spark.conf.set(ROCKS, before)


def test_windows_go_on_across_micro_batches(rocks, tmp_path):
    def spread(windows):
        return windows[:, -1, 0] - windows[:, :, 0].mean(1) + windows[:, :, 1].max(1)

    rows = {s: [(s, T0 + dt.timedelta(hours=k), float((k * m) % 17), float(k % 5)) for k in range(40)] for s, m in (("A", 7), ("B", 3))}
    schema = "symbol string, ts timestamp, close double, _v double"
    for n, (low, high) in enumerate(((0, 3), (3, 20), (20, 40))):
        part = [r for own in rows.values() for r in own[low:high]]
        path = str(tmp_path / "in" / f"part{n}")
        rocks.createDataFrame(part[::-1], schema).coalesce(1).write.parquet(path)
        for f in os.listdir(path):
            os.utime(os.path.join(path, f), (1_000_000 + n, 1_000_000 + n))
    stream = rocks.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    out = bars.windowed_predictions(stream, ["close", "_v"], spread, 6, 3)
    query = bars.stream_into(out, str(tmp_path / "out"), str(tmp_path / "state"))
    query.awaitTermination()
    got = sorted((r["symbol"], r["ts"], r["rows"], round(r["prediction"], 9)) for r in rocks.read.schema(out.schema).parquet(str(tmp_path / "out")).collect())
    want = []
    for s, own in rows.items():
        for k in range(2, 40):
            held = own[max(0, k - 5) : k + 1]
            want.append((s, own[k][1], len(held), round(held[-1][2] - sum(r[2] for r in held) / len(held) + max(r[3] for r in held), 9)))
    assert got == sorted(want) and len(query.recentProgress) >= 3


def test_ordered_micro_batches_are_slices(spark, monkeypatch, tmp_path):
    """A worker holds a symbol's rows of a micro-batch, so none has many more than a slice, and they come in order."""
    monkeypatch.setattr(analysis, "SLICE", 300)
    rows = spark.range(1000).selectExpr("(id * 617) % 1000 AS ts", "id")
    stream, seen = analysis._stream_of(spark, rows, str(tmp_path), ("ts",)), []
    bars.upsert_batches(stream, lambda batch, number: seen.append(sorted(r["ts"] for r in batch.collect())), str(tmp_path / "state")).awaitTermination()
    assert len(seen) == 4 and max(map(len, seen)) < 400 and sum(seen, []) == list(range(1000))


@pytest.mark.parametrize("name", ["stream_volume_bars", "stream_live_monitor"])
def test_queries_are_the_same_in_slices(spark, monkeypatch, name):
    """Bars and states go on from slice to slice, over pauses longer than an hour as well, which these few ticks have."""
    def told():
        return sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in catalog.QUERIES[name](spark, "/root/testdata/sf0.001").collect())

    whole = told()
    monkeypatch.setattr(analysis, "SLICE", 300)
    assert whole and told() == whole
