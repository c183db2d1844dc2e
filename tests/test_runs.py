"""Run folders as a data source: pruning by filters, complete runs, and a stream that waits for what is incomplete."""

import glob
import os
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from brontide.plans import all_queries, evidence_queries
from brontide.session import shared_root
from brontide.sources import runs as R
from brontide.sources import tables as T

LINES = [
    "1:0:d=2024050100:TMP:2 m above ground:6 hour fcst:",
    "2:700:d=2024050100:APCP:surface:0-6 hour acc fcst:",
    "3:1500:d=2024050100:APCP:surface:3-6 hour acc fcst:",
    "not a line of an inventory",
    "4:1900:d=2024050100:TMP:2 m above ground:anl:",
]


def write(root, feed, run, lead, lines=LINES, name="atmos/x"):
    path = f"{root}/{feed}.{run[:8]}/{run[8:]}/{name}.f{lead:03d}.idx"
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as f:
        f.write("\n".join(lines))
    return path


def source(spark, **options):
    R.register_runs(spark)
    return spark.read.format("forecast_runs").options(**options)


def test_rows_and_byte_ranges(spark, tmp_path):
    write(tmp_path, "gfs", "2024050100", 6)
    write(tmp_path, "gfs", "2024050100", 9, [])
    write(tmp_path, "gfs", "20240501xx", 6)
    got = source(spark).load(str(tmp_path)).orderBy("n").collect()
    assert [tuple(r)[3:] for r in got] == [
        (1, 0, 699, "TMP", "2 m above ground", "6 hour fcst"),
        (2, 700, 1499, "APCP", "surface", "0-6 hour acc fcst"),
        (3, 1500, 1899, "APCP", "surface", "3-6 hour acc fcst"),
        (4, 1900, None, "TMP", "2 m above ground", "anl"),
    ]
    assert {tuple(r)[:3] for r in got} == {("gfs", datetime(2024, 5, 1), 6)}
    assert source(spark, rows="files").load(f"file://{tmp_path}").select("lead", "bytes").orderBy("lead").collect()[1] == (9, 0)


def test_empty_folder_and_wrong_options(spark, tmp_path):
    assert source(spark).load(str(tmp_path)).count() == 0
    assert source(spark, rows="files").load(f"{tmp_path}/none").count() == 0
    with pytest.raises(Exception, match="feeds"):
        source(spark, complete=True).load(str(tmp_path)).count()


def test_filters_leave_files_unopened(tmp_path):
    for feed, run, lead in (("gfs", "2024050100", 6), ("gfs", "2024050200", 3), ("gfs", "2024050200", 9), ("gefs", "2024050200", 6), ("gfs", "2024050400", 6)):
        write(tmp_path, feed, run, lead)
    reader = R.RunReader({"path": str(tmp_path)})
    pushed = [R.D.EqualTo(("feed",), "gfs"), R.D.GreaterThan(("run",), datetime(2024, 5, 1)), R.D.LessThanOrEqual(("run",), datetime(2024, 5, 3)), R.D.In(("lead",), (3, 6)), R.D.EqualTo(("abbreviation",), "TMP")]
    assert list(reader.pushFilters(pushed)) == pushed
    (folder,) = reader.partitions()
    assert [(f.feed, f.run, f.lead) for f in folder.files] == [("gfs", "2024050200", 3)]
    assert sum(b.num_rows for b in reader.read(folder)) == 2


def test_filters_give_the_rows_that_spark_would_keep(spark, tmp_path):
    for feed in ("gfs", "geavg"):
        for run in ("2024050100", "2024050112", "2024050200"):
            for lead in (3, 6, 240):
                write(tmp_path, feed, run, lead)
    df = source(spark).load(str(tmp_path))
    whole = [tuple(r) for r in df.collect()]
    for test in ("lead < 6", "lead >= 6 AND level = 'surface'", "feed IN ('gfs', 'x')", "NOT feed = 'gfs'", "run = '2024-05-01 12:00:00'", "run IN ('2024-05-02', '2024-05-01')", "abbreviation IN ('TMP') AND abbreviation = 'APCP'", "lead + 1 = 7", "byte_to IS NULL"):
        kept = spark.createDataFrame(whole, df.schema).where(test)
        assert sorted(map(str, df.where(test).collect())) == sorted(map(str, kept.collect())), test


def test_large_runs_are_read_in_parts(spark, tmp_path):
    lines = [f"{i}:{i * 100}:d=2024050100:TMP:{i} m é:{'x' * (i % 7)}:" if i % 5 else "no line" for i in range(1, 60)]
    write(tmp_path, "gfs", "2024050100", 3, lines)
    write(tmp_path, "gfs", "2024050100", 6)
    write(tmp_path, "gfs", "2024050100", 9, lines[:20] + ["no line"] * 40)
    rows = lambda **o: sorted(source(spark, **o).load(str(tmp_path)).collect(), key=lambda r: (r["lead"], r["n"]))
    whole = rows()
    for size in (1, 30, 31, 45, 300, 10_000):
        reader = R.RunReader({"path": str(tmp_path), "split_mb": str(size / 1e6)})
        parts = reader.partitions()
        assert all(sum(f.bytes for f in p.files) <= size or len(p.files) == 1 and (p.end or p.files[0].bytes) - p.start <= size for p in parts)
        got = [tuple(r.values()) for p in parts for b in reader.read(p) for r in b.to_pylist()]
        assert sorted((g[2:] for g in got), key=lambda g: g[:2]) == [tuple(r)[2:] for r in whole], size
    assert rows(split_mb=40 / 1e6) == whole


def test_pieces_are_one_inventory(spark, tmp_path):
    pieces = {2: [LINES[0]], 10: ["no line"], 9: [LINES[1], LINES[2]], 11: [], 100: [LINES[4]]}
    for folder in ("atmos", "wave"):
        for i, lines in pieces.items():
            write(tmp_path, "gfs", "2024050100", 6, lines, f"{folder}/part-{i}.x")
    pattern = r"(?P<feed>[^/.]+)\.(?P<run>\d{8}/\d{2})/\w+/part-(?P<piece>\d+).*\.f(?P<lead>\d{3})\.idx$"
    for split in (16, 1e-6):
        df = source(spark, pattern=pattern, split_mb=split).load(str(tmp_path))
        assert sorted((r["n"], r["byte_from"], r["byte_to"]) for r in df.collect()) == sorted(2 * [(1, 0, 699), (2, 700, 1499), (3, 1500, 1899), (4, 1900, None)]), split


def test_run_folders_are_written_in_pieces_and_their_rows_stay_where_they_are_read(spark, monkeypatch):
    folders = lambda: set(glob.glob(shared_root(spark).removeprefix("file://") + "/runs-*"))
    before = folders()
    monkeypatch.setattr(evidence_queries, "LINES_A_PIECE", 250)
    plan = all_queries()["s15_run_folders"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=broadcast" in plan  # else all rows meet in four tasks, one for each field
    (folder,) = folders() - before
    pieces = glob.glob(f"{folder}/feed=*/run=*/lead=*/part-*")
    lines = {}
    for p in pieces:
        task = os.path.basename(p).split("-")[1]
        with open(p) as f:
            lines[task] = lines.get(task, 0) + sum(1 for _ in f)
    assert sum(lines.values()) > 4_000 and max(lines.values()) <= 750


def test_picked_fields(spark, tmp_path):
    write(tmp_path, "gfs", "2024050100", 6)
    wanted = spark.createDataFrame([("t", "TMP", "2 m above ground", False), ("rain", "APCP", "surface", True), ("first", "APCP", "surface", False), ("none", "X", "surface", False)], "name string, abbreviation string, level string, windowed boolean")
    got = T.pick_fields(source(spark).load(str(tmp_path)), wanted, ["feed", "run", "lead"])
    assert {r["name"]: (r["n"], r["byte_from"], r["byte_to"], r["window_h"]) for r in got.collect()} == {"t": (1, 0, 699, None), "rain": (3, 1500, 1899, 3), "first": (2, 700, 1499, 6)}


def test_complete_and_fresh_runs(spark, tmp_path):
    for run in ("2024050100", "2024050200"):
        for feed in ("gfs", "geavg"):
            write(tmp_path, feed, run, 240)
    write(tmp_path, "gfs", "2024050300", 240)
    write(tmp_path, "geavg", "2024050300", 234)
    files = source(spark, rows="files").load(str(tmp_path))
    whole = R.complete_runs(files, ["gfs", "geavg"])
    assert sorted(r["run"].day for r in whole.collect()) == [1, 2]
    only = source(spark, rows="files", feeds="gfs,geavg", complete=True).load(str(tmp_path))
    assert sorted({r["run"].day for r in only.collect()}) == [1, 2]
    fresh = lambda at: R.newest_fresh_run(whole, datetime(2024, 5, *at)).collect()[0]["run"]
    assert fresh((4, 6)) == datetime(2024, 5, 2)
    assert fresh((4, 7)) is None
    assert fresh((1, 23)) == datetime(2024, 5, 1)
    assert R.newest_fresh_run(whole.where("false"), datetime(2024, 5, 2)).collect()[0]["run"] is None


def stream_once(spark, root, checkpoint, out):
    R.register_runs(spark)
    df = spark.readStream.format("forecast_runs").options(feeds="gfs,geavg", last_lead=240, horizon_h=48).load(str(root))
    counted = df.groupBy("feed", "run").agg(F.count(F.lit(1)).alias("n"))

    def keep(batch, _):
        out.extend((r["feed"], f"{r['run']:%d%H}", r["n"]) for r in batch.collect())

    q = counted.writeStream.outputMode("update").option("checkpointLocation", str(checkpoint)).foreachBatch(keep).trigger(availableNow=True).start()
    assert q.awaitTermination(180) is not False and q.exception() is None


def test_stream_reads_each_run_once_it_is_complete(spark, tmp_path):
    root, check, out = tmp_path / "runs", tmp_path / "check", []
    for feed in ("gfs", "geavg"):
        write(root, feed, "2024050100", 240)
    write(root, "gfs", "2024050112", 240)
    write(root, "gfs", "2024050200", 240)
    write(root, "geavg", "2024050200", 240)
    write(root, "other", "2024050200", 240)
    stream_once(spark, root, check, out)
    assert sorted(out) == [("geavg", "0100", 4), ("geavg", "0200", 4), ("gfs", "0100", 4), ("gfs", "0200", 4)]
    out.clear()
    stream_once(spark, root, check, out)
    assert out == []
    write(root, "geavg", "2024050112", 240)
    stream_once(spark, root, check, out)
    assert sorted(out) == [("geavg", "0112", 4), ("gfs", "0112", 4)]


def test_offsets_stay_short_and_lose_no_complete_run(tmp_path):
    stream = R.RunStream({"path": str(tmp_path), "feeds": "gfs", "last_lead": "240", "horizon_h": "48"})
    read, start = [], stream.initialOffset()
    for day in range(1, 29):
        if day != 5:
            write(tmp_path, "gfs", f"202405{day:02d}00", 240)
        if day == 6:
            write(tmp_path, "gfs", "2024050500", 240)
        if day == 20:
            write(tmp_path, "gfs", "2024051012", 240)  # far too late: given up
        end = stream.latestOffset()
        read += [f.run for p in stream.partitions(start, end) for f in p.files]
        stream.commit(end)
        start = end
        assert len(end["runs"]) <= 4 and stream.latestOffset() == end
    assert sorted(read) == [f"202405{day:02d}00" for day in range(1, 29)]
    again = R.RunStream({"path": str(tmp_path), "feeds": "gfs", "last_lead": "240", "horizon_h": "48"})
    assert not any(p.files for p in again.partitions(start, again.latestOffset()))
