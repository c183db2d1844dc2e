"""Forecast runs in folders as a data source: inventories by run, pruned by filters, and a stream of runs once they are complete.

    register_runs(spark)
    fields = spark.read.format("forecast_runs").load("hdfs:///runs").where("run >= '2024-05-01' AND abbreviation = 'TMP'")
    files = spark.read.format("forecast_runs").option("rows", "files").load("hdfs:///runs")
    arriving = spark.readStream.format("forecast_runs").option("feeds", "gfs,geavg,gespr").option("last_lead", 240).load("hdfs:///runs")

Options: ``path``; ``pattern``, an expression with the groups feed, run (digits yyyyMMddHH, other characters are left
out) and lead that is looked for in each file's path below ``path``; ``rows``, ``fields`` (a row for each line of an
inventory) or ``files`` (a row for each file, none is opened); ``feeds`` and ``last_lead``, which say when a run is
complete: its file of the last lead is there for every feed; ``complete`` (true: a batch read leaves other runs out);
``horizon_h``, how long after a newer run a stream still waits for an older one; ``split_mb``, how much of a run one task
reads. A pattern with the group piece (digits) makes one inventory of the files that differ in it alone, in its order.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import UTC, datetime, timedelta
from itertools import groupby

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as D
from pyspark.sql import functions as F

PATTERN = r"(?P<feed>[^/.]+)\.(?P<run>\d{8}/\d{2})/.*\.f(?P<lead>\d{3})\.idx$"
FIELDS = "feed string, run timestamp, lead int, n int, byte_from long, byte_to long, abbreviation string, level string, time_range string"
FILES = "feed string, run timestamp, lead int, path string, bytes long"
LINE = re.compile(r"(\d+):(\d+):d=\d{10}:([^:]+):([^:]*):([^:]*)")
LINES_A_BATCH = 20_000


@dataclass(frozen=True)
class RunFile:
    feed: str
    run: str
    lead: int
    path: str
    bytes: int
    inventory: str = ""


@dataclass
class RunFolder(D.InputPartition):
    """Files of one feed's run, or the lines of one file that begin in a range of its bytes: one task's work."""

    files: list[RunFile]
    start: int = 0
    end: int | None = None
    next: RunFile | None = None  # the piece of the last file's inventory that comes after it


class Folders:
    """What the readers share: the files below a path and which runs are complete."""

    def __init__(self, options: dict):
        if not options.get("path"):
            raise ValueError("forecast_runs needs a path")
        self.path = options["path"]
        self.pattern = re.compile(options.get("pattern", PATTERN))
        self.rows = options.get("rows", "fields")
        if self.rows not in ("fields", "files"):
            raise ValueError(f"rows is fields or files, not {self.rows}")
        self.feeds = [f.strip() for f in options.get("feeds", "").split(",") if f.strip()]
        self.last_lead = int(options.get("last_lead", 240))
        self.horizon = timedelta(hours=float(options.get("horizon_h", 96)))
        self.split = max(1, int(float(options.get("split_mb", 8)) * 1e6))

    def files(self) -> list[RunFile]:
        system, root = _system(self.path)
        found = []
        for info in system.get_file_info(pafs.FileSelector(root, recursive=True, allow_not_found=True)):
            path = info.path[len(root) :]
            m = info.is_file and self.pattern.search(path)
            run = re.sub(r"\D", "", m["run"]) if m else ""
            if len(run) == 10:
                piece = m.groupdict().get("piece")
                whole = path if piece is None else path[: m.start("piece")]
                found.append((int(piece or 0), RunFile(m["feed"], run, int(m["lead"]), info.path, info.size, whole)))
        return [f for _, f in sorted(found, key=lambda x: (x[1].run, x[1].feed, x[1].lead, x[1].inventory, x[0], x[1].path))]

    def complete(self, files: list[RunFile]) -> set[str]:
        """Runs whose last lead every feed has published."""
        if not self.feeds:
            raise ValueError("which runs are complete depends on the option feeds")
        last = {(f.run, f.feed) for f in files if f.lead == self.last_lead}
        return {f.run for f in files if all((f.run, feed) in last for feed in self.feeds)}

    def read(self, folder: RunFolder, wanted: dict[str, set] | None = None) -> Iterator[pa.RecordBatch]:
        """Rows of a folder's files; ``wanted`` are values that columns of the inventories must have."""
        if not folder.files:
            return
        if self.rows == "files":
            yield _batch(FILES_SCHEMA, [(f.feed, _time(f.run), f.lead, f.path, f.bytes) for f in folder.files])
            return
        system, _ = _system(self.path)
        rows: list[tuple] = []
        for _, pieces in groupby(folder.files, lambda f: (f.lead, f.inventory)):
            files = list(pieces)
            head = (files[0].feed, _time(files[0].run), files[0].lead)
            lines = (line for f in files for line in _lines(system, f.path, folder.start, folder.end))
            for line in _inventory(lines, self._following(system, folder) if files[-1] is folder.files[-1] else iter(())):
                if wanted and any(line[_AT[c]] not in v for c, v in wanted.items()):
                    continue
                rows.append(head + line)
                if len(rows) >= LINES_A_BATCH:
                    yield _batch(FIELDS_SCHEMA, rows)
                    rows = []
        if rows:
            yield _batch(FIELDS_SCHEMA, rows)

    def _following(self, system: pafs.FileSystem, folder: RunFolder) -> Iterator[str]:
        """Lines of the last inventory that come after the folder's; only what is asked for is read."""
        if folder.end is not None:
            yield from _lines(system, folder.files[-1].path, folder.end)
        if folder.next:
            yield from _lines(system, folder.next.path)
            n = folder.next
            later = [f.path for f in self.files() if (f.feed, f.run, f.lead, f.inventory) == (n.feed, n.run, n.lead, n.inventory)]
            for path in later[later.index(n.path) + 1 :]:
                yield from _lines(system, path)


_STAMP = pa.timestamp("us", tz="UTC")
FILES_SCHEMA = pa.schema([("feed", pa.string()), ("run", _STAMP), ("lead", pa.int32()), ("path", pa.string()), ("bytes", pa.int64())])
FIELDS_SCHEMA = pa.schema([("feed", pa.string()), ("run", _STAMP), ("lead", pa.int32()), ("n", pa.int32()), ("byte_from", pa.int64()), ("byte_to", pa.int64()), *[(c, pa.string()) for c in ("abbreviation", "level", "time_range")]])
_AT = {"abbreviation": 3, "level": 4, "time_range": 5}


def _system(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path.rstrip("/")) if ":/" in path else (pafs.LocalFileSystem(), path.rstrip("/"))


def _time(run: str) -> datetime:
    return datetime.strptime(run, "%Y%m%d%H").replace(tzinfo=UTC)


def _batch(schema: pa.Schema, rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(column, f.type) for column, f in zip(zip(*rows), schema)], schema=schema)


def _inventory(lines: Iterator[str], following: Iterator[str]) -> Iterator[tuple]:
    """(n, byte_from, byte_to, abbreviation, level, time_range) of each line; a field ends where the next one begins, the last where the first of ``following`` does, else it has no end."""
    held = None
    for m in filter(None, map(LINE.match, lines)):
        if held:
            yield (held[0], held[1], int(m[2]) - 1, *held[2:])
        held = (int(m[1]), int(m[2]), m[3], m[4], m[5])
    if held:
        m = next(filter(None, map(LINE.match, following)), None)
        yield (held[0], held[1], int(m[2]) - 1 if m else None, *held[2:])


def _lines(system: pafs.FileSystem, path: str, start: int = 0, end: int | None = None) -> Iterator[str]:
    """Lines whose first byte is at ``start`` or later and before ``end``."""
    whole_file = not start and end is None
    with system.open_input_stream(path) if whole_file else system.open_input_file(path) as stream:
        at, rest, skip = max(start - 1, 0), b"", start > 0
        if skip:
            stream.seek(at)
        while piece := stream.read(1 << 20):
            *whole, rest = (rest + piece).split(b"\n")
            for line in whole:
                if not skip:
                    if end is not None and at >= end:
                        return
                    yield line.decode("utf-8", "replace")
                at, skip = at + len(line) + 1, False
        if rest and not skip and (end is None or at < end):
            yield rest.decode("utf-8", "replace")


class ForecastRuns(D.DataSource):
    @classmethod
    def name(cls) -> str:
        return "forecast_runs"

    def schema(self) -> str:
        return FILES if self.options.get("rows") == "files" else FIELDS

    def reader(self, schema) -> RunReader:
        return RunReader(self.options)

    def streamReader(self, schema) -> RunStream:
        return RunStream(self.options)


class RunReader(D.DataSourceReader):
    """Filters on feed, run and lead leave files unopened, those on the columns of an inventory leave its rows unmade.

    Spark applies every filter again, so what a filter leaves standing here is never wrong, only more to read.
    """

    def __init__(self, options: dict):
        self.folders = Folders(options)
        self.only_complete = str(options.get("complete", "false")).lower() == "true"
        self.tests: list[tuple[str, str, object]] = []
        self.wanted: dict[str, set] = {}

    def pushFilters(self, filters):
        for f in filters:
            column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if isinstance(f, (D.EqualTo, D.In)) and column in _AT and self.folders.rows == "fields":
                values = set(f.value) if isinstance(f, D.In) else {f.value}
                self.wanted[column] = self.wanted.get(column, values) & values
            elif column in ("feed", "run", "lead") and type(f).__name__ in COMPARE:
                self.tests.append((column, type(f).__name__, f.value))
            yield f

    def partitions(self) -> list[RunFolder]:
        files = self.folders.files()
        if self.only_complete:
            complete = self.folders.complete(files)
            files = [f for f in files if f.run in complete]
        return _by_folder([f for f in files if all(_holds(f, *t) for t in self.tests)], self.folders)

    def read(self, partition: RunFolder):
        return self.folders.read(partition, self.wanted)


COMPARE = {
    "EqualTo": lambda a, b: a == b,
    "In": lambda a, b: a in b,
    "GreaterThan": lambda a, b: a > b,
    "GreaterThanOrEqual": lambda a, b: a >= b,
    "LessThan": lambda a, b: a < b,
    "LessThanOrEqual": lambda a, b: a <= b,
}


def _holds(f: RunFile, column: str, test: str, value) -> bool:
    if column != "run":
        return COMPARE[test](getattr(f, column), value)
    return COMPARE[test](_time(f.run), tuple(map(_utc, value)) if test == "In" else _utc(value))


def _utc(t: datetime) -> datetime:
    return t.astimezone(UTC) if t.tzinfo else t.replace(tzinfo=UTC)


def _by_folder(files: list[RunFile], folders: Folders) -> list[RunFolder]:
    """Each feed's run, in parts of about the split's size; a larger file is read in ranges. Rows of files are not parted."""
    found: list[RunFolder] = []
    for _, run in groupby(files, lambda f: (f.run, f.feed)):
        run, size = list(run), None
        for f, after in zip(run, [*run[1:], None]):
            following = after if after and (after.lead, after.inventory) == (f.lead, f.inventory) else None
            cut = folders.rows == "fields" and f.bytes > folders.split and not _compressed(f.path)
            if cut:
                ends = [*range(folders.split, f.bytes, folders.split), None]
                found += [RunFolder([f], start, end, following) for start, end in zip([0, *ends], ends)]
            elif size is None or folders.rows == "fields" and size + f.bytes > folders.split:
                found.append(RunFolder([f], next=following))
                size = f.bytes
            else:
                found[-1].files.append(f)
                found[-1].next = following
                size += f.bytes
            size = None if cut else size
    return found or [RunFolder([])]  # without any, Spark would still read one


def _compressed(path: str) -> bool:
    """Streams of such files are unpacked by their ending, so they have no ranges."""
    return path.lower().endswith((".gz", ".bz2", ".lz4", ".zst"))


class RunStream(D.DataSourceStreamReader):
    """Each run once, when it is complete, in whatever order runs complete.

    An offset names the complete runs above a floor. The floor lies ``horizon_h`` hours below the newest run that
    has been read, so offsets stay short for ever: a run that is complete only after one so much newer was read is given
    up. The same two offsets always stand for the same runs. After a restart the first offset names every run once more.
    """

    def __init__(self, options: dict):
        self.folders = Folders(options)
        self.done: dict | None = None

    def initialOffset(self) -> dict:
        return {"floor": "", "runs": []}

    def latestOffset(self) -> dict:
        complete = self.folders.complete(self.folders.files())
        if not self.done or not self.done["runs"]:
            return {"floor": "", "runs": sorted(complete)}
        floor = max(self.done["floor"], f"{_time(self.done['runs'][-1]) - self.folders.horizon:%Y%m%d%H}")
        held = set(self.done["runs"])
        if not any(r > floor and r not in held for r in complete):
            return self.done
        return {"floor": floor, "runs": sorted(r for r in complete | held if r > floor)}

    def partitions(self, start: dict, end: dict) -> list[RunFolder]:
        new = {r for r in end["runs"] if r > start["floor"]} - set(start["runs"])
        return _by_folder([f for f in self.folders.files() if f.run in new and f.feed in self.folders.feeds], self.folders)

    def read(self, partition: RunFolder):
        return self.folders.read(partition)

    def commit(self, end: dict) -> None:
        self.done = end


def register_runs(spark: SparkSession) -> None:
    """Make ``forecast_runs`` a format of the session, with filters handed to it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ForecastRuns)


def complete_runs(files: DataFrame, feeds: list[str], last_lead: int = 240) -> DataFrame:
    """Runs for which every feed has published the last lead; ``files`` are rows (feed, run, lead)."""
    there = [F.max(F.when((F.col("feed") == feed) & (F.col("lead") == last_lead), 1).otherwise(0)) for feed in feeds]
    return files.groupBy("run").agg(sum(there, F.lit(0)).alias("_feeds")).where(F.col("_feeds") == len(feeds)).select("run")


def newest_fresh_run(runs: DataFrame, now, max_age_h: float = 54) -> DataFrame:
    """One row: the newest run up to ``now``, null if it is older than ``max_age_h``; a run after ``now`` does not count."""
    newest = runs.where(F.col("run") <= now).agg(F.max("run").alias("run"))
    age = (F.unix_micros(F.lit(now).cast("timestamp")) - F.unix_micros("run")) / 3_600_000_000
    return newest.select(F.when(age <= max_age_h, F.col("run")).alias("run"))
