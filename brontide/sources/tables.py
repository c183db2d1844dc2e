"""Tables in and out: shards, thinned reads, station files, grids, partitioned and idempotent writes, fingerprints."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

OBSERVATION = T.StructType([T.StructField(n, T.StringType() if n in ("station", "wxcodes") else T.TimestampType() if n == "valid" else T.DoubleType()) for n in ("station", "valid", "tmpf", "dwpf", "sknt", "gust", "vsby", "wxcodes")])


def read_observations(spark: SparkSession, path: str) -> DataFrame:
    """Station reports as CSV with header, M for missing."""
    return spark.read.schema(OBSERVATION).option("header", True).option("nullValue", "M").option("timestampFormat", "yyyy-MM-dd HH:mm").csv(path)


def read_shards(spark: SparkSession, path: str | Sequence[str], keys: Sequence[str] = (), columns: Sequence[str] = ()) -> DataFrame:
    """Parquet shards, projected at the scan, one row for each key."""
    df = spark.read.option("mergeSchema", True).parquet(*([path] if isinstance(path, str) else path))
    df = df.select(*columns) if columns else df
    return df.dropDuplicates(list(keys)) if keys else df


def read_thinned(spark: SparkSession, path: str | Sequence[str], dates: DataFrame | None, date: str, keys: Sequence[str] = (), columns: Sequence[str] = ()) -> DataFrame:
    """Only rows of the dates asked for (all without ``dates``), doubles other than keys as floats, one row for each key. A date partition prunes the scan."""
    df = read_shards(spark, path, (), columns)
    df = df if dates is None else df.join(dates.select(date).distinct(), date, "left_semi")
    narrow = {f.name for f in df.schema if isinstance(f.dataType, T.DoubleType)} - set(keys)
    df = df.select(*[F.col(c).cast("float").alias(c) if c in narrow else F.col(c) for c in df.columns])
    return df.dropDuplicates(list(keys)) if keys else df


def run_dates(df: DataFrame, date: str = "run_date") -> DataFrame:
    return df.select(date).distinct()


def read_station_files(spark: SparkSession, path: str, pattern: str = r"([^/]+)\.parquet$", name: str = "point_id") -> DataFrame:
    """Files of one station each, the station taken from the file's name."""
    df = spark.read.parquet(path)
    return df.withColumn(name, F.regexp_extract(F.col("_metadata.file_path"), pattern, 1))


def write_monthly(df: DataFrame, path: str, date: str, mode: str = "append") -> None:
    """Parquet by month; rows of a month are gathered first, so a month is not spread over every task's files."""
    month = df.withColumn("yyyymm", F.date_format(date, "yyyyMM"))
    month.repartition("yyyymm", F.pmod(F.xxhash64(date), F.lit(8))).write.mode(mode).partitionBy("yyyymm").parquet(path)


def write_by_point(df: DataFrame, name: str, path: str, key: str = "point_id", buckets: int = 64, order: Sequence[str] = ()) -> DataFrame:
    """Write a table in buckets of ``key``, sorted by it and ``order``, and return it as the session's table ``name``.

    Tables written this way join on the key and any further columns, group and open windows by it
    without an exchange, once ``join_by_point`` has told the session so. A bucket is one task's
    part: choose as many as keep it in memory, and as many for all tables of a job. Of two tables with other
    numbers only the one with fewer buckets is moved; joined on the key alone, neither is if the numbers divide each other.
    """
    spark = df.sparkSession
    spark.sql(f"DROP TABLE IF EXISTS `{name}`")
    by_bucket = df.repartition(buckets, key)  # so that each bucket is one file
    by_bucket.write.mode("overwrite").format("parquet").bucketBy(buckets, key).sortBy(key, *order).option("path", path).saveAsTable(name)
    return spark.table(name)


def open_by_point(spark: SparkSession, name: str, path: str, schema: T.StructType, key: str = "point_id", buckets: int = 64, order: Sequence[str] = ()) -> DataFrame:
    """A table that another session wrote with ``write_by_point``, under the same key, buckets and order."""
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    sorted_by = ", ".join(f"`{c}`" for c in (key, *order))
    spark.sql(f"CREATE TABLE IF NOT EXISTS `{name}` ({columns}) USING parquet CLUSTERED BY (`{key}`) SORTED BY ({sorted_by}) INTO {buckets} BUCKETS LOCATION '{path}'")
    return spark.table(name)


def join_by_point(spark: SparkSession) -> None:
    """Let the session join, on a key and further columns, tables that are in buckets of the key alone, and read buckets together where numbers differ."""
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    spark.conf.set("spark.sql.bucketing.coalesceBucketsInJoin.enabled", "true")


def append_missing(df: DataFrame, path: str, keys: Sequence[str], attempts: int = 20) -> int:
    """Append the rows whose keys the table does not hold yet, as one version; how many rows that were.

    Only ``read_versions`` reads such a table: rows that no version names do not count. Each key
    is in the table once, also if ``df`` repeats it (its smallest row stays), if the call is
    repeated, if a task or the driver dies half-way, and if several writers append at once:
    the new rows are staged in a folder of their own, and the version that names it is a
    file that only one writer can create. A writer that comes second looks for missing keys again.
    """
    spark, keys = df.sparkSession, list(keys)
    rest = [c for c in df.columns if c not in keys]
    once = df.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("_r")).select(*keys, "_r.*").select(*df.columns) if rest else df.dropDuplicates(keys)
    for _ in range(attempts):
        folders, version = _versions(spark, path)
        held = spark.read.schema(df.schema).parquet(*folders).select(*keys) if folders else None
        new = once.join(held.distinct(), keys, "left_anti") if held is not None else once
        stage = f"{path}/data/{uuid.uuid4().hex}"
        new.write.parquet(stage)
        n = spark.read.schema(df.schema).parquet(stage).count()
        if not n or _commit(spark, path, version + 1, [*folders, stage]):
            return n
    raise RuntimeError(f"other writers were first {attempts} times")


def read_versions(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The table that ``append_missing`` wrote, as of its newest version or of an earlier one."""
    folders, found = _versions(spark, path, version)
    if not folders:
        raise FileNotFoundError(f"no version of {path}")
    return spark.read.parquet(*folders)


def _file_system(spark: SparkSession, path: str):
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return root, root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _versions(spark: SparkSession, path: str, version: int | None = None) -> tuple[list[str], int]:
    """Folders of the newest version (or of ``version``), and its number; none and 0 for a table that is not there."""
    root, fs = _file_system(spark, f"{path}/versions")
    if not fs.exists(root):
        return [], 0
    found = sorted(int(f.getPath().getName()) for f in fs.listStatus(root) if f.getPath().getName().isdigit())
    found = [v for v in found if version is None or v <= version]
    if not found:
        return [], 0
    with_lines = spark.read.text(f"{path}/versions/{found[-1]:020d}").orderBy("value").collect()  # a line for each append
    return [f"{path}/data/{r['value']}" for r in with_lines], found[-1]


def _commit(spark: SparkSession, path: str, version: int, folders: list[str]) -> bool:
    """Name the folders of a version; false if another writer has named one. The list is written aside and renamed without overwriting, so readers see all of it or nothing."""
    target, fs = _file_system(spark, f"{path}/versions/{version:020d}")
    aside, _ = _file_system(spark, f"{path}/staged/{uuid.uuid4().hex}")
    out = fs.create(aside, False)
    try:
        out.write("\n".join(f.rpartition("/")[2] for f in folders).encode())
    finally:
        out.close()
    fs.mkdirs(target.getParent())
    if fs.exists(target):
        fs.delete(aside, False)
        return False
    none = spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.org.apache.hadoop.fs.Options.Rename, 1)
    none[0] = spark.sparkContext._jvm.org.apache.hadoop.fs.Options.Rename.NONE
    context = spark.sparkContext._jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    try:
        context.rename(context.makeQualified(aside), context.makeQualified(target), none)
    except Exception as e:  # noqa: BLE001  the other writer's file is there now
        if not fs.exists(target):
            raise RuntimeError(f"version {version} of {path} could not be written") from e
        fs.delete(aside, False)
        return False
    return True


def fingerprint(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """One row: sha256 over sorted path:size lines of all files. The files' contents are not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path).select(F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), "length")
    lines = F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "name", F.col("length").cast("string")))), "\n")
    return files.agg(F.count(F.lit(1)).alias("files"), F.sum("length").alias("bytes"), F.sha2(lines.cast("binary"), 256).alias("sha256"))


def pick_fields(rows: DataFrame, wanted: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """One inventory row of each wanted field in each file (``keys``), with its ``window_h`` (null: not a window).

    ``rows`` are (*keys, n, abbreviation, level, time_range, ...), ``wanted`` (name, abbreviation, level, windowed).
    A windowed field takes its narrowest window, any other the first instantaneous row; where there is none, the first row.
    """
    from ..operators.labels import first_per

    form = r"^(\d+)-(\d+) hour (acc|max|min)"
    width = F.regexp_extract("time_range", form, 2).try_cast("int") - F.regexp_extract("time_range", form, 1).try_cast("int")
    other = F.when(F.col("time_range").rlike(r"^\d+ hour fcst$"), 0).otherwise(1)
    found = rows.join(wanted, ["abbreviation", "level"]).withColumn("window_h", F.nullif(width, F.lit(0)))
    turn = F.when(F.col("windowed"), F.coalesce("window_h", F.lit(10_000))).otherwise(other)
    return first_per(found.withColumn("_w", turn), [*keys, "name"], ["_w", "n"]).drop("_w", "windowed")


def inventory(lines: DataFrame, line: str = "value") -> DataFrame:
    """Columns of inventory lines n:offset:d=init:NAME:level:range: ; lines of another form go."""
    form = r"^(\d+):(\d+):d=(\d{10}):([^:]+):([^:]*):([^:]*):?"
    part = lambda i: F.regexp_extract(line, form, i)
    out = lines.where(F.col(line).rlike(form))
    return out.select(part(1).cast("int").alias("n"), part(2).cast("long").alias("byte_from"), F.to_timestamp(part(3), "yyyyMMddHH").alias("init"), part(4).alias("abbreviation"), part(5).alias("level"), part(6).alias("time_range"))


def html_table(pages: DataFrame, html: str, key: str, columns: int) -> DataFrame:
    """(key, row, c1 .. cn): cells of table rows with at least ``columns`` cells; tags and entities in cells are undone."""
    rows = F.regexp_extract_all(html, F.lit(r"(?is)<tr[^>]*>(.*?)</tr>"), F.lit(1))
    each = pages.select(key, F.posexplode(rows).alias("row", "_r"))
    cells = F.regexp_extract_all("_r", F.lit(r"(?is)<t[dh][^>]*>(.*?)</t[dh]>"), F.lit(1))
    each = each.withColumn("_c", F.transform(cells, plain_text)).where(F.size("_c") >= columns)
    return each.select(key, "row", *[F.get("_c", i).alias(f"c{i + 1}") for i in range(columns)])


def plain_text(html):
    """Text of a piece of HTML."""
    out = F.regexp_replace(html, r"(?s)<[^>]*>", " ")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        out = F.replace(out, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def html_elements(pages: DataFrame, html: str, key: str, tag: str) -> DataFrame:
    """(key, i, attributes, text) of every element of a tag that holds no element of the same tag."""
    whole = F.regexp_extract_all(html, F.lit(rf"(?is)(<{tag}\b[^>]*>.*?</{tag}>)"), F.lit(1))
    each = pages.select(key, F.posexplode(whole).alias("i", "_e"))
    return each.select(key, "i", F.trim(F.regexp_extract("_e", rf"(?is)^<{tag}\b([^>]*)>", 1)).alias("attributes"), plain_text(F.regexp_extract("_e", rf"(?is)^<{tag}\b[^>]*>(.*)</{tag}>$", 1)).alias("text"))


def first_definition(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """The first row of each key, as code tables mean it."""
    from ..operators.labels import first_per

    return first_per(rows, [key], list(order))
