"""Harvest of published parameter tables into one table of raw fields (see operators.fields.RAW_FIELD).

Each reader takes a table of texts (doc, text), one row for each file, and
returns rows of RAW_FIELD; ``harvest`` puts them together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.fields import RAW_FIELD
from ..operators.labels import first_per
from .tables import html_table, inventory

_COLUMNS = [c.split() for c in RAW_FIELD.split(", ")]
# Level codes of grid files.
SURFACES = {
    1: "surface", 2: "cloud_base", 3: "cloud_top", 4: "level_of_0c_isotherm", 6: "max_wind_level", 7: "tropopause", 8: "nominal_top", 9: "sea_bottom", 10: "column", 20: "isothermal_level",
    100: "pressure_level", 101: "mean_sea_level", 102: "mean_sea_level", 103: "height_above_ground", 104: "sigma_level", 105: "hybrid_level", 106: "soil", 107: "potential_vorticity_surface",
    108: "pressure_above_ground", 109: "potential_vorticity_surface", 160: "depth_below_sea", 200: "column", 220: "boundary_layer",
}


def _shaped(df: DataFrame, source: str, **columns: Column) -> DataFrame:
    columns["source_table"] = F.lit(source)
    empty = {"level_text": F.lit(""), "time_range_text": F.lit("")}
    return df.select(*[columns.get(n, empty.get(n, F.lit(None))).cast(t).alias(n) for n, t in _COLUMNS])


def _strip(x: Column) -> Column:
    """Without white space of any kind at the ends."""
    return F.regexp_replace(x, r"^\s+|\s+$", "")


def _blank(x: Column) -> Column:
    return F.nullif(_strip(x), F.lit(""))


def _number(x: Column) -> Column:
    return F.when(x.rlike(r"^\d+$"), x.cast("int"))


def definition_blocks(files: DataFrame, text: str = "text") -> DataFrame:
    """(i, comment, key, body map) of the blocks  # comment / 'key' = { a = b; ... }  of definition files, in order of file and place."""
    block = r"(?m)^#(.*)\n'((?:[^'\\]|\\.)*)'\s*=\s*\{([^}]*)\}"
    each = files.select("doc", F.posexplode(F.regexp_extract_all(text, F.lit(block), F.lit(0))).alias("_at", "_b"))
    part = lambda i: F.regexp_extract("_b", block, i)
    pairs = F.filter(F.split(part(3), ";"), lambda x: F.contains(x, F.lit("=")))
    body = F.map_from_entries(F.array_distinct(F.transform(pairs, lambda x: F.struct(_strip(F.substring_index(x, "=", 1)).alias("k"), _strip(F.regexp_replace(x, r"^[^=]*=", "")).alias("v")))))
    number = F.row_number().over(Window.partitionBy("doc").orderBy("_at")) - 1
    return each.select("doc", number.alias("i"), _strip(part(1)).alias("comment"), _strip(part(2)).alias("key"), body.alias("body"))


def grid_definitions(short_names: DataFrame, names: DataFrame, units: DataFrame, ids: DataFrame) -> DataFrame:
    """Four definition files, or sets of files with the same doc names, whose blocks stand in the same order; short names, names and units with unequal numbers of blocks are refused."""
    blocks = [definition_blocks(f) for f in (short_names, names, units, ids)]
    counts = [b.count() for b in blocks[:3]]
    if len(set(counts)) > 1:
        raise ValueError(f"blocks do not stand side by side: {counts}")
    s, n, u, p = blocks
    on = ["doc", "i"]
    j = s.join(n.select(*on, F.col("key").alias("_name")), on).join(u.select(*on, F.col("key").alias("_unit")), on).join(p.select(*on, F.col("key").alias("_id")), on, "left")
    value = lambda k: F.try_element_at("body", F.lit(k))
    surface, height = _number(value("typeOfFirstFixedSurface")), value("scaledValueOfFirstFixedSurface")
    level = F.coalesce(*[F.when(surface == k, F.lit(v)) for k, v in SURFACES.items()], F.lit(""))
    level = F.when((surface == 103) & height.rlike(r"^[1-9]\d*$|^0\d*$"), F.concat(height, F.lit(" m above ground"))).otherwise(level)
    return _shaped(j, "grib2_eccodes", raw_field=F.col("key"), description=F.coalesce(_blank(F.col("_name")), F.col("comment")), unit=_blank(F.col("_unit")), level_text=level, grib_statistical_processing=_number(value("typeOfStatisticalProcessing")), source_record_id=F.col("_id"))


def standard_names(files: DataFrame, text: str = "text") -> DataFrame:
    """XML table of standard names: entry id, canonical_units, description (the name itself where it is missing)."""
    entry = "entry array<struct<_id:string, canonical_units:string, description:string>>"
    e = files.select(F.explode(F.from_xml(F.regexp_replace(text, r"<\?xml[^>]*\?>", ""), entry)["entry"]).alias("e")).select("e.*").where("_id IS NOT NULL AND _id <> ''")
    name = F.replace(F.col("_id"), F.lit("_"), F.lit(" "))
    return _shaped(e, "cf_standard_names", raw_field=F.col("_id"), unit=_blank(F.col("canonical_units")), description=F.coalesce(_blank(F.col("description")), name), source_record_id=F.col("_id"))


def model_registry(files: DataFrame, text: str = "text") -> DataFrame:
    """State lines of a model's registry:  state type name dims ... "NAME" "description" "unit" ; those without description go."""
    line = r'^\s*state\s+\S+\s+(\w+)\s+\S+.*?"([^"]*)"\s+"([^"]*)"\s+"([^"]*)"'
    one = files.select(F.explode(F.split(text, r"\r?\n")).alias("_l")).where(F.col("_l").rlike(line))
    part = lambda i: _strip(F.regexp_extract("_l", line, i))
    return _shaped(one.where(part(3) != ""), "wrf_registry", raw_field=part(1), description=part(3), unit=_blank(part(4)), source_record_id=part(1))


def parameter_pages(pages: DataFrame, text: str = "text") -> DataFrame:
    """(abbreviation, description, unit) of HTML code tables; the first row of an abbreviation counts, placeholders for no unit are null."""
    t = html_table(pages, text, "doc", 4)
    fine = (F.col("c4") != "") & (F.col("c2") != "") & ~F.contains(F.col("c4"), F.lit(" ")) & ~F.lower("c4").isin("abbrev", "-")
    one = first_per(t.where(fine), ["c4"], ["doc", "row"])
    return one.select(F.col("c4").alias("abbreviation"), F.col("c2").alias("description"), F.when(~F.col("c3").isin("-", "", "see", "Code table"), F.col("c3")).alias("unit"))


def inventories(files: DataFrame, parameters: DataFrame, text: str = "text") -> DataFrame:
    """Distinct (name, level, time range) of inventory lines, described by a table of ``parameter_pages``."""
    lines = inventory(files.select(F.explode(F.split(text, r"\r?\n")).alias("value"))).select(*[_strip(F.col(c)).alias(c) for c in ("abbreviation", "level", "time_range")]).distinct()
    j = lines.join(parameters, "abbreviation", "left")
    return _shaped(j, "ncep_gfs_idx", raw_field=F.col("abbreviation"), description=F.coalesce("description", F.lit("")), unit=F.col("unit"), level_text=F.col("level"), time_range_text=F.col("time_range"), source_record_id=F.concat_ws("|", "abbreviation", "level", "time_range"))


def element_tables(files: DataFrame, text: str = "text") -> DataFrame:
    """Lines code|abbreviation|type|name|unit|... ; comments and lines without name go, units that name a table are null."""
    lines = files.select(F.explode(F.split(text, r"\r?\n")).alias("_l")).select(F.split("_l", r"\|").alias("p")).where((F.size("p") >= 5) & ~F.startswith(F.get("p", F.lit(0)), F.lit("#")))
    part = lambda i: _strip(F.get("p", F.lit(i)))
    unit = F.when(F.lower(part(4)).isin("numeric table", "flag table", "code table"), F.lit(None)).otherwise(part(4))
    return _shaped(lines.where((part(1) != "") & (part(3) != "")), "bufr_wmo", raw_field=part(1), description=F.initcap(part(3)), unit=unit, source_record_id=part(1))


def alert_events(alerts: DataFrame, text: str = "text") -> DataFrame:
    """The event names of CAP alerts, each with its longest headline (of equal ones the first in order)."""
    xml = F.regexp_replace(F.regexp_replace(text, r"<\?xml[^>]*\?>", ""), r"(</?)cap:", "$1")
    a = alerts.select(F.from_xml(xml, "info array<struct<event:string, headline:string>>")["info"][0].alias("i"))
    e = a.select(_strip(F.col("i.event")).alias("event"), F.coalesce(_strip(F.col("i.headline")), F.lit("")).alias("headline")).where("event <> ''")
    one = first_per(e.withColumn("_n", -F.length("headline")), ["event"], ["_n", "headline"])
    return _shaped(one, "cap_sachet", raw_field=F.col("event"), description=F.substring(F.coalesce(_blank(F.col("headline")), F.col("event")), 1, 400), evidence_class_hint=F.lit("warning"), source_record_id=F.concat(F.lit("cap:"), "event"))


def provider_fields(fields: DataFrame, source: str) -> DataFrame:
    """A provider's own names (name, description, unit, hint), whose description is their time range too."""
    return _shaped(fields, source, raw_field=F.col("name"), description=F.col("description"), unit=F.col("unit"), time_range_text=F.col("description"), evidence_class_hint=F.col("hint"), source_record_id=F.col("name"))


def harvest(*parts: DataFrame) -> DataFrame:
    """All raw fields in one table."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
