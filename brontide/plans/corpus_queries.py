"""Queries over text corpora: field names, questions, spans, de-duplication, vector mapping."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import calibrate as K
from ..operators import corpus as O
from ..operators import metrics as M
from ..operators.fields import FIELD_SPECS, classify_fields, field_corpus
from ..sources import fields as H
from .registry import Registry, table
from .verification_queries import rounded

R = Registry()
add = R.add
FIELDS = "(VALUES " + ", ".join("(" + ", ".join("NULL" if x is None else f"'{x}'" for x in r) + ")" for r in O.NATIVE_FIELDS) + ") f(name, canonical, statistic, unit)"


def native_names(s, d):
    """Parts as native fields: the size picks a name, with odd case and hyphens."""
    names = F.array(*[F.lit(r[0]) for r in O.NATIVE_FIELDS] + [F.lit("mystery"), F.lit("")])
    n = F.element_at(names, (F.col("p_partkey") % (len(O.NATIVE_FIELDS) + 2) + 1).cast("int"))
    return table(s, d, "part").select("p_partkey", F.when(F.col("p_size") % 2 == 0, F.upper(F.translate(n, "_", "-"))).otherwise(n).alias("name"))


NAMES = "nm AS (SELECT p_partkey, [" + ", ".join(f"'{r[0]}'" for r in O.NATIVE_FIELDS) + f", 'mystery', ''][p_partkey % {len(O.NATIVE_FIELDS) + 2} + 1] AS name FROM part)"


@add("p23_p31_field_lookup", f"WITH {NAMES} SELECT p_partkey, canonical, statistic, unit AS canonical_unit FROM nm LEFT JOIN {FIELDS} ON f.name = nm.name")
def _(s, d):
    return O.look_up_fields(native_names(s, d), "name").drop("name")


UNITS = ["K", "deg  C", "mm", "kg m**-2", "m s^-1", "%", "furlong", None, "hPa", "W/m2", "Kg / Kg", "code table"]
FAMILY = ["temperature", "temperature", "length", "length", "speed", "fraction", "unknown", "categorical", "pressure", "energy_flux", "mixing_ratio", "categorical"]
arr = lambda xs: "[" + ", ".join("NULL" if x is None else f"'{x}'" for x in xs) + "]"


@add("p24_unit_families", f"SELECT p_partkey, {arr(FAMILY)}[p_partkey % 12 + 1] AS family FROM part")
def _(s, d):
    unit = F.get(F.array(*[F.lit(u) for u in UNITS]), (F.col("p_partkey") % 12).cast("int"))
    return table(s, d, "part").select("p_partkey", O.unit_family(unit).alias("family"))


DESCRIPTIONS = [
    "Total precipitation", "Probability of precipitation", "precipitation rate at surface", "Snow depth", "Maximum temperature at 2 m", "TMIN daily", "Dew point at 2 metre", "heat index", "Soil temperature 0-7 cm", "Sea surface temperature",
    "2 metre temperature", "potential temperature", "Wind gust at 10 m", "U-component of wind at 10 m", "northward wind", "wind direction", "Wind speed at 850 hPa", "Relative humidity at 2 m", "specific humidity", "Pressure reduced to MSL",
    "Surface pressure", "downward short-wave radiation", "sunshine duration", "Total cloud cover", "visibility", "Volumetric soil water", "evaporation", "CAPE at surface", "convective inhibition", "lightning flash density",
    "thunderstorm probability", "significant height of wind wave", "very heavy rain and thunderstorm", "dense fog and mist", "Cyclone over sea, very rough", "Widespread rain", "6 hour acc rain", "nothing known", "", "rain and hail, river above danger level",
]
HINTS = "CASE p_partkey % 3 WHEN 0 THEN 'warning' END"


def raw_fields(s, d):
    """Parts as raw fields: the key picks a description, the size a unit and a processing code."""
    k, z = F.col("p_partkey"), F.col("p_size")
    pick = lambda xs, i: F.get(F.array(*[F.lit(x) for x in xs]), i.cast("int"))
    p = table(s, d, "part").select(
        F.lit("part").alias("source_table"), F.lit("x").alias("raw_field"), pick(DESCRIPTIONS, k % len(DESCRIPTIONS)).alias("description"), pick(UNITS, z % len(UNITS)).alias("unit"), F.lit("").alias("level_text"), F.lit("").alias("time_range_text"),
        F.when(z % 4 == 0, z % 12).cast("int").alias("grib_statistical_processing"), F.expr(HINTS).alias("evidence_class_hint"), k.cast("string").alias("source_record_id"))
    return p


strings = lambda xs: "[" + ", ".join(f"'{x}'" for x in xs) + "]::VARCHAR[]"
SPEC_ROWS = ", ".join(f"({i}, '{x.variable}', {strings(x.families)}, '{x.statistic}', {strings(x.keywords)}, {strings(x.anti)}, {strings(x.classes)}, {x.priority})" for i, x in enumerate(FIELD_SPECS))


@add("p25_field_classification", f"""
    WITH spec(i, variable, families, statistic, keywords, without, classes, priority) AS (VALUES {SPEC_ROWS}),
    f AS (
      SELECT p_partkey, trim(({strings(DESCRIPTIONS)})[p_partkey % {len(DESCRIPTIONS)} + 1] || ' x') AS text, {arr(FAMILY)}[p_size % {len(UNITS)} + 1] AS family, {HINTS} AS hint, CASE WHEN p_size % 4 = 0 THEN p_size % 12 END AS code FROM part),
    c AS (
      SELECT f.*, spec.*, list_filter(keywords, lambda w: regexp_matches(text, '(?i)' || w))[1] AS matched FROM f, spec
      WHERE (list_contains(families, family) OR family = 'unknown') AND len(list_filter(without, lambda w: regexp_matches(text, '(?i)' || w))) = 0
        AND CASE WHEN hint = 'warning' THEN list_contains(classes, 'warning') ELSE classes <> ['warning'] END),
    r AS (
      SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY priority DESC, length(matched) DESC, i) AS turn, count(*) OVER (PARTITION BY p_partkey, priority) AS rivals FROM c WHERE matched IS NOT NULL),
    b AS (SELECT * FROM r WHERE turn = 1)
    SELECT f.p_partkey, coalesce(b.variable, 'other') AS canonical_variable, coalesce(CASE WHEN b.statistic IN ('probability', 'categorical') THEN b.statistic ELSE CASE b.code WHEN 0 THEN 'mean' WHEN 4 THEN 'instant' WHEN 8 THEN 'instant' ELSE b.statistic END END, 'instant') AS statistic,
      b.family AS unit_family, CASE WHEN b.rivals > 1 THEN greatest(0.55, round(1 - 0.15 * (b.rivals - 1), 3)) ELSE 1.0 END AS label_confidence, coalesce(b.matched, '') AS matched_on, coalesce(f.hint, 'forecast') AS evidence_class
    FROM f LEFT JOIN b ON b.p_partkey = f.p_partkey""")
def _(s, d):
    out = classify_fields(raw_fields(s, d))
    return out.select(F.col("source_record_id").cast("long").alias("p_partkey"), "canonical_variable", "statistic", "unit_family", "label_confidence", "matched_on", "evidence_class")


@add("p26_accumulation_and_level", """SELECT l_orderkey, l_linenumber, l_partkey, CASE l_linenumber % 4 WHEN 0 THEN CAST(6 AS DOUBLE) WHEN 1 THEN CAST(l_linenumber * 3 AS DOUBLE) WHEN 2 THEN 24.0 END AS hours, CASE l_linenumber % 4 WHEN 0 THEN '2m' WHEN 1 THEN 'mean_sea_level' WHEN 2 THEN 'pressure_level' ELSE 'surface' END AS level FROM lineitem""")
def _(s, d):
    n = F.col("l_linenumber")
    text = F.when(n % 4 == 0, "6-12 hour acc fcst at 2 m").when(n % 4 == 1, F.format_string("rain past %d h, mean sea level", n * 3)).when(n % 4 == 2, "daily total at 850 hPa").otherwise("instant")
    rows = table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", text.alias("text"))
    parsed = rows.select("text").distinct().select("text", O.accumulation_hours("text").alias("hours"), O.vertical_level("text").alias("level"))
    return rows.join(F.broadcast(parsed), "text").drop("text")  # a row for each text, of which there are at most three and one for each line number


QUESTIONS = ["Will it rain tomorrow afternoon?", "Can I spray pesticide in 3 hours?", "wind tonight near the boat", "What is normal temperature next week?", "heavy rain warning day after tomorrow", "should I harvest on 2024-02-10 in the morning", "chance of rain this weekend", "hot today?", "go fishing next 3 days", "weather in Kalimpong"]
DAY = ["CAST(ts AS DATE) + 1", None, "CAST(ts AS DATE)", "CAST(ts AS DATE) + 7", "CAST(ts AS DATE) + 2", "DATE '2024-02-10'", "CAST(ts AS DATE) + CAST(CASE WHEN isodow(ts) = 6 THEN 7 ELSE (6 - isodow(ts) + 7) % 7 END AS INTEGER)", "CAST(ts AS DATE)", "CAST(ts AS DATE)", "CAST(ts AS DATE)"]
START = ["12:00:00", None, "21:00:00", "00:00:00", "00:00:00", "06:00:00", "00:00:00", "00:00:00", "00:00:00", "00:00:00"]
END_DAY = [0, None, 1, 6, 0, 0, 0, 0, 2, 0]
END = ["18:00:00", None, "05:59:59", "23:59:59", "23:59:59", "11:59:59", "23:59:59", "23:59:59", "23:59:59", "23:59:59"]
CONF = [0.9, 0.95, 0.9, 0.7, 0.9, 1.0, 0.9, 0.9, 0.8, 0.6]


def questions(s, d):
    q = F.get(F.array(*[F.lit(x) for x in QUESTIONS]), (F.col("event_id") % 10).cast("int"))
    return table(s, d, "events").select("event_id", q.alias("question"), F.date_trunc("second", "ts").alias("now"), F.lit("short").alias("h"))


def _case(values, form):
    return "CASE event_id % 10 " + " ".join(f"WHEN {i} THEN {form(i)}" for i in range(10) if values[i] is not None) + " END"


@add("p27_time_windows", f"""WITH n AS (SELECT event_id, date_trunc('second', ts) AS ts FROM events), w AS (SELECT event_id, ts, CASE WHEN event_id % 10 = 1 THEN ts + INTERVAL 3 HOUR ELSE {_case(DAY, lambda i: f"CAST({DAY[i]} AS TIMESTAMP) + INTERVAL '{START[i]}'")} END AS valid_from, CASE WHEN event_id % 10 = 1 THEN ts + INTERVAL 4 HOUR ELSE {_case(DAY, lambda i: f"CAST({DAY[i]} + {END_DAY[i]} AS TIMESTAMP) + INTERVAL '{END[i]}'")} END AS valid_to, {_case(CONF, lambda i: CONF[i])} AS confidence FROM n)
    SELECT event_id, CAST(valid_from AS TIMESTAMP) AS valid_from, CAST(valid_to AS TIMESTAMP) AS valid_to, CAST(confidence AS DOUBLE) AS confidence, CASE WHEN event_id % 10 = 1 OR (date_diff('day', ts, valid_from) = 0 AND epoch(valid_to) - epoch(ts) <= 21600) THEN 'nowcast' WHEN date_diff('day', ts, valid_from) <= 3 THEN 'short' WHEN date_diff('day', ts, valid_from) <= 10 THEN 'medium' ELSE 'climate' END AS horizon FROM w""")
def _(s, d):
    return O.time_window(questions(s, d), "question", "now").select("event_id", "valid_from", "valid_to", "confidence", "horizon")


PLAN = [(None, "pa,pp", "forecast", "O"), ("spray", "pa,pp,ws,wg", "forecast,warning", "O,C,I,G"), ("marine", "pa,pp,ws,wg", "forecast,warning", "O,C,I,G"), (None, "t", "forecast,reanalysis", "O,E,N"), (None, "pa,pp", "forecast,warning", "O,C,I"), ("harvest", "pa,pp", "forecast,warning", "O,C,I,G"), (None, "pa,pp", "forecast", "O,G"), (None, "t", "forecast", "O"), ("marine", "pa,pp,ws,wg", "forecast,warning", "O,C,I,G"), (None, "t,pa", "forecast", "O")]


@add("p28_retrieval_plans", f"SELECT event_id, {arr([p[0] for p in PLAN])}[event_id % 10 + 1] AS decision, {arr([p[1] for p in PLAN])}[event_id % 10 + 1] AS variables, {arr([p[2] for p in PLAN])}[event_id % 10 + 1] AS classes, {arr([p[3] for p in PLAN])}[event_id % 10 + 1] AS sources FROM events")
def _(s, d):
    short = {"precipitation_amount": "pa", "precipitation_probability": "pp", "temperature_2m": "t", "wind_speed": "ws", "wind_gust": "wg"}
    m = F.create_map(*[F.lit(x) for kv in short.items() for x in kv])
    p = O.retrieval_plan(questions(s, d), "question", "h")
    return p.select("event_id", "decision", F.array_join(F.transform("variables", lambda v: F.element_at(m, v)), ",").alias("variables"), F.array_join("evidence_classes", ",").alias("classes"), F.array_join(F.transform("sources", lambda v: F.substring(v, 1, 1)), ",").alias("sources"))


@add("p29_decision_domains", f"SELECT event_id, {arr(['travel', 'spray', 'marine', 'travel', 'travel', 'harvest', 'travel', 'travel', 'marine', 'travel'])}[event_id % 10 + 1] AS domain FROM events")
def _(s, d):
    return questions(s, d).select("event_id", O.decision_domain("question").alias("domain"))


@add("p32_rule_parse", f"SELECT event_id, {arr([None] * 9 + ['kalimpong'])}[event_id % 10 + 1] AS place, {arr(['tomorrow afternoon', None, 'tonight', None, 'tomorrow', 'morning', 'this weekend', 'today', 'next 3 days', None])}[event_id % 10 + 1] AS time_phrase, {arr([None, 'pesticide_spraying', None, None, None, None, None, None, 'marine', None])}[event_id % 10 + 1] AS decision FROM events")
def _(s, d):
    return O.rule_parse(questions(s, d), "question", ["nagpur", "kalimpong"]).select("event_id", "place", "time_phrase", "decision")


@add("j22_place_resolution", """SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'coordinates' WHEN 1 THEN 'code' WHEN 2 THEN 'name' WHEN 3 THEN 'ambiguous' ELSE 'not_found' END AS status, CASE event_id % 5 WHEN 0 THEN 21.25 WHEN 1 THEN 10.0 WHEN 2 THEN 11.5 END AS lat, CASE event_id % 5 WHEN 1 THEN 'alpha' WHEN 2 THEN 'new delta' END AS place FROM events""")
def _(s, d):
    texts = F.array(*[F.lit(x) for x in ("rain at 21.25, 79.5 now", "weather for 440001 please", "is New Delta wet", "alpha or new delta?", "somewhere in newdelta")])
    q = table(s, d, "events").select("event_id", F.get(texts, (F.col("event_id") % 5).cast("int")).alias("q"))
    g = s.createDataFrame([("Alpha", "440001", 10.0, 70.0), ("New Delta", None, 11.5, 71.0), ("Gamma", None, 12.0, 72.0)], "name string, code string, lat double, lon double")
    return O.resolve_places(q, "q", g, "event_id").select("event_id", "status", "lat", "place")


NORM = r"regexp_replace(lower(trim(text)), '\s+', ' ', 'g')"


@add("u5_normalised_dedup", f"WITH t AS (SELECT doc_id, row_number() OVER (PARTITION BY {NORM} ORDER BY doc_id) AS i FROM documents) SELECT doc_id FROM t WHERE i = 1")
def _(s, d):
    return O.dedup_normalised(table(s, d, "documents"), "text", ["doc_id"]).select("doc_id")


@add("t5_assembled_corpus", f"WITH b AS (SELECT item_id + 1000000000 AS id, text, TRUE AS old FROM benchmark UNION ALL SELECT doc_id, text, FALSE FROM documents), r AS (SELECT id, {NORM} AS norm, row_number() OVER (PARTITION BY {NORM} ORDER BY old DESC, id) AS i FROM b), p AS (SELECT id, ('0x' || substr(sha1(norm), 1, 8))::UBIGINT % 100 AS p FROM r WHERE i = 1) SELECT CASE WHEN p < 80 THEN 'train' WHEN p < 90 THEN 'val' ELSE 'test' END AS split, count(*) AS n, min(id) AS first FROM p GROUP BY 1")
def _(s, d):
    old = table(s, d, "benchmark").select((F.col("item_id") + 1000000000).alias("id"), "text")
    out = O.assemble(old, table(s, d, "documents").select(F.col("doc_id").alias("id"), "text"), "text", "id", [])
    return out.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first"))


def harvested(s, d):
    """Parts written as published tables of eight forms, some dozens to a file, and read back."""
    k = F.col("p_partkey")
    p = table(s, d, "part").select(k, F.format_string("f%d", k).alias("f"), F.format_string("%s part %d", "p_name", k).alias("long"), F.when(k % 3 != 0, "K").otherwise("").alias("u"), (k % 4 == 0).alias("rare"))

    def files(rows, line, head="", tail="", sep="\n"):
        """One text for each 97th of the keys, lines in order of the key."""
        lines = F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", line.alias("l")))), lambda x: x["l"])
        one = rows.groupBy((k % 97).alias("_f")).agg(lines.alias("_l")).withColumn("doc", F.format_string("%05d", "_f"))
        return one.select("doc", F.concat(F.lit(head), F.array_join("_l", sep), F.lit(tail)).alias("text"))

    block = lambda key, body="": files(p, F.concat(F.lit("# note\n'"), key, F.lit("' = {"), body if not isinstance(body, str) else F.lit(body), F.lit("\n\t}")))
    body = F.concat(F.lit("\n\t discipline = 0 ;\n\t typeOfFirstFixedSurface = "), F.when(F.col("rare"), "103").otherwise("101"), F.lit(" ;\n\t scaledValueOfFirstFixedSurface = 2 ;\n\t typeOfStatisticalProcessing = 1 ;"))
    grid = H.grid_definitions(block(F.col("f"), body), block(F.col("long")), block(F.col("u")), block(k.cast("string")))
    xml = files(p, F.concat(F.lit('<entry id="'), F.col("f"), F.lit('"><canonical_units>'), F.col("u"), F.lit("</canonical_units><description>"), F.when(F.col("rare"), "").otherwise(F.col("long")), F.lit("</description></entry>")), '<?xml version="1.0"?><table>', "</table>")
    state = files(p, F.concat(F.lit("state real "), F.col("f"), F.lit(' ij misc 1 - - "'), F.upper("f"), F.lit('" "'), F.when(F.col("rare"), "").otherwise(F.col("long")), F.lit('" "'), F.col("u"), F.lit('"')), "# registry\n")
    cells = files(p, F.concat(F.lit("<tr><td>1</td><td>"), F.col("long"), F.lit("</td><td>"), F.when(F.col("u") == "", "-").otherwise(F.col("u")), F.lit("</td><td><a>"), F.when(F.col("rare"), "two words").otherwise(F.col("f")), F.lit("</a></td></tr>")), "<table><tr><th>Number</th><th>Parameter</th><th>Units</th><th>Abbrev</th></tr>", "</table>")
    lines = files(p, F.concat(F.lit("1:0:d=2024010100:"), F.col("f"), F.lit(":2 m above ground:0-6 hour acc fcst:"), F.lit("\n2:9:d=2024010100:"), F.col("f"), F.lit(":2 m above ground:0-6 hour acc fcst:")), "no line\n")
    element = files(p, F.concat(F.lit("001|"), F.when(F.col("rare"), "").otherwise(F.col("f")), F.lit("|table|"), F.upper("long"), F.lit("|"), F.when(F.col("u") == "", "Code Table").otherwise(F.col("u")), F.lit("|0")), "# code|abbreviation|type|name|unit\n")
    alert = p.select(F.concat(F.lit("<cap:alert><cap:sender>s</cap:sender><cap:info><cap:event>"), F.format_string("event %d", k % 50), F.lit("</cap:event><cap:headline>"), F.col("long"), F.lit("</cap:headline></cap:info></cap:alert>")).alias("text"))
    own = p.where("rare").select(F.col("f").alias("name"), F.col("long").alias("description"), F.col("u").alias("unit"), F.when(k % 8 == 0, "warning").alias("hint"))
    return H.harvest(grid, H.standard_names(xml), H.model_registry(state), H.inventories(lines, H.parameter_pages(cells)), H.element_tables(element), H.alert_events(alert), H.provider_fields(own, "open_meteo"), H.provider_fields(own, "imd_products"))


HARVEST = """p AS (SELECT p_partkey AS k, 'f' || p_partkey AS f, p_name || ' part ' || p_partkey AS long, CASE WHEN p_partkey % 3 <> 0 THEN 'K' END AS u, p_partkey % 4 = 0 AS rare FROM part),
  raw AS (
    SELECT 'grib2_eccodes' AS source_table, f AS raw_field, long AS description, u AS unit, CASE WHEN rare THEN '2 m above ground' ELSE 'mean_sea_level' END AS level_text, '' AS time_range_text, 1 AS grib_statistical_processing, NULL AS evidence_class_hint, CAST(k AS VARCHAR) AS source_record_id FROM p
    UNION ALL SELECT 'cf_standard_names', f, CASE WHEN rare THEN f ELSE long END, u, '', '', NULL, NULL, f FROM p
    UNION ALL SELECT 'wrf_registry', f, long, u, '', '', NULL, NULL, f FROM p WHERE NOT rare
    UNION ALL SELECT 'ncep_gfs_idx', f, CASE WHEN rare THEN '' ELSE long END, CASE WHEN NOT rare THEN u END, '2 m above ground', '0-6 hour acc fcst', NULL, NULL, f || '|2 m above ground|0-6 hour acc fcst' FROM p
    UNION ALL SELECT 'bufr_wmo', f, array_to_string(list_transform(string_split(lower(long), ' '), lambda w: upper(w[1]) || w[2:]), ' '), u, '', '', NULL, NULL, f FROM p WHERE NOT rare
    UNION ALL SELECT 'cap_sachet', 'event ' || e, long, NULL, '', '', NULL, 'warning', 'cap:event ' || e FROM (SELECT k % 50 AS e, long, row_number() OVER (PARTITION BY k % 50 ORDER BY length(long) DESC, long) AS i FROM p) WHERE i = 1
    UNION ALL SELECT s, f, long, CASE WHEN u IS NULL THEN '' ELSE u END, '', long, NULL, CASE WHEN k % 8 = 0 THEN 'warning' END, f FROM p, (VALUES ('open_meteo'), ('imd_products')) t(s) WHERE rare)"""


@add("s17_field_harvest", f"WITH {HARVEST} SELECT * FROM raw")
def _(s, d):
    return harvested(s, d)


@add("t6_s17_field_corpus", f"""
    WITH {HARVEST}, k AS (SELECT *, lower(raw_field) || '|' || lower(coalesce(unit, '')) || '|' || lower(level_text) || '|' || lower(time_range_text) AS key FROM raw)
    SELECT source_table, raw_field, source_record_id, CASE WHEN source_table IN ('cf_standard_names', 'grib2_eccodes', 'cap_sachet') THEN CASE WHEN ('0x' || substr(sha1(key), 1, 8))::UBIGINT % 100 < 12 THEN 'val' ELSE 'train' END
      WHEN source_table IN ('bufr_wmo', 'open_meteo', 'imd_products') THEN 'dev_zeroshot' ELSE 'test_zeroshot' END AS split FROM k""")
def _(s, d):
    return field_corpus(harvested(s, d)).select("source_table", "raw_field", "source_record_id", "split")


SLOT = r"""sl AS (SELECT conv_id, turn, text, regexp_extract(text, '\S+\s+(\S+)', 1) AS w FROM conversations)"""


def slots(s, d):
    c = table(s, d, "conversations").select(F.concat_ws("/", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("id"), "text", F.regexp_extract("text", r"\S+\s+(\S+)", 1).alias("w"))
    return c.withColumn("w", F.when(F.length("w") % 4 == 0, F.concat("w", F.lit("zz"))).otherwise(F.col("w")))


@add(
    "t1_slot_spans",
    f"""WITH {SLOT}, x AS (
      SELECT conv_id || '/' || turn AS id, trim(text) AS text, trim(CASE WHEN length(w) % 4 = 0 THEN w || 'zz' ELSE w END) AS w, CASE WHEN length(w) % 3 = 0 THEN upper(w) END AS u FROM sl),
    p AS (SELECT *, instr(text, w) AS p, instr(text, u) AS q FROM x),
    r AS (SELECT *, CASE WHEN coalesce(text, '') = '' THEN 'missing_field' WHEN coalesce(w, '') = '' OR p = 0 OR (u <> '' AND q = 0) THEN 'slot_not_substring' END AS reject_reason FROM p)
    SELECT id, CASE WHEN reject_reason IS NULL THEN p - 1 END AS start, reject_reason FROM r""",
)
def _(s, d):
    given = F.regexp_extract("text", r"\S+\s+(\S+)", 1)
    t = slots(s, d).withColumn("u", F.when(F.length(given) % 3 == 0, F.upper(given)))
    o = O.slot_spans(t, "text", {"word": "w", "loud": "u"}, ["loud"])
    return o.select("id", F.get("spans", 0)["start"].cast("long").alias("start"), "reject_reason")


@add("t2_bio_tags", r"""WITH w AS (SELECT conv_id || '/' || turn AS id, regexp_extract_all(text, '\S+') AS w FROM conversations) SELECT id, len(w) AS tokens, CAST(least(len(w), 1) AS BIGINT) AS b, CAST(greatest(least(len(w), 2) - 1, 0) AS BIGINT) AS i FROM w WHERE len(w) > 1""")
def _(s, d):
    t = O.tokens_with_offsets(slots(s, d), "text", "id")
    two = t.groupBy("id").agg(F.max(F.when(F.col("i") == 0, F.col("start"))).alias("start"), F.max(F.when(F.col("i") == 1, F.col("end"))).alias("end")).where("end IS NOT NULL").withColumn("slot", F.lit("place"))
    tags = O.bio_tags(t.join(two.select("id"), "id"), two, "id")
    return tags.select("id", F.size("tokens").cast("long").alias("tokens"), F.size(F.filter("tags", lambda x: x.startswith("B"))).cast("long").alias("b"), F.size(F.filter("tags", lambda x: x.startswith("I"))).cast("long").alias("i"))


@add("t3_bio_spans", r"""WITH w AS (SELECT conv_id || '/' || turn AS id, regexp_extract_all(text, '\S+') AS w FROM conversations) SELECT id, 'place' AS slot, CAST(0 AS INTEGER) AS first, CAST(1 AS INTEGER) AS last FROM w WHERE len(w) > 1 UNION ALL SELECT id, 'time', 2, 2 FROM w WHERE len(w) > 2""")
def _(s, d):
    w = F.regexp_extract_all("text", F.lit(r"\S+"), F.lit(0))
    c = slots(s, d).select("id", w.alias("tokens")).where(F.size("tokens") > 1)
    tags = F.transform("tokens", lambda x, i: F.when(i == 0, "B-place").when(i == 1, "I-place").when(i == 2, "B-time").otherwise("O"))
    return O.bio_spans(c.withColumn("tags", tags), "id").select("id", "slot", "first", "last")


@add("m19_slot_f1", r"""WITH w AS (SELECT conv_id, turn, len(regexp_extract_all(text, '\S+')) AS n FROM conversations), g AS (SELECT sum(CASE WHEN n > 1 THEN 1 ELSE 0 END + CASE WHEN n > 2 THEN 1 ELSE 0 END) AS gold, sum(CASE WHEN n > 1 THEN 1 ELSE 0 END) AS found FROM w) SELECT CAST(gold AS BIGINT) AS gold, CAST(found AS BIGINT) AS found, CAST(found AS BIGINT) AS "right", 1.0 AS precision, round(found / gold, 6) AS recall, round(2.0 * found / (gold + found), 6) AS f1 FROM g""")
def _(s, d):
    w = F.regexp_extract_all("text", F.lit(r"\S+"), F.lit(0))
    c = slots(s, d).select("id", w.alias("tokens")).where(F.size("tokens") > 1)
    gold = F.transform("tokens", lambda x, i: F.when(i == 0, "B-place").when(i == 1, "I-place").when(i == 2, "B-time").otherwise("O"))
    said = F.transform("tokens", lambda x, i: F.when(i == 0, "B-place").when(i == 1, "I-place").otherwise("O"))
    spans = lambda t: O.bio_spans(c.withColumn("tags", t), "id").select("id", F.col("first").alias("start"), F.col("last").alias("end"), "slot")
    return rounded(M.slot_f1(spans(gold), spans(said), "id"))


@add(
    "m19_label_sets",
    r"""WITH w AS (SELECT conv_id % 5 AS language, list_distinct(list_transform(regexp_extract_all(text, '\S+'), lambda x: left(x, 1))) AS t, list_distinct(list_transform(regexp_extract_all(text, '\S+'), lambda x: right(x, 1))) AS p FROM conversations),
    e AS (SELECT language, unnest(list_distinct(list_concat(t, p))) AS c, t, p FROM w),
    k AS (SELECT language, c, sum(CAST(list_contains(t, c) AS INT)) AS g, sum(CAST(list_contains(p, c) AS INT)) AS s, sum(CAST(list_contains(t, c) AND list_contains(p, c) AS INT)) AS b FROM e GROUP BY ALL),
    f AS (SELECT language, round(2 * sum(b) / (sum(g) + sum(s)), 6) AS micro_f1, round(avg(2 * b / (g + s)), 6) AS macro_f1 FROM k GROUP BY 1),
    n AS (SELECT language, count(*) AS n, round(avg(CASE WHEN list_sort(t) = list_sort(p) THEN 1.0 ELSE 0 END), 6) AS exact_match FROM w GROUP BY 1 HAVING count(*) >= 25)
    SELECT * FROM n JOIN f USING (language)""",
)
def _(s, d):
    words = F.regexp_extract_all("text", F.lit(r"\S+"), F.lit(0))
    c = table(s, d, "conversations").select((F.col("conv_id") % 5).alias("language"), F.transform(words, lambda w: F.left(w, F.lit(1))).alias("t"), F.transform(words, lambda w: F.right(w, F.lit(1))).alias("p"))
    return rounded(M.label_sets(c, "t", "p", ["language"], 25))


@add("t4_templates")
def _(s, d):
    t = s.createDataFrame([(i, x) for i, x in enumerate(("Will it rain in {place} {time}?", "Wind at {place} {time}", "{time} in {place}: spray or wait?"))], "template_id int, template string")
    f = table(s, d, "customer").select(F.col("c_custkey").alias("filler_id"), F.col("c_name").alias("place"), F.lower("c_mktsegment").alias("time"))
    return O.from_templates(t, f, 25)


def centroids(s, d):
    """Mean vector of each class, over positions."""
    e = table(s, d, "embeddings").select("label", F.posexplode("embedding").alias("i", "x"))
    m = e.groupBy("label", "i").agg(F.round(F.avg(F.col("x").cast("double")), 6).alias("m"))
    return m.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("i", "m"))).alias("_v")).select("label", F.col("_v.m").alias("vector"))


MAPPED = """e AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings), x AS (SELECT label, unnest(v) AS x, unnest(range(1, len(v) + 1)) AS i FROM e), m AS (SELECT label, i, round(avg(x), 6) AS m FROM x GROUP BY ALL), c AS (SELECT label, list(m ORDER BY i) AS c FROM m GROUP BY 1),
  s AS (SELECT vec_id, e.label, CAST(c.label AS VARCHAR) AS l, round(list_cosine_similarity(v, c), 9) AS s FROM e, c), r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, l DESC) AS i FROM s)"""


@add("f16_vector_mapping", f"WITH {MAPPED} SELECT vec_id, CASE WHEN s >= 0.3 THEN l ELSE 'unknown' END AS mapped, l AS nearest, round(s, 6) AS similarity FROM r WHERE i = 1")
def _(s, d):
    m = K.map_by_vectors(table(s, d, "embeddings"), centroids(s, d), "vec_id", "embedding", "label", 0.3)
    return rounded(m.select("vec_id", "mapped", "nearest", "similarity"))


@add("m18_mapping_scores", f"WITH {MAPPED}, t AS (SELECT CAST(label AS VARCHAR) AS t, CASE WHEN s >= 0.3 THEN l ELSE 'unknown' END AS p FROM r WHERE i = 1) SELECT count(*) AS n, round(avg(CASE WHEN t = p THEN 1.0 ELSE 0 END), 6) AS accuracy, round(sum(CASE WHEN t = p AND t <> 'unknown' THEN 1 ELSE 0 END) / nullif(sum(CASE WHEN t <> 'unknown' THEN 1 ELSE 0 END), 0), 6) AS mapped_accuracy, round(avg(CASE WHEN p <> 'unknown' AND t <> p THEN 1.0 ELSE 0 END), 6) AS misassigned FROM t")
def _(s, d):
    e = table(s, d, "embeddings")
    m = K.map_by_vectors(e, centroids(s, d), "vec_id", "embedding", "label", 0.3).join(e.select("vec_id", F.col("label").cast("string").alias("t")), "vec_id")
    return rounded(M.classification(m, "t", "mapped").select("n", "accuracy", "mapped_accuracy", "misassigned"))


@add("f17_abstention_threshold")
def _(s, d):
    e = table(s, d, "embeddings")
    m = K.map_by_vectors(e, centroids(s, d), "vec_id", "embedding", "label", 0.0).join(e.select("vec_id", "label"), "vec_id")
    return K.abstention_threshold(m, "label", "nearest", "similarity")
