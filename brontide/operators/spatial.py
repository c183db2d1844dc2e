"""Grids and places: nearest nodes, pixel boxes, bilinear samples, neighbourhoods, gradients. No theta joins: keys are exploded cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .nearest import k_nearest


def nearest_node(places: DataFrame, nodes: DataFrame, key="point_id", node="node_id", wrap: float | None = None) -> DataFrame:
    """(key, node, dist2): the nearest node of each place by equirectangular squared distance, ties to the smaller id.

    Longitudes do not go around, unless ``wrap`` = 360 says so. A place is one key; of several rows the smallest counts.
    """
    p = places.where(F.col("lat").isNotNull() & F.col("lon").isNotNull()).groupBy(F.col(key).alias("key")).agg(F.min(F.struct("lat", "lon")).alias("_p"))
    p = p.select("key", F.col("_p.lon").alias("x"), F.col("_p.lat").alias("y"), F.cos(F.radians("_p.lat")).alias("w"))
    n = nodes.select(F.col(node).alias("id"), F.col("lon").alias("x"), F.col("lat").alias("y"))
    return k_nearest(p, n, 1, wrap).select(F.col("key").alias(key), F.col("id").alias(node), "dist2")


def reference_nodes(points: DataFrame, is_node: str, key="point_id") -> DataFrame:
    """(key, ref_id): the node whose climatology a point uses: its own for a node, the nearest one's for any other point."""
    nodes = points.where(is_node).select(F.col(key).alias("ref_id"), "lat", "lon")
    nearest = nearest_node(points.where(f"NOT {is_node}"), nodes, key, "ref_id").select(key, "ref_id")
    return nearest.unionByName(points.where(is_node).select(key, F.col(key).alias("ref_id")))


def box_pixels(points: DataFrame, step: float, top: float, west: float, half: int, lat="lat", lon="lon") -> DataFrame:
    """Each point with every (row, col) of the box of ``half`` pixels around its own; rounding is half to even."""
    row, column = F.bround((F.lit(top) - F.col(lat)) / step, 0).cast("int"), F.bround((F.col(lon) - F.lit(west)) / step, 0).cast("int")
    around = F.sequence(F.lit(-half), F.lit(half))
    return points.withColumn("_r", F.explode(around)).withColumn("_c", F.explode(around)).withColumns({"row": row + F.col("_r"), "col": column + F.col("_c")}).drop("_r", "_c")


def cells_of_points(points: DataFrame, pixels: DataFrame, step: float, top: float, west: float, half: int) -> DataFrame:
    """Range join of points and pixels as an equi join on the exploded boxes."""
    return box_pixels(points, step, top, west, half).join(pixels, ["row", "col"])


def bilinear(points: DataFrame, grid: DataFrame, fields: list[str], keys: list[str], step: float, top: float, west: float, lat="lat", lon="lon", key="point_id", shape: tuple[int, int] | None = None) -> DataFrame:
    """Fields at points from the four grid neighbours; null neighbours drop out and the weights are scaled up; null if all are.

    With ``shape`` (rows, columns) a point beyond the grid takes the values of its edge; without, only one less than a cell beyond it does.
    """
    y, x = (F.lit(top) - F.col(lat)) / step, (F.col(lon) - F.lit(west)) / step
    p = points.withColumns({"_y": y, "_x": x}).withColumns({"_r0": F.floor("_y").cast("int"), "_c0": F.floor("_x").cast("int")})
    if shape:
        inside = lambda c, n: F.least(F.greatest(F.col(c), F.lit(0)), F.lit(n - 2))
        p = p.withColumns({"_r0": inside("_r0", shape[0]), "_c0": inside("_c0", shape[1])})
    fy, fx = F.col("_y") - F.col("_r0"), F.col("_x") - F.col("_c0")
    if shape:
        fy, fx = (F.least(F.greatest(f, F.lit(0.0)), F.lit(1.0)) for f in (fy, fx))
    corners = [(r, c) for r in (0, 1) for c in (0, 1)]
    weight = lambda r, c: (fy if r else 1 - fy) * (fx if c else 1 - fx)
    four = F.array(*[F.struct((F.col("_r0") + r).alias("row"), (F.col("_c0") + c).alias("col"), weight(r, c).alias("w")) for r, c in corners])
    p = p.select(key, F.explode(four).alias("_q")).select(key, "_q.*").where("w > 0")
    out = []
    for f in fields:
        w = F.sum(F.when(F.col(f).isNotNull(), F.col("w")))
        out.append(F.try_divide(F.sum(F.col("w") * F.col(f)), w).alias(f))
    return p.join(grid, ["row", "col"]).groupBy(key, *keys).agg(*out)


def _edges(df: DataFrame, keys: list[str], axis: str, half: int) -> DataFrame:
    """The first and last line repeated ``half`` times outward."""
    w = Window.partitionBy(*keys)
    df = df.withColumns({"_lo": F.min(axis).over(w), "_hi": F.max(axis).over(w)})
    outside = F.sequence(F.lit(1), F.lit(half))
    up = F.when(F.col(axis) == F.col("_lo"), F.transform(outside, lambda i: F.col(axis) - i)).otherwise(F.array().cast("array<int>"))
    down = F.when(F.col(axis) == F.col("_hi"), F.transform(outside, lambda i: F.col(axis) + i)).otherwise(F.array().cast("array<int>"))
    df = df.withColumn("_pad", F.explode(F.concat(F.array(F.col(axis)), up, down)))
    return df.withColumn("_real", F.col("_pad") == F.col(axis)).withColumn(axis, F.col("_pad")).drop("_pad", "_lo", "_hi")


def neighbourhood(grid: DataFrame, keys: list[str], field: str, size: int, at_least: float | None = None, missing: float | None = 0.0) -> DataFrame:
    """Mean, max, min, sd and (with ``at_least``) share over size x size cells, edges repeated.

    A cell without a value counts as ``missing``; with None it counts for nothing.
    Rows first, then columns: 2 * size cells are read for each, not size ** 2.
    """
    half = size // 2
    known = F.when(~F.isnan(F.col(field).cast("double")), F.col(field))
    value = known if missing is None else F.coalesce(known, F.lit(missing))
    base = grid.select(*keys, "row", "col", value.alias("_v"), (value * value).alias("_v2"), F.when(value.isNotNull(), 1.0).alias("_k"), (F.when(value >= at_least, 1.0).when(value.isNotNull(), 0.0) if at_least is not None else F.lit(None).cast("double")).alias("_e"))
    a = _edges(base, [*keys, "row"], "col", half)
    w = Window.partitionBy(*keys, "row").orderBy("col").rangeBetween(-half, half)
    a = a.select(*keys, "row", "col", "_real", F.sum("_v").over(w).alias("_v"), F.sum("_v2").over(w).alias("_v2"), F.sum("_k").over(w).alias("_k"), F.sum("_e").over(w).alias("_e"), F.max("_v").over(w).alias("_hi"), F.min("_v").over(w).alias("_lo")).where("_real").drop("_real")
    b = _edges(a.withColumnsRenamed({"_lo": "_least", "_hi": "_most"}), [*keys, "col"], "row", half).withColumnsRenamed({"_least": "_lo", "_most": "_hi"})
    w = Window.partitionBy(*keys, "col").orderBy("row").rangeBetween(-half, half)
    n = F.sum("_k").over(w)
    mean = F.sum("_v").over(w) / n
    out = b.select(*keys, "row", "col", "_real", mean.alias("nb_mean"), F.max("_hi").over(w).alias("nb_max"), F.min("_lo").over(w).alias("nb_min"), F.sqrt(F.greatest(F.sum("_v2").over(w) / n - mean * mean, F.lit(0.0))).alias("nb_sd"), *([(F.sum("_e").over(w) / n).alias("nb_share")] if at_least is not None else []))
    return out.where("_real").drop("_real")


# Fixed value: metres in a degree of latitude.
DEGREE_M = 111_320.0


def gradient(grid: DataFrame, keys: list[str], fields: list[str], step: float, top: float) -> DataFrame:
    """d<field>_dx and d<field>_dy per metre, centred, one-sided at edges; east-west spacing shrinks with latitude and rows run southward."""
    metre = DEGREE_M * step
    lat = F.lit(top) - F.col("row") * step
    dx = metre * F.cos(F.radians(lat))
    along, down = Window.partitionBy(*keys, "row").orderBy("col"), Window.partitionBy(*keys, "col").orderBy("row")

    def slope(f: str, w, gap: Column | float, sign: int) -> Column:
        before, after = F.lag(f).over(w), F.lead(f).over(w)
        first, last = F.lag(F.lit(1)).over(w).isNull(), F.lead(F.lit(1)).over(w).isNull()
        centred = (after - before) / (2 * gap)
        return sign * F.when(first & last, F.lit(None).cast("double")).when(first, (after - F.col(f)) / gap).when(last, (F.col(f) - before) / gap).otherwise(centred)

    out = {}
    for f in fields:
        out[f"d{f}_dx"] = slope(f, along, dx, 1)
        out[f"d{f}_dy"] = slope(f, down, metre, -1)
    return grid.withColumns(out)


def kinematics(grid: DataFrame, keys: list[str], u: str, v: str, step: float, top: float, q: str | None = None, height: str | None = None) -> DataFrame:
    """Vorticity, divergence and, where given, moisture-flux convergence and upslope flow."""
    fields = [u, v]
    if q:
        grid = grid.withColumns({"_qu": F.col(q) * F.col(u), "_qv": F.col(q) * F.col(v)})
        fields += ["_qu", "_qv"]
    g = gradient(grid, keys, fields + ([height] if height else []), step, top)
    out = {"vorticity": F.col(f"d{v}_dx") - F.col(f"d{u}_dy"), "divergence": F.col(f"d{u}_dx") + F.col(f"d{v}_dy")}
    if q:
        out["moisture_convergence"] = -(F.col("d_qu_dx") + F.col("d_qv_dy"))
    if height:
        out["upslope"] = F.col(u) * F.col(f"d{height}_dx") + F.col(v) * F.col(f"d{height}_dy")
    return g.withColumns(out).select(*grid.columns, *out).drop("_qu", "_qv")


def pressure_gradient(grid: DataFrame, keys: list[str], pressure: str, step: float, top: float) -> DataFrame:
    """pgrad_hpa100km: how steeply a pressure in Pa changes, in hPa over 100 km."""
    g = gradient(grid, keys, [pressure], step, top)
    return g.select(*grid.columns, (F.hypot(f"d{pressure}_dx", f"d{pressure}_dy") * 1e3).alias("pgrad_hpa100km"))


def terrain(grid: DataFrame, height: str, step: float, top: float, keys: list[str] = ()) -> DataFrame:
    """Descriptors of each cell's ground in metres: height (0 where unknown), its slopes, roughness over 5 and 9 cells, relief, and height above its surroundings."""
    keys = list(keys)
    known = F.when(~F.isnan(F.col(height).cast("double")), F.col(height))
    g = grid.select(*keys, "row", "col", F.coalesce(known, F.lit(0.0)).alias("hgt"))
    at = [*keys, "row", "col"]
    near, far = (neighbourhood(g, keys, "hgt", size) for size in (5, 9))
    near = near.select(*at, F.col("nb_sd").alias("elev_std_5"))
    far = far.select(*at, F.col("nb_sd").alias("elev_std_9"), (F.col("nb_max") - F.col("nb_min")).alias("relief_9"), F.col("nb_mean").alias("_mean9"))
    out = gradient(g, keys, ["hgt"], step, top).withColumnsRenamed({"dhgt_dx": "dzdx", "dhgt_dy": "dzdy"}).join(near, at).join(far, at)
    return out.withColumns({"slope": F.hypot("dzdx", "dzdy"), "elev_minus_nb9": F.col("hgt") - F.col("_mean9")}).drop("_mean9")


def edge_cells(cells: DataFrame) -> DataFrame:
    """Cells (row, col) that lack one of their four neighbours."""
    steps = F.explode(F.array(*[F.struct((F.col("row") + r).alias("row"), (F.col("col") + c).alias("col")) for r, c in ((0, 1), (0, -1), (1, 0), (-1, 0))]))
    closed = cells.select(steps.alias("_s")).select("_s.*").groupBy("row", "col").agg(F.count(F.lit(1)).alias("_n")).where("_n = 4").drop("_n")
    return cells.join(closed, ["row", "col"], "left_anti")


def coast_distance(cells: DataFrame, land: str = "land") -> DataFrame:
    """Distance of every cell, in cells, to the nearest cell of the other kind, however far; null only if there is none.

    The nearest cell of a kind is one of its edge cells: the neighbour on the way to it
    would be nearer. So each kind looks for its nearest among the edges of the other, by blocks of
    them; the grid may be ragged or sparse. A cell that is given as both kinds counts as both.
    """
    known = cells.where(F.col("row").isNotNull() & F.col("col").isNotNull() & F.col(land).isNotNull()).select(F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), F.col(land).alias("_land")).distinct()
    found = None
    for kind in (True, False):
        mine, other = (known.where(F.col("_land") == k).select("row", "col") for k in (kind, not kind))
        nodes = edge_cells(other).select(F.struct("row", "col").alias("_c")).select(F.shiftleft(F.col("_c.row"), 32).bitwiseXOR(F.col("_c.col").bitwiseAND(F.lit(0xFFFFFFFF))).alias("id"), F.col("_c.col").alias("x"), F.col("_c.row").alias("y"))
        place = F.shiftleft(F.col("row"), 32).bitwiseXOR(F.col("col").bitwiseAND(F.lit(0xFFFFFFFF)))
        got = k_nearest(mine.select(place.alias("key"), F.col("col").alias("x"), F.col("row").alias("y"), F.lit(1.0).alias("w")), nodes).select("key", F.lit(kind).alias("_kind"), "dist2")
        found = got if found is None else found.unionByName(got)
    key = F.shiftleft(cells["row"].cast("long"), 32).bitwiseXOR(cells["col"].cast("long").bitwiseAND(F.lit(0xFFFFFFFF)))
    out = cells.join(found, (key == found["key"]) & (cells[land] == found["_kind"]), "left")
    return out.select(*[cells[c] for c in cells.columns], F.sqrt("dist2").alias("coast_cells"))
