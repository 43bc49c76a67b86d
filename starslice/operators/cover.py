"""Point in polygon over an adaptive cover: square cells that split where a polygon has many edges.

Cells lie on grids whose sides are powers of two, so their corners are exact in any unit and no size has to be chosen for degrees or metres. A
polygon begins with the cells, four at most, that its box touches. A cell with more than ``most`` edges splits into four. For the lower right corner of
each cell it is known whether it is inside; a point's answer differs from it by the parity of the edges between the two, and only edges
that touch the cell can lie there. So a cell without edges is wholly inside or outside, and no point meets an edge outside its cell.

The lookup cuts a leaf with more than ``FEW`` edges once more, into a fixed grid of squares, so that most places are answered by a square without edges.

Parities are ``bit_xor`` aggregates, so neither a huge ring nor a dense cell is gathered: edges stay rows until a leaf takes them in pieces of
about ``most``. Cells that are still too full ``levels`` below the first (many edges through one point) have several pieces.

A point on an edge or a corner is inside as the half-open ray rule says: rays go to larger x, a vertex at the ray's height counts as below it.
Points without coordinates match nothing; polygons of no width or height hold no point.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starslice.operators.geo import bounding_boxes, edges
from starslice.runtime import settle

CELL = ["geom", "e", "ix", "iy"]  # a cell of side 2 ** e
EDGE = ["seq", "x1", "y1", "x2", "y2"]
BANDS = 8  # of a leaf's height; changes cost, not results
FEW = 4  # edges that are tested without a loop over an array; changes cost, not results
CUT = 3  # levels that the lookup cuts a leaf of more edges by; changes cost, not results
CUTS = 2  # times that it does so, the second time where a square has more edges still; changes cost, not results


def _side(e: Column) -> Column:
    return F.pow(F.lit(2.0), e)


def _spans(g: dict[str, Column], y: Column) -> Column:
    return (g["y1"] > y) != (g["y2"] > y)


def _right_of(g: dict[str, Column], x: Column, y: Column) -> Column:
    """Whether the edge meets the ray that starts at (x, y); the crossing is clamped to the edge's own reach."""
    at = g["x1"] + (y - g["y1"]) * (g["x2"] - g["x1"]) / F.nullif(g["y2"] - g["y1"], F.lit(0.0))
    at = F.greatest(F.least(g["x1"], g["x2"]), F.least(F.greatest(g["x1"], g["x2"]), at))
    return _spans(g, y) & (x < F.coalesce(at, x))


def _xor(*flags: Column) -> Column:
    return reduce(lambda a, b: a != b, flags)


def _between(g: dict[str, Column], cx: Column, cy: Column, x: Column, y: Column) -> Column:
    """Parity of the edge between the corner (cx, cy) and (x, y): along the height of the point, then along the corner's side.

    The height at which an edge crosses the side is only ever compared through the ray test itself, so both ways round agree in rounding too.
    """
    return _xor(_along(g, cx, x, y), ((g["x1"] > cx) != (g["x2"] > cx)) & _up(g, cx, cy, y))


def _along(g: dict[str, Column], cx: Column, x: Column, y: Column) -> Column:
    return _spans(g, y) & _xor(_right_of(g, x, y), _right_of(g, cx, y))


def _up(g: dict[str, Column], cx: Column, cy: Column, y: Column) -> Column:
    """For an edge that crosses the corner's side."""
    right = F.when(g["x1"] > cx, g["y1"]).otherwise(g["y2"])  # height of the end beyond the side
    return _xor(_right_of(g, cx, cy), right > cy, _right_of(g, cx, y), right > y)


def _touches(g: dict[str, Column], x0: Column, y0: Column, side: Column) -> Column:
    """Whether the edge may touch the closed cell; a little is added to each side, as a spare edge costs nothing and a lost one does."""
    pad = side * 1e-6
    lo_x, lo_y, hi_x, hi_y = x0 - pad, y0 - pad, x0 + side + pad, y0 + side + pad
    apart = (
        (F.greatest(g["x1"], g["x2"]) < lo_x) | (F.least(g["x1"], g["x2"]) > hi_x)
        | (F.greatest(g["y1"], g["y2"]) < lo_y) | (F.least(g["y1"], g["y2"]) > hi_y)
    )
    dx, dy = g["x2"] - g["x1"], g["y2"] - g["y1"]
    mid = dx * ((lo_y + hi_y) / 2 - g["y1"]) - dy * ((lo_x + hi_x) / 2 - g["x1"])
    return ~apart & (F.abs(mid) <= (F.abs(dx) + F.abs(dy)) * (side / 2 + pad))


def _columns() -> dict[str, Column]:
    return {c: F.col(c) for c in EDGE[1:]}


def _first(all_edges: DataFrame, boxes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The cells that each polygon's box touches, with the answer for their corners, and their edges."""
    wide = boxes.filter("x1 > x0 AND y1 > y0").withColumn("e", F.ceil(F.log2(F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")))).cast("int"))
    at = lambda c: F.floor(F.col(c) / _side(F.col("e")))
    cells = wide.select("geom", "e", F.explode(F.sequence(at("x0"), at("x1"))).alias("ix"), at("y0").alias("lo"), at("y1").alias("hi"))
    cells = settle(cells.select("geom", "e", "ix", F.explode(F.sequence("lo", "hi")).alias("iy")), "cover-first")
    side, g = _side(F.col("e")), _columns()
    met = all_edges.join(cells, "geom")
    ray = _right_of(g, (F.col("ix") + 1) * side, F.col("iy") * side)
    touch = _touches(g, F.col("ix") * side, F.col("iy") * side, side)
    known = met.groupBy(*CELL).agg((F.bit_xor(ray.cast("int")) == 1).alias("inside"), F.count_if(touch).alias("n"))
    return known.withColumn("floor", F.col("e")), met.filter(touch).select(*CELL, *EDGE)


def _split(cells: DataFrame, held: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The four parts of each cell, and their edges."""
    side, g = _side(F.col("e") - 1), _columns()
    rows = held.join(cells.select(*CELL, "inside", "floor"), CELL)
    corner = (F.col("ix") + 1) * side * 2, F.col("iy") * side * 2
    parts = [(F.col("ix") * 2 + i, F.col("iy") * 2 + j) for j in (0, 1) for i in (0, 1)]
    between = [_between(g, *corner, (x + 1) * side, y * side) for x, y in parts]
    flips = rows.groupBy(*CELL, "inside", "floor").agg(*[(F.bit_xor(b.cast("int")) == 1).alias(f"f{k}") for k, b in enumerate(between)])
    made = F.inline(F.array(*[F.struct(x.alias("cx"), y.alias("cy"), _xor(F.col("inside"), F.col(f"f{k}")).alias("answer")) for k, (x, y) in enumerate(parts)]))
    fresh = flips.select("geom", (F.col("e") - 1).alias("e"), "floor", made).withColumnsRenamed({"cx": "ix", "cy": "iy", "answer": "inside"})
    near = F.filter(F.array(*[F.when(_touches(g, x * side, y * side, side), F.struct(x.alias("cx"), y.alias("cy"))) for x, y in parts]), lambda p: p.isNotNull())
    moved = rows.select("geom", (F.col("e") - 1).alias("e"), *EDGE, F.inline(near)).withColumnsRenamed({"cx": "ix", "cy": "iy"})
    moved = settle(moved.select(*CELL, *EDGE), "cover-edges")
    sizes = moved.groupBy(*CELL).agg(F.count("*").alias("n"))
    return fresh.join(sizes, CELL, "left").withColumn("n", F.coalesce("n", F.lit(0))), moved


def polygon_cover(vertices: DataFrame, most: int = 32, levels: int = 12) -> DataFrame:
    """(geom, e, ix, iy, inside, pieces, edges): the leaves of the cover. ``inside`` is the answer for the lower right corner.

    A leaf without edges is wholly inside. ``pieces`` is the number of rows a leaf has; each holds about ``most`` edges at most.
    """
    all_edges = settle(edges(vertices).withColumn("seq", F.xxhash64("part", "ring", "seq")).select("geom", *EDGE), "cover-rings")
    cells, held = _first(all_edges, bounding_boxes(vertices))
    cells, held = settle(cells, "cover-cells"), settle(held, "cover-edges")
    leaves = []  # one scan a level
    while True:
        full = (F.col("n") > most) & (F.col("e") > F.col("floor") - levels)
        done = cells.filter(~full & (F.col("inside") | (F.col("n") > 0))).withColumn("pieces", F.greatest(F.ceil(F.col("n") / most), F.lit(1)))
        piece = F.pmod(F.xxhash64("seq"), F.col("pieces")).alias("piece")
        lists = (
            held.join(done.select(*CELL, "pieces"), CELL).groupBy(*CELL, piece)
            .agg(F.collect_list(F.struct(*EDGE[1:])).alias("edges"))
        )
        leaves.append(settle(done.select(*CELL, "inside", "pieces").join(lists.drop("piece"), CELL, "left"), "cover"))
        cells = cells.filter(full)
        if not cells.limit(1).count():
            return reduce(DataFrame.unionByName, leaves)
        cells, held = _split(cells, held)
        cells = settle(cells, "cover-cells")


def _band(y: Column) -> Column:
    side = _side(F.col("e"))
    band = F.floor((y - F.col("iy") * side) / side * BANDS)
    return F.greatest(F.lit(0), F.least(F.lit(BANDS - 1), band)).cast("int")


def _banded(cover: DataFrame) -> DataFrame:
    """A row for each leaf and band of its height: the edges that reach into the band, and those of the leaf that cross the corner's side.

    A point's height and an edge's ends get their bands by the same rising expression, so an edge at a point's height is in its band.
    """
    cx = (F.col("ix") + 1) * _side(F.col("e"))
    edges = F.coalesce("edges", F.array().cast("array<struct<x1:double,y1:double,x2:double,y2:double>>"))
    bands = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda b: F.filter(
        edges, lambda g: (_band(F.least(g["y1"], g["y2"])) <= b) & (_band(F.greatest(g["y1"], g["y2"])) >= b)))
    crossing = F.filter(edges, lambda g: (g["x1"] > cx) != (g["x2"] > cx))
    return cover.select(*CELL, "inside", crossing.alias("crossing"), F.posexplode(bands).alias("band", "beside"))


def _past(g: dict[str, Column], x: Column, y: Column, cx: Column) -> Column:
    """A flag for each place of a cell whose right side is at cx: it differs between two places as the parity of the edge between them does.

    It is that of ``_between``, put together: the ray test, and for each end of the edge beyond the side whether it lies above the place.
    """
    return _xor(_right_of(g, x, y), (g["x1"] > cx) & (g["y1"] > y), (g["x2"] > cx) & (g["y2"] > y))


def _few(x: Column, y: Column, cx: Column) -> Column:
    """``_past`` of all edges of a row with ``FEW`` at most, written out, as functions on arrays run without generated code."""
    def flag(i: int) -> Column:
        x1, y1, x2, y2, lo, hi = (F.col(f"{c}_{i}") for c in [*EDGE[1:], "lo", "hi"])
        at = x1 + (y - y1) * (x2 - x1) / (y2 - y1)  # as in _right_of, and computed only where the heights differ
        ray = F.when((y1 > y) != (y2 > y), (x < lo) | ((x < hi) & (x < at))).otherwise(F.lit(False))
        return _xor(ray, (x1 > cx) & (y1 > y), (x2 > cx) & (y2 > y))

    odd = F.lit(False)
    for i in reversed(range(FEW)):
        odd = F.when(F.col("n") > i, _xor(flag(i), odd)).otherwise(F.lit(False))
    return odd


def _flat(cells: DataFrame) -> DataFrame:
    """Cells of ``FEW`` edges at most with a column for each coordinate; ``base`` is the answer where the edges' flags agree."""
    ends = {f"{c}_{i}": F.coalesce(F.get("edges", F.lit(i))[c], F.lit(0.0)) for i in range(FEW) for c in EDGE[1:]}
    ends |= {f"{c}_{i}": f(ends[f"x1_{i}"], ends[f"x2_{i}"]) for i in range(FEW) for c, f in (("lo", F.least), ("hi", F.greatest))}
    rows = cells.select(*CELL, "inside", F.coalesce(F.size("edges"), F.lit(0)).alias("n"), *[v.alias(k) for k, v in ends.items()], _side(F.col("e")).alias("side"))
    rows = rows.withColumn("cx", F.coalesce((F.col("ix") + 1) * F.col("side"), F.lit(0.0)))
    base = _xor(F.col("inside"), _few(F.col("cx"), F.col("iy") * F.col("side"), F.col("cx")))
    return rows.withColumn("base", F.coalesce(base, F.lit(False))).drop("inside", "side")


def _cut(leaves: DataFrame) -> DataFrame:
    """(geom, e, ix, iy, inside, edges): each leaf in 4 ** CUT squares, without the empty ones outside.

    A row of squares is one group: bits for the answers at the squares' corners, and the edges with the first and last square that they touch.
    """
    wide, g, parts = 2 ** CUT, _columns(), int(leaves.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    x1, y1, x2, y2 = g.values()
    side = F.col("side")
    cx = (F.col("ix") + 1) * side
    # a row without edges has one that is missing, whose bits are none
    none = F.array(F.lit(None).cast("struct<x1:double,y1:double,x2:double,y2:double>"))
    met = leaves.withColumn("side", _side(F.col("e"))).repartition(parts, *CELL).select(*CELL, "inside", "side", F.inline(F.concat("edges", none)))
    met = met.withColumn("corner", _past(g, cx, F.col("iy") * side, cx)).withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(wide - 1))))
    part, first, line = side / wide, F.col("ix") * wide, F.col("iy") * wide + F.col("j")
    low = line * part
    # _past at the corners of a row: those left of the edge are as many as whole squares fit, as the sides are powers of two
    at = F.greatest(F.least(x1, x2), F.least(F.greatest(x1, x2), x1 + (low - y1) * (x2 - x1) / F.nullif(y2 - y1, F.lit(0.0))))
    left = F.greatest(F.lit(0), F.least(F.lit(wide), F.ceil(at / part) - first - 1)).cast("int")
    ray = F.when(_spans(g, low), F.call_function("shiftleft", F.lit(1), left) - 1).otherwise(0)
    rest = F.when(_xor(F.col("corner"), (x1 > cx) & (y1 > low), (x2 > cx) & (y2 > low)), 2 ** wide - 1).otherwise(0)
    # the reach of the edge within the row, with the spare of _touches
    pad = part * 1e-6
    reach = [x1 + (level - y1) * (x2 - x1) / F.nullif(y2 - y1, F.lit(0.0)) for level in (F.greatest(F.least(y1, y2), low - pad), F.least(F.greatest(y1, y2), low + part + pad))]
    ends = [F.when(y1 == y2, x).otherwise(F.greatest(F.least(x1, x2), F.least(F.greatest(x1, x2), r))) for x, r in zip((x1, x2), reach)]
    here = lambda x: F.greatest(F.lit(-1), F.least(F.lit(wide), F.floor(x / part) - first)).cast("int")
    met = met.withColumns({"flip": ray.bitwiseXOR(rest), "close": (F.greatest(y1, y2) >= low - pad) & (F.least(y1, y2) <= low + part + pad)})
    met = met.withColumns({"lo": here(F.least(*ends) - pad), "hi": here(F.greatest(*ends) + pad)})
    kept = F.when(F.col("close"), F.struct("lo", "hi", *EDGE[1:]))
    rows = met.filter(x1.isNull() | F.col("close") | (F.col("flip") != 0)).groupBy(*CELL, "inside", "j").agg(F.bit_xor("flip").alias("flip"), F.collect_list(kept).alias("near"))
    bit = F.call_function("shiftleft", F.lit(1), F.col("i"))
    squares = rows.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(wide - 1)))).select(
        "geom", (F.col("e") - CUT).alias("e"), (first + F.col("i")).alias("ix"), line.alias("iy"),
        _xor(F.col("inside"), F.col("flip").bitwiseAND(bit) != 0).alias("inside"),
        F.transform(F.filter("near", lambda t: (t["lo"] <= F.col("i")) & (t["hi"] >= F.col("i"))), lambda t: F.struct(*[t[c] for c in EDGE[1:]])).alias("edges"))
    return squares.filter(F.col("inside") | (F.size("edges") > 0))


def locate(points: DataFrame, cover: DataFrame) -> DataFrame:
    """(point columns, geom) for each point and polygon around it. ``points`` has x and y.

    A point looks up the one cell of each side that the cover has (as many as it has levels), by equality: in leaves with few edges and in squares that other
    leaves are cut into. Leaves, and squares of many edges, are cut into bands. All are dealt to all tasks, however few bytes points and cover have, as each may
    hold very many pairs; so neither side is broadcast.
    """
    n, shape = F.coalesce(F.size("edges"), F.lit(0)), [*CELL, "inside", "edges"]
    full = (F.col("pieces") == 1) & (n > FEW)
    kinds = F.when(full, "full").when(F.col("pieces") == 1, "few").otherwise("dense")
    sides: dict[str, list[int]] = {}
    for r in cover.select(kinds.alias("kind"), "e").distinct().collect():  # a few whole numbers
        sides.setdefault(r["kind"], []).append(r["e"])
    if not sides:
        return points.join(cover.select("geom"), F.lit(False))
    to = lambda c, e: F.floor(F.col(c) / _side(e))
    e, x, y = F.col("e"), F.col("x"), F.col("y")
    parts = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    band = [F.lit(b) for b in range(BANDS)]

    def met(rows: DataFrame, cells: DataFrame, at: list[int], key: list[str]) -> DataFrame:
        """Rows beside the cells that hold them; a hash leads the key, as rows are sorted by its first column soonest."""
        spread = rows.withColumn("e", F.explode(F.array(*[F.lit(k) for k in sorted(at)]))).withColumns({"ix": to("x", e), "iy": to("y", e)})
        both = [(t.withColumn("band", _band(y)) if "band" in key and t is spread else t).withColumn("cell", F.xxhash64(*key)) for t in (spread, cells)]
        left, right = [t.repartition(parts, "cell", *key) for t in both]
        return left.join(right.hint("merge"), ["cell", *key])

    known = points.filter("x IS NOT NULL AND y IS NOT NULL AND NOT isnan(x) AND NOT isnan(y)")
    known = known.withColumns({c: F.coalesce(c, F.lit(0).cast(points.schema[c].dataType)) for c in ("x", "y")})  # none is missing; so the planner knows it
    cell, banded, out = CELL[1:], [*CELL[1:], "band"], [*points.columns, "geom"]
    cx, cy = (F.col("ix") + 1) * _side(e), F.col("iy") * _side(e)
    along = F.aggregate("beside", F.lit(False), lambda a, g: _xor(a, _along(g, cx, x, y)))
    odd = F.aggregate("crossing", along, lambda a, g: _xor(a, _up(g, cx, cy, y)))
    within = _xor(F.col("base"), _few(x, y, F.col("cx")))
    found = []
    if "few" in sides:
        leaves = _flat(cover.filter((F.col("pieces") == 1) & (n <= FEW)).select(*shape)).withColumn("band", F.explode(F.array(*band)))
        found.append(met(known, leaves, sides["few"], banded).filter(within).select(*out))
    left, at, fine, reached = cover.filter(full).select(*shape), sides.get("full", []), [], set()
    for _ in range(CUTS):
        if at:
            squares, reached = settle(_cut(left), "cover-squares"), reached | {k - CUT for k in at}
            fine, left = [*fine, squares.filter(n <= FEW)], squares.filter(n > FEW)
            at = [r["e"] for r in left.select("e").distinct().collect()]
    if fine:
        found.append(met(known, _flat(reduce(DataFrame.unionByName, fine)), [*reached], cell).filter(within).select(*out))
    if at:
        found.append(met(known, _banded(left), at, banded).filter(_xor(F.col("inside"), odd)).select(*out))
    if "dense" in sides:
        # the pieces of a dense cell answer together, once for each place
        places = met(known.select("x", "y").distinct(), _banded(cover.filter("pieces > 1")), sides["dense"], banded)
        agreed = places.groupBy("geom", "x", "y", "inside").agg((F.bit_xor(odd.cast("int")) == 1).alias("odd")).filter(_xor(F.col("inside"), F.col("odd")))
        found.append(known.join(agreed.select("x", "y", "geom"), ["x", "y"]).select(*out))
    return reduce(DataFrame.unionByName, found)


def point_in_polygon(points: DataFrame, vertices: DataFrame, most: int = 32, levels: int = 12) -> DataFrame:
    """(point columns, geom) for every point inside a polygon, holes excluded."""
    return locate(points, polygon_cover(vertices, most, levels))
