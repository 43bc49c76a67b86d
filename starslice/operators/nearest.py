"""The nearest neighbours of every entity: a tree of grid cells descended by whole groups of places.

Equal positions are one place with its smallest entities. Cells with more than ``most`` places split, so a leaf holds that many at most, however
dense the data are. Every leaf asks for the neighbours of all its places at once: it starts with all top cells, and each round replaces
asked cells by their parts and keeps those that can matter. From the boxes of two cells follow the least and the greatest distance
between their places; the greatest distances within which enough places lie bound what the leaf needs, and cells whose least distance is
beyond are left out. In the end the places of a leaf meet those of its few leaves, joined by equality.

The distance is equirectangular at the asking entity: differences of longitude shrink by the cosine of its latitude, so it isn't symmetric.
Ties go to the smaller entity. Rows without an entity or a position are left out; an entity's several rows are several entities.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from starslice.runtime import settle

KEY = ["e", "ix", "iy"]
BOX = ["x0", "x1", "y0", "y1"]
STEP = 2  # a cell splits into 2 ** STEP parts a side


def _cell(e: Column) -> list[Column]:
    side = F.pow(F.lit(2.0), e)
    return [e.cast("int").alias("e"), F.floor(F.col("lon") / side).alias("ix"), F.floor(F.col("lat") / side).alias("iy")]


def _tree(places: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """Nodes (cell, n, box, leaf) of all levels, and the places with their leaf."""
    ends = places.agg(F.max(F.greatest(F.abs("lon"), F.abs("lat"))).alias("far")).first()  # one number
    top = max(0, int(ends["far"] or 0).bit_length())
    nodes, homes, held, e = [], [], places, F.lit(top)
    while True:
        held = settle(held.select(*_cell(e), "lon", "lat", "ids"), "nearest-open")
        box = [F.min("lon").alias("x0"), F.max("lon").alias("x1"), F.min("lat").alias("y0"), F.max("lat").alias("y1")]
        level = settle(held.groupBy(*KEY).agg(F.count("*").alias("n"), *box).withColumn("leaf", F.col("n") <= most), "nearest-nodes")
        nodes.append(level)
        homes.append(held.join(level.filter("leaf").select(*KEY), KEY))
        if not level.filter("NOT leaf").limit(1).count():
            both = [frames[0] for frames in (nodes, homes)]
            for frames, k in ((nodes, 0), (homes, 1)):
                for more in frames[1:]:
                    both[k] = both[k].unionByName(more)
            return both[0], settle(both[1], "nearest-homes")
        held = held.join(level.filter("NOT leaf").select(*KEY), KEY)
        top -= STEP
        e = F.lit(top)


def _gap(lo: Column, hi: Column, to_lo: Column, to_hi: Column) -> Column:
    return F.greatest(F.lit(0.0), to_lo - hi, lo - to_hi)


def _reach(lo: Column, hi: Column, to_lo: Column, to_hi: Column) -> Column:
    return F.greatest(to_hi - lo, hi - to_lo)


def _bounds() -> tuple[Column, Column]:
    """The least and the greatest squared distance from a place of the leaf (q..) to one of the cell, with room for rounding."""
    q, c = [F.col(f"q{b}") for b in BOX], [F.col(b) for b in BOX]
    south, north = (F.cos(F.radians(v)) for v in (q[2], q[3]))
    narrow = F.least(F.abs(south), F.abs(north))
    wide = F.when((q[2] <= 0) & (q[3] >= 0), F.lit(1.0)).otherwise(F.greatest(F.abs(south), F.abs(north)))
    least = F.pow(_gap(q[0], q[1], c[0], c[1]) * narrow, 2) + F.pow(_gap(q[2], q[3], c[2], c[3]), 2)
    most = F.pow(_reach(q[0], q[1], c[0], c[1]) * wide, 2) + F.pow(_reach(q[2], q[3], c[2], c[3]), 2)
    return least * (1 - 1e-9), most * (1 + 1e-9)


def _asked(nodes: DataFrame, need: int) -> DataFrame:
    """(qe, qix, qiy, cell): for each leaf, the leaves that can hold one of the ``need`` places nearest to a place of it."""
    own = ["qe", "qix", "qiy", *[f"q{b}" for b in BOX]]
    nodes = settle(nodes, "nearest-tree")
    leaves = nodes.filter("leaf").select(*[F.col(c).alias(f"q{c}") for c in [*KEY, *BOX]])
    high = nodes.agg(F.max("e")).first()[0]
    if high is None:
        return leaves.select("qe", "qix", "qiy").withColumns({"e": F.col("qe"), "ix": F.col("qix"), "iy": F.col("qiy")})
    below = nodes.withColumns({"pe": F.col("e") + STEP, "px": F.floor(F.col("ix") / 2**STEP), "py": F.floor(F.col("iy") / 2**STEP)})
    # four top cells at most, as the side is more than any coordinate
    tops = nodes.filter(F.col("e") == high).agg(F.collect_list(F.struct(*KEY, *BOX, "n", "leaf"))).scalar()
    asked = leaves.select("*", F.inline(tops))
    least, most = _bounds()
    by_most = Window.partitionBy("qe", "qix", "qiy").orderBy("most", *KEY).rowsBetween(Window.unboundedPreceding, 0)
    all_of = Window.partitionBy("qe", "qix", "qiy")
    while True:
        rows = asked.withColumns({"least": least, "most": most}).withColumn("within", F.sum("n").over(by_most))
        rows = rows.withColumn("bound", F.min(F.when(F.col("within") >= need, F.col("most"))).over(all_of))
        kept = settle(rows.filter("bound IS NULL OR least <= bound").select(*own, *KEY, *BOX, "n", "leaf"), "nearest-asked")
        if not kept.filter("NOT leaf").limit(1).count():
            return kept.select("qe", "qix", "qiy", *KEY)
        parts = kept.filter("NOT leaf").select(*own, *[F.col(c).alias(f"p{c[-1]}") for c in KEY]).join(below, ["pe", "px", "py"])
        asked = kept.filter("leaf").unionByName(parts.select(*kept.columns))


def nearest_all(entities: DataFrame, k: int = 5, most: int = 16) -> DataFrame:
    """(entity, neighbor, dist, pos): the ``k`` entities nearest to each one of ``entities`` (entity, lon, lat), from position 1.

    ``dist`` is squared, in degrees of latitude, as for one entity.
    """
    known = entities.select("entity", F.col("lon").cast("double").alias("lon"), F.col("lat").cast("double").alias("lat"))
    known = known.filter("entity IS NOT NULL AND lon IS NOT NULL AND lat IS NOT NULL AND NOT isnan(lon) AND NOT isnan(lat) AND abs(lon) <= 1e6 AND abs(lat) <= 90")
    known = settle(known, "nearest-entities")
    # of one place no more than its k + 1 smallest entities can be anyone's neighbours; the limit is applied before the shuffle, too
    first = Window.partitionBy("lon", "lat").orderBy("entity")
    few = known.withColumn("_at", F.row_number().over(first)).filter(F.col("_at") <= k + 1)
    places = few.groupBy("lon", "lat").agg(F.sort_array(F.collect_list("entity")).alias("ids"))
    nodes, homes = _tree(places, most)
    asked = _asked(nodes, k + 1)
    me = homes.select(*[F.col(c).alias(f"q{c}") for c in KEY], F.col("lon").alias("qlon"), F.col("lat").alias("qlat"))
    pairs = asked.join(me, ["qe", "qix", "qiy"]).join(homes, KEY)
    dist = F.pow((F.col("lon") - F.col("qlon")) * F.cos(F.radians("qlat")), 2) + F.pow(F.col("lat") - F.col("qlat"), 2)
    close = pairs.select("qlon", "qlat", dist.alias("dist"), F.explode("ids").alias("neighbor"))
    order = Window.partitionBy("qlon", "qlat").orderBy("dist", "neighbor")
    best = close.withColumn("_at", F.row_number().over(order)).filter(F.col("_at") <= k + 1)
    lists = best.groupBy("qlon", "qlat").agg(F.sort_array(F.collect_list(F.struct("dist", "neighbor"))).alias("near"))
    rows = known.join(lists, (F.col("lon") == F.col("qlon")) & (F.col("lat") == F.col("qlat")))
    others = F.slice(F.filter("near", lambda r: r["neighbor"] != F.col("entity")), 1, k)
    return rows.select("entity", F.posexplode(others).alias("_pos", "r")).select("entity", "r.neighbor", "r.dist", (F.col("_pos") + 1).alias("pos"))
