"""Composite reports: leaderboard, trends, season mix, head-to-head, records, cards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starslice.operators import aggregates as A
from starslice.operators import ranking as K
from starslice.operators import series as S
from starslice.plans import metrics as M
from starslice.plans.spec import SliceSpec
from starslice.runtime import ratio
from starslice.sources.star import Star, partial_periods


# -- trends -------------------------------------------------------------------------
def trend_lines(star: Star, spec: SliceSpec, entities: list, mode: str = "count", may_be_partial: bool = True) -> DataFrame:
    """(line, season_year, value): the scope total plus one line per chosen entity.

    ``count`` hides the total when entities are chosen; ``per_sqmi`` divides by the area;
    ``index`` sets the first positive value to 100 and leaves partial periods out unless
    only spring is shown or the species has none (``may_be_partial``).
    """
    free = spec.patch(region="")
    dense = star.measures(free, {"v": free}, keep_seasons=True)
    scope = F.col("region") == spec.region if spec.region else F.lit(True)
    chosen = F.col("entity").isin(*entities) if entities else F.lit(False)
    shown = F.filter(
        F.array(
            F.when(scope & F.lit(mode != "count" or not entities), "total"),
            F.when(chosen, F.col("entity").cast("string")),
        ),
        lambda x: x.isNotNull(),
    )
    lines = (
        dense.filter(spec.period_predicate()).withColumn("line", F.explode(shown))
        .groupBy("line", "season_year").agg(F.sum("v").alias("v"), F.sum("area").alias("area"))
    )
    if mode == "per_sqmi":
        return lines.select("line", "season_year", ratio("v", "area").alias("value"))
    if mode == "index":
        if may_be_partial and spec.season != "spring":
            partial = partial_periods(dense).withColumn("_partial", F.lit(True))
            lines = lines.join(partial, "season_year", "left").withColumn("v", F.when(F.col("_partial").isNull(), F.col("v")))
        return lines.select("line", "season_year", S.index_100("v", "line").alias("value"))
    return lines.select("line", "season_year", F.col("v").cast("double").alias("value"))


def compare_species(whole: Star, spec: SliceSpec, pair: tuple[str, str], may_be_partial: tuple[str, ...] | None = None) -> DataFrame:
    """Two species on the union of their periods, each indexed to its first full period.

    Only the period range, region and method of the slice apply to both lines. Both lines and the
    test for partial periods come from one pass over the fact. ``may_be_partial`` names the species that are tested (all
    where it isn't given); a period of another one counts whole.
    """
    reduced = SliceSpec(method=spec.method)
    rows = A.in_region(whole, spec.region).filter(F.col("species").isin(*pair))
    kept = rows.groupBy("species", "season_year").agg(
        F.bool_or(F.col("season") == "fall").alias("full"),
        F.sum(F.when(reduced.category_predicate() & F.col("_in"), F.col("cnt")).otherwise(0)).alias("v"),
    ).filter(spec.period_predicate())
    whole_period = F.col("full") if may_be_partial is None else F.col("full") | ~F.col("species").isin(*may_be_partial)
    value = kept.withColumn("v", F.when(whole_period, F.col("v"))).withColumn("value", S.index_100("v", "species"))
    side = lambda sp: F.max(F.when(F.col("species") == sp, F.col("value")))
    return value.groupBy("season_year").agg(side(pair[0]).alias("first"), side(pair[1]).alias("second"))


# -- places -------------------------------------------------------------------------
def percent_mix(star: Star, spec: SliceSpec, keys: list[str], year: int) -> DataFrame:
    """Share of each portion inside a place, for portions present in at least one of the places."""
    members = A.places(star, keys).select("place", "entity")
    rows = star.slice(spec.patch(region="", year_from=year, year_to=year))
    sums = rows.groupBy("entity", "portion").agg(F.sum("cnt").alias("v")).join(members, "entity")
    cells = sums.groupBy("portion").pivot("place", keys).agg(F.sum("v")).fillna(0)
    columns = [F.col(f"`{k}`") for k in keys]
    present = F.exists(F.array(*columns), lambda v: v > 0)
    mixed = cells.filter(present).unpivot(["portion"], columns, "place", "v")
    return S.share(mixed, "v", "pct", ("place",)).select("place", "portion", (F.col("pct") * 100).alias("pct"))


def default_pair(now: DataFrame, home) -> DataFrame:
    """Side A is the home entity or the leader; side B the best entity that is not A."""
    best = now.orderBy(F.desc("v"), "entity").limit(2).agg(
        F.sort_array(F.collect_list(F.struct((-F.col("v")).alias("o"), "entity"))).alias("t")
    )
    first, second = F.col("t")[0]["entity"].cast("string"), F.col("t")[1]["entity"].cast("string")
    if home is None:
        return best.select(F.lit("none").alias("home"), first.alias("a"), second.alias("b"))
    me = F.lit(str(home))
    return best.select(me.alias("home"), me.alias("a"), F.when(first == me, second).otherwise(first).alias("b"))


# -- records ------------------------------------------------------------------------
def min_base(series: DataFrame, value: str, bounded: bool = False) -> DataFrame:
    """Smallest base that counts as a record: a tenth of the upper median of positive cells, at least 10."""
    middle = F.array(F.floor(F.col("n_rows") / 2))
    stat = K.order_statistics(series.filter(F.col(value) > 0), [], value, middle, bounded)
    return stat.agg(
        F.greatest(F.lit(10), F.floor(F.coalesce(F.max(value), F.lit(0)) * 0.1 + 0.5)).cast("long").alias("min_base")
    )


def _partial_last(per: DataFrame, spec: SliceSpec) -> DataFrame:
    """One row from (season_year, f): the last period when it has no autumn count although the one before has, else 0."""
    last = per.agg(F.sort_array(F.collect_list(F.struct("season_year", "f")), asc=False).alias("y"))
    bad = (F.size("y") > 1) & (F.col("y")[0]["f"] == 0) & (F.get("y", F.lit(1))["f"] > 0) & F.lit(not spec.season)
    return last.select(F.when(bad, F.col("y")[0]["season_year"]).otherwise(0).alias("partial"))


def _totals(star: Star, spec: SliceSpec) -> DataFrame:
    """(season_year, v, f): the slice's total and its autumn part per period of the range."""
    rows = A.in_region(star, spec.region).filter(spec.period_predicate())
    pick = lambda s: F.sum(F.when(s.category_predicate() & F.col("_in"), F.col("cnt")).otherwise(0))
    return rows.groupBy("season_year").agg(pick(spec).alias("v"), pick(spec.patch(season="fall")).alias("f"))


def last_is_partial(star: Star, spec: SliceSpec) -> DataFrame:
    return _partial_last(_totals(star, spec), spec)


def record_changes(star: Star, spec: SliceSpec, limit: int = 10) -> DataFrame:
    """Biggest jumps and drops between adjacent periods, small bases and a partial last period left out."""
    dense = star.measures(spec, {"v": spec, "f": spec.patch(season="fall")}).filter(spec.period_predicate())
    floor = min_base(dense, "v", star.small).scalar()
    partial = _partial_last(dense.groupBy("season_year").agg(F.sum("f").alias("f")), spec).scalar()
    kept = dense.select(
        "entity", "season_year", F.when((F.col("v") >= floor) & (F.col("season_year") != partial), F.col("v")).otherwise(0).alias("v")
    )
    moves = S.adjacent_changes(kept, "v").select("entity", "season_year", F.round("change", 9).alias("change"))
    tie = ["entity", "season_year"]
    jumps = K.numbered(moves, limit, F.desc("change"), *tie).withColumn("record", F.lit("jump"))
    drops = K.numbered(moves, limit, F.asc("change"), *tie).withColumn("record", F.lit("drop"))
    return jumps.unionByName(drops)


def best_worst_year(star: Star, spec: SliceSpec) -> DataFrame:
    """Best and worst period overall; the worst ignores empty and partial periods; the earliest wins a tie."""
    newest = F.sort_array(F.collect_list(F.struct("season_year", "v", "f")), asc=False)
    packed = _totals(star, spec).agg(newest.alias("y"))
    bad = (F.size("y") > 1) & (F.col("y")[0]["f"] == 0) & (F.get("y", F.lit(1))["f"] > 0) & F.lit(not spec.season)
    partial = F.when(bad, F.col("y")[0]["season_year"]).otherwise(0)
    ordered = lambda keep, sign: F.get(F.array_sort(F.transform(
        F.filter("y", keep), lambda r: F.struct((sign * r["v"]).alias("o"), r["season_year"].alias("season_year"), r["v"].alias("v"))
    )), F.lit(0))
    best = ordered(lambda r: F.lit(True), F.lit(-1))
    worst = ordered(lambda r: (r["v"] > 0) & (r["season_year"] != partial), F.lit(1))
    rows = F.array(F.struct(F.lit("best").alias("record"), best.alias("r")), F.struct(F.lit("worst").alias("record"), worst.alias("r")))
    return packed.select(F.inline(rows)).select("record", "r.season_year", "r.v")


# -- leaderboard and map --------------------------------------------------------------
def board_order(sort: str = "rank", ascending: bool = True) -> list[Column]:
    """The order of a board by rank, name, value, value2 or delta; equal rows by rank, then entity.

    Rows without a rank or a second value are last in either direction; a row without a rank change counts as the lowest one.
    """
    c = F.col(sort)
    last = c.asc_nulls_last() if ascending else c.desc_nulls_last()
    return [last if sort != "delta" else c.asc_nulls_first() if ascending else c.desc_nulls_last(), F.col("rank").asc_nulls_last(), F.col("entity")]


def leaderboard(star: Star, spec: SliceSpec, year: int, metric: str = "count", metric2: str = "", limit: int | None = None,
                roles: M.Roles = M.ORDER_ROLES, sort: str = "rank", ascending: bool = True) -> DataFrame:
    """Value, second metric, rank, rank change, six-season sparkline and share of the whole, in the order that is asked for."""
    ids = [m for m in dict.fromkeys([metric, metric2]) if m]
    # shares are of the whole state, so the region is applied after the total (a z-score depends on its scope)
    late = "zscore" not in ids
    # the sparkline holds six periods, the rank change one more than the metric reads
    df = M.metric_frame(star, spec.patch(region="") if late else spec, ids, roles, at=year, back=5).withColumn("value", F.col(metric))
    df = df.withColumn("value2", F.col(metric2).cast("double") if metric2 else F.lit(None).cast("double"))
    if metric == "count" and late:
        whole = df.groupBy("season_year").agg(F.sum("value").alias("_whole"))
        df = df.join(whole, "season_year").withColumn("share", ratio("value", "_whole")).drop("_whole")
    elif metric == "count":
        whole = star.slice(spec.patch(region="", year_from=year, year_to=year)).agg(F.sum("cnt")).scalar()
        df = df.withColumn("share", ratio(F.col("value"), whole))
    else:
        df = df.withColumn("share", F.lit(None).cast("double"))
    df = df.filter(F.col("region") == spec.region) if spec.region else df
    ranked = S.with_rank_delta(df, "value", not M.METRICS[metric].diverging, star.small)
    board = ranked.withColumn("spark", S.sparkline("base")).filter((F.col("season_year") == year) & F.col("value").isNotNull())
    out = board.select("entity", "name", "region", "value", "value2", "rank", "delta", "spark", "share")
    out = out.orderBy(*board_order(sort, ascending))
    return out.limit(limit) if limit else out


def stats_strip(star: Star, spec: SliceSpec, year: int, metric: str = "count") -> DataFrame:
    """One row: total, entities reporting, entities in scope and the top entity by the metric."""
    df = M.metric_frame(star, spec, [metric], at=year).filter(F.col("season_year") == year)
    v, e = F.col(metric), F.col("entity")
    return df.agg(
        F.sum("base").alias("total"), F.count_if(F.col("base") > 0).alias("reporting"), F.count("*").alias("in_scope"),
        F.min_by(e, F.when(v.isNotNull(), F.struct(-v, e))).alias("top_entity"), F.max(v).alias("top_value"),
    )


# -- the entity card --------------------------------------------------------------------
def entity_card(star: Star, spec: SliceSpec, metric: str, entity, year: int) -> DataFrame:
    """Value, ranks in the whole and in its region with the ranked counts, and the top-10 streak."""
    free = spec.patch(region="")
    df = M.metric_frame(star, free, [metric]).withColumn("value", F.col(metric))
    positive = not M.METRICS[metric].diverging
    now = df.filter(F.col("season_year") == year)
    ranked = K.competition_rank(now, ["season_year"], "value", positive, star.small, "state_rank")
    ranked = K.competition_rank(ranked, ["region"], "value", positive, star.small, "region_rank")
    me, ok = F.col("entity") == entity, F.col("state_rank").isNotNull()
    region = now.filter(me).select("region").scalar()
    one = ranked.agg(
        F.max(F.when(me, F.col("name"))).alias("name"), F.max(F.when(me, F.col("value"))).alias("value"),
        F.max(F.when(me, F.col("state_rank"))).alias("state_rank"), F.count_if(ok).alias("state_ranked"),
        F.max(F.when(me, F.col("region_rank"))).alias("region_rank"),
        F.count_if(ok & (F.col("region") == region)).alias("region_ranked"),
    )
    runs = K.competition_rank(df, ["season_year"], "base", bounded=star.small)
    streak = S.top_n_streaks(runs, year, 10).filter(me).select("streak").scalar()
    return one.withColumn("streak", streak)


def average_line(star: Star, spec: SliceSpec, entity) -> DataFrame:
    """Per period: the entity's count and the rounded mean over entities with a positive count."""
    dense = star.measures(spec.patch(region=""), {"v": spec.patch(region="")})
    return dense.groupBy("season_year").agg(
        F.max(F.when(F.col("entity") == entity, F.col("v"))).alias("own"),
        F.round(F.avg(F.when(F.col("v") > 0, F.col("v")))).cast("long").alias("average"),
    )


def nearest(dim: DataFrame, entity, k: int = 5) -> DataFrame:
    """The k entities with the closest centroids to one entity (equirectangular distance).

    One scan with the origin as scalar values; the sort keeps only k rows per task.
    """
    me = dim.filter(F.col("entity") == entity)
    lon, lat = me.select("lon").scalar(), me.select("lat").scalar()
    dist = F.pow((F.col("lon") - lon) * F.cos(F.radians(lat)), 2) + F.pow(F.col("lat") - lat, 2)
    return (
        dim.filter(F.col("entity") != entity).withColumn("dist", dist)
        .orderBy("dist", "entity").limit(k)
    )


def neighbors_compared(star: Star, spec: SliceSpec, metric: str, entity, year: int, k: int = 5) -> DataFrame:
    """The entity and its nearest neighbours with value and rank, undefined values last."""
    df = M.metric_frame(star, spec.patch(region=""), [metric], at=year).filter(F.col("season_year") == year).withColumn("value", F.col(metric))
    ranked = K.competition_rank(df, ["season_year"], "value", not M.METRICS[metric].diverging, star.small)
    near = nearest(star.dim, entity, k).select("entity").unionByName(star.dim.filter(F.col("entity") == entity).select("entity"))
    return ranked.join(near, "entity", "left_semi").select(
        "entity", "name", "value", "rank", (F.col("entity") == entity).alias("self")
    ).orderBy(F.col("value").desc_nulls_last(), "entity")


def pressure_card(star: Star, spec: SliceSpec, entity, year: int, round_to: int = 100) -> DataFrame:
    """Hunter densities, estimated hunters, harvest per hunter and the two ranks of one entity."""
    ids = ["deer_per_hunter", "hunters_per_sqmi"]
    df = M.metric_frame(star, spec.patch(region=""), ids, at=year).filter(F.col("season_year") == year)
    for m, name in zip(ids, ("rank_per_hunter", "rank_density")):
        df = K.competition_rank(df, ["season_year"], m, True, star.small, name)
    df = df.join(star.effort, ["entity", "season_year"], "left")
    me = F.col("entity") == entity
    own = lambda c: F.max(F.when(me, c))
    people = (F.col("fh") + F.col("ah")) * F.col("area")
    return df.agg(
        own(F.col("fh")).alias("firearms"), own(F.col("ah")).alias("archery"),
        own(F.round(people / round_to) * round_to).alias("hunters"), own(F.col("deer_per_hunter")).alias("per_hunter"),
        own(F.col("rank_per_hunter")).alias("rank_per_hunter"), F.count("rank_per_hunter").alias("ranked_per_hunter"),
        own(F.col("rank_density")).alias("rank_density"), F.count("rank_density").alias("ranked_density"),
    )


def density_trend(effort: DataFrame, entity) -> DataFrame:
    """Per published period: the entity's combined density and the mean over entities, one decimal."""
    both = F.col("fh") + F.col("ah")
    per = effort.groupBy("season_year").agg(
        F.max(F.when(F.col("entity") == entity, both)).alias("own"), F.avg(both).alias("average")
    )
    return per.filter(F.col("average").isNotNull()).withColumn("average", F.round("average", 1))


def region_effort(star: Star, spec: SliceSpec) -> DataFrame:
    """Area-weighted density and harvest per hunter per region, over members that report both densities."""
    df = star.measures(spec, {"v": spec}).join(star.effort, ["entity", "season_year"])
    ok = F.col("fh").isNotNull() & F.col("ah").isNotNull() & (F.col("area") > 0)
    people = (F.col("fh") + F.col("ah")) * F.col("area")
    agg = df.filter(ok).groupBy("region", "season_year").agg(
        F.sum(people).alias("hunters"), F.sum("area").alias("area"), F.sum("v").alias("v"), F.count("*").alias("members")
    )
    return agg.filter(F.col("hunters") > 0).select(
        "region", "season_year", "members", ratio("hunters", "area").alias("density"), ratio("v", "hunters").alias("per_hunter")
    )


def permits_vs_harvest(permits: DataFrame, hunters: DataFrame) -> DataFrame:
    """Fill rate per permit type, with the share of firearms hunters who took at least one animal."""
    took = 1 - ratio("hunters_0_deer", "hunters_total")
    success = hunters.filter("method = 'firearms'").select("year", took.alias("success_rate"))
    return permits.join(success, "year", "left").withColumn("fill_rate", ratio("deer_harvested", "permits_issued"))


# -- season mix ---------------------------------------------------------------------------
def season_stats(star: Star, spec: SliceSpec, roles: M.Roles = M.ORDER_ROLES, entity=None) -> DataFrame:
    """Opening share, youth share and spring:fall ratio per period; an entity scope ignores the region."""
    free = spec.all_years().patch(entities=(entity,) if entity is not None else ())
    if entity is not None:
        free = free.patch(region="")
    sums = {
        **M.METRICS["opening_share"].sums(free, roles), **M.METRICS["youth_share"].sums(free, roles),
        "spring": free.patch(season="spring", portions=()), "fall": free.patch(season="fall", portions=()),
    }
    rows = star.fact
    if entity is not None:
        rows = rows.filter(F.col("entity") == entity)
    elif free.region:
        rows = rows.join(star.dim.filter(F.col("region") == free.region).select("entity"), "entity", "left_semi")
    wide = A.conditional(rows, ["season_year"], **{k: s.category_predicate() for k, s in sums.items()})
    return wide.select(
        "season_year", ratio("os_num", "os_den").alias("opening_share"), ratio("ys_num", "ys_den").alias("youth_share"),
        ratio("spring", "fall").alias("spring_fall"),
    )


# -- head to head ---------------------------------------------------------------------------
# stat -> which direction wins ("" = no winner)
H2H_BETTER = {
    "harvest": "high", "per_area": "high", "rank": "low", "change": "high", "avg5": "high", "buck_doe": "high",
    "hunters_per_area": "", "per_hunter": "high", "attribute_share": "high", "best": "high", "best_year": "",
}


def h2h_stats(star: Star, spec: SliceSpec, keys: tuple[str, str], year: int, roles: M.Roles = M.ORDER_ROLES) -> DataFrame:
    """(stat, a, b): the statistics of two places, each an entity or a region; the region filter is dropped."""
    full = spec.patch(region="").all_years()
    sums = {"v": full, **M.METRICS["buck_doe"].sums(full, roles)}
    dense = star.measures(full, sums)
    members = A.places(star, list(keys)).select("side", "is_region", "entity", F.col("region").alias("home"))
    named = dense.join(members, "entity")
    exact = M.attribute_share_exact(star, full).select("entity", "season_year", "num", F.col("den").alias("aden"))
    named = named.join(star.effort, ["entity", "season_year"], "left").join(exact, ["entity", "season_year"], "left")
    ok = F.col("fh").isNotNull() & F.col("ah").isNotNull() & (F.col("area") > 0)
    people = (F.col("fh") + F.col("ah")) * F.col("area")
    line = named.groupBy("side", "is_region", "season_year").agg(
        F.min("entity").alias("entity"), F.min("home").alias("home"),
        F.sum("v").alias("v"), F.sum("area").alias("area"), F.sum("bd_num").alias("bd_num"), F.sum("bd_den").alias("bd_den"),
        F.sum(F.when(ok, people)).alias("hunters"), F.sum(F.when(ok, F.col("area"))).alias("earea"),
        F.sum(F.when(ok, F.col("v"))).alias("ev"), F.sum("num").alias("num"), F.sum("aden").alias("aden"),
    )
    line = line.withColumns({
        "prev": F.lag("v").over(S.line("side")), "avg5": S.trailing_average("v", 5, "side"),
    })
    best = K.argmax(["side"], line, "v", "season_year").select("side", F.col("season_year").alias("best_year"), F.col("v").alias("best"))
    now = line.filter(F.col("season_year") == year).join(best, "side")
    # competition rank = 1 + number of strictly greater peers at the same grain
    peers = dense.filter(F.col("season_year") == year)
    own = peers.select(F.lit(False).alias("is_region"), F.col("v").alias("peer"))
    regional = peers.groupBy("region").agg(F.sum("v").alias("peer")).select(F.lit(True).alias("is_region"), "peer")
    above = (
        now.select("side", "is_region", "v").join(own.unionByName(regional), "is_region")
        .groupBy("side").agg((F.count_if(F.col("peer") > F.col("v")) + 1).alias("place"))
    )
    now = now.join(above, "side")
    stats = {
        "harvest": F.col("v").cast("double"), "per_area": ratio("v", "area"),
        "rank": F.when(F.col("is_region") | (F.col("v") > 0), F.col("place")).cast("double"),
        "change": ratio("v", "prev") - 1, "avg5": F.col("avg5"), "buck_doe": ratio("bd_num", "bd_den"),
        "hunters_per_area": F.when(F.col("hunters") > 0, ratio("hunters", "earea")), "per_hunter": ratio("ev", "hunters"),
        "attribute_share": ratio("num", "aden"), "best": F.col("best").cast("double"), "best_year": F.col("best_year").cast("double"),
    }
    long = now.select(
        "side", "is_region",
        F.inline(F.array(*[F.struct(F.lit(k).alias("stat"), c.alias("value")) for k, c in stats.items()])),
    )
    side = lambda i, c: F.max(F.when(F.col("side") == i, F.col(c)))
    return long.groupBy("stat").agg(
        side(0, "value").alias("a"), side(1, "value").alias("b"),
        (side(0, "is_region") == side(1, "is_region")).alias("same_grain"),
    )


def h2h_winners(stats: DataFrame) -> DataFrame:
    """Winner per statistic (``a``, ``b`` or NULL); rank only counts between places of one grain."""
    better = F.create_map(*[F.lit(x) for kv in H2H_BETTER.items() for x in kv])
    how = F.when((F.col("stat") == "rank") & ~F.col("same_grain"), "").otherwise(better[F.col("stat")])
    a, b = F.col("a"), F.col("b")
    first = F.when(how == "high", a > b).when(how == "low", a < b)
    return stats.select("stat", F.when(a != b, F.when(first, "a").when(~first, "b")).alias("winner"))


def h2h_score(winners: DataFrame) -> DataFrame:
    w = F.col("winner")
    return winners.agg(F.count_if(w == "a").alias("a"), F.count_if(w == "b").alias("b"), F.count(w).alias("decided"))
