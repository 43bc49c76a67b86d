"""Generated facts: short statements about one period, each a small frame of at most one row.

Everything is computed from one dense entity x period frame that is written once, so the fact
table is scanned a single time however many statements are made.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starslice.functions import labels as L
from starslice.operators import ranking as K
from starslice.operators import series as S
from starslice.plans import metrics as M
from starslice.plans.spec import SliceSpec
from starslice.runtime import ratio, settle
from starslice.sources.star import Star

COLUMNS = ("priority", "id", "entity", "value", "caption", "text")


def _fact(df: DataFrame, priority: int, fact_id: str, value: Column, caption: Column, text: Column, entity: Column | None = None) -> DataFrame:
    who = entity.cast("string") if entity is not None else F.lit(None).cast("string")
    return df.select(
        F.lit(priority).alias("priority"), F.lit(fact_id).alias("id"), who.alias("entity"),
        value.alias("value"), caption.alias("caption"), text.alias("text"),
    )


def _top_two(df: DataFrame, value: str) -> DataFrame:
    """One row: ``a`` the leader and ``b`` the runner-up (entity, name, value)."""
    ok = df.filter(F.col(value).isNotNull()).orderBy(F.desc(value), "entity").limit(2)
    packed = F.sort_array(F.collect_list(F.struct((-F.col(value)).alias("o"), "entity", "name", F.col(value).alias("v"))))
    return ok.agg(packed.alias("t")).select(F.get("t", F.lit(0)).alias("a"), F.get("t", F.lit(1)).alias("b")).filter(F.col("a").isNotNull())


def make_facts(star: Star, spec: SliceSpec, year: int, kind: str = "deer", home=None, roles: M.Roles = M.ORDER_ROLES,
               animals: str = "animals", round_to: int = 100, min_count: int = 50, limit: int | None = None) -> DataFrame:
    """Facts in priority order. ``kind`` picks the class and effort facts or the season and attribute facts."""
    full = spec.all_years()
    sums = {"all": full, "spring": full.patch(season="spring"), "fall": full.patch(season="fall")}
    if kind == "deer":
        sums |= M.METRICS["opening_share"].sums(full.patch(method="", youth=None), roles)
        sums |= M.METRICS["buck_doe"].sums(full, roles)
        sums |= {
            "as_num": full.patch(portions=roles.archery, method=""), "as_den": full.patch(portions=(), method=""),
        }
    else:
        sums |= {"sf_spring": full.patch(season="spring", portions=()), "sf_fall": full.patch(season="fall", portions=())}
    wide = settle(star.measures(full, sums).filter(F.col("season_year") <= year), "facts")
    now_only = wide.filter(F.col("season_year") == year)

    # a period with spring rows only is compared spring to spring
    if kind == "turkey" and not spec.season:
        spring_only = now_only.agg((F.sum("fall") == 0) & (F.sum("spring") > 0)).scalar()
    else:
        spring_only = F.lit(False)
    dense = wide.withColumn("v", F.when(spring_only, F.col("spring")).otherwise(F.col("all")))
    now = dense.filter(F.col("season_year") == year)

    split = kind == "deer"
    scope = f"in the {spec.region} region" if spec.region else "in the state"
    the_scope = scope.replace("in the ", "the ")
    label = L.season_label(F.lit(year), split)
    an = F.lit(animals)

    totals = dense.groupBy("season_year").agg(F.sum("v").alias("t")).agg(
        F.sort_array(F.collect_list(F.struct("season_year", "t")), asc=False).alias("y")
    )
    total = totals.select(
        F.col("y")[0]["t"].alias("t"), F.get("y", F.lit(1))["t"].alias("p"), F.slice("y", 2, 5).alias("back"), F.size("y").alias("n")
    )
    ranked = K.competition_rank(dense, ["season_year"], "v", bounded=star.small)
    facts: list[DataFrame] = []

    if home is not None:
        me = ranked.filter(F.col("entity") == home).withColumn("pr", F.lag("rank").over(S.line())).filter(F.col("season_year") == year)
        d = F.col("pr") - F.col("rank")
        move = F.when(d > 0, F.format_string(" (up %d)", d)).when(d < 0, F.format_string(" (down %d)", -d)).when(d == 0, " (no change)").otherwise("")
        text = F.concat(F.col("name"), F.lit(" ranks "), L.ordinal(F.col("rank")), F.lit(f" {scope} in "), label, move, F.lit("."))
        facts.append(_fact(me.filter("rank IS NOT NULL"), 1, "home", F.format_string("#%d", F.col("rank")), F.concat_ws(" ", L.grouped(F.col("v")), an), text, F.col("entity")))

    run = S.leader_run(dense, "v", year).join(star.dim.select("entity", "name"), "entity")
    led = F.concat(F.col("name"), F.lit(f" has led {the_scope} "), F.col("run").cast("string"), F.lit(" seasons running."))
    once = F.concat(F.col("name"), F.lit(f" led {the_scope} in "), label, F.lit(" with "), L.grouped(F.col("v")), F.lit(" "), an, F.lit("."))
    facts.append(_fact(run.filter("v > 0"), 2, "leader", L.grouped(F.col("v")), an, F.when(F.col("run") >= 2, led).otherwise(once), F.col("entity")))

    rel = ratio("t", "p") - 1
    text = F.concat(F.lit("The harvest is "), F.when(rel >= 0, "up ").otherwise("down "), L.percent(F.abs(rel)), F.lit(" on last season."))
    facts.append(_fact(total.filter("p > 0"), 3, "yoy", L.plus(rel, L.percent(rel)), F.concat(L.grouped(F.col("p")), F.lit(" → "), L.grouped(F.col("t"))), text))

    dens = _top_two(now.withColumn("x", ratio("v", "area")), "x").filter("a.v > 0")
    second = F.coalesce(F.concat(F.lit("; "), F.col("b.name"), F.lit(" was 2nd at "), L.fixed(F.col("b.v"), 1)), F.lit(""))
    text = F.concat(F.col("a.name"), F.lit(" took "), L.fixed(F.col("a.v"), 1), F.lit(f" {animals} per unit of area, the most {scope}"), second, F.lit("."))
    facts.append(_fact(dens, 4, "density", L.fixed(F.col("a.v"), 2), F.concat(an, F.lit(" per area")), text, F.col("a.entity")))

    if kind == "deer" and star.effort is not None:
        facts += _effort_facts(star, spec, dense, year, home, scope, round_to)

    runs = S.top_n_streaks(ranked, year, 10).filter("streak >= 3").join(star.dim.select("entity", "name"), "entity")
    best = K.top(runs, 1, F.desc("streak"), "entity")
    every = F.col("streak") == totals.select(F.size("y")).scalar()
    text = F.concat(F.col("name"), F.lit(f" has finished top 10 {scope} "), F.when(every, "every season on record.").otherwise(F.format_string("%d seasons in a row.", F.col("streak"))))
    facts.append(_fact(best, 7, "streak", F.col("streak").cast("string"), F.lit("seasons in the top 10"), text, F.col("entity")))

    if kind == "deer":
        st = now.agg(*[F.sum(c).alias(c) for c in ("os_num", "os_den", "bd_num", "bd_den", "as_num", "as_den")])
        for prio, fid, name, shown, caption, words in (
            (8, "opening", "os", lambda r: L.percent(r, 0), "of the main portion", "The opening days were {} of the main portion."),
            (9, "buckdoe", "bd", lambda r: L.fixed(r, 2), "bucks per doe", "There were {} bucks for every doe."),
            (10, "archery", "as", lambda r: L.percent(r, 0), "archery share", "Archery took {} of the harvest."),
        ):
            r = ratio(f"{name}_num", f"{name}_den")
            value = shown(r)
            text = F.replace(F.lit(words), F.lit("{}"), value)
            facts.append(_fact(st.filter(r > 0), prio, fid, value, F.lit(caption), text))
    else:
        st = now.agg(F.sum("sf_spring").alias("s"), F.sum("sf_fall").alias("f")).filter("s > 0 AND f > 0")
        r = L.fixed(ratio("s", "f"), 1)
        facts.append(_fact(st, 8, "springfall", F.concat(r, F.lit(":1")), F.lit("spring : fall"), F.concat(F.lit("Spring outdrew fall "), r, F.lit(" to 1."))))
        if star.attrs is not None:
            # the slice's season rule applies to the denominator as well
            cells = M.attribute_share_exact(star, full.patch(season=spec.season)).filter(F.col("season_year") == year)
            pool = now.filter(F.col("v") >= min_count).join(cells.select("entity", "share"), "entity")
            top = _top_two(pool, "share").filter("a.v > 0")
            text = F.concat(F.col("a.name"), F.lit(" led the attribute share with "), L.percent(F.col("a.v"), 0), F.lit(f" (places with {min_count} or more)."))
            facts.append(_fact(top, 9, "public", L.percent(F.col("a.v"), 0), F.lit("attribute share"), text, F.col("a.entity")))

    prev = F.lag("v").over(S.line())
    moved = dense.withColumn("prev", prev).filter((F.col("season_year") == year) & F.col("prev").isNotNull() & ((F.col("prev") > 0) | (F.col("v") > 0)))
    moved = moved.withColumn("delta", F.col("v") - F.col("prev"))
    before = F.concat(F.lit("vs "), L.season_label(F.lit(year - 1), split))
    up = _top_two(moved, "delta").filter("a.v > 0")
    down = _top_two(moved.withColumn("fall_by", -F.col("delta")), "fall_by").filter("a.v > 0")
    g = L.grouped(F.col("a.v"))
    facts.append(_fact(up, 11, "gain", F.concat(F.lit("+"), g), before, F.concat(F.col("a.name"), F.lit(" gained "), g, F.lit(f" {animals} on last season, the biggest rise {scope}.")), F.col("a.entity")))
    facts.append(_fact(down, 12, "loss", F.concat(F.lit("−"), g), before, F.concat(F.col("a.name"), F.lit(" fell by "), g, F.lit(f" {animals}, the biggest drop {scope}.")), F.col("a.entity")))

    mean = F.aggregate("back", F.lit(0).cast("double"), lambda acc, b: acc + b["t"]) / F.nullif(F.size("back"), F.lit(0))
    avg = total.filter("size(back) >= 3").withColumn("m", mean).filter("m > 0")
    rel = ratio("t", "m") - 1
    n = F.size("back").cast("string")
    text = F.concat(label, F.lit(" came in "), L.percent(F.abs(rel)), F.when(rel >= 0, " above the ").otherwise(" below the "), n, F.lit("-season mean."))
    facts.append(_fact(avg, 13, "avg5", L.plus(rel, L.percent(rel)), F.concat(F.lit("vs "), n, F.lit("-season avg")), text))

    if not spec.region:
        per = now.groupBy("region").agg(F.sum("v").alias("x"))
        first = K.top(per.filter("x > 0"), 1, F.desc("x"), "region")
        r = ratio(F.col("x"), now.agg(F.sum("v")).scalar())
        text = F.concat(F.lit("The "), F.col("region"), F.lit(" region accounted for "), L.percent(r), F.lit(f" of the {animals}."))
        facts.append(_fact(first, 14, "region", L.percent(r, 0), F.lit("of the state"), text))

    alive = now.agg(F.sum("v") > 0).scalar()
    out = reduce(DataFrame.unionByName, facts).filter(alive).orderBy("priority")
    return out.limit(limit) if limit else out


def _effort_facts(star: Star, spec: SliceSpec, dense: DataFrame, year: int, home, scope: str, round_to: int) -> list[DataFrame]:
    """Most hunters and best harvest per hunter in the latest period that publishes densities."""
    published = star.effort.filter((F.col("season_year") <= year) & F.col("fh").isNotNull()).agg(F.max("season_year")).scalar()
    at = dense.filter(F.col("season_year") == published).join(star.effort, ["entity", "season_year"])
    people = (F.col("fh") + F.col("ah")) * F.col("area")
    at = at.withColumns({
        "people": F.when(people > 0, F.floor(people / round_to + 0.5) * round_to),
        "per": ratio(F.col("v"), people),
    })
    label = L.season_label(F.first("season_year"), True)
    when = at.agg(label.alias("l")).scalar()
    top = _top_two(at, "people")
    if home is not None:
        mine = at.filter(F.col("entity") == home).select(F.struct("entity", "name", F.col("people").alias("v"))).scalar()
        use = mine["v"].isNotNull() & (F.col("a.entity") != F.lit(home))
        other = F.when(use, F.concat(F.lit("; "), mine["name"], F.lit(" had ≈"), L.grouped(mine["v"])))
    else:
        other = F.lit(None).cast("string")
    second = F.concat(F.lit("; "), F.col("b.name"), F.lit(" was 2nd with ≈"), L.grouped(F.col("b.v")))
    tail = F.coalesce(other, second, F.lit(""))
    text = F.concat(F.col("a.name"), F.lit(" had ≈"), L.grouped(F.col("a.v")), F.lit(f" hunters, the most {scope}"), tail, F.lit("."))
    best = _top_two(at, "per").filter("a.v > 0")
    per = L.fixed(F.col("a.v"), 2)
    return [
        _fact(top, 5, "hunters", F.concat(F.lit("≈"), L.grouped(F.col("a.v"))), F.concat(F.lit("hunters, "), when), text, F.col("a.entity")),
        _fact(best, 6, "dph", per, F.lit("per hunter"), F.concat(F.lit(f"Highest harvest per hunter {scope}: "), F.col("a.name"), F.lit(" ("), per, F.lit(").")), F.col("a.entity")),
    ]
