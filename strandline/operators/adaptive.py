"""The adaptive plan of pseudotime bins: kernel widths from the cells' states, and boundaries that states jump at.

All fits are in closed form over grouped sums: a pilot is an equal-time part of a branch, and its local line, its noise and its bootstrap are
sums over its cells. Draws come from md5 of what they are for, so that every run and every other engine draws alike.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.operators.ordered import counts_below, quantiles
from strandline.storage import written


def draw(*parts: Column) -> Column:
    """A whole number from 0 to 2**32 - 1 that the parts' text decides."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *[p.cast("string") for p in parts]).cast("binary")), 1, 8), 16, 10).cast("long")


def equal_time_centres(cells: DataFrame, bins: int, most_elements: int | None = None) -> DataFrame:
    """(branch, bin, centre, spacing, low, high) of `bins` bins of one width over each branch's range of pseudotime; a branch at one time has spacing 1 / bins.

    With most_elements, bins times cells of a branch are counted before anything is made, and too many are an error.
    """
    spans = cells.groupBy("branch").agg(F.min("pseudotime").alias("low"), F.max("pseudotime").alias("high"), F.count("*").alias("_cells"))
    if most_elements is not None:
        over = spans.where(F.col("_cells") * bins > most_elements).count()
        if over:
            raise MemoryError(f"{over} branches have more than {most_elements} cells times bins")
    width = F.when(F.col("high") > F.col("low"), F.col("high") - F.col("low")).otherwise(1.0) / bins
    first = F.col("low") + width / 2
    last = F.col("high") - width / 2
    step = (last - first) / max(bins - 1, 1)
    rows = spans.select("branch", "low", "high", width.alias("spacing"), F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin")).withColumn("centre", first + F.col("bin") * step)
    # a few rows from all cells, which every step reads again
    return written(rows.select("branch", "bin", "centre", "spacing", "low", "high"), "centres")


def _cuts(branches: DataFrame, stable: DataFrame | None) -> DataFrame:
    """(branch, cuts): the stable edges of every branch, rising."""
    if stable is None:
        return branches.select("branch").distinct().withColumn("cuts", F.array().cast("array<double>"))
    return branches.select("branch").distinct().join(stable.groupBy("branch").agg(F.array_sort(F.collect_set("edge")).alias("cuts")), "branch", "left").withColumn("cuts", F.coalesce("cuts", F.array().cast("array<double>")))


def _region(time: str) -> Column:
    return F.size(F.filter("cuts", lambda x: x <= F.col(time)))


def state_pilots(cells: DataFrame, centres: DataFrame, subdivisions: int = 3, least: int = 8, repeats: int = 0, stable: DataFrame | None = None, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """Pilots (branch, pilot, at, region, n, rank, noise, variance, mu, boots) and the cells' part in them.

    cells(cell_id, branch, pseudotime, vec). A branch's range is cut into bins times `subdivisions` pilots of one width; a cell counts where it lies in the pilot and in the
    region (between stable edges) of the pilot's middle. With at least `least` cells a line over time is fitted to each dimension (a mean, if all are at one
    time): mu is its value in the middle, noise the residuals' mean square over degrees of freedom, summed over dimensions, variance that of mu. boots
    holds for each of `repeats` replicates the change of mu when centred residuals, widened to their degrees of freedom, are dealt anew to the cells: cell k of n (by
    cell_id) gets that of the cell that draw(seed, branch, pilot, replicate, k) modulo n tells. Other pilots have rank 0 and nulls.
    """
    spans = centres.groupBy("branch").agg(F.first("low").alias("low"), F.first("high").alias("high"), (F.count("*") * subdivisions).cast("int").alias("pilots"))
    spans = spans.join(_cuts(centres, stable), "branch")
    width = (F.col("high") - F.col("low")) / F.col("pilots")
    grid = spans.select("branch", "cuts", F.explode(F.sequence(F.lit(0), F.col("pilots") - 1)).alias("pilot"), width.alias("width"), "low").withColumn("at", F.col("low") + (F.col("pilot") + 0.5) * F.col("width")).withColumn("region", _region("at"))
    place = F.when(width > 0, F.least(F.floor((F.col("pseudotime") - F.col("low")) / width), F.col("pilots") - 1)).otherwise(0).cast("int")
    inside = cells.join(F.broadcast(spans), "branch").withColumn("pilot", place).withColumn("_r", _region("pseudotime"))
    inside = inside.select("cell_id", "branch", "pilot", "_r", "pseudotime", F.col("vec").cast("array<double>").alias("vec")).join(F.broadcast(grid.select("branch", "pilot", "at", "region")), ["branch", "pilot"]).where("_r = region")
    # places from the pilot's middle, so that sums of squares do not cancel
    rows = written(inside.select("cell_id", "branch", "pilot", (F.col("pseudotime") - F.col("at")).alias("x"), "vec"), "pilot-cells")
    key = ["branch", "pilot"]
    times = rows.groupBy(*key).agg(F.count("*").alias("n"), F.avg("x").alias("mx"), F.min("x").alias("_a"), F.max("x").alias("_b"), F.var_pop("x").alias("_v")).where(F.col("n") >= least)
    times = times.select(*key, "n", "mx", F.when(F.col("_b") > F.col("_a"), F.col("_v") * F.col("n")).otherwise(0.0).alias("ss"), F.when(F.col("_b") > F.col("_a"), 2).otherwise(1).alias("rank"))
    flat = rows.select("cell_id", *key, "x", F.posexplode("vec").alias("dim", "y")).join(F.broadcast(times), key)
    fits = flat.groupBy(*key, "dim").agg(F.avg("y").alias("my"), F.sum((F.col("x") - F.col("mx")) * F.col("y")).alias("_xy"), F.first("ss").alias("ss"), F.first("mx").alias("mx"))
    fits = fits.select(*key, "dim", "my", F.when(F.col("ss") > 0, F.col("_xy") / F.col("ss")).otherwise(0.0).alias("slope"), F.col("mx").alias("_mx")).withColumn("value", F.col("my") - F.col("slope") * F.col("_mx")).drop("_mx")
    fits = written(fits, "pilot-fits")
    residual = F.col("y") - F.col("my") - F.col("slope") * (F.col("x") - F.col("mx"))
    left = written(flat.join(F.broadcast(fits), [*key, "dim"]).select("cell_id", *key, "dim", "n", "rank", residual.alias("e")), "residuals")
    noise = left.groupBy(*key).agg((F.sum(F.col("e") * F.col("e")) / F.first(F.col("n") - F.col("rank"))).alias("noise"))
    line = F.when(F.col("ss") > 0, F.col("mx") * F.col("mx") / F.col("ss")).otherwise(0.0)
    means = fits.groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "value"))), lambda x: x["value"]).alias("mu"))
    pilots = times.join(noise, key).join(means, key).withColumn("variance", F.col("noise") * (1 / F.col("n") + line))
    boots = None
    if repeats:
        numbered = counts_below(rows.groupBy("branch", "pilot", "cell_id").agg(F.first("x").alias("x"), F.count("*").alias("_k")), key, "cell_id", "_k").select("cell_id", *key, "x", F.col("_below").alias("k"))
        numbered, times = written(numbered, "numbered"), written(times, "times")
        share = 1 / F.col("n") + F.when(F.col("ss") > 0, -F.col("mx") * (F.col("x") - F.col("mx")) / F.col("ss")).otherwise(0.0)
        dealt = numbered.join(F.broadcast(times), key).withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
        dealt = dealt.select(*key, "replicate", F.pmod(draw(F.lit(seed), F.col("branch"), F.col("pilot"), F.col("replicate"), F.col("k")), F.col("n")).alias("k"), share.alias("share"))
        weights = dealt.groupBy(*key, "replicate", "k").agg(F.sum("share").alias("share"))
        given = left.join(numbered.select("cell_id", *key, "k"), ["cell_id", *key]).withColumn("e", F.col("e") * F.sqrt(F.col("n") / (F.col("n") - F.col("rank"))))
        changes = given.join(weights, [*key, "k"]).groupBy(*key, "replicate", "dim").agg(F.sum(F.col("share") * F.col("e")).alias("change"))
        each = changes.groupBy(*key, "replicate").agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "change"))), lambda x: x["change"]).alias("change"))
        boots = written(each.groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct("replicate", "change"))), lambda x: x["change"]).alias("boots")), "boots")
    out = grid.select("branch", "pilot", "at", "region").join(pilots.select(*key, "n", "rank", "noise", "variance", "mu"), key, "left").withColumn("rank", F.coalesce("rank", F.lit(0)))
    out = out.join(boots, key, "left") if boots is not None else out.withColumn("boots", F.lit(None).cast("array<array<double>>"))
    return written(out, "pilots"), rows


def _spread(mu: Column, weight: str = "p") -> Column:
    """Sum over dimensions of the weighted variance of grouped vectors; its parts are sums of one group's rows."""
    return F.sum(F.col(weight) * mu * mu) - F.sum(F.col(weight) * mu) ** 2 / F.sum(weight)


def state_scores(pilots: DataFrame, centres: DataFrame, multipliers: list[float], uncertainty: float = 1.0, floor: float = 0.1, budget: float = 1.0, stable: DataFrame | None = None) -> DataFrame:
    """For every bin and width (spacing times multiplier): distortion, noise, uncertainty, coverage, evidence, score and whether the score is within the budget.

    A bin sees the pilots of its branch and region under a Gaussian of the width. distortion is the spread of their means beyond what their variances explain,
    never below 0; uncertainty the standard deviation of the same over the bootstrap; score = sqrt((distortion - times uncertainty) / (noise + floor)), the floor being a part of
    the spread of pilots within branches. Evidence needs two fitted pilots of some weight.
    """
    key = ["branch", "bin", "multiplier"]
    seen = centres.join(_cuts(centres, stable), "branch").withColumn("region", _region("centre"))
    offered = seen.withColumn("multiplier", F.explode(F.array(*[F.lit(float(m)) for m in sorted(multipliers)])))
    z = (F.col("at") - F.col("centre")) / (F.col("spacing") * F.col("multiplier"))
    both = offered.join(F.broadcast(pilots), ["branch", "region"], "left").withColumn("w", F.exp(-z * z / 2)).withColumn("fit", F.col("rank") > 0)
    # pilots and bins are few hundreds a branch, whatever the cells are
    held = F.when(F.col("fit"), F.col("w")).otherwise(0.0)
    mass = written(both.groupBy(*key).agg(F.sum(held).alias("mass"), F.sum("w").alias("total"), F.sum(F.col("fit").cast("int")).alias("pilots")), "mass")
    fitted = written(both.where("fit").join(mass, key).where("mass > 0").select(*key, "pilot", (F.col("w") / F.col("mass")).alias("p"), "noise", "variance", "mu", "boots"), "weights")
    levels = written(fitted.groupBy(*key).agg(F.sum(F.col("p") * (1 - F.col("p")) * F.col("variance")).alias("correction"), F.sum(F.col("p") * F.col("noise")).alias("noise")), "levels")
    spread = fitted.select(*key, "p", F.posexplode("mu").alias("dim", "m")).groupBy(*key, "dim").agg(_spread(F.col("m")).alias("d")).groupBy(*key).agg(F.sum("d").alias("d"))
    moved = fitted.select(*key, "p", "mu", F.posexplode("boots").alias("replicate", "change")).select(*key, "replicate", "p", F.posexplode(F.zip_with("mu", "change", lambda a, b: a + b)).alias("dim", "m"))
    again = moved.groupBy(*key, "replicate", "dim").agg(_spread(F.col("m")).alias("d")).groupBy(*key, "replicate").agg(F.sum("d").alias("d")).join(levels, key)
    unsure = written(again.groupBy(*key).agg(F.stddev_samp(F.greatest(F.col("d") - F.col("correction"), F.lit(0.0))).alias("uncertainty")), "uncertainty")
    # the spread of pilots within branches, every branch alike
    known = pilots.where("rank > 0").withColumn("_one", F.lit(1.0))
    within = known.select("branch", "_one", F.posexplode("mu").alias("dim", "m")).groupBy("branch", "dim").agg((_spread(F.col("m"), "_one") / F.count("*")).alias("d")).groupBy("branch").agg(F.sum("d").alias("d"))
    scales = known.groupBy("branch").agg(F.count("*").alias("k"), F.avg("variance").alias("v")).where("k >= 2").join(within, "branch")
    scale = scales.agg(F.coalesce(F.avg(F.greatest(F.col("d") - (1 - 1 / F.col("k")) * F.col("v"), F.lit(0.0))), F.lit(0.0)).alias("scale")).crossJoin(known.agg(F.coalesce(F.max("noise"), F.lit(0.0)).alias("_most")))
    least = floor * floor * F.col("scale") + 2.0**-52 * F.greatest("scale", "_most")
    rows = mass.join(levels, key, "left").join(spread, key, "left").join(unsure, key, "left").crossJoin(F.broadcast(scale.select(least.alias("floor"))))
    rows = rows.withColumn("evidence", (F.col("pilots") >= 2) & (F.col("mass") > 0)).withColumn("coverage", F.when(F.col("total") > 0, F.col("mass") / F.col("total")).otherwise(0.0))
    distortion = F.when(F.col("evidence"), F.greatest(F.col("d") - F.col("correction"), F.lit(0.0)))
    rows = rows.withColumn("distortion", distortion).withColumn("uncertainty", F.when(F.col("evidence"), F.coalesce("uncertainty", F.lit(0.0)))).withColumn("noise", F.when(F.col("evidence"), F.col("noise")))
    above = F.greatest(F.col("distortion") - uncertainty * F.col("uncertainty"), F.lit(0.0))
    below = F.col("noise") + F.col("floor")
    score = F.when(below > 0, F.sqrt(above / F.when(below > 0, below))).otherwise(F.when(above == 0, 0.0).otherwise(float("inf")))
    rows = rows.withColumn("score", F.when(F.col("evidence"), score)).withColumn("accepted", F.coalesce(F.col("score") <= budget, F.lit(False)))
    return written(rows.select(*key, "pilots", "coverage", "evidence", "distortion", "noise", "uncertainty", "score", "accepted"), "scores")


def state_bandwidths(scores: DataFrame, centres: DataFrame) -> DataFrame:
    """(branch, bin, multiplier, bandwidth, reason, confident): the largest accepted width of each bin.

    Without one the smallest that has evidence is taken and said to miss the budget, and without any evidence the widest. confident: accepted, with all pilots in sight fitted.
    """
    m, good, known = F.col("multiplier"), F.col("accepted") & F.col("evidence"), F.col("evidence")
    by = scores.groupBy("branch", "bin").agg(F.max(F.when(good, m)).alias("_a"), F.min(F.when(known, m)).alias("_e"), F.max(m).alias("_w"), F.min(m).alias("_s"))
    chosen = by.select("branch", "bin", F.coalesce("_a", "_e", "_w").alias("multiplier"), F.when(F.col("_a").isNotNull(), "largest_accepted").when(F.col("_e") == F.col("_s"), "state_budget_unmet_at_min").when(F.col("_e").isNotNull(), "state_budget_unmet_at_min_evidenced").otherwise("insufficient_state_evidence").alias("reason"))
    full = scores.select("branch", "bin", "multiplier", "coverage")
    out = chosen.join(full, ["branch", "bin", "multiplier"]).join(centres.select("branch", "bin", "spacing"), ["branch", "bin"])
    confident = (F.col("reason") == "largest_accepted") & (F.abs(F.col("coverage") - 1) <= 1e-12)
    return out.select("branch", "bin", "multiplier", (F.col("multiplier") * F.col("spacing")).alias("bandwidth"), "reason", confident.alias("confident"))


#: Parts of a pool to both sides of its median; the median of a draw is looked for in the narrowest that its size allows.
LEVELS = [0.01, 0.02, 0.05, 0.1, 0.2, 0.5]
AROUND = [0.5, *[0.5 + side * x for x in LEVELS for side in (-1, 1)]]


def _quantiles(rows: DataFrame, by: list[str], value: str, cuts: list[float]) -> DataFrame:
    """(by, edges) of groups of any size."""
    return quantiles(rows.select(F.struct(*by).alias("_g"), F.col(value).alias("_x")), "_g", "_x", cuts).select("_g.*", "edges")


def _medians(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """(by, median) of groups of any size."""
    return _quantiles(rows, by, value, [0.5]).select(*by, F.col("edges")[0].alias("median"))


def _hex(x: Column) -> Column:
    return F.lpad(F.lower(F.hex(x.cast("long"))), 8, "0")


def _draws_near(rank: Column, n: Column, reach: float) -> tuple[Column, Column]:
    """Draws, as eight hex digits, between which the rank-th smallest of n is, but for chances that fall with reach; "g" is above all."""
    off = reach * (F.sqrt(rank * (1 - rank / n)) + 1)
    return _hex(F.floor(F.greatest(rank - off, F.lit(0.0)) / n * 2.0**32)), F.when(rank + off >= n, F.lit("g")).otherwise(_hex(F.ceil((rank + off) / n * 2.0**32)))


def _drawn_medians(used: DataFrame, pools: DataFrame, splits: int, seed: int, reach: float) -> DataFrame:
    """(branch, left, what, split, half, dim, median, whole) of all draws; whole: nothing fell outside of where it was looked for.

    Draws are spread evenly, so that of n the rank-th lies near rank / n: rows surely below it are taken, and only those near it are put in order. The median of a
    draw is near its pool's: values farther off are counted, and only those near it are told apart. So hardly any of the rows of all splits are kept or shuffled.
    """
    key, group = ["branch", "left"], ["branch", "left", "what", "split", "half", "dim"]
    m, observed = F.col("m"), F.col("what") == "observed"
    n = F.when(observed, F.when(F.col("side") == 0, F.col("left_count")).otherwise(F.col("right_count"))).otherwise(F.col("left_count") + F.col("right_count"))
    (low, high), (low2, high2) = _draws_near(m, n, reach), _draws_near(2 * m, n, reach)
    need = reach / 2 / F.sqrt("m") + 1 / m
    level = F.coalesce(*[F.when(need <= x, F.lit(i)) for i, x in enumerate(LEVELS)], F.lit(len(LEVELS) - 1))
    at = lambda k: F.transform("around", lambda e: F.element_at(e, 2 * level + k))
    rules = pools.select(*key, "side", "what", "m", "centre", at(2).alias("vlow"), at(3).alias("vhigh"), low.alias("low"), high.alias("high"), low2.alias("low2"), high2.alias("high2"), F.explode(F.sequence(F.lit(0), F.lit(splits - 1))).alias("split"))
    # in one draw's small groups both places touch: all between is put in order
    touch = F.col("high") >= F.col("low2")
    rules = rules.withColumn("high", F.when(~observed & touch, F.col("high2")).otherwise(F.col("high"))).withColumn("low2", F.when(observed, "").when(touch, F.col("high2")).otherwise(F.col("low2")))
    text = F.concat_ws("|", F.lit(seed).cast("string"), "what", F.col("split").cast("string"), F.col("branch").cast("string"), F.col("left").cast("string"), F.lit(""))
    numbered = rules.withColumn("prefix", text).withColumn("draw", F.row_number().over(Window.orderBy(*key, "what", "split", "side")))
    rules = written(numbered, "rules")
    # what a value is does not depend on the split
    rest = lambda y, i: y - F.element_at("centre", i + 1)
    off = lambda x, i: F.when(x < F.element_at("vlow", i + 1), -1).when(x > F.element_at("vhigh", i + 1), 1).otherwise(0)
    placed = F.transform(F.transform("vec", lambda y, i: F.struct(i.alias("dim"), rest(y, i).alias("y"), off(rest(y, i), i).alias("off"))), lambda v: F.struct(v["dim"].alias("dim"), v["off"].alias("off"), F.when(v["off"] == 0, v["y"]).alias("y")))
    kinds_of = rules.select(*key, "side", "what", "centre", "vlow", "vhigh").distinct()
    whats = used.select("cell_id", F.col("cell_id").cast("string").alias("name"), *key, "side", "vec").join(F.broadcast(kinds_of), [*key, "side"]).select("cell_id", "name", *key, "side", "what", placed.alias("values"))
    every = whats.join(F.broadcast(rules.select(*key, "side", "what", "draw", "prefix", "low", "high", "low2", "high2")), [*key, "side", "what"])
    every = every.select("cell_id", "draw", "what", "values", "low", "high", "low2", "high2", F.substring(F.md5(F.concat("prefix", "name").cast("binary")), 1, 8).alias("d"))
    d, noise = F.col("d"), F.col("what") == "noise"
    # 0 and 2 are surely the first and second half's, 1 and 3 near their ends
    zone = F.when(d < F.col("low"), 0).when(d <= F.col("high"), 1).when(noise & (d < F.col("low2")), 2).when(noise & (d <= F.col("high2")), 3)
    items = every.select("cell_id", "draw", "d", zone.alias("zone"), "values").where("zone is not null").select("cell_id", "draw", "d", "zone", F.explode("values").alias("v"))
    near = F.col("zone") % 2 == 1
    items = items.select("draw", "zone", "v.*", F.when(near, F.col("d")).alias("d"), F.when(near, F.col("cell_id")).alias("cell_id"))
    drawn = written(items.groupBy("draw", "zone", "dim", "off", "y", "d", "cell_id").agg(F.count("*").alias("n")), "drawn")
    drawn = drawn.join(F.broadcast(rules.select("draw", *key, "what", "split", "side", "m")), "draw").withColumn("side", F.when(noise, -1).otherwise(F.col("side")))
    sure = drawn.where("zone in (0, 2)").withColumn("half", F.when(noise, F.col("zone") / 2).otherwise(F.col("side")).cast("int"))
    draw_of = [*key, "what", "split", "side", "dim"]
    before = sure.groupBy(*draw_of).agg(F.sum(F.when(F.col("zone") == 0, F.col("n")).otherwise(0)).alias("_first"), F.sum(F.when(F.col("zone") == 2, F.col("n")).otherwise(0)).alias("_second"))
    order = ["d", F.lpad(F.col("cell_id").cast("string"), 20, "0")]
    near = drawn.where("zone in (1, 3)").withColumn("_k", F.row_number().over(Window.partitionBy(*draw_of).orderBy(*order)) - 1).join(F.broadcast(before), draw_of, "left")
    nth = F.col("_k") + F.coalesce("_first", F.lit(0)) + F.when(F.col("zone") == 3, F.coalesce("_second", F.lit(0))).otherwise(0)
    half = F.when(noise, F.when(nth < m, 0).when(nth < 2 * m, 1)).otherwise(F.when(nth < m, F.col("side")))
    taken = near.withColumn("half", half).where("half is not null").select(*group, "m", "off", "y", "n")
    kinds = sure.select(*group, "m", "off", "y", "n").unionByName(taken).where("off <> 0 or y is not null").groupBy(*group, "m", "off", "y").agg(F.sum("n").alias("n"))
    own = Window.partitionBy(*group)
    start = F.coalesce(F.sum("n").over(own.orderBy("off", "y").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = kinds.withColumn("_start", start).withColumn("_all", F.sum("n").over(own))
    lower, upper = F.floor((F.col("_all") - 1) / 2), F.floor(F.col("_all") / 2)
    holds = lambda r: F.max(F.when((F.col("off") == 0) & (F.col("_start") <= r) & (r < F.col("_start") + F.col("n")), F.col("y")))
    found = placed.groupBy(*group).agg(F.first("m").alias("m"), F.first("_all").alias("_all"), holds(lower).alias("_l"), holds(upper).alias("_h"))
    median = F.when(F.col("_all") % 2 == 1, F.col("_l")).otherwise(F.col("_h") - (F.col("_h") - F.col("_l")) * 0.5)
    return written(found.select(*group, median.alias("median"), (median.isNotNull() & (F.col("_all") == F.col("m"))).alias("whole")), "halves")


def boundaries(cells: DataFrame, centres: DataFrame, least: int = 12, splits: int = 20, stability: float = 0.8, seed: int = 0, reach: float = 5.0) -> DataFrame:
    """(branch, left, edge, left_count, right_count, stability, threshold, status): edges between bins at which the cells' states jump.

    cells(cell_id, branch, pseudotime, vec); an edge lies midway between two bins' centres, and a cell belongs to the bin its time falls to by the edges. For each split half of the
    smaller side's number is drawn from both sides, and their medians' distance is compared with that between two such draws from the pool of
    both sides' cells around their own medians. The threshold is the noise distances' median plus three median absolute deviations, stability the share of splits
    above it. Draws are the first by draw(seed, what, split, branch, edge, cell_id), ties by cell_id. Where rows and values are looked for is `reach` deviations wide at first, and widened
    if that was too narrow, so that the result does not depend on it.
    """
    edges = centres.select("branch", F.col("bin").alias("left"), "centre").join(centres.select("branch", (F.col("bin") - 1).alias("left"), F.col("centre").alias("_next")), ["branch", "left"])
    edges = written(edges.select("branch", "left", ((F.col("centre") + F.col("_next")) / 2).alias("edge")), "edges")
    lists = edges.groupBy("branch").agg(F.array_sort(F.collect_list("edge")).alias("cuts"))
    binned = cells.join(F.broadcast(lists), "branch").select("cell_id", "branch", _region("pseudotime").alias("bin"), F.col("vec").cast("array<double>").alias("vec"))
    sided = binned.withColumn("left", F.explode(F.array(F.col("bin") - 1, F.col("bin")))).join(F.broadcast(edges.select("branch", "left")), ["branch", "left"]).withColumn("side", (F.col("bin") > F.col("left")).cast("int"))
    key = ["branch", "left"]
    counts = sided.groupBy(*key).agg(F.sum(1 - F.col("side")).alias("left_count"), F.sum("side").alias("right_count"))
    counts = edges.join(counts, key, "left").select(*key, "edge", F.coalesce("left_count", F.lit(0)).alias("left_count"), F.coalesce("right_count", F.lit(0)).alias("right_count")).withColumn("m", F.greatest(F.lit(1), F.floor(F.least("left_count", "right_count") / 2)))
    counts = written(counts, "sides")
    enough = F.least("left_count", "right_count") >= least
    used = written(sided.join(F.broadcast(counts.where(enough).select(*key, "m")), key).select("cell_id", *key, "side", "m", "vec"), "sided")
    values = used.select(*key, "side", F.posexplode("vec").alias("dim", "y"))
    seen = written(_quantiles(values, [*key, "side", "dim"], "y", AROUND), "around")
    middle = F.broadcast(seen.select(*key, "side", "dim", F.col("edges")[0].alias("median")))
    rest = _quantiles(values.join(middle, [*key, "side", "dim"]).select(*key, "dim", (F.col("y") - F.col("median")).alias("r")), [*key, "dim"], "r", AROUND)
    both = seen.select(*key, "side", "dim", F.lit("observed").alias("what"), F.lit(0.0).alias("c"), "edges").unionByName(rest.join(middle, [*key, "dim"]).select(*key, "side", "dim", F.lit("noise").alias("what"), F.col("median").alias("c"), "edges"))
    listed = both.groupBy(*key, "side", "what").agg(F.array_sort(F.collect_list(F.struct("dim", "c", "edges"))).alias("_d"))
    pools = written(listed.select(*key, "side", "what", F.col("_d.c").alias("centre"), F.col("_d.edges").alias("around")).join(counts.select(*key, "left_count", "right_count", "m"), key), "pools")
    wanted = pools.agg(F.sum(F.size("centre"))).first()[0] or 0
    while True:
        halves = _drawn_medians(used, pools, splits, seed, reach)
        # beyond this, all rows are put in order and all values told apart
        if reach > 1e8 or halves.where("whole").count() == wanted * splits:
            break
        reach = reach * 4 if reach < 100 else 1e9
    apart = halves.groupBy(*key, "what", "split", "dim").agg(F.sum(F.when(F.col("half") == 0, F.col("median")).otherwise(-F.col("median"))).alias("d")).groupBy(*key, "what", "split").agg(F.sqrt(F.sum(F.col("d") * F.col("d"))).alias("d"))
    apart = written(apart, "distances")
    noise = apart.where("what = 'noise'")
    level = _medians(noise, key, "d")
    mad = _medians(noise.join(level, key).select(*key, F.abs(F.col("d") - F.col("median")).alias("d")), key, "d").withColumnRenamed("median", "mad")
    threshold = level.join(mad, key).select(*key, (F.col("median") + 3 * F.col("mad")).alias("threshold"))
    share = apart.where("what = 'observed'").join(threshold, key).groupBy(*key).agg(F.first("threshold").alias("threshold"), F.avg((F.col("d") > F.col("threshold")).cast("double")).alias("stability"))
    status = F.when(F.col("stability").isNull(), "uncertain_insufficient_support").when(F.col("stability") >= stability, "stable").otherwise("uncertain_noise")
    return counts.join(share, key, "left").select(*key, "edge", "left_count", "right_count", "stability", "threshold", status.alias("status"))
