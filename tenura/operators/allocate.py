"""Budget allocation over members, actions and locations.

Each member is one row with an array of candidate actions, so the choice of an action at given
prices needs no shuffle. Prices are a table with one row per location, joined to the members: a scan gives
partial sums for the locations a task has seen, their totals move each location's interval of prices, and the moved
table is the input of the next scan. The driver holds the price of the common budget and sums over all locations.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenura.config import ACTIONS, Action, Limits
from tenura.errors import DataError, InfeasibleError
from tenura.functions import hash_normal, hash_unit, round_dec, safe_div
from tenura.functions.md5 import normals
from tenura.functions.ordered import prefix_sums
from tenura.session import checkpointed

#: Members scored at once in a task, times options, times price points.
CELLS = 1_000_000
#: Random mixtures of allocations that are tried in one job.
MIXTURES = 64
#: Members whose values are drawn at once in a task.
DRAWN = 16384

# ---- candidates and scenarios ----------------------------------------------------------------


def _actions(actions: Sequence[Action]) -> Column:
    return F.array(*[F.struct(F.lit(a.name).alias("action"), F.lit(float(a.cost)).alias("cost"), F.lit(float(a.minutes)).alias("minutes"),
                              F.array(*[F.lit(e) for e in a.eligible]).alias("_eligible")) for a in actions])


def candidates(members: DataFrame, cate: DataFrame, actions: Sequence[Action] = ACTIONS, effect: str = "cate_mean",
               check_eligible: bool = True) -> DataFrame:
    """Rows (member, location, action, cost, minutes, value) with value = ltv times effect (0 if unknown).

    Actions are unfolded from a constant array. ``members`` needs ``ltv``; a missing one is an error
    of the caller, not a random number.
    """
    missing = [c for c in ("member_id", "location_id", "contract_source", "ltv") if c not in members.columns]
    if missing:
        raise DataError(f"members is missing columns {missing}")
    located = members.filter(F.col("location_id").isNotNull())
    long = located.select("member_id", "location_id", "contract_source", "ltv", F.inline(_actions(actions)))
    if check_eligible:
        long = long.filter(F.array_contains("_eligible", F.col("contract_source")))
    known = cate.select("member_id", "action", F.col(effect).alias("_e"))
    value = F.col("ltv") * F.coalesce("_e", F.lit(0.0))
    return long.join(known, ["member_id", "action"], "left").select(
        "member_id", "location_id", "contract_source", "action", "cost", "minutes", value.alias("value"))


def sample_scenarios(cate: DataFrame, n: int = 50, seed: int = 42) -> DataFrame:
    """Normal draws around each effect, clipped to [0, 1]; one row per scenario.

    Draws follow the hash of member, action, scenario and seed, so they do not depend on the
    partitioning or on retries.
    """
    z = hash_normal("member_id", "action", "scenario", seed=seed)
    drawn = F.col("cate_mean") + F.greatest(F.col("cate_std"), F.lit(1e-6)) * z
    rows = cate.select("member_id", "action", "cate_mean", "cate_std", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("scenario"))
    return rows.withColumn("cate_realized", F.greatest(F.lit(0.0), F.least(F.lit(1.0), drawn)))


def _draw(member, action, scenario, mean, std, seed: int) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), mean + F.greatest(std, F.lit(1e-6)) * hash_normal(member, action, scenario, seed=seed)))


def scenario_arrays(cate: DataFrame, n: int = 50, seed: int = 42) -> DataFrame:
    """The same draws as one array per (member, action), without multiplying rows. One expression makes them all: with one each the code is too long to be compiled."""
    draws = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda s: _draw("member_id", "action", s, F.col("cate_mean"), F.col("cate_std"), seed))
    return cate.select("member_id", "action", draws.alias("draws"))


# ---- baseline --------------------------------------------------------------------------------


def uniform_baseline(cands: DataFrame, total_budget: float, ratio_digits: int = 8) -> DataFrame:
    """Equal budget per location, spent greedily by value per cost, one action per member.

    Ties go by the MD5 of the member id. The running cost is split by ratio ranges, so a location
    with a third of all members is not sorted in one task.
    """
    ratio = F.round(F.col("value") / F.col("cost"), ratio_digits)
    best = cands.filter("value > 0").groupBy("member_id", "location_id").agg(
        F.max(F.struct(ratio.alias("ratio"), "action", "cost", "minutes", "value")).alias("_b")).select("member_id", "location_id", "_b.*")
    share = best.select("location_id").distinct().agg(F.count("*").alias("n")).first()["n"]
    if not share:
        return best.drop("ratio")
    run = prefix_sums(best, -F.col("ratio"), ["cost"], ["location_id"], tie=["member_id"], null_keys=False)
    return run.filter(F.col("cum_cost") <= F.lit(total_budget / share)).select(
        "member_id", "location_id", "action", "cost", "minutes", "value")


# ---- priced solution -------------------------------------------------------------------------


@dataclass
class Solution:
    allocation: DataFrame      # member_id, location_id, action, cost, minutes, value
    value: float
    cost: float
    bound: float               # no feasible allocation is worth more
    prices: tuple[float, DataFrame]  # of the common budget, and (location_id, p, v): of cost (the common price included) and minutes

    @property
    def gap(self) -> float:
        return (self.bound - self.value) / max(abs(self.bound), 1e-9)


def member_rows(cands: DataFrame) -> DataFrame:
    """One row per member with its candidates (a handful per member, bounded by the action list)."""
    return cands.groupBy("member_id", "location_id").agg(F.collect_list(F.struct("action", "cost", "minutes", "value")).alias("options"))


def _small(table: DataFrame, numbers: int) -> DataFrame:
    """Broadcast a table of so many numbers while it stays below 32 MB; otherwise leave the join to the optimizer."""
    return F.broadcast(table) if numbers * 16 <= 32 * 2**20 else table


def _per_location(parts: DataFrame, finish, kind: str, keep: Sequence[str] = ()) -> DataFrame:
    """Rows of kind ``kind`` from the sums of the arrays ``net`` of each location and its values in the columns ``keep``.

    ``finish`` turns (locations, sums, kept columns) into the arrays of the columns; a plan has no expression for each entry of the arrays.
    """
    names = [c.strip().split()[0] for c in kind.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at: dict = {}
        sums, kept = [], []
        for b in batches:
            if not b.num_rows:
                continue
            rows = b.column("net").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
            rows = np.where(np.isnan(rows), 0.0, rows)  # an unknown value adds nothing
            codes = b.column("location_id").dictionary_encode()
            loc = codes.indices.to_numpy()
            first = np.unique(loc, return_index=True)[1]
            part = np.zeros((len(first), rows.shape[1]))
            np.add.at(part, loc, rows)
            others = np.column_stack([b.column(c).to_numpy()[first] for c in keep]) if keep else np.empty((len(first), 0))
            for i, name in enumerate(codes.dictionary.to_pylist()):
                if name in at:
                    sums[at[name]] += part[i]
                else:
                    at[name] = len(sums)
                    sums.append(part[i])
                    kept.append(others[i])
        if sums:
            found = finish(np.array(sums), np.array(kept))
            yield pa.RecordBatch.from_arrays([pa.array(list(at), b.column("location_id").type), *found], names)

    return parts.select("location_id", "net", *keep).repartition("location_id").mapInArrow(run, kind)


def _lists(x: np.ndarray) -> pa.Array:
    return pa.array(list(x), pa.list_(pa.float64()))


def _total(rows: DataFrame, column: str) -> np.ndarray | None:
    """The sum of an array column over all rows: one array for each task returns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        acc = 0
        for b in batches:
            if b.num_rows:
                acc = acc + b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1).sum(0)
        if np.ndim(acc):
            yield pa.RecordBatch.from_arrays([_lists([acc])], ["v"])

    parts = [np.array(r["v"]) for r in rows.select(column).mapInArrow(run, "v array<double>").toLocalIterator()]
    return sum(parts) if parts else None


def _evaluate(rows: DataFrame, prices: DataFrame, expand, locations: int, keep: Sequence[str] = ()) -> DataFrame:
    """Partial sums (location_id, net, cost, minutes): for each price point of a location, an array entry with the dual
    value, the cost and the minutes of its members' best choices.

    ``prices`` has four numbers a, b, c, d per location; ``expand`` turns an array of these into points (location, point,
    2) of cost and minute prices. A task gives out sums for the locations of a batch only, so nothing grows with all locations. Columns
    ``keep`` of the prices are given out too.
    """
    kind = dict(rows.dtypes)["location_id"]

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            codes = batch.column("location_id").dictionary_encode()
            loc = codes.indices.to_numpy()
            first = np.unique(loc, return_index=True)[1]
            grid = expand(np.column_stack([batch.column(c).to_numpy()[first] for c in "abcd"]))
            width = grid.shape[1]
            options = batch.column("options")
            lens, flat = options.value_lengths().to_numpy(), options.flatten()
            row = np.repeat(np.arange(len(lens)), lens)
            slot = np.arange(len(row)) - np.repeat(np.cumsum(lens) - lens, lens)
            most = int(lens.max(initial=0))
            value, cost, minutes = np.full((len(lens), most), -np.inf), np.zeros((len(lens), most)), np.zeros((len(lens), most))
            for target, name in ((value, "value"), (cost, "cost"), (minutes, "minutes")):
                target[row, slot] = flat.field(name).to_numpy(zero_copy_only=False)
            sums = np.zeros((3, len(first), width))
            step = max(1, CELLS // max(1, most * width))
            for i in range(0, len(lens) if most else 0, step):
                at = slice(i, i + step)
                g = grid[loc[at]]
                net = value[at][:, :, None] - cost[at][:, :, None] * g[:, None, :, 0] - minutes[at][:, :, None] * g[:, None, :, 1]
                pick = net.argmax(axis=1)
                best = np.take_along_axis(net, pick[:, None, :], axis=1)[:, 0, :]
                take = best > 0
                for k, part in enumerate((best, np.take_along_axis(cost[at], pick, axis=1), np.take_along_axis(minutes[at], pick, axis=1))):
                    np.add.at(sums[k], loc[at], np.where(take, part, 0.0))
            yield pa.RecordBatch.from_arrays([codes.dictionary, *map(_lists, sums), *[batch.column(c).take(pa.array(first)) for c in keep]], ["location_id", "net", "cost", "minutes", *keep])

    columns = list(dict.fromkeys(("a", "b", "c", "d", *keep)))
    joined = rows.select("location_id", "options").join(_small(prices.select("location_id", *columns), (1 + len(columns)) * locations), "location_id")
    return joined.mapInArrow(partial, f"location_id {kind}, net array<double>, cost array<double>, minutes array<double>" + "".join(f", {c} double" for c in keep))


def _square(points: int):
    """Price points of a box (a..b of cost, c..d of minutes): a square grid."""

    def expand(box: np.ndarray) -> np.ndarray:
        share = np.linspace(0.0, 1.0, points)
        p = box[:, 0, None] + (box[:, 1] - box[:, 0])[:, None] * share
        v = box[:, 2, None] + (box[:, 3] - box[:, 2])[:, None] * share
        return np.stack([np.repeat(p, points, axis=1), np.tile(v, (1, points))], axis=2)

    return expand


def _levels(levels: Sequence[float]):
    """Price points of a location (cost price a, minute price c) at several common prices: the larger of both."""

    def expand(box: np.ndarray) -> np.ndarray:
        p = np.maximum(box[:, 0, None], np.asarray(levels, float)[None, :])
        return np.stack([p, np.repeat(box[:, 2, None], p.shape[1], axis=1)], axis=2)

    return expand


def _at(prices: DataFrame) -> DataFrame:
    return prices.select("location_id", F.col("p").alias("a"), F.col("p").alias("b"), F.col("v").alias("c"), F.col("v").alias("d"))


def location_prices(rows: DataFrame, ceiling: DataFrame, limits: Limits, locations: int, passes: int = 6, points: int = 7, common: float = 0.0,
                    start: DataFrame | None = None) -> DataFrame:
    """(location_id, p, v): cost and minute prices that minimise each location's dual, all locations at once.

    Each location has a box of prices. A pass sums the dual at a grid of points of every box and moves the box to the best
    point so far and its neighbours, which enclose the minimum as the dual is convex; the moved boxes are joined to the members in the
    next pass. Cost prices are at least the price of the common budget; ``start`` (prices of a similar problem)
    narrows the first box.
    """
    minutes, low = limits.staff_hours * 60, F.lit(float(common))
    top_p, top_v = F.greatest("c_max", low), F.greatest("m_max", F.lit(0.0))
    box = ceiling
    if start is None:
        box = box.select("location_id", low.alias("a"), top_p.alias("b"), F.lit(0.0).alias("c"), top_v.alias("d"))
    else:
        box = box.join(start.select("location_id", "p", "v"), "location_id", "left")
        near = lambda x, top, least: (F.greatest(F.col(x), least), F.lit(0.3) * F.col(x) + F.lit(0.02) * top)
        (pm, ph), (vm, vh) = near("p", top_p, low), near("v", top_v, F.lit(0.0))
        box = box.select("location_id", F.coalesce(F.greatest(low, pm - ph), low).alias("a"), F.coalesce(pm + ph, top_p).alias("b"),
                         F.coalesce(F.greatest(F.lit(0.0), vm - vh), F.lit(0.0)).alias("c"), F.coalesce(vm + vh, top_v).alias("d"))
    box = checkpointed(box.withColumns({"dual": F.lit(math.inf), "p": low, "v": F.lit(0.0)}))
    kind, expand, common = dict(rows.dtypes)["location_id"], _square(points), float(common)
    names = ["a", "b", "c", "d", "dual", "p", "v"]

    def move(sums: np.ndarray, now: np.ndarray) -> list[pa.Array]:
        grid = expand(now)
        dual = sums + (grid[:, :, 0] - common) * limits.max_per_location + grid[:, :, 1] * minutes
        tried = np.concatenate([now[:, None, 4:], np.concatenate([dual[:, :, None], grid], axis=2)], axis=1)  # dual, p, v of the best so far and of all points
        at = np.lexsort((tried[:, :, 2], tried[:, :, 1], tried[:, :, 0]), axis=1)[:, 0]
        best = tried[np.arange(len(tried)), at]
        near = lambda x, lo, hi: (x - (now[:, hi] - now[:, lo]) * 1.1 / (points - 1), x + (now[:, hi] - now[:, lo]) * 1.1 / (points - 1))
        (p0, p1), (v0, v1) = near(best[:, 1], 0, 1), near(best[:, 2], 2, 3)
        return [pa.array(x) for x in (np.maximum(common, p0), p1, np.maximum(0.0, v0), v1, *best.T)]

    for _ in range(passes):
        box = checkpointed(_per_location(_evaluate(rows, box, expand, locations, names), move, f"location_id {kind}, " + ", ".join(f"{c} double" for c in names), names))
    return box.select("location_id", "p", "v")


def _grid(low: float, high: float, n: int) -> list[float]:
    return [low + (high - low) * i / (n - 1) for i in range(n)] if high > low else [low]


def _global_price(rows: DataFrame, prices: DataFrame, locations: int, ceiling: float, limits: Limits, guess: float = 0.0, passes: int = 4, points: int = 9) -> float:
    """Price of the common budget: locations pay the larger of it and their own price."""
    low, high = (0.8 * guess, 1.25 * guess) if guess > 0 else (0.0, ceiling)
    for _ in range(passes):
        levels = _grid(low, high, points)
        spend = _evaluate(rows, _at(prices), _levels(levels), locations).agg(*[F.sum(F.col("cost")[i]) for i in range(len(levels))]).first()
        fits = [i for i, s in enumerate(spend) if (s or 0.0) <= limits.total_budget]
        if not fits:
            low, high = levels[-1], levels[-1] * 2 + 1e-6
        elif fits[0] > 0:
            low, high = levels[fits[0] - 1], levels[fits[0]]
        elif levels[0] > 0:
            low, high = 0.0, levels[0]
        else:
            return 0.0
    return high


def _prices(rows: DataFrame, ceiling: DataFrame, locations: int, limits: Limits, passes: int, points: int, start: tuple[float, DataFrame] | None = None) -> tuple[float, DataFrame]:
    """The common price and the location prices, found in turn: each sees the other's last value."""
    guess, near = start or (0.0, None)
    own = location_prices(rows, ceiling, limits, locations, passes, points, 0.0 if start is None else guess, near)
    common = guess
    if limits.max_per_location * locations <= limits.total_budget:
        return 0.0, own
    top = ceiling.agg(F.max("c_max")).first()[0]
    for _ in range(2 if start is None else 1):
        free = own.withColumn("p", F.when(F.col("p") > F.lit(common), F.col("p")).otherwise(0.0))
        common = _global_price(rows, free, locations, top, limits, common, 4 if common == 0 else 2)
        own = location_prices(rows, ceiling, limits, locations, max(2, passes // 2), points, common, own)
    return common, own


def dual_value(rows: DataFrame, prices: DataFrame, common: float, limits: Limits, locations: int | None = None) -> float:
    """What no feasible allocation can exceed, at any given prices (location_id, p, v) with p at least ``common``."""
    n = prices.count() if locations is None else locations
    net = _evaluate(rows, _at(prices), _levels([0.0]), n).agg(F.sum(F.col("net")[0])).first()[0] or 0.0
    held = prices.agg(F.sum((F.col("p") - F.lit(common)) * F.lit(limits.max_per_location) + F.col("v") * F.lit(limits.staff_hours * 60.0))).first()[0] or 0.0
    return common * limits.total_budget + net + held


def feasibility(rows: DataFrame, limits: Limits) -> DataFrame:
    """Per location: what its members can cost at most (``most``), whether that meets the floor, and the best value per cost and per minute."""
    dearest = F.array_max(F.transform("options", lambda o: o["cost"]))
    per_cost = F.array_max(F.transform("options", lambda o: o["value"] / F.greatest(o["cost"], F.lit(1e-6))))
    per_minute = F.array_max(F.transform("options", lambda o: F.when(o["minutes"] > 0, o["value"] / o["minutes"]).otherwise(0.0)))
    got = rows.groupBy("location_id").agg(F.sum(dearest).alias("most"), F.greatest(F.max(per_cost), F.lit(0.0)).alias("c_max"), F.greatest(F.max(per_minute), F.lit(0.0)).alias("m_max"))
    return got.select("location_id", "most", (F.col("most") >= F.lit(limits.min_per_location)).alias("meets_floor"), "c_max", "m_max")


def check_feasible(rows: DataFrame, limits: Limits) -> tuple[DataFrame, int]:
    """The table of ``feasibility`` and the number of locations; an error when the floors cannot be met."""
    table = checkpointed(feasibility(rows, limits))
    one = table.agg(F.count("*").alias("n"), F.count_if(~F.col("meets_floor")).alias("poor")).first()
    floor = limits.min_per_location
    if floor > limits.max_per_location:
        raise InfeasibleError("the minimum per location exceeds the maximum")
    if floor * one["n"] > limits.total_budget:
        raise InfeasibleError(f"{one['n']} locations need {floor * one['n']:.2f}, the budget is {limits.total_budget:.2f}")
    if one["poor"]:
        some = [r["location_id"] for r in table.filter(~F.col("meets_floor")).orderBy("location_id").limit(5).collect()]
        raise InfeasibleError(f"{one['poor']} locations without candidates for the minimum, such as {some}")
    return table, one["n"]


def _accept(rows: DataFrame, prices: DataFrame, locations: int, limits: Limits, floor: float, rounds: int) -> DataFrame:
    """A feasible allocation: members in the order of value per priced resource, cut at the limits.

    The first round offers each member the best option at the prices. Further rounds offer what is
    left of every limit: a first action to members without one, or a better action in place of the
    present one, ordered by added value per added resource. Running totals are distributed; what is left of a location's
    limits stands beside its prices.
    """
    minutes, budget = float(limits.staff_hours * 60), limits.total_budget
    left = prices.select("location_id", F.col("p").alias("_p"), F.col("v").alias("_v"), F.lit(float(limits.max_per_location)).alias("_cap"), F.lit(minutes).alias("_min"))
    none = F.struct(F.lit("").alias("action"), F.lit(0.0).alias("cost"), F.lit(0.0).alias("minutes"), F.lit(0.0).alias("value"))
    state = rows.withColumn("cur", none)
    for i in range(rounds):
        dc = lambda o: o["cost"] - F.col("cur")["cost"]
        dm = lambda o: o["minutes"] - F.col("cur")["minutes"]
        dv = lambda o: o["value"] - F.col("cur")["value"]
        price = lambda o: F.col("_p") * dc(o) + F.col("_v") * dm(o)
        least = F.lit(0.0) if floor > 0 and i == 0 else F.lit(1e-9)
        fits = F.filter("options", lambda o: (dc(o) <= F.col("_cap")) & (dm(o) <= F.col("_min")) & (dv(o) >= least))
        scored = F.transform(fits, lambda o: F.struct(
            F.round(F.greatest(dv(o) - price(o), F.lit(0.0)), 9).alias("net"), F.round(dv(o) / F.greatest(price(o), F.lit(1e-9)), 9).alias("ratio"),
            dc(o).alias("cost"), dm(o).alias("minutes"), F.struct(o["action"].alias("action"), o["cost"].alias("cost"), o["minutes"].alias("minutes"), o["value"].alias("value")).alias("new")))
        pick = state.join(_small(left, 5 * locations), "location_id").select("member_id", "location_id", "_cap", "_min", F.array_max(scored).alias("_b")).filter(
            "_b is not null").select("member_id", "location_id", "_cap", "_min", "_b.*")
        pick = checkpointed(pick)  # read for the ranges, their totals and the rows
        run = prefix_sums(pick, -F.col("ratio"), ["cost", "minutes"], ["location_id"], tie=["member_id"], null_keys=False)
        local = run.filter((F.col("cum_cost") <= F.col("_cap")) & (F.col("cum_minutes") <= F.col("_min"))).select(
            "member_id", "location_id", "cost", "minutes", "new", "ratio",
            ((F.col("cum_cost") - F.col("cost") < F.lit(floor)) & F.lit(i == 0)).alias("_floor"))
        local = checkpointed(local)
        spend = local.agg(F.count("*").alias("n"), F.sum("cost").alias("c"), F.sum(F.when(F.col("_floor"), F.col("cost"))).alias("f")).first()
        if (spend["c"] or 0.0) > budget + 1e-9:
            room = budget - (spend["f"] or 0.0)
            extra = prefix_sums(local.filter("not _floor"), -F.col("ratio"), ["cost"], tie=["member_id"])
            local = checkpointed(local.filter("_floor").unionByName(extra.filter(F.col("cum_cost") <= F.lit(room)).drop("cum_cost", "total_cost")))
            spend = local.agg(F.count("*").alias("n"), F.sum("cost").alias("c")).first()
        if not spend["n"]:
            break
        state = checkpointed(state.join(_small(local.select("member_id", "new"), 8 * spend["n"]), "member_id", "left").withColumn("cur", F.coalesce("new", "cur")).drop("new"))
        used = local.groupBy("location_id").agg(F.sum("cost").alias("_uc"), F.sum("minutes").alias("_um"))
        left = checkpointed(left.join(used, "location_id", "left").select(
            "location_id", "_p", "_v", (F.col("_cap") - F.coalesce("_uc", F.lit(0.0))).alias("_cap"), (F.col("_min") - F.coalesce("_um", F.lit(0.0))).alias("_min")))
        budget -= spend["c"]
    return state.filter("cur.action <> ''").select("member_id", "location_id", "cur.*")


def solve(cands: DataFrame, limits: Limits = Limits(), use_floor: bool = False, passes: int = 6, points: int = 7, rounds: int = 3) -> Solution:
    """Allocate actions to members under the total budget, the location caps and staff minutes.

    Prices minimise the Lagrangian dual, whose value bounds every allocation from above; a
    feasible allocation is then cut along the priced order. ``gap`` certifies the quality.
    """
    return _solve_rows(checkpointed(member_rows(cands)), limits, use_floor, passes, points, rounds)


def _solve_rows(rows: DataFrame, limits: Limits, use_floor: bool, passes: int, points: int, rounds: int, start: tuple[float, DataFrame] | None = None) -> Solution:
    floor = limits.min_per_location if use_floor else 0.0
    ceiling, n = check_feasible(rows, limits if use_floor else replace(limits, min_per_location=0.0))
    if not n:
        raise InfeasibleError("there are no candidates")
    common, prices = _prices(rows, ceiling, n, limits, passes, points, start)
    bound = dual_value(rows, prices, common, limits, n)
    allocation = _accept(rows, prices, n, limits, floor, rounds)
    total = allocation.agg(F.coalesce(F.sum("value"), F.lit(0.0)).alias("v"), F.coalesce(F.sum("cost"), F.lit(0.0)).alias("c")).first()
    return Solution(allocation, total["v"], total["c"], bound, (common, prices))


def violations(allocation: DataFrame, cands: DataFrame, limits: Limits, floor: bool = False) -> DataFrame:
    """How often an allocation breaks each limit, all counted from the allocation and the candidates: one row, all zero if it is feasible.

    Rows that are no candidate (or not at its cost, minutes and location), members with more than one action, locations above their
    cap or minutes or (with ``floor``) below their minimum, and the amount above the total budget.
    """
    keys = ["member_id", "location_id", "action", "cost", "minutes"]
    unknown = allocation.select(*keys).join(cands.select(*keys), keys, "left_anti").agg(F.count("*").alias("not_a_candidate"))
    twice = allocation.groupBy("member_id").count().agg(F.count_if(F.col("count") > 1).alias("members_twice"))
    per = cands.select("location_id").distinct().join(allocation.groupBy("location_id").agg(F.sum("cost").alias("c"), F.sum("minutes").alias("m")), "location_id", "left")
    c, m = F.coalesce("c", F.lit(0.0)), F.coalesce("m", F.lit(0.0))
    least = limits.min_per_location if floor else 0.0
    at = per.agg(
        F.count_if(c > limits.max_per_location + 1e-6).alias("locations_over_cap"), F.count_if(m > limits.staff_hours * 60 + 1e-6).alias("locations_over_minutes"),
        F.count_if(c < least - 1e-6).alias("locations_below_floor"), F.greatest(F.lit(0.0), F.sum(c) - F.lit(limits.total_budget + 1e-6)).alias("over_budget"))
    return unknown.join(twice, F.lit(True)).join(at, F.lit(True))


# ---- uncertainty -----------------------------------------------------------------------------


def evaluate_scenarios(allocation: DataFrame, scenarios: DataFrame, ltv: DataFrame) -> DataFrame:
    """Mean, extremes, population deviation and robust gap of an allocation's value over scenarios.

    ``scenarios`` holds (member, action, scenario, cate_realized); a missing effect counts 0.
    """
    totals = _scenario_totals(allocation, scenarios, ltv)
    return totals.agg(F.count("*").alias("n_scenarios"), round_dec(F.avg("v"), 4).alias("expected_mrr"), round_dec(F.min("v"), 4).alias("worst_case_mrr"),
                      round_dec(F.max("v"), 4).alias("best_case_mrr"), round_dec(F.stddev_pop("v"), 4).alias("mrr_std"),
                      round_dec(F.avg("v") - F.min("v"), 4).alias("robust_gap"))


def _scenario_totals(allocation: DataFrame, scenarios: DataFrame, ltv: DataFrame) -> DataFrame:
    valued = allocation.select("member_id", "action").join(ltv.select("member_id", "ltv"), "member_id")
    hits = scenarios.select("member_id", "action", "scenario", "cate_realized").join(valued, ["member_id", "action"])
    found = hits.groupBy("scenario").agg(F.sum(F.col("ltv") * F.col("cate_realized")).alias("v"))
    every = scenarios.select("scenario").distinct()
    return every.join(found, "scenario", "left").select("scenario", F.coalesce("v", F.lit(0.0)).alias("v"))


def compare_allocations(a: DataFrame, b: DataFrame, scenarios: DataFrame, ltv: DataFrame) -> DataFrame:
    """Second allocation against the first: value differences in percent and overlap of (member, action)."""
    tag = lambda df, s: evaluate_scenarios(df, scenarios, ltv).select(F.lit(1).alias("_k"), *[
        F.col(c).alias(f"{c}_{s}") for c in ("expected_mrr", "worst_case_mrr", "robust_gap")])
    cost = lambda df, s: df.agg(F.lit(1).alias("_k"), round_dec(F.coalesce(F.sum("cost"), F.lit(0.0)), 2).alias(f"total_cost_{s}"), F.count("*").alias(f"members_{s}"))
    pairs = a.select("member_id", "action", F.lit(1).alias("_a")).join(b.select("member_id", "action", F.lit(1).alias("_b")), ["member_id", "action"], "full")
    overlap = pairs.agg(F.lit(1).alias("_k"), F.count_if(F.col("_a").isNotNull() & F.col("_b").isNotNull()).alias("_both"), F.count("*").alias("_any"))
    one = tag(a, "a").join(tag(b, "b"), "_k").join(cost(a, "a"), "_k").join(cost(b, "b"), "_k").join(overlap, "_k")
    diff = lambda c: round_dec((F.col(f"{c}_b") - F.col(f"{c}_a")) / F.greatest(F.abs(f"{c}_a"), F.lit(1e-6)) * 100, 4)
    return one.select("total_cost_a", "members_a", "expected_mrr_a", "worst_case_mrr_a", "robust_gap_a", "total_cost_b", "members_b", "expected_mrr_b",
                      "worst_case_mrr_b", "robust_gap_b", diff("expected_mrr").alias("expected_mrr_diff_pct"), diff("worst_case_mrr").alias("worst_case_mrr_diff_pct"),
                      round_dec(F.coalesce(safe_div(F.col("_both"), F.nullif(F.col("_any"), F.lit(0))), F.lit(0.0)), 6).alias("jaccard"))


@dataclass
class StochasticSolution(Solution):
    objective: float = 0.0
    scenario_values: tuple[float, ...] = ()
    rounds: int = 0  # priced problems that were solved for it

    @property
    def robust_gap(self) -> float:
        return sum(self.scenario_values) / len(self.scenario_values) - min(self.scenario_values)

    @property
    def gap(self) -> float:
        return (self.bound - self.objective) / max(abs(self.bound), 1e-9)


def stochastic_rows(members: DataFrame, cate: DataFrame, n: int = 50, seed: int = 42, actions: Sequence[Action] = ACTIONS) -> DataFrame:
    """Member rows whose options carry one value per scenario as an array.

    Rows move with the mean and the deviation of their effects; the draws are made where the members are. They are those of ``scenario_arrays``.
    """
    cands = candidates(members, cate, actions)
    ltv = members.select("member_id", "ltv")
    effects = cate.select("member_id", "action", "cate_mean", "cate_std", F.lit(True).alias("known"))
    full = cands.drop("value").join(effects, ["member_id", "action"], "left").join(ltv, "member_id")
    text = F.concat_ws("|", F.col("member_id").cast("string"), "action").alias("text")
    parts = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # the draws are many times what moves here, so parts are not joined by its size
    lean = full.repartition(parts, "member_id", "location_id").groupBy("member_id", "location_id").agg(F.collect_list(F.struct("action", "cost", "minutes", "cate_mean", "cate_std", "known", "ltv", text)).alias("options"))
    kinds, scenarios = dict(lean.dtypes), range(n)

    def drawn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, DRAWN):
                b = whole.slice(at, DRAWN)
                lists = b.column("options")
                o = lists.flatten()
                number = lambda c: o.field(c).to_numpy(zero_copy_only=False)[:, None]  # noqa: B023, E731
                std = np.maximum(pc.fill_null(o.field("cate_std"), 0.0).to_numpy(zero_copy_only=False)[:, None], 1e-6)
                draws = np.fmax(0.0, np.fmin(1.0, number("cate_mean") + std * normals(o.field("text").to_pylist(), scenarios, seed)))
                known = pc.fill_null(o.field("known"), False).to_numpy(zero_copy_only=False)[:, None]
                values = np.where(known, draws, 0.0) * number("ltv")
                unknown = np.repeat(pc.is_null(o.field("ltv")).to_numpy(zero_copy_only=False), n)
                values = pa.ListArray.from_arrays(pa.array(np.arange(len(o) + 1) * n, pa.int32()), pa.array(values.ravel(), mask=unknown))
                made = pa.StructArray.from_arrays([o.field("action"), o.field("cost"), o.field("minutes"), values], ["action", "cost", "minutes", "values"])
                ends = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])
                yield pa.RecordBatch.from_arrays([b.column("member_id"), b.column("location_id"), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), made)], ["member_id", "location_id", "options"])

    return checkpointed(lean.mapInArrow(drawn, f"member_id {kinds['member_id']}, location_id {kinds['location_id']}, options array<struct<action:string,cost:double,minutes:double,values:array<double>>>"))


class Bundle:
    """What the priced problems solved so far say about scenario weights, shared by all levels of risk aversion.

    Solved with weights c, a problem gives an allocation with its value in every scenario (a cut of the dual function, at any
    weights), and a bound: no allocation is worth more than that at c. Level r asks for weights c = (1 - r) / n + r w with w
    on the simplex, so a bound found at c holds for every level whose least weight (1 - r) / n is at most min(c).
    """

    def __init__(self, rows: DataFrame, n: int, limits: Limits, use_floor: bool, passes: int, points: int):
        self.rows, self.n, self.limits, self.use_floor, self.passes, self.points = rows, n, limits, use_floor, passes, points
        self.found: list[tuple[DataFrame, float, np.ndarray, DataFrame]] = []  # allocation, cost, totals, and per location the sums of cost and totals
        self.bounds: list[tuple[np.ndarray, float]] = []
        self.start: tuple[float, DataFrame] | None = None

    def worth(self, totals: np.ndarray, risk: float) -> float:
        return float((1 - risk) * totals.mean() + risk * totals.min())

    def bound(self, risk: float) -> tuple[float, np.ndarray]:
        """The least bound that holds at a level, with its scenario weights w."""
        least = (1 - risk) / self.n
        mine = [(b, c) for c, b in self.bounds if c.min() >= least - 1e-12]
        if not mine:
            return math.inf, np.full(self.n, 1 / self.n)
        b, c = min(mine, key=lambda x: x[0])
        return b, np.maximum(c - least, 0.0) / risk if risk > 0 else np.full(self.n, 1 / self.n)

    def best(self, risk: float) -> int:
        return max(range(len(self.found)), key=lambda i: self.worth(self.found[i][2], risk))

    def add(self, allocation: DataFrame) -> None:
        options = self.rows.select("member_id", "location_id", F.explode("options").alias("_o")).select("member_id", "location_id", "_o.action", "_o.cost", "_o.values")
        chosen = options.join(_small(allocation.select("member_id", "action"), 3 * allocation.count()), ["member_id", "action"])
        kind = dict(self.rows.dtypes)["location_id"]
        parts = chosen.select("location_id", F.concat(F.array("cost"), "values").alias("net"))
        per = checkpointed(_per_location(parts, lambda sums, _: [_lists(sums)], f"location_id {kind}, sums array<double>"))
        total = _total(per, "sums")
        total = np.zeros(1 + self.n) if total is None else total
        self.found.append((allocation, float(total[0]), total[1:], per))

    def solve(self, w: np.ndarray, risk: float) -> None:
        """Price the problem at scenario weights w and keep its cut and its bound."""
        c = (1 - risk) / self.n + risk * w
        coef = F.lit([float(x) for x in c])
        mixed = checkpointed(self.rows.withColumn("options", F.transform("options", lambda o: F.struct(
            o["action"].alias("action"), o["cost"].alias("cost"), o["minutes"].alias("minutes"),
            F.aggregate(F.zip_with(o["values"], coef, lambda v, k: v * k), F.lit(0.0), lambda s, x: s + x).alias("value")))))
        passes = self.passes if self.start is None else max(2, self.passes // 2)
        got = _solve_rows(mixed, self.limits, self.use_floor, passes, self.points, 3, self.start)
        self.start = got.prices
        self.bounds.append((c, got.bound))
        self.add(got.allocation)

    def master(self, risk: float, center: np.ndarray, step: float, iterations: int = 4000) -> tuple[np.ndarray, np.ndarray]:
        """Weights w that minimise the largest cut plus an entropy term around ``center``, and the mixture of cuts that holds them there.

        For a mixture m of the cuts the best w is proportional to center * exp(-step * risk * totals of the mixture); what is
        left is smooth in m and climbed by multiplicative steps.
        """
        t = np.array([f[2] for f in self.found])
        scale = max(float(np.ptp(t, axis=1).max()), 1e-9)
        m, out = np.full(len(t), 1 / len(t)), np.zeros(len(t))
        for k in range(iterations):
            z = -step * (m @ t) / scale
            w = center * np.exp(z - z.max())
            w /= w.sum()
            g = ((1 - risk) * t.mean(axis=1) + risk * t @ w) / scale
            m = m * np.exp((g - g.max()) * 4 / math.sqrt(1 + k / 50))
            m /= m.sum()
            out += m
        return w, out / out.sum()

    def mix(self, mixture: np.ndarray, risk: float, seed: int) -> None:
        """Give each location the allocation of one cut, drawn by the mixture; of MIXTURES draws within the budget the best one is kept if it is better.

        Every location keeps its own limits, as it takes over a whole feasible plan. All draws are summed in one job.
        """
        use = [i for i in np.argsort(-mixture) if mixture[i] > 0.01][:8]
        if len(use) < 2:
            return
        edges, width = np.cumsum(mixture[use] / mixture[use].sum())[:-1], 1 + self.n
        plans = None
        for k, i in enumerate(use):
            one = self.found[i][3].select("location_id", F.lit(k).alias("plan"), "sums")
            plans = one if plans is None else plans.unionByName(one)
        draw = lambda s: sum([F.when(hash_unit("location_id", s, seed=seed) > F.lit(float(e)), 1).otherwise(0) for e in edges], F.lit(0))
        drawn = plans.select("plan", "sums", F.transform(F.sequence(F.lit(0), F.lit(MIXTURES - 1)), lambda s: hash_unit("location_id", s, seed=seed)).alias("u"))

        def taken(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            acc = np.zeros((MIXTURES, width))
            for b in batches:
                if b.num_rows:
                    u, sums = (b.column(c).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1) for c in ("u", "sums"))
                    mine = np.searchsorted(edges, u, side="left") == b.column("plan").to_numpy()[:, None]  # how many edges lie below the draw
                    acc += mine.T.astype(float) @ sums
            yield pa.RecordBatch.from_arrays([_lists([acc.ravel()])], ["sums"])

        sums = _total(drawn.mapInArrow(taken, "sums array<double>"), "sums").reshape(MIXTURES, width)
        fits = [s for s in range(MIXTURES) if sums[s, 0] <= self.limits.total_budget + 1e-9]
        if not fits:
            return
        top = max(fits, key=lambda s: self.worth(sums[s, 1:], risk))
        if self.worth(sums[top, 1:], risk) <= self.worth(self.found[self.best(risk)][2], risk):
            return
        picked = None
        for k, i in enumerate(use):
            one = self.found[i][0].where(draw(F.lit(top)) == k)
            picked = one if picked is None else picked.unionByName(one)
        self.add(checkpointed(picked))

    def level(self, risk: float, rounds: int, tolerance: float) -> StochasticSolution:
        """Solve at weights the master proposes until the gap is closed or the rounds are used up."""
        done, step = 0, 8.0
        while True:
            bound, center = self.bound(risk)
            top = self.worth(self.found[self.best(risk)][2], risk) if self.found else -math.inf
            if self.found and math.isfinite(bound) and (bound - top <= tolerance * abs(bound) or done >= rounds or risk == 0):
                break
            if not self.found or risk == 0:
                w = np.full(self.n, 1 / self.n)
            else:
                w, mixture = self.master(risk, center, step)
                self.mix(mixture, risk, len(self.found))
                top = self.worth(self.found[self.best(risk)][2], risk)
                if math.isfinite(bound) and bound - top <= tolerance * abs(bound):
                    break
            self.solve(w, risk)
            done += 1
            step = step * 1.5 if self.bounds[-1][1] < bound else step / 2
        i = self.best(risk)
        allocation, cost, totals, _ = self.found[i]
        return StochasticSolution(allocation, float(totals.mean()), cost, bound, self.start, self.worth(totals, risk), tuple(map(float, totals)), done)


def solve_stochastic(rows: DataFrame, n: int, risk: float = 0.3, limits: Limits = Limits(), use_floor: bool = True, rounds: int = 8,
                     tolerance: float = 0.004, passes: int = 6, points: int = 7, bundle: Bundle | None = None) -> StochasticSolution:
    """Maximise (1 - risk) * mean + risk * worst scenario under all limits and the location floor.

    The worst case is the least value over weights of the scenarios. A bundle of solved problems proposes the next weights: a
    small master on the driver (scenarios times problems solved) finds the weights at which the best allocation known is
    worth least, near the best ones so far. Every problem bounds the optimum from above, so ``gap`` is certified; the search ends
    when it is within ``tolerance`` or after ``rounds`` problems. Mixtures of the plans found, location by location, are
    tried as allocations too.
    """
    return (bundle or Bundle(rows, n, limits, use_floor, passes, points)).level(risk, rounds, tolerance)


def efficient_frontier(rows: DataFrame, n: int, risks: Sequence[float] = (0.0, 0.1, 0.2, 0.3, 0.5, 0.8, 1.0), limits: Limits = Limits(),
                       rounds: int = 6, tolerance: float = 0.004) -> DataFrame:
    """Expected against worst-case value over rising risk aversion, with the certified gap of each level.

    All levels share one bundle: an allocation found for one is a cut for every other, and a bound holds for all higher levels.
    """
    bundle = Bundle(rows, n, limits, True, 6, 7)
    for r in risks:
        bundle.level(r, rounds, tolerance)
    out = []
    for r in risks:
        allocation, cost, totals, _ = bundle.found[bundle.best(r)]
        bound = bundle.bound(r)[0]
        out.append((float(r), float(totals.mean()), float(totals.min()), float(totals.std()), allocation.count(), cost, (bound - bundle.worth(totals, r)) / max(abs(bound), 1e-9)))
    return rows.sparkSession.createDataFrame(out, "risk_aversion double, expected_mrr double, worst_case_mrr double, mrr_std double, "
                                                  "members_targeted bigint, total_cost double, gap double")


# ---- reports ---------------------------------------------------------------------------------


def location_plan(allocation: DataFrame) -> DataFrame:
    """Per location: members, action mix as text (most frequent first), budget, retained value, return."""
    per = allocation.groupBy("location_id", "action").agg(F.count("*").alias("n"), F.sum("cost").alias("cost"), F.sum(F.round("value", 2)).alias("value"))
    mix = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("o"), F.col("action").alias("a"))))
    agg = per.groupBy("location_id").agg(F.sum("n").alias("n_members_targeted"), mix.alias("_m"), F.sum("cost").alias("_c"), F.sum("value").alias("_v"))
    text = F.array_join(F.transform("_m", lambda x: F.concat(x["a"], F.lit("("), (-x["o"]).cast("string"), F.lit(")"))), ", ")
    return agg.select("location_id", "n_members_targeted", text.alias("action_mix"), round_dec(F.col("_c"), 2).alias("budget_allocated"),
                      round_dec(F.col("_v"), 2).alias("expected_retained_mrr"), round_dec(F.try_divide("_v", "_c"), 2).alias("roi"))


def action_pivot(allocation: DataFrame, actions: Sequence[Action] = ACTIONS) -> DataFrame:
    names = [a.name for a in actions]
    return allocation.groupBy("location_id").pivot("action", names).count().fillna(0, names)


def simulate_intervention(members: DataFrame, cate: DataFrame, segment: Column, actions: Sequence[Action] = ACTIONS) -> DataFrame:
    """Effect of giving every eligible member of a segment each action: members, saves, cost, retained value."""
    cands = candidates(members.filter(segment), cate, actions)
    saves = cate.select("member_id", "action", "cate_mean")
    return cands.join(saves, ["member_id", "action"], "left").groupBy("action").agg(
        F.count("*").alias("members"), round_dec(F.coalesce(F.sum("cate_mean"), F.lit(0.0)), 4).alias("expected_saves"),
        round_dec(F.sum("cost"), 2).alias("cost"), round_dec(F.sum("value"), 2).alias("retained_value"))
