"""Recurrences over blocks: running sums and maxima and y = lam * y_prev + u.

Every block runs the recurrence over its own rows from a zero state as a plain running window;
the end states of the blocks, a table of one row per block, give the state each block starts
from. Exact for any block size.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barweave.functions.rolling import Frame
from barweave.operators.blocks import prefix

# A state weight below e^-UNDERFLOW is zero as a double. Nothing above it is left out: quotients of
# decayed states (RSI, ADX) still depend on very small ones.
UNDERFLOW = 746.0
# Largest exponent of lam ** position kept inside a block (doubles end near e^709).
MAX_EXPONENT = 600.0
# Blocks of a symbol whose end states one task puts in order.
STRIP_BLOCKS = 16384


@dataclass(frozen=True)
class Scan:
    """How one column follows from the input column `x` row by row.

    kind "sum", "max": running sum or maximum of x.
    kind "affine": y is missing before row `seed_at`, there it is the `seed` ("avg", "sum") of x
    over rows `seed_from`..`seed_at`, and after it lam * y_prev + gain * x.
    """

    x: str
    kind: str = "affine"
    lam: float = 1.0
    gain: float = 1.0
    seed_from: int = 0
    seed_at: int = 0
    seed: str = "avg"


@dataclass(frozen=True)
class Tiling:
    """Block geometry: block j answers for rows from j * rows, and holds `back` earlier ones.

    The recurrence of block j covers rows [start(j), start(j + 1)), where the first `skip`
    copied rows are left out as their own inputs look further back than the block does.
    """

    rows: int
    back: int
    skip: int

    def start(self) -> Column:
        first = F.col("blk") * F.lit(self.rows) - F.lit(self.back - self.skip)
        return F.when(F.col("blk") == 0, F.lit(0)).otherwise(first).cast("long")

    def end(self) -> Column:
        return (F.col("blk") + 1) * F.lit(self.rows) - F.lit(self.back - self.skip + 1)


def ema(x: str, n: int, first: int = 0) -> Scan:
    """EMA seeded at row first+n-1 by the mean of the n rows up to it."""
    return Scan(x, lam=(n - 1) / (n + 1), gain=2 / (n + 1), seed_from=first, seed_at=first + n - 1)


def wilder(x: str, n: int, first: int = 1) -> Scan:
    """Wilder mean seeded by the mean of n values from row `first`."""
    return Scan(x, lam=(n - 1) / n, gain=1 / n, seed_from=first, seed_at=first + n - 1)


def _local(scan: Scan, tiling: Tiling, frame: Frame) -> Column:
    """The recurrence inside one block, from a zero state."""
    start = tiling.start()
    inside = F.col("rn") >= start
    x = F.when(inside, F.col(f"`{scan.x}`").cast("double"))
    if scan.kind == "sum":
        return F.coalesce(F.sum(x).over(frame.running), F.lit(0.0))
    if scan.kind == "max":
        return F.max(x).over(frame.running)
    how = F.avg if scan.seed == "avg" else F.sum
    seeded = how(F.when(F.col("rn") >= scan.seed_from, x)).over(frame.running)
    u = (
        F.when(~inside | (F.col("rn") < scan.seed_at), F.lit(0.0))
        .when(F.col("rn") == scan.seed_at, seeded)
        .otherwise(F.coalesce(x, F.lit(0.0)) * scan.gain)
    )
    if scan.lam == 0:
        return u  # an average over one row
    # Centred exponents use the whole range of a double.
    q = (F.col("rn") - start).cast("double") - F.lit((tiling.rows + tiling.back) / 2.0)
    return _power(scan.lam, q), u, _power(scan.lam, -q)


def _power(lam: float, exponent: Column) -> Column:
    return F.pow(F.lit(lam), exponent)


def run_scans(
    laid: DataFrame, scans: dict[str, Scan], tiling: Tiling, frame: Frame, keep_carry=lambda t: t
) -> DataFrame:
    """Add one column per scan, exact in all rows from the tiling's start on.

    `keep_carry` may store the table of block states (one row per block).
    """
    keep = laid.columns
    inputs, running, final = {}, {}, {}
    for name, scan in scans.items():
        local = _local(scan, tiling, frame)
        if isinstance(local, tuple):
            scale, u, unscale = local
            inputs[f"_u_{name}"] = u * unscale
            running[f"_z_{name}"] = F.sum(f"_u_{name}").over(frame.running) * scale
        else:
            running[f"_z_{name}"] = local
    local_rows = laid.withColumns(inputs).withColumns(running) if inputs else laid.withColumns(running)

    states = local_rows.groupBy("symbol", "blk").agg(
        *[F.max(F.when(F.col("rn") == tiling.end(), F.col(f"_z_{n}"))).alias(n) for n in scans]
    )
    carry = keep_carry(_carry(states, scans, tiling)).select(
        "symbol", "blk", *[F.col(n).alias(f"_c_{n}") for n in scans]
    )
    joined = local_rows.join(carry, ["symbol", "blk"], "left")

    start = tiling.start()
    k = (F.col("rn") - start + 1).cast("double")
    for name, scan in scans.items():
        z, c = F.col(f"_z_{name}"), F.col(f"_c_{name}")
        if scan.kind == "max":
            y = F.greatest(z, c)
        elif scan.kind == "sum":
            y = z + F.coalesce(c, F.lit(0.0))
        elif scan.lam == 0:
            y = z
        else:
            y = z + _power(scan.lam, k) * F.coalesce(c, F.lit(0.0))
        ready = F.col("rn") >= start
        if scan.kind == "affine":
            ready = ready & (F.col("rn") >= scan.seed_at)
        final[name] = F.when(ready, y)
    return joined.select(*[F.col(f"`{c}`") for c in keep], *[y.alias(n) for n, y in final.items()])


def _carry(states: DataFrame, scans: dict[str, Scan], tiling: Tiling) -> DataFrame:
    """State of every scan just before each block's first row."""
    sums = [n for n, s in scans.items() if s.kind == "sum"]
    maxes = [n for n, s in scans.items() if s.kind == "max"]
    affine = {n: s for n, s in scans.items() if s.kind == "affine" and s.lam > 0}
    parts = []
    if affine:
        rates = {n: tiling.rows * -math.log(s.lam) for n, s in affine.items()}
        parts.append(decayed(states.select("symbol", "blk", *affine), rates))
    if sums or maxes:
        parts.append(prefix(states.select("symbol", "blk", *sums, *maxes), sums, maxes))
    if not parts:
        return states.select("symbol", "blk", *[F.lit(None).cast("double").alias(n) for n in scans])
    carry = parts[0]
    for part in parts[1:]:
        carry = carry.join(part, ["symbol", "blk"], "full")
    missing = [n for n in scans if n not in carry.columns]
    return carry.withColumns({n: F.lit(None).cast("double") for n in missing}) if missing else carry


def group_blocks(rate: float) -> int:
    """Blocks per group for a state that decays by e^-rate per block.

    A group spans at least UNDERFLOW, so a state outlives only one group, and less than twice
    MAX_EXPONENT. Sizes are rounded up in steps of half an octave, so that similar rates share a window.
    """
    need, step = math.ceil(UNDERFLOW / rate), 0
    while math.ceil(2 ** (step / 2)) < need:
        step += 1
    return math.ceil(2 ** (step / 2))


def decayed(blocks: DataFrame, rates: dict[str, float], strip: int = STRIP_BLOCKS) -> DataFrame:
    """For every (symbol, blk): each column summed over all earlier blocks, the i-th one back weighing e^-(i-1)*rate.

    Blocks are numbered 0, 1, ... without gaps. They are dealt to strips, each with copies of the
    two groups before it; inside a strip, groups are summed on their own, and the end of the group
    before is added. Rows stay linear in the blocks, whatever the rate; one exchange serves all columns.
    """
    sizes = {n: group_blocks(rate) for n, rate in rates.items()}
    halo = 2 * max(sizes.values())
    strip = max(strip, 8 * halo)
    home, place = F.floor(F.col("blk") / F.lit(strip)).cast("long"), F.col("blk") % F.lit(strip)
    copied = F.when(place >= strip - halo, home + 1)
    dealt = (
        blocks.withColumn("_strip", F.explode(F.array_compact(F.array(home, copied))))
        .repartition("symbol", "_strip")
        .withColumn("_at", F.col("blk") - F.col("_strip") * F.lit(strip) + F.lit(halo))
    )
    by_block = Window.partitionBy("symbol", "_strip").orderBy("blk")
    before = by_block.rowsBetween(Window.unboundedPreceding, -1)
    inside, ends, total = {}, {}, {}
    for n, rate in rates.items():
        size = sizes[n]
        group, in_group = F.floor(F.col("_at") / F.lit(size)), F.col("_at") % F.lit(size)
        running = Window.partitionBy("symbol", "_strip", group).orderBy("blk").rowsBetween(Window.unboundedPreceding, 0)
        power = (in_group - (size - 1) / 2.0) * F.lit(rate)
        inside[f"_in_{n}"] = F.sum(F.col(n) * F.exp(power)).over(running) * F.exp(-power)
        ends[f"_end_{n}"] = F.last(F.when(in_group == size - 1, F.col(f"_in_{n}")), ignorenulls=True).over(before)
        ends[f"_before_{n}"] = F.when(in_group > 0, F.lag(f"_in_{n}").over(by_block))
        carried = F.col(f"_end_{n}") * F.exp(-in_group * F.lit(rate))
        total[n] = F.coalesce(F.col(f"_before_{n}") + carried, f"_before_{n}", carried)
    summed = dealt.withColumns(inside).withColumns(ends)
    return summed.where(home == F.col("_strip")).select("symbol", "blk", *[c.alias(n) for n, c in total.items()])
