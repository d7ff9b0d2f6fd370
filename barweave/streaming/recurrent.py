"""Features of arriving bars from kept state, so that a batch costs its own rows and not the past.

Per symbol the newest `keep` rows stay, with their position and the value of every recurrence. A
recurrence goes on from the last of them: its value there, put in as the first input, brings the
block-wise scan into the state it had. Windows look back into the kept rows. A symbol with fewer
rows so far keeps its whole past and is computed as a batch, seeds included.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barweave.operators.blocks import number_rows
from barweave.operators.scan import Scan
from barweave.plans.features import features, gather, looked_back
from barweave.plans.registry import Feature, q

OLD, EDGE = "_old", "_edge"


def resumed(name: str, scan: Scan) -> list[Feature]:
    """The rules of a recurrence that goes on from its stored value at the row marked EDGE."""
    was, enters, runs = f"_was_{name}", f"_in_{name}", f"_go_{name}"
    idle = F.lit(0.0) if scan.kind == "affine" else F.lit(None).cast("double")
    gain = scan.gain if scan.kind == "affine" else 1.0

    def enter(_) -> Column:
        return F.when(F.col(EDGE), q(was) / gain).when(F.col(OLD), idle).otherwise(q(scan.x).cast("double"))

    return [
        Feature(enters, (scan.x, was, OLD, EDGE), enter),
        Feature(runs, (enters,), scan=Scan(enters, scan.kind, scan.lam, scan.gain)),
        Feature(name, (runs, was, OLD), lambda _: F.when(F.col(OLD), q(was)).otherwise(q(runs))),
    ]


@dataclass(frozen=True)
class Plan:
    """What is kept between batches, and the rules that go on from it."""

    names: tuple[str, ...]
    columns: tuple[str, ...]
    scans: tuple[str, ...]
    rules: tuple[Feature, ...]
    own: tuple[Feature, ...]
    keep: int


def plan(names: list[str], columns: list[str], own: list[Feature] = ()) -> Plan:
    found = gather(names, {f.name: f for f in own}, [*columns, "rn"])
    scans = tuple(n for n, f in found.items() if f.scan)
    rules = tuple(rule for n in scans for rule in resumed(n, found[n].scan))
    there = [*columns, "rn", OLD, EDGE, *[f"_was_{n}" for n in scans]]
    wanted = [*names, *[n for n in scans if n not in names]]
    reach = max(looked_back(wanted, {f.name: f for f in own}, [*columns, "rn"]), looked_back(wanted, {f.name: f for f in [*own, *rules]}, there))
    keep = 1 + max(reach, *(found[n].scan.seed_at for n in scans), 1)
    return Plan(tuple(names), tuple(columns), scans, rules, tuple(own), keep)


def advance(
    new: DataFrame, state: DataFrame | None, plan: Plan, bar_seconds: int, store: Callable[[DataFrame, str], DataFrame]
) -> tuple[DataFrame, DataFrame]:
    """(the new bars with their features, the state after them).

    New bars follow the known ones in time, symbol by symbol; symbols without new bars keep their
    state. `store(df, name)` writes a table and reads it back: what is used twice goes through it.
    """
    base = [q(c) for c in plan.columns]
    was = [f"_was_{n}" for n in plan.scans]
    empty = new.select(*base, F.lit(0).cast("long").alias("rn"), *[F.lit(None).cast("double").alias(w) for w in was]).limit(0)
    state = empty if state is None else state
    lasts = state.groupBy("symbol").agg(F.max("rn").alias("_last"))
    placed = number_rows(new.select(*base), bar_seconds).join(lasts, "symbol", "left")
    known_rows = F.coalesce(F.col("_last") + 1, F.lit(0).cast("long"))
    fresh = placed.withColumn("rn", F.col("rn") + known_rows).withColumn(OLD, F.lit(False))
    touched = fresh.select("symbol").distinct()
    kept = state.join(touched, "symbol", "left_semi").join(lasts, "symbol").withColumn(OLD, F.lit(True))
    rows = kept.unionByName(fresh, allowMissingColumns=True).withColumn(EDGE, F.col(OLD) & (F.col("rn") == F.col("_last")))
    rows = store(rows.withColumn("_young", known_rows < plan.keep).drop("_last"), "rows")

    outputs = [*plan.names, *[n for n in plan.scans if n not in plan.names]]
    carried = [*plan.columns, "rn", OLD]
    young = features(rows.where("_young").drop(*was), outputs, bar_seconds, own=plan.own, keep=carried)
    grown = features(rows.where("NOT _young"), outputs, bar_seconds, own=[*plan.own, *plan.rules], keep=carried)
    done = store(young.unionByName(grown), "done")

    tops = done.groupBy("symbol").agg(F.max("rn").alias("_top"))
    newest = done.join(tops, "symbol").where(F.col("rn") > F.col("_top") - plan.keep)
    after = newest.select(*base, "rn", *[q(n).cast("double").alias(w) for n, w in zip(plan.scans, was)])
    idle = state.join(touched, "symbol", "left_anti").select(*after.columns)
    return done.where(~F.col(OLD)).select(*base, *[q(n) for n in plan.names if n not in plan.columns]), after.unionByName(idle)
