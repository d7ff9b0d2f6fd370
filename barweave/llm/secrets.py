"""Credentials in text, told from examples by who owns them across the corpus.

Built-in functions only. Candidates are found per row; their hashes are counted over all distinct
repositories and owners; a value that many owners share is an example that was copied around, a
value of few owners looks live.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barweave.llm.common import Scratch

# The base kinds in their order, with the pattern, the group that is judged and its
# least length. In "access" and "hex" the least length is part of the pattern, which finds the
# same matches: a run that is too short cannot hold a longer one.
ASSIGN = (
    "([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]"
    "|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)
BASE = [("assign", ASSIGN, 2, 6), ("access", "AKIA[A-Z0-9]{16,}", 0, 20), ("hex", "[0-9a-f]{24,}", 0, 24)]
# The further kind of the method: long runs that mix cases and digits.
MIXED = "[A-Za-z0-9_-]{20,}"
KINDS = [name for name, *_ in BASE] + ["mixed"]
MAX_OWNERS = 2
CHUNK = 256
SPAN = "struct<start:long,kind:int,end:long,value:string>"


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use(value)`, with the value computed once. Inside a lambda Spark computes an expression anew for every element,
    but a lambda's own argument is a value."""
    return F.get(F.transform(F.array(value), use), 0)


def running(values: Column, join: Callable[[Column, Column], Column]) -> Column:
    """Inclusive running results of an array of longs from 0, in two levels: work is linear for arrays of any usual length."""
    none, zero = F.array().cast("array<long>"), F.lit(0).cast("long")

    def grow(done: Column, x: Column) -> Column:
        return F.concat(done, F.array(join(F.coalesce(F.try_element_at(done, F.lit(-1)), zero), x)))

    def chunks(all_values: Column) -> Column:
        last = F.greatest(F.ceil(F.size(all_values) / CHUNK).cast("int") - 1, F.lit(0))
        return F.transform(F.sequence(F.lit(0), last), lambda k: F.aggregate(F.slice(all_values, k * CHUNK + 1, CHUNK), none, grow))

    def shifted(inner: Column) -> Column:
        totals = F.transform(inner, lambda c: F.coalesce(F.try_element_at(c, F.lit(-1)), zero))
        return bound(
            F.aggregate(totals, F.array(zero), grow),
            lambda before: F.flatten(F.transform(inner, lambda c, k: bound(F.get(before, k), lambda b: F.transform(c, lambda x: join(b, x))))),
        )

    return bound(values, lambda v: bound(chunks(v), shifted))


def running_sum(lengths: Column) -> Column:
    return running(lengths, lambda a, b: a + b)


def spans_of(text: Column, kind: int, pattern: str, group: int, least: int) -> Column:
    """Matches of `pattern`, leftmost and not overlapping, whose `group` has `least` characters or more.

    The places follow from the lengths of the pieces between the matches.
    """
    none = F.array().cast(f"array<{SPAN}>")

    def placed(found: Column) -> Column:
        steps = F.zip_with(found["m"], F.slice(found["gaps"], F.lit(1), F.size(found["m"])), lambda m, g: (F.length(g) + F.length(m)).cast("long"))
        return F.transform(
            F.arrays_zip(found["m"].alias("m"), found["v"].alias("v"), running_sum(steps).alias("e")),
            lambda x: F.struct(
                (x["e"] - F.length(x["m"])).alias("start"), F.lit(kind).alias("kind"), x["e"].alias("end"), x["v"].alias("value")
            ),
        )

    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = whole if group == 0 else F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    found = F.struct(whole.alias("m"), value.alias("v"), F.split(text, pattern, -1).alias("gaps"))
    kept = F.filter(bound(found, placed), lambda s: F.length(s["value"]) >= least).cast(f"array<{SPAN}>")
    return F.when(F.rlike(text, F.lit(pattern)), kept).otherwise(none)


def untouched(mixed: Column, base: Column) -> Column:
    """The spans of `mixed` (apart from each other) that no span of `base` overlaps.

    In one order by the starts of `base` and the ends of `mixed`, a mixed span is touched if the
    largest end of the base spans before it lies beyond its start.
    """
    event = "struct<at:long,own:int,reach:long,span:" + SPAN + ">"
    events = F.array_sort(F.concat(
        F.transform(mixed, lambda m: F.struct(m["end"].alias("at"), F.lit(0).alias("own"), F.lit(0).cast("long").alias("reach"), m.alias("span"))).cast(f"array<{event}>"),
        F.transform(base, lambda b: F.struct(b["start"].alias("at"), F.lit(1).alias("own"), b["end"].alias("reach"), b.alias("span"))).cast(f"array<{event}>"),
    ))

    def judged(found: Column) -> Column:
        reach = running(F.transform(found, lambda e: e["reach"]), lambda a, b: F.greatest(a, b))
        free = F.filter(F.arrays_zip(found.alias("e"), reach.alias("r")), lambda x: (x["e"]["own"] == 0) & (x["r"] <= x["e"]["span"]["start"]))
        return F.transform(free, lambda x: x["e"]["span"])

    # Few texts have both kinds; the others need no order.
    return F.when((F.size(mixed) == 0) | (F.size(base) == 0), mixed).otherwise(bound(events, judged))


def find_secrets(
    docs: DataFrame, room: Scratch, key: str = "doc_id", text: str = "text",
    repository: str = "source", owner: str = "source", max_owners: int = MAX_OWNERS,
) -> DataFrame:
    """One row per input row: key, base (spans), spans (all spans).

    A span is (start, kind, end, value, n_repositories, n_owners, verdict), in code points, end
    exclusive; `kind` counts KINDS from 0; verdict is "live" or "example" (more than `max_owners`
    owners share the value). Base spans are listed whatever their verdict; mixed runs only where
    they look live and no base span touches them. Null text has no spans; a null repository or
    owner counts as one of its own. Repeated rows give equal rows; an empty table gives none;
    other columns are not read.
    """
    body = F.coalesce(F.col("text"), F.lit(""))
    base = F.flatten(F.array(*[spans_of(body, i, *rule) for i, (_, *rule) in enumerate(BASE)]))
    mixed = F.filter(
        spans_of(body, len(BASE), MIXED, 0, 20),
        lambda s: s["value"].rlike("[0-9]") & s["value"].rlike("[a-z]") & s["value"].rlike("[A-Z]"),
    )
    found = room.save(
        docs.select(
            F.col(key).alias("key"), F.col(text).alias("text"),
            F.col(repository).alias("repository"), F.col(owner).alias("owner"),
        )
        .select("key", "repository", "owner", F.array_sort(base).alias("base"), mixed.alias("mixed"))
        .select(
            "key", "repository", "owner", "base",
            untouched(F.col("mixed"), F.col("base")).alias("mixed"),
        )
        .withColumn("spans", F.concat("base", "mixed"))
        .drop("mixed"),
        "candidates",
    )
    candidates = found.where(F.size("spans") > 0).select(
        "repository", "owner", F.explode(F.transform("spans", _digest)).alias("digest")
    )
    # Combined before each shuffle: a value has at most one row per repository, owner and task.
    used = candidates.groupBy("digest", "owner", "repository").agg(F.count(F.lit(1)).alias("n"))
    by_owner = used.groupBy("digest", "owner").agg(F.count(F.lit(1)).alias("repositories"), F.sum("n").alias("n"))
    counted = by_owner.groupBy("digest").agg(
        F.sum("repositories").alias("n_repositories"), F.count(F.lit(1)).alias("n_owners"), F.sum("n").alias("n_uses")
    )
    # Texts with the same list of spans share one row from here on, however often they are copied.
    lists = F.sha2(F.to_json(F.struct("spans")), 256)
    listed = found.where(F.size("spans") > 0).withColumn("list", lists)
    different = listed.groupBy("list").agg(F.first("spans").alias("spans"))
    known = different.select("list", F.explode("spans").alias("s")).withColumn("digest", _digest(F.col("s")))
    judged = known.join(counted, "digest").select(
        "list",
        F.struct(
            "s.start", "s.kind", "s.end", "s.value", "n_repositories", "n_owners",
            F.when(F.col("n_owners") > max_owners, "example").otherwise("live").alias("verdict"),
        ).alias("s"),
    )
    spans = judged.groupBy("list").agg(F.array_sort(F.collect_list("s")).alias("judged"))
    extra = len(BASE)
    bare = found.where(F.size("spans") == 0).select("key", F.array().cast(spans.schema["judged"].dataType).alias("judged"))
    all_spans = F.col("judged")
    return listed.join(spans, "list").select("key", "judged").unionByName(bare).select(
        "key",
        F.filter(all_spans, lambda s: s["kind"] < extra).alias("base"),
        F.filter(all_spans, lambda s: (s["kind"] < extra) | (s["verdict"] == "live")).alias("spans"),
    )


def _digest(span: Column) -> Column:
    return F.sha2(span["value"], 256)


def span_list(spans: Column) -> Column:
    """kind:start:end by start, then kind, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ","
    )
