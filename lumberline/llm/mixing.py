"""Interleaving of sources to target weights by Pfair scheduling, with DataFrame and SQL functions only.

Each source is cut into blocks of equally many rows. With a weight of q units out of Q, block i of a source may not run
before slot floor(i Q / q) and must have run by slot ceil((i + 1) Q / q); earliest deadline first over these windows
keeps each source within less than one block of its share at every slot. The windows repeat every Q slots, so one
period is scheduled (a fold over Q slots, in SQL) and all blocks of the table take their slots from it by arithmetic.
"""

from __future__ import annotations

import heapq

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import ordinal_within, seeded_hash, spool

PERIOD = 1_000
BLOCK_ROWS = 16
SEED = 7
#: Units of the lightest source in a period that is chosen, and the longest such period for fewer than a tenth as many sources.
LEAST_UNITS, LONGEST = 10, 1 << 22
#: Slots times sources up to which SQL schedules a period; above, the driver does, with heaps.
FOLDED = 500_000
#: Where rows without a source go.
NO_SOURCE = ""


def _weight(weights: dict[str, float] | None, power: float) -> Column:
    if not weights:
        return F.pow(F.col("rows").cast("double"), F.lit(power))
    named = F.create_map(*[F.lit(x) for pair in weights.items() for x in pair])
    return F.coalesce(F.element_at(named, F.col("source")), F.lit(min(weights.values()))).cast("double")


def chosen_period(counts: DataFrame, weights: dict[str, float] | None, power: float) -> int:
    """So many slots that the lightest source has LEAST_UNITS of them, between PERIOD and LONGEST (or 10 a source)."""
    n, least, total = counts.select(_weight(weights, power).alias("w")).agg(F.count(F.lit(1)), F.min("w"), F.sum("w")).first()
    wanted = LEAST_UNITS * total / least if n and least > 0 else PERIOD
    return max(PERIOD, min(-int(-wanted // 1), max(LONGEST, 10 * n)))


def scheduled_by_driver(counts: DataFrame, weights: dict[str, float] | None, power: float, period: int) -> DataFrame:
    """What ``target_units`` and ``pfair_period`` give, for many sources: one row for each source comes to the driver."""
    rows = counts.select("source", _weight(weights, power).alias("w")).collect()
    rows = sorted(((r["source"], r["w"]) for r in rows), key=lambda r: r[0].encode())
    total, n = sum(w for _, w in rows), len(rows)
    base = 0 if min(w for _, w in rows) / total * period >= 1 else 1
    exact = [w / total * (period - base * n) for _, w in rows]
    units = [base + int(x) for x in exact]
    for i in sorted(range(n), key=lambda i: (int(exact[i]) - exact[i], i))[: period - sum(units)]:
        units[i] += 1
    picked = pfair_slots(units, period)
    done, nth = [0] * n, []
    for i in picked:
        nth.append(done[i])
        done[i] += 1
    names = pa.array([s for s, _ in rows], pa.string())
    at = pa.array(picked, pa.int64())
    columns = {"source": names.take(at), "units": pa.array(units, pa.int64()).take(at), "nth": pa.array(nth, pa.int32()), "slot": pa.array(range(period), pa.int64())}
    return counts.sparkSession.createDataFrame(pa.table(columns))


def pfair_slots(units: list[int], period: int) -> list[int]:
    """The source of each slot by earliest deadline first; ties go to the first source."""
    later = [(0, i) for i in range(len(units))]  # (first slot allowed, source)
    ready: list[tuple[int, int]] = []  # (deadline, source)
    done, picked = [0] * len(units), []
    for t in range(period):
        while later and later[0][0] <= t:
            i = heapq.heappop(later)[1]
            heapq.heappush(ready, (-(-(done[i] + 1) * period // units[i]), i))
        i = heapq.heappop(ready)[1]
        picked.append(i)
        done[i] += 1
        if done[i] < units[i]:
            heapq.heappush(later, (done[i] * period // units[i], i))
    return picked


def target_units(counts: DataFrame, weights: dict[str, float] | None, power: float, period: int) -> DataFrame:
    """(source, units): the weights as whole units, ``period`` in all, by largest remainder. If a source would have less
    than one, each first takes one and the weights share out the others.

    Without ``weights`` a source weighs its row count to ``power``; sources that ``weights`` leaves out weigh as the
    lightest one named. There is one row for each source.
    """
    weight = _weight(weights, power)
    weighed = F.sort_array(F.collect_list(F.struct("source", weight.alias("weight"))))
    whole = f"(array_min(transform(w, x -> x.weight)) / total * {period} >= 1)"
    spare = F.expr(f"{period} - if({whole}, 0, size(w))")
    return (
        counts.agg(weighed.alias("w"))
        .withColumn("total", F.expr("aggregate(w, cast(0 as double), (a, x) -> a + x.weight)"))
        .withColumn("spare", spare)
        .withColumn("period_base", F.expr(f"if({whole}, 0, 1)"))
        .withColumn("exact", F.expr("transform(w, x -> struct(x.source as source, x.weight / total * spare as share))"))
        .withColumn("left", F.expr("cast(spare - aggregate(exact, cast(0 as bigint), (a, x) -> a + cast(floor(x.share) as bigint)) as int)"))
        .withColumn("first", F.expr("slice(transform(array_sort(exact, (a, b) -> case when a.share - floor(a.share) > b.share - floor(b.share) then -1 when a.share - floor(a.share) < b.share - floor(b.share) then 1 when a.source < b.source then -1 else 1 end), x -> x.source), 1, left)"))
        .select(F.explode(F.expr("transform(exact, x -> struct(x.source as source, period_base + cast(floor(x.share) as bigint) + if(array_contains(first, x.source), 1, 0) as units))")).alias("u"))
        .select("u.source", "u.units")
    )


def pfair_period(units: DataFrame, period: int) -> DataFrame:
    """(source, nth, slot, units): the slot of the nth block of each source in one period, by earliest deadline first.

    One row holds the whole state (a counter for each source) and is folded over the slots; ties of deadlines go to the
    first source by name.
    """
    state = units.agg(F.sort_array(F.collect_list(F.struct("source", "units"))).alias("s")).where("size(s) > 0")
    deadline = f"case when x.done < x.units and (x.done * {period}) div x.units <= t then ((x.done + 1) * {period} + x.units - 1) div x.units end"
    pick = f"array_min(filter(transform(a.now, (x, i) -> struct({deadline} as due, i as i)), x -> x.due is not null)).i"
    step = f"""
      aggregate(sequence(0, {period - 1}),
        struct(transform(s, x -> struct(x.units as units, cast(0 as bigint) as done)) as now, cast(array() as array<int>) as picked),
        (a, t) -> named_struct(
          'now', transform(array({pick}), p -> transform(a.now, (x, i) -> struct(x.units as units, x.done + if(i = p, 1, 0) as done)))[0],
          'picked', array_append(a.picked, {pick})),
        a -> a.picked)"""
    picked = state.withColumn("picked", F.expr(step)).select("s", F.posexplode("picked").alias("slot", "i"))
    named = picked.select(F.expr("s[i].source").alias("source"), F.expr("s[i].units").alias("units"), F.col("slot").cast("long").alias("slot"))
    return named.groupBy("source", "units").agg(F.sort_array(F.collect_list("slot")).alias("slots")).select("source", "units", F.posexplode("slots").alias("nth", "slot"))


def mix_sources(
    df: DataFrame,
    source_col: str = "source",
    id_col: str = "doc_id",
    text_col: str = "text",
    weights: dict[str, float] | None = None,
    power: float = 0.5,
    period: int | None = None,
    block_rows: int = BLOCK_ROWS,
    seed: int = SEED,
    hash_col: str | None = None,
) -> DataFrame:
    """Every row of ``df`` with ``mix_block`` (the block within its source), ``mix_slot`` (the block's slot in the
    schedule) and ``mix_position`` (the row's 0-based place in the mixture). No row is dropped or repeated.

    Rows enter their source's blocks in the order of a seeded hash of id and text, or of ``hash_col`` if it is given, which
    holds that hash (then id and text need not be there). As long as no source has run out, the
    blocks of each source in any number of first slots differ by less than one from its weight's share; when a source
    has run out its slots fall away and the others go on at their rates. Rows without a source form a source of their
    own. An empty table gives an empty result. Ties and repeated rows are kept, in any order among themselves. Columns
    that bear the new names are replaced. The weights are whole units of ``1 / period``. Without a ``period`` it
    is chosen by the weights, for any number of sources; with one, more than ``period`` / 2 sources raise a
    ``ValueError``.
    """
    df = df.drop("mix_block", "mix_slot", "mix_position")
    rows = df.withColumn("__source", F.coalesce(F.col(source_col).cast("string"), F.lit(NO_SOURCE))).withColumn("__hash", F.col(hash_col) if hash_col else seeded_hash(seed, F.col(id_col), F.col(text_col)))
    counts = spool(rows.groupBy(F.col("__source").alias("source")).agg(F.count(F.lit(1)).alias("rows")))
    n_sources = counts.count()
    if period is None:
        period = chosen_period(counts, weights, power)
    elif n_sources > period // 2:
        raise ValueError(f"{n_sources} sources are too many for weights in units of 1/{period}")
    if n_sources * period <= FOLDED:
        units = spool(target_units(counts, weights, power, period))
        schedule = spool(pfair_period(units, period))  # at most `period` rows; the fold runs once
    else:
        schedule = spool(scheduled_by_driver(counts, weights, power, period))
        units = schedule.select("source", "units").distinct()
    numbered = ordinal_within(rows, "__source", "__hash", "__ordinal")
    numbered = numbered.withColumn("mix_block", F.expr(f"__ordinal div {block_rows}"))
    quota = units.join(counts, "source").select("source", F.col("units").alias("q"), F.col("rows").alias("n"))
    numbered = _with_schedule(numbered, schedule, period)
    return _with_positions(numbered, quota, schedule, period, block_rows).drop("__source", "__hash", "__ordinal", "__cycle", "__slot")


def _with_schedule(numbered: DataFrame, schedule: DataFrame, period: int) -> DataFrame:
    """The block's slot: whole periods before it, and its place in the period; periods up to 2 ** 20 slots are broadcast."""
    by_source = schedule.groupBy(F.col("source").alias("__s")).agg(F.first("units").alias("__q"), F.sort_array(F.collect_list("slot")).alias("__slots"))
    if period <= 1 << 20:
        by_source = F.broadcast(by_source)
    out = numbered.join(by_source, F.col("__source") == F.col("__s"))
    out = out.withColumn("__cycle", F.expr("mix_block div __q")).withColumn("__slot", F.expr("__slots[cast(mix_block % __q as int)]"))
    return out.withColumn("mix_slot", F.col("__cycle") * period + F.col("__slot")).drop("__s", "__q", "__slots")


def _with_positions(numbered: DataFrame, quota: DataFrame, schedule: DataFrame, period: int, block_rows: int) -> DataFrame:
    """Rows before a block = rows of all sources in earlier periods (arithmetic) + rows of earlier slots of its period.

    For each period there is one row for each slot in use; running totals stay inside a period, so they are dealt by
    period and grow only in number.
    """
    per_source = schedule.join(quota, "source").select("source", "q", "n", "nth", "slot")
    last = F.expr(f"((n + {block_rows - 1}) div {block_rows} - 1 - nth) div q")
    used = F.expr(f"(n + {block_rows - 1}) div {block_rows} > nth")
    blocks = per_source.where(used).select("source", "q", "n", "nth", "slot", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("__c"))
    size = F.expr(f"least({block_rows}, n - (__c * q + nth) * {block_rows})")
    sizes = blocks.select("__c", F.col("slot").alias("__t"), size.alias("__size"))
    all_quota = quota.agg(F.collect_list(F.struct("q", "n")).alias("__all"))
    cycles = sizes.select("__c").distinct().crossJoin(F.broadcast(all_quota))  # one row of totals joined to each period
    cycles = cycles.select("__c", F.expr(f"aggregate(__all, cast(0 as bigint), (a, x) -> a + least(x.n, __c * x.q * {block_rows}))").alias("__before"))
    running = Window.partitionBy("__c").orderBy("__t").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.withColumn("__run", F.coalesce(F.sum("__size").over(running), F.lit(0))).join(cycles, "__c")
    starts = starts.select("__c", "__t", (F.col("__before") + F.col("__run")).alias("__start"))
    joined = numbered.join(starts, (F.col("__cycle") == F.col("__c")) & (F.col("__slot") == F.col("__t")))
    return joined.withColumn("mix_position", F.col("__start") + F.expr(f"__ordinal % {block_rows}")).drop("__c", "__t", "__start")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mix_sources(docs).select("doc_id", "source", "mix_block", "mix_slot", "mix_position")
