"""As-of alignment of events to price series, with prices some rows later.

The price side is prepared once: every price gets the prices ``h`` rows later
and the time at which the next price replaces it. Events then look up the one
interval they fall into.

* Where the prepared prices are small (their size is computed, not guessed),
  they are broadcast, keyed by time cell. Events are not shuffled or sorted.
* Otherwise events and prices meet in ranges of time that are merged in order, after one
  shuffle. The ranges have about equally many rows, however these crowd; a price that still holds
  where a range begins goes there too, so the work grows with rows and not with pairs. Instants
  with more events than a range are salted.
"""

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapewire.session import durable

BROADCAST_BYTES = 64 << 20
ROWS_PER_TASK = 1_000_000
_DAY = 86_400
_CELL_ROWS = 16
#: Most ranges of time that events and prices are merged in, and the rank error of their bounds: a tenth of a range.
RANGES = 4096


@dataclass(frozen=True)
class SeriesProfile:
    """Bounds of a set of price series."""

    rows: int
    series: int
    longest: int  # rows of the longest series
    days: int  # days with prices, summed over the series
    densest: int  # rows of the fullest day of a series
    first_day: int  # days since 1970-01-01
    last_day: int
    name_bytes: int  # of the longest series name

    @property
    def span_days(self) -> int:
        return self.last_day - self.first_day + 1


def profile_series(prices: DataFrame, by: Sequence[str] = ()) -> SeriesProfile:
    """Measure the price side in one job that counts by day before it shuffles."""
    n = F.count(F.lit(1))
    per_day = prices.groupBy(*by, F.unix_date(F.to_date("ts")).alias("_day")).agg(n.alias("n"))
    per_series = per_day.groupBy(*by).agg(
        F.sum("n").alias("n"),
        F.count("_day").alias("days"),
        F.max("n").alias("densest"),
        F.min("_day").alias("first"),
        F.max("_day").alias("last"),
    )
    total = per_series.where("n is not null").agg(
        F.coalesce(F.sum("n"), F.lit(0)),
        F.count(F.lit(1)),
        F.coalesce(F.max("n"), F.lit(0)),
        F.coalesce(F.sum("days"), F.lit(0)),
        F.coalesce(F.max("densest"), F.lit(0)),
        F.coalesce(F.min("first"), F.lit(0)),
        F.coalesce(F.max("last"), F.lit(0)),
        F.coalesce(F.max(F.octet_length(F.concat_ws("", *[F.col(c).cast("string") for c in by]))), F.lit(0)) + 16 * len(by),
    )
    return SeriesProfile(*total.first())


def check_horizons(horizons: Sequence[int]) -> list[int]:
    """Distinct horizons in the given order; negative ones are refused."""
    wanted = list(dict.fromkeys(int(h) for h in horizons))
    if any(h < 0 for h in wanted):
        raise ValueError(f"horizons count rows forward and cannot be negative: {wanted}")
    return wanted


def forward_prices(
    prices: DataFrame,
    horizons: Sequence[int] = (3,),
    by: Sequence[str] = (),
    tie: Sequence[str] = (),
    profile: SeriesProfile | None = None,
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """Each price row with ``t{h}``, the price ``h`` rows later in its series.

    Past the end of a series it is NULL. Also adds ``next_ts``. Rows with equal
    ``ts`` count one by one, ``tie`` ordering them.

    A series that one task can hold is one window partition. If any is longer,
    the rows are range-partitioned by series and time, which splits long series
    evenly wherever their rows crowd. Rows next to a range edge find the rows after
    them by their number in the series, so that no task gets a whole series, even
    with horizons as long as a range.
    """
    horizons = check_horizons(horizons)
    profile = profile or profile_series(prices, by)
    order = ["ts", *tie]
    if profile.longest <= rows_per_task:
        return _with_leads(prices, Window.partitionBy(*by).orderBy(*order), horizons)

    reach = max([1, *horizons])
    ranged = durable(_by_ranges(prices, [*by, *order], profile.rows, rows_per_task))
    within = Window.partitionBy(*by, "_range").orderBy(*order)
    marked = ranged.withColumns(
        {
            "_near_end": F.lead("ts", reach).over(within).isNull(),
            "_near_start": F.lag("ts", reach).over(within).isNull(),
        }
    )
    inner = _with_leads(marked, within, horizons).where("not _near_end")
    # Rows near the edges of ranges are numbered along their series and meet by number, row for row.
    earlier = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranged.groupBy(*by, "_range").agg(F.count(F.lit(1)).alias("_rows"))
    offsets = offsets.select(*by, "_range", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_before"))
    edges = _meet(marked.withColumn("_at", F.row_number().over(within)).where("_near_end or _near_start"), offsets, [*by, "_range"])
    edges = edges.withColumn("_number", F.col("_before") + F.col("_at"))
    ahead = sorted({1, *horizons} - {0})
    steps = edges.select(*by, F.explode(F.array(*map(F.lit, ahead))).alias("_step"), "_number", "ts", "adj_close")
    found = steps.groupBy(*by, (F.col("_number") - F.col("_step")).alias("_number")).agg(
        F.max(F.when(F.col("_step") == 1, F.col("ts"))).alias("next_ts"),
        *[F.max(F.when(F.col("_step") == h, F.col("adj_close"))).alias(f"t{h}") for h in horizons if h],
    )
    outer = _meet(edges.where("_near_end"), found, [*by, "_number"], "left")
    if 0 in horizons:
        outer = outer.withColumn("t0", F.col("adj_close"))
    return inner.select(*prices.columns, "next_ts", *[f"t{h}" for h in horizons]).unionByName(
        outer.select(*prices.columns, "next_ts", *[f"t{h}" for h in horizons])
    )


def _by_ranges(rows: DataFrame, order: Sequence[str], n: int, rows_per_task: int) -> DataFrame:
    """Rows range-partitioned so that a task can hold each ``_range``, however they crowd."""
    return rows.repartitionByRange(math.ceil(n / rows_per_task), *order).withColumn("_range", F.spark_partition_id())


def _meet(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on keys of which a series name may be NULL; the columns of the right side come without the keys."""
    named = right.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    same = [F.col(k).eqNullSafe(F.col(f"_right_{k}")) for k in keys]
    return left.join(named, same, how).drop(*[f"_right_{k}" for k in keys])


def _with_leads(df: DataFrame, w, horizons: Sequence[int]) -> DataFrame:
    leads = {
        f"t{h}": F.lead("adj_close", h).over(w) if h else F.col("adj_close") for h in horizons
    }
    return df.withColumns({"next_ts": F.lead("ts").over(w), **leads})


def asof_join(
    events: DataFrame,
    prices: DataFrame,
    horizons: Sequence[int] = (),
    by: Sequence[str] = (),
    tie: Sequence[str] = (),
    profile: SeriesProfile | None = None,
    broadcast_bytes: int = BROADCAST_BYTES,
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """Every event with the last price at or before its ``ts``.

    Adds ``t0`` and, for each horizon, ``t{h}``, the price ``h`` rows after that
    one. Events before the first price are kept with NULLs. Of several prices
    with the same ``ts`` the last by ``tie`` counts. ``by`` names the columns
    that tell the series apart, on both sides.
    """
    wanted = [0, *[h for h in check_horizons(horizons) if h]]
    profile = profile or profile_series(prices, by)
    values = [f"t{h}" for h in wanted]
    taken = sorted({*values, "_from", "_to", "_cell", "_part", "_range", "_salt", "_event", "_price", "_seen"} & set(events.columns))
    if taken:
        raise ValueError(f"events already have the columns {taken}; rename them first.")
    leads = forward_prices(prices, wanted, by, tie, profile, rows_per_task)
    intervals = leads.where("next_ts is null or next_ts > ts").select(
        *by, F.col("ts").alias("_from"), F.col("next_ts").alias("_to"), *values
    )
    cells = _TimeCells(profile)
    if cells.broadcast_rows * _row_bytes(profile, values) <= broadcast_bytes:
        return _lookup(events, prices, intervals, values, by, cells)
    bounds = _bounds(events, prices, profile, rows_per_task)
    return _merge(events, intervals, values, by, bounds)


def _row_bytes(profile: SeriesProfile, values: Sequence[str]) -> int:
    # fixed-width fields of 8 bytes, and the longest series name
    return 8 * (6 + len(values)) + profile.name_bytes


class _TimeCells:
    """Time cells about as wide as the usual gap between prices, whole days at least.

    Days with many prices are split further, see ``_parts``.
    """

    def __init__(self, profile: SeriesProfile):
        gap = profile.span_days * profile.series / max(profile.rows, 1)
        self.seconds = _DAY * max(1, round(gap))
        self.last = profile.last_day * _DAY // self.seconds
        self.split = profile.densest * self.seconds > _CELL_ROWS * _DAY
        cells = profile.series * (profile.span_days * _DAY // self.seconds + 2)
        # An interval is repeated at each cell edge it crosses; splitting full
        # cells adds less than one row per four.
        self.broadcast_rows = (profile.rows + cells) * 5 // 4

    def of(self, ts: Column) -> Column:
        return F.floor(F.unix_micros(ts) / F.lit(self.seconds * 1_000_000))

    def start(self, cell: Column) -> Column:
        return F.timestamp_seconds(cell * F.lit(self.seconds))

    def end(self, cell: Column) -> Column:
        """Last microsecond of the cell."""
        return F.timestamp_micros((cell + 1) * F.lit(self.seconds * 1_000_000) - 1)

    def part(self, ts: Column, cell: Column, parts: Column) -> Column:
        """Which of the equal parts of its cell a time belongs to."""
        micros = self.seconds * 1_000_000
        return F.floor((F.unix_micros(ts) - cell * F.lit(micros)) * parts / F.lit(micros))


def _lookup(events, prices, intervals, values, by, cells: _TimeCells) -> DataFrame:
    """Broadcast the intervals under each time cell they touch."""
    last_instant = cells.end(F.lit(cells.last))
    touched = intervals.withColumns(
        {
            "_until": F.coalesce(F.col("_to") - F.expr("interval 1 microsecond"), last_instant),
        }
    ).withColumn(
        "_cell", F.explode(F.sequence(cells.of(F.col("_from")), cells.of(F.col("_until"))))
    )
    # events after the last cell look into the last cell, which the open
    # interval of every series reaches
    at = F.least(F.col("ts"), last_instant)
    located = events.withColumns({"_at": at, "_cell": cells.of(at)})
    keys = [*by, "_cell"]
    if cells.split:
        # full cells only: the number of parts, so that each has few intervals
        parts = (
            prices.groupBy(*by, cells.of(F.col("ts")).alias("_cell"))
            .agg(F.ceil(F.count(F.lit(1)) / F.lit(_CELL_ROWS // 4)).alias("_parts"))
            .where(F.col("_parts") > 4)
        )
        cell, n = F.col("_cell"), F.coalesce("_parts", F.lit(1))
        touched = touched.join(F.broadcast(parts), keys, "left").withColumn(
            "_part",
            F.explode(
                F.sequence(
                    cells.part(F.greatest("_from", cells.start(cell)), cell, n),
                    cells.part(F.least("_until", cells.end(cell)), cell, n),
                )
            ),
        )
        located = located.join(F.broadcast(parts), keys, "left").withColumn(
            "_part", cells.part(F.col("_at"), cell, n)
        )
        keys.append("_part")
    right = F.broadcast(touched.select(*keys, "_from", "_to", *values).alias("p"))
    left = located.select(*events.columns, *[k for k in keys if k not in events.columns]).alias("e")
    match = [F.col(f"e.{k}") == F.col(f"p.{k}") for k in keys]
    match.append(F.col("e.ts") >= F.col("p._from"))
    match.append(F.col("p._to").isNull() | (F.col("e.ts") < F.col("p._to")))
    return left.join(right, match, "left").select(
        *[F.col(f"e.{c}") for c in events.columns], *[F.col(f"p.{v}") for v in values]
    )


@dataclass(frozen=True)
class _Bounds:
    """Times (microseconds) at which ranges begin, the first before all others, and the salts of each range."""

    starts: list[int]
    salts: list[int]

    def range_of(self, ts: Column) -> Column:
        """The last range that begins at or before a time: by halving, in as many steps as the number has digits."""
        if len(self.starts) == 1:
            return F.lit(0)
        known, at = F.lit(self.starts).cast("array<bigint>"), F.unix_micros(ts)
        steps = [F.lit(1 << k) for k in reversed(range((len(self.starts) - 1).bit_length()))]
        return F.aggregate(F.array(*steps), F.lit(0), lambda lo, step: F.when(F.get(known, lo + step) <= at, lo + step).otherwise(lo))

    def of(self, numbers: list[int], range_: Column) -> Column:
        """The number that a range has."""
        return F.get(F.lit(numbers).cast("array<bigint>"), range_) if len(numbers) > 1 else F.lit(numbers[0]).cast("long")


def _bounds(events: DataFrame, prices: DataFrame, profile: SeriesProfile, rows_per_task: int) -> _Bounds:
    """Ranges of time with equally many rows of both sides, in one job.

    No series has more rows in a range than the range itself, so that hot series are cut like the whole. There are at
    most as many ranges as there are rows to a series, which bounds the prices that go on into further ranges by the
    number of rows. An instant that several bounds fall on has as many salts.
    """
    both = events.select("ts").union(prices.select("ts")).where("ts is not null")
    grid = [k / RANGES for k in range(1, RANGES)]
    found = both.agg(F.count(F.lit(1)).alias("n"), F.percentile_approx(F.unix_micros("ts"), grid, 10 * RANGES).alias("at")).first()
    size = max(2, rows_per_task // 4)
    wanted = min(RANGES, math.ceil(found["n"] / size), max(1, found["n"] // max(profile.series, 1)))
    drawn = [found["at"][k * RANGES // wanted - 1] for k in range(1, wanted)] if found["at"] else []
    starts = sorted(set(drawn))
    return _Bounds([-(1 << 62), *starts], [1, *[drawn.count(s) for s in starts]])


def _merge(events: DataFrame, intervals: DataFrame, values: Sequence[str], by: Sequence[str], bounds: _Bounds) -> DataFrame:
    """Merge events and prices in time order inside ranges of time, after one shuffle by series and range.

    A price goes into the range it begins in and, as the one to begin with, into those that begin while it holds. Prices
    of ranges with salts go to each salt.
    """
    until = F.coalesce(F.expr("_to - interval 1 microsecond"), F.timestamp_micros(F.lit(1 << 61)))
    first, last = bounds.range_of(F.col("_from")), bounds.range_of(until)
    priced = intervals.where(" and ".join(["true", *[f"`{c}` is not null" for c in by]]))
    held = priced.withColumn("_range", F.explode(F.sequence(first, last)))
    salt = F.sequence(F.lit(0).cast("long"), bounds.of(bounds.salts, F.col("_range")) - 1)
    offered = held.select(*by, "_range", F.explode(salt).alias("_salt"), F.col("_from").alias("ts"), F.struct(*values).alias("_price"), F.lit(False).alias("_event"))
    # copies hash alike, so the input partition goes into the salt as well
    spread = F.xxhash64(F.spark_partition_id(), *[F.col(c) for c in _hashable(events)])
    located = events.withColumn("_range", F.when(F.col("ts").isNotNull(), bounds.range_of(F.col("ts"))).otherwise(0))
    located = located.withColumns({"_salt": F.pmod(spread, bounds.of(bounds.salts, F.col("_range"))), "_event": F.lit(True)})
    rows = located.unionByName(offered, allowMissingColumns=True)
    # false sorts before true: a price at the same instant precedes the event
    w = Window.partitionBy(*by, "_range", "_salt").orderBy("ts", "_event")
    seen = F.last("_price", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return (
        rows.withColumn("_seen", seen)
        .where("_event")
        .select(*events.columns, *[F.col(f"_seen.{v}").alias(v) for v in values])
    )


def _hashable(df: DataFrame) -> list[str]:
    return [name for name, kind in df.dtypes if "map<" not in kind and "variant" not in kind]
