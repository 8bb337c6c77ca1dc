"""Calendar windows, idempotency and adaptive slicing."""

from __future__ import annotations

import zoneinfo
from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from twinledger.functions.values import literal_for
from twinledger.model import (
    STATUS_PENDING,
    STATUS_SKIPPED,
    WINDOW_CUSTOM,
    WINDOW_LAST_DAYS,
    WINDOW_LAST_MONTHS,
    WINDOW_LAST_WEEKS,
    WINDOW_PREVIOUS_DAY,
    WINDOW_PREVIOUS_MONTH,
    WINDOW_PREVIOUS_WEEK,
)
from twinledger.operators.skew import hot_keys_of, join_unique
from twinledger.session import require_utc, stored

# Slicing limits and messages.
MAX_PAGES = 20
MAX_WINDOWS = 512
ORDER_ERROR = "Automation window start must be before window end"
START_ERROR = "windowStartDate is required for custom automation windows"
END_ERROR = "windowEndDate is required for custom automation windows"

_OFFSET_ZONE = r"^(?:UTC|GMT|UT)?[+-](?:0?\d|1[0-7])(?::[0-5]\d)?$"


def zone_or_utc(col: Column) -> Column:
    """A usable zone id; blank or unknown names mean UTC."""
    name = F.trim(col)
    known = name.isin(sorted(zoneinfo.available_timezones() - {"Factory", "localtime"})) | name.rlike(_OFFSET_ZONE)
    return F.when(known, name).otherwise(F.lit("UTC"))


def local_midnight(day: Column, zone: Column) -> Column:
    """Start of a local day as an instant; a midnight lost to DST moves forward."""
    return F.to_utc_timestamp(day.cast("timestamp"), zone)


# --- windows -----------------------------------------------------------------


def resolve_windows(automations: DataFrame, fire_col: str = "fireTime") -> DataFrame:
    """Adds ``windowStart``, ``windowEnd``, ``zone`` and ``windowError``.

    Expects ``relativeWindowTypeEnumId``, ``relativeWindowCount``,
    ``customWindowStartDate``, ``customWindowEndDate`` and ``windowTimeZone``.
    An invalid automation carries its error; the others go on.
    """
    require_utc(automations.sparkSession)
    zone = F.col("zone")
    day = F.to_date(F.from_utc_timestamp(F.col(fire_col), zone))
    week = F.to_date(F.date_trunc("week", day))
    month = F.trunc(day, "month")
    asked = F.coalesce(F.col("relativeWindowCount").cast("int"), F.lit(1))
    count = F.greatest(asked, F.lit(1))
    kind = F.coalesce(F.nullif(F.trim("relativeWindowTypeEnumId"), F.lit("")), F.lit(WINDOW_LAST_DAYS))
    start_day = (
        F.when(kind == WINDOW_PREVIOUS_DAY, F.date_sub(day, 1))
        .when(kind == WINDOW_PREVIOUS_WEEK, F.date_sub(week, 7))
        .when(kind == WINDOW_PREVIOUS_MONTH, F.add_months(month, -1))
        .when(kind == WINDOW_LAST_WEEKS, F.date_sub(week, count * 7))
        .when(kind == WINDOW_LAST_MONTHS, F.add_months(month, -count))
        .otherwise(F.date_sub(day, count))
    )
    end_day = (
        F.when(kind.isin(WINDOW_PREVIOUS_WEEK, WINDOW_LAST_WEEKS), week)
        .when(kind.isin(WINDOW_PREVIOUS_MONTH, WINDOW_LAST_MONTHS), month)
        .otherwise(day)
    )
    custom = kind == WINDOW_CUSTOM
    start = F.when(custom, F.col("customWindowStartDate")).otherwise(local_midnight(start_day, zone))
    end = F.when(custom, F.col("customWindowEndDate")).otherwise(local_midnight(end_day, zone))
    error = (
        F.when(F.col("windowStart").isNull(), START_ERROR)
        .when(F.col("windowEnd").isNull(), END_ERROR)
        .when(F.col("windowStart") >= F.col("windowEnd"), ORDER_ERROR)
    )
    return (
        automations.withColumn("zone", zone_or_utc(F.col("windowTimeZone")))
        .withColumn("windowStart", start).withColumn("windowEnd", end).withColumn("windowError", error)
    )


def split_month_windows(
    windows: DataFrame, start_col: str = "windowStart", end_col: str = "windowEnd", zone_col: str = "zone"
) -> DataFrame:
    """Cut each window at local month starts; ``sequenceNum`` counts from 1."""
    require_utc(windows.sparkSession)
    zone = F.col(zone_col)
    start, end = F.col(start_col), F.col(end_col)
    first = F.trunc(F.from_utc_timestamp(start, zone), "month")
    last = F.trunc(F.from_utc_timestamp(end, zone), "month")
    months = F.sequence(first, last, F.expr("interval 1 month"))
    month_start = local_midnight(F.col("_month"), zone)
    month_end = local_midnight(F.add_months("_month", 1), zone)
    child_start, child_end = F.col("childWindowStart"), F.col("childWindowEnd")
    return (
        windows.filter(start < end)
        .select("*", F.posexplode(months).alias("_pos", "_month"))
        .withColumn("sequenceNum", F.col("_pos") + 1)
        .withColumn("childWindowStart", F.greatest(start, month_start))
        .withColumn("childWindowEnd", F.least(end, month_end))
        .filter(child_start < child_end)
        .drop("_pos", "_month")
    )


def calendar_window(
    df: DataFrame, start_col: str = "windowStart", end_col: str = "windowEnd",
    zone_col: str = "windowTimeZone", start_date_col: str | None = None, end_date_col: str | None = None,
) -> DataFrame:
    """Local calendar meaning of a window, with ``calendarDateNormalized``.

    Explicit local dates become zone midnights; a whole-day range given as UTC
    midnights is read as local days; anything else is left alone.
    """
    require_utc(df.sparkSession)
    zone = zone_or_utc(F.col(zone_col))
    start, end = F.col(start_col), F.col(end_col)
    null_date = F.lit(None).cast("date")
    from_day = F.to_date(F.col(start_date_col)) if start_date_col else null_date
    to_day = F.to_date(F.col(end_date_col)) if end_date_col else null_date
    explicit = from_day.isNotNull() & to_day.isNotNull()
    whole_days = F.coalesce(
        (start == F.date_trunc("day", start)) & (end == F.date_trunc("day", end)) & (start < end), F.lit(False)
    )

    def local(given: Column, instant: Column) -> Column:
        return (
            F.when(explicit, local_midnight(given, zone))
            .when(whole_days, local_midnight(F.to_date(instant), zone))
            .otherwise(instant)
        )

    new_start, new_end = local(from_day, start), local(to_day, end)
    return df.select(
        *[c for c in df.columns if c not in (start_col, end_col)],
        new_start.alias(start_col), new_end.alias(end_col), zone.alias("zone"),
        (explicit | whole_days).alias("calendarDateNormalized"),
    )


def idempotent_windows(candidates: DataFrame, executions: DataFrame) -> DataFrame:
    """Candidate windows with their ``disposition``: NEW, REUSED or skipped.

    A window already executed is skipped unless its execution is still
    pending.  Executions collapse to one row per window before the join.
    """
    keys = ["automationId", "scheduledDate", "childWindowStart", "childWindowEnd"]
    done = executions.groupBy(*keys).agg(
        F.max((F.col("statusEnumId") != STATUS_PENDING).cast("int")).alias("_finished")
    )
    disposition = (
        F.when(F.col("_finished").isNull(), "NEW").when(F.col("_finished") == 0, "REUSED")
        .otherwise(STATUS_SKIPPED)
    )
    joined = join_unique(candidates, done, keys, "left", hot_keys_of(candidates, keys))
    return joined.withColumn("disposition", disposition).drop("_finished")


def due_automations(automations: DataFrame, now, limit: int = 100) -> DataFrame:
    """Active automations whose next run is due, earliest first.

    A stored next fire time decides; otherwise the last whole step of a fixed
    ``scheduleSeconds`` interval since the last run, computed directly, or the
    last calendar fire time if the caller supplies ``lastCronFireTime``.
    """
    at = F.lit(now).cast("timestamp")
    last = F.col("lastScheduledFireTime").cast("timestamp")
    step = F.col("scheduleSeconds").cast("bigint")
    steps = F.floor((F.unix_micros(at) - F.unix_micros(last)) / (step * 1_000_000))
    by_interval = F.when(
        (step > 0) & (steps >= 1), F.timestamp_micros(F.unix_micros(last) + steps * step * 1_000_000)
    )
    fire = by_interval
    if "lastCronFireTime" in automations.columns:
        cron = F.col("lastCronFireTime").cast("timestamp")
        fire = F.when(cron.isNotNull(), F.when(last.isNull() | (last < cron), cron)).otherwise(by_interval)
    stored = F.col("nextScheduledFireTime").cast("timestamp")
    due = F.when(stored.isNotNull(), F.when(stored <= at, stored)).otherwise(fire)
    return (
        automations.filter(F.upper("isActive") == "Y").withColumn("dueFireTime", due)
        .filter(F.col("dueFireTime").isNotNull()).orderBy("dueFireTime", "automationId").limit(limit)
    )


# --- tagging rows with windows -----------------------------------------------

def tag_windows(
    df: DataFrame, ts_col: str, windows: DataFrame, id_col: str = "window_id",
    start_col: str = "start", end_col: str = "end", salt_buckets: int = 16,
) -> DataFrame:
    """Each record once per window that contains it, with the window's id.

    A window of width w covers two cells at most of the smallest power of two
    microseconds that isn't less than w.  Windows are listed under those cells
    and records under their cell of each width in use, so the match is an equi
    join that offers a record only windows of neighbouring times, whatever
    their length.  The widths in use are few (64 at most).  Both sides carry a
    salt, so that a busy cell is spread over tasks; a window has ``salt_buckets``
    rows for it.
    """
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    level = F.ceil(F.log2(F.greatest(F.lit(1), F.col("_to") - F.col("_from")).cast("double"))).cast("int")
    cell = lambda at, bits: F.expr(f"cast(floor(({at}) / power(2D, {bits})) as bigint)")
    ranged = windows.filter(F.col(start_col) < F.col(end_col)).select(
        F.col(id_col), micros(start_col).alias("_from"), micros(end_col).alias("_to")).withColumn("_level", level)
    cells = ranged.withColumn("_cell", F.explode(F.array_distinct(F.array(cell("_from", "_level"), cell("_to - 1", "_level")))))
    spread = cells.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salt_buckets - 1))))
    levels = sorted(r["_level"] for r in ranged.select("_level").distinct().collect())
    if not levels:
        return df.select("*", F.lit(None).cast(windows.schema[id_col].dataType).alias(id_col)).filter(F.lit(False))
    salt = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]), F.lit(salt_buckets)).cast("int")
    rows = df.withColumns({"_at": micros(ts_col), "_salt": salt}).withColumn("_level", F.explode(F.array(*[F.lit(x) for x in levels])))
    rows = rows.withColumn("_cell", cell("_at", "_level"))
    inside = (F.col("_at") >= F.col("_from")) & (F.col("_at") < F.col("_to"))
    return rows.join(spread, ["_level", "_cell", "_salt"]).filter(inside).select(*df.columns, id_col)


# --- adaptive slicing --------------------------------------------------------


@dataclass
class Slices:
    """Accepted windows in time order, as rows, and what finding them took."""

    rows: DataFrame | None
    page_count: int = 0
    window_count: int = 0
    split_count: int = 0
    error: str | None = None

    def frame(self, spark: SparkSession) -> DataFrame:
        """The slices as rows; a search that ended early is an error, never a partial frame."""
        if self.error:
            raise ValueError(self.error)
        return self.rows

    @property
    def windows(self) -> list[tuple[datetime, datetime, int]]:
        """The slices on the driver, for callers that have few."""
        if self.rows is None:
            return []
        return [(r["start"], r["end"], r["recordCount"]) for r in self.rows.orderBy("sequenceNum").collect()]


_EPOCH = datetime(1970, 1, 1)
LEVELS_PER_PASS = 12


def _millis(moment: datetime) -> int:
    return (moment - _EPOCH) // timedelta(milliseconds=1)


def _range(start: Column, end: Column) -> Column:
    return F.struct(start.alias("s"), end.alias("e"))


def _half(cell: Column, at: Column) -> Column:
    """The half of a range that holds a time, cut at the lower middle; a range of one millisecond stays whole."""
    middle = F.shiftright(cell["s"] + cell["e"], 1)
    return F.when(cell["e"] - cell["s"] <= 1, cell).when(at < middle, _range(cell["s"], middle)).otherwise(_range(middle, cell["e"]))


def _cell(at: Column, root: Column, depth: int) -> Column:
    """The range that holds a time after ``depth`` halvings of the root."""
    return F.aggregate(F.sequence(F.lit(1), F.lit(depth)), root, lambda cell, _: _half(cell, at)) if depth else root


def _cells(at: Column, root: Column, above: int, depth: int) -> Column:
    """The ranges that hold a time after more than ``above`` halvings and up to ``depth``."""
    base = _cell(at, root, above)
    path = F.aggregate(F.sequence(F.lit(above + 1), F.lit(depth)), F.array(base), lambda p, _: F.array_append(p, _half(F.element_at(p, -1), at)))
    return F.array_except(F.array_distinct(path), F.array(base))


def _numbered(rows: DataFrame, key: str, number: str) -> DataFrame:
    """Rows numbered from 1 by a unique key: sorted by range over all tasks, each task's numbers follow those of the tasks before."""
    at, task = "_at", "_task"
    placed = rows.repartitionByRange(key).sortWithinPartitions(key).withColumn(at, F.monotonically_increasing_id())
    placed = stored(placed.withColumns({task: F.shiftright(at, 33), at: F.col(at).bitwiseAND(F.lit((1 << 33) - 1))}), "numbered")
    counts = placed.groupBy(task).agg(F.count(F.lit(1)).alias("_n"))
    before = counts.select(task, F.coalesce(F.sum("_n").over(Window.orderBy(task).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    return placed.join(before, task).withColumn(number, F.col("_before") + F.col(at) + 1).drop(at, task, "_before")


def adaptive_slices(
    df: DataFrame, ts_col: str, start: datetime, end: datetime, page_size: int,
    max_pages: int = MAX_PAGES, max_windows: int | None = None,
) -> Slices:
    """Halve ``[start, end)`` until every slice holds at most ``max_pages`` pages.

    A dyadic tree of counts, as rows: times are counted by millisecond once,
    each pass counts ``LEVELS_PER_PASS`` levels of halving together below the
    ranges that are still too full, and reads the counts inside those only.
    Slices are the halves that fit of the ranges that don't; empty ones too.
    The driver sees totals.  There is no limit on slices unless
    ``max_windows`` sets one (a source's own limit is ``MAX_WINDOWS``); where
    it or the smallest slice is reached, ``error`` says so and ``frame``
    raises.
    """
    require_utc(df.sparkSession)
    if not start < end:
        return Slices(None, error="Window start must be before window end.")
    capacity = page_size * max_pages
    dtype = df.schema[ts_col].dataType
    root = _range(F.lit(_millis(start)).cast("long"), F.lit(_millis(end)).cast("long"))
    ts = F.col(ts_col)
    inside = df.filter((ts >= literal_for(start, dtype)) & (ts < literal_for(end, dtype)))
    counts = stored(inside.groupBy(F.expr(f"unix_millis(cast(`{ts_col}` as timestamp))").alias("at")).agg(F.count(F.lit(1)).alias("n")), "slices")
    at = F.col("at")
    total = counts.agg(F.sum("n")).first()[0] or 0
    if total <= capacity:
        rows = counts.sparkSession.range(1).select(F.lit(1).cast("long").alias("sequenceNum"), F.timestamp_millis(F.lit(_millis(start))).alias("start"),
                                                   F.timestamp_millis(F.lit(_millis(end))).alias("end"), F.lit(total).cast("long").alias("recordCount"))
        return Slices(rows, max(1, -(-total // page_size)), 1, 0)
    found = stored(df.sparkSession.range(1).select(root["s"].alias("s"), root["e"].alias("e"), F.lit(total).cast("long").alias("n")), "slices")
    rows, depth, error, splits = counts, 0, None, 0
    while error is None:
        further = depth + LEVELS_PER_PASS
        leaves = stored(rows.groupBy(_cell(at, root, further).alias("cell")).agg(F.sum("n").alias("n")), "slices")
        levels = leaves.select(F.explode(_cells(F.col("cell.s"), root, depth, further)).alias("cell"), "n").groupBy("cell").agg(F.sum("n").alias("n"))
        found = found.unionByName(stored(levels.select("cell.s", "cell.e", "n"), "slices"))
        full = found.filter(F.col("n") > capacity)
        splits, narrow = full.agg(F.count(F.lit(1)), F.count_if(F.col("e") - F.col("s") <= 1)).first()
        if narrow:
            error = f"More than {max_pages} pages for {ts_col} in the minimum split window. Choose a smaller time period."
        elif max_windows is not None and 1 + 2 * splits > max_windows:
            error = f"Window split limit ({max_windows}) would be exceeded for {ts_col}. Choose a smaller time period."
        opened = leaves.filter(F.col("n") > capacity).select("cell")
        if opened.isEmpty():
            break
        rows, depth = stored(rows.withColumn("cell", _cell(at, root, further)).join(opened, "cell", "left_semi").select("at", "n"), "slices"), further
    if error:
        return Slices(None, window_count=1 + 2 * splits, split_count=splits, error=error)
    middle = F.shiftright(F.col("s") + F.col("e"), 1)
    halves = full.select(F.explode(F.array(_range(F.col("s"), middle), _range(middle, F.col("e")))).alias("cell")).select("cell.s", "cell.e")
    fits = halves.join(found, ["s", "e"], "left").withColumn("n", F.coalesce("n", F.lit(0))).filter(F.col("n") <= capacity)
    slices = stored(_numbered(fits, "s", "sequenceNum").select(
        "sequenceNum", F.timestamp_millis("s").alias("start"), F.timestamp_millis("e").alias("end"), F.col("n").alias("recordCount")), "slices")
    pages = slices.agg(F.sum(F.greatest(F.lit(1), F.ceil(F.col("recordCount") / page_size)))).first()[0]
    return Slices(slices, int(pages) + splits * max_pages, 1 + 2 * splits, splits)
