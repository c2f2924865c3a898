"""The survey analyses: tow table -> log transform -> annual means -> running
means -> standard deviation, for one trophic value (summed forage fish or
zooplankton volume).

Physical shape (one plan at every scale):

* a narrow pass over the tows (region, season, year, value; the fish variant
  dedupes samples in it, the group-sum variant aggregates rows to weighted
  sample entries) is stored once in the shared checkpoint folder, since several
  steps read it; ``Series.close()`` deletes it;
* the per-(region, season) minimum is a partial aggregate of at most regions x
  seasons rows (a bound by construction) and comes back as a broadcast join;
* the annual table is a partial aggregate; running means and SDs are windows
  and aggregates over it alone;
* tow-level outputs of a deduped analysis store the deduped rows once, with
  all their columns, and every other step reads its few columns from there;
  those of a plain one read the tows once more. The annual statistics are a
  stored table by then, so the planner knows its real size when it picks the
  join (a broadcast, whatever years the data spans);
* the first row of each year is found over keys and order columns only. Its few
  keys then go to the source (``fetch``), below its joins, so that the second
  pass over the tows scans and shuffles nothing but the rows it returns.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftline import constants as C
from driftline.functions.classify import region_name, region_names, season
from driftline.functions.numeric import half_min_log, nan_to_null, row_sum
from driftline.operators.columns import relocate, rest_first, select_positions
from driftline.operators.dedupe import asc_nulls_last, prefer_then_first, prefer_where_repeated
from driftline.operators.filters import scalar_max
from driftline.operators.joins import attach
from driftline.operators.reshape import layer_table
from driftline.operators.series import (
    annual_mean,
    group_row_sum,
    plain_min,
    positive_min,
    running_mean,
    weighted_annual_mean,
    with_weighted_sd,
    with_year_sd,
    year_sd,
)
from driftline.plans.materialize import broadcast_bounded
from driftline.session import delete_scratch, scratch_path

Fetch = Callable[[DataFrame], DataFrame]

WEIGHT = "_tows"
ROWS = "_rows"  # rows an entry stands for


@dataclass(frozen=True)
class Names:
    """Output column names of one analysis."""

    # fixed values: names of the reference tables
    region: str = "region_name"
    log: str = "log10_FF"
    mean: str = "log_mean_FF"
    run: str = "runMean_FF"
    full: str = "running_mean"
    sd: str = "sd_FF"
    minimum: str = "min_nonzero"


@dataclass(frozen=True)
class SeriesSpec:
    """Parameters of one analysis (defaults = the maintained forage-fish run)."""

    value: str = "fishsum"                     # trophic value column
    parts: tuple[str, ...] = C.FORAGE_FISH     # summed into ``value``; () = value is a column
    sum_mode: str = "row"                      # 'row' | 'group' (draft: sum over the sample group)
    sum_keys: tuple[str, ...] = C.DRAFT_SAMPLE_KEY
    positions: tuple = ()                      # 1-based projection of the raw input (draft)
    keep: tuple[str, ...] | None = None        # projection by name after classification
    metadata: tuple[str, ...] | None = C.TOW_METADATA  # without ``keep``: those of them the input has
    region_map: Mapping[int, str] = field(default_factory=lambda: dict(C.REGIONS_MERGED))
    drop_region: int | None = C.REGION_DROPPED_CODE
    sampled: str | None = "ich_gear"           # rows with blank text here were not sampled
    dedupe_keys: tuple[str, ...] | None = C.SAMPLE_KEY
    preferred_col: str = "zoo_gear"
    preferred: str = C.PREFERRED_ZOO_GEAR
    rare_repeats: bool = False                 # few keys repeat (a survey file): dedupe those rows only
    drop_missing: tuple[str, ...] = ()         # drop rows with these missing
    zero_policy: str = "keep"                  # 'keep' (offset zeros) | 'drop' (draft)
    log_base: str = "10"                       # '10' | 'e'
    empty_min: str = "inf"                     # group without positive value: 'inf' | 'null'
    k: int = C.RUN_MEAN_K
    sd_weight: str = "tow"                     # 'tow' (row-weighted) | 'year'
    sd_source: str = "annual"                  # 'annual' | 'running_mean'
    order: tuple[str, ...] = ("_row",)         # file order (total tie-break)
    names: Names = field(default_factory=Names)

    @property
    def group_bound(self) -> int:
        """Rows of any (region, season) table: a bound by construction."""
        return len(region_names(self.region_map)) * (len(C.SEASON_BANDS) + 1)

    @property
    def order_names(self) -> list[str]:
        """Columns ordering the tow table when "first row" is picked.

        After a dedupe the rows are sorted by the sample key (unique), file
        order otherwise.
        """
        lead = list(self.dedupe_keys) if self.dedupe_keys else []
        return lead + [c for c in self.order if c not in lead]

    def visible(self, columns: Sequence[str]) -> list[str] | None:
        """Tow columns of the outputs, in order (``None``: all of them)."""
        if self.keep:
            return list(self.keep)
        if self.metadata is None:
            return None
        found = [c for c in self.metadata if c in columns]
        return found + [c for c in (self.parts or (self.value,)) if c not in found]


class Record:
    """The whole record of one analysis and the tables stored for it."""

    def __init__(self, tows: DataFrame, spec: SeriesSpec, keep: bool = True, fetch: Fetch | None = None):
        self.tows, self.spec, self.keep, self.fetch = tows, spec, keep, fetch
        self.grouped = _entries_apply(spec)
        self._values: dict[bool, DataFrame] = {}
        self._paths: list[str] = []
        self._rows: DataFrame | None = None

    def store(self, df: DataFrame, name: str) -> DataFrame:
        path = scratch_path(df.sparkSession, name)
        df.write.parquet(path)
        self._paths.append(path)
        return df.sparkSession.read.parquet(path)

    def narrow(self, order: bool = False) -> DataFrame:
        """(region, season, year, value) of every tow, or of every sample entry
        with its row count; ``order`` adds the columns that order the tows."""
        if self.grouped and not order:
            return sample_entries(self.tows, self.spec)
        return prepared(self.tows, self.spec, narrow=True, order=order)

    def values(self, order: bool = False) -> DataFrame:
        """:meth:`narrow`, stored once (unless ``keep`` is off)."""
        known = self._values.get(order)
        if known is None and not self.grouped:  # a stored table that holds all that is needed
            known = self._values.get(True)
            if known is None and self._rows is not None and set(self.spec.order_names if order else ()) <= set(self._rows.columns):
                known = self._rows
        if known is None:
            known = self.narrow(order)
            known = self._values[order] = self.store(known, "values") if self.keep else known
        return known

    def rows(self) -> DataFrame:
        """Every tow with all its columns. A dedupe that must carry them all is
        done once, and its result stored for this and the narrow steps."""
        if self._rows is None and self.keep and self.spec.dedupe_keys and not self._values:
            self._rows = self.store(prepared(self.tows, self.spec), "rows")
        return prepared(self.tows, self.spec) if self._rows is None else self._rows

    def rows_at(self, keys: DataFrame) -> DataFrame:
        """The tows that ``keys`` (order columns and more) may name, before any dedupe."""
        tows = self.tows if self.fetch is None else self.fetch(keys)
        return prepared(tows, self.spec, dedupe=False)

    @functools.cached_property
    def minima(self) -> DataFrame:
        """(region, season, minimum) over the whole record."""
        return minimum_table(self.values(), self.spec)

    def logged(self, df: DataFrame) -> DataFrame:
        """``df`` with its group's minimum and the log value."""
        n = self.spec.names
        small = broadcast_bounded(self.minima, self.spec.group_bound)
        out = attach(df, small, [n.region, "season"])
        return out.withColumn(n.log, half_min_log(self.spec.value, n.minimum, self.spec.log_base))

    def close(self) -> None:
        for path in self._paths:
            delete_scratch(self.tows.sparkSession, path)
        self._paths.clear()
        self._values.clear()
        self._rows = None


class Series:
    """Lazily built outputs of one analysis over one tow table.

    ``logged`` holds the tow rows with the minimum and the log value; the
    minimum always comes from the whole record, also for a period slice. Use
    it as a context manager, or call :meth:`close`, to delete what it stored.
    """

    def __init__(self, record: Record, cond: Column | None = None):
        self.record, self.spec, self._cond = record, record.spec, cond
        n = self.spec.names
        self.keys = [n.region, "season", "year"]
        self.part = [n.region, "season"]

    def __enter__(self) -> "Series":
        return self

    def __exit__(self, *exc) -> None:
        self.close()

    def close(self) -> None:
        """Delete the stored tables; outputs must have been computed by then."""
        self.record.close()

    def _sliced(self, df: DataFrame) -> DataFrame:
        return df if self._cond is None else df.filter(self._cond)

    @property
    def entries(self) -> DataFrame | None:
        """Weighted sample entries of the group-sum variant."""
        return self._sliced(self.record.logged(self.record.values())) if self.record.grouped else None

    @functools.cached_property
    def logged(self) -> DataFrame:
        """Every tow with its minimum and log value (order columns included)."""
        return self.record.logged(self._sliced(self.record.rows()))

    # -- small tables ------------------------------------------------------
    @functools.cached_property
    def _annual(self) -> DataFrame:
        """Annual table with the tow count per year (the SD weight)."""
        n = self.spec.names
        values = self._sliced(self.record.logged(self.record.values()))
        if self.record.grouped:
            return weighted_annual_mean(values, self.keys, n.log, n.mean, ROWS, WEIGHT)
        return annual_mean(values, self.keys, n.log, n.mean, weight=WEIGHT)

    @property
    def annual(self) -> DataFrame:
        """(region, year, season, mean): one row per group, as ``summarize`` gives."""
        n = self.spec.names
        return self._annual.select(n.region, "year", "season", n.mean)

    @functools.cached_property
    def _stats(self) -> DataFrame:
        """Annual table with both running means and the group SD on every row."""
        s, n = self.spec, self.spec.names
        a = running_mean(self._annual, self.part, "year", n.mean, n.run, k=s.k)
        a = running_mean(a, self.part, "year", n.mean, n.full, k=s.k, complete=True)
        source = n.mean if s.sd_source == "annual" else n.run
        if s.sd_weight == "tow":
            return with_weighted_sd(a, self.part, source, WEIGHT, n.sd)
        return with_year_sd(a, self.part, source, n.sd)

    @functools.cached_property
    def _stored_stats(self) -> DataFrame:
        """The annual statistics as a table of known size, for joins with tows."""
        return self.record.store(self._stats, "stats")

    @property
    def series(self) -> DataFrame:
        """Annual table plus partial-window and complete-window running means."""
        n = self.spec.names
        return self._stats.select(n.region, "year", "season", n.mean, n.run, n.full)

    @property
    def sd(self) -> DataFrame:
        """(region, season, sd): at most regions x seasons rows."""
        n = self.spec.names
        return self._stats.select(*self.part, n.sd).dropDuplicates(self.part)

    # -- outputs -----------------------------------------------------------
    def _shown(self, df: DataFrame) -> DataFrame:
        """Without order columns that no projection asked for."""
        shown = self.spec.visible(self.record.tows.columns)
        return df if shown is None else df.drop(*[c for c in self.spec.order if c not in shown])

    def summary(self) -> DataFrame:
        """Annual series with both running means and the group SD."""
        n = self.spec.names
        return self._stats.select(n.region, "season", "year", n.mean, n.run, n.full, n.sd)

    def report(self) -> DataFrame:
        """The SD table: region, season, sd (12 rows for three regions)."""
        return self.sd

    def tows(self) -> DataFrame:
        """Every tow with min, log value, its group's annual mean and the SD."""
        n = self.spec.names
        return attach(self._shown(self.logged), self._stored_stats.select(*self.keys, n.mean, n.sd), self.keys)

    def with_annual_mean(self) -> DataFrame:
        """Every tow with its group's annual mean (the grouped ``mutate``)."""
        n = self.spec.names
        return attach(self._shown(self.logged), self._stored_stats.select(*self.keys, n.mean), self.keys)

    @functools.cached_property
    def _first_keys(self) -> DataFrame:
        """The order columns of the first tow of each (region, season, year).

        A partial aggregate over keys and order columns: at most one narrow
        row per group leaves each task. Stored, so its size is known.
        """
        order = self.spec.order_names
        key = F.struct(*[x for i, c in enumerate(order) for x in (F.col(c).isNull().alias(f"missing_{i}"), F.col(c).alias(f"at_{i}"))])
        picked = self._sliced(self.record.values(order=True)).groupBy(*self.keys).agg(F.min(key).alias("first"))
        new = [(i, c) for i, c in enumerate(order) if c not in self.keys]
        return self.record.store(picked.select(*self.keys, *[F.col("first").getField(f"at_{i}").alias(c) for i, c in new]), "first")

    def first_rows(self) -> DataFrame:
        """First tow row (in table order) of every (region, season, year)."""
        first = self._first_keys
        rows = self._sliced(self.record.rows_at(first))
        hit = attach(rows, first.withColumn("_hit", F.lit(True)), first.columns, how="inner").drop("_hit")
        return self.record.logged(hit.dropDuplicates(self.keys))

    def final(self) -> DataFrame:
        """Running-mean table joined to each year's first tow row: the tow columns,
        the value, the minimum, the log, the annual mean, the SD, the running mean."""
        n = self.spec.names
        rows = self._shown(self.first_rows())
        out = attach(self._stored_stats.select(*self.keys, n.mean, n.sd, n.run), rows, self.keys, how="inner")
        # the annual columns go behind those of the tows, then each key to its place among them
        order = rest_first(out.columns, [*self.keys, n.mean, n.sd, n.run])
        for key in sorted(self.keys, key=rows.columns.index):
            at = rows.columns.index(key)
            order = relocate(order, [key], after=rows.columns[at - 1]) if at else relocate(order, [key])
        return out.select(*order)

    def layers(self) -> DataFrame:
        """Chart data: tow log values, annual means, running means in one long table."""
        n = self.spec.names
        tows = self.entries
        if tows is None:
            tows = self._sliced(self.record.logged(self.record.values()))
        else:  # an entry stands for several tows
            tows = tows.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col(ROWS))))
        return layer_table([("tow", tows, n.log), ("annual", self.annual, n.mean),
                            ("running_mean", self.series, n.run)],
                           [n.region, "season", "year"])

    def period(self, lo: int | None, hi: int | None = None, literal_max: bool = False) -> "Series":
        """Slice of the series (``between(year, lo, hi)``; ``hi=None``: from ``lo`` on).

        ``year >= lo`` equals ``between(year, lo, max(year))`` whenever no year
        is missing. With ``literal_max`` the maximum is computed, and one missing
        year empties the slice, as in the method.
        """
        if literal_max:
            cond = F.col("year").between(lo, scalar_max(self._sliced(self.record.values()), "year"))
        else:
            cond = F.col("year") >= lo if hi is None else F.col("year").between(lo, hi)
        return Series(self.record, cond if self._cond is None else self._cond & cond)


# -- building the tow-level tables --------------------------------------------

def classify(tows: DataFrame, spec: SeriesSpec) -> DataFrame:
    """Season, region filter and region name."""
    n = spec.names
    out = tows.withColumn("season", season("month"))
    if spec.drop_region is not None:
        out = out.filter(F.col("region") != spec.drop_region)
    return out.withColumn(n.region, region_name("region", spec.region_map))


def prepared(tows: DataFrame, spec: SeriesSpec, narrow: bool = False, order: bool = False,
             dedupe: bool = True) -> DataFrame:
    """Projection, sampled filter, dedupe and the trophic value, before the offset.

    ``narrow`` keeps (region, season, year, value) only, and the order columns
    with ``order``; the dedupe then carries nothing else through its shuffle.
    """
    n = spec.names
    out = select_positions(tows, spec.positions) if spec.positions else tows
    if spec.sum_mode == "group" and spec.parts:
        # draft: the sum runs over every row of the sample group, repeated on each row
        totals = group_row_sum(out, spec.sum_keys, spec.parts, spec.value)
        out = attach(out, totals, spec.sum_keys, how="inner")
    out = classify(out, spec)
    if spec.sampled:
        out = out.filter(F.col(spec.sampled) != "")
    if spec.sum_mode == "row" and spec.parts:
        out = out.withColumn(spec.value, row_sum(spec.parts))
    lean = [n.region, "season", "year", spec.value]
    if narrow:
        shown = lean + [c for c in spec.order_names if order and c not in lean]
    else:
        shown = spec.visible(out.columns)
        if shown is not None:
            shown = shown + [c for c in spec.order if c in out.columns and c not in shown]
            shown = [c for c in shown if c != spec.value or not spec.parts] + [spec.value] * bool(spec.parts)
    carried = None if shown is None else shown + [c for c in spec.drop_missing if c not in shown]
    if spec.dedupe_keys and dedupe:
        pick = prefer_where_repeated if spec.rare_repeats else prefer_then_first
        out = pick(out, spec.dedupe_keys, spec.preferred_col, spec.preferred, asc_nulls_last(spec.order), carried)
    if spec.drop_missing:
        out = out.dropna(subset=list(spec.drop_missing))
    if spec.zero_policy == "drop":
        out = out.filter(nan_to_null(spec.value) != 0)
    return out if shown is None else out.select(*shown)


def _minimum(spec: SeriesSpec) -> Column:
    """Aggregate expression of the offset minimum."""
    if spec.zero_policy == "drop":
        return plain_min(spec.value)
    return positive_min(spec.value, spec.empty_min)


def minimum_table(df: DataFrame, spec: SeriesSpec) -> DataFrame:
    """Per (region, season): the offset minimum (positive values only, or after
    zeros were dropped)."""
    n = spec.names
    return df.groupBy(n.region, "season").agg(_minimum(spec).alias(n.minimum))


def analyse(tows: DataFrame, spec: SeriesSpec, keep: bool = True, fetch: Fetch | None = None) -> Series:
    """The analysis of one tow table; nothing runs before an output is asked for.

    With ``keep`` the narrow pass over the tows is stored once (worth it when
    ``tows`` is derived: joins, a dedupe, a CSV); ``keep=False`` reads a plain
    columnar table anew instead, which costs no more.

    ``fetch`` gives, for a table of keys that has the order columns, the tows
    those keys may name (more do no harm): a source that is itself a join filters
    its inputs by them. Without it ``tows`` is read once more for first rows.
    """
    return Series(Record(tows, spec, keep, fetch))


def _entries_apply(spec: SeriesSpec) -> bool:
    """Whether the group-sum variant needs no row-level step (projection by
    name, sampled filter, dedupe)."""
    if spec.sum_mode != "group" or not spec.parts or spec.keep or spec.sampled or spec.dedupe_keys:
        return False
    return not set(spec.drop_missing) - {spec.value} and "region" in spec.sum_keys


def sample_entries(tows: DataFrame, spec: SeriesSpec) -> DataFrame:
    """Group-sum variant: one entry per (sample, month, year) with its row count.

    Every row of a sample carries the sample's total, and every row of an
    entry has the same region, season and year, so annual means, minima and
    SDs computed over entries weighted by ``ROWS`` equal those over rows. One
    partial aggregate and a window over its few entries per sample replace the
    join of the totals back onto every row.
    """
    n = spec.names
    out = select_positions(tows, spec.positions) if spec.positions else tows
    keys = list(spec.sum_keys)
    entries = (out.groupBy(*keys, "month", "year")
                  .agg(F.sum(row_sum(spec.parts)).alias("_part"), F.count(F.lit(1)).alias(ROWS))
                  .withColumn(spec.value, F.sum("_part").over(Window.partitionBy(*keys))))
    entries = classify(entries, spec)
    if spec.drop_missing:
        entries = entries.dropna(subset=list(spec.drop_missing))
    if spec.zero_policy == "drop":
        entries = entries.filter(nan_to_null(spec.value) != 0)
    return entries.select("region", n.region, "season", "year", spec.value, ROWS)


def year_weighted_by_code(series: Series, code: str = "region") -> DataFrame:
    """Draft SD: one value per (code, year, season), SD per (code, season).

    The mean comes from the named region; each numeric code present in a year
    contributes that year's mean once.
    """
    n = series.spec.names
    source = series.entries if series.record.grouped else series.logged
    combos = source.select(code, n.region, "season", "year").distinct()
    per_code = attach(combos, series.annual, series.keys)
    return year_sd(per_code, [code, "season"], n.mean, n.sd)


def fish_names(label: str = "FF") -> Names:
    return Names(log=f"log10_{label}", mean=f"log_mean_{label}", run=f"runMean_{label}",
                 sd=f"sd_{label}")


# fixed values: output names of the draft; it called the named region "Region"; Spark and SQL names are case-insensitive,
# so it would collide with the numeric "region" column: it keeps "region_name"
DRAFT_NAMES = Names(region="region_name", log="LogofSum", mean="aver", run="runMean",
                    full="running_mean", sd="SD_ts")


def maintained_fish(**overrides) -> SeriesSpec:
    """Forage fish, maintained analysis (dedupe, row sum, keep zeros, log10)."""
    return replace(SeriesSpec(names=fish_names("FF")), **overrides)


def maintained_volume(**overrides) -> SeriesSpec:
    """Zooplankton volume, maintained analysis (drop missing volume, keep zeros, log10)."""
    base = SeriesSpec(value=C.VOLUME, parts=(), sampled=None, dedupe_keys=None,
                      drop_missing=(C.VOLUME,), names=fish_names("ZP"))
    return replace(base, **overrides)


def draft_fish(**overrides) -> SeriesSpec:
    """Forage fish, workshop draft (group sum, SNE kept, drop zeros, natural log)."""
    base = SeriesSpec(sum_mode="group", metadata=None, region_map=dict(C.REGIONS_SPLIT), sampled=None,
                      dedupe_keys=None, zero_policy="drop", log_base="e", names=DRAFT_NAMES)
    return replace(base, **overrides)


def draft_volume(**overrides) -> SeriesSpec:
    """Zooplankton volume, workshop draft (region 0 kept, drop zeros, natural log)."""
    base = SeriesSpec(value=C.VOLUME, parts=(), metadata=None, region_map=dict(C.REGIONS_SPLIT),
                      drop_region=None, sampled=None, dedupe_keys=None, zero_policy="drop",
                      log_base="e", names=DRAFT_NAMES)
    return replace(base, **overrides)
