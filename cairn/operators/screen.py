"""Screening of faulty readings: a ceiling, and readings that stay flat in the melt season.

Series are dealt out over the tasks and sorted by Spark; a task takes those of a batch together, as arrays
laid end to end, so its work goes with readings and not with stations.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Most water (in), spread and least value of a flat run (in), readings in season that make it a fault.
CEILING, FLAT, FLAT_LEAST, RUN = 200.0, 0.25, 1.0, 7
MELT = ("06-01", "09-30")
WINDOW = 10


class Series:
    """Whole series of several stations, end to end: days since 1970 (the greatest number if unknown), values, and where each begins."""

    def __init__(self, rows: pa.Table):
        self.rows = rows.combine_chunks()
        keys, day = self.rows["station"], self.rows["day"].cast(pa.int32())
        self.dated = pc.is_valid(day).to_numpy()
        self.days = pc.fill_null(day, np.iinfo(np.int32).max).to_numpy().astype(np.int64)
        self.values = self.rows["value"].to_numpy()
        key, lost = pc.fill_null(keys, 0).to_numpy(), pc.is_null(keys).to_numpy()
        self.heads = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]) | (lost[1:] != lost[:-1]))))
        self.lengths = np.diff(np.concatenate((self.heads, [len(key)])))
        self.first = np.repeat(self.heads, self.lengths)

    def warm(self) -> np.ndarray:
        """Whether each day lies in the melt season."""
        days = np.where(self.dated, self.days, 0).astype("datetime64[D]")
        months = days.astype("datetime64[M]")
        in_year = (months.astype(int) % 12 + 1) * 100 + (days - months).astype(int) + 1
        low, high = (int(m.replace("-", "")) for m in MELT)
        return self.dated & (in_year >= low) & (in_year <= high)

    def newest(self, when: int) -> np.ndarray:
        """Of each series the place of the newest reading up to a day, below its head if there is none."""
        return self.heads + np.add.reduceat((self.days <= when).astype(int), self.heads) - 1

    def taken(self, places: np.ndarray, *names: str) -> list[pa.Array]:
        return [self.rows[n].take(pa.array(places)).combine_chunks() for n in names]


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[Series]:
    """The batches of a task, cut so that no series is."""
    held: list[pa.RecordBatch] = []
    for batch in (b for b in batches if b.num_rows):
        keys = batch.column("station")
        same = pc.equal(keys, keys[-1]) if keys[-1].is_valid else pc.is_null(keys)
        cut = batch.num_rows - pc.sum(same).as_py()
        if held and (cut or held[-1].column("station")[-1] != keys[-1]):
            yield Series(pa.Table.from_batches([*held, batch.slice(0, cut)]))
            held = []
        elif cut:
            yield Series(pa.Table.from_batches([batch.slice(0, cut)]))
        held.append(batch.slice(cut))
    if held:
        yield Series(pa.Table.from_batches(held))


def _by_series(daily: DataFrame, judge: Callable[[Series], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """What ``judge`` gives of all series; each is ordered by day, then ``ord`` if there is one, nulls last."""
    typed = {"station": "long", "day": "date", "value": "double", "ord": "long"}
    columns = [c for c in typed if c != "ord" or "ord" in daily.columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for series in _whole(batches):
            yield from judge(series)

    dealt = daily.select(*(F.col(c).cast(typed[c]).alias(c) for c in columns)).repartition("station")
    return dealt.sortWithinPartitions("station", *(F.col(c).asc_nulls_last() for c in columns if c in ("day", "ord"))).mapInArrow(run, schema)


def run_starts(values: np.ndarray, ceiling: float = CEILING, first: np.ndarray | None = None) -> np.ndarray:
    """For each reading the place of the first of the longest flat run that ends there (itself, if none does).

    The spread of a stretch only grows with its length, so for all readings at once the first place
    is found by bisection, with the least and greatest of stretches of 1, 2, 4, ... readings at hand.
    ``first``: the place where the series of each reading begins, if there are several.
    """
    n = len(values)
    first = np.zeros(n, int) if first is None else first
    here = np.arange(n)
    longest = int((here - first).max(initial=-1)) + 1
    fit = (values >= FLAT_LEAST) & (values <= ceiling)
    low, high = [np.where(fit, values, -np.inf)], [np.where(fit, values, np.inf)]
    while 1 << len(low) <= longest:
        half = 1 << (len(low) - 1)
        low.append(np.minimum(low[-1][:-half], low[-1][half:]))
        high.append(np.maximum(high[-1][:-half], high[-1][half:]))
    start = here.copy()
    least, most = low[0].copy(), high[0].copy()
    for k in range(len(low) - 1, -1, -1):
        # Each stretch grows by 2**k readings to the left where it stays flat.
        at = start - (1 << k)
        can = at >= first
        with np.errstate(invalid="ignore"):
            a = np.minimum(least[can], low[k][at[can]])
            b = np.maximum(most[can], high[k][at[can]])
            flat = b - a <= FLAT
        grown = np.flatnonzero(can)[flat]
        start[grown] = at[grown]
        least[grown], most[grown] = a[flat], b[flat]
    return start


def faults(series: Series, ceiling: float = CEILING) -> np.ndarray:
    """For each reading the first place of the faulty run that ends there, or -1."""
    values = series.values
    start = run_starts(values, ceiling, series.first)
    warm = np.concatenate(([0], np.cumsum(series.warm())))
    here = np.arange(len(values))
    stuck = (values >= FLAT_LEAST) & (warm[here + 1] - warm[start] >= RUN)
    return np.where(values > ceiling, here, np.where(stuck, start, -1))


def _rejected(start: np.ndarray, last: np.ndarray, heads: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each reading the first and the last place of the run that is rejected with it, -1 if it stays.

    All series are walked back at once, each from its ``last`` reading down to its head: a fault that is met takes its run with it.
    """
    here = np.arange(len(start))
    fault = np.maximum.accumulate(np.where(start >= 0, here, -1))
    end = np.full(len(start), -1)
    on = last >= heads
    at, low = last[on], heads[on]
    while len(at):
        at = fault[at]
        on = at >= low
        at, low = at[on], low[on]
        end[start[at]] = at
        at = start[at] - 1
        on = at >= low
        at, low = at[on], low[on]
    run = np.maximum.accumulate(np.where(end >= 0, here, -1))
    gone = (run >= 0) & (end[run] >= here)
    return np.where(gone, run, -1), np.where(gone, end[run], -1)


def believed(daily: DataFrame) -> DataFrame:
    """``daily`` (station, day, value) with ``believed`` as of each station's newest day.

    From the newest reading backwards a faulty run is rejected whole and the walk goes on
    before it, so what is rejected depends on what was rejected after it. A station has a reading a day.
    """
    names = ["station", "day", "value", "believed"]

    def judge(series: Series) -> Iterator[pa.RecordBatch]:
        run, _ = _rejected(faults(series), series.heads + series.lengths - 1, series.heads)
        yield pa.RecordBatch.from_arrays([*series.taken(np.arange(len(run)), *names[:3]), pa.array(run < 0)], names)

    return _by_series(daily.select("station", "day", "value"), judge, "station long, day date, value double, believed boolean")


def _days(dates: list[str]) -> list[int]:
    return [int(np.datetime64(d, "D").astype(int)) for d in dates]


def _date(days: np.ndarray, mask: np.ndarray | None = None) -> pa.Array:
    return pa.array(days.astype(np.int32), mask=mask).cast(pa.date32())


def believed_as_of(daily: DataFrame, dates: list[str]) -> DataFrame:
    """Station, eval_date, day, value, faulty_since: the readings of the window that are believed at each date.

    If a station's newest reading is rejected, it falls silent: none of its window is believed; if that
    reading lies in the window, one row without a day tells since when the station is faulty.
    """
    whens = _days(dates)

    def judge(series: Series) -> Iterator[pa.RecordBatch]:
        start = faults(series)
        here, days = np.arange(len(start)), series.days
        for when in whens:
            last = series.newest(when)
            run, _ = _rejected(start, last, series.heads)
            newest = np.repeat(last, series.lengths)
            near = (here <= newest) & (when - days <= WINDOW)
            mute = start[newest] >= 0
            out = np.flatnonzero(near & np.where(mute, here == newest, run < 0))
            told = mute[out]
            station, day, value = series.taken(out, "station", "day", "value")
            hide = lambda a: pc.if_else(pa.array(told), pa.scalar(None, a.type), a)  # noqa: E731, B023
            since = _date(np.where(told, days[start[out]], 0), ~told)
            yield pa.RecordBatch.from_arrays([station, _date(np.full(len(out), when)), hide(day), hide(value), since], ["station", "eval_date", "day", "value", "faulty_since"])

    return _by_series(daily.select("station", "day", "value"), judge, "station long, eval_date date, day date, value double, faulty_since date")


def judged_as_of(daily: DataFrame, dates: list[str], ceiling: float = CEILING, back: int = 14) -> DataFrame:
    """W03 to W05 for all that reads a station: station, eval_date, day, value, ord, state, reason, since.

    ``daily`` holds station, day, value and ord, which orders readings of a day. At each date a
    reading up to it is ``believed``, ``rejected`` (reason ``ceiling`` or ``stuck``, since when) or ``silent``: the
    newest one is rejected, so those of the window count no more, while older ones still date a melt-out. Given are the
    readings of the date's year and of the ``back`` days before it, and the newest one whenever it was.
    """
    whens = _days(dates)
    schema = "station long, eval_date date, day date, value double, ord long, state string, reason string, since date, newest boolean"

    def judge(series: Series) -> Iterator[pa.RecordBatch]:
        start = faults(series, ceiling)
        here, days = np.arange(len(start)), series.days
        for when in whens:
            last = series.newest(when)
            run, end = _rejected(start, last, series.heads)
            newest = np.repeat(last, series.lengths)
            opens = int(np.datetime64(when, "D").astype("datetime64[Y]").astype("datetime64[D]").astype(int))
            out = np.flatnonzero((here <= newest) & ((here == newest) | (when - days <= back) | (days >= opens)))
            run, end = run[out], end[out]
            mute = np.repeat(start[last] >= 0, series.lengths)[out]
            gone = run >= 0
            state = np.where(gone, 2, mute & (when - days[out] <= WINDOW))
            reason = (series.values[end] > ceiling).astype(int)
            station, day, value, ord_ = series.taken(out, "station", "day", "value", "ord")
            words = pa.array(["believed", "silent", "rejected"]).take(pa.array(state)), pa.array(["stuck", "ceiling"]).take(pa.array(reason, mask=~gone))
            columns = [station, _date(np.full(len(out), when)), day, value, ord_, *words, _date(np.where(gone, days[run], 0), ~gone), pa.array(out == newest[out])]
            yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in schema.split(", ")])

    return _by_series(daily.select("station", "day", "value", "ord"), judge, schema)


def ceiling_counts(daily: DataFrame, ceiling: float) -> DataFrame:
    """station, readings, over: readings above a ceiling."""
    return daily.groupBy("station").agg(F.count("*").alias("readings"), F.sum((F.col("value") > ceiling).cast("long")).alias("over"))
