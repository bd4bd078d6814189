"""What kind of series it is: season, trend, demand class, breaks, transform.

Works on prepared rows (keys, t, y). Each step keeps the rows of a series in
the partition it was first hashed to, so they follow one another without
further shuffles.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.constants import (
    ADI_CUT,
    BOX_COX_GRID,
    CHANGEPOINT_HISTORY,
    CHANGEPOINT_SIGMAS,
    CV2_CUT,
    LOG_CEILING,
    MIN_OBSERVATIONS,
    RECENT_CHANGEPOINT_SHARE,
    SEASON,
    SEASON_CANDIDATES,
    SEASONAL_DIFFERENCE_FLOOR,
    SERIES_ID,
    SIGNIFICANCE,
    SURROGATE_DRAWS,
    SURROGATE_MARGIN,
    Y,
)
from tidemark.functions import arrays
from tidemark.functions.columns import clip, near_zero
from tidemark.session import cut_lineage

#: Two-sided 5% point of the normal distribution (fixed value).
CRITICAL = 1.959963984540054
#: 5% point of the level-stationarity statistic (fixed value).
KPSS_CRITICAL = 0.463


def compacted(panel: DataFrame, keys: Sequence[str] = (SERIES_ID,)) -> DataFrame:
    """Observed rows only, positions closed up: keys, t, n, y."""
    whole = Window.partitionBy(*keys)
    known = panel.filter(F.col(Y).isNotNull())
    return known.select(
        *keys,
        (F.row_number().over(whole.orderBy("t")) - 1).alias("t"),
        F.count("*").over(whole).alias("n"),
        Y,
    )


def centred_mean(value: Column, width: int, order) -> Column:
    """Centred moving average; an even width halves the two ends."""
    half = width // 2
    frame = order.rowsBetween(-half, half)
    full = F.count(value).over(frame) == 2 * half + 1
    if width % 2:
        return F.when(full, F.avg(value).over(frame))
    ends = F.lag(value, half).over(order) + F.lead(value, half).over(order)
    return F.when(full, (F.sum(value).over(frame) - ends / 2) / width)


def decompose(series: DataFrame, period: int, keys: Sequence[str] = (SERIES_ID,)) -> DataFrame:
    """Adds trend, detrended, seasonal and remainder at one period.

    Only series of at least two periods' length are kept.
    """
    order = Window.partitionBy(*keys).orderBy("t")
    phase = Window.partitionBy(*keys, "_phase")
    whole = Window.partitionBy(*keys)
    trended = (
        series.filter(F.col("n") >= 2 * period)
        .withColumn("trend", centred_mean(F.col(Y), period, order))
        .withColumn("detrended", F.col(Y) - F.col("trend"))
        .withColumn("_phase", F.pmod(F.col("t"), F.lit(period)))
        .withColumn("_mean", F.avg("detrended").over(phase))
        .withColumn("_rows", F.count("*").over(phase))
    )
    # Every phase counts once, however many rows it has.
    share = F.when(F.col("_mean").isNotNull(), 1 / F.col("_rows"))
    centre = F.sum(F.col("_mean") * share).over(whole) / F.sum(share).over(whole)
    return (
        trended.withColumn("seasonal", F.col("_mean") - centre)
        .withColumn("remainder", F.col("detrended") - F.col("seasonal"))
        .drop("_phase", "_mean", "_rows")
    )


def strength(signal: Column, remainder: Column) -> Column:
    """1 - var(remainder) / var(signal + remainder), between 0 and 1 (aggregate)."""
    both = signal.isNotNull() & remainder.isNotNull()
    rest = F.var_samp(F.when(both, remainder))
    total = F.var_samp(F.when(both, signal + remainder))
    value = clip(1 - rest / total, 0.0, 1.0)
    return F.when((F.count_if(both) >= 3) & (total > 0), value).otherwise(0.0)


def autocorrelation(
    series: DataFrame, value: str, lag: int, keys: Sequence[str] = (SERIES_ID,)
) -> DataFrame:
    """keys, n_values, acf, repeats: the lag's correlation against its 5% band."""
    whole = Window.partitionBy(*keys)
    known = series.filter(F.col(value).isNotNull()).withColumn("_c", F.col(value) - F.avg(value).over(whole))
    paired = known.withColumn("_p", F.lag("_c", lag).over(whole.orderBy("t")))
    stats = paired.groupBy(*keys).agg(
        F.count("*").alias("n_values"),
        F.sum(F.col("_c") * F.col("_p")).alias("_cross"),
        F.sum(F.col("_c") * F.col("_c")).alias("_own"),
    )
    n = F.col("n_values")
    acf = F.when((n > lag + 2) & (F.col("_own") > 0), F.col("_cross") / F.col("_own")).otherwise(0.0)
    band = CRITICAL / F.sqrt(n)
    return stats.select(*keys, "n_values", acf.alias("acf"), ((n > lag + 2) & (acf >= band)).alias("repeats"))


def seasonal_evidence(
    series: DataFrame, frequency: str, keys: Sequence[str] = (SERIES_ID,)
) -> DataFrame:
    """keys, period, strength, acf, repeats for every candidate period."""
    return seasonal_evidence_of(history_arrays(series, keys), frequency, keys)


def seasonal_evidence_of(histories: DataFrame, frequency: str, keys: Sequence[str] = (SERIES_ID,)) -> DataFrame:
    """`seasonal_evidence` of one row per series with its ``values``."""
    periods = SEASON_CANDIDATES[frequency]

    def made(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        offsets, values, _ = arrays.flat(arrays.column(batch, "values"))
        out = {f"{name}_{p}": np.zeros(batch.num_rows) for p in periods for name in ("strength", "acf", "repeats")}
        for rows, places in arrays.by_length(offsets):
            for p in periods:
                if places.shape[1] < 2 * p + 1:
                    continue
                seasonal, rest = _seasonal(values[places], p)
                out[f"strength_{p}"][rows] = _strengths(seasonal, rest)
                # The centred mean is missing at the two ends only.
                inner = (seasonal + rest)[:, p // 2 : places.shape[1] - p // 2]
                centred, m = inner - inner.mean(axis=1, keepdims=True), inner.shape[1]
                own = (centred * centred).sum(axis=1)
                with np.errstate(all="ignore"):
                    acf = np.where((m > p + 2) & (own > 0), (centred[:, p:] * centred[:, : max(m - p, 0)]).sum(axis=1) / own, 0.0)
                out[f"acf_{p}"][rows] = acf
                out[f"repeats_{p}"][rows] = (m > p + 2) & (acf >= CRITICAL / np.sqrt(m))
        return {name: pa.array(held) for name, held in out.items()}

    sent = histories.select(*keys, "values", F.size("values").alias("_n"))
    rated = arrays.add_columns(sent, made, ", ".join(f"{name}_{p} double" for p in periods for name in ("strength", "acf", "repeats")), ("values",))
    each = F.array(
        *[
            F.struct(F.lit(p).alias("period"), F.col(f"strength_{p}").alias("strength"), F.col(f"acf_{p}").alias("acf"), (F.col(f"repeats_{p}") > 0).alias("repeats"))
            for p in periods
        ]
    )
    return rated.select(*keys, "_n", F.inline(each)).filter(F.col("_n") >= 2 * F.col("period") + 1).drop("_n")


# ---- Noise floors ----------------------------------------------------------
# A shuffled series has no season; the strength such shuffles reach is what a
# real one must exceed. The shuffles are random draws, which built-in
# expressions cannot make per series, so this is a vectorised Arrow function
# over arrays that a series' calendar bounds.
def _centred(values: np.ndarray, width: int) -> np.ndarray:
    """Centred moving average along the last axis."""
    n, half = values.shape[-1], width // 2
    out = np.full(values.shape, np.nan)
    if width < 2 or n < 2 * half + 1:
        return out
    kernel = np.full(2 * half + 1, 1.0 / width)
    if width % 2 == 0:
        kernel[[0, -1]] /= 2
    windows = np.lib.stride_tricks.sliding_window_view(values, 2 * half + 1, axis=-1)
    out[..., half : n - half] = windows @ kernel
    return out


def _seasonal(values: np.ndarray, period: int) -> tuple[np.ndarray, np.ndarray]:
    """Seasonal part and remainder of each row."""
    detrended = values - _centred(values, period)
    n = values.shape[-1]
    padded = np.full((*values.shape[:-1], -(-n // period) * period), np.nan)
    padded[..., :n] = detrended
    with np.errstate(all="ignore"):
        phases = np.nanmean(padded.reshape(*values.shape[:-1], -1, period), axis=-2)
        phases = phases - np.nanmean(phases, axis=-1, keepdims=True)
    seasonal = np.tile(phases, padded.shape[-1] // period)[..., :n]
    return seasonal, detrended - seasonal


def _strengths(signal: np.ndarray, rest: np.ndarray) -> np.ndarray:
    known = np.isfinite(signal) & np.isfinite(rest)
    signal, rest = np.where(known, signal, np.nan), np.where(known, rest, np.nan)
    with np.errstate(all="ignore"):
        total = np.nanvar(signal + rest, axis=-1, ddof=1)
        share = np.clip(1.0 - np.nanvar(rest, axis=-1, ddof=1) / total, 0.0, 1.0)
    return np.where((known.sum(axis=-1) >= 3) & (total > 0), share, 0.0)


def _inner_mean(values: np.ndarray, width: int) -> np.ndarray:
    """`_centred` without its missing ends: each step adds one neighbour of all rows."""
    half = width // 2
    m = values.shape[-1] - 2 * half
    share = 1.0 / width
    ends = share if width % 2 else share / 2
    out = values[..., :m] * ends
    for k in range(1, 2 * half):
        out += values[..., k : k + m] * share
    out += values[..., 2 * half :] * ends
    return out


def _seasoned(values: np.ndarray, period: int) -> tuple[np.ndarray, np.ndarray]:
    """Seasonal part, and what is left of each value by the moving average, nought
    at the two ends, for finite values of two periods at least."""
    n, half = values.shape[-1], period // 2
    cycles = -(-n // period)
    left = np.zeros((*values.shape[:-1], cycles * period))
    left[..., half : n - half] = values[..., half : n - half] - _inner_mean(values, period)
    seen = np.bincount(np.arange(half, n - half) % period, minlength=period)
    phases = left.reshape(*values.shape[:-1], cycles, period).sum(axis=-2) / seen
    phases -= phases.mean(axis=-1, keepdims=True)
    return np.tile(phases, cycles)[..., :n], left[..., :n]


def _spread_of(values: np.ndarray, cut: int) -> np.ndarray:
    """Sample variance along the last axis without ``cut`` values at either end, which are nought."""
    n = values.shape[-1]
    inner = slice(cut, n - cut)
    off = np.zeros_like(values)
    off[..., inner] = values[..., inner] - values.sum(axis=-1, keepdims=True) / (n - 2 * cut)
    return (off * off).sum(axis=-1) / (n - 2 * cut - 1)


def _share_of(total: np.ndarray, rest: np.ndarray, cut: int) -> np.ndarray:
    """`_strengths` of parts whose ``cut`` values at either end are nought."""
    if total.shape[-1] - 2 * cut < 3:
        return np.zeros(total.shape[:-1])
    whole = _spread_of(total, cut)
    with np.errstate(all="ignore"):
        share = np.clip(1.0 - _spread_of(rest, cut) / whole, 0.0, 1.0)
    return np.where(whole > 0, share, 0.0)


def _season_strengths(values: np.ndarray, period: int) -> np.ndarray:
    """Strength of the season of each row of two periods at least."""
    seasonal, left = _seasoned(values, period)
    inner = slice(period // 2, values.shape[-1] - period // 2)
    rest, total = np.zeros_like(left), np.zeros_like(left)
    rest[..., inner] = left[..., inner] - seasonal[..., inner]
    total[..., inner] = seasonal[..., inner] + rest[..., inner]
    return _share_of(total, rest, period // 2)


def _trend_strengths(values: np.ndarray, period: int) -> np.ndarray:
    n = values.shape[-1]
    if period < 2 or n < 2 * period:
        if n < 4:
            return np.zeros(values.shape[:-1])
        spread = np.var(values, axis=-1, ddof=1)
        moves = np.var(np.diff(values, axis=-1), axis=-1, ddof=1)
        with np.errstate(all="ignore"):
            share = np.clip(1.0 - moves / (2.0 * spread), 0.0, 1.0)
        return np.where(spread > 0, share, 0.0)
    level = values - _seasoned(values, period)[0]
    width = max(3, period | 1)
    cut = width // 2
    inner = slice(cut, n - cut)
    smooth, rest, total = np.zeros_like(level), np.zeros_like(level), np.zeros_like(level)
    smooth[..., inner] = _inner_mean(level, width)
    rest[..., inner] = level[..., inner] - smooth[..., inner]
    total[..., inner] = smooth[..., inner] - smooth.sum(axis=-1, keepdims=True) / (n - 2 * cut) + rest[..., inner]
    return _share_of(total, rest, cut)


@lru_cache(maxsize=64)
def _orders(n: int, seed: int) -> np.ndarray:
    """The shuffles of any n values: which value stands at which place, one draw a row."""
    draw = np.random.default_rng(seed)
    return np.stack([draw.permutation(np.arange(n)) for _ in range(SURROGATE_DRAWS)])


#: Shuffled values that are looked at together.
_SHUFFLED = 1 << 17


def _floors(values: np.ndarray, seed: int, strengths: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """What the strengths of each row's shuffles reach."""
    orders = _orders(values.shape[1], seed)
    chunk = max(1, _SHUFFLED // orders.size)
    parts = [strengths(values[i : i + chunk, orders]) for i in range(0, len(values), chunk)]
    return np.quantile(np.concatenate(parts), 1.0 - SIGNIFICANCE, axis=1) * SURROGATE_MARGIN


def seasonal_floors(values: np.ndarray, period: int) -> np.ndarray:
    """The strength that noise alone reaches at a period, for each row of one length."""
    n = values.shape[1]
    if period < 2 or n < 2 * period:
        return np.ones(len(values))
    half = period // 2
    rest = values[:, half : n - half] - _inner_mean(values, period)
    if rest.shape[1] < period:
        return np.ones(len(values))
    if rest.shape[1] < 2 * period:
        return np.zeros(len(values))
    return _floors(rest, period * 7919 + n, lambda draws: _season_strengths(draws, period))


def trend_floors(values: np.ndarray, period: int) -> np.ndarray:
    n = values.shape[1]
    if n < 8:
        return np.ones(len(values))
    return _floors(values, n * 104_729, lambda draws: _trend_strengths(draws, period))


def seasonal_floor(values: np.ndarray, period: int) -> float:
    return float(seasonal_floors(values[None], period)[0])


def trend_floor(values: np.ndarray, period: int) -> float:
    return float(trend_floors(values[None], period)[0])


def shapes_of(values: np.ndarray, frequency: str) -> dict[str, np.ndarray]:
    """Season and trend of windows of one length, one a row, against their noise
    floors. All rows are shuffled alike, since draws go by length and period."""
    rows, n = values.shape
    periods = [p for p in SEASON_CANDIDATES[frequency] if n >= 2 * p + 1]
    scores, floors = np.zeros((rows, len(periods))), np.ones((rows, len(periods)))
    for place, p in enumerate(periods):
        _, left = _seasoned(values, p)
        inner = left[:, p // 2 : n - p // 2]
        m = inner.shape[1]
        if m <= p + 2:
            continue
        centred = inner - inner.mean(axis=1, keepdims=True)
        own = (centred * centred).sum(axis=1)
        with np.errstate(all="ignore"):
            acf = np.where(own > 0, (centred[:, p:] * centred[:, :-p]).sum(axis=1) / own, 0.0)
        found = np.flatnonzero(acf >= CRITICAL / np.sqrt(m))
        if len(found):
            power, floor = _season_strengths(values[found], p), seasonal_floors(values[found], p)
            scores[found, place], floors[found, place] = np.where(power > floor, power, 0.0), floor
    default = SEASON[frequency]
    period = np.full(rows, default if n >= 2 * default else 1)
    power, floor = np.zeros(rows), np.ones(rows)
    best = scores.max(axis=1, initial=0.0)
    seasonal = np.flatnonzero(best > 0)
    if len(seasonal):
        # The shortest period that comes close to the best.
        chosen = (scores[seasonal] >= best[seasonal, None] - 0.05).argmax(axis=1)
        period[seasonal], power[seasonal] = np.array(periods)[chosen], scores[seasonal, chosen]
        floor[seasonal] = np.where(power[seasonal] > 0, floors[seasonal, chosen], 1.0)
    trend, noise = np.zeros(rows), np.ones(rows)
    for p in np.unique(period):
        own = np.flatnonzero(period == p)
        trend[own], noise[own] = _trend_strengths(values[own], int(p)), trend_floors(values[own], int(p))
    return {
        "period": period,
        "seasonal_strength": power,
        "seasonal_floor": floor,
        "trend_strength": trend,
        "trend_floor": noise,
        "has_season": (period > 1) & (power > floor),
        "has_trend": trend > noise,
    }


def shape_of(values: np.ndarray, frequency: str) -> dict[str, float]:
    """Season and trend of one window of history against their noise floors."""
    return {name: held[0].item() for name, held in shapes_of(values[None], frequency).items()}


SHAPE = (
    "struct<period:int,seasonal_strength:double,seasonal_floor:double,trend_strength:double,"
    "trend_floor:double,has_season:boolean,has_trend:boolean>"
)


def shape_column(values: Column, frequency: str) -> Column:
    """The shape of each array of history, those of one length of a batch together."""

    @F.pandas_udf(SHAPE)
    def shapes(batch: pd.Series) -> pd.DataFrame:
        known = [held[np.isfinite(held)] for held in (np.asarray(held, dtype=float) for held in batch)]
        alike: dict[int, list[int]] = {}
        for i, held in enumerate(known):
            alike.setdefault(held.size, []).append(i)
        parts = [pd.DataFrame(shapes_of(np.stack([known[i] for i in places]), frequency), index=places) for places in alike.values()]
        return pd.concat(parts).sort_index()

    return shapes(values)


def history_arrays(series: DataFrame, keys: Sequence[str] = (SERIES_ID,)) -> DataFrame:
    """One row per series with its values in calendar order."""
    packed = F.array_sort(F.collect_list(F.struct("t", Y)))
    return series.groupBy(*keys).agg(F.transform(packed, lambda p: p[Y]).alias("values"))


def seasonal_profile(series: DataFrame, frequency: str, keys: Sequence[str] = (SERIES_ID,)) -> DataFrame:
    histories = spread_out(history_arrays(series, keys), keys)
    return histories.select(*keys, shape_column(F.col("values"), frequency).alias("s")).select(*keys, "s.*")


def spread_out(windows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Windows over as many tasks as a shuffle has: few bytes, much computing.

    A number given by hand keeps adaptive execution from merging the small
    partitions back together.
    """
    tasks = int(windows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return windows.repartition(tasks, *keys)


# ---- Demand and transform --------------------------------------------------
def demand_class(interval: Column, cv2: Column) -> Column:
    rare, varied = interval >= ADI_CUT, cv2 >= CV2_CUT
    return (
        F.when(interval.isNull(), "no_demand")
        .when(rare & varied, "lumpy")
        .when(rare, "intermittent")
        .when(varied, "erratic")
        .otherwise("smooth")
    )


def demand_pattern(series: DataFrame, keys: Sequence[str] = (SERIES_ID,)) -> DataFrame:
    """keys, n, interval, cv2, demand_class, zero share, variation."""
    sold = F.when(F.col(Y) > 0, F.col(Y))
    stats = series.groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.count(sold).alias("_hits"),
        F.avg(sold).alias("_mean"),
        F.stddev_samp(sold).alias("_std"),
        F.avg(near_zero(F.col(Y)).cast("double")).alias("zero_share"),
        F.bool_and(F.col(Y) > 0).alias("positive"),
        F.abs(F.try_divide(F.stddev_samp(Y), F.avg(Y))).alias("variation"),
    )
    enough = F.col("_hits") >= 2
    rated = stats.withColumn("interval", F.when(enough, F.col("n") / F.col("_hits"))).withColumn(
        "cv2", F.when(enough, F.pow(F.col("_std") / F.col("_mean"), 2.0)).otherwise(0.0)
    )
    return rated.select(
        *keys,
        "n",
        "interval",
        "cv2",
        demand_class(F.col("interval"), F.col("cv2")).alias("demand_class"),
        "zero_share",
        "positive",
        F.coalesce("variation", F.lit(0.0)).alias("variation"),
    )


#: Which models a class may reach, whether a single number means anything for
#: it, and whether its band is widened (fixed values).
BASELINES = ("naive", "seasonal_naive")
SMOOTH_MODELS = ("holt_winters", "ets", "theta", "sarimax", "prophet", "gradient_boosting")
ROUTES = {
    "smooth": ((*BASELINES, *SMOOTH_MODELS), True, False),
    "erratic": ((*BASELINES, *SMOOTH_MODELS), True, True),
    "intermittent": ((*BASELINES, "croston"), True, True),
    "lumpy": ((*BASELINES, "croston"), False, True),
    "no_demand": (BASELINES, False, True),
}


def routing(pattern: DataFrame) -> DataFrame:
    """Adds allowed models, point_meaningful, widen and the reason in words."""
    kind = F.col("demand_class")

    def pick(index: int, kind_type: str) -> Column:
        out = F.lit(None).cast(kind_type)
        for name, route in ROUTES.items():
            value = F.array(*[F.lit(m) for m in sorted(route[0])]) if index == 0 else F.lit(route[index])
            out = F.when(kind == name, value).otherwise(out)
        return out

    interval, cv2 = F.round("interval", 1), F.round("cv2", 2)
    reason = (
        F.when(kind == "lumpy", F.format_string("Demand arrives about every %.1f periods and its size varies widely (CV squared %.2f).", interval, cv2))
        .when(kind == "intermittent", F.format_string("Demand arrives about every %.1f periods.", interval))
        .when(kind == "no_demand", "Fewer than two periods hold any demand.")
        .when(kind == "erratic", F.format_string("Demand arrives regularly but its size varies widely (CV squared %.2f).", cv2))
        .otherwise("Demand arrives regularly and at a consistent size.")
    )
    return pattern.select(
        "*",
        pick(0, "array<string>").alias("allowed"),
        pick(1, "boolean").alias("point_meaningful"),
        pick(2, "boolean").alias("widen"),
        reason.alias("reason"),
    )


def box_cox_hint(series: DataFrame, period: Column, keys: Sequence[str] = (SERIES_ID,)) -> DataFrame:
    """keys, box_cox, transform: the power that evens out the spread of blocks."""
    width = F.greatest(F.lit(2), F.when(period >= 2, period).otherwise(4))
    blocks = series.groupBy(*keys, F.floor(F.col("t") / width).alias("_block")).agg(
        F.count("*").alias("_size"),
        F.avg(Y).alias("_mean"),
        F.stddev_samp(Y).alias("_std"),
        F.min(Y).alias("_low"),
    )
    usable = (F.col("_size") >= 2) & (F.col("_mean") > 0)
    ratios = {f"r{i}": F.when(usable, F.col("_std") / F.pow(F.col("_mean"), F.lit(1.0 - p))) for i, p in enumerate(BOX_COX_GRID)}
    stats = blocks.groupBy(*keys).agg(
        F.sum("_size").alias("_n"),
        F.min("_low").alias("_low"),
        F.count_if(usable).alias("_blocks"),
        *[F.when(F.avg(r) > 0, F.stddev_samp(r) / F.avg(r)).alias(name) for name, r in ratios.items()],
    )
    options = F.array(*[F.struct(F.col(f"r{i}").alias("d"), F.lit(i).alias("i"), F.lit(p).alias("p")) for i, p in enumerate(BOX_COX_GRID)])
    best = F.array_min(F.filter(options, lambda o: o["d"].isNotNull()))["p"]
    fits = (F.col("_n") >= 8) & (F.col("_low") > 0) & (F.col("_blocks") >= 2)
    hint = F.when(fits, F.coalesce(best, F.lit(1.0))).otherwise(1.0)
    return stats.select(
        *keys,
        hint.alias("box_cox"),
        F.when((F.col("_low") > 0) & (hint <= LOG_CEILING), "log").otherwise("none").alias("transform"),
    )


def level_stationary(frame: DataFrame, name: str) -> DataFrame:
    """Adds kpss and stationary for an array column of one row per series.

    The statistic is that of Kwiatkowski and others about the mean, with the
    lag length chosen from the data (Hobijn and others).
    """

    def cross(i: Column) -> Column:
        left = F.slice("_r", i + 1, F.col("_n") - i)
        right = F.slice("_r", F.lit(1), F.col("_n") - i)
        return F.aggregate(F.zip_with(left, right, lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)

    def total(array: Column, part) -> Column:
        return F.aggregate(array, F.lit(0.0), lambda a, x: a + part(x))

    staged = (
        frame.withColumn("_n", F.size(name))
        .withColumn("_mean", total(F.col(name), lambda x: x) / F.col("_n"))
        .withColumn("_r", F.transform(name, lambda x: x - F.col("_mean")))
        .withColumn("_own", total(F.col("_r"), lambda x: x * x))
        .withColumn("_reach", F.floor(F.pow(F.col("_n").cast("double"), F.lit(2 / 9))).cast("int"))
    )
    lags = F.transform(
        F.when(F.col("_reach") >= 1, F.sequence(F.lit(1), F.col("_reach"))).otherwise(F.array().cast("array<int>")),
        lambda i: F.struct(i.alias("i"), (cross(i) / (F.col("_n") / 2)).alias("c")),
    )
    staged = staged.withColumn("_lags", lags)
    s0 = F.col("_own") / F.col("_n") + total(F.col("_lags"), lambda v: v["c"])
    s1 = total(F.col("_lags"), lambda v: v["i"] * v["c"])
    ratio = s1 / s0
    third = F.lit(1 / 3)
    gamma = 1.1447 * F.pow(ratio * ratio, third)
    auto = F.floor(gamma * F.pow(F.col("_n").cast("double"), third)).cast("int")
    staged = staged.withColumn("_auto", F.when(F.col("_own") > 0, F.least(auto, F.col("_n") - 1)).otherwise(0))
    weighted = F.transform(
        F.when(F.col("_auto") >= 1, F.sequence(F.lit(1), F.col("_auto"))).otherwise(F.array().cast("array<int>")),
        lambda i: cross(i) * (1 - i / (F.col("_auto") + 1.0)),
    )
    staged = staged.withColumn("_long", (F.col("_own") + 2 * total(weighted, lambda x: x)) / F.col("_n"))
    running = F.aggregate(
        "_r",
        F.struct(F.lit(0.0).alias("c"), F.lit(0.0).alias("q")),
        lambda a, x: F.struct((a["c"] + x).alias("c"), (a["q"] + (a["c"] + x) * (a["c"] + x)).alias("q")),
        lambda a: a["q"],
    )
    kpss = F.when((F.col("_n") >= 8) & (F.col("_long") != 0), running / F.pow(F.col("_n"), F.lit(2)) / F.col("_long"))
    level = F.when((F.col("_n") < 8) | (F.col("_own") == 0), True).otherwise(F.col("kpss") < KPSS_CRITICAL)
    dropped = ("_n", "_mean", "_r", "_own", "_reach", "_lags", "_auto", "_long")
    return staged.withColumn("kpss", kpss).withColumn("stationary", level).drop(*dropped)


def difference_order(histories: DataFrame, period: Column, keys: Sequence[str] = (SERIES_ID,)) -> DataFrame:
    """keys, difference_order: how often to difference until the level holds."""

    def step(values: Column) -> Column:
        n = F.size(values)
        tail = F.slice(values, F.lit(2), F.greatest(n - 1, F.lit(0)))
        head = F.slice(values, F.lit(1), F.greatest(n - 1, F.lit(0)))
        return F.zip_with(tail, head, lambda a, b: a - b)

    once = step(F.col("values"))
    leveled = histories.select(*keys, period.alias("_period"), F.posexplode(F.array(F.col("values"), once, step(once))).alias("d", "v"))
    tested = level_stationary(leveled, "v")
    # Kept out of a filter, which would carry the whole statistic below itself.
    settled = (F.col("d") == 2) | F.col("stationary") | (F.size("v") <= F.greatest(F.lit(8), F.col("_period")))
    return tested.groupBy(*keys).agg(F.min(F.when(settled, F.col("d"))).alias("difference_order"))


def seasonal_difference(power: Column, n: Column, period: Column) -> Column:
    seasons = F.when(period > 1, n / period).otherwise(0.0)
    return F.when((seasons >= 2.5) & (power >= SEASONAL_DIFFERENCE_FLOOR), 1).otherwise(0)


def minimum_history(has_season: Column, period: Column, frequency: str) -> Column:
    return F.when(has_season, F.greatest(F.lit(8), 2 * period)).otherwise(MIN_OBSERVATIONS[frequency])


# ---- Level shifts ----------------------------------------------------------
def changepoints(series: DataFrame, keys: Sequence[str] = (SERIES_ID,)) -> DataFrame:
    """keys, index, strength, recent: where the level steps to a new plateau.

    Each split is judged by the spread within its two halves, from running
    sums; neighbouring splits are one break, named by the strongest.
    """
    return changepoints_of(history_arrays(series, keys), keys)


def changepoints_of(histories: DataFrame, keys: Sequence[str] = (SERIES_ID,)) -> DataFrame:
    """`changepoints` of one row per series with its ``values``."""

    def made(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        offsets, values, _ = arrays.flat(arrays.column(batch, "values"))
        found = [np.empty((0, 4))]
        for rows, places in arrays.by_length(offsets):
            n = places.shape[1]
            w = max(4, n // 6)
            if n < CHANGEPOINT_HISTORY or n - w <= w:
                continue
            y = values[places]
            sums, squares, t = np.cumsum(y, axis=1), np.cumsum(y * y, axis=1), np.arange(w, n - w + 1)
            left, left_squares, right = sums[:, t - 1], squares[:, t - 1], n - t
            left_mean, right_mean = left / t, (sums[:, -1:] - left) / right
            left_var = np.maximum(left_squares / t - left_mean * left_mean, 0.0)
            right_var = np.maximum((squares[:, -1:] - left_squares) / right - right_mean * right_mean, 0.0)
            within, apart = np.sqrt((left_var * t + right_var * right) / n), np.abs(left_mean - right_mean)
            with np.errstate(all="ignore"):
                strength = np.where(within > 0, apart / within, np.where(apart != 0, np.inf, 0.0))
            at, place = np.nonzero(strength > CHANGEPOINT_SIGMAS)
            index = t[place]
            opens = np.append(True, (at[1:] != at[:-1]) | (np.diff(index) >= w))[: len(at)]
            cluster, power = np.cumsum(opens), strength[at, place]
            order = np.lexsort((index, -power, cluster))
            best = order[np.append(True, np.diff(cluster[order]) > 0)[: len(at)]]
            recent = index[best] >= n * (1 - RECENT_CHANGEPOINT_SHARE)
            found.append(np.stack((rows[at[best]], index[best], power[best], recent), axis=1))
        all_found = np.concatenate(found)
        all_found = all_found[np.argsort(all_found[:, 0], kind="stable")]
        places = np.searchsorted(all_found[:, 0], np.arange(batch.num_rows + 1))
        breaks = pa.StructArray.from_arrays(
            [pa.array(all_found[:, 1].astype(np.int32)), pa.array(all_found[:, 2]), pa.array(all_found[:, 3] > 0)], names=["index", "strength", "recent"]
        )
        return {"_breaks": pa.ListArray.from_arrays(pa.array(places, pa.int32()), breaks)}

    rated = arrays.add_columns(histories.select(*keys, "values"), made, "_breaks array<struct<index:int,strength:double,recent:boolean>>", ("values",))
    return rated.select(*keys, F.inline("_breaks"))


def jump_share(series: DataFrame, keys: Sequence[str] = (SERIES_ID,)) -> DataFrame:
    """keys, outlier_share: steps beyond 3.5 robust deviations."""
    return jump_share_of(history_arrays(series, keys), keys)


def jump_share_of(histories: DataFrame, keys: Sequence[str] = (SERIES_ID,)) -> DataFrame:
    """`jump_share` of one row per series with its ``values``."""

    def made(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        offsets, values, _ = arrays.flat(arrays.column(batch, "values"))
        share = np.zeros(batch.num_rows)
        for rows, places in arrays.by_length(offsets):
            if places.shape[1] < 5:
                continue
            moves = arrays.steps(values[places])
            off = np.abs(moves - arrays.median(moves)[:, None])
            middle, average = 1.4826 * arrays.median(off), arrays.mean(off)
            scale = np.where(middle > 0, middle, np.where(average > 0, average, np.nan))[:, None]
            share[rows] = (off / scale > 3.5).sum(axis=1) / moves.shape[1]
        return {"outlier_share": pa.array(share)}

    return arrays.add_columns(histories.select(*keys, "values"), made, "outlier_share double", ("values",))


def profile_series(panel: DataFrame, frequency: str, keys: Sequence[str] = (SERIES_ID,)) -> DataFrame:
    """One row per series with everything above."""
    keys = list(keys)
    series = compacted(panel, keys)
    # Shuffled draws feed several branches below: made once and written.
    shape = cut_lineage(seasonal_profile(series, frequency, keys), "shape")
    pattern = demand_pattern(series, keys)
    with_period = series.join(shape.select(*keys, "period"), keys)
    hint = box_cox_hint(with_period, F.col("period"), [*keys, "period"]).drop("period")
    histories = history_arrays(with_period, [*keys, "period"])
    order = difference_order(histories, F.col("period"), keys)
    joined = pattern.join(shape, keys).join(hint, keys).join(order, keys).join(jump_share(series, keys), keys)
    steady = ~F.col("demand_class").isin("intermittent", "lumpy")
    return joined.withColumn("box_cox", F.when(steady, F.col("box_cox")).otherwise(1.0)).withColumn(
        "transform", F.when(steady, F.col("transform")).otherwise("none")
    ).withColumn(
        "seasonal_difference_order", seasonal_difference(F.col("seasonal_strength"), F.col("n"), F.col("period"))
    ).withColumn("minimum_history", minimum_history(F.col("has_season"), F.col("period"), frequency))
