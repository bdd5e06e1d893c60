"""Scalar arithmetic of levels, budgets and timeouts. NULL means not measured and stays NULL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FULL_SCALE = 32767.0


def decibels(amplitude: Column) -> Column:
    """Level of an amplitude below full scale, two decimals; NULL for none."""
    return F.when(amplitude > 0, F.bround(F.log10(amplitude / FULL_SCALE) * 20, 2))


def frame_decibels(rms: Column) -> Column:
    """Unrounded level with a floor of -180."""
    return F.log10(F.greatest(rms / FULL_SCALE, F.lit(1e-9))) * 20


def pcm_seconds(n_bytes: Column, rate: Column | int, channels: int = 1, width: int = 2) -> Column:
    return n_bytes / (F.lit(rate) if isinstance(rate, int) else rate) / (channels * width)


def realtime_factor(duration: Column, seconds: Column) -> Column:
    return F.when((duration != 0) & (seconds != 0), F.bround(duration / seconds, 2))


def request_timeout(configured: Column, prompt_tokens: Column, output_tokens: Column) -> Column:
    return F.least(F.lit(1800.0), F.greatest(configured, F.lit(45.0), 15 + prompt_tokens / 250 + output_tokens / 12))


def speech_timeout(duration: Column, floor: float, most: float) -> Column:
    return F.coalesce(F.least(F.lit(most), F.greatest(F.lit(floor), 90 + duration * 0.25)), F.lit(floor))


def note_cap(total_words: Column) -> Column:
    return F.least(F.lit(50), F.greatest(F.lit(25), F.floor(total_words / 150))).cast("int")


def audit_budget(context: Column, prompt_tokens: Column, cap: Column) -> Column:
    """Struct (budget, ask, skip) of an audit request."""
    budget = F.greatest(F.lit(256), (context * F.lit(0.92)).cast("int"))
    ask = F.least(F.greatest(F.lit(8192), cap * 300), F.greatest(F.lit(1024), budget - prompt_tokens))
    return F.struct(budget.alias("budget"), ask.alias("ask"), (prompt_tokens + ask > budget).alias("skip"))


def ram_shortfall_mib(weights_mib: Column, context: Column, available_mib: Column) -> Column:
    """Missing memory; NULL if it fits or nothing is known."""
    short = weights_mib + context * 32 / 1024 + 1500 - available_mib
    return F.when(short > 0, short)


def knee_reduction(over: Column, ratio: float = 4.0, knee: float = 6.0) -> Column:
    """Reduction in dB of a soft-knee compressor for a level over its threshold."""
    slope = 1 - 1 / ratio
    return (
        F.when(over <= -knee / 2, F.lit(0.0))
        .when(over >= knee / 2, over * slope)
        .otherwise(F.pow(over + knee / 2, F.lit(2.0)) * slope / (2 * knee))
    )


def to_int16(x: Column) -> Column:
    return F.least(F.lit(32767.0), F.greatest(F.lit(-32768.0), F.bround(x, 0))).cast("int")


def peak_normalised(samples: Column, target: float = 0.95) -> Column:
    """Samples scaled to the target peak where theirs is above zero and below it."""
    peak = F.array_max(F.transform(samples, F.abs))
    gain = F.when((peak > 0) & (peak < target), F.lit(target) / peak).otherwise(F.lit(1.0))
    return F.transform(samples, lambda x: x * gain)


def quiet_warning(peak: Column, measured: Column) -> Column:
    """NULL if unmeasured or loud enough."""
    level = decibels(peak)
    return F.when(
        measured,
        F.when(level.isNull(), F.lit("no signal")).when(level <= -35.0, F.concat(F.lit("quiet recording: peak "), level, F.lit(" dBFS"))),
    )
