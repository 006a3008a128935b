"""Column functions of the signal domain."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..operators.dedisperse import INJECTION_CONSTANT, SEARCH_CONSTANT

BAND_MHZ = 500.0
#: Repeat weight of training samples by the pattern of their source file (fixed values): new positives, negatives, the rest.
REPEATS = (("new.*LPT", 6), ("(?i)neg|rfi", 2))


def effective_channels(bandwidth_mhz: Column, nchan: Column) -> Column:
    """Channels inside a bandwidth, at least 1."""
    return F.greatest(F.lit(1.0), bandwidth_mhz / (F.lit(BAND_MHZ) / nchan))


def per_channel_snr(snr: Column, bandwidth_mhz: Column, nchan: Column) -> Column:
    return snr / F.sqrt(effective_channels(bandwidth_mhz, nchan))


def start_mjd(day: Column, seconds: Column, offset: Column) -> Column:
    return day + (seconds + offset) / 86400.0


def mjd_to_timestamp(mjd: Column) -> Column:
    return F.timestamp_micros(F.round((mjd - 40587) * 86400e6).cast("long"))


def timestamp_to_mjd(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp")) / 86400e6 + 40587


def search_delay(dm: Column, freq: Column, reference: Column) -> Column:
    """Seconds a frequency (MHz) lags the reference, by the search's constant."""
    return F.lit(SEARCH_CONSTANT) * dm * (1 / (freq * freq) - 1 / (reference * reference))


def injection_delay(dm: Column, freq: Column, reference: Column) -> Column:
    """As ``search_delay`` by the injection's constant."""
    return F.lit(INJECTION_CONSTANT) * dm * (1 / (freq * freq) - 1 / (reference * reference))


def span_files(delay_samples: Column, file_length: int) -> Column:
    """Files that a delay reaches over: the delay is cut to whole samples first."""
    return F.ceil(delay_samples.cast("int") / file_length)


def scene_length(dm_max: Column, low_mhz: float, high_mhz: float, dt_s: float, output: int, guard: int) -> Column:
    """Samples to read for a scene of ``output`` samples: with the largest dispersion shift, rounded up, and a guard."""
    shift = F.ceil(F.lit(SEARCH_CONSTANT) * dm_max * (1 / (low_mhz * low_mhz) - 1 / (high_mhz * high_mhz)) / dt_s)
    return F.lit(output) + shift + guard


def decoded(data: Column) -> Column:
    """Text of bytes; what is not UTF-8 (and U+FFFD itself) is left out."""
    return F.replace(F.make_valid_utf8(data.cast("string")), F.lit("\ufffd"), F.lit(""))


def file_token(source: Column, quant: Column, number: Column, threshold: Column) -> Column:
    """Name of a result file: source, quantization, number of four digits and threshold."""
    return F.concat_ws("_", source, quant, F.lpad(number.cast("string"), 4, "0"), F.concat(F.lit("ge"), slug(threshold)))


def first_set(*values: Column) -> Column:
    """The first value that is neither null nor zero."""
    return F.coalesce(*[F.nullif(v, F.lit(0)) if i < len(values) - 1 else v for i, v in enumerate(values)])


def source_tolerance(strict: Column, source: Column) -> Column:
    return F.greatest(strict, F.coalesce(source, strict))


def sigma_threshold(threshold: Column) -> Column:
    """A threshold in hundredths, rounded up unless it is one already."""
    return F.ceil(threshold * 100 - 1e-9).cast("int")


def in_crop(value: Column, start: Column, span: Column, size: int = 512) -> Column:
    """Place of a value in a crop of ``size`` pixels; null outside."""
    at = (value - start) / span * size
    return F.when((at >= 0) & (at < size), at)


def crop_start(value: Column, wanted_pixel: Column, span: Column, total: int, size: int = 512) -> Column:
    """Start of a crop that shows a value at the wanted pixel, kept inside the data; rounded half to even."""
    return F.least(F.greatest(F.bround(value - wanted_pixel / size * span).cast("int"), F.lit(0)), F.lit(total) - span)


def valid_box(w: Column, h: Column, left: Column, top: Column) -> Column:
    """Finite and at least one pixel each way; a negative corner is legal."""
    finite = [~F.isnan(c) & (F.abs(c) < float("inf")) for c in (left, top, w, h)]
    return finite[0] & finite[1] & finite[2] & finite[3] & (w >= 1) & (h >= 1)


def slug(threshold: Column) -> Column:
    """A number as part of a file name: the shortest form with p for the point."""
    return F.regexp_replace(F.regexp_replace(threshold.cast("string"), r"\.0$", ""), r"\.", "p")


def repeat_weight(path: Column) -> Column:
    """How often a training sample counts, by the name of its source."""
    out = F.lit(1)
    for pattern, n in reversed(REPEATS):
        out = F.when(path.rlike(pattern), F.lit(n)).otherwise(out)
    return out


def softmax_true(false_logit: Column, true_logit: Column) -> Column:
    return F.exp(true_logit) / (F.exp(false_logit) + F.exp(true_logit))


def batches(spec: str) -> list[int]:
    """Batch numbers of a text such as ``0-3,7``, sorted, without repeats."""
    found: set[int] = set()
    for part in spec.split(","):
        lo, _, hi = part.strip().partition("-")
        if lo:
            found |= set(range(int(lo), int(hi or lo) + 1))
    return sorted(found)
