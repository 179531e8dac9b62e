"""Column functions: names, quality rules, number formats and per-frame array arithmetic."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from vocalgrid import fixed


# Names ------------------------------------------------------------------------------------------


def subject_of(utterance: Column) -> Column:
    """The part of an utterance name before the first underscore."""
    return F.substring_index(utterance, "_", 1)


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def file_stem(path: Column) -> Column:
    """File name without its last extension; a leading dot is part of the stem."""
    return F.regexp_replace(file_name(path), r"^(.+)\.[^.]*$", "$1")


def utterance_name(path: Column) -> Column:
    """Utterance named by a feature or parameter file; null for other files."""
    found = [F.nullif(F.regexp_extract(path, p, 1), F.lit("")) for p in fixed.UTTERANCE_FILE_PATTERNS]
    return F.coalesce(*found)


# Quality rules ----------------------------------------------------------------------------------


def fps_fallback(metadata: Column) -> Column:
    """Frame rate from a JSON text: ``fps``, else ``frame_rate``, else the default."""
    parsed = F.from_json(metadata, "fps STRING, frame_rate STRING")
    return F.coalesce(
        parsed["fps"].try_cast("double"), parsed["frame_rate"].try_cast("double"), F.lit(fixed.DEFAULT_FPS)
    )


def quality_tier(correlation: Column) -> Column:
    """The first tier whose bound is met; NaN meets none (Spark orders it above all numbers, so it is told apart)."""
    rule = F.when(F.isnan(correlation.cast("double")), fixed.LOWEST_TIER)
    for name, bound in fixed.QUALITY_TIERS:
        rule = rule.when(correlation >= bound, name)
    return rule.otherwise(fixed.LOWEST_TIER)


def half_duration(n_frames: Column) -> Column:
    return n_frames / F.lit(fixed.DEFAULT_FPS) * 0.5


def _not_a_number(*values: Column) -> Column:
    found = F.lit(False)
    for value in values:
        found = found | F.coalesce(F.isnan(value.cast("double")), F.lit(False))
    return found


def alignment_is_valid(correlation: Column, offset: Column, n_frames: Column, minimum: float) -> Column:
    """NaN in either value is never valid."""
    return ~_not_a_number(correlation, offset) & ~(correlation < minimum) & ~(F.abs(offset) > half_duration(n_frames))


def alignment_message(correlation: Column, offset: Column, n_frames: Column, minimum: float) -> Column:
    """The first failing check decides the message."""
    half = half_duration(n_frames)
    low = F.concat(F.lit("Low correlation: "), fixed_point(correlation, 3), F.lit(f" < {minimum}"))
    far = F.concat(
        F.lit("Large offset: "), fixed_point(F.abs(offset), 2), F.lit("s (>"), fixed_point(half, 2), F.lit("s)")
    )
    good = F.concat(F.lit("Valid alignment: correlation="), fixed_point(correlation, 3))
    return F.when(_not_a_number(correlation, offset), F.lit("Not finite")).when(correlation < minimum, low).when(F.abs(offset) > half, far).otherwise(good)


def duration_matches(n_frames: Column, fps: Column, n_samples: Column, rate: Column) -> Column:
    return F.abs(n_frames / fps - n_samples / rate) < 1.0


def is_infinite(value: Column) -> Column:
    return F.abs(value) == F.lit(float("inf"))


# Number formats ---------------------------------------------------------------------------------


def fixed_point(value: Column, digits: int) -> Column:
    """Text with ``digits`` decimals, rounded on the exact binary value, exact ties to even.

    The JVM formatter rounds the shortest decimal form instead, which differs on ties. The product
    with twice the scale is split into its rounded value and its exact remainder to decide them.
    """
    scale = 10**digits
    double = value.cast("double")
    a, b = F.abs(double), F.lit(float(2 * scale))
    product = a * b
    big = a * F.lit(134217729.0)
    head = big - (big - a)
    rest = (head * b - product) + (a - head) * b
    odd = product.cast("long")
    is_tie = (product == F.floor(product)) & (odd % 2 == 1)
    lower = F.floor(odd / 2).cast("long")
    up = (rest > 0) | ((rest == 0) & (lower % 2 == 1))
    units = F.when(is_tie, lower + up.cast("long")).otherwise(F.floor((product + 1) / 2).cast("long"))
    whole = F.floor(units / scale).cast("long").cast("string")
    part = F.lpad((units % scale).cast("string"), digits, "0")
    sign = F.when(double < 0, F.lit("-")).otherwise(F.lit(""))
    number = F.concat(sign, whole, F.lit("."), part)
    infinite = F.when(double > 0, F.lit("inf")).otherwise(F.lit("-inf"))
    return F.when(F.isnan(double), F.lit("nan")).when(a == F.lit(float("inf")), infinite).otherwise(number)


def human_count(count: Column) -> Column:
    """1.23M, 5.43K or the plain number."""
    return (
        F.when(count >= 1_000_000, F.concat(fixed_point(count / 1_000_000, 2), F.lit("M")))
        .when(count >= 1_000, F.concat(fixed_point(count / 1_000, 2), F.lit("K")))
        .otherwise(count.cast("string"))
    )


def r6(value: Column) -> Column:
    """Six decimals, no negative zero: the precision results are compared at."""
    return F.round(value.cast("double"), 6) + F.lit(0.0)


# Seeded draws -----------------------------------------------------------------------------------


def draw_text(seed: int, *parts: Column) -> Column:
    """md5 of the seed and the parts: an order that any engine and any rerun agrees on."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[p.cast("string") for p in parts]))


def draw(seed: int, *parts: Column) -> Column:
    """A number in [0, 1) from the first 32 bits of the md5."""
    return F.conv(F.substring(draw_text(seed, *parts), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


# Frames as flat row-major arrays ----------------------------------------------------------------


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value computed once, however often a lambda in the body uses it.

    Bodies must use bound values only: a Python kernel's result that the optimizer moves into a
    lambda could no longer be taken out for the Python workers.
    """
    return F.transform(F.array(value), body)[0]


def array_sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, v: s + v)


def count_value(values: Column, value: int) -> Column:
    """How often a value occurs: by native array removal, so no lambda and no explode."""
    return F.size(values) - F.size(F.array_remove(values, value))


def normalize_array(pixels: Column, low: float = 0.0, high: float = 1.0) -> Column:
    """Min-max scaling to [low, high]; a constant frame becomes the midpoint."""


    def scale(b: Column) -> Column:
        span = b["most"] - b["least"]
        scaled = F.transform(b["px"], lambda v: (v - b["least"]) / span * F.lit(high - low) + F.lit(low))
        return F.when(span == 0, F.transform(b["px"], lambda v: F.lit((low + high) / 2))).otherwise(scaled)

    ends = F.struct(pixels.alias("px"), F.array_min(pixels).alias("least"), F.array_max(pixels).alias("most"))
    return bind(ends, scale)


def frame_zscore(pixels: Column) -> Column:
    """(v - mean) / (population std + 1e-8) inside one frame."""
    n = F.size(pixels)
    moments = F.aggregate(
        pixels,
        F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("q")),
        lambda m, v: F.struct((m["s"] + v).alias("s"), (m["q"] + v * v).alias("q")),
        lambda m: F.struct(
            (m["s"] / n).alias("mean"),
            F.sqrt(F.greatest(m["q"] / n - (m["s"] / n) * (m["s"] / n), F.lit(0.0))).alias("std"),
        ),
    )
    held = F.struct(pixels.alias("px"), moments.alias("m"))
    eps = F.lit(fixed.SCALE_EPSILON)
    return bind(held, lambda h: F.transform(h["px"], lambda v: (v - h["m"]["mean"]) / (h["m"]["std"] + eps)))


def pad_frame(pixels: Column, height: int, width: int, target: int, fill: float = 0.0) -> Column:
    """Centred zero padding to target x target; an odd rest goes to the far side."""
    top, left = (target - height) // 2, (target - width) // 2
    blank = F.array_repeat(F.lit(fill), target)
    side = F.array_repeat(F.lit(fill), left)
    other = F.array_repeat(F.lit(fill), target - width - left)
    rows = bind(
        pixels,
        lambda px: F.transform(
            F.sequence(F.lit(0), F.lit(height - 1)),
            lambda y: F.concat(side, F.slice(px, y * width + 1, width), other),
        ),
    )
    above = F.array_repeat(blank, top)
    below = F.array_repeat(blank, target - height - top)
    return F.flatten(F.concat(above, rows, below))


def crop(pixels: Column, width: int, y1: int, y2: int, x1: int, x2: int) -> Column:
    """Rows y1..y2-1 and columns x1..x2-1 of a frame."""
    lines = F.sequence(F.lit(y1), F.lit(y2 - 1))
    rows = bind(
        pixels, lambda px: F.transform(lines, lambda y: F.slice(px, y * width + F.lit(x1 + 1), x2 - x1))
    )
    return F.flatten(rows)


def unpad_frame(pixels: Column, size: int, original: int) -> Column:
    """Centre crop of a size x size frame."""
    start = (size - original) // 2
    return crop(pixels, size, start, start + original, start, start + original)


def clip01(value: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), value))


def digitize(value: Column, thresholds: Sequence[float]) -> Column:
    """Class = number of thresholds not above the value."""
    total = F.lit(0)
    for t in thresholds:
        total = total + (value >= F.lit(float(t))).cast("int")
    return total


def digitize_frame(pixels: Column, thresholds: Sequence[float]) -> Column:
    return F.transform(pixels, lambda v: digitize(v, thresholds))


def digitize_by(value: Column, thresholds: Column) -> Column:
    """The same with an array column of thresholds."""
    return F.size(F.filter(thresholds, lambda t: t <= value))


def flip_frame(pixels: Column, height: int, width: int) -> Column:
    """Mirror every row."""
    lines = F.sequence(F.lit(0), F.lit(height - 1))
    rows = bind(pixels, lambda px: F.transform(lines, lambda y: F.reverse(F.slice(px, y * width + 1, width))))
    return F.flatten(rows)


def adjust_brightness(pixels: Column, factor: Column) -> Column:
    held = F.struct(pixels.alias("px"), factor.alias("f"))
    return bind(held, lambda h: F.transform(h["px"], lambda v: clip01(v * h["f"])))


def adjust_contrast(pixels: Column, factor: Column) -> Column:
    mean = array_sum(pixels) / F.size(pixels)
    held = F.struct(pixels.alias("px"), mean.alias("m"), factor.alias("f"))
    return bind(held, lambda h: F.transform(h["px"], lambda v: clip01((v - h["m"]) * h["f"] + h["m"])))
