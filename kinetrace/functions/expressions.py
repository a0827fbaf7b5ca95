"""Scalar expressions of the episode model: time, names, gaps, sampling indices."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CHUNK_SIZE = 1000


def _c(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def unix_seconds(t_ns: str | Column) -> Column:
    """Nanoseconds since the epoch as seconds: a long to a double, then a division, as IEEE rounds both."""
    return _c(t_ns).cast("double") / F.lit(1e9)


def frame_time_ns(path: str | Column) -> Column:
    """The timestamp that a frame's file name is; null where it is not a number."""
    digits = F.regexp_extract(_c(path), r"([0-9]+)\.[^./]*$", 1)
    return F.when(digits != "", digits.cast("bigint"))


def file_name(path: str | Column) -> Column:
    return F.element_at(F.split(_c(path), "/"), -1)


def chunk_name(episode: str | Column) -> Column:
    return F.format_string("chunk-%03d", F.floor(_c(episode) / CHUNK_SIZE))


def image_feature(camera: str | Column) -> Column:
    return F.concat(F.lit("observation.images."), _c(camera))


def joint_label(component: str | Column | None, joint: str | Column) -> Column:
    """``component_joint.pos``, or ``joint.pos`` where there is no component."""
    joint = F.concat(_c(joint), F.lit(".pos"))
    return joint if component is None else F.concat_ws("_", _c(component), joint)


def entity_path(episode: str | Column, *parts: str | Column) -> Column:
    return F.concat_ws("/", F.concat(F.lit("ep"), _c(episode).cast("string")), *map(_c, parts))


def camera_name(name: str | Column) -> Column:
    """The present name of a wrist camera that older recordings name the other way round."""
    name = _c(name)
    return F.when(name == "left_wrist", "wrist_left").when(name == "right_wrist", "wrist_right").otherwise(name)


def file_place(sequence: str | Column) -> tuple[Column, Column]:
    """(chunk, file) of the n-th file: a chunk ends with its file 999."""
    return F.floor(_c(sequence) / CHUNK_SIZE), _c(sequence) % CHUNK_SIZE


def concat_float32(*arrays: str | Column) -> Column:
    return F.concat(*map(_c, arrays)).cast("array<float>")


def missing(x: str | Column) -> Column:
    """Null or NaN."""
    x = _c(x)
    return x.isNull() | F.isnan(x)


def has_gap(vector: str | Column) -> Column:
    """Whether a vector is null or empty or holds a null or NaN."""
    v = _c(vector)
    return v.isNull() | (F.size(v) == 0) | F.coalesce(F.exists(v, lambda x: x.isNull() | F.isnan(x)), F.lit(True))


def nan_to_null(x: str | Column) -> Column:
    x = _c(x)
    return F.when(~F.isnan(x), x)


def filled(before: Column, value: Column, after: Column) -> Column:
    """The value, or where it is missing the mean of both neighbours; null where one of those is missing too."""
    value, before, after = nan_to_null(value), nan_to_null(before), nan_to_null(after)
    return F.coalesce(value, (before.cast("double") + after.cast("double")) / 2)


def filled_vector(before: Column, vector: Column, after: Column, width: int, kind: str = "float") -> Column:
    """``filled`` element by element; a null vector counts as ``width`` missing elements. Keeps the element type."""
    none = F.array_repeat(F.lit(None).cast(kind), width)
    before, after = F.coalesce(before, none), F.coalesce(after, none)
    return F.transform(F.coalesce(vector, none), lambda x, i: filled(F.get(before, i), x, F.get(after, i)).cast(kind))


def missing_count(vector: Column, width: int) -> Column:
    return F.when(vector.isNull(), F.lit(width)).otherwise(F.size(F.filter(vector, lambda x: x.isNull() | F.isnan(x))))


def image_sample_size(n: str | Column, least: int = 100, most: int = 10_000, power: float = 0.75) -> Column:
    """Frames of an episode that image statistics look at."""
    n = _c(n)
    return F.when(n < least, n).otherwise(F.greatest(F.lit(least), F.least(F.floor(F.pow(n.cast("double"), F.lit(power))), F.lit(most)))).cast("bigint")


def even_index(i: str | Column, n: str | Column, k: str | Column) -> Column:
    """The i-th of k frames evenly spread over n, halves to the even one."""
    i, n, k = map(_c, (i, n, k))
    return F.when(k <= 1, F.lit(0)).otherwise(F.bround(i * ((n - 1) / F.greatest(k - 1, F.lit(1))))).cast("bigint")


def train_end(episodes: str | Column, share: float) -> Column:
    return F.bround(_c(episodes) * F.lit(share)).cast("bigint")
