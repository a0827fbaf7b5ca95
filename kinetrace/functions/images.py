"""Statistics of JPEG frames; decoding is the JVM's, which hands bytes over in the order blue, green, red."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.stats import image_moments
from .expressions import even_index, image_sample_size

#: Images of at least LARGE pixels on the long side are thinned to about SMALL.
LARGE, SMALL = 300, 150
DECODED = "path string, height int, width int, channels int, data binary"


def decoded(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """(path, height, width, channels, data) of image files."""
    df = spark.read.format("image").option("recursiveFileLookup", True).load(paths)
    return df.select(F.col("image.origin").alias("path"), "image.height", "image.width", F.col("image.nChannels").alias("channels"), "image.data")


def decoded_bytes(spark: SparkSession, data: bytes) -> np.ndarray:
    """The pixels of one image in memory."""
    schema = getattr(getattr(spark._jvm.org.apache.spark.ml.image, "ImageSchema$"), "MODULE$")
    found = schema.decode("", data)
    if found.isEmpty():
        raise ValueError("not an image that the JVM decodes")
    row = found.get().getStruct(0)
    return pixels(bytes(row.get(5)), row.getInt(1), row.getInt(2), row.getInt(3))


def pixels(data: bytes, height: int, width: int, channels: int) -> np.ndarray:
    """Height x width x 3 in the order red, green, blue; grey is repeated."""
    a = np.frombuffer(data, np.uint8).reshape(height, width, channels)
    return np.repeat(a, 3, 2) if channels == 1 else a[:, :, 2::-1]


def chosen_frames(frames: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The frames that statistics look at: evenly spread, before any is decoded."""
    w = W.partitionBy(*keys).orderBy(order)
    ranked = frames.withColumns({"i": (F.row_number().over(w) - 1).cast("bigint"), "n": F.count(F.lit(1)).over(W.partitionBy(*keys))})
    ranked = ranked.withColumn("take", image_sample_size("n"))
    j = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("take") - 1))
    wanted = ranked.where("i = 0").select(*keys, "n", "take", j.alias("j"))
    wanted = wanted.select(*keys, even_index("j", "n", "take").alias("i"))
    return ranked.join(wanted, [*keys, "i"]).drop("i", "n", "take")


def partial_moments(images: DataFrame, keys: list[str]) -> DataFrame:
    """Rows (keys, channel, n, min, max, sum, sumsq) of decoded images; three an image leave the worker."""

    def run(batches):
        for b in batches:
            col = {c: b.column(b.schema.get_field_index(c)).to_pylist() for c in ("height", "width", "channels", "data")}
            rows, at = [], []
            for i, (h, w, c, d) in enumerate(zip(col["height"], col["width"], col["channels"], col["data"])):
                p = pixels(d, h, w, c)
                step = max(1, int(max(h, w) / SMALL)) if max(h, w) >= LARGE else 1
                p = p[::step, ::step].astype(np.int64)
                for k in range(3):
                    x = p[:, :, k]
                    rows.append((k, x.size, int(x.min()), int(x.max()), int(x.sum()), int((x * x).sum())))
                    at.append(i)
            if rows:
                own = [b.column(b.schema.get_field_index(k)).take(pa.array(at)) for k in keys]
                yield pa.RecordBatch.from_arrays([*own, *(pa.array(x, pa.int64()) for x in zip(*rows))], [*keys, "channel", "n", "min", "max", "sum", "sumsq"])

    kinds = dict(images.dtypes)
    schema = "".join(f"`{k}` {kinds[k]}, " for k in keys) + "channel bigint, n bigint, min bigint, max bigint, sum bigint, sumsq bigint"
    return images.mapInArrow(run, schema)


def describe(images: DataFrame, keys: list[str]) -> DataFrame:
    """min, max, mean and std in 0..1 for each key and channel."""
    return image_moments(partial_moments(images, keys), *keys, "channel")
