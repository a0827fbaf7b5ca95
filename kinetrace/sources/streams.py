"""Scans of a dataset folder: joint readings of all layouts in one plan, and camera frames in folders or tars."""

from __future__ import annotations

import os
import tarfile
from dataclasses import dataclass
from uuid import uuid4

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expressions import file_name, frame_time_ns
from .metadata import Metadata

STATE = ("qpos", "qvel", "qtorque")
#: Schemes that pyarrow opens, and what it calls them.
SCHEMES = {"file": "file", "hdfs": "hdfs", "s3": "s3", "s3a": "s3", "s3n": "s3", "gs": "gs"}
READINGS = "episode_pos int, episode_id string, category string, key string, key_pos int, row_pos bigint, t_ns bigint, values array<float>, path string"
FRAMES = "episode_pos int, episode_id string, camera string, name string, t_ns bigint, path string, container string, offset bigint, size bigint"
#: Episodes whose folders are named one by one to the scan; with more, the scan lists all and filters.
MAX_PATHS = 1000


@dataclass(frozen=True)
class Stream:
    """A logical stream of every episode: where its file lies below the episode, and which column it is."""

    category: str
    key: str
    embodiment: str
    component: str | None
    attribute: str
    path: str
    state: bool

    @property
    def parts(self) -> tuple[str, ...]:
        return tuple(x for x in (self.embodiment, self.component, self.attribute) if x)


def catalogue(meta: Metadata, category: str, has_state=lambda category, embodiment, component: False) -> list[Stream]:
    """The streams of one category, in order; ``has_state`` tells whether a component keeps a state file."""
    out = []
    for name, e in meta.embodiments.items():
        base = category if meta.version is None else f"{category}/{name}"
        for component in e.components or (None,):
            folder = base if component is None else f"{base}/{component}_arm" if meta.version is None else f"{base}/{component}"
            state = component is not None and has_state(category, name, component)
            for attribute in STATE if state else e.attributes:
                key = "/".join(x for x in (name, component, attribute) if x)
                out.append(Stream(category, key, name, component, attribute, f"{folder}/{'state' if state else attribute}.parquet", state))
    return out


def _episodes(spark: SparkSession, meta: Metadata, chosen: list[int] | None) -> DataFrame:
    rows = [(i, str(e["id"])) for i, e in enumerate(meta.episodes) if chosen is None or i in set(chosen)]
    return spark.createDataFrame(rows, "episode_pos int, episode_id string")


def _folders(root: str, meta: Metadata, chosen: list[int] | None) -> list[str]:
    if chosen is not None and len(chosen) <= MAX_PATHS:
        return [f"{root}/episodes/{meta.episodes[i]['id']}" for i in chosen]
    return [f"{root}/episodes"]


def listing(spark: SparkSession, folders: list[str], pattern: str) -> DataFrame:
    """(path, size) of the files below; the content is never read."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(folders)
    return df.select("path", F.col("length").alias("size"))


def below(path, root: str):
    """The path's part behind ``episodes/``, whatever scheme the root was given with."""
    return F.regexp_extract(path, r"^.*?/episodes/(.*)$", 1) if "/episodes/" not in root else F.element_at(F.split(path, root.rstrip("/").rsplit("/", 1)[-1] + "/episodes/"), -1)


def opened(path: str):
    """A file of any store that pyarrow knows, open for ranged reads on whichever machine."""
    from pyarrow import fs

    scheme, colon, rest = path.partition(":")
    if not colon or scheme == "file":
        return fs.LocalFileSystem().open_input_file("/" + (rest if colon else path).lstrip("/"))
    store, place = fs.FileSystem.from_uri(f"{SCHEMES.get(scheme, scheme)}:{rest}")
    return store.open_input_file(place)


def _spark_time(t: pa.DataType | None) -> str:
    """The type by which Spark reads a file's times: numbers where it can't tell nanoseconds."""
    if t is None or not pa.types.is_timestamp(t) or t.unit == "ns":
        return "bigint"
    return "timestamp" if t.tz else "timestamp_ntz"


def _footers(batches):
    """(path, time, element): the types of a file's times and of its values' elements, by its footer."""
    import pyarrow.parquet as pq

    for b in batches:
        times, elements = [], []
        for path in b.column(0).to_pylist():
            with opened(path) as f:
                schema = pq.read_schema(f)
            times.append(_spark_time(schema.field("timestamp").type if "timestamp" in schema.names else None))
            elements.append("double" if any(pa.types.is_list(t) and pa.types.is_float64(t.value_type) for t in schema.types) else "float")
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(times, pa.string()), pa.array(elements, pa.string())], ["path", "time", "element"])


def _scan(spark: SparkSession, files: DataFrame, one: str, folders: list[str]) -> DataFrame:
    """(t_ns, value columns, path, row_pos) of sensor files whose times and values may differ in type.

    Files of one kind are one scan; usually all are, and then the folders are scanned and no file is named.
    """
    if one.partition(":")[0] in SCHEMES:
        kinds = files.select("path").repartition(spark.sparkContext.defaultParallelism).mapInArrow(_footers, "path string, time string, element string")
        each = sorted(tuple(r) for r in kinds.select("time", "element").distinct().collect())
    else:  # a store that only Spark opens: one file stands for all
        each = [(dict(spark.read.parquet(one).dtypes).get("timestamp", "bigint"), "float")]
    wide = "double" if any(e == "double" for _, e in each) else "float"
    values, out = (*STATE, "value", "positions"), None
    for time, element in each:
        reader = spark.read.schema(f"timestamp {time}, " + ", ".join(f"{c} array<{element}>" for c in values))
        paths = folders if len(each) == 1 else [r.path for r in kinds.where((F.col("time") == time) & (F.col("element") == element)).select("path").collect()]
        part = reader.option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").parquet(*paths)
        t = F.col("timestamp") if time == "bigint" else F.unix_micros(F.col("timestamp").cast("timestamp")) * 1000
        part = part.select(*[F.col(c).cast(f"array<{wide}>").alias(c) for c in values], F.col("_metadata.file_path").alias("path"), F.col("_metadata.row_index").alias("row_pos"), t.alias("t_ns"))
        out = part if out is None else out.unionByName(part)
    return out


def readings(spark: SparkSession, root: str, meta: Metadata, chosen: list[int] | None = None) -> DataFrame:
    """All joint readings, one row a stream and time, in one scan of the files that exist.

    A state file is read once and unfolded into its three attributes; a missing attribute column gives no rows.
    ``row_pos`` is a row's place in its file. Values are floats, or doubles where a file has them. Times in nanoseconds
    need a setting of the session, which stays.
    """
    spark.conf.set("spark.sql.legacy.parquet.nanosAsLong", "true")
    folders = _folders(root, meta, chosen)
    files = None if meta.num_episodes == 0 or (chosen is not None and not chosen) else listing(spark, folders, "*.parquet")
    if files is None or (one := files.first()) is None:
        return spark.createDataFrame([], READINGS)
    scan = _scan(spark, files, one.path, folders)
    parts = F.split(below(F.col("path"), root), "/")
    stem = F.regexp_replace(F.element_at(parts, -1), r"\.parquet$", "")
    state = F.array(*[F.struct(F.lit(a).alias("attribute"), F.col(a).alias("values"), F.lit(True).alias("is_state")) for a in STATE])
    plain = F.array(F.struct(stem.alias("attribute"), F.coalesce("value", "positions").alias("values"), F.lit(False).alias("is_state")))
    long = scan.select(
        "path", "row_pos", "t_ns",
        F.get(parts, F.lit(0)).alias("episode_id"),
        F.array_join(F.slice(parts, 2, F.size(parts) - 2), "/").alias("folder"),
        F.explode(F.when(stem == "state", state).otherwise(plain)).alias("a"),
    )
    rows = {}  # a stream without a state file has two places in the order, by whether others have one; either orders it well
    for category in ("action", "obs"):
        for flag in (False, True):
            for pos, s in enumerate(catalogue(meta, category, lambda *_, f=flag: f)):
                rows[s.path.rpartition("/")[0], s.attribute, s.state] = (category, s.key, pos)
    table = spark.createDataFrame([(*k, *v) for k, v in rows.items()], "folder string, attribute string, is_state boolean, category string, key string, key_pos int")
    long = long.select("path", "row_pos", "t_ns", "episode_id", "folder", "a.attribute", "a.values", "a.is_state")
    joined = long.join(F.broadcast(table), ["folder", "attribute", "is_state"]).join(_episodes(spark, meta, chosen), "episode_id")
    return joined.select(*[c.split(" ")[0] for c in READINGS.split(", ")])


def camera_folders(meta: Metadata, camera: str) -> list[str]:
    """Where a camera's frames may lie below an episode, the first that exists counting."""
    if meta.version is not None:
        return [f"cameras/{camera}"]
    return [f"{camera}_image", f"{camera.replace('_wrist', '')}_image"]


def _tar_index(batches):
    """(container, name, offset, size) of the members of tars, of which only the headers are read."""
    for b in batches:
        for path in b.column(0).to_pylist():
            with opened(path) as f, tarfile.open(fileobj=f, mode="r:") as tar:
                rows = [(path, m.name, m.offset_data, m.size) for m in tar if m.isfile()]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], ["container", "name", "offset", "size"])


def frames(spark: SparkSession, root: str, meta: Metadata, cameras: list[str], chosen: list[int] | None = None) -> DataFrame:
    """Pointers to all frames; bytes stay in place. A camera's folder counts before a tar of its name."""
    if not cameras or meta.num_episodes == 0 or (chosen is not None and not chosen):
        return spark.createDataFrame([], FRAMES)
    folders = _folders(root, meta, chosen)
    names = spark.createDataFrame([(f, c, k) for c in cameras for k, f in enumerate(camera_folders(meta, c))], "folder string, camera string, choice int")
    files = listing(spark, folders, "*")  # whatever lies in a camera's folder is a frame
    parts = F.split(below(F.col("path"), root), "/")
    loose = files.select("path", "size", F.get(parts, F.lit(0)).alias("episode_id"), F.array_join(F.slice(parts, 2, F.size(parts) - 2), "/").alias("folder"))
    loose = loose.join(F.broadcast(names), "folder")
    first = loose.groupBy("episode_id", "camera").agg(F.min("choice").alias("choice"))
    loose = loose.join(first, ["episode_id", "camera", "choice"])
    loose = loose.select("episode_id", "camera", file_name("path").alias("name"), "path", F.lit(None).cast("string").alias("container"), F.lit(0).cast("bigint").alias("offset"), "size")
    tars = files.where(F.col("path").endswith(".tar")).select("path").repartition(spark.sparkContext.defaultParallelism)
    packed = tars.mapInArrow(_tar_index, "container string, name string, offset bigint, size bigint")
    parts = F.split(below(F.col("container"), root), "/")
    folder = F.regexp_replace(F.array_join(F.slice(parts, 2, F.size(parts)), "/"), r"\.tar$", "")
    packed = packed.withColumns({"episode_id": F.get(parts, F.lit(0)), "folder": folder}).join(F.broadcast(names.select("folder", "camera")), "folder")
    packed = packed.join(first.select("episode_id", "camera"), ["episode_id", "camera"], "left_anti")
    packed = packed.select("episode_id", "camera", file_name("name").alias("name"), F.concat("container", F.lit("!"), "name").alias("path"), "container", "offset", "size")
    both = loose.unionByName(packed).join(_episodes(spark, meta, chosen), "episode_id")
    return both.withColumn("t_ns", frame_time_ns("name")).select(*[c.split(" ")[0] for c in FRAMES.split(", ")])


def frame_bytes(path: str, container: str | None, offset: int, size: int) -> bytes:
    """A frame's bytes: a whole file, or a range of a tar."""
    with opened(container or path) as f:
        return f.read_at(size, offset)


def with_bytes(spark: SparkSession, frames_: DataFrame) -> DataFrame:
    """``frames`` with their ``bytes``, read where the rows are."""

    def read(batches):
        for b in batches:
            out = [frame_bytes(*p) for p in zip(*(b.column(b.schema.get_field_index(c)).to_pylist() for c in ("path", "container", "offset", "size")))]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.binary())], [*b.schema.names, "bytes"])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in frames_.schema)
    return frames_.mapInArrow(read, f"{fields}, bytes binary")


def as_files(spark: SparkSession, frames_: DataFrame, folder: str) -> DataFrame:
    """``frames_`` with a ``file`` of each: a copy below ``folder``, so that one path names them all to a reader of files.

    ``folder`` is a path that every executor mounts. A copy appears by a rename once whole.
    """

    def write(batches):
        for b in batches:
            for file, *place in zip(*(c.to_pylist() for c in b.columns)):
                os.makedirs(os.path.dirname(file), exist_ok=True)
                temp = f"{os.path.dirname(file)}/_{uuid4().hex}"
                with open(temp, "wb") as f:
                    f.write(frame_bytes(*place))
                os.replace(temp, file)
            yield pa.RecordBatch.from_arrays([pa.array([len(b)], pa.int64())], ["n"])

    out = frames_.withColumn("file", F.concat(F.lit(f"{folder}/"), F.substring(F.sha2("path", 256), 1, 2), F.lit("/"), F.sha2("path", 256), F.lit(".jpeg")))
    each = out.select("file", "path", "container", "offset", "size").dropDuplicates(["file"])
    each.mapInArrow(write, "n bigint").agg(F.sum("n")).collect()
    return out
