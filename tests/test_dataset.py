"""Datasets of all layouts: metadata, scans, alignment, quality, merging and writers."""

import json
import shutil

import numpy as np
import pandas as pd
import pyarrow.parquet as pq
import pytest
import recordings as rec
import yaml

from kinetrace import Dataset, cli, maintenance, publish
from kinetrace.sinks.episodic import modality_ranges
from kinetrace.sources.metadata import embodiment

VERSIONS = [None, "0.1.0", "0.2.0", "0.3.0"]


@pytest.fixture(scope="module")
def roots(spark, tmp_path_factory):
    base = tmp_path_factory.mktemp("recordings")
    return {v: rec.write(spark, base / f"d{v}", v) for v in VERSIONS} | {"tar": rec.write(spark, base / "tar", "0.3.0", "tar")}


@pytest.mark.parametrize("version", VERSIONS)
def test_metadata(roots, spark, version):
    m = Dataset(roots[version], spark).meta
    assert (m.version, m.operator, m.operation_type, m.location, m.num_episodes) == (version, "Tester", "teleop", "Test", 2)
    assert m.tasks == rec.TASKS and m.equipment["id"] == "Test" and m.equipment["version"] == "1.0"
    arms = m.embodiments["arms"]
    assert (arms.components, arms.attributes, len(arms.joints), arms.joints[-1]) == (("right", "left"), ("qpos",), 8, "gripper")
    assert arms.version == ("1.2" if version is None else "2.0")
    assert m.frequencies == (rec.frequencies(version == "0.3.0") if version in ("0.2.0", "0.3.0") else {})
    with pytest.raises(ValueError):
        embodiment("x", {"id": "Wheel"})


@pytest.mark.parametrize("version", VERSIONS)
def test_loading(roots, spark, version):
    d = Dataset(roots[version], spark)
    obs, action = d.load_obs(0), d.load_action(d.meta.episodes[1])
    right = obs["arms/right/qpos"]
    assert right.columns == ["timestamp", *(f"joint{k}" for k in range(1, 8)), "gripper"]
    assert (right.count(), obs["arms/left/qpos"].count(), action["arms/right/qpos"].count()) == (746, 745, 90)
    t, x = rec.series(746, 8, 11)
    got = right.toPandas()
    assert got.timestamp.tolist() == t and np.array_equal(got.iloc[:, 1:].to_numpy(np.float32), x)
    assert d.load_obs(0, use_unixtime=True)["arms/right/qpos"].first().timestamp == t[0] / 1e9
    if version == "0.3.0":
        assert list(obs) == [f"arms/{s}/{a}" for s in ("right", "left") for a in ("qpos", "qvel", "qtorque")] + ["lifter/elevation"]
        assert np.allclose(obs["arms/right/qvel"].toPandas().iloc[:, 1:], x * 0.1) and obs["lifter/elevation"].count() == 745
    else:
        assert list(obs) == ["arms/right/qpos", "arms/left/qpos"]


@pytest.mark.parametrize("version", [*VERSIONS, "tar"])
def test_alignment_takes_the_first_reading_not_before(roots, spark, version):
    d = Dataset(roots[version], spark)
    s = d.sample(30, 0)
    assert [x.timestamp for x in s] == [1772010251.6202147, 1772010251.653548]
    names = {"wrist_left": "left_wrist", "wrist_right": "right_wrist"} if version is None else {}
    want = {"ceiling": 1772010251629083055, "head": 1772010251629774985, "wrist_left": 1772010251620214727, "wrist_right": 1772010251628789283}
    for c, t in want.items():
        assert s[0].cameras[names.get(c, c)].endswith(f"{t}.jpeg")
    t, x = rec.series(746, 8, 11)
    for sample in s:
        i = next(i for i, v in enumerate(t) if v / 1e9 >= sample.timestamp)
        assert np.allclose(sample.obs["arms/right/qpos"], x[i])
    assert len(s[0]) == 4 and list(s[0]) == ["timestamp", "obs", "action", "cameras"] and s[0]["obs"] is s[0].obs


def test_alignment_against_searching(spark):
    """Double grids at several rates, with equal times, against sorted search over a ranged array."""
    from pyspark.sql import functions as F

    from kinetrace.operators import align

    r = np.random.default_rng(11)
    rows, want = [], set()
    for e in range(6):
        own = {s: np.sort(1.77e9 + np.round(r.uniform(0, 20, 150), 2 + s)) for s in range(3)}
        rows += [(e, s, float(t), i) for s, ts in own.items() for i, t in enumerate(ts)]
        start, end = max(t[0] for t in own.values()), min(t[-1] for t in own.values())
        for k, t in enumerate(np.arange(start, end, 1 / 24)):
            if t <= end:
                want |= {(e, s, k, int(np.searchsorted(ts, t))) for s, ts in own.items()}
    df = spark.createDataFrame(rows, "e int, s int, t double, i int")
    grid = align.with_float_grid(align.common_range(df, "e", "s", "t"), 24)
    for width in (None, 3.0):
        got = align.forward_asof(df, grid, "e", "s", "t", ["i"], width).select("e", "s", "k", "i")
        assert {tuple(x) for x in got.collect()} == want
    assert align.time_grid(grid, "e").where(F.col("e") == 0).count() == len({k for e, _, k, _ in want if e == 0})


def test_cameras(roots, spark):
    for v, kind in (("0.3.0", "dir"), ("tar", "tar")):
        d = Dataset(roots[v], spark)
        assert d.camera_format == kind and d.camera_names == list(rec.FRAMES)
        c = d.load_camera("ceiling", 0)
        assert c.num_frames == 3 and c.format == kind
        assert c.load_timestamps() == [t / 1e9 for t in rec.FRAMES["ceiling"]]
        assert c.get_frame(1).t_ns == rec.FRAMES["ceiling"][1]
        data = {bytes(r.bytes) for r in c.read_bytes().collect()}
        assert len(data) == 1 and next(iter(data))[:2] == b"\xff\xd8"
        image = c.load(0)
        assert image.shape == (60, 96, 3) and np.abs(image.astype(int) - [200, 50, 10]).max() <= 3
        with pytest.raises(KeyError):
            d.load_camera("none", 0)
    only = Dataset(roots["0.3.0"], spark, camera_names=["head"])
    assert list(only.load_cameras(0)) == ["head"] and only.frames().select("camera").distinct().count() == 1


def test_smoothing(roots, spark):
    from kinetrace.operators.smooth import design, zero_phase

    b, a = design(0.01)
    assert np.allclose(b, 5.845142433144487e-08 * np.array([1, 4, 6, 4, 1]), rtol=1e-9)
    assert np.allclose(a, [1, -3.9179078653919865, 5.7570763791180655, -3.7603495076945257, 0.921181929191236])
    assert np.allclose(zero_phase(np.full((50, 2), 3.0), 1.0), 3.0) and np.array_equal(zero_phase(np.ones((15, 1)), 1), np.ones((15, 1)))
    d = Dataset(roots["0.3.0"], spark)
    x = d.load_obs(0)["arms/right/qpos"].toPandas().iloc[:, 1:].to_numpy(float)
    y = d.load_obs(0, cutoff=5.0)["arms/right/qpos"].toPandas().iloc[:, 1:].to_numpy()
    assert np.allclose(y, zero_phase(x, 5.0)) and np.abs(np.diff(y, axis=0)).mean() < np.abs(np.diff(x, axis=0)).mean()
    assert np.allclose(d.load_obs(0, cutoff=0)["arms/right/qpos"].toPandas().iloc[:, 1:], x)


@pytest.mark.parametrize("cutoff", [0.5, 5.0, 100.0])
def test_the_filter_is_its_recurrence(cutoff):
    """Blocks of rows as matrix products against one row after another."""
    from kinetrace.operators import smooth

    b, a = smooth.design(smooth.normalised(cutoff))
    x = np.random.default_rng(1).normal(0, 1, (1000, 3)).cumsum(0)
    for n in (16, 97, 98, 99, 1000):
        whole = np.concatenate((2 * x[0] - x[15:0:-1], x[:n], 2 * x[n - 1] - x[n - 2 : n - 17 : -1] if n > 16 else 2 * x[15] - x[14::-1]))
        for _ in range(2):
            y, z = np.empty_like(whole), None
            lag = lambda k, v, i: v[i - k] if i >= k else v[0]  # noqa: E731, before the first row all is steady
            for i in range(len(whole)):
                y[i] = sum(b[k] * lag(k, whole, i) for k in range(5)) - sum(a[k] * (y[i - k] if i >= k else whole[0]) for k in range(1, 5))
            whole = y[::-1]
        assert np.allclose(smooth.zero_phase(x[:n], cutoff), whole[15:-15], rtol=1e-6, atol=1e-6)


def test_smoothing_leaves_streams_with_nulls(spark):
    from kinetrace.operators.smooth import smoothed, zero_phase

    rows = [(s, i, None if s == 1 and i == 3 else [float(i), None if s == 2 and i == 4 else 1.0] if s < 3 or i else [1.0]) for s in range(4) for i in range(30)]
    got = {(r.s, r.row_pos): r["values"] for r in smoothed(spark.createDataFrame(rows, "s int, row_pos bigint, values array<float>"), ["s"], 5.0).collect()}
    assert np.allclose([got[0, i] for i in range(30)], zero_phase([[i, 1.0] for i in range(30)], 5.0))
    assert got[1, 3] is None and got[1, 4] == [4.0, 1.0] and got[3, 0] == [1.0] and got[3, 1] == [1.0, 1.0]
    assert all(np.isnan(got[2, i][1]) for i in range(30)) and np.isfinite(got[2, 7][0])


@pytest.mark.parametrize("version", VERSIONS)
@pytest.mark.parametrize("cameras", ["dir", "tar"])
def test_writing_the_latest_layout(roots, spark, tmp_path, version, cameras):
    Dataset(roots[version], spark).write(tmp_path / "out", camera_format=cameras)
    d = Dataset(tmp_path / "out", spark)
    assert d.meta.version == "0.3.0" and sorted(d.camera_names) == sorted(rec.FRAMES) and d.camera_format == cameras
    assert d.load_obs(0)["arms/right/qpos"].count() == 746
    assert d.load_camera("wrist_left", 0).load_timestamps() == [t / 1e9 for t in rec.FRAMES["wrist_left"]]
    assert [x.timestamp for x in d.sample(30, 0)] == [1772010251.6202147, 1772010251.653548]
    with pytest.raises(ValueError):
        d.write(tmp_path / "x", format="none")


def test_validate_and_repair(spark, tmp_path, capsys):
    root = rec.write(spark, tmp_path / "d", "0.3.0")
    base = root / "episodes" / "0"
    d = Dataset(root, spark)
    assert d.validate() and cli.main(["validate", str(root)]) == 0
    state, lifter, left = base / "obs/arms/right/state.parquet", base / "obs/lifter/elevation.parquet", base / "action/arms/left/qpos.parquet"
    _, x = rec.series(746, 8, 11)
    rec.break_cells(state, "qpos", {4: None, 10: {2: float("nan")}, 20: {1: None}, 30: None, 31: None})
    rec.break_cells(lifter, "value", {0: {0: float("nan")}, 7: {0: float("nan")}})
    rec.break_cells(left, "value", {3: {5: None}})
    said = []
    assert not d.validate(said.append)
    assert said == [f"episodes/0/{p}: includes null values" for p in ("obs/arms/right/state.parquet", "obs/lifter/elevation.parquet", "action/arms/left/qpos.parquet")]
    assert cli.main(["validate", str(root)]) == 1
    done, errors = [], []
    assert maintenance.repair(d, tmp_path / "copy", done.append, errors.append) == (8 + 1 + 1 + 1 + 1, 16 + 1)
    assert len(done) == 3 and len(errors) == 2
    copy = pq.read_table(tmp_path / "copy/episodes/0/obs/arms/right/state.parquet")
    v = copy.column("qpos").to_pylist()
    assert np.allclose(v[4], (x[3] + x[5]) / 2) and np.isclose(v[10][2], (x[9][2] + x[11][2]) / 2) and v[30] is None and v[31] is None
    assert copy.schema.field("qpos").type == pq.read_schema(state).field("qpos").type
    assert not Dataset(tmp_path / "copy", spark).validate()
    assert pq.read_table(state).column("qpos").to_pylist()[4] is None  # the original stays
    cli.main(["repair", str(root)])
    out = capsys.readouterr()
    assert out.out.count("repaired") == 3 and out.err.count("can't be repaired") == 2


def test_merge(spark, tmp_path):
    a = rec.write(spark, tmp_path / "a", "0.3.0")
    more = [{"prompt": "Different task.", "description": "d"}, *rec.TASKS]
    b = rec.write(spark, tmp_path / "b", "0.3.0", tasks=more, episodes=[{"id": "9", "success": True, "task_index": 1}, {"id": "5", "success": True, "task_index": 0}])
    for link in (False, True):
        out = tmp_path / f"out{link}"
        maintenance.merge([a, b], out, link, spark)
        m = Dataset(out, spark).meta
        assert [e["id"] for e in m.episodes] == ["0", "1", "2", "3"] and [e["task_index"] for e in m.episodes] == [0, 0, 0, 1]
        assert [t["prompt"] for t in m.tasks] == ["Run test.", "Different task."]
        assert (out / "episodes" / "2").is_symlink() == link and (out / "episodes/2/obs/arms/right/state.parquet").exists()
    with pytest.raises(ValueError):
        maintenance.merge([a], tmp_path / "x", spark=spark)
    with pytest.raises(ValueError):
        maintenance.merge([a, b], tmp_path / "outTrue", spark=spark)
    for change in ("version", "stroke", "frequency", "camera"):
        c = rec.write(spark, tmp_path / change, "0.3.0")
        doc = yaml.safe_load((c / "metadata.yaml").read_text())
        if change == "version":
            doc["version"] = "0.2.0"
        elif change == "stroke":
            doc["equipment"]["embodiments"]["lifter"]["stroke"] = 1
        elif change == "frequency":
            doc["frequencies"]["obs"]["lifter"] = 1.0
        else:
            doc["equipment"]["perceptions"]["cameras"]["extra"] = {}
        (c / "metadata.yaml").write_text(yaml.safe_dump(doc))
        with pytest.raises(ValueError):
            maintenance.merge([a, c], tmp_path / "never", spark=spark)


def test_episodic_export(roots, spark, tmp_path):
    d = Dataset(roots["0.3.0"], spark)
    d.write(tmp_path, format="gr00t", fps=30, train_split=0.5)
    t = pq.read_table(tmp_path / "data/chunk-000/episode_000001.parquet")
    assert t.column_names == ["action", "observation.state", "timestamp", "frame_index", "episode_index", "index", "task_index", "success", "last_frame_index"]
    assert t.column("index").to_pylist() == [2, 3] and t.column("success").to_pylist() == [1, 1] and t.column("timestamp").to_pylist() == [0, 1 / 30]
    assert len(t.column("action")[0]) == 17
    info = json.loads((tmp_path / "meta/info.json").read_text())
    assert (info["total_episodes"], info["total_frames"], info["total_videos"], info["total_chunks"], info["splits"]) == (2, 4, 8, 1, {"train": "0:1", "val": "1:2"})
    assert info["features"]["observation.images.head"]["shape"] == [60, 96, 3] and info["features"]["action"]["names"][-1] == "elevation.pos"
    stats = [json.loads(x) for x in (tmp_path / "meta/episodes_stats.jsonl").read_text().splitlines()]
    a = np.array(pq.read_table(tmp_path / "data/chunk-000/episode_000000.parquet").column("action").to_pylist())
    assert np.allclose(stats[0]["stats"]["action"]["mean"], a.mean(0), atol=1e-6) and np.allclose(stats[0]["stats"]["action"]["q10"], np.quantile(a, 0.1, 0), atol=1e-6)
    image = stats[0]["stats"]["observation.images.ceiling"]
    assert np.allclose(np.ravel(image["mean"]), [200 / 255, 50 / 255, 10 / 255], atol=1e-2) and image["count"] == [2]
    ranges = {"right_arm": (0, 7), "right_gripper": (7, 8), "left_arm": (8, 15), "left_gripper": (15, 16), "lifter": (16, 17)}
    assert modality_ranges(d) == {k: {"start": s, "end": e} for k, (s, e) in ranges.items()}
    assert json.loads((tmp_path / "meta/modality.json").read_text())["video"]["head"] == {"original_key": "observation.images.head"}
    with pytest.raises(ValueError):
        d.write(tmp_path / "x", format="lerobot_v2.1", train_split=2)
    with pytest.raises(ValueError):
        d.write(tmp_path / "x", format="lerobot_v2.1", fps=0)


def test_packed_export(roots, spark, tmp_path):
    Dataset(roots["0.3.0"], spark).write(tmp_path, format="lerobot_v3.0", success_only=True)
    t = pq.read_table(tmp_path / "data/chunk-000/file-000.parquet")
    assert t.column("episode_index").to_pylist() == [0, 0] and t.column("success").to_pylist() == [1, 1]
    e = pd.read_parquet(tmp_path / "meta/episodes/chunk-000/file-000.parquet")
    assert e["length"].tolist() == [2] and e["data/file_index"].tolist() == [0] and len(e["stats/action/mean"][0]) == 17
    tasks = pd.read_parquet(tmp_path / "meta/tasks.parquet")
    assert tasks.index.name == "task" and tasks.task_index.tolist() == [0]
    stats = json.loads((tmp_path / "meta/stats.json").read_text())
    assert list(stats)[:2] == ["action", "episode_index"] and "observation.images.head" in stats
    assert json.loads((tmp_path / "meta/info.json").read_text())["features"]["timestamp"]["fps"] == 30


def test_packed_videos_follow_each_other(roots, spark, tmp_path):
    Dataset(roots["0.3.0"], spark, ["head", "ceiling"]).write(tmp_path, format="lerobot_v3.0")
    e = pd.read_parquet(tmp_path / "meta/episodes/chunk-000/file-000.parquet")
    key = "videos/observation.images.head/"
    assert e[key + "file_index"].tolist() == [0, 0] and e[key + "from_timestamp"].tolist() == [0, 2 / 30] and e[key + "to_timestamp"].tolist() == [2 / 30, 4 / 30]
    assert e["dataset_from_index"].tolist() == [0, 2] and not [c for c in e if "wrist" in c]


@pytest.mark.parametrize("format", ["lerobot_v2.1", "gr00t", "lerobot_v3.0"])
def test_exports_of_tars_describe_images_like_those_of_folders(roots, spark, tmp_path, format):
    for v in ("0.3.0", "tar"):
        Dataset(roots[v], spark).write(tmp_path / v, format=format)
    one, two = tmp_path / "0.3.0" / "meta", tmp_path / "tar" / "meta"
    assert sorted(p.name for p in one.parent.iterdir()) == sorted(p.name for p in two.parent.iterdir())
    info = json.loads((two / "info.json").read_text())
    assert {f"observation.images.{c}" for c in rec.FRAMES} <= set(info["features"]) and info == json.loads((one / "info.json").read_text())
    names = ["stats.json"] if format == "lerobot_v3.0" else ["stats.json", "episodes_stats.jsonl"]
    for name in names:
        assert (one / name).read_text() == (two / name).read_text()
    if format == "lerobot_v3.0":
        a, b = (pd.read_parquet(m / "episodes/chunk-000/file-000.parquet") for m in (one, two))
        assert "stats/observation.images.head/mean" in b and list(a) == list(b) and repr(a.values.tolist()) == repr(b.values.tolist())
    else:
        assert all("observation.images.head" in json.loads(x)["stats"] for x in (two / "episodes_stats.jsonl").read_text().splitlines())


@pytest.mark.parametrize("format", ["lerobot_v2.1", "lerobot_v3.0"])
def test_exports_stop_where_a_camera_lacks_frames(spark, tmp_path, format):
    root = rec.write(spark, tmp_path / "d", "0.3.0")
    shutil.rmtree(root / "episodes" / "3" / "cameras" / "head")
    with pytest.raises(ValueError, match="'head' of episode 1 has 0 video frames"):
        Dataset(root, spark).write(tmp_path / "out", format=format)
    assert not list(tmp_path.glob("out/**/*.parquet"))


def test_exports_need_the_encoder_or_go_without_videos(roots, spark, tmp_path):
    d = Dataset(roots["0.3.0"], spark)
    with pytest.raises(RuntimeError, match="no-such-encoder"):
        d.write(tmp_path / "a", format="lerobot_v3.0", encoder="no-such-encoder")
    assert not (tmp_path / "a").exists()
    d.write(tmp_path / "b", format="lerobot_v3.0", videos=False, encoder="no-such-encoder", data_mb=7, video_mb=9)
    assert not list(tmp_path.glob("b/videos/**/*.mp4")) and spark.read.parquet(str(tmp_path / "b/meta/frames")).count() == 16
    info = json.loads((tmp_path / "b/meta/info.json").read_text())
    assert (info["data_files_size_in_mb"], info["video_files_size_in_mb"]) == (7, 9) and "observation.images.head" in info["features"]
    assert not [c for c in pd.read_parquet(tmp_path / "b/meta/episodes/chunk-000/file-000.parquet") if c.startswith("videos/")]


def test_videos_hold_their_frames_in_order(roots, spark, tmp_path):
    """Files are packed by the measured ratio; the stand-in encoder keeps 100 bytes of each frame."""
    d = Dataset(roots["tar"], spark, ["head"])
    first = bytes(d.load_camera("head", 0).read_bytes().first().bytes)[:100]
    d.write(tmp_path / "two", format="lerobot_v3.0", video_mb=300 / 2**20, data_mb=1 / 2**20)
    assert [(tmp_path / f"two/videos/observation.images.head/chunk-000/file-00{k}.mp4").read_bytes() for k in (0, 1)] == [first * 2] * 2
    e = pd.read_parquet(tmp_path / "two/meta/episodes/chunk-000/file-000.parquet")
    assert e["videos/observation.images.head/file_index"].tolist() == e["data/file_index"].tolist() == [0, 1]
    d.write(tmp_path / "three", format="lerobot_v2.1")
    assert (tmp_path / "three/videos/chunk-000/observation.images.head/episode_000001.mp4").read_bytes() == first * 2


def test_a_dataset_behind_a_uri(roots, spark, tmp_path):
    """A root that no path names is read through Spark alone."""
    for v in (None, "tar"):
        d, local = Dataset(f"file://{roots[v]}", spark), Dataset(roots[v], spark)
        assert not d.is_local and d.meta.data == local.meta.data and list(d.load_obs(0)) == list(local.load_obs(0))
        assert d.load_camera("ceiling", 0).load_timestamps() == local.load_camera("ceiling", 0).load_timestamps()
        assert [x.timestamp for x in d.sample(30, 0)] == [1772010251.6202147, 1772010251.653548]
    with pytest.raises(ValueError, match="is no path"):
        d.root_path


def test_files_of_different_types(spark, tmp_path):
    """Doubles beside floats, and times in microseconds beside nanoseconds, each file by its own footer."""
    import pyarrow as pa

    root = rec.write(spark, tmp_path / "d", "0.2.0")
    t, x = rec.series(50, 8, 3)
    t = [1000 * (v // 1000) for v in t]
    rec.put(pa.table([pa.array(t, pa.timestamp("ns")), pa.array(list(x.astype(float) + 1e-12), pa.list_(pa.float64()))], ["timestamp", "value"]), root / "episodes/0/obs/arms/right/qpos.parquet")
    rec.put(pa.table([pa.array([v // 1000 for v in t], pa.timestamp("us", "UTC")), pa.array(list(x), pa.list_(pa.float32()))], ["timestamp", "value"]), root / "episodes/0/obs/arms/left/qpos.parquet")
    obs = Dataset(root, spark).load_obs(0)
    right, left = (obs[f"arms/{s}/qpos"].toPandas() for s in ("right", "left"))
    assert right.timestamp.tolist() == left.timestamp.tolist() == t
    assert np.array_equal(right.iloc[:, 1:].to_numpy(), x.astype(float) + 1e-12) and np.array_equal(left.iloc[:, 1:].to_numpy(np.float32), x)


def test_frames_of_any_kind_and_linked_copies(spark, tmp_path):
    for cameras in ("dir", "tar"):
        root = rec.write(spark, tmp_path / cameras, "0.1.0", cameras)
        if cameras == "dir":
            folder = root / "episodes/0/cameras/head"
            for f in sorted(folder.iterdir()):
                f.rename(f.with_suffix(".png"))
        d = Dataset(root, spark)
        assert d.load_camera("head", 0).num_frames == 3
        maintenance.repair(d, tmp_path / f"copy-{cameras}")
        copy = Dataset(tmp_path / f"copy-{cameras}", spark)
        place = tmp_path / f"copy-{cameras}/episodes/0/cameras" / ("head" if cameras == "dir" else "head.tar")
        assert place.is_symlink() and copy.meta.version == "0.3.0" and copy.camera_format == cameras
        assert copy.load_camera("head", 0).load_timestamps() == d.load_camera("head", 0).load_timestamps()


def test_unknown_recordings_are_errors(roots, tmp_path):
    from kinetrace.sources.metadata import Metadata

    doc = yaml.safe_load((roots[None] / "metadata.yaml").read_text())
    del doc["meta"]["equipment"]["leader"]["arms"]["right_arm"]["name"]
    with pytest.raises(ValueError, match="has no name"):
        Metadata(doc["meta"]).equipment


def test_long_series(roots, spark, tmp_path):
    d = Dataset(roots["0.3.0"], spark)
    d.write(tmp_path, format="rrd", fps=30)
    s = spark.read.parquet(str(tmp_path / "series"))
    assert s.where("entity = 'ep3/obs/lifter/elevation/elevation'").count() == 2
    assert s.select("entity").distinct().count() == 2 * (6 * 8 + 1 + 2 * 8 + 1)
    tabs = json.loads((tmp_path / "blueprint.json").read_text())["tabs"]
    assert [x["name"] for x in tabs] == ["ep0", "ep3"] and tabs[0]["column_shares"] == [0.3, 0.35, 0.35]


def test_card_and_packing(spark, tmp_path):
    root = rec.write(spark, tmp_path / "d", "0.3.0")
    sent = []

    class Publisher:
        def publish(self, folder, repository, ignore, tags):
            sent.append((folder, repository, ignore, tags))

    publish.publish(Dataset(root, spark), "me/x", Publisher(), ["a"], license="mit")
    assert Dataset(root, spark).camera_format == "tar" and sent[0][1] == "me/x"
    text = (root / "README.md").read_text()
    assert "license: mit" in text and "episodes/*/cameras/head.tar" in text and "operation_type: teleop" in text
