from __future__ import annotations

import hashlib
import json
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from splitproof.sources import files, sinks


@pytest.fixture
def tree(tmp_path):
    for rel, data in {"site/train/Joy/a_aug_1.JPG": b"x", "site/test/joy/b.png": b"x", "other/Anger/c.jpeg": b"y", "other/Anger/notes.txt": b"z", "site/train/odd/d.jpg": b"w"}.items():
        (tmp_path / rel).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / rel).write_bytes(data)
    return str(tmp_path)


def test_file_tree(spark, tree):
    rows = {r.rel: r for r in files.file_tree(spark, tree).collect()}
    assert set(rows) == {"site/train/Joy/a_aug_1.JPG", "site/test/joy/b.png", "other/Anger/c.jpeg", "site/train/odd/d.jpg"}
    a = rows["site/train/Joy/a_aug_1.JPG"]
    assert (a.tree, a.split, a.label, a.stem, a.sha256) == ("site", "train", "joy", "a_aug_1", hashlib.sha256(b"x").hexdigest())
    assert rows["other/Anger/c.jpeg"].split == "unsplit"
    names = spark.createDataFrame([("joy", "happy"), ("anger", "angry")], "label string, name string")
    assert {r.label for r in files.file_tree(spark, tree, labels=names).collect()} == {"happy", "angry"}
    assert [r.class_index for r in files.indexed_classes(files.file_tree(spark, tree)).orderBy("rel").collect()] == [0, 1, 1, 2]


def test_class_folders_refuse_unknown_classes(spark, tree):
    zones = spark.createDataFrame([("joy", 1)], "label string, zone int")
    with pytest.raises(Exception, match="unknown class odd"):
        files.class_folders(spark, tree + "/site", zones).collect()
    rows = files.class_folders(spark, tree + "/site", zones, ("odd",)).collect()
    assert {r.sample_id for r in rows} == {hashlib.sha256(p.encode()).hexdigest()[:20] for p in ("train/Joy/a_aug_1.JPG", "test/joy/b.png")}


def test_checked_csv(spark, tmp_path):
    path, schema = tmp_path / "e.csv", StructType().add("TestID", "long").add("Judgment", "string")
    path.write_text("Judgment,TestID\n0,5\n1,6\n")
    digest = hashlib.sha256(path.read_bytes()).hexdigest()
    rows = files.checked_csv(spark, str(path), schema, digest, {"Judgment": ["0", "1"]})
    assert sorted(r.TestID for r in rows.collect()) == [5, 6]
    for args in ((schema, "0" * 64), (schema.add("More", "string"),), (StructType().add("TestID", "long").add("Judgment", "string"), None, {"Judgment": ["0"]})):
        with pytest.raises(ValueError):
            files.checked_csv(spark, str(path), *args)


def test_series_catalogue(spark, tmp_path):
    for rel in ("happy/Person_3/clip_30.csv", "sad/x_Person_9_b.csv", "odd/y.csv"):
        (tmp_path / rel).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / rel).write_text("a\n1\n")
    zones = spark.createDataFrame([("happy", 2), ("sad", 3)], "emotion string, zone int")
    got = {r.emotion: (r.person, r.fps, r.zone) for r in files.series_catalogue(spark, str(tmp_path), zones).collect()}
    assert got == {"happy": ("Person_3", 30.0, 2), "sad": ("Person_9", 25.0, 3)}


def test_sounds(spark, tmp_path):
    with wave.open(str(tmp_path / "a.wav"), "wb") as w:
        w.setnchannels(2)
        w.setsampwidth(2)
        w.setframerate(8000)
        w.writeframes(b"\x00\x40\x00\x00" * 3)
    row = files.sounds(spark, str(tmp_path)).first()
    assert row.rate == 8000 and row.samples == [0.25] * 3


def test_matched_features_and_speech(spark):
    a, b = spark.createDataFrame([(1, 0), (2, 1)], "id long, label int"), spark.createDataFrame([(1,), (3,)], "id long")
    with pytest.raises(ValueError):
        files.matched(a, b, "id")
    rows = spark.createDataFrame([("x/one.pt", 1)], "path string, label int")
    stored = spark.createDataFrame([("one", [1.0])], "stem string, feature array<double>")
    assert files.features(rows, stored, F.col("path"), "label", 3).first().one_hot == [0.0, 1.0, 0.0]
    cut = spark.sql("SELECT array(named_struct('start', 0L, 'end', 30L), named_struct('start', 50L, 'end', 60L)) AS t")
    assert cut.select(files.speech_share(F.col("t"), F.lit(100))).first()[0] == 0.4
    assert bytes(spark.sql("SELECT 'data:image/png;base64,aGk=' AS b").select(files.decoded(F.col("b"))).first()[0]) == b"hi"


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(2, "b"), (1, "a")], "id long, part string")
    assert sinks.document(rows) == json.dumps([{"id": 1, "part": "a"}, {"id": 2, "part": "b"}], sort_keys=True, indent=2) + "\n"
    path = str(tmp_path / "out")
    assert sinks.partitioned(rows, path, "id", "part") == 2 and sinks.partitioned(rows, path, "id", "part") == 0
    assert spark.read.parquet(path).count() == 2
    assert sinks.differences(rows, rows).count() == 0 and sinks.differences(rows, rows.limit(1)).count() == 1
    lines = sinks.macros(spark.createDataFrame([("Files", 1234.0), ("Rate", 0.12345)], "n string, v double"), "n", "v")
    assert sorted(r.line for r in lines.collect()) == ["\\newcommand{\\Files}{1,234}", "\\newcommand{\\Rate}{0.123}"]
    text = "\n".join(r.line for r in lines.collect()) + "\n"
    found = sinks.ledger(spark.createDataFrame([(text,)], "value string")).collect()
    assert {(r.name, r.value, r.source) for r in found} == {(n, v, hashlib.sha256(text.encode()).hexdigest()) for n, v in (("Files", "1,234"), ("Rate", "0.123"))}
    files_ = spark.createDataFrame([("a/b.txt", b"x"), ("c.txt", b"")], "rel string, content binary")
    assert sinks.placed(files_, str(tmp_path / "placed")) == 2 and sinks.placed(files_, str(tmp_path / "placed")) == 0
    assert (tmp_path / "placed/a/b.txt").read_bytes() == b"x"
    with pytest.raises(ValueError):
        sinks.placed(files_, str(tmp_path / "placed"), most=1)
    h = "0" * 64
    found = sinks.listed(spark.createDataFrame([(f"{h}  a",), (f"{h}  ../b",), (f"{h}  c",)], "line string"), spark.createDataFrame([("a", h), ("c", "1"), ("d", h)], "path string, sha256 string"))
    assert {r.path: r.state for r in found.collect()} == {"a": "same", "../b": "unsafe", "c": "changed", "d": "extra"}


def test_resampling():
    x = np.sin(np.arange(400) / 9).astype(np.float32)
    assert files.resampled_sound(x, 8000, 8000) is x
    for rate, target in ((8000, 16_000), (16_000, 8000), (44_100, 16_000), (16_000, 22_050)):
        step = np.gcd(rate, target)
        up, down = target // step, rate // step
        side = 10 * max(up, down)
        taps = np.sinc(np.arange(-side, side + 1) / max(up, down)) * np.kaiser(2 * side + 1, 5.0)
        stretched = np.zeros(len(x) * up)
        stretched[::up] = x
        want = np.convolve(stretched, taps * up / taps.sum())[side : side + len(stretched) : down]
        got = files.resampled_sound(x, rate, target)
        assert len(got) == -(-len(x) * up // down) and np.allclose(got, want[: len(got)], atol=1e-5)
    with pytest.raises(ValueError):
        files.wave_samples(b"no sound")
