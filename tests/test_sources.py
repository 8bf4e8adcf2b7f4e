"""Files: each format read back as written."""

import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from murmura.sources import bmp, forest_text, text, wav


def put(tmp_path, name, content):
    p = tmp_path / name
    p.write_text(content)
    return str(p)


def test_readers(spark, tmp_path):
    assert [tuple(r) for r in text.read_bags(spark, put(tmp_path, "a", "bag_id,filename\n\n0,x.wav\n1,y.wav\n")).orderBy("bag_id").collect()] == [(0, "x.wav"), (1, "y.wav")]
    f = text.read_segment_features(spark, put(tmp_path, "b", "bag_id,segment_id,[feature vector]\n0,0,0.25,1.0\n")).first()
    assert (f.bag_id, f.features) == (0, [0.25, 1.0])
    assert [r.labels for r in text.read_bag_labels(spark, put(tmp_path, "c", "bag_id,[labels]\n0,2,5\n3,\n")).orderBy("bag_id").collect()] == [[2, 5], []]
    assert text.read_species(spark, put(tmp_path, "d", "class_id,code,species\n0,ABCD,Bird\n")).first().code == "ABCD"
    assert text.read_segment_rectangles(spark, put(tmp_path, "e", "bag_id,segment_id,min_x,max_x,min_y,max_y\n0,0,10,40,5,25,\n")).first().max_y == 25
    assert text.read_expert_labels(spark, put(tmp_path, "f", 'f1,"AAAA,RAIN"\n')).first().codes == ["AAAA", "RAIN"]
    assert text.read_rain(spark, put(tmp_path, "g", "bag_id,rain_probability\n0,0.125\n")).first().rain_probability == 0.125
    assert text.read_folds(spark, put(tmp_path, "h", "bag_id,fold\n0,1\n")).first().fold == 1
    assert text.read_bag_features(spark, put(tmp_path, "i", "bag_id,whatever\n0,1,2\n")).first().features == [1.0, 2.0]
    with pytest.raises(ValueError):
        text.read_bags(spark, put(tmp_path, "j", "id,name\n0,x\n"))


def test_experiment_round_trip(spark, tmp_path):
    ex = spark.createDataFrame([(0, 1, [1, 2], [0.1, 0.9]), (1, 0, [], [0.4, 0.6])], "bag_id int, fold int, labels array<int>, features array<double>")
    classes = spark.createDataFrame([(0, "a"), (1, "b"), (2, "c")], "class_id int, name string")
    path = str(tmp_path / "mlc")
    text.write_experiment(ex, classes, path, 3, 2, 2)
    settings, c, got = text.read_experiment(spark, path)
    assert settings == {"num_classes": 3, "feature_dim": 2, "partition": "k-fold", "folds": 2} and c.count() == 3
    assert [(r.partition, r.labels, r.features) for r in got.orderBy("example_id").collect()] == [("1", [1, 2], [0.1, 0.9]), ("0", [], [0.4, 0.6])]
    assert text.read_experiment(spark, path, compat=True)[2].filter("example_id = 1").first().labels == [0]


def test_feature_file_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, 0, [0.5, 0.25]), (0, 0, [1.0, 2.0])], "bag_id int, segment_id int, features array<double>")
    path = str(tmp_path / "features")
    text.write_features(df, path, ["bag_id", "segment_id"], text.HEADERS["segment_features"])
    assert [r.value for r in spark.read.text(path).collect()] == ["bag_id,segment_id,[feature vector]", "0,0,1.000000,2.000000", "1,0,0.500000,0.250000"]
    assert text.read_segment_features(spark, path).count() == 2


def test_wav(spark, tmp_path):
    x = np.sin(np.arange(1600) * 0.1) * 0.5
    rate, bits, channels, y = wav.decode(wav.encode(x, 16000))
    assert (rate, bits, channels) == (16000, 16, 1) and np.abs(x - y).max() < 1e-4
    stereo = np.array([[100, 300], [-200, 0]], "<i2").tobytes()
    data = b"RIFF" + struct.pack("<I", 36 + len(stereo)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 2, 8000, 32000, 4, 16) + b"data" + struct.pack("<I", len(stereo)) + stereo
    assert np.allclose(wav.decode(data)[3] * 32768, [200, -100])
    with pytest.raises(ValueError):
        wav.decode(b"nothing")
    df = spark.createDataFrame([("a.wav", 16000, x.tolist())], "name string, sample_rate int, samples array<float>")
    assert wav.write(df, str(tmp_path / "wavs")) == 1
    (tmp_path / "wavs" / "bad.wav").write_bytes(b"no")
    got = wav.read(spark, str(tmp_path / "wavs")).collect()
    assert len(got) == 1 and len(got[0].samples) == 1600
    assert [(r.samples, r.problem) for r in wav.read(spark, str(tmp_path / "wavs"), problems=True).filter("problem IS NOT NULL").collect()] == [(None, "not a RIFF/WAVE file")]


def test_bmp(spark, tmp_path):
    rng = np.random.default_rng(0)
    for shape in ((3, 4), (5, 7, 3)):
        img = rng.integers(0, 256, shape).astype(np.uint8)
        got = bmp.decode(bmp.encode(img))
        assert (got == (img[:, :, None] if img.ndim == 2 else img)).all()
    five = struct.pack("<HH", 0x7C00, 0x001F)
    head = b"BM" + struct.pack("<IHHI", 54 + 4, 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, 2, 1, 1, 16, 0, 4, 0, 0, 0, 0)
    assert bmp.decode(head + five).tolist() == [[[255, 0, 0], [0, 0, 255]]]
    pal = bytes(range(0, 256)) * 4
    rle = bytes((3, 7, 0, 0, 2, 9, 0, 1))
    head = b"BM" + struct.pack("<IHHI", 0, 0, 0, 54 + 1024) + struct.pack("<IiiHHIIiiII", 40, 3, 2, 1, 8, 1, len(rle), 0, 0, 256, 0)
    grey = b"".join(bytes((i, i, i, 0)) for i in range(256))
    assert bmp.decode(head + grey + rle)[:, :, 0].tolist() == [[7, 7, 7], [9, 9, 0]] and len(pal) == 1024
    (tmp_path / "x.bmp").write_bytes(bmp.encode(rng.integers(0, 256, (3, 4)).astype(np.uint8)))
    r = bmp.read(spark, str(tmp_path)).first()
    named = bmp.read(spark, str(tmp_path)).withColumn("name", F.lit("copy.bmp"))
    assert bmp.write(named, str(tmp_path / "out")) == 1 and bmp.read(spark, str(tmp_path / "out")).first().data == r.data
    assert (r.w, r.h, r.channels) == (4, 3, 3) and bmp.as_array(r.w, r.h, r.channels, bytes(r.data)).shape == (3, 4, 3)


def test_forest_text(spark, tmp_path):
    from murmura.operators.forest import train_local

    rng = np.random.default_rng(0)
    x = rng.normal(size=(60, 3))
    f = train_local(x, (x[:, 0] > 0).astype(int), 2, 3, leaf="histogram")
    t = forest_text.forest_text(f)
    assert forest_text.forest_text(forest_text.parse_forest(t)) == t
    assert forest_text.forest_text(forest_text.parse_forest("2,1\n(0,0.500000,[1.000000,0.000000],[0.000000,1.000000])\n")).endswith("(0,0.500000,[1.000000,0.000000],[0.000000,1.000000])\n")
    forest_text.save(spark, f, str(tmp_path / "model"))
    assert forest_text.forest_text(forest_text.load(spark, str(tmp_path / "model"))) == t


def test_html_report(spark):
    from murmura.operators.recordings import html_bars, unpivoted

    df = spark.createDataFrame([("a<", 3), ("b", 1)], "class string, count int")
    assert "a&lt;" in html_bars(df, "class", "count", "t")
    wide = df.select("class", F.col("count").alias("x"), (F.col("count") + 1).alias("y"))
    assert unpivoted(wide).count() == 4
