"""Folders of an analysis: set-up, moves, supporting recordings, and discovery from the command line."""

from murmura import cli
from murmura.operators import folders


def test_set_up_and_moves(spark, tmp_path):
    made = folders.set_up(str(tmp_path))
    assert len(made) == 14 and all((tmp_path / n).is_dir() for n in folders.FOLDERS)
    folders.set_up(str(tmp_path))  # again: nothing changes
    for i in range(7):
        (tmp_path / "chunks" / f"a{i}.wav").write_bytes(bytes([i]))
    (tmp_path / "chunks" / ".hidden").write_bytes(b"x")
    assert folders.move_files(spark, str(tmp_path / "chunks"), str(tmp_path / "src_wavs")) == 7
    assert sorted(p.name for p in (tmp_path / "src_wavs").iterdir()) == [f"a{i}.wav" for i in range(7)]
    assert [p.name for p in (tmp_path / "chunks").iterdir()] == [".hidden"]
    assert (tmp_path / "src_wavs" / "a3.wav").read_bytes() == b"\3"
    (tmp_path / "segmentation_examples" / "a2.marked.bmp").write_bytes(b"i")
    (tmp_path / "segmentation_examples" / "a5.bmp").write_bytes(b"i")
    cli.main(["copy-supporting", str(tmp_path / "segmentation_examples"), str(tmp_path / "src_wavs"), str(tmp_path / "segmentation_examples_support")], spark)
    assert sorted(p.name for p in (tmp_path / "segmentation_examples_support").iterdir() if p.suffix == ".wav") == ["a2.wav", "a5.wav"]


def test_discovery_commands(spark, tmp_path, capsys):
    from murmura.sources import text

    b = spark.createDataFrame([(i, f"f{i}.wav", i / 10) for i in range(6)], "bag_id int, filename string, p double")
    s = spark.createDataFrame([(i, j, [float(i * i), float(j)]) for i in range(6) for j in range(2)], "bag_id int, segment_id int, features array<double>")
    data = str(tmp_path / "data")
    text.write_table(b.select("bag_id", "filename"), f"{data}/bags", ["bag_id"], text.HEADERS["bags"])
    text.write_table(b.selectExpr("bag_id", "concat(bag_id % 3, '') AS labels"), f"{data}/bag_labels", ["bag_id"], text.HEADERS["bag_labels"])
    text.write_table(b.select("bag_id", "p"), f"{data}/rain_probabilities", ["bag_id"], text.HEADERS["rain"])
    text.write_features(s, f"{data}/segment_features", ["bag_id", "segment_id"], text.HEADERS["segment_features"])
    cli.main(["discover", data, "MIFF", "--n", "3"], spark)
    assert [x.split("\t")[0] for x in capsys.readouterr().out.splitlines()[:3]] == ["0", "5", "4"]
    cli.main(["discover", data, "MIFF", "--n", "2", "--rain", "0.35"], spark)
    assert [x.split("\t") for x in capsys.readouterr().out.splitlines()[:2]] == [["0", "f0.wav"], ["3", "f3.wav"]]
    cli.main(["discovery-curves", data, str(tmp_path / "curves"), "--n", "2", "--repetitions", "2"], spark)
    rows = [r.value.split("\t") for r in spark.read.text(str(tmp_path / "curves")).collect()]
    assert {r[0] for r in rows} == {"random", "MIFF"} and len(rows) == 6
