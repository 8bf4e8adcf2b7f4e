"""Captions and boxes of segments."""

import numpy as np
import pytest

from murmura.functions import captions, image
from murmura.operators import folders
from murmura.sources import bmp


def test_numbers_of_characters():
    assert [captions.number(c) for c in "AZaz09.="] == [0, 25, 26, 51, 52, 61, 62, 72]
    assert all(captions.character(captions.number(c)) == c for c in captions.CHARACTERS)
    for bad in ("", "AB", "~"):
        with pytest.raises(ValueError):
            captions.number(bad)
    for bad in (-1, 73):
        with pytest.raises(ValueError):
            captions.character(bad)


def test_every_character_has_a_form_of_its_own():
    forms = {captions.glyph(c).tobytes() for c in captions.CHARACTERS + " "}
    assert len(forms) == 74 and not captions.glyph(" ").any()
    assert not any(captions.glyph(c)[7].any() or captions.glyph(c)[:, 7].any() for c in captions.CHARACTERS)  # letters don't touch


def test_text_by_hand():
    img = captions.draw_text(np.zeros((10, 24), np.uint8), "L -", 0, 0, 9)
    want = np.zeros((10, 24), np.uint8)
    want[0:7, 0] = want[6, 0:7] = want[3, 16:23] = 9
    assert (img == want).all()
    up = captions.draw_text(np.zeros((10, 24), np.uint8), "L -", 0, 0, 9, upwards=True)
    assert (up == want[::-1]).all()


@pytest.mark.parametrize("x,y", [(0, 0), (-5, -3), (3, 4), (18, 9), (-60, 0), (40, 40), (0, -20)])
def test_text_at_and_beyond_edges(x, y):
    small = np.full((12, 20, 3), 7, np.uint8)
    wide = np.full((112, 120, 3), 7, np.uint8)
    captions.draw_text(wide, "Hi?", x + 60, y + 50, (1, 2, 3), ground=True)
    captions.draw_text(small, "Hi~", x, y, (1, 2, 3), ground=True)
    assert (small == wide[50:62, 60:80]).all()
    assert (captions.draw_text(small.copy(), "", 0, 0, (1, 2, 3)) == small).all()


def test_boxes_of_segments(spark, tmp_path):
    grey = np.arange(40 * 50, dtype=np.uint8).reshape(40, 50)
    images = spark.createDataFrame([("a", 50, 40, bytearray(grey.tobytes())), ("none", 50, 40, bytearray(grey.tobytes()))], "path string, w int, h int, data binary")
    rows = [("a", 1, (5, 20, 3, 30), "Dog 7"), ("a", 0, (30, 48, 2, 9), None), ("lost", 0, (0, 1, 0, 1), "x")]
    s = spark.createDataFrame(rows, "path string, segment_id int, rect struct<min_x:int,max_x:int,min_y:int,max_y:int>, name string")
    got = {r.path: np.frombuffer(r.data, np.uint8).reshape(40, 50, 3) for r in folders.segment_boxes(images, s, "name").collect()}
    want = np.stack([grey] * 3, 2)
    assert set(got) == {"a", "none"} and (got["none"] == want).all()
    image.draw_box(want, 30, 2, 48, 9, folders.BOX)
    image.draw_box(want, 5, 3, 20, 30, folders.BOX)
    lit = captions.strip("Dog 7")[::-1]
    for y, x in np.argwhere(lit):
        if 7 + x < 50:
            want[5 + y, 7 + x] = folders.BOX
    assert (got["a"] == want).all()
    assert folders.segment_boxes(images.limit(0), s).count() == 0 and folders.segment_boxes(images, s.limit(0)).count() == 2


def test_boxes_as_a_command(spark, tmp_path):
    from murmura import cli

    grey = np.zeros((80, 90), np.uint8)
    grey[10:60, 20:70] = 200
    mask = np.where(grey > 0, 255, 0).astype(np.uint8)
    for name, img in (("source", grey), ("masks", mask)):
        (tmp_path / name).mkdir()
        (tmp_path / name / "r.bmp").write_bytes(bmp.encode(img))
    cli.main(["segment-boxes", str(tmp_path / "source"), str(tmp_path / "masks"), str(tmp_path / "boxes")], spark)
    out = bmp.decode(next((tmp_path / "boxes").glob("*.bmp")).read_bytes())
    assert (out[10, 25] == folders.BOX).all() and (out[30, 20] == folders.BOX).all() and (out[5, 5] == 0).all()
