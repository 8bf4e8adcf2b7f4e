"""Captions in images: letters of up to seventeen strokes, drawn into cells of 8x8 pixels.

A letter's form follows from the strokes that it is made of, as on a display with
fourteen segments; two dots and an upper mark serve punctuation. Small letters are the
large ones in the lower five rows.
"""

from __future__ import annotations

from functools import cache

import numpy as np

from murmura.functions.image import draw_line

#: A cell is square; a line of text has two more rows, so that captions can stand on a white ground.
CELL, LINE = 8, 10
#: The characters of captions, in the order of their numbers.
CHARACTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789.,'\"!?:*-+="
#: Each stroke's ends as x, y, x, y, row 0 uppermost.
STROKES = {
    "a": (0, 0, 6, 0), "b": (6, 0, 6, 3), "c": (6, 3, 6, 6), "d": (0, 6, 6, 6), "e": (0, 3, 0, 6), "f": (0, 0, 0, 3), "g": (0, 3, 3, 3), "h": (3, 3, 6, 3),
    "i": (0, 0, 3, 3), "j": (3, 0, 3, 3), "k": (6, 0, 3, 3), "l": (3, 3, 0, 6), "m": (3, 3, 3, 6), "n": (3, 3, 6, 6), "o": (3, 1, 3, 1), "p": (3, 6, 3, 6), "q": (3, 0, 3, 1),
}
#: The strokes of each character.
FORMS = {
    "A": "abcefgh", "B": "abcdhjm", "C": "adef", "D": "abcdjm", "E": "adefgh", "F": "aefg", "G": "acdefh", "H": "bcefgh", "I": "adjm", "J": "bcde", "K": "efgkn", "L": "def", "M": "bcefik",
    "N": "bcefin", "O": "abcdef", "P": "abefgh", "Q": "abcdefn", "R": "abefghn", "S": "acdfgh", "T": "ajm", "U": "bcdef", "V": "efkl", "W": "bcefln", "X": "ikln", "Y": "ikm", "Z": "adkl",
    "0": "abcdefkl", "1": "bck", "2": "abdegh", "3": "abcdh", "4": "bcfgh", "5": "adfgn", "6": "acdefgh", "7": "abc", "8": "abcdefgh", "9": "abcdfgh",
    ".": "p", ",": "l", "'": "q", '"': "bf", "!": "jp", "?": "abhp", ":": "op", "*": "ghijklmn", "-": "gh", "+": "ghjm", "=": "dgh",
}


def number(character: str) -> int:
    """A character's place among those that captions have."""
    if len(character) != 1 or character not in CHARACTERS:
        raise ValueError(f"captions have no {character!r}")
    return CHARACTERS.index(character)


def character(number: int) -> str:
    if not 0 <= number < len(CHARACTERS):
        raise ValueError(f"captions have no character {number}")
    return CHARACTERS[number]


@cache
def glyph(character: str) -> np.ndarray:
    """The lit pixels of a character's cell; a space has none."""
    cell = np.zeros((CELL, CELL), bool)
    if character == " ":
        return cell
    small = "a" <= character <= "z"
    for stroke in FORMS[character.upper()]:
        x0, y0, x1, y1 = (2 * v // 3 if small else v for v in STROKES[stroke])
        down = 2 if small else 0
        draw_line(cell, x0, y0 + down, x1, y1 + down, True)
    return cell


def strip(text: str) -> np.ndarray:
    """The lit pixels of a line of text. What captions have no form for is drawn as a question mark."""
    cells = [glyph(c if c == " " or c in CHARACTERS else "?") for c in text]
    return np.vstack([np.hstack(cells), np.zeros((LINE - CELL, CELL * len(cells)), bool)]) if cells else np.zeros((LINE, 0), bool)


def draw_text(img: np.ndarray, text: str, x: int, y: int, color, ground: bool = False, upwards: bool = False) -> np.ndarray:
    """Text from column x and row y on; what lies outside the image is left out.

    ``ground``: on white. ``upwards``: the image's row 0 is its lowest one, so the
    text stands on row y instead of hanging from it.
    """
    lit = strip(text)[::-1] if upwards else strip(text)
    top, left = max(-y, 0), max(-x, 0)
    lit = lit[top : max(img.shape[0] - y, top), left : max(img.shape[1] - x, left)]
    part = img[y + top : y + top + lit.shape[0], x + left : x + left + lit.shape[1]]
    if ground:
        part[...] = 255
    part[lit] = color
    return img
