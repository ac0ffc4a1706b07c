"""Small tables with what operators must stand: nulls, empty and very long texts, ties, repeats, clashing columns."""

from __future__ import annotations

import os
import random
import shutil
import tempfile

WORDS = "the of and ring tone able under north mit license by sea lane corn vale oak elm stone river hill".split()


def prose(seed: int, n: int) -> str:
    draw = random.Random(seed)
    return " ".join(draw.choice(WORDS) + draw.choice(["", "", "", "s", "ed", "ing", ".", ","]) for _ in range(n))


LONG = prose(1, 4000)
BASE = prose(2, 300)
NEAR = BASE.replace(" ", "  ", 1)
EDIT = " ".join(w if i != 150 else "changed" for i, w in enumerate(BASE.split(" ")))
PASSAGE = prose(3, 40)
LICENSE = "Licensed under CC BY-NC 4.0. Released under the MIT License, cc by nc cc by nc."

TEXTS: list[tuple[int | None, str | None, str | None, str | None]] = [
    (1, None, "en", "a"),
    (2, "", "en", "a"),
    (3, " \n\t ", None, None),
    (4, LONG, "en", "a"),
    (5, LONG, "en", "a"),
    (6, BASE, "de", "b"),
    (7, NEAR, "de", "b"),
    (8, EDIT, None, "b"),
    (9, BASE, "de", ""),
    (9, BASE, "de", ""),
    (10, prose(4, 60) + " " + PASSAGE + " " + prose(5, 60), "fr", None),
    (11, "Été à l’œuvre ﬁn 中文字 K İ ẞ\x85x\x1cy " + PASSAGE, "fr", "c"),
    (12, "a\nb\nc\nd\na\nb\nc\ne\na\nb\nc\nd", "xx", "c"),
    (13, "\n\n\n\n", "xx", "c"),
    (14, LICENSE + "\n" + prose(6, 20), "en", "d"),
    (15, "x" * 700, "en", "d"),
    (16, "one", "en", "d"),
    (17, "$$$ *** ### " * 40, "en", "d"),
    (None, BASE, "en", None),
    (None, None, None, None),
    (18, prose(7, 200), "en", "d"),
    (19, prose(7, 200), "en", "a"),
]
# Names that operators use inside.
CLASHING = (
    "size row words spans items kept band n_words limits id tie tie2 copies anchor node fingerprint bands component "
    "text_hash lines starts rank target level n_tokens start html payload"
).split() + ["two words", "a-b,c", "dotted.name", "tick`ed"]


def documents(spark, rows=None):
    """The odd documents with extra columns; empty if ``rows`` is an empty list."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(
        f"`{c.replace('`', '``')}` string" for c in CLASHING
    )
    rows = TEXTS if rows is None else rows
    full = [(*r, len(r[1] or ""), *("clash" for _ in CLASHING)) for r in rows]
    return spark.createDataFrame(full, schema)


def folder() -> str:
    return tempfile.mkdtemp(prefix="run-")


def drop(path: str) -> None:
    if os.path.basename(path).startswith("run-"):
        shutil.rmtree(path, ignore_errors=True)
