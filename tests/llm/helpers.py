"""Small tables with the rows that operators must bear, and brute-force parts."""

from __future__ import annotations

import re

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _text string, _id long, words int"
WHITE = re.compile(r"[\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text: str | None) -> list[str]:
    return [w for w in WHITE.split(text or "") if w]


PROSE = (
    "The river rose over the old stones and the people of the town carried sand to the wall before night came. "
    "Nobody had seen such water in the valley since the bridge was built by hands now long forgotten."
)
LONG = " ".join(f"word{i % 7919}" for i in range(60_000))
TEXTS = [
    (1, PROSE, "en", "b"),
    (2, PROSE, "en", "a"),  # a copy
    (3, PROSE.replace(" ", " \t\n", 3), "en", "b"),  # a copy but for white space
    (4, PROSE + " Then it fell.", "en", None),  # a near copy
    (5, None, "en", "a"),
    (6, "", None, "a"),
    (7, " \n\t", "de", "c"),
    (8, "zwei Worte", "de", "c"),
    (9, LONG, None, "b"),
    (None, PROSE.upper(), "en", "b"),  # no id, equal but for case
    (11, "### $$$ %%% &&& ||| <<< >>> *** ### $$$ %%% &&&", "en", "d"),
    (12, "ein zwei drei vier fünf " * 6, "de", "a"),  # windows that repeat
    (12, "ein zwei drei vier fünf " * 6, "de", "a"),  # a row that repeats
    (13, "Zeile mit Wort\nZeile mit Wort\n\n  \nZeile mit Wort\nandere Zeile hier steht noch mehr", "de", "a"),
    (14, "été naïve İstanbul Σίσυφος é <|endoftext|> it's 123 中文", "fr", "a"),
]


def fixture(spark, rows=TEXTS):
    """Documents with columns whose names operators might use themselves."""
    return spark.createDataFrame(
        [(i, t, lang, source, len(t or ""), "extra", 7, 3) for i, t, lang, source in rows], SCHEMA
    ).repartition(3)
