"""Small article tables, with every odd case the jobs have to stand."""

import random

SCHEMA = "url long, content string, language string, label int, digest string, size string, row long, n int, word string, term string, fp string, score string, node string"

_SYLLABLES = {"en": "the an er in on th re ing ion ly".split(), "de": "der die sch ein ung keit heit ver ge ach".split()}


def text(rng: random.Random, language: str = "en", words: int = 80) -> str:
    s = _SYLLABLES[language]
    return " ".join("".join(rng.choice(s) for _ in range(rng.randint(1, 4))) for _ in range(words)).capitalize() + "."


def contents(n: int = 60, seed: int = 1) -> list[tuple[str | None, str | None]]:
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        language = ("en", "de")[i % 2]
        rows.append((text(rng, language, rng.randint(5, 200)), language))
    rows[7] = rows[3]
    rows[11] = rows[3]
    rows += [(None, "en"), ("", None), ("   \n", "de"), ("12 34 !!", "en"), ("x", None), ("Öl ÄRGER 日本語 😀 " * 40, "de"), ("word " * 60_000, "en"), (None, None)]
    return rows


def articles(spark, n: int = 60, seed: int = 1):
    """Rows with nulls, equal texts, a repeated row, a null url, a long text and columns with clashing names."""
    rows = [(i, c, lang, i % 2, "d", "s", 1, 1, "w", "t", "f", "s", "n") for i, (c, lang) in enumerate(contents(n, seed))]
    rows += [rows[5], (None, "no url here", "en", 1, *([None] * 9)), (None, None, None, None, *([None] * 9))]
    return spark.createDataFrame(rows, SCHEMA)


def no_articles(spark):
    return spark.createDataFrame([], SCHEMA)
