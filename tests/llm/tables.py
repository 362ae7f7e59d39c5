"""Small tables with the awkward cases every operator has to take."""

import random

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, shard int, kept boolean, n_words string"


def documents(spark, texts, langs=None):
    """A documents table with further columns that clash with results; ids 0.. unless given as pairs."""
    rows = [t if isinstance(t, tuple) else (i, t) for i, t in enumerate(texts)]
    langs = langs or ["en"] * len(rows)
    return spark.createDataFrame(
        [(i, t, g, None, len(t or ""), 99, None, "x") for (i, t), g in zip(rows, langs)], SCHEMA
    )


def words(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def awkward(rng=None):
    """(doc_id, text): NULLs, empty and blank texts, repeats, ties, one long text."""
    rng = rng or random.Random(3)
    base = words(rng, 60)
    lines = "a line that comes back\nAnother Line here \n\nshort\n" + base
    return [
        (5, None),
        (None, base),
        (None, None),
        (7, ""),
        (8, " \t\n\x0b\n"),
        (9, base),
        (9, base),
        (3, base + " tail"),
        (4, lines),
        (2, lines.upper()),
        (6, "\r another line HERE\t\nnew text of its own, in one line"),
        (10, words(rng, 30_000, 20_000)),
        (11, "é" * 40 + " x \U0001f600 ÀÉ"),
        (12, "one"),
    ]
