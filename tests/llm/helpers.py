from __future__ import annotations

import os
import random

import pytest

#: Columns whose names the operators use inside; they must not get in the way.
CLASHES = ["key", "digest", "n", "entry", "comp", "zone", "bucket", "block", "words", "score", "label", "batch_id", "kept", "term", "_range", "_guest", "_turn", "next_text", "tokens", "row"]

SMALL = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(SMALL), reason="the driver's tables are not here")


def edge_rows() -> list[tuple[int | None, str | None]]:
    """Nulls, empty and blank texts, a very long text, a very long word, ties and repeated rows."""
    rng = random.Random(3)
    long_text = " ".join(rng.choice(["alpha", "beta", "gamma", "delta,", "eps."]) + str(rng.randint(0, 999)) for _ in range(30_000))
    base = "the quick brown fox jumps over the lazy dog and runs away from the big bad wolf again"
    return [
        (None, "a text without an id, which is one of two"),
        (None, "another text without an id, which is one of two"),
        (1, None),
        (2, ""),
        (3, " \t\n\r "),
        (4, long_text),
        (5, "x" * 20_000),
        (6, base),
        (7, base),
        (7, base),
        (8, base.replace(" ", "  \n")),
        (9, base + " extra"),
        (10, "Ünïcödé ΣΑΣ İstanbul 漢字 😀 naïve café"),
        (10, "the same id with another text"),
        (11, "one two"),
        (12, "One  two"),
        (13, "a\x00b \x1f c"),
        (14, "\nfirst line\n\nthird line. Under the MIT License. <|endoftext|> it's\n"),
    ]


def edge_frame(spark):
    rows = [(i, t, *range(len(CLASHES))) for i, t in edge_rows()]
    return spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"`{c}` int" for c in CLASHES)).repartition(3)


def empty_frame(spark):
    return edge_frame(spark).where("false")


def labels_frame(spark, rows=()):
    return spark.createDataFrame(list(rows), "doc_id long, quality int, toxic int")


def same_rows(got, expected) -> None:
    order = lambda x: tuple((v is not None, v) for v in x)
    assert sorted(map(tuple, got), key=order) == sorted(map(tuple, expected), key=order)
