"""Small documents with the cases that every operator must handle."""

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
CLASHING = ", row string, _id string, _text string, size long, ids string, fp long, score double, spans string, taken long"


def prose(seed: int, words: int) -> str:
    import random

    own = random.Random(seed)
    parts = ["tion", "er", "an", "th", "ed", "es", "ing", "on", "ble", "ha"]
    text = [("".join(own.choice(parts) for _ in range(own.randrange(1, 4)))) for _ in range(words)]
    return " ".join(text).capitalize() + "."


def awkward_rows():
    """Nulls, empty, blank and long texts, repeated rows, a null id, non-ASCII text."""
    long = prose(1, 4000)
    rows = [
        (1, prose(2, 60), "en", "a", 10), (2, prose(2, 60), "en", "b", 10), (3, None, None, None, None),
        (4, "", "en", "a", 0), (5, " \t\n ", "en", "a", 4), (6, long, "en", "b", len(long)),
        (7, "naïve 日本語 \u0301 🎉 " * 20, "fr", None, 3), (8, "x", "en", "c", 1), (8, "x", "en", "c", 1),
        (9, "a" * 500, "en", "c", 500), (None, prose(3, 30), "en", "a", 2), (10, prose(2, 60) + " Tail.", "de", "a", 1),
    ]
    return rows


def docs(spark, rows=None, clashing=False):
    rows = awkward_rows() if rows is None else rows
    if clashing:
        return spark.createDataFrame([(*r, "r", "i", "t", 1, "i", 2, 0.5, "s", 3) for r in rows], DOCS + CLASHING)
    return spark.createDataFrame(rows, DOCS)


def empty(spark):
    return spark.createDataFrame([], DOCS)
