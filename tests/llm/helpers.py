import re

DOCS = "doc_id long, text string, lang string, source string, n_chars long, Score double, removed_lines string, Mix_size int, t string, digest_ string"
AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def frame(spark, rows):
    """Rows (doc_id, text, source) with columns whose names clash."""
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), 1.0, "x", 2, "y", "z") for i, t, s in rows], DOCS)


LONG = " ".join(f"w{i % 977}x{i}" for i in range(30_000))
#: Nulls, empty, white space, copies, a repeated row, one very long text, texts in several scripts.
MIXED = [
    (1, None, "a"), (2, "", None), (3, " \n\t ", "a"), (4, "one", "b"), (5, "one two three four five six seven", "b"), (6, "one two three four five six seven", "c"),
    (6, "one two three four five six seven", "c"), (None, "no id here at all in this one", "b"), (7, LONG, "a"), (8, "Élan vital — naïve café 𝒳 \\ </s>", None),
]
