"""Small tables with every awkward case, for all operators."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, text_sha256 string, score double, kept boolean, salt int, component_id long, row string, topic string"


def words(seed, n):
    rng = random.Random(seed)
    return " ".join("".join(rng.choices("abcdefghij", k=rng.randint(1, 7))) for _ in range(n))


LONG = words(99, 30_000)
TEXTS = [
    (1, words(1, 60)), (2, words(1, 60)), (3, "  " + words(1, 60).replace(" ", "\n")), (4, None), (5, ""), (6, " \t\n"), (7, LONG), (8, LONG + " tail end of it"),
    (9, "one two"), (10, "ONE  two"), (11, words(2, 60) + " " + words(3, 30)), (12, words(4, 40) + " " + words(3, 30)), (13, words(1, 60)), (13, words(1, 60)),
    (None, "no identifier here at all, " + words(5, 20)), (14, "naïve café 中文 ½ \x1c don't 'll  <|endoftext|> x"), (15, "a" * 5000), (16, "ab " * 700), (17, words(6, 80)), (18, words(6, 79) + " changed"),
]


def documents(spark, rows=TEXTS):
    full = [(i, t, None if i == 9 else "en", None if i == 10 else f"src{(i or 0) % 2}", 1, "x", 0.5, True, 3, -1, "r", "t") for i, t in rows]
    return spark.createDataFrame(full, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def clean(rows=TEXTS):
    """Rows with an identifier, texts as they count."""
    return [(i, t or "") for i, t in rows]
