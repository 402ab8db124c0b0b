import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, w string, h string, key string, block string, row string, score double, length long"


def make(spark, rows):
    """Documents with further columns whose names operators use inside."""
    full = [(i, t, None, "s", None if t is None else len(t), "w", None, "k", None, "r", 0.5, 7) for i, t in rows]
    return spark.createDataFrame(full, SCHEMA)


@pytest.fixture(scope="session")
def nasty(spark):
    r = random.Random(4)
    words = [f"{a}{b}{c}" for a in ("ba", "ko", "ti", "né") for b in ("ra", "lo", "x") for c in ("s", "m", "tu")]
    long = " ".join(r.choice(words) + r.choice(["", "", ".", ",", ". The", ".\nAnd"]) for _ in range(30_000))
    base = " ".join(r.choice(words) for _ in range(120))
    rows = [
        (1, "The cat sat. A dog ran.\nThe cat sat. A dog ran."), (2, ""), (3, None), (4, "  \t\n "), (5, "one"), (6, "one two"),
        (7, long), (8, base), (9, base.replace(" ", "  ")), (10, base + " end"), (11, base), (11, base), (None, base), (None, "alone"),
        (12, "a b c a b c a b c d\n\nx#y$ %\nx#y$ %"), (13, "数据 处理 🙂 e\u0301 \x1c odd\u00a0space\u3000wide"), (14, "x" * 3000), (15, "Released under the MIT License.\nmit"),
        (16, "é" * 400 + " " + "9" * 300), (17, "it's   a\n\n\n  don't <|endoftext|> ok"),
    ]
    return make(spark, rows)


@pytest.fixture(scope="session")
def nothing(spark):
    return make(spark, [])
