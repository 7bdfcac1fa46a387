from __future__ import annotations

import random

import pytest

# Names that the operators use inside; documents may bring columns of the same names.
CLASHING = ["row", "at", "id", "digest", "size", "kept", "fp", "n", "draws", "tokens", "anchors", "__row", "file"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(
    f"`{c}` string" for c in CLASHING
)


def words(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choice("abcdeé") for _ in range(rng.randint(2, 7))) for _ in range(n))


def messy_rows() -> list[tuple]:
    rng = random.Random(5)
    passage, long, base = words(rng, 120), words(rng, 30_000), words(rng, 90)
    texts = [
        (1, "Aa b\tC"), (1, "Aa b\tC"), (2, None), (3, ""), (None, "Aa b\tC"), (None, None), (4, long),
        (5, words(rng, 30) + " " + passage + " " + words(rng, 20)), (6, words(rng, 10) + "\n" + passage),
        (7, words(rng, 30) + " " + passage), (8, base), (9, base), (10, base + " tail"), (None, base), (11, "x " * 400),
        (12, long[:200_000]), (13, " \n\t "), (14, "<|endoftext|> it's 12 " + words(rng, 60)), (4, words(rng, 70)),
        (15, passage), (16, passage), (16, passage),
    ]
    out = []
    for i, (key, text) in enumerate(texts):
        source = [None, "s1", "s2", "s1"][i % 4]
        out.append((key, text, "en" if i % 3 else None, source, len(text or ""), *["?"] * len(CLASHING)))
    return out


@pytest.fixture(scope="session")
def messy(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("messy") / "documents.parquet")
    spark.createDataFrame(messy_rows(), SCHEMA).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def none(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("none") / "documents.parquet")
    spark.createDataFrame([], SCHEMA).write.parquet(path)
    return spark.read.parquet(path)
