"""Small documents with every awkward case: nulls, empty and long texts, ties, repeated rows, clashing columns."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, body int, n double, cls string, key string, ids string, bucket string"


def make(rows):
    """(doc_id, text, source) rows with columns whose names operators use inside."""
    return [(i, t, "en", s, len(t or ""), "x", 1, 0.5, "c", "k", "i", "b") for i, t, s in rows]


def sentences(seed: int, n: int, words: int = 40) -> list[str]:
    rng = random.Random(seed)
    syllables = ["an", "the", "re", "ion", "st", "er", "wh", "ou", "lich", "é", "ñ", "ß"]
    vocabulary = ["".join(rng.choices(syllables, k=rng.randint(1, 3))) for _ in range(300)]
    return [" ".join(rng.choices(vocabulary, k=rng.randint(1, words))) for _ in range(n)]


def awkward(seed: int = 1, n: int = 40):
    texts = sentences(seed, n)
    rows = [(i, t, f"s{i % 3}" if i % 7 else "hot") for i, t in enumerate(texts)]
    rows += [
        (100, None, "s1"),
        (101, "", "s1"),
        (102, "   \n\t ", None),
        (103, "one", "s2"),
        (104, "日本 語 🙂 x  y\r\n z", "s2"),
        (105, " ".join(sentences(9, 1, 60) * 200), "hot"),
        (106, texts[0], "s0"),
        (107, texts[0], "s0"),
        (107, texts[0], "s0"),
        (None, texts[1], "s0"),
        (None, None, None),
        (-5, texts[2] + " end", "s9"),
        (2**40, "<|endoftext|> a <|endoftext|>", "s9"),
    ]
    return rows


def frame(spark, rows, parts: int = 3):
    df = spark.createDataFrame(make(rows), SCHEMA)
    return df.repartition(parts) if rows else df
