"""Small tables with the awkward cases: nulls, empty and long texts, ties, repeated rows, clashing names."""

import random

WORDS = ["the", "of", "river", "stone", "über", "niño", "data", "cloud", "green", "seven", "walk", "paper", "éa", "light"]


def prose(seed: int, n: int) -> str:
    pick = random.Random(seed)
    return " ".join(pick.choice(WORDS) + ("." if pick.random() < 0.1 else "") for _ in range(n))


def documents(spark, rows=None):
    if rows is None:
        texts = [prose(i, 20 + 7 * i) for i in range(30)]
        texts += [None, "", " \t\n ", "one", "One two", texts[3], texts[3], texts[5].replace("river", "brook", 1), prose(99, 20_000), "☃" * 3000, "<|endoftext|> x"]
        rows = [(i, t, "en" if i % 3 else None, f"src{i % 4}", len(t) if t else None) for i, t in enumerate(texts)]
        rows += [rows[7], rows[7], (None, texts[9], None, None, None)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, shard int, key string, part int, fp string, n_hit string, score string, found int, w int"
    return spark.createDataFrame([(*r, 1, "k", 2, "f", "h", "s", 3, 4) for r in rows], schema)
