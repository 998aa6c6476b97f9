"""Rows that every operator must survive, and small helpers."""

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def corpus(seed=1, n=60):
    """Short texts with copies, repeated lines, nulls, empty and long texts."""
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefghijkl") for _ in range(rng.randint(2, 8))) for _ in range(300)]
    line = lambda k: " ".join(rng.choice(words) for _ in range(k))
    shared = [line(8) for _ in range(4)]
    out = []
    for i in range(n):
        lines = [line(rng.randint(1, 12)) for _ in range(rng.randint(1, 5))]
        if i % 3 == 0:
            lines.insert(rng.randint(0, len(lines)), rng.choice(["", " ", "\t"]) + rng.choice(shared).title())
        out.append((i, "\n".join(lines)))
    out += [(100, out[5][1]), (101, out[5][1].replace(" ", "  ")), (102, out[5][1] + "\n"), (103, None), (104, ""), (105, " \n\t "),
            (106, "É" + out[7][1]), (107, "word " * 20000), (108, "\n".join([line(6)] * 50)), (109, out[9][1])]
    return out


def documents(spark, rows, extra=True):
    """A table with columns whose names operators use themselves."""
    df = spark.createDataFrame([(i, t, "en", None, len(t or "")) for i, t in rows], DOCS)
    if not extra:
        return df
    from pyspark.sql import functions as F

    for c in ("n", "size", "digest", "fp", "batch", "key", "h1", "base", "rest", "row", "score", "_gone", "_id", "_base", "r1"):
        df = df.withColumn(c, F.lit(7))
    return df


def by_id(df, *columns):
    return sorted((tuple(r[c] for c in ("doc_id", *columns)) for r in df.collect()), key=str)
