"""Small tables with everything that may go wrong in them."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row int, gid string, fp long, x int, q string, rid long, _gone int, y int, n int"
WORDS = "alpha beta gamma delta omega river stone cloud Maple Cedar größe élan niño zwölf 42 x".split()


def texts(seed=7, n=40):
    rng = random.Random(seed)
    base = [" ".join(rng.choice(WORDS) for _ in range(rng.randint(1, 60))) for _ in range(n)]
    near = [b + " tail" for b in base[:6]]
    long = " ".join(rng.choice(WORDS) + str(rng.randint(0, 99)) for _ in range(30_000))
    odd = [None, "", " ", "\n\t", "a", "A", "ß", "\x00", "١٢", "😀 😀", "x" * 50_000, long, long + " End", long.upper(), base[0], base[0].upper(), base[0], base[1] + "!", "%%% !!! ###"]
    return base + near + odd


def documents(spark, rows=None):
    if rows is None:
        rows = [(i, t, ["en", "fr", None][i % 3], [None, "a", "b", "a", "a"][i % 5]) for i, t in enumerate(texts())]
        rows += [rows[0], rows[0], (None, "no id", "en", "a"), (None, None, None, None), (None, "no id", "en", "a"), (3, "another text on id three", "en", "b")]
    return spark.createDataFrame([(*r, len(r[1] or ""), 1, "g", 2, 3, "q", 4, 5, 6, 7) for r in rows], SCHEMA).repartition(3)


def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int, text string")
