"""Small tables for the operators: odd texts, nulls, ties, repeated rows, names that could clash."""

import random

from pyspark.sql import DataFrame, SparkSession

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size int, tag string, row string, fp long, kept boolean, digest string, score double"
SF = "/root/testdata/sf0.001"


def passage(rng: random.Random, n: int, vocabulary: int = 400) -> str:
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def texts() -> list[tuple]:
    rng = random.Random(5)
    shared = passage(rng, 60)
    base = passage(rng, 120)
    out = [
        (1, "", None), (2, None, "b"), (3, " \t\n\x0b\x0c\r ", "b"), (4, "one", "a"), (5, "Two words", None), (6, "a b c", "é"), (7, "a b c d", "é"),
        (8, base, "a"), (9, base, "a"), (10, base.replace(" ", "\n ", 7), "b"), (11, base.upper(), "c"), (12, base + " tail", "a"),
        (13, passage(rng, 30) + " " + shared + " " + passage(rng, 30), "a"), (14, shared + "\n" + shared, "b"), (15, "x " * 50, "b"),
        (16, "naïve café straße   \U0001f600\U0001f468‍\U0001f469 日本語 " * 4, "c"), (17, passage(rng, 9000, 5000), "a"), (18, "z" * 5000, "a"),
        (19, "it's we'll I'd 12345 67.8\r\n\r\n   \t tail  ", "c"), (20, "\x1c\x1d\x85 sep\x1ear", "c"),
    ]
    out += [(21, base, "a"), (21, base, "a"), (None, shared, "a"), (None, base, "b")]
    for i in range(30, 90):
        out.append((i, passage(rng, rng.randrange(1, 300)), rng.choice(["a", "b", "c", None, "é"])))
    return out


def table(spark: SparkSession, rows=None) -> DataFrame:
    rows = texts() if rows is None else rows
    return spark.createDataFrame([(i, t, "en", s, 1, 7, "t", "r", 9, True, "d", 0.5) for i, t, s in rows], SCHEMA).repartition(3)


def write(spark: SparkSession, folder, rows=None, **more: DataFrame) -> str:
    table(spark, rows).write.parquet(f"{folder}/documents.parquet")
    for name, df in more.items():
        df.write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def documents(spark: SparkSession, sf_dir: str) -> list[tuple]:
    return [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source").collect()]


def key(row) -> str:
    return repr(tuple(row))
