"""A small documents table with what real ones hold: nulls, copies, odd texts, clashing columns."""

import random

from pyspark.sql import types as T

SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()),
    T.StructField("text", T.StringType()),
    T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()),
    T.StructField("n_chars", T.LongType()),
    # names that the operators use themselves
    T.StructField("t", T.StringType()),
    T.StructField("part", T.LongType()),
    T.StructField("_row", T.StringType()),
    T.StructField("a.b", T.StringType()),
])


def prose(rng, words, n):
    return " ".join(rng.choice(words) for _ in range(n))


def rows(seed=1):
    """Texts by id; several ids share a text, one row is repeated, some values are null."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)] + ["é", "ß", "日本"]
    passage = prose(rng, words, 70)
    line = prose(rng, words, 12)
    texts = {}
    for i in range(40):
        texts[i] = "\n".join(prose(rng, words, rng.randint(3, 40)) for _ in range(rng.randint(1, 5)))
    long_line = prose(rng, words, 300)
    texts[3] = texts[1]
    texts[9] = texts[2] + " tail"
    for i in (5, 12, 20, 31):
        texts[i] += "\n" + passage + "\n" + line
    texts[13] += "\n" + line.replace(line.split()[4], "changed", 1)
    texts[14] += "\n" + " ".join(line.split()[:5] + line.split()[6:])
    texts[15] = long_line
    texts[16] = " ".join(long_line.split()[:150] + ["new"] + long_line.split()[150:])
    texts[17] = None
    texts[18] = ""
    texts[19] = " \n\t \n"
    texts[21] = "one two"
    texts[22] = "one two"
    texts[23] = "a" * 4000
    texts[24] = "same words " * 60
    texts[25] = "Write to jane@mail.example.com or +1 (555) 555-0100, host 10.0.0.1, card 4111 1111 1111 1111."
    out = [(i, t, "en", None if i % 7 == 0 else f"s{i % 3}", len(t or ""), "t", i, "r", "d") for i, t in texts.items()]
    out.append(out[6])
    out.append((None, texts[2], None, None, None, None, None, None, None))
    return out


def frame(spark, data=None, partitions=4):
    return spark.createDataFrame(rows() if data is None else data, SCHEMA).repartition(partitions)
