"""Documents with nulls, empties, ties, copies, long texts, repeated rows and a column that clashes with the operators' own."""

import random

D = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key long, node long"


def rows(seed=1):
    rng = random.Random(seed)
    vocab = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyzéß") for _ in range(rng.randint(2, 8))) for _ in range(300)]
    line = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    shared, base = line(30), [line(rng.randint(8, 40)) for _ in range(6)]
    texts = [None, "", " \n\t ", "x", "One two", line(5000), "\n".join(base), "\n".join(base), "\n".join(base).upper(), "a " * 60]
    texts += [f"{line(10)}\n{shared}\n{line(10)}" for _ in range(5)]
    for _ in range(5):
        words = "\n".join(base).split(" ")
        words[rng.randrange(len(words))] = "changed"
        texts.append(" ".join(words))
    texts += [line(rng.randint(1, 60)) for _ in range(10)]
    out = [(i, t, "en" if i % 2 else "fr", "src0", len(t or ""), i % 3, 7) for i, t in enumerate(texts)]
    return [*out, (None, "\n".join(base), None, None, None, None, None), (None, None, None, None, None, None, None)]


def docs(spark, data=None):
    return spark.createDataFrame(rows() if data is None else data, SCHEMA).repartition(3)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
