"""Documents with the awkward cases that every operator must take: nulls, blanks, ties, repeats, a very long text."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, keep string, h1 int, n_lines string, _tokens string, node string"

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "s", "x1", ",", "."]) for _ in range(n))


def rows():
    rng = random.Random(4)
    base = [prose(rng, rng.choice([3, 8, 40, 120])) for _ in range(40)]
    texts = base + [None, "", " \n\t ", "!!!", "a", "\n\n", base[0], base[0], base[3].upper(), prose(rng, 9000), "é" * 50 + " Straße ñandú", "one\r\ntwo\nthree"]
    near = base[7].split() or ["x"]
    for k in range(12):
        w = list(near)
        w[rng.randrange(len(w))] = "changed%d" % k
        texts.append(" ".join(w))
    out = [(i, t, ["en", "de", None][i % 3], ["src0", "src1", None, "src0"][i % 4], len(t or ""), "x", 1, "y", "z", "q") for i, t in enumerate(texts)]
    out.append(out[5])  # a repeated row
    out.append((None, "a text without an id", "en", "src1", 20, "x", 1, "y", "z", "q"))
    return out


def documents(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
