import random

import pytest

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng: random.Random, n: int, vocabulary: int = 3000) -> list[str]:
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def as_docs(spark, rows):
    """rows: (doc_id, text) or (doc_id, text, source); lang, source and n_chars are made up."""
    full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or "")) for r in rows]
    return spark.createDataFrame(full, DOC)


#: Nulls, empty and very long texts, ties and repeated rows, odd white space and letters.
ODD = [
    (1, None), (2, ""), (3, " \t\n "), (None, "no id here at all but words"), (4, "one"), (5, "one"), (5, "one"), (6, "x " * 30_000), (7, "café   naïve word \U0001f600 <|endoftext|> end"),
    (8, "A b\x0bc\x0cd\re\r\nf\x1cg\x85h"), (9, "same text over and over same text over and over same text over and over"), (10, "same text over and over same text over and over same text over and over"),
]


@pytest.fixture(scope="session")
def odd(spark):
    return as_docs(spark, ODD).cache()


@pytest.fixture(scope="session")
def corpus():
    """Random texts with exact copies, near copies of several strengths, and shared passages."""
    rng = random.Random(5)
    out = [(i, " ".join(words(rng, rng.randint(3, 120)))) for i in range(60)]
    passage = words(rng, 30)
    for i in range(60, 75):
        out.append((i, " ".join(words(rng, 20) + passage + words(rng, 10))))
    base = words(rng, 150)
    for i in range(75, 135):  # near copies without their original: only some link
        copy = list(base)
        for _ in range(i % 7):
            copy[rng.randrange(150)] = f"n{rng.randrange(10**6)}"
        out.append((i, " ".join(copy)))
    out += [(i, out[i % 60][1]) for i in range(135, 150)]
    rng.shuffle(out)
    return out
