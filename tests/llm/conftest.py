import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, spans string, n_words long"
SF = "/root/testdata/sf0.001"


def corpus() -> list[tuple]:
    """Texts with copies, near copies, shared passages, nulls, empty and very long texts, and repeated rows."""
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdeéß") for _ in range(rng.randint(1, 8))) for _ in range(300)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passage, base = text(70), text(200).split()
    out: list[tuple] = []
    add = lambda t, lang="en": out.append((len(out), t, lang, "s", None, "x", -1))
    for n in (0, 1, 3, 4, 5, 49, 50, 51, 120, 400):
        add(text(n))
    for _ in range(6):
        near = list(base)
        for _ in range(rng.randint(0, 3)):
            near[rng.randrange(len(near))] = rng.choice(words)
        add(" ".join(near), "fr")
    for _ in range(5):
        add(f"{text(30)} {passage}\n{text(20)}")
    for _ in range(4):
        add(out[8][1])
    add(passage)
    add(None, None)
    add("", None)
    add(" \t\n\x0b", "de")
    add("12 34 -- !!", "de")
    add(text(6000), "fr")
    add("x" * 30_000, "en")
    add("Mail a.b@c-d.org or +1 (017) 555-7713, card 4111 1111 1111 1111, host 10.0.0.255 not 10.0.0.256 İÉ 漢字", "de")
    out.append(out[9])
    out.append((None, out[9][1], None, None, None, None, None))
    out.append((None, None, None, None, None, None, None))
    return out


@pytest.fixture(scope="session")
def rows():
    return corpus()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
