import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _id long, size long, bucket string, n_lines string, score string"


def corpus(seed: int = 0, n: int = 60) -> list[tuple]:
    """Texts with copies, near copies, shared lines and passages, nulls, blanks, odd characters and one long text."""
    r = random.Random(seed)
    words = ["".join(r.choice("abcdeéñüAB") for _ in range(r.randint(1, 7))) for _ in range(120)]
    line = lambda k: " ".join(r.choice(words) for _ in range(k)).capitalize() + "."
    shared, passage = [line(9) for _ in range(3)], line(30)
    texts: list[str | None] = [None, "", " \t\n\x0b\x0c\r ", "\n", "a", "one two three", "\x00 b \x1c c\x85 d", passage, passage, line(14), "x" * 200, "Der " * 60, "<|endoftext|> don't STOP"]
    for _ in range(n):
        parts = [line(r.randint(3, 25)) for _ in range(r.randint(1, 4))]
        if r.random() < 0.4:
            parts.insert(r.randint(0, len(parts)), r.choice(["", "  ", "\t"]) + r.choice(shared) + r.choice(["", "  "]))
        if r.random() < 0.3:
            parts.append(passage)
        texts.append("\n".join(parts))
        if r.random() < 0.2:
            texts.append(texts[-1])
        if r.random() < 0.2:
            texts.append(texts[-1] + " tail")
    texts.append("\n".join(line(40) for _ in range(300)))
    rows = [(3 * i, t, r.choice(["en", "de", None]), r.choice(["s1", "s1", "s1", "s2", "é", None]), len(t or ""), -i, i, "b", "x", "y") for i, t in enumerate(texts)]
    r.shuffle(rows)
    return [*rows, rows[0], rows[5], rows[5]]  # repeated rows


@pytest.fixture(scope="session")
def rows():
    return corpus()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5).cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
