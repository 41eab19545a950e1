import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, fp long, bucket int, kept boolean, hit_spans string"


def document_rows(seed: int = 3, n: int = 120) -> list[tuple]:
    """Texts with copies, near copies, shared passages, nulls, empties, odd bytes and one long text."""
    rng = random.Random(seed)
    vocabulary = ["Alpha", "beta", "gamma,", "délta", "eps#", "zeta|", "été", "naïve", "x1", "longer-word", "THE", "the", "of", "日本", "emoji😀"]
    words = lambda k: [rng.choice(vocabulary) + (str(rng.randrange(40)) if rng.random() < 0.5 else "") for _ in range(k)]
    passage = words(45)
    texts: list[str | None] = []
    for _ in range(n):
        w = words(rng.choice([3, 19, 20, 21, 60, 150]))
        if rng.random() < 0.25:
            at = rng.randrange(len(w) + 1)
            w[at:at] = passage[: rng.choice([7, 20, 30, 45])]
        texts.append(rng.choice([" ", "  ", "\n", "\t"]).join(w))
    texts += [texts[0], texts[0], texts[1], texts[5] + " tail", None, None, "", "   \n\t ", "one", "a " * 400, "\u00a0nbsp\u2003em", "A B c " * 9, " ".join(words(6000))]
    rows = [(3 * i, t, "en" if i % 3 else None, f"src{i % 2}", None if t is None else len(t), 7, 1, False, "x") for i, t in enumerate(texts)]
    rows.append(rows[2])  # a repeated row
    rows.append((None, "an id that is null " * 8, "de", "s", 1, 0, 0, True, None))
    return rows


@pytest.fixture(scope="session")
def rows():
    return document_rows()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
