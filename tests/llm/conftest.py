import random

import pytest

#: A text in each odd form: missing, empty, gaps only, one word, not ASCII, long, line ends.
ODD_TEXTS = [
    None,
    "",
    " \t\n",
    "word",
    "Größe ▁ naïve \U0001f600 ñandú",
    "x" * 30_000,
    "a b\r\nc\x0bd\x0ce\tf",
    "again " * 3_000,
    "\x1c odd \x85 signs   here",
]


@pytest.fixture(scope="session")
def corpus():
    """Random texts with copies, near copies, shared passages and ties: (id, text) rows."""
    rng = random.Random(5)
    words = ["".join(rng.choices("abcdefgh", k=rng.randint(1, 7))) for _ in range(300)]
    prose = lambda n: " ".join(rng.choices(words, k=n))
    texts = [prose(rng.randint(1, 260)) for _ in range(60)]
    passage = prose(80)
    texts += [f"{prose(20)} {passage} {prose(rng.randint(1, 40))}" for _ in range(12)]
    for t in texts[:10]:
        parts = t.split()
        parts[len(parts) // 2] = "changed"
        texts += [t, " ".join(parts)]
    texts += [prose(30) * 12]
    rng.shuffle(texts)
    return [(7 * i + 3, t) for i, t in enumerate(texts)]


@pytest.fixture(scope="session")
def rough(corpus):
    """The corpus, odd texts, a repeated row, rows without id, and two rows of one id."""
    rows = corpus + [(5000 + i, t) for i, t in enumerate(ODD_TEXTS)]
    return rows + [corpus[0], (None, corpus[1][1]), (None, "no id here"), (corpus[2][0], "same id")]


@pytest.fixture(scope="session")
def make(spark):
    """A documents table from (id, text) rows, with columns whose names clash with working ones."""

    def build(rows, partitions=3):
        full = [
            (i, t, "de", None if (i or 0) % 5 == 0 else f"src{(i or 0) % 3}", len(t or ""), "k", 1)
            for i, t in rows
        ]
        schema = (
            "doc_id bigint, text string, lang string, source string, n_chars bigint, "
            "kept string, mark int"
        )
        return spark.createDataFrame(full, schema).repartition(partitions)

    return build


@pytest.fixture(scope="session")
def table(spark, make, tmp_path_factory):
    """Folder with a documents table of the rows, as queries read it."""

    def write(rows):
        folder = tmp_path_factory.mktemp("tables")
        make(rows).write.parquet(f"{folder}/documents.parquet")
        return str(folder)

    return write
