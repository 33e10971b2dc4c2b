import random

#: Texts that trip things up: empty, white space only, one word, ties, non-ASCII, controls, long.
TEXTS = [None, "", " ", "\n\n", "word", "Two words", "a\tb\x0bc\x0cd\re\nf", "é ß 日本語 𝒳 é", "x" * 5000, "A a A a A a A a A a A a", "one two three four five six seven eight nine ten eleven twelve " * 60]


def random_texts(n, seed, words=60):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    return [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, words))) for _ in range(n)]


def edge_docs(spark):
    """documents with nulls in every column, repeated rows and further columns whose names clash with results and inputs."""
    rows = [(i, t, "en", "s", 1, True, 5, "T") for i, t in enumerate(TEXTS)]
    rows += [(None, "null id", None, None, None, None, None, None), (3, "again", "de", "t", 2, False, 1, "U"), (3, "again", "de", "t", 2, False, 1, "U"), (7, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, kept boolean, n_words long, TEXT string")
