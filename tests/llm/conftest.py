import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, component_id string, size string, score string"


def docs_of(spark, rows):
    """rows: (doc_id, text[, lang, source]); the last three columns have names that operators use themselves."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "s", len(r[1] or ""), "x", "y", "z") for r in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def corpus():
    """Random documents with copies, near copies, shared passages, odd texts and edge cases."""
    rng = random.Random(5)
    words = ["w%d" % k for k in range(900)] + ["The", "the", "of,", "And.", "été", "ÉTÉ", "naïve", "a b", "x​y", "語"]
    passage = [rng.choice(words) for _ in range(60)]
    rows, texts = [], []
    for k in range(150):
        kind = rng.random()
        if texts and kind < 0.12:
            text = rng.choice(texts)
        elif texts and kind < 0.35:
            w = rng.choice(texts).split(" ")
            for _ in range(max(1, len(w) // rng.choice([15, 25, 60]))):
                w[rng.randrange(len(w))] = rng.choice(words)
            text = " ".join(w)
        else:
            w = [rng.choice(words) for _ in range(rng.choice([3, 8, 20, 60, 200, 400]))]
            if kind > 0.8:
                at = rng.randrange(len(w) + 1)
                w[at:at] = passage[: rng.choice([34, 35, 36, 60])]
            text = rng.choice([" ", " ", "\n", "\t ", "\x0b"]).join(w)
        texts.append(text)
        rows.append((k * 3, text))
    rows += [(1001, None), (1002, ""), (1003, " \n\t"), (1004, "one"), (1005, "one two three four"), (1006, "one two three four"), (1007, "ONE two three four"), (1008, "!!! ... 123"), (None, "a null id " * 9), (1010, "very " * 30000 + "long"), (1011, rows[5][1]), (1011, rows[5][1]), (1012, "a b c d e f g h")]
    return rows
