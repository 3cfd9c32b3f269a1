"""Texts and tables for the tests of this folder."""

import random

import pytest


def prose(rng: random.Random, words: int, vocabulary: int = 400) -> str:
    return " ".join("".join(rng.choices("abcdefgh", k=2 + rng.randrange(vocabulary) % 5)) for _ in range(words))


#: names that the operators use themselves
EXTRA = ("id", "h", "fp", "ord", "bucket", "key", "sha", "component", "again", "size", "target", "leaf", "grp", "weak_label",
         "licence", "node", "root", "digest", "n", "text for scoring", "m_key", "stay_id", "gone_id", "len")


@pytest.fixture(scope="session")
def frame(spark):
    """Rows (doc_id, text, source) as a table with columns whose names clash with the operators' own."""

    def make(rows, parts=3):
        rows = [(*r, "src")[:3] for r in rows]
        df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(parts)
        for k, name in enumerate(EXTRA):
            df = df.selectExpr("*", f"{k} as `{name}`")
        return df

    return make


@pytest.fixture(scope="session")
def edge_rows():
    """Nulls, empty and blank texts, copies, near copies, a long text, repeated rows and non-ASCII."""
    rng = random.Random(17)
    base = [prose(rng, rng.choice([1, 3, 4, 5, 30, 80])) for _ in range(40)]
    rows = [(10 + 3 * i, t) for i, t in enumerate(base)]
    rows += [(500, None), (501, ""), (502, " \t\n\x0b "), (503, "É ñ ü ß 中文 ça"), (504, "Word " * 3000), (505, prose(rng, 8000))]
    for k in range(12):
        rows.append((600 + k, base[5]))
        words = base[7].split()
        words[k % len(words)] = "changed"
        rows.append((700 + k, " ".join(words)))
    rows += [(500, None), rows[3], rows[3]]
    return [(i, t, None if i % 7 == 0 else f"s{i % 4}") for i, t in rows]
