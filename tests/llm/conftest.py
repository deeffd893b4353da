"""Small corpora for the corpus operators."""

from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, node long, token long, label int, copies long"


def words(rng: random.Random, n: int) -> list[str]:
    return ["".join(rng.choice("bdfgklmnprst") + rng.choice("aeiou") for _ in range(rng.randint(1, 4))) for _ in range(n)]


@pytest.fixture(scope="session")
def texts() -> list[tuple]:
    """Documents with copies, near copies, shared passages, a hot source, nulls, empty and long texts, repeated rows."""
    rng = random.Random(7)
    base = [words(rng, rng.randint(60, 200)) for _ in range(25)]
    passage = words(rng, 70)
    out = [" ".join(w) for w in base]
    out += [out[0], out[0], out[1]]  # copies
    for w in base[:8]:  # near copies
        near = list(w)
        near[len(near) // 2] = "changed"
        out.append(" ".join(near).upper())
    for w in base[10:16]:  # a passage in the middle of other texts
        out.append(" ".join(w[:30] + passage + w[30:40]) + "\nlast line\nlast line")
    out += ["", "one", "two words", "one", "Ünïcode tëxt — 你好 🎉", "  \t\n ", " ".join(words(rng, 6000)), "x" * 30000, " ".join(words(rng, 200_000))]
    rows = [(i, t, "en", "hot" if i % 3 else f"s{i % 5}", len(t), 1, 2, 3, 4, 5) for i, t in enumerate(out)]
    rows += [(len(rows), None, None, None, None, 1, 2, 3, 4, 5), (None, "a null key", "en", "s1", 10, 1, 2, 3, 4, 5), rows[3], rows[3]]
    return rows


@pytest.fixture(scope="session")
def docs(spark, texts):
    return spark.createDataFrame(texts, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
