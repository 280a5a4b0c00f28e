import os

import pytest

from lifelog.llm.common import documents

SF = os.environ.get("LLM_SF", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def docs(spark):
    return documents(spark, SF)


#: Nulls in any column, empty and blank texts, one long text, ties, repeated rows and clashing columns.
ROWS = [
    (1, "the quick brown fox jumps over the lazy dog and runs to the hills " * 3, "en", "a"),
    (1, "the quick brown fox jumps over the lazy dog and runs to the hills " * 3, "en", "a"),
    (2, None, None, None),
    (3, "", "en", "a"),
    (4, " \t\n ", "de", None),
    (None, "der schnelle braune Fuchs springt über den faulen Hund", "de", "b"),
    (5, "x" * 300_000, "en", "b"),
    (6, "word " * 40_000, None, "c"),
    (7, "1 2 3 !!! ###", "fr", "c"),
    (-8, "le renard brun saute par-dessus le chien paresseux 😀 \U0001f600 é", "fr", "c"),
]
CLASHING = ("fp", "node", "row", "size", "target", "score", "range", "ids", "spans", "key", "shard")


@pytest.fixture(scope="session")
def odd(spark):
    names = ", ".join(f"{c} int" for c in CLASHING)
    return spark.createDataFrame([(*r, len(r[1] or ""), *range(len(CLASHING))) for r in ROWS],
                                 f"doc_id long, text string, lang string, source string, n_chars long, {names}")


@pytest.fixture(scope="session")
def empty(odd):
    return odd.limit(0)
