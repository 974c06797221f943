from __future__ import annotations

import pytest

#: Column names that operators use inside or return: an input may have them too.
CLASHING = ("n_words", "n_hit", "hits", "score", "size", "key", "rank", "rest", "taken", "base_failed", "kept", "n_lines", "class_id", "component_id", "token", "shared", "id", "language", "digest", "licence", "_text", "a", "b")


@pytest.fixture(scope="session")
def documents(spark):
    """Rows -> a documents table with clashing extra columns."""

    def make(rows, extra=True):
        """rows: (doc_id, text, lang, source)."""
        schema = "doc_id long, text string, lang string, source string, n_chars long" + (", " + ", ".join(f"`{c}` int" for c in CLASHING) if extra else "")
        full = [(i, t, la, s, None if t is None else len(t), *([None, 7][k % 2] for k in range(len(CLASHING) if extra else 0))) for i, t, la, s in rows]
        return spark.createDataFrame(full, schema)

    return make


#: Null, empty, white space, repeated rows, ties, a very long text, odd characters.
ODD = [
    (1, None, None, None),
    (2, "", "en", "s"),
    (3, " \t\n\x0b\x0c\r", "en", None),
    (4, "same text here", None, "s"),
    (4, "same text here", None, "s"),
    (5, "same text here", "en", "t"),
    (6, "word " * 30_000, "en", "t"),
    (7, "ÄÖ   ünï   cödé 漢字 🙂", "de", "t"),
    (8, "one", "fr", "u"),
    (9, "\x00 nul # * $ % & | < >", "fr", "u"),
    (None, "no id at all", "en", "u"),
]


@pytest.fixture(scope="session")
def odd(documents):
    return documents(ODD)


@pytest.fixture(scope="session")
def empty(documents):
    return documents([])
