import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, target string, label string, spans string, start string, tid string, sid string"


def table(spark, rows):
    """Documents with extra columns whose names operators use themselves."""
    return spark.createDataFrame([(i, t, lang, source, None if t is None else len(t), "x", "x", "x", "x", "x", "x", "x") for i, t, lang, source in rows], SCHEMA)


def prose(r, words, n):
    return " ".join(r.choice(words) for _ in range(n))


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls in any column, empty and very long texts, ties, repeated rows, copies and near copies."""
    r = random.Random(11)
    words = ["".join(r.choice("abcdeilmnorstu") for _ in range(r.randint(2, 7))) for _ in range(400)]
    base = prose(r, words, 90)
    near = base.split()
    near[40] = "changed"
    shared = prose(r, words, 25)
    lines = [prose(r, words, 8) for _ in range(5)]
    rows = [
        (0, base, "en", "a"), (1, base, "en", None), (2, " ".join(near), "de", "b"), (3, None, "en", "a"), (4, "", None, "a"), (5, "   \n\t ", "en", "c"),
        (6, prose(r, words, 20_000), "en", "a"), (7, "one two", "de", "b"), (8, "one two", "de", "b"), (8, "one two", "de", "b"), (None, prose(r, words, 30), "en", "c"),
        (None, None, None, None), (11, prose(r, words, 40) + " " + shared + " " + prose(r, words, 30), "de", "b"), (12, shared + " " + prose(r, words, 50), "en", "c"),
        (13, "ÄÖ ÜÑ ²³ 中文 \U0001f600 ñandú", "es", "é"), (14, "a" * 5000, "en", "a"), (15, "ab" * 400 + base[:200], "en", "a"), (16, "1234 5678 !!", "en", "b"),
        (17, "\n".join(lines), "en", "a"), (18, "\n".join(["intro " + prose(r, words, 5), *lines[1:4], "end"]), "en", "a"), (19, "\n".join(lines[:2]), "de", "b"),
        (20, base.upper(), "en", ""), (21, "x\r\n\ty  z..,'s don't", "en", ""),
        # Ids that are no doubles, beside nulls.
        (2**53 + 1, prose(r, words, 60) + " " + shared, "en", "a"), (2**53 + 3, base + " " + prose(r, words, 3), "de", None), (2**63 - 1, shared + " " + prose(r, words, 8), None, "b"),
        (-(2**53) - 1, "\n".join(lines[1:4]), "en", "c"), (None, shared, "de", "a"), (-(2**63) + 1, "mail a.b@example.org now", "en", "b"),
    ]
    return rows


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return table(spark, odd_rows).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return table(spark, [])
