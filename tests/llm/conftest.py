import random

import pytest

COLUMNS = "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, fp bigint, size int, key string, text_a string, component string"


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join("".join(r.choice("th er on an re he in ed nd ha".split()) for _ in range(r.randint(1, 4))) for _ in range(n))


def near(seed: int, n: int, changed: int) -> str:
    w = prose(seed, n).split()
    for k in range(changed):
        w[(k * 37 + 11) % n] = f"other{seed}x{k}"
    return " ".join(w)


@pytest.fixture(scope="session")
def rows():
    """Nulls, empty and very long texts, ties, repeated rows, copies."""
    texts = [None, "", " \t\n ", "one", "One\tTWO", prose(1, 60), prose(1, 60), prose(1, 60).upper(), near(1, 60, 1), prose(2, 400), near(2, 400, 1), near(2, 400, 30), "x" * 70000, prose(3, 20000), 'idiot token = "9b1c02d7a4e8f3650718293a4b5c6d7e8f901a2b" end', "naïve café <|endoftext|> 日本 🙂 don't  stop"]
    texts += [prose(100 + k, 30 + k) + (" idiot scum" if k % 3 == 0 else "") for k in range(60)]
    out = [(k, t, "en", [None, "a", "b", "B", "é"][k % 5], 0 if t is None else len(t), 0.0, 1, 2, "k", "t", "c") for k, t in enumerate(texts)]
    out.append(out[5])  # a repeated row
    out.append((None, "no id", None, None, None, None, None, None, None, None, None))
    return out


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, COLUMNS).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], COLUMNS)


@pytest.fixture(scope="session")
def labels(spark, rows):
    found = [(r[0], int(r[1] is not None and len(r[1]) > 200), int("idiot" in (r[1] or "")), 1.0) for r in rows if r[0] is not None]
    return spark.createDataFrame(found + [(5, None, None, 0.0)], "doc_id bigint, quality int, toxic int, score double")
