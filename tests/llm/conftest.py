import random

import pytest

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, id long, th long, pos int, rank int, size long, score double, `of` string, kept_id long, fp long, part int"


def edge_rows() -> list[tuple]:
    """Nulls, empty and white texts, a very long text, repeated rows, ties, ids that repeat with other texts, odd characters."""
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(300)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passage = text(70)
    rows = [
        (1, None, "en", "s1"), (2, "", "en", "s1"), (3, " \n\t\r ", "en", None), (None, "no id " + text(30), "fr", "s2"), (None, None, None, None),
        (4, passage, "en", "s2"), (4, passage, "en", "s2"), (5, "one", "en", "s2"), (6, text(20) + "\n" + passage + "\n" + text(9), "de", "s3"),
        (7, passage + "\n" + text(15), "en", "s3"), (8, "é ü <|endoftext|> 日本 \x00 \x85 🤦🏽", "es", "s1"), (9, text(30000), "en", "s3"),
        (9, "the same id with another text " + text(12), "en", "s1"), (10, "x" * 5000, "en", "s1"), (11, "\n".join(["a line of its own " + w for w in words[:40]]), "en", "s2"),
        (12, "\n".join(["a line of its own " + w for w in words[:40]]), "en", "s2"), (13, "ab " * 400, "en", "s1"),
    ]
    rows += [(100 + i, text(rng.randint(5, 120)), "en", f"s{i % 3}") for i in range(60)]
    return rows


@pytest.fixture(scope="session")
def edge(spark):
    extra = (7, 8, 9, 10, 11, 0.5, "clash", 12, 13, 14)
    return spark.createDataFrame([(*r, len(r[1] or ""), *extra) for r in edge_rows()], COLUMNS).repartition(3)


@pytest.fixture(scope="session")
def empty(edge):
    return edge.limit(0)
