import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, epoch string, n_words string, fp string"


def sentence(rng, n, words=("the", "of", "river", "stone", "and", "Light", "under", "walks", "quiet", "seven", "maps", "cold")):
    return " ".join(rng.choice(words) + rng.choice(["", "", "s", "ly", "er"]) + str(rng.randrange(40) or "") for _ in range(n))


def corpus(seed=3, n=60):
    """Documents with copies, near copies, shared passages, nulls in every column, empty and very long texts, repeated
    rows and columns whose names clash with the operators' own."""
    rng = random.Random(seed)
    texts = [sentence(rng, rng.randrange(20, 120)) for _ in range(n)]
    passage = sentence(rng, 70)
    out = []
    for i, t in enumerate(texts):
        if i % 7 == 1:
            t = texts[i - 1]                                      # exact copy
        elif i % 7 == 2:
            t = " ".join(w if k != 30 else "changed" for k, w in enumerate(texts[i - 1].split()))
        elif i % 7 == 3:
            t = t + "\n" + passage + "\n" + t[:50]
        elif i % 7 == 4:
            t = t.replace(" ", "  ").replace("  ", "\t", 2).upper()
        out.append((i * 3, t, "en", f"s{i % 4}" if i % 3 else "hot", len(t), "x", "y", "z", "w"))
    out += [(500, None, None, None, None, None, None, None, None), (501, "", "en", "s1", 0, "", "", "", ""), (502, " \t\r\n\x0b\x0c ", "en", None, 7, "", "", "", ""),
            (503, "ÄÖ ß éè 語  x", None, "s2", 9, "", "", "", ""), (504, "1234 5678 !!", "en", "s2", 9, "", "", "", ""),
            (505, "ab " * 30_000, "en", "s3", 90_000, "", "", "", ""), (506, "q" * 40_000, "en", "s3", 40_000, "", "", "", ""),
            (None, texts[0], "en", "s1", 1, "", "", "", ""), (507, texts[5], "en", "s1", 1, "", "", "", ""), (507, texts[5], "en", "s1", 1, "", "", "", "")]
    return out


@pytest.fixture(scope="session")
def rows():
    return corpus()


@pytest.fixture(scope="session")
def docs(spark, rows):
    from sagebrush.llm.common import prepare

    prepare(spark)
    return spark.createDataFrame(rows, SCHEMA).repartition(5).cache()


@pytest.fixture(scope="session")
def nothing(spark):
    from sagebrush.llm.common import prepare

    prepare(spark)
    return spark.createDataFrame([], SCHEMA)


def ascii_lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


@pytest.fixture(scope="session")
def lower():
    return ascii_lower
