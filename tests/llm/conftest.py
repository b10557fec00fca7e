import random

import pytest

DOCUMENT = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def spread(spark):
    """Shuffles keep all their partitions, so that what goes on over partition boundaries is tested."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield spark
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def words(rnd, n):
    return " ".join("".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rnd.randint(2, 8))) for _ in range(n))


def odd_texts():
    """Texts with copies, shared passages, repeated lines, other alphabets, blanks, one very long line, and NULL."""
    rnd = random.Random(11)
    passage, base = words(rnd, 30), words(rnd, 120).split()
    out = [None, "", " \n\t ", "one", "Two words", "Ünï çödé", "日本語のテキスト", "\n\n\n", "a" * 3000, "ab " * 2000]
    out += [words(rnd, rnd.randint(1, 60)) for _ in range(25)]
    out += [words(rnd, 8) + " " + passage + " " + words(rnd, 12) for _ in range(8)]
    for k in range(12):                      # near copies of one text, more and more edited
        copy = list(base)
        for _ in range(k):
            copy[rnd.randrange(len(copy))] = "edited"
        out.append(" ".join(copy))
    lines = [words(rnd, 6) for _ in range(9)]
    out += ["\n".join(lines), "\n".join(lines[2:7]), "\n".join([words(rnd, 5), *lines[1:5], words(rnd, 5)]), "\n".join(["same line"] * 12)]
    out += [out[12], out[12], out[-2].upper(), out[40]]
    return out


@pytest.fixture(scope="session")
def odd_rows():
    texts = odd_texts()
    return [(k * 5 % len(texts), t, "en" if k % 3 else None, None if k % 7 == 0 else f"s{k % 4}", len(t or "")) for k, t in enumerate(texts)]


@pytest.fixture(scope="session")
def odd_docs(spark, odd_rows):
    return spark.createDataFrame(odd_rows, DOCUMENT).repartition(5)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCUMENT)
