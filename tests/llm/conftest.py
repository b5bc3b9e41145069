import random

import pytest

WORDS = "the of and to in er on at re st nd ing ion ent ha he an or es ti".split()


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + r.choice(WORDS) for _ in range(n))


def document_rows() -> list[tuple]:
    """Copies, near copies, shared passages, blank, null, long and repeated texts over three sources and a null one."""
    passage = prose(1000, 60)
    rows = [(i, prose(i, 40 + i % 50), "en", f"src{i % 3}", None) for i in range(30)]
    rows += [(100 + i, prose(i % 5, 40 + i % 5), "en", "src0", 1) for i in range(15)]
    rows += [(200 + i, prose(300 + i, 20) + " " + passage + " " + prose(400 + i, 20), "en", "src1", 1) for i in range(6)]
    near = prose(7, 200).split()
    for i in range(5):
        near[i * 17] = f"edit{i}"
        rows.append((300 + i, " ".join(near), "en", "src2", 1))
    rows += [(400, None, None, None, None), (401, "", "en", "", 0), (402, " \n\t ", "en", "src1", 3), (403, "one", "en", None, 3), (404, prose(9, 3000) + "\n" + prose(9, 300), "en", "src0", 3)]
    rows += [(405, "äöü é " * 40, "de", "src1", 3), (406, "a" * 700, "en", "src1", 3), (407, "<|endoftext|> it's 12 o'clock  \x1f x", "en", "src2", 1)]
    rows += [rows[3], rows[3]]
    return rows


@pytest.fixture(scope="session")
def docs(spark):
    """Documents with a further column that clashes with names the operators use inside."""
    from pyspark.sql import functions as F

    schema = "doc_id long, text string, lang string, source string, n_chars long"
    return spark.createDataFrame(document_rows(), schema).withColumn("rest", F.lit("x")).withColumn("id", F.lit(1)).withColumn("pieces", F.lit(2)).repartition(5, "lang", "doc_id")


@pytest.fixture(scope="session")
def texts():
    return [(r[0], r[1]) for r in document_rows()]


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
