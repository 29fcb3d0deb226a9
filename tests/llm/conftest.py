"""A small table folder with the awkward cases: nulls, empty and long texts, repeated rows, clashing columns."""

import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, n, letters):
    own = random.Random(letters)
    known = ["".join(own.choice(letters) for _ in range(own.randint(2, 9))) for _ in range(400)]
    return [rng.choice(known) for _ in range(n)]


def prose(rng, n, letters="abcdefghij"):
    out, i = [], 0
    w = words(rng, n, letters)
    while i < n:
        k = rng.randint(4, 12)
        out.append(" ".join(w[i:i + k]).capitalize() + ".")
        i += k
    return "\n".join(" ".join(out[i:i + 3]) for i in range(0, len(out), 3))


def make_docs():
    rng = random.Random(5)
    rows = []
    for i in range(60):
        lang, letters = (("xx", "abcdefghij"), ("yy", "klmnopqrst"))[i % 2]
        t = prose(rng, rng.randint(30, 160), letters)
        rows.append((i, t, lang, f"s{i % 4}", len(t)))
    base = rows[0][1].split(" ")
    for i in range(60, 90):     # a group of near copies
        w = list(base)
        w[rng.randrange(len(w))] = f"edit{i}"
        rows.append((i, " ".join(w), "xx", "s0", 1))
    passage = prose(rng, 60)
    for i in range(90, 110):    # a passage in different surroundings
        rows.append((i, prose(rng, 40) + "\n" + passage + "\n" + prose(rng, 40), "xx", "s1", 2))
    rows += [(110, rows[3][1], "yy", "s2", 3), (111, rows[3][1].upper(), "yy", "s2", 3), (112, "", "xx", "s0", 0), (113, None, "yy", None, None),
             (114, "ab cd", "xx", "s0", 5), (115, "AB  cd", None, "s0", 6), (116, "  \n\t ", "xx", "s1", 5), (117, "1234 !!", "xx", "s3", 7),
             (118, prose(rng, 12000), "xx", "s3", 8), (119, rows[5][1], None, None, 9), (None, rows[7][1], "yy", "s0", 1), (None, None, None, None, None)]
    rows += [rows[9], rows[9], rows[112]]   # rows that repeat
    return rows


ROWS = make_docs()


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(ROWS, DOCS).repartition(5).cache()


@pytest.fixture(scope="session")
def tiny(spark, docs, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("tiny"))
    whole = docs.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    whole.write.parquet(f"{d}/documents.parquet")
    rng = random.Random(8)
    items = [(0, " ".join(ROWS[2][1].split()[8:40])), (1, prose(rng, 30)), (2, None), (3, "")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    labels = [(i, int(i % 2 == 0), 0) for i in range(60)] + [(1, None, 0), (500, 1, 0)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return d
