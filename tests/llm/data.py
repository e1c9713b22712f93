"""Small tables for the tests of tessera.llm."""

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(n, seed, vocabulary=3000):
    r = random.Random(seed)
    return [f"w{r.randrange(vocabulary)}" for _ in range(n)]


def documents(seed=1, n=60):
    """Random texts with exact and near copies, shared passages, empty, null, long and repeated rows."""
    r = random.Random(seed)
    texts = [" ".join(words(r.choice([3, 8, 40, 150, 400]), 100 * seed + i)) for i in range(n)]
    passage = " ".join(words(90, 7_000 + seed))
    for i in range(0, n, 9):
        texts.append(f"{texts[i][: r.randrange(300)]} {passage} {' '.join(words(30, 8_000 + i))}")
    for i in range(5):
        near = words(200, 9_000 + seed)
        near[10 * i + 3] = "changed"
        texts.append(" ".join(near))
    texts += [texts[4], texts[4], texts[4], "", "", None, "one", "one", " ".join(words(6000, 5)), "é" * 500 + "ü" * 300, "ab" * 900, "x" * 1300]
    rows = [(i, t, "en", None if i % 11 == 0 else f"src{min(i % 7, i % 3)}", len(t or "")) for i, t in enumerate(texts)]
    return rows + [rows[3], rows[3], (None, texts[5], None, None, None), (None, texts[5], None, None, None), (3, "another text of the same id", "en", "src1", 0)]


def frame(spark, rows):
    """With a column that clashes with names the operators use inside."""
    return spark.createDataFrame([(*r, "k", -1, "x") for r in rows], DOCS + ", key string, id int, h string").repartition(3)


def shared(spark, tmp):
    """A folder that stands for the cluster's shared one."""
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(str(tmp))
