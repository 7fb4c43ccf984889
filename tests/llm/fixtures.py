"""Small tables with the awkward cases: nulls, empty and very long texts, ties, repeats and clashing extra columns."""

import random

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, node string, pos int"


def prose(rng, n, words=400):
    return " ".join(rng.choice(VOCABULARY[:words]) for _ in range(n))


_rng = random.Random(1)
VOCABULARY = ["the", "and", "of", "le", "der", *("".join(_rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(_rng.randint(2, 12))) for _ in range(2000))]


def texts(n=60, seed=3):
    rng = random.Random(seed)
    base = [prose(rng, rng.choice([3, 8, 20, 60, 200])) for _ in range(n)]
    passage = prose(rng, 60)
    out = list(base)
    for k in range(0, n, 5):  # exact and near copies, and a shared passage
        out.append(base[k])
        words = base[k].split()
        words[len(words) // 2] = "changed"
        out.append(" ".join(words))
        out.append(base[(k + 1) % n] + " " + passage + " " + base[(k + 2) % n])
    out += [None, "", "   \n\t ", "one", "One two", "ONE two three", "x " * 3000 + "end", prose(rng, 20000), "é" * 50, "a b \x00 c"]
    return out


def table(spark, values=None, ids=None):
    values = texts() if values is None else values
    ids = range(len(values)) if ids is None else ids
    rows = [(i, t, "en" if k % 3 else None, f"src{k % 4}" if k % 5 else None, len(t or ""), "clash", k) for k, (i, t) in enumerate(zip(ids, values))]
    return spark.createDataFrame(rows, COLUMNS)


def awkward(spark):
    """The table with a repeated row and a row without an id."""
    df = table(spark)
    return df.union(df.where("doc_id in (0, 7)")).union(spark.createDataFrame([(None, "some text without an id at all here", None, None, 3, "c", 1)], COLUMNS))


def empty(spark):
    return spark.createDataFrame([], COLUMNS)
