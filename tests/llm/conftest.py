import random

import pytest

LONG_WORD = "x7@a." * 8000
#: Extra columns that carry names which operators use inside.
CLASHING = ("block", "bucket", "payload", "node", "row", "key", "root", "label", "score", "kept", "n_words", "failed", "train", "items", "hits", "spans")
#: More names, which only whole rows carry through the stages: also with a dot, and of columns that stages add or once added.
STAGE_CLASHING = (*CLASHING, "near_row", "decontam_row", "__quality_n_words", "mix_tokens", "mix_weight", "a.b", "all", "lone", "order", "n_lines", "sealed_5")


def phrase(r, n, vocabulary=400):
    return " ".join(f"w{r.randrange(vocabulary)}" for _ in range(n))


@pytest.fixture(scope="session")
def rows():
    """Ids and texts: nulls, blanks, one endless word, a very long text, exact and near copies, shared passages and lines, ids that
    repeat with other and with equal texts, rows without an id."""
    r = random.Random(5)
    base = [phrase(r, 120) for _ in range(6)]
    out = [(k, t) for k, t in enumerate(base)]
    near = base[0].split()
    near[60] = "changed"
    passage = phrase(r, 70)
    lines = "\n".join(phrase(r, 6) for _ in range(5))
    out += [(10, base[0]), (11, " ".join(near)), (12, base[1].upper()), (13, base[2] + "  \n " + passage), (14, passage + " " + phrase(r, 30)), (15, "tail " + passage)]
    out += [(20, lines + "\n" + phrase(r, 12)), (21, phrase(r, 9) + "\n\n" + lines), (22, lines.replace("\n", " \n")), (23, "a\nb\na\nb\nc d e f g h i j\nc d e f g h i j")]
    out += [(30, None), (31, ""), (32, " \t\r\n\x0b\x0c "), (33, LONG_WORD), (34, phrase(r, 30000, 50)), (35, "one two three"), (36, "ONE two three"), (37, "one two three"), (38, "é" * 60 + " ünïcödé \U0001f600 words")]
    out += [(40, base[3]), (40, base[4]), (40, base[4]), (None, base[5]), (None, None), (-5, base[5]), (41, "ha " * 300)]
    return out


@pytest.fixture(scope="session")
def docs(spark, rows):
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASHING)
    data = [(d, t, None if k % 7 == 0 else "en", None if k % 5 == 0 else f"s{k % 3}", None if t is None else len(t), *["x"] * len(CLASHING)) for k, (d, t) in enumerate(rows)]
    return spark.createDataFrame(data, schema).repartition(3, "doc_id", "text").cache()


@pytest.fixture(scope="session")
def empty(docs):
    return docs.limit(0)
