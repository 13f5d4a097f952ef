import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))
sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

SF = "/root/testdata/sf0.001"
# Columns that documents may carry and that operators use inside.
EXTRA = "n_words long, start string, kept string, rest string, last int, spans string, h int, recipe string, anchor long, n int"


@pytest.fixture(scope="session")
def sample(spark):
    """(doc_id, text) of the smallest documents table."""
    from cadenza.llm import queries as Q

    Q.prepare(spark)
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]


@pytest.fixture(scope="session")
def documents(spark):
    """Function (rows of (doc_id, text)) -> documents table with nulls and columns of clashing names."""
    from cadenza.llm import queries as Q

    Q.prepare(spark)

    def make(rows, parts=3):
        full = [(d, t, [None, "en", "fr"][i % 3], [None, "src1", "odd", "src7"][i % 4], None if i % 2 else len(t or "")) + (None,) * 10 for i, (d, t) in enumerate(rows)]
        return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long, " + EXTRA).repartition(parts)

    return make


def odd_texts():
    """Nulls, empty and blank texts, repeats, ties and long runs."""
    base = " ".join(f"w{i * 7919 % 997}" for i in range(400))
    near = base.replace("w0 ", "other ", 1)
    long_ = " ".join(f"v{i * 104729 % 50021}" for i in range(40_000))
    return [(1, None), (2, ""), (3, "  \n\t "), (4, base), (5, base), (5, base), (6, near), (None, base), (None, "only one null id here to see"), (7, "one two three"),
            (8, "One TWO three"), (9, "é à ü ñ 漢字   x y 😀 tail"), (10, long_), (11, long_ + " end."), (12, "1" * 5000 + "@" * 3000 + "a" * 3000),
            (13, "\n".join(["same line of text here."] * 40)), (14, "\x0b\x0cform feed\x1cfs\x85nel " * 30), (15, "")]
