import os
import re
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
TO_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text, lower=True):
    t = text or ""
    return re.findall(r"[^\x20\x09-\x0D]+", t.translate(TO_LOWER) if lower else t)


@pytest.fixture(scope="session", autouse=True)
def shared_folder(spark):
    """A checkpoint folder, and the package on the Python workers' path."""
    spark.sparkContext.environment["PYTHONPATH"] = ROOT
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="llm-tests-"))


#: Nulls, empty and white texts, ties, repeated rows and ids, and a long text.
ODD = [(1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "a b c d"), (5, "a b c d"), (6, "a b c d e f g"), (None, "a b c d e f g"),
       (7, "é ü 漢字 　 x"), (8, "word " * 30000), (9, "Éan " * 300), (10, "x" * 200000)]


@pytest.fixture(scope="session")
def odd(spark):
    """The odd rows with columns whose names clash with the operators' own."""
    rows = [(i, t, "en", None if i == 4 else "s", len(t or ""), 1, 2, "z") for i, t in ODD]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, "
                                       "id bigint, n bigint, node string")
