import numpy as np
import pytest


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty, wordless and long texts, ties, repeated rows, and extra columns with clashing names."""
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(400)]

    def prose(n):
        return " ".join(rng.choice(words, n))

    base = [prose(60) for _ in range(6)]
    near = [" ".join(w if rng.random() > 0.03 else "zz" for w in b.split()) for b in base for _ in range(4)]
    texts = [None, "", " \n\t ", "one", "one", "ONE", "a b c d", "A b C d", prose(5), prose(6000), *base, *base[:3], *near]
    rows = [(i if i != 7 else None, t, None if i % 7 == 3 else "en", None if i % 5 == 2 else f"src{i % 3}", 1) for i, t in enumerate(texts)]
    rows += [rows[10], rows[10], (3, "another text under the same key", "de", "src1", None), (None, None, None, None, None)]
    extra = [(*r, "x", 1, "y", 2.0, "z") for r in rows]
    return spark.createDataFrame(extra, "doc_id long, text string, lang string, source string, n_chars long, k string, lab long, _lang string, score double, __row string").repartition(3).cache()


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.where("false")
