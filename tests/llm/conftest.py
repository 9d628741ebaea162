import os
import sys

import pytest
from samples import ODD, WORDS

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def docs(spark):
    """Documents from (doc_id, text[, lang[, source]])."""
    def make(rows, extra=False):
        full = []
        for r in rows:
            doc_id, text, lang, source = [*r, *(["en", "src0"][len(r) - 2:])][:4]
            full.append((doc_id, text, lang, source, None if text is None else len(text)))
        df = spark.createDataFrame(full, SCHEMA).repartition(3)
        if extra:   # further columns, named like the operators' own
            for c in ("block", "kind", "payload", "row", "host", "size", "h", "fp", "shard", "score", "label", "id"):
                df = df.selectExpr("*", f"1 AS {c}")
        return df
    return make


@pytest.fixture
def prose():
    """Seeded random prose of n words, in sentences of ten."""
    import random

    def make(n, seed=0):
        rnd = random.Random(seed)
        words = [rnd.choice(WORDS) + str(rnd.randrange(50)) for _ in range(n)]
        return " ".join(w + "." if i % 10 == 9 else w for i, w in enumerate(words))
    return make


@pytest.fixture
def odd(docs):
    return docs(ODD, extra=True)


@pytest.fixture
def empty(docs, spark):
    return spark.createDataFrame([], SCHEMA)
