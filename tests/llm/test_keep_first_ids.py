"""Near-duplicate removal on tables whose ids repeat with other texts."""

import random

from tests.llm.conftest import DOCS
from wardwise.llm import simhash


def words(seed, n=60):
    rnd = random.Random(seed)
    return " ".join(f"{rnd.choice('bcdfgklmnprst')}{rnd.randrange(10_000)}" for _ in range(n))


def test_texts_under_one_id_stay(spark):
    a, b, c, d, e = (words(k) for k in range(5))
    data = [
        (1, a),  # the first of its copies
        (5, a),  # a copy of a smaller id goes
        (5, b),  # another text of that id stays
        (5, b),  # an equal row of one id goes
        (5, c),
        (7, b),  # a copy of b goes, c and b aren't linked by their id
        (9, c),  # a copy of c goes
        *[(11, words(100 + k)) for k in range(50)],  # a hot id
        (12, words(101)),
        (13, d),
        (None, a),
        (None, e),
    ]
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in data], DOCS).repartition(4)
    got = sorted(((r.doc_id, r.text) for r in simhash.keep_first(df).collect()), key=str)
    want = [(1, a), (5, b), (5, c), *[(11, words(100 + k)) for k in range(50)], (13, d), (None, a), (None, e)]
    assert got == sorted(want, key=str)
