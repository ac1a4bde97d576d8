"""The automaton's matches against a plain scan of every place."""

import random

from pyspark.sql import functions as F

from wardwise.llm import queries, toxicity


def plain_matches(lexicon, folded):
    """Every place and every term, with the boundaries read off the text."""
    def places(reading, phrase, whole):
        for s in range(len(reading) - len(phrase) + 1):
            e = s + len(phrase)
            if reading[s:e] == phrase and not (s and reading[s - 1].isalpha()) and not (whole and e < len(reading) and reading[e].isalpha()):
                yield s, e

    readings = {folded, toxicity.fold_ends(folded)}
    spared = [p for r in readings for x in lexicon.exceptions for p in places(r, x, True)]
    found = {(s, e, t) for r in readings for t in lexicon.terms for s, e in places(r, t.rstrip(" "), t.endswith(" "))}
    return {m for m in found if not any(s <= m[0] and m[1] <= e for s, e in spared)}


def test_matches_equal_a_plain_scan():
    rnd = random.Random(9)
    syllables = ["ba", "lo", "ki", "a", "o", "b4", "0k", "é", "к", "$"]
    word = lambda: "".join(rnd.choice(syllables) for _ in range(rnd.randint(1, 5)))
    some = 0
    for _ in range(400):
        words = [word() for _ in range(60)]
        plain = [toxicity.fold(w) for w in words if toxicity.fold(w).isalpha()]
        terms = {w[: rnd.randint(1, 6)] if rnd.random() < 0.6 else f"{w} ": 1.0 for w in plain[:8]}
        exceptions = plain[8:10] + [" ".join(plain[k : k + 2]) for k in range(0, 6, 2)]
        lexicon = toxicity.Lexicon(terms, exceptions, [0.0, 1.0, 1.0])
        text = toxicity.fold("".join(rnd.choice(words) + rnd.choice([" ", " ", ", ", "!", "1 ", "\n", "-"]) for _ in range(80)))
        got = lexicon.matches(text)
        assert len(got) == len(set(got)) and set(got) == plain_matches(lexicon, text)
        some += len(got)
    assert some > 1000


def test_a_row_without_an_id_is_not_held_out(spark):
    rows = spark.createDataFrame([(None,), (1,), (5,)], "doc_id long").select("doc_id", F.expr(queries.HELD_OUT).alias("held"))
    assert all(r.held in (True, False) for r in rows.collect())
