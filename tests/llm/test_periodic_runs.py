"""Periodic runs against brute force."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from wardwise.llm import periodic_runs
from wardwise.llm.queries import op13_periodic_runs


def brute_runs(words, min_length=12):
    """Every stretch of equal words p apart, for all p, with its smallest period."""
    number = {w: i for i, w in enumerate(dict.fromkeys(words))}
    w = np.array([number[x] for x in words], np.int64)
    seen = {}
    for p in range(1, len(w) // 2 + 1):
        edges = np.flatnonzero(np.diff(np.concatenate([[False], w[:-p] == w[p:], [False]]).astype(int)))
        for s, e in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
            if e - s >= p:
                seen.setdefault((s, e + p), p)
    return sorted((s, e - s, p) for (s, e), p in seen.items() if e - s >= max(min_length, 2 * p))


def collapsed(words, runs):
    gone = {i for s, n, p in runs for i in range(s + p, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def made_words(rnd):
    """Words full of runs: powers of powers, cut powers, repeats of what is there."""
    letters, out = rnd.choice([1, 2, 2, 3, 4, 10, 1000]), []
    if rnd.random() < 0.3:
        return [b"%d" % rnd.randrange(letters) for _ in range(rnd.randint(0, 300))]
    while len(out) < 250 and rnd.random() < 0.97:
        block = [b"%d" % rnd.randrange(letters) for _ in range(rnd.randint(1, 8))] * rnd.randint(1, 20)
        block = block[: rnd.randint(1, len(block))] * rnd.randint(1, 4)
        out += out[rnd.randrange(len(out)) :] * 2 if out and rnd.random() < 0.3 else block
    return out[:600]


def check(seed, n):
    rnd = random.Random(seed)
    wrong = 0
    for _ in range(n):
        documents = [made_words(rnd) for _ in range(rnd.randint(1, 30))]
        for words, rows in zip(documents, periodic_runs.runs_of(documents), strict=True):
            wrong += [tuple(r) for r in rows.tolist() if r[1] >= 12] != brute_runs(words)
    return wrong


def test_runs_equal_brute_force():
    assert check(1, 60) == 0


@pytest.mark.parametrize("part", ["_scale", "_aligned", "_synchronising"])
def test_each_part_of_the_method_is_needed(monkeypatch, part):
    """Without the synchronising pairs, or without the highly periodic regions, runs are missed."""
    nothing = (lambda *a: np.empty(0, np.int64)) if part == "_synchronising" else (lambda *a: np.empty((0, 3), np.int64))
    monkeypatch.setattr(periodic_runs, part, nothing)
    assert check(1, 40) > 0


def test_colliding_hashes_only_cost_time(monkeypatch):
    """Hashes of few values propose much that is not there; the words decide."""
    monkeypatch.setattr(periodic_runs, "_mixed", lambda h: (h * np.uint64(7)) % np.uint64(61))
    rnd = random.Random(3)
    for _ in range(20):
        words = made_words(rnd)
        got = {tuple(r) for r in periodic_runs.runs_of([words])[0].tolist() if r[1] >= 12}
        assert all(words[s : s + n - p] == words[s + p : s + n] for s, n, p in got)


def test_long_runs():
    a, b = [b"a"], [b"b"]
    for words in (a * 100_000, [b"%d" % (i % 1017) for i in range(50_000)]):
        assert len(periodic_runs.runs_of([words])[0]) == 1
    for words in (a * 900 + b + a * 900, (a + b) * 150 + b + (a + b) * 150, [*(a * 7 + b) * 60, *a * 3] * 3):
        assert [tuple(r) for r in periodic_runs.runs_of([words])[0].tolist() if r[1] >= 12] == brute_runs(words)


def test_batches_do_not_change_runs(monkeypatch):
    rnd = random.Random(8)
    documents = [made_words(rnd) for _ in range(60)] + [[], [b"x"] * 5000]
    whole = [r.tolist() for r in periodic_runs.runs_of(documents)]
    monkeypatch.setattr(periodic_runs, "BATCH_WORDS", 700)
    assert [r.tolist() for r in periodic_runs.runs_of(documents)] == whole


def test_run_frames(docs, no_docs, rows):
    odd = docs.withColumn("runs", F.lit("clash")).withColumn("collapsed", F.lit(1))
    out = periodic_runs.collapse_runs(odd, min_length=6).collect()
    assert len(out) == len(rows)
    for r in out:
        words = [w.decode() for w in (r.text or "").encode().split()]
        runs = brute_runs(words, 6)
        assert r.n_words == len(words) and [tuple(x) for x in r.runs] == runs and r.collapsed == collapsed(words, runs)
    empty = periodic_runs.collapse_runs(no_docs)
    assert empty.count() == 0 and "runs" in empty.columns


def test_op13_whole_table(spark, sf):
    source = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    found = op13_periodic_runs(spark, sf).collect()
    assert len(found) == len(source) and any(r.n_runs for r in found)
    for r in found:
        words = [w.decode() for w in (source[r.doc_id] or "").encode().split()]
        h, n = zlib.crc32(str(r.doc_id).encode()), len(words)
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i if i < a else a + (i - a) % p] for i in range(n)]
        runs = brute_runs(words)
        best = max(runs, key=lambda x: (x[1], -x[0], -x[2]), default=(None, None, None))
        assert (r.n_runs, (r.start, r.length, r.period)) == (len(runs), best)
        assert r.exponent_milli == (1000 * best[1] // best[2] if runs else None)
        assert r.runs_sha256 == hashlib.sha256("".join(f"{s},{k},{p}\n" for s, k, p in runs).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(collapsed(words, runs).encode()).hexdigest()
