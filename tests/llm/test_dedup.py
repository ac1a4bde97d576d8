"""Line dedup, SimHash, components and substring dedup against brute force."""

import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import xxhash
from pyspark.sql import functions as F

from tests.llm.conftest import DOCS
from wardwise.llm import line_dedup, simhash, substring_dedup
from wardwise.llm.components import components
from wardwise.llm.queries import op5_simhash, op10_substring_dedup

A_TO_Z = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# -- line dedup ----------------------------------------------------------


def brute_lines(rows, min_sites):
    raw, home = defaultdict(set), {}
    for site, text in rows:
        if text is not None and site is not None:
            home[text] = min(home.get(text, site), site)
            for line in text.split("\n"):
                if line.strip(" "):
                    raw[line].add(site)
    md5 = lambda line: hashlib.md5(line.encode()).hexdigest()
    held = defaultdict(dict)
    for text in {text for _, text in rows if text is not None}:
        parts = text.split("\n")
        found = [p for p in parts if len(raw[p]) >= min_sites]
        copy = 2 * sum(map(len, found)) > sum(map(len, parts))
        witness = min(map(md5, found)) if copy else md5(text)
        for line in found:
            if text in home:
                held[line][witness] = min(held[line].get(witness, home[text]), home[text])
    out = []
    for _, text in rows:
        parts = [] if text is None else text.split("\n")
        drop = {i for i, p in enumerate(parts) if len(set(held[p].values())) >= min_sites}
        if not any(p.strip(" ") for i, p in enumerate(parts) if i not in drop):
            drop = set()
        out.append((text if not drop else "\n".join(p for i, p in enumerate(parts) if i not in drop), len(parts), len(drop)))
    return out


def test_copies_are_no_boilerplate(spark):
    """Exact and near copies on many sites keep their lines; short pages around a footer lose it."""
    story = [f"a long line of the story, number {i}" for i in range(12)]
    copies = ["\n".join(story)] * 30 + ["\n".join([*story[:i], f"edited {i} {k}", *story[i + 1 :]]) for i in range(12) for k in range(6)]
    pages = [f"own {i}\nthe footer of all sites, which is longer than the page" for i in range(12)] + [f"page {i} with a longer text of its own, more than the footer has\nthe footer of all sites, which is longer than the page" for i in range(9)]
    rows = [(i, text, "en", f"s{i % 9}", 0) for i, text in enumerate([*copies, *pages, "the footer of all sites, which is longer than the page"])]
    got = {r.doc_id: r.text for r in line_dedup.remove_boilerplate(spark.createDataFrame(rows, DOCS)).collect()}
    assert [got[r[0]] for r in rows] == [w[0] for w in brute_lines([(r[3], r[1]) for r in rows], 5)]
    assert all(got[i] == text for i, text in enumerate(copies)) and all(got[r[0]] == r[1].split("\n")[0] for r in rows[len(copies) :])


def test_line_dedup(spark, docs, no_docs, rows):
    rnd = random.Random(3)
    lines = [f"line {i} " + "word " * (i % 5) for i in range(40)] + ["", "  "]
    made = [(100 + i, "\n".join(rnd.choice(lines) if rnd.random() < 0.5 else f"own {rnd.random()} text" for _ in range(rnd.randint(1, 12))), "en", rnd.choice([*"abcdefgh", None]), 0) for i in range(300)]
    data = made + rows
    df = spark.createDataFrame(data, DOCS).withColumn("n_lines", F.lit("clash"))
    got = sorted(((r.doc_id, r.text, r.n_lines, r.n_removed) for r in line_dedup.remove_boilerplate(df, min_sites=5).collect()), key=str)
    want = sorted(((d[0], *w) for d, w in zip(data, brute_lines([(d[3], d[1]) for d in data], 5), strict=True)), key=str)
    assert got == want and any(r[3] for r in got)
    assert line_dedup.remove_boilerplate(no_docs).count() == 0


def test_line_dedup_near_threshold_is_exact(spark):
    """A coarse sketch: most lines are near the threshold and get the exact count."""
    rows = [(i, f"shared {i % 30}\n" + "own " * 20 + str(i), "en", f"s{i % (20 + i % 30)}", 0) for i in range(2000)]
    lines = line_dedup._lines(spark.createDataFrame(rows, DOCS).withColumn("__site", F.col("source")), "text")
    got = {bytes(r.h) for r in line_dedup.widespread(lines, 25, lg_k=4).collect()}
    sites = defaultdict(set)
    for r in rows:
        sites[r[1].split("\n")[0]].add(r[3])
    assert got == {hashlib.md5(k.encode()).digest() for k, s in sites.items() if len(s) >= 25} and got


# -- SimHash -------------------------------------------------------------


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(A_TO_Z))
    grams = [" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def brute_components(ids, fps):
    """Smallest id reachable over at most three differing bits."""
    label = list(range(len(ids)))
    order = sorted(range(len(ids)), key=lambda i: ids[i])
    fp = np.array([fps[i] for i in order], np.uint64)
    near = np.bitwise_count(fp[:, None] ^ fp[None, :]) <= 3
    label = np.arange(len(fp))
    while True:
        low = np.where(near, label[None, :], len(fp)).min(1)
        if (low == label).all():
            return {ids[i]: ids[order[label[k]]] for k, i in enumerate(order)}
        label = low


def test_simhash_frames(docs, no_docs, rows):
    got = simhash.near_duplicates(docs.withColumn("component_id", F.lit("clash"))).collect()
    assert len(got) == len(rows)
    fps = {r[0]: brute_fingerprint(r[1]) for r in rows}
    assert {(r.doc_id, r.fp % 2**64) for r in got} == set(fps.items())
    named = [i for i in fps if i is not None]
    want = brute_components(named, [fps[i] for i in named])
    assert all(r.component_id == want[r.doc_id] for r in got if r.doc_id is not None)
    assert simhash.near_duplicates(no_docs).count() == 0
    kept = [r.doc_id for r in simhash.keep_first(docs).collect()]
    assert sorted(k for k in kept if k is not None) == sorted(set(want.values())) and None in kept


def test_simhash_whole_table(spark, sf):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    ids = sorted(texts)
    fps = [brute_fingerprint(texts[i]) for i in ids]
    want = brute_components(ids, fps)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in op5_simhash(spark, sf).collect()}
    assert got == {i: (f"{f:016x}", want[i]) for i, f in zip(ids, fps, strict=True)}


def test_index_loses_no_link_in_hot_lists(spark, monkeypatch):
    """Thousands of prints within few bits of each other: lists overflow to the next levels."""
    monkeypatch.setattr(simhash, "LIST_LIMIT", 40)
    rnd = random.Random(5)
    base = [rnd.getrandbits(64) for _ in range(4)]
    fps = set()
    while len(fps) < 1200:
        f = rnd.choice(base)
        for _ in range(rnd.randint(0, 9)):
            f ^= 1 << rnd.randrange(64)
        fps.add(f)
    fps = sorted(fps)
    signed = [f - 2**64 if f >= 2**63 else f for f in fps]
    rows = spark.createDataFrame([(0, f, f, i) for i, f in enumerate(signed)], "key long, open long, fp long, node long")
    links, level = [], 1
    while level <= simhash.LEVELS and rows.count():
        found = simhash._compare(simhash._post(rows, level), level, 3).collect()
        links += [(r.a, r.b) for r in found if r.b is not None]
        rest = [(r.key, r.open, r.fp, r.a) for r in found if r.b is None]
        rows = spark.createDataFrame(rest, "key long, open long, fp long, node long")
        level += 1
    assert level > 2
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = brute_components(list(range(len(fps))), fps)
    assert {i: got.get(i, i) for i in want} == want


def test_components(spark):
    rnd = random.Random(9)
    path = [(i, i + 1) for i in range(100, 160)] + [(200 + 2 * i, 400 - i) for i in range(40)]
    edges = path + [(rnd.randrange(1000, 1400), rnd.randrange(1000, 1400)) for _ in range(250)] + [(7, 7), (1, None), (5, 3), (3, 5)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            ra, rb = find(a), find(b)
            root[max(ra, rb)] = min(ra, rb)
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in root if find(x) != x}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# -- substring dedup -----------------------------------------------------


def brute_repeats(rows, window):
    """rows: (id, text) with distinct ids; equal rows must be passed once."""
    seen, out = {}, {}
    for i, text in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        gone = set()
        for s in range(len(words) - window + 1):
            if seen.setdefault(tuple(words[s : s + window]), (i, s)) != (i, s):
                gone.update(range(s, s + window))
        out[i] = (len(words), len(gone), " ".join(w for k, w in enumerate(words) if k not in gone))
    return out


def test_substring_frames(docs, no_docs, rows):
    got = substring_dedup.remove_repeats(docs.withColumn("id", F.lit("clash"))).collect()
    want = brute_repeats(set((r[0], r[1]) for r in rows), 20)
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is None:
            assert r.n_removed == 0
        else:
            assert (r.n_words, r.n_removed, r.kept) == want[r.doc_id]
    assert substring_dedup.remove_repeats(no_docs).count() == 0


def test_substring_texts_of_one_id(spark):
    """Different texts under one id are different documents, in the order of their MD5; the first occurrence stays."""
    rnd = random.Random(12)
    passage = " ".join(f"p{k}" for k in range(30))
    texts = [f"x y z {passage}", " ".join(f"o{k}" for k in range(9)) + f" {passage}", f"{passage} end", None, "", *(f"{rnd.randrange(9)} {passage} {k}" for k in range(20))]
    rows = [(1 + k // 9, t) for k, t in enumerate(texts)] + [(1, texts[0]), (None, texts[0]), (None, texts[1])]
    md5 = lambda t: int(hashlib.md5((t or "").encode()).hexdigest()[:15], 16)
    ordered = sorted({r for r in rows if r[0] is not None}, key=lambda r: (r[0], md5(r[1])))
    want = brute_repeats(list(enumerate(t for _, t in ordered)), 20)
    expected = [(ordered.index(r), r) if r[0] is not None else (None, r) for r in rows]
    expected = sorted(((r[0], *want[k]) if k is not None else (None, len(r[1].split()), 0, r[1]) for k, r in expected), key=str)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted((tuple(r) for r in substring_dedup.remove_repeats(df).collect()), key=str) == expected


def test_substring_random(spark, monkeypatch):
    """Few words, so windows repeat within and across documents at all alignments; some anchors are heavy."""
    rnd = random.Random(11)
    passages = [[rnd.choice("abcdefgh") for _ in range(rnd.randint(15, 60))] for _ in range(12)]
    rows = []
    for i in range(250):
        words = []
        for _ in range(rnd.randint(0, 6)):
            p = rnd.choice(passages)
            a = rnd.randrange(len(p))
            words += p[a : a + rnd.randint(1, 60)] if rnd.random() < 0.6 else [f"w{rnd.randrange(400)}" for _ in range(rnd.randint(1, 25))]
        if rnd.random() < 0.1:
            words += ["z"] * rnd.randint(1, 70)
        rows.append((i, " ".join(words)))
    want = brute_repeats(rows, 20)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    for heavy, dense, held in ((1000, 128, 1 << 20), (12, 128, 500), (1000, 3, 1 << 20), (1000, 2, 200)):
        for name, value in (("HEAVY", heavy), ("DENSE", dense), ("HELD", held)):
            monkeypatch.setattr(substring_dedup, name, value)
        got = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in substring_dedup.remove_repeats(df).collect()}
        assert got == want


def test_automaton_matching_statistics():
    rnd = random.Random(2)
    for _ in range(100):
        text = [rnd.randrange(3) for _ in range(rnd.randint(1, 60))]
        automaton = substring_dedup.SuffixAutomaton()
        for e, symbol in enumerate(text):
            best = max(n for n in range(e + 2) if n == 0 or any(text[s : s + n] == text[e + 1 - n : e + 1] for s in range(e + 1 - n)))
            assert automaton.extend(symbol) == best


def test_op10_whole_table(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want = brute_repeats(rows, 20)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in op10_substring_dedup(spark, sf).collect()}
    assert got == {i: (n, k, hashlib.sha256(t.encode()).hexdigest()) for i, (n, k, t) in want.items()}
