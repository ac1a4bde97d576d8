"""Toxicity, decontamination, WARC, personal data and nearest neighbours."""

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import DOCS
from tests.conftest import SF_MID
from wardwise.llm import ann, decontamination, pii_crf, toxicity, warc
from wardwise.llm.queries import op1_toxicity, op6_warc, op7_pii, op8_nearest, op9_decontamination

A_TO_Z = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# -- toxicity ------------------------------------------------------------


def made_texts(n, seed):
    rnd = random.Random(seed)
    vocabulary = ["".join(rnd.choice("abcdefghilmnorstu") for _ in range(rnd.randint(2, 9))) for _ in range(600)]
    bad = ["grumple", "snorkfool", "vezzick", "blargon"]
    spelled = {"grumple": ["grumple", "Grumple", "grumpl3", "gruмple".replace("м", "m")], "vezzick": ["vezzick", "vezz1ck", "vеzzick"]}
    rows = []
    for i in range(n):
        words = [rnd.choice(vocabulary) for _ in range(rnd.randint(5, 120))]
        toxic = rnd.random() < 0.2
        for _ in range(rnd.randint(1, 4) if toxic else 0):
            word = rnd.choice(bad)
            words.insert(rnd.randrange(len(words)), rnd.choice(spelled.get(word, [word, word + "ian"])))
        if not toxic and rnd.random() < 0.1:
            words.append("vezzickfree")
        rows.append((" ".join(words), int(toxic)))
    return rows


def test_lexicon_held_out_accuracy():
    rows = made_texts(1500, 1)
    lexicon = toxicity.learn(rows[:1000])
    right = sum((lexicon.score(t) >= 0.5) == bool(y) for t, y in rows[1000:])
    assert right >= 490 and lexicon.terms
    assert lexicon.score("they said vezzickfree soup") < 0.5 <= lexicon.score("you vezz1ck, you 5norkfool") <= 1
    # long clean texts and texts without matches keep one low score
    assert lexicon.score("") == lexicon.score("plain words " * 500) < 0.5


def test_folding_and_boundaries():
    lexicon = toxicity.Lexicon({"trash": 2.0, "clown ": 3.0}, ["trashcan"], [-1.0, 1.0, 1.0])
    found = lambda t: [m[2] for m in lexicon.matches(toxicity.fold(t))]
    assert found("Tr4sh, тrash; trаsh! TRASHED") == ["trash", "trash", "trash"]  # the second begins with another letter
    assert found("cl0wn clown. clowns xclown") == ["clown ", "clown "]
    assert found("trashcan trash") == ["trash"]
    assert toxicity.Lexicon.from_json(lexicon.to_json()).terms == lexicon.terms


def test_toxicity_frames(spark, docs, no_docs, rows):
    made = made_texts(600, 2)
    train = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(made)], "doc_id long, text string")
    labels = [(i, y) for i, (_, y) in enumerate(made)] + [(3, made[3][1]), (5, None), (None, 1), (9999, 1)]
    lexicon = toxicity.train(train, spark.createDataFrame(labels, "doc_id long, toxic int"))
    again = toxicity.train(train.repartition(7), spark.createDataFrame(labels[::-1], "doc_id long, toxic int"))
    assert lexicon.terms and lexicon.to_json() == again.to_json()
    out = toxicity.score(docs.withColumn("score", F.lit("clash")), lexicon).collect()
    assert len(out) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in out)
    assert toxicity.score(no_docs, lexicon).count() == 0
    nothing = toxicity.train(no_docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert {r.score for r in toxicity.score(docs, nothing).collect()} == {0.0}


def test_op1(spark):
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF_MID}/labels.parquet").collect()}
    held = [r for r in op1_toxicity(spark, SF_MID).collect() if r.held_out]
    assert all(zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r in held)
    known = [(r.predicted, labels[r.doc_id]) for r in held if r.doc_id in labels]
    assert sum(p == y for p, y in known) >= 0.95 * len(known)


# -- decontamination -----------------------------------------------------


def brute_windows(docs, items, window):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(A_TO_Z))
    windows = {}
    for i, t in items:
        words = split(t)
        n = min(window, len(words))
        for s in range(len(words) - n + 1 if words else 0):
            windows.setdefault(tuple(words[s : s + n]), set()).update([] if i is None else [str(i)])
    out = []
    for i, t in docs:
        words, hit, ids = split(t), set(), set()
        for n in {len(w) for w in windows}:
            for s in range(len(words) - n + 1):
                if (found := windows.get(tuple(words[s : s + n]))) is not None:
                    hit.update(range(s, s + n))
                    ids |= found
        out.append((i, len(words), len(hit), ",".join(sorted(ids))))
    return sorted(out, key=str)


@pytest.mark.parametrize("shard_words", [decontamination.SHARD_WORDS, 300])
def test_decontamination(spark, docs, no_docs, rows, shard_words):
    rnd = random.Random(4)
    items = [(i, " ".join(rnd.choice(["The", "Red", "fox-trot", "naïve", "a1", "z", "über"]) for _ in range(rnd.choice([0, 1, 3, 9, 10, 11, 30])))) for i in range(30)]
    items += [(30, None), (None, "the cat sat on a mat and the dog ran to"), (31, rows[0][1]), (31, rows[0][1]), ("x", " ".join(rows[0][1].split()[:4]))]
    items = [(None if i is None else str(i), t) for i, t in items]
    made = [(100 + k, " ".join(filter(None, (" ".join(f"w{rnd.randrange(50)}" for _ in range(5)), (items[rnd.randrange(30)][1] or "")[rnd.choice([0, 4]) :], "end!"))), "en", "a", 0) for k in range(120)]
    data = rows + made
    df = spark.createDataFrame(data, DOCS).withColumn("item_ids", F.lit("clash"))
    bench = spark.createDataFrame(items, "item_id string, text string")
    got = decontamination.find_windows(df, bench, 10, shard_words=shard_words).collect()
    mine = sorted(((r.doc_id, r.n_words, sum(s.end - s.start for s in r.hit_spans), ",".join(r.item_ids)) for r in got), key=str)
    assert mine == brute_windows([(d[0], d[1]) for d in data], items, 10)
    assert decontamination.find_windows(no_docs, bench).count() == 0
    assert all(not r.hit_spans for r in decontamination.find_windows(docs, bench.limit(0)).collect())


def test_op9(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    want = [(i, n, h, hashlib.sha256(ids.encode()).hexdigest(), h > 0) for i, n, h, ids in brute_windows(docs, items, 10)]
    got = sorted(((r.doc_id, r.n_words, r.n_hit, r.items_sha256, r.contaminated) for r in op9_decontamination(spark, sf).collect()), key=str)
    assert got == sorted(want, key=str)


# -- WARC ----------------------------------------------------------------


def brute_records(pages):
    first = {}
    for i, _, html in pages:
        body = (html or "").encode()
        if i is not None and len(body) >= 100:
            first[body] = min(i, first.get(body, i))
    out = []
    for i, _, html in pages:
        body = (html or "").encode()
        to = first.get(body) if i is not None else None
        copy = to is not None and to != i
        out.append((i, len(body), hashlib.sha256(body).hexdigest(), "revisit" if copy else "response", to if copy else None))
    return sorted(out, key=str)


def fake_record(n, tail=""):
    return f"<p>{'x' * 40}\r\n\r\nWARC/1.0\r\nWARC-Type: response\r\nWARC-Page-ID: 666\r\nContent-Length: {n}\r\n\r\nHTTP/1.1 200 OK\r\n\r\nfake{tail}"


@pytest.mark.parametrize("split", ["128m", "700"])
def test_warc_round_trip(spark, split):
    """Payloads that look like records, empty ones and copies; byte ranges down to about a record."""
    rnd = random.Random(8)
    pages = [(i, f"http://h/{i}", rnd.choice(["", "é" * 60, "<html>" + "ab " * rnd.randint(0, 90), "same page " * 12, "short", None])) for i in range(40)]
    pages += [(60, "http://x/\r\nWARC/1.0\r\n", fake_record(20)), (61, None, fake_record(10**6)), (62, "u", fake_record(5, "\r\n\r\n" + fake_record(3)))]
    pages += [(63, "u", "WARC/1.0\r\n" * 30), (64, "u", "WARC/1.0\r\n" * 30), (None, "u", "same page " * 12), (5, "u", "tie"), (5, "u", "tie")]
    rnd.shuffle(pages)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)
        df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("id", F.lit("clash")).coalesce(2)
        got = warc.archive(df).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert sorted(map(tuple, got), key=str) == brute_records(pages)


def test_warc_empty_and_bytes(spark):
    assert warc.archive(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
    page = [(1, "http://a/", "hello"), (2, "http://b/", None)]
    path = warc.write_warc(spark.createDataFrame(page, "page_id long, url string, html string").coalesce(1), warc.shared_path(spark, "warc-test"))
    data = b"".join(bytes(r.content) for r in spark.read.format("binaryFile").load(path + "/*.txt").collect())
    head = data.split(b"\r\n\r\n")[0].decode().split("\r\n")
    assert head[0] == "WARC/1.0" and "WARC-Target-URI: <http://a/>" in head
    assert data.count(b"WARC/1.0\r\n") == 2 and data.endswith(b"\r\n\r\n")


def test_op6(spark, sf):
    pages = [(r.page_id, r.url, r.html) for r in spark.read.parquet(f"{sf}/pages.parquet").collect()]
    got = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in op6_warc(spark, sf).collect()]
    assert sorted(got, key=str) == brute_records(pages)


# -- personal data -------------------------------------------------------

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for k, d in enumerate(map(int, reversed(digits))):
        total += d if k % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def brute_base(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {"ip": lambda: all(int(p) <= 255 for p in m[0].split(".")), "card": lambda: 16 <= len(digits) <= 19 and luhn(digits), "phone": lambda: 8 <= len(digits) <= 15}
            if ok.get(kind, lambda: True)():
                out.append((kind, *m.span()))
    return out


@pytest.fixture(scope="module")
def field():
    return pii_crf.train(pii_crf.labelled_rows())


def test_base_spans():
    rnd = random.Random(3)
    parts = ["a@b.c", "@", "1.2.3.4", "256.1.1.1", "+1 (555) 123-4567", "4111 1111 1111 1111", "4111111111111111", "-", " ", ".", "1", "22", "a", "+", "x.y@", "(", ")", "0" * 16, "é"]
    for _ in range(5000):
        text = "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 12)))
        assert pii_crf.base_spans(text) == brute_base(text), text
    for text in ("a" * 200_000, "1" * 200_000, "1." * 100_000, "a@" * 100_000, "+1 " * 60_000):
        pii_crf.base_spans(text)  # linear time


def test_viterbi_and_cuts(field):
    """The batch decoder equals enumeration; the cut sequences equal the whole one."""
    rng = np.random.default_rng(5)
    for size in (1, 2, 3, 4):
        scores = rng.normal(size=(3, size, 4)) * 2
        moves = rng.normal(size=(4, 4))
        got = pii_crf.viterbi(scores, moves)
        paths = np.indices((4,) * size).reshape(size, -1).T
        for b in range(3):
            value = [moves[0, p[0]] + sum(scores[b, t, p[t]] for t in range(size)) + sum(moves[p[t], p[t + 1]] for t in range(size - 1)) + moves[p[-1], 0] for p in paths]
            assert (paths[int(np.argmax(value))] == got[b]).all()
    other = pii_crf.Field({}, np.zeros((0, len(pii_crf.LABELS))), field.moves)
    for _ in range(400):
        scores = rng.normal(size=(rng.integers(1, 40), len(pii_crf.LABELS))) * 3
        scores[:, 0] += rng.uniform(0, 14)
        other.emissions = lambda ids, scores=scores: scores.copy()
        assert (pii_crf.viterbi(scores[None], field.moves)[0] == other.decode(np.ones(len(scores), int))).all()


def test_field_on_unseen_texts(field):
    cases = {
        "please mail kate dot olsen at firm dot example dot com now": ["kate dot olsen at firm dot example dot com"],
        "my phone is (415) 555-0123 or so": ["(415) 555-0123"],
        "pay 4222.2222.2222.2222 today": ["4222.2222.2222.2222"],
        "host 10[.]2[.]3[.]4 failed": ["10[.]2[.]3[.]4"],
        "look at the dot on the wall at noon, 24 of them in 2021": [],
        "plain prose about a river and 3 boats": [],
    }
    right = sum([t[s:e] for _, s, e in pii_crf.spans_of([t], field)[0][1]] == want for t, want in cases.items())
    assert right == len(cases)


def test_pii_frames(docs, no_docs, rows, spark, sf):
    out = pii_crf.find(docs.withColumn("spans", F.lit("clash"))).collect()
    assert len(out) == len(rows)
    assert pii_crf.find(no_docs).count() == 0
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in op7_pii(spark, sf).collect():
        base = brute_base(texts[r.doc_id])
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(s[0] == k for s in base) for k in PATTERNS)
        text = ",".join(f"{k}:{s}:{e}" for k, s, e in base)
        assert r.base_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert set(filter(None, text.split(","))) <= set(r.spans.split(","))


# -- nearest neighbours --------------------------------------------------


def brute_nearest(rows, queries, k):
    out = {}
    for q, v in queries:
        near = sorted({(float(np.sqrt(((np.array(x) - np.array(v)) ** 2).sum())), i) for i, x in rows if i != q and len(x) == len(v)})[:k]
        out[q] = near
    return out


def test_nearest(spark, monkeypatch):
    monkeypatch.setattr(ann, "SHARD", 400)
    monkeypatch.setattr(ann, "QUERY_BLOCK", 7)
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(20, 24)) * 2
    good = [(i, (centres[i % 20] + rng.normal(size=24)).tolist()) for i in range(1500)]
    good += [(2000 + i, good[40][1]) for i in range(300)]  # one common vector, ties by id
    good += [(5000, [1.0, 2.0]), (5001, [1.0, 2.5])]
    bad = [(9000, None), (9001, []), (9002, [0.0] * 24), (9003, [float("nan")] * 24), (9004, [float("inf")] + [1.0] * 23), (9005, [None] + [1.0] * 23), (None, good[0][1])]
    rows = good + bad + [good[0], good[40], (9020, None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("v", F.lit("clash"))
    got = {}
    for r in ann.nearest(df, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.score, r.vec_id))
        assert r["rank"] == len(got[r.query_id])
    want = brute_nearest(good, [(i, v) for i, v in good if i % 20 == 0], 10)
    assert set(got) == {q for q, near in want.items() if near}
    found = sum(len({v for _, v in got[q]} & {v for _, v in near}) for q, near in want.items() if near)
    assert found >= 0.9 * sum(map(len, want.values()))
    assert all(s == dict((v, d) for d, v in brute_nearest(good, [(q, dict(good)[q])], 10**6)[q])[i] for q in list(got)[:5] for s, i in got[q])
    assert [v for _, v in got[2000]] == [40, *range(2001, 2010)]
    assert ann.nearest(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_op8_recall(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF_MID}/embeddings.parquet").collect()]
    want = brute_nearest(rows, [r for r in rows if r[0] % 100 == 0], 10)
    got = {}
    for r in op8_nearest(spark, SF_MID).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    assert sum(len(got[q] & {v for _, v in near}) for q, near in want.items()) >= 0.9 * sum(map(len, want.values()))


def test_search_over_several_shards_verifies_few(monkeypatch):
    """Vectors of the larger table in four shards: recall and the share of vectors whose distance was computed."""
    table = pq.read_table("/root/testdata/sf0.1/embeddings.parquet")
    vectors, ids = np.array(table["embedding"].to_pylist(), float), table["vec_id"].to_numpy()
    verified, near = [], ann.CollisionIndex.near

    def counted(self, *args):
        found = near(self, *args)
        verified.append(len(found[0]) / len(self.vectors))
        return found

    monkeypatch.setattr(ann.CollisionIndex, "near", counted)
    monkeypatch.setattr(ann, "LEAST", 20)
    asked = np.flatnonzero(ids % 100 == 0)
    got = {}
    for shard in range(4):
        own = np.arange(len(ids)) % 4 == shard
        for q, v, d in zip(*ann._search(ids[own], vectors[own], ids[asked], vectors[asked], 10).to_pydict().values(), strict=True):
            got.setdefault(q, []).append((d, v))
    found = 0
    for i in asked:
        distance = np.sqrt(((vectors - vectors[i]) ** 2).sum(1))
        distance[i] = np.inf
        found += len({v for _, v in sorted(got[ids[i]])[:10]} & set(ids[np.argsort(distance, kind="stable")[:10]].tolist()))
    assert found >= 0.9 * 10 * len(asked) and np.mean(verified) < 0.2
