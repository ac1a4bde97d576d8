"""Merkle proofs against a plain tree."""

import hashlib
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from wardwise.llm import merkle
from wardwise.llm.queries import op12_merkle


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_leaf(values):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def tree(leaves):
    """Top digest, and for each leaf its path of (left, right)."""
    paths, place, level = [[] for _ in leaves], list(range(len(leaves))), list(leaves)
    while len(level) > 1:
        for k, p in enumerate(place):
            run = p // 3 * 3
            paths[k].append(("".join(level[run:p]), "".join(level[p + 1 : run + 3])))
            place[k] = p // 3
        level = [sha("".join(level[k : k + 3])) for k in range(0, len(level), 3)]
    return level[0], paths


def fold(leaf, path):
    for left, right in path:
        leaf = sha(left + leaf + right)
    return leaf


def plain(rows):
    """(group, order, leaf) rows, in the order of the manifest, with subroot, root and path."""
    groups = defaultdict(list)
    for r in rows:
        groups[r[0]].append(r)
    first = lambda v: (v is not None, v)
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    made = {}
    for g in names:
        groups[g].sort(key=lambda r: (first(r[1]), r[2]))
        made[g] = tree([r[2] for r in groups[g]])
    root, crown = tree([made[g][0] for g in names])
    return [(*r, made[g][0], root, path + crown[k]) for k, g in enumerate(names) for r, path in zip(groups[g], made[g][1], strict=True)]


def as_text(path):
    return "/".join(f"{left}|{right}" for left, right in path)


def check(spark, data):
    rows = [(g, o, sha(f"{g}{o}{x}"), x) for g, o, x in data]
    df = spark.createDataFrame(rows, "g string, o long, leaf string, x string").withColumn("path", F.lit("clash")).repartition(5)
    out = merkle.with_proofs(df, "g", "o", "leaf").collect()
    got = sorted((str(r.g), str(r.o), r.leaf, r.subroot, r.root, as_text((s.left.hex(), s.right.hex()) for s in r.path)) for r in out)
    assert got == sorted((str(r[0]), str(r[1]), r[2], r[3], r[4], as_text(r[5])) for r in plain([r[:3] for r in rows]))


@pytest.mark.parametrize("sizes", [[1], [3], [1, 1], [2, 4, 1, 0, 9, 10], [82, 1, 3, 27, 28, 81, 243], [700, 5]])
def test_proofs_equal_a_plain_tree(spark, sizes):
    check(spark, [(f"s{g}" if g % 4 else None if g else "é", o * 3 % 701, "x") for g, n in enumerate(sizes) for o in range(n)])


def test_many_groups_and_shuffled_joins(spark):
    """More rows on the pointed-to side than may be broadcast."""
    spark.conf.set("wardwise.broadcast.maxRows", "3")
    try:
        check(spark, [(f"g{k % 40}" if k % 3 else "hot", k, "x") for k in range(900)])
    finally:
        spark.conf.unset("wardwise.broadcast.maxRows")


def test_ties_nulls_and_repeated_rows(spark):
    check(spark, [("a", None, "x"), ("a", None, "y"), ("a", 1, "x"), ("a", 1, "x"), ("a", 1, "x"), (None, None, "z"), ("", 2, "")] + [("b", 7, "same")] * 100)


def test_frames(docs, no_docs, rows):
    leaf = merkle.leaf_digest([F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")])
    out = merkle.with_proofs(docs.withColumn("leaf", leaf), "source", "doc_id", "leaf").collect()
    assert len(out) == len(rows) and {r.leaf for r in out} == {plain_leaf((r[0], r[3], r[2], r[4], r[1])) for r in rows}
    assert len({r.root for r in out}) == 1 and all(fold(r.leaf, [(s.left.hex(), s.right.hex()) for s in r.path]) == r.root for r in out)
    assert merkle.with_proofs(no_docs.withColumn("leaf", leaf), "source", "doc_id", "leaf").count() == 0


def test_op12_whole_table(spark, sf):
    source = spark.read.parquet(f"{sf}/documents.parquet").collect()
    columns = lambda r, text: plain_leaf((r.doc_id, r.source, r.lang, r.n_chars, text))
    text = {r.doc_id: r for r in source}
    got = {r.doc_id: r for r in op12_merkle(spark, sf).collect()}
    assert len(got) == len(source)
    failed = 0
    for _, doc_id, leaf, subroot, root, path in plain([(r.source, r.doc_id, columns(r, r.text)) for r in source]):
        r, d = got[doc_id], text[doc_id]
        claimed = d.text.replace("\n", "") if d.text is not None and zlib.crc32(str(doc_id).encode()) % 2 == 0 else d.text
        back = fold(columns(d, claimed), path)
        assert (r.leaf, r.subroot, r.root, r.proof_sha256) == (leaf, subroot, root, sha("".join(a + b for a, b in path)))
        assert (r.folded_root, r.verified) == (back, back == root)
        failed += not r.verified
    assert 0 < failed < len(source)
