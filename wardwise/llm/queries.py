"""The registered queries of this subpackage: thin digests over its operators."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from wardwise.llm import ann, bpe, decontamination, line_dedup, merkle, periodic_runs, pii_crf, sentence_pieces, simhash, substring_dedup, token_counts, toxicity, warc
from wardwise.llm.common import table

BPE_RANKS = "byte_bpe_multi_50k.tiktoken"
PIECES = "piece_bpe_32k.model"
TOKEN_LIMIT = 4096
HELD_OUT = "coalesce(crc32(CAST(doc_id AS STRING)) % 5 = 0, false)"


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text")


def training_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The labels that scores may be learned from."""
    return table(spark, sf_dir, "labels").where(f"NOT ({HELD_OUT})")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    scored = toxicity.score(docs, toxicity.train(docs, training_labels(spark, sf_dir)))
    return scored.select("doc_id", F.expr(HELD_OUT).alias("held_out"), "score", "predicted")


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = public_tokenizers.path(BPE_RANKS)
    decoded = bpe.round_trip(_documents(spark, sf_dir), ranks, public_tokenizers.PATTERN)
    return decoded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = token_counts.count_tokens(_documents(spark, sf_dir), public_tokenizers.path(PIECES))
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > TOKEN_LIMIT).alias("over_limit"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    kept = line_dedup.remove_boilerplate(docs)
    return kept.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_documents(spark, sf_dir))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc.archive(table(spark, sf_dir, "pages"))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii_crf.find(_documents(spark, sf_dir)).drop("text")
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    counts = [F.size(F.filter("base_spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}") for kind in pii_crf.KINDS]
    return found.select("doc_id", *counts, F.sha2(joined("base_spans"), 256).alias("base_sha256"), joined("spans").alias("spans"))


def op8_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return ann.nearest(vectors, F.col("vec_id") % 100 == 0)


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.find_windows(_documents(spark, sf_dir), table(spark, sf_dir, "benchmark")).drop("text")
    hits = F.aggregate("hit_spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select(
        "doc_id",
        "n_words",
        hits.alias("n_hit"),
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"),
        (hits > 0).alias("contaminated"),
    )


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substring_dedup.remove_repeats(_documents(spark, sf_dir))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op11_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = sentence_pieces.round_trip(_documents(spark, sf_dir), public_tokenizers.path(PIECES))
    ids = F.array_join(F.col("ids").cast("array<string>"), ",")
    covered = F.coalesce(F.try_element_at("spans", F.lit(-1))["end"], F.lit(0)).cast("long")
    return coded.select("doc_id", "n_tokens", F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"), covered.alias("n_span_bytes"))


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    columns = lambda text: [F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), text]
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    claimed = F.when(tampered, F.replace(F.col("text"), F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    rows = docs.select("doc_id", "source", merkle.leaf_digest(columns(F.col("text"))).alias("leaf"), merkle.leaf_digest(columns(claimed)).alias("claimed"))
    proven = merkle.with_proofs(rows, "source", "doc_id", "leaf")
    out = proven.select("doc_id", "leaf", "subroot", "root", merkle.proof_digest(F.col("path")).alias("proof_sha256"), merkle.folded(F.col("claimed"), F.col("path")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """In a tenth of the documents, picked by the crc32 of their id, the words from one on repeat with a period; a null id is not picked."""
    crc = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    picked = docs.withColumns({"g": F.floor(crc / 10), "words": F.when(crc % 10 == 0, words)}).withColumn("n", F.size("words"))
    first = picked.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")))
    repeat = first.withColumn("p", 1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8)))
    head = F.slice("words", F.lit(1), F.col("a").cast("int"))
    tail = F.transform(F.sequence(F.lit(0), F.col("n") - F.col("a") - 1), lambda i: F.element_at("words", (F.col("a") + i % F.col("p") + 1).cast("int")))
    planted = F.when(F.col("n") > 0, F.array_join(F.concat(head, tail), " "))
    return repeat.select("doc_id", F.coalesce(planted, F.col("text")).alias("text"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs.collapse_runs(with_planted_runs(_documents(spark, sf_dir)))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"], -r["start"], -r["period"])))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    rows = found.select("doc_id", "runs", F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"), best.alias("best"))
    length, start, period = F.col("best.length"), -F.col("best.col2"), -F.col("best.col3")
    return rows.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        start.alias("start"),
        length.alias("length"),
        period.alias("period"),
        F.floor(1000 * length / period).alias("exponent_milli"),
        "runs_sha256",
        "collapsed_sha256",
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_byte_bpe": op2_byte_bpe,
    "op3_token_counts": op3_token_counts,
    "op4_line_dedup": op4_line_dedup,
    "op5_simhash": op5_simhash,
    "op6_warc": op6_warc,
    "op7_pii": op7_pii,
    "op8_nearest": op8_nearest,
    "op9_decontamination": op9_decontamination,
    "op10_substring_dedup": op10_substring_dedup,
    "op11_sentence_pieces": op11_sentence_pieces,
    "op12_merkle": op12_merkle,
    "op13_periodic_runs": op13_periodic_runs,
}
ORACLE_SQL: dict[str, str] = {
    "op6_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
        d AS (SELECT page_id, strlen(html) AS payload_bytes, sha256(html) AS payload_digest FROM p),
        f AS (SELECT payload_digest, min(page_id) AS first FROM d WHERE payload_bytes >= 100 GROUP BY 1)
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN page_id <> first THEN first END AS refers_to
        FROM d LEFT JOIN f USING (payload_digest)
    """,
    "op4_line_dedup": """
        WITH docs AS (
            SELECT row_number() OVER () AS r, doc_id, source, md5(text) AS t, length(replace(text, chr(10), '')) AS total, string_split(text, chr(10)) AS parts
            FROM documents
        ),
        lines AS (SELECT r, source, t, total, unnest(parts) AS line, unnest(range(len(parts))) AS pos FROM docs),
        candidates AS (SELECT line FROM lines WHERE trim(line) <> '' GROUP BY line HAVING count(DISTINCT source) >= 5),
        found AS (SELECT t, pos, line, min(source) AS site, min(total) AS total FROM lines SEMI JOIN candidates USING (line) GROUP BY t, pos, line),
        texts AS (
            SELECT t, min(site) AS site, CASE WHEN 2 * sum(length(line)) > min(total) THEN min(md5(line)) ELSE t END AS witness FROM found GROUP BY t
        ),
        held AS (SELECT line, min(texts.site) AS site FROM found JOIN texts USING (t) GROUP BY line, witness),
        spread AS (SELECT line FROM held GROUP BY line HAVING count(DISTINCT site) >= 5),
        marked AS (SELECT r, pos, line, line IN (SELECT line FROM spread) AS gone FROM lines),
        bare AS (SELECT r, count(*) FILTER (NOT gone AND trim(line) <> '') = 0 AS is_bare FROM marked GROUP BY r)
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone AND NOT is_bare) AS n_removed,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone OR is_bare), '')) AS kept_sha256
        FROM marked JOIN bare USING (r) JOIN docs USING (r) GROUP BY r, doc_id
    """,
    "op9_decontamination": r"""
        WITH fold AS (SELECT 'ABCDEFGHIJKLMNOPQRSTUVWXYZ' AS up, 'abcdefghijklmnopqrstuvwxyz' AS low),
        items AS (
            SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), up, low), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
            FROM benchmark, fold
        ),
        windows AS (
            SELECT DISTINCT item, least(10, len(w)) AS n, array_to_string(list_slice(w, s + 1, s + least(10, len(w))), ' ') AS k
            FROM items, unnest(range(0, greatest(1, len(w) - 9))) AS t(s) WHERE len(w) > 0
        ),
        docs AS (
            SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), up, low), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
            FROM documents, fold
        ),
        hits AS (
            SELECT r, s, windows.n, item
            FROM (
                SELECT r, s, n, array_to_string(list_slice(w, s + 1, s + n), ' ') AS k
                FROM docs, (SELECT DISTINCT n FROM windows) AS z, unnest(range(0, len(w) - n + 1)) AS t(s)
            ) AS here JOIN windows ON here.n = windows.n AND here.k = windows.k
        ),
        spans AS (SELECT r, count(DISTINCT p) AS n_hit FROM hits, unnest(range(s, s + n)) AS t(p) GROUP BY r),
        found AS (
            SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM hits WHERE item IS NOT NULL) GROUP BY r
        )
        SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
               sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
        FROM docs LEFT JOIN spans USING (r) LEFT JOIN found USING (r)
    """,
    "op10_substring_dedup": r"""
        WITH docs AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
        windows AS (
            SELECT doc_id, s, array_to_string(list_slice(w, s + 1, s + 20), ' ') AS k FROM docs, unnest(range(0, len(w) - 19)) AS t(s)
        ),
        again AS (SELECT doc_id, s, row_number() OVER (PARTITION BY k ORDER BY doc_id, s) AS nth FROM windows),
        gone AS (SELECT DISTINCT doc_id, p FROM again, unnest(range(s, s + 20)) AS t(p) WHERE nth > 1),
        words AS (SELECT doc_id, p, w[p + 1] AS word FROM docs, unnest(range(0, len(w))) AS t(p)),
        kept AS (
            SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS text, count(*) AS n FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id
        )
        SELECT doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
        FROM docs LEFT JOIN kept USING (doc_id)
    """,
    "op12_merkle": """
        WITH RECURSIVE docs AS (
            SELECT row_number() OVER () AS r, doc_id, source,
                   concat_ws('', coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-'), coalesce(strlen(source) || ':' || source, '-'),
                             coalesce(strlen(lang) || ':' || lang, '-'), coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-')) AS head,
                   text, replace(text, chr(10), '') AS cut,
                   list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ord(c) AS BIGINT))),
                               lambda a, b: list_reduce(list_prepend(xor(a, b), CAST(range(8) AS BIGINT[])), lambda v, k: xor(v >> 1, 3988292384 * (v & 1)))) AS crc
            FROM documents
        ),
        leaves AS (
            SELECT r, doc_id, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
                   CASE WHEN xor(crc, 4294967295) % 2 = 0 THEN sha256(head || coalesce(strlen(cut) || ':' || cut, '-'))
                        ELSE sha256(head || coalesce(strlen(text) || ':' || text, '-')) END AS claimed,
                   dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS g
            FROM docs
        ),
        placed AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM leaves),
        lower_nodes AS (
            SELECT g, 0 AS h, i, leaf AS d FROM placed
            UNION ALL
            SELECT g, h + 1, i // 3, sha256(string_agg(d, '' ORDER BY i))
            FROM (SELECT *, count(*) OVER (PARTITION BY g) AS c FROM lower_nodes) WHERE c > 1 GROUP BY g, h, i // 3
        ),
        subroots AS (SELECT g, max(h) AS top, max_by(d, h) AS subroot FROM lower_nodes GROUP BY g),
        upper_nodes AS (
            SELECT 0 AS h, g AS i, subroot AS d FROM subroots
            UNION ALL
            SELECT h + 1, i // 3, sha256(string_agg(d, '' ORDER BY i))
            FROM (SELECT *, count(*) OVER () AS c FROM upper_nodes) WHERE c > 1 GROUP BY h, i // 3
        ),
        crown AS (SELECT max(h) AS upper_top, max_by(d, h) AS root FROM upper_nodes),
        steps AS (
            SELECT r, h AS k, coalesce(string_agg(d, '' ORDER BY n.i) FILTER (n.i < p.i // CAST(3 ** h AS BIGINT)), '') AS l,
                   coalesce(string_agg(d, '' ORDER BY n.i) FILTER (n.i > p.i // CAST(3 ** h AS BIGINT)), '') AS s
            FROM (SELECT placed.*, unnest(range(top)) AS hh FROM placed JOIN subroots USING (g)) AS p
                 JOIN lower_nodes AS n ON n.g = p.g AND n.h = p.hh AND n.i // 3 = p.i // CAST(3 ** (p.hh + 1) AS BIGINT)
            GROUP BY r, h, p.i
            UNION ALL
            SELECT r, top + h, coalesce(string_agg(d, '' ORDER BY n.i) FILTER (n.i < p.g // CAST(3 ** h AS BIGINT)), ''),
                   coalesce(string_agg(d, '' ORDER BY n.i) FILTER (n.i > p.g // CAST(3 ** h AS BIGINT)), '')
            FROM (SELECT placed.*, top, unnest(range(upper_top)) AS hh FROM placed JOIN subroots USING (g), crown) AS p
                 JOIN upper_nodes AS n ON n.h = p.hh AND n.i // 3 = p.g // CAST(3 ** (p.hh + 1) AS BIGINT)
            GROUP BY r, top, h, p.g
        ),
        folds AS (
            SELECT r, 0 AS k, claimed AS d FROM placed
            UNION ALL
            SELECT r, k + 1, sha256(l || d || s) FROM folds JOIN steps USING (r, k)
        ),
        proofs AS (SELECT r, sha256(string_agg(l || s, '' ORDER BY k)) AS proof_sha256 FROM steps GROUP BY r),
        ends AS (SELECT r, max_by(d, k) AS folded_root FROM folds GROUP BY r)
        SELECT doc_id, leaf, subroot, root, coalesce(proof_sha256, sha256('')) AS proof_sha256, folded_root, folded_root = root AS verified
        FROM placed JOIN subroots USING (g) JOIN ends USING (r) LEFT JOIN proofs USING (r), crown
    """,
}
