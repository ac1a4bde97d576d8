"""Toxicity scores from a weighted lexicon matched by Aho-Corasick.

Texts are folded first: full-width and other compatible forms and accented
letters to the plain letter, look-alike letters of other scripts to their Latin
letter (capitals before they are lower-cased), digits and signs that stand for
letters beside a letter to that letter. At the end of a word they may also be
a number, so such a word is read both ways; a closing exclamation mark is a
mark. The lexicon holds word beginnings and whole words with weights; an
Aho-Corasick automaton finds them in the folded text. A match inside an
exception, a word or a phrase of two or three words, does not count. The weights found are normalised by the
text's length in words, and a two-feature logistic turns the sum and the
length-normalised sum into a score.

The lexicon, its weights, the exceptions and the logistic are learned from a
sample of labelled rows of at most ``TRAIN_ROWS`` per class, chosen by a hash
of the id, so the sample does not depend on partitions or order. An id counts
once, with the smallest of its texts if it has several. Learning runs in one
task over that sample; the model (at most ``MAX_TERMS`` terms) is the
only thing that reaches the driver.

Edge cases: null and empty texts have no matches and get the score of a text
without matches; without labelled rows of both classes no term is learned and
every score is 0; rows whose label is null are not used; repeated rows are
scored alike; an empty table gives an empty result. Other columns pass
through, except that ``score`` and ``predicted`` replace columns of those names.
"""

from __future__ import annotations

import json
import math
import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from wardwise.llm.common import texts, with_arrow_columns

TRAIN_ROWS = 4000  # labelled rows a class that the lexicon is learned from
MAX_TERMS = 400
MAX_EXCEPTIONS = 400  # single words, and as many phrases
SHORTEST, LONGEST = 4, 8  # characters of a word beginning in the lexicon
MIN_LOG_ODDS = 2.0
COVERED = 3  # terms that each toxic text should match, if there are as many
LEAST_GAIN = 0.01  # share of the toxic texts that a term must still be needed for

# Letters of other scripts that look like a Latin letter, as capitals and as small letters (a capital may look like
# another letter than its small form), and what stands for a letter at a letter's side.
CAPITALS = str.maketrans("АВЕЅІЈКМНОРСТУХԚԜΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "abesijkmhopctyxqwabezhikmnoptyx")
LOOK_ALIKES = str.maketrans("аеорсухіјѕԁһӏвкмнԛԝαεονικρτυχøłđħı", "aeopcyxijsdhlbkmhqwaeovikptuxoldhi")
ACCENTS = re.compile("[\u0300-\u036f]+")
STANDS_FOR = str.maketrans("013457@$!|", "oieastasil")
STAND_INS = re.compile(r"[013457@$!|]+(?=[^\W\d_])")
LAST_STAND_INS = re.compile(r"(?<=[^\W\d_])[013457@$|]+(?!\w)")
WORD = re.compile(r"[^\W\d_]+")


def fold(text: str) -> str:
    """Compatible forms, accents, look-alikes and stand-ins before a letter as the lower-case letters they mean."""
    if not text.isascii():
        text = unicodedata.normalize("NFC", ACCENTS.sub("", unicodedata.normalize("NFKD", text))).translate(CAPITALS)
    text = text.lower()
    if not text.isascii():
        text = text.translate(LOOK_ALIKES)
    return STAND_INS.sub(lambda m: m[0].translate(STANDS_FOR), text)


def fold_ends(folded: str) -> str:
    """A folded text, of the same length, with the stand-ins at the ends of words as letters too."""
    return LAST_STAND_INS.sub(lambda m: m[0].translate(STANDS_FOR), folded)


def words_in(folded: str) -> set[str]:
    """Words of a folded text; one that ends in stand-ins is read both ways."""
    return set(WORD.findall(folded)).union(WORD.findall(fold_ends(folded)))


class Lexicon:
    """Matcher and scorer: ``terms`` and ``exceptions`` by text; a term that ends in a space is a whole word."""

    def __init__(self, terms: dict[str, float], exceptions: list[str], logistic: list[float]):
        self.terms, self.exceptions, self.logistic = terms, exceptions, logistic
        self.automaton = ahocorasick.Automaton()
        for kind, phrases in (("term", terms), ("except", exceptions)):
            for phrase in phrases:
                bare = phrase.rstrip(" ")
                old = self.automaton.get(bare, ())
                self.automaton.add_word(bare, (*old, (kind, phrase, len(bare))))
        if self.automaton:
            self.automaton.make_automaton()

    def matches(self, folded: str) -> list[tuple[int, int, str]]:
        """Counted matches as (start, end, term), those inside exceptions left out; each match of either reading counts once."""
        if not self.automaton:
            return []
        found, spared = {}, []
        for reading in dict.fromkeys((folded, fold_ends(folded))):
            for last, hits in self.automaton.iter(reading):
                for kind, phrase, size in hits:
                    start, end = last + 1 - size, last + 1
                    if start and reading[start - 1].isalpha():
                        continue
                    if (kind == "except" or phrase[-1] == " ") and end < len(reading) and reading[end].isalpha():
                        continue
                    if kind == "term":
                        found[start, end, phrase] = None
                    else:
                        spared.append((start, end, phrase))
        return [m for m in found if not any(s <= m[0] and m[1] <= e for s, e, _ in spared)]

    def features(self, text: str) -> tuple[float, float]:
        """Log of the weights found, and of the weights per hundred words."""
        weight = sum(self.terms[term] for _, _, term in self.matches(fold(text)))
        return math.log1p(weight), math.log1p(100 * weight / max(1, len(text.split())))

    def score(self, text: str) -> float:
        if not self.terms:
            return 0.0
        x, y = self.features(text)
        a, b, c = self.logistic
        return 1 / (1 + math.exp(-max(-40.0, min(40.0, a + b * x + c * y))))

    def to_json(self) -> str:
        return json.dumps([self.terms, self.exceptions, self.logistic])

    @staticmethod
    def from_json(text: str) -> Lexicon:
        return Lexicon(*json.loads(text))


def _evidence(toxic: int, clean: int, share: float) -> float:
    """Log-likelihood ratio of a term's share of toxic texts against the sample's."""
    n = toxic + clean
    return sum(k * math.log(k / n / q) for k, q in ((toxic, share), (clean, 1 - share)) if k)


def phrases_around(folded: str, terms: dict[str, float], spared: set[str]) -> set[str]:
    """Phrases of two or three words, one space apart, around each word that a term finds and that isn't spared itself."""
    spots = [m.span() for m in WORD.finditer(folded)]
    found = set()
    for i, (s, e) in enumerate(spots):
        w = folded[s:e]
        if w in spared or not (f"{w} " in terms or any(w[:k] in terms for k in range(SHORTEST, LONGEST + 1))):
            continue
        for first in range(max(0, i - 2), i + 1):
            for last in range(max(i, first + 1), min(first + 3, len(spots))):
                if all(folded[spots[k][1] : spots[k + 1][0]] == " " for k in range(first, last)):
                    found.add(folded[spots[first][0] : spots[last][1]])
    return found


def _benign(clean: Counter, toxic: Counter) -> list[str]:
    """The words or phrases of at least two clean texts and no toxic one, at most ``MAX_EXCEPTIONS``."""
    return sorted((w for w, c in clean.items() if c >= 2 and not toxic[w]), key=lambda w: (-clean[w], w))[:MAX_EXCEPTIONS]


def learn(rows: list[tuple[str, int]]) -> Lexicon:
    """Lexicon from labelled texts (text, 0 or 1)."""
    rows = sorted(set(rows))  # copies say nothing new
    n = Counter(y for _, y in rows)
    if not (n[0] and n[1]):
        return Lexicon({}, [], [0.0, 0.0, 0.0])
    pool: dict[str, str] = {}  # a word of many texts is held once
    docs = [[pool.setdefault(w, w) for w in words_in(fold(t))] for t, _ in rows]
    terms_of = lambda words: {w[:k] for w in words for k in range(SHORTEST, min(LONGEST, len(w)) + 1)} | {f"{w} " for w in words}
    where: dict[str, list[int]] = defaultdict(list)
    for i, (words, (_, y)) in enumerate(zip(docs, rows, strict=True)):
        for term in terms_of(words) if y else ():
            where[term].append(i)
    needed = math.log(1 + len(where)) + 1  # evidence beyond chance, as so many terms were tried
    share = n[1] / (n[0] + n[1])
    where = {t: d for t, d in where.items() if _evidence(len(d), 0, share) >= needed}  # clean texts only take evidence away
    seen = Counter()
    for words, (_, y) in zip(docs, rows, strict=True):
        if not y:
            seen.update(t for t in terms_of(words) if t in where)
    odds = {t: math.log((len(d) + 0.1) / (n[1] + 0.2)) - math.log((seen[t] + 0.1) / (n[0] + 0.2)) for t, d in where.items()}
    left = {t: set(d) for t, d in where.items() if odds[t] >= MIN_LOG_ODDS and _evidence(len(d), seen[t], share) >= needed}
    chosen: dict[str, float] = {}
    cover, least = Counter(), max(2, math.ceil(LEAST_GAIN * n[1]))
    while left and len(chosen) < MAX_TERMS:  # greedy cover of the toxic texts; ties to the longer, then the smaller term
        gain = {t: len(d) * odds[t] for t, d in left.items()}
        most = max(gain.values())
        best = min((t for t in left if gain[t] >= 0.98 * most), key=lambda t: (-len(t), t))
        chosen[best] = round(odds[best], 4)
        cover.update(got := left.pop(best))
        full = {i for i in got if cover[i] >= COVERED}
        left = {t: rest for t, d in left.items() if not (t.startswith(best.rstrip(" ")) or best.startswith(t.rstrip(" "))) and len(rest := d - full) >= least}
    # words that begin like a term, and then phrases around a term, that are met in clean texts only, and in more than one of them
    clean, toxic = Counter(), Counter()
    for words, (_, y) in zip(docs, rows, strict=True):
        (toxic if y else clean).update(w for w in words if any(w[:k] in chosen for k in range(SHORTEST, LONGEST + 1)))
    exceptions = _benign(clean, toxic)
    clean, toxic = Counter(), Counter()
    for t, y in rows:
        (toxic if y else clean).update(phrases_around(fold(t), chosen, set(exceptions)))
    exceptions += _benign(clean, toxic)
    lexicon = Lexicon(chosen, exceptions, [0.0, 0.0, 0.0])
    x = np.array([(1.0, *lexicon.features(t)) for t, _ in rows])
    y = np.array([float(label) for _, label in rows])
    beta, ridge = np.zeros(3), np.diag([1e-3, 1e-2, 1e-2])
    weight = np.where(y > 0, 0.5 / n[1], 0.5 / n[0]) * len(y)  # the sample's classes count alike
    for _ in range(50):  # Newton's method
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -40, 40)))
        step = np.linalg.solve(x.T @ (x * (weight * p * (1 - p))[:, None]) + ridge, x.T @ (weight * (y - p)) - ridge @ beta)
        beta = beta + step
        if np.abs(step).max() < 1e-9:
            break
    lexicon.logistic = [float(b) for b in beta]
    return lexicon


def training_rows(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text", rows_per_class: int = TRAIN_ROWS) -> DataFrame:
    """(__id, __y, __text) of the sample: one row for each sampled id and label, with the smallest of the id's texts."""
    labelled = labels.select(F.col(id_col).alias("__id"), F.col(label_col).cast("int").alias("__y")).where("__id IS NOT NULL AND __y IN (0, 1)").distinct()
    order = [F.xxhash64("__id"), "__id"]
    ids = labelled.where("__y = 1").orderBy(*order).limit(rows_per_class).unionAll(labelled.where("__y = 0").orderBy(*order).limit(rows_per_class))
    rows = docs.select(F.col(id_col).alias("__id"), F.coalesce(F.col(text_col), F.lit("")).alias("__text")).join(F.broadcast(ids), "__id")
    return rows.groupBy("__id", "__y").agg(F.min("__text").alias("__text"))  # each task leaves one row an id before any row moves


def train(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text", rows_per_class: int = TRAIN_ROWS) -> Lexicon:
    """Learn a lexicon from a bounded sample of labelled documents."""
    rows = training_rows(docs, labels, label_col, id_col, text_col, rows_per_class)

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sample = sorted((i, t, y) for b in batches for i, t, y in zip(*(b.column(c).to_pylist() for c in ("__id", "__text", "__y")), strict=True))
        yield pa.RecordBatch.from_pydict({"model": [learn([(t, y) for _, t, y in sample]).to_json()]})

    found = rows.repartition(1).mapInArrow(fit, "model string").first()
    return Lexicon.from_json(found[0]) if found else learn([])


def score(df: DataFrame, lexicon: Lexicon, text_col: str = "text") -> DataFrame:
    """``df`` plus ``score`` (0 to 1) and ``predicted`` (1 if the score is at least 0.5)."""
    model = lexicon.to_json()
    matcher: list[Lexicon] = []

    def run(batch: pa.RecordBatch) -> list:
        if not matcher:
            matcher.append(Lexicon.from_json(model))
        scores = [matcher[0].score(t) for t in texts(batch, text_col)]
        return [pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32())]

    return with_arrow_columns(df, run, [text_col], [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
