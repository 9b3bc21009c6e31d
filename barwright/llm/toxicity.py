"""Toxicity by a weighted lexicon, matched by an Aho-Corasick automaton on folded text.

Folding undoes disguises: case, accents and other marks, homoglyphs, and digits and signs that stand for letters, which they
do next to letters only. The lexicon is learned on labelled training rows: beginnings of words (of ``LONGEST`` letters at
most) and whole words of any length that stand in toxic documents far oftener than in others, weighted by their log odds;
all of them, which the rows learned from bound. Pairs of words that hold a lexicon word but
stand in harmless documents are exceptions and cancel the match. The matched weights are normalised by
length and turned into a probability by a logistic fit on the training rows.

Null and empty texts have no match and the score of a text without one; null labels are never learned, and a
doc_id labelled both ways counts as toxic; a null doc_id is scored and never held out; repeated rows each give
their own row; an empty table gives an empty result; without labels of both kinds every score is 0;
other columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Staged
from .words import sliced

#: Labelled rows to fit on, at most in expectation (chosen by a hash).
FIT_ROWS = 16_000
SHORTEST, LONGEST, LEAST_DOCS, LEAST_ODDS, EXCEPTION_DOCS = 3, 14, 4, 1.5, 3
#: Terms that a task counts before it gives them out.
HELD = 300_000
#: Letters of other scripts that pass for Latin letters, and digits and signs that do next to letters; at the end of a word only some.
LOOKALIKES = dict(zip("аеорсхуіјѕԁһкмтвαεικνορτυχ", "aeopcxyijsdhkmtbaeiknoptux"))
SIGNS = str.maketrans("013457@$!|", "oieastasil")
LAST_SIGNS = str.maketrans("013457@$", "oieastas")
DISGUISED = re.compile(r"[0-9@$!|]+")


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


class _Fold(dict):
    """Code point -> folded string: letters, or a space for what is not a letter. ``bare``: marks on letters go as well."""

    def __init__(self, bare: bool):
        self.bare = bare

    def __missing__(self, code: int) -> str:
        c = unicodedata.normalize("NFKC", chr(code)).lower()
        if self.bare:
            c = unicodedata.normalize("NFKD", c)
        found = ""
        for x in c:
            x = LOOKALIKES.get(x, x)
            found += x if x.isalpha() else "" if unicodedata.combining(x) or unicodedata.category(x) == "Cf" else " "
        self[code] = found
        return found


FOLDS = (_Fold(False), _Fold(True))


def _undisguised(found: re.Match) -> str:
    text, start, end = found.string, found.start(), found.end()
    if end < len(text) and text[end].isalpha():
        return found[0].translate(SIGNS)
    if start and text[start - 1].isalpha():
        return found[0].translate(LAST_SIGNS)
    return found[0]


def fold(text: str | None, bare: bool = True) -> str:
    """Folded words, each after one space, and a space at the end."""
    text = DISGUISED.sub(_undisguised, text or "")
    return " " + " ".join(text.translate(FOLDS[bare]).split()) + " "


def views(text: str | None) -> list[str]:
    """The text with the marks on its letters and, where that differs, without them."""
    marked, bare = fold(text, False), fold(text, True)
    return [marked] if marked == bare else [marked, bare]


def _counted(counts: dict[str, list[int]]) -> pa.RecordBatch:
    columns = list(zip(*counts.values()))
    return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), *[pa.array(c, pa.int64()) for c in columns]], ["term", "bad", "good", "bad_uses", "good_uses"][: 1 + len(columns)])


def _beginnings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many toxic and other documents have a word that begins so, and how many words do; a trailing space marks a whole word. Partial counts, given out whenever a task holds ``HELD`` terms."""
    counts: dict[str, list[int]] = {}
    for batch in chain.from_iterable(map(sliced, batches)):
        for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
            seen: Counter = Counter()
            # a word counts up to three times in a document, so that repeated lines do not outweigh others
            words = Counter(w for view in views(text) for w in view.split())
            for w, n in words.items():
                n = min(n, 3)
                for k in range(SHORTEST, min(LONGEST, len(w)) + 1):
                    seen[w[:k]] += n
                seen[w + " "] += n
            seen[""] += sum(min(n, 3) for n in words.values())
            for term, n in seen.items():
                row = counts.setdefault(term, [0, 0, 0, 0])
                row[1 - toxic] += 1
                row[3 - toxic] += n
            if len(counts) > HELD:
                yield _counted(counts)
                counts = {}
    if counts:
        yield _counted(counts)


class Lexicon:
    """terms: folded beginnings -> weight; exceptions: pairs of folded words; fit: intercept and two slopes."""

    def __init__(self, terms: dict[str, float], exceptions: frozenset[str] = frozenset(), fit: tuple[float, float, float] | None = None):
        self.terms, self.exceptions, self.fit = terms, exceptions, fit
        self._automaton = None

    @property
    def automaton(self):
        if self._automaton is None and self.terms:
            import ahocorasick

            self._automaton = ahocorasick.Automaton()
            for t, w in self.terms.items():
                self._automaton.add_word(" " + t, (len(t), w))
            self._automaton.make_automaton()
        return self._automaton

    def matches(self, folded: str) -> dict[int, float]:
        """Where a word begins -> the greatest weight of the terms that it begins with."""
        found: dict[int, float] = {}
        if self.automaton is not None:
            for end, (n, w) in self.automaton.iter(folded):
                at = end - n + 1
                if w > found.get(at, 0.0):
                    found[at] = w
        return found

    def pairs(self, folded: str, at: int) -> list[str]:
        """The word at ``at`` with the one before it and the one after it."""
        stop = folded.index(" ", at)
        before, after = folded.rfind(" ", 0, at - 1) + 1 if at > 1 else at, folded.find(" ", stop + 1)
        return ([folded[before:stop]] if before < at else []) + ([folded[at:after]] if after > 0 else [])

    def features(self, text: str | None) -> tuple[float, float]:
        """Log of the matched weight, each word once, and the share of the words that all matches are, by weight; of the view that has more."""
        best = (0.0, 0.0)
        for folded in views(text):
            found = self.matches(folded)
            if self.exceptions and found:
                found = {at: w for at, w in found.items() if self.exceptions.isdisjoint(self.pairs(folded, at))}
            if found:
                distinct = {folded[at : folded.index(" ", at)]: w for at, w in found.items()}
                best = max(best, (float(np.log1p(sum(distinct.values()))), float(np.log1p(100 * sum(found.values()) / (folded.count(" ") + 20)))))
        return best

    def score(self, text: str | None) -> float:
        if self.fit is None:
            return 0.0
        a, b = self.features(text)
        z = self.fit[0] + self.fit[1] * a + self.fit[2] * b
        return float(1 / (1 + np.exp(-np.clip(z, -35, 35))))


def _pairs(lexicon: Lexicon):
    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chain.from_iterable(map(sliced, batches)):
            counts: dict[str, list[int]] = {}
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
                for term in {p for folded in views(text) for at in lexicon.matches(folded) for p in lexicon.pairs(folded, at)}:
                    counts.setdefault(term, [0, 0])[1 - toxic] += 1
            if counts:
                yield _counted(counts)

    return pairs


def _features(lexicon: Lexicon):
    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chain.from_iterable(map(sliced, batches)):
            found = [lexicon.features(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array([f[0] for f in found], pa.float64()), pa.array([f[1] for f in found], pa.float64())], ["toxic", "a", "b"])

    return features


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 50) -> tuple[float, float, float]:
    """Newton's method with a ridge on the slopes."""
    full = np.column_stack((np.ones(len(x)), x))
    w, penalty = np.zeros(3), np.diag([1e-6, ridge, ridge])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(full @ w, -35, 35)))
        step = np.linalg.solve((full * (p * (1 - p))[:, None]).T @ full + penalty, full.T @ (y - p) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(map(float, w))


def fit(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> Lexicon:
    known = labels.where("doc_id is not null and toxic is not null").where(~held_out())
    share = int(min(1.0, rows / max(known.count(), 1)) * (1 << 30))
    chosen = known.where(F.pmod(F.xxhash64(F.lit("toxic"), "doc_id"), F.lit(1 << 30)) < share).groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    held = Staged(docs.select("doc_id", "text").join(chosen, "doc_id").select("text", "toxic"), "toxic-fit").read()
    numbers = {r["toxic"]: r["count"] for r in held.groupBy("toxic").count().collect()}
    bad, good = numbers.get(1, 0), numbers.get(0, 0)
    if not bad or not good:
        return Lexicon({})
    count = "term string, bad long, good long"
    summed = lambda df: df.groupBy("term").agg(*[F.sum(c).alias(c) for c in df.columns[1:]])
    terms = Staged(summed(held.mapInArrow(_beginnings, f"{count}, bad_uses long, good_uses long")), "toxic-terms").read()
    words = terms.where("term = ''").first()
    odds = lambda a, b, m, n: F.log((F.col(a) + 0.5) / (m + 1.0)) - F.log((F.col(b) + 0.5) / (n + 1.0))
    terms = terms.where("term != ''").withColumn("odds", odds("bad_uses", "good_uses", words["bad_uses"], words["good_uses"]))
    terms = terms.where((F.col("bad") >= LEAST_DOCS) & (F.col("odds") >= LEAST_ODDS) & (odds("bad", "good", bad, good) >= LEAST_ODDS))
    # as many as the rows learned from can hold
    lexicon = Lexicon({r["term"]: r["odds"] for r in terms.orderBy("term").collect()})
    common = summed(held.mapInArrow(_pairs(lexicon), count)).where((F.col("good") >= EXCEPTION_DOCS) & (F.col("good") * bad > 10 * F.col("bad") * good))
    lexicon.exceptions = frozenset(r["term"] for r in common.collect())
    lexicon._automaton = None
    points = held.mapInArrow(_features(lexicon), "toxic int, a double, b double").toPandas()
    lexicon._automaton = None
    lexicon.fit = _logistic(points[["a", "b"]].to_numpy(), points["toxic"].to_numpy().astype(float))
    return lexicon


def _scorer(lexicon: Lexicon):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chain.from_iterable(map(sliced, batches)):
            scores = np.array([lexicon.score(t) for t in batch.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(scores), pa.array((scores >= 0.7).astype("i4"))], ["doc_id", "held_out", "score", "predicted"])

    return score


def predict(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """doc_id, held_out, score, predicted (1 from a score of 0.7 on) for every row."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", held_out().alias("held_out"), "text").mapInArrow(_scorer(lexicon), f"doc_id {kind}, held_out boolean, score double, predicted int")


def scan(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return predict(docs, fit(docs, labels))
