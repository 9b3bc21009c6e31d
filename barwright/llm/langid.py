"""Language identification by segmentation-marginalised unigrams.

The pieces of a fixed public vocabulary have a probability in each language, counted on the labelled
training rows. A text's likelihood sums over all its segmentations into pieces: a forward pass over each
word (pieces never cross white space), where every character also has a rare fallback of its own. Of a word,
however long, only as many steps are held as a piece is long. Words repeat, so a word's likelihoods are remembered
by its 64-bit hash (bounded memory) and a text's are the sum over all its words.

Null text and texts without a letter are ``und`` with score 0; null languages are never learned; a null
doc_id is carried; repeated rows each give their own row; an empty table gives an empty result; without
any training row all is ``und``; other columns are ignored, and lang is read in training rows only.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .words import Powers, of_process, sliced, spans, stretch_hashes

#: Training rows in expectation, at most (chosen by a hash); what learning reads is bounded by it.
FIT_ROWS = 20_000
FALLBACK, SMOOTH = 1e-8, 0.1
#: Words that a process remembers; cells of a forward pass.
MEMO, CELLS = 300_000, 1 << 18
#: Bytes of text looked at together.
PORTION = 1 << 19
UNKNOWN = "und"
#: A text is rejected if it is ``und``, if no language is likelier than the first, or if its mean log likelihood by character in
#: the likeliest one is below the second: other scripts, languages not learned and random letters come to -5 and less, prose to -1 to -3.
LEAST, LEAST_FLUENT = 0.3, -4.0


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def held_out(parts: int = 5, part: int = 0) -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % parts == part, F.lit(False))


SIGNS = "!\"#$%&'()*+,-./0123456789:;<=>?@[\\]^_`{|}~"
_APART = str.maketrans(dict.fromkeys(SIGNS, " "))
#: The same by bytes.
_APART_BYTES = np.arange(256).astype("u1")
_APART_BYTES[list(SIGNS.encode())] = 32


def _words(text: str) -> list[str]:
    """Words in lower case; signs and digits part them, as they belong to no language."""
    return text.lower().translate(_APART).split()


class Pieces:
    """The vocabulary's pieces in lower case, and all their places in words."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = self.model.get_piece_size()
        self._automaton, self.longest = None, 1

    @property
    def automaton(self):
        if self._automaton is None:
            import ahocorasick

            made = ahocorasick.Automaton()
            for i in range(self.size):
                piece = self.model.id_to_piece(i)
                if not (self.model.is_control(i) or self.model.is_unknown(i) or self.model.is_byte(i)) and piece == piece.lower():
                    made.add_word(piece, len(piece) << 32 | i)
                    self.longest = max(self.longest, len(piece))
            made.make_automaton()
            self._automaton = made
        return self._automaton


def _counter(path_of: Callable[[], str]):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, words = Pieces(path_of()), {}
        for batch in chain.from_iterable(map(sliced, batches)):
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
                words.setdefault(lang, Counter()).update(_words(text))
        for lang, counts in words.items():
            total = np.zeros(pieces.size, np.int64)
            known = list(counts)
            for i in range(0, len(known), 10_000):
                part = known[i : i + 10_000]
                for w, ids in zip(part, pieces.model.encode(part, out_type=int, num_threads=1)):
                    total[ids] += counts[w]
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(total[at])], ["lang", "piece", "n"])

    return count


class Model:
    """Languages in order, and for each piece its probability in each of them."""

    def __init__(self, langs: list[str], table: np.ndarray):
        self.langs, self.table = langs, table


def fit(docs: DataFrame, path_of: Callable[[], str] = default_path, rows: int = FIT_ROWS) -> Model:
    """Learn from rows that are not held out and have a text and a language."""
    known = docs.select("doc_id", "text", F.col("lang").cast("string").alias("lang")).where(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    share = min(1.0, rows / max(known.count(), 1))
    chosen = known.where(F.pmod(F.xxhash64(F.lit("langid"), "doc_id"), F.lit(1 << 30)) < int(share * (1 << 30)))
    counts = chosen.select("lang", "text").mapInArrow(_counter(path_of), "lang string, piece int, n long").groupBy("lang", "piece").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(counts["lang"].unique())
    size = Pieces(path_of()).size
    table = np.full((size, len(langs)), SMOOTH)
    for n, lang in enumerate(langs):
        mine = counts[counts["lang"] == lang]
        table[mine["piece"].to_numpy(), n] += mine["n"].to_numpy()
    return Model(langs, table / table.sum(axis=0, keepdims=True))


class Scorer:
    """What a process knows of words, by their hash, sorted: score by language, characters, when last met. Of ``MEMO`` words those met last are kept."""

    def __init__(self, model: Model, path: str):
        self.model, self.pieces, self.powers = model, Pieces(path), Powers()
        self.known, self.table, self.tick = np.empty(0, "u8"), np.empty((0, len(model.langs) + 2)), 0

    @staticmethod
    def at(model: Model, path: str) -> Scorer:
        """The process's scorer for this model; it serves the next task too."""
        name = ("language", path, tuple(model.langs), hashlib.sha256(model.table.tobytes()).hexdigest())
        return of_process(name, lambda: Scorer(model, path))

    def word_scores(self, words: list[str]) -> np.ndarray:
        """Forward pass over all words at once: log of the sum over segmentations, by word and language."""
        starts, texts, at = [], [], 0
        for w in words:
            starts.append(at)
            texts.append("▁" + w)
            at += len(w) + 2
        spans = np.fromiter(chain.from_iterable(self.pieces.automaton.iter("\n".join(texts))), np.int64)
        end, length, piece = spans[::2], spans[1::2] >> 32, spans[1::2] & 0xFFFFFFFF
        begin = np.array(starts)
        lens = np.array([len(t) for t in texts])
        word = np.searchsorted(begin, end, "right") - 1
        stop = end - begin[word] + 1
        order = np.argsort(stop, kind="stable")
        word, stop, length, piece = word[order], stop[order], length[order], piece[order]
        bounds = np.searchsorted(stop, np.arange(1, lens.max() + 2))
        # the last steps only; each word and language has a scale of its own, so that no product becomes too small
        steps = self.pieces.longest + 1
        ring = np.zeros((steps, len(words), len(self.model.langs)))
        ring[0] = 1.0
        scale = np.zeros(ring.shape[1:])
        out = np.empty(ring.shape[1:])
        last = np.argsort(lens, kind="stable")
        done = np.searchsorted(lens[last], np.arange(lens.max() + 2))
        for j in range(1, lens.max() + 1):
            here = ring[(j - 1) % steps] * FALLBACK
            a, b = bounds[j - 1], bounds[j]
            if b > a:
                np.add.at(here, word[a:b], ring[(j - length[a:b]) % steps, word[a:b]] * self.model.table[piece[a:b]])
            ring[j % steps] = here
            ended = last[done[j] : done[j + 1]]
            out[ended] = np.log(here[ended]) + scale[ended]
            if j % 8 == 0:
                small = np.where((here < 1e-100) & (here > 0), here, 1.0)
                ring /= small
                scale += np.log(small)
        return out

    def _learn(self, hashes: np.ndarray, raw: list[str]) -> None:
        """Scores of new words, those of like length together. What stands between signs may hold other white space, and so several words."""
        split = [_words(w) for w in raw]
        words = sorted(set(chain.from_iterable(split)), key=len)
        rows, at = np.zeros((len(words), len(self.model.langs) + 1)), 0
        rows[:, -1] = np.fromiter(map(len, words), float, len(words)) + 1  # a word's end counts as a character
        while at < len(words):
            stop = at + 1
            while stop < len(words) and (stop + 1 - at) * (len(words[stop]) + 2) <= CELLS:
                stop += 1
            rows[at:stop, :-1], at = self.word_scores(words[at:stop]), stop
        place = dict(zip(words, range(len(words))))
        made = np.full((len(raw), self.table.shape[1]), self.tick, float)
        several = [n for n, parts in enumerate(split) if len(parts) != 1]
        made[:, :-1] = rows[[place[parts[0]] if len(parts) == 1 else 0 for parts in split]] if words else 0.0
        for n in several:
            made[n, :-1] = rows[[place[w] for w in split[n]]].sum(axis=0)
        into = np.searchsorted(self.known, hashes)
        self.known, self.table = np.insert(self.known, into, hashes), np.insert(self.table, into, made, axis=0)

    def scores(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Log likelihood by text and language, and characters of each text."""
        out = np.zeros((len(texts), self.table.shape[1] - 1))
        for start, data, bounds, starts, ends in spans(texts, pc.ascii_lower, PORTION, _APART_BYTES):
            self.tick += 1
            if len(self.known) > MEMO:
                kept = self.table[:, -1] > np.median(self.table[:, -1])
                self.known, self.table = self.known[kept], self.table[kept]
            hashes, first, inverse = np.unique(stretch_hashes(data, starts, ends, self.powers), return_index=True, return_inverse=True)
            at = np.searchsorted(self.known, hashes)
            new = at == len(self.known)
            new[~new] = self.known[at[~new]] != hashes[~new]
            if new.any():
                raw = data.tobytes()
                self._learn(hashes[new], [raw[a:b].decode() for a, b in zip(starts[first[new]].tolist(), ends[first[new]].tolist())])
                at = np.searchsorted(self.known, hashes)
            self.table[at, -1] = self.tick
            sums = np.zeros((len(starts) + 1, out.shape[1]))
            np.cumsum(self.table[at[inverse], :-1], axis=0, out=sums[1:])
            stops = np.searchsorted(starts, bounds)
            out[start : start + len(bounds) - 1] = sums[stops[1:]] - sums[stops[:-1]]
        return out[:, :-1], out[:, -1]


class Judge:
    def __init__(self, model: Model, path: str):
        self.model, self.scorer = model, Scorer.at(model, path)

    def __call__(self, texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, its posterior, and the text's mean log likelihood by character in it (NaN where there is none)."""
        lettered = np.flatnonzero(pc.fill_null(pc.match_substring_regex(texts, r"\p{L}"), False).to_numpy(zero_copy_only=False)) if self.model.langs else []
        langs, best, fluent = [UNKNOWN] * len(texts), np.zeros(len(texts)), np.full(len(texts), np.nan)
        if not len(lettered):
            return langs, best, fluent
        logs, chars = self.scorer.scores(texts.take(pa.array(lettered)))
        odds = np.exp(logs - logs.max(axis=1, keepdims=True))
        odds /= odds.sum(axis=1, keepdims=True)
        for m, k in zip(lettered.tolist(), odds.argmax(axis=1).tolist()):
            langs[m] = self.model.langs[k]
        best[lettered], fluent[lettered] = odds.max(axis=1), logs.max(axis=1) / chars
        return langs, best, fluent


def _predictor(model: Model, path_of: Callable[[], str]):
    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Judge(model, path_of())
        for batch in chain.from_iterable(sliced(b, PORTION) for b in batches):
            langs, best, fluent = judge(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(langs, pa.string()), pa.array(best), pa.array(fluent, from_pandas=True)], ["doc_id", "held_out", "lang_pred", "score", "fluency"])

    return predict


def predict(docs: DataFrame, model: Model, path_of: Callable[[], str] = default_path) -> DataFrame:
    """doc_id, held_out, lang_pred, score (posterior of the predicted language), fluency (mean log likelihood by character in it) for every row."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", held_out().alias("held_out"), "text").mapInArrow(_predictor(model, path_of), f"doc_id {kind}, held_out boolean, lang_pred string, score double, fluency double")


def scan(docs: DataFrame) -> DataFrame:
    return predict(docs, fit(docs))


def _sieve(model: Model, path_of: Callable[[], str], least: float, least_fluent: float):
    def sieve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Judge(model, path_of())
        for batch in chain.from_iterable(sliced(b, PORTION) for b in batches):
            langs, best, fluent = judge(batch.column("text"))
            yield batch.filter(pa.array((best > least) & (np.nan_to_num(fluent, nan=-np.inf) >= least_fluent) & (np.array(langs, object) != UNKNOWN), pa.bool_()))

    return sieve


def accepted(docs: DataFrame, path_of: Callable[[], str] = default_path, least: float = LEAST, least_fluent: float = LEAST_FLUENT) -> DataFrame:
    """The rows of ``docs`` whose language can be told: not ``und``, likelier than ``least`` in some language, and as fluent in it as ``least_fluent``."""
    return docs.mapInArrow(_sieve(fit(docs, path_of), path_of, least, least_fluent), docs.schema)
