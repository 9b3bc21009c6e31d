"""Benchmark decontamination by template windows.

Words become typed slots where they are numbers, units after a number, or names (capitalised words),
and stay as lower-case words elsewhere. Windows of five canonical words are hashed in two channels:
``literal``, where all words stay words, numbers too, and ``template``, where they are slots. The windows of
documents and benchmark are two tables joined on the hash. A document holds an item if 0.8 of the item's windows of
a channel stand in it; in the template channel they must also stand together in an occurrence whose slots are
consistent, which tells a re-parameterised question from chance: one value of the item always becomes one value of the
document, and one value of the document always stands for one of the item, for at least 0.8 of the slots of each type, either way.
Each of several occurrences in a document is looked at by itself. It must also keep a fifth of the item's words (two
at least), numbers apart, as they are: a copy of which less is left, all names and numbers, is not told from other
texts of that form and not reported. An item of fewer words than a window is a window by itself, in the literal channel only.

Of the documents' windows only those leave a task whose place is set in a bit map of the benchmark's hashes. The map has
16 places for each window of the benchmark, up to a fixed most (``blocks.bit_map``): it is all that is sent out, and it spares work but decides
nothing. No text of the benchmark reaches the driver.

Null and empty texts and items hold nothing and are never reported; null ids are carried; repeated rows are
reported once for each pair of ids; an empty table on either side gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import BitMap, bit_map
from .common import Staged
from .words import Portion, Powers, of_process, portions, sliced

WINDOW, SHARE = 5, 0.8
#: Words are parted as in ``words``.
ASCII_SPACE = re.compile(r"[\t-\r ]+")
NUMBER = re.compile(r"[+-]?[$€£]?\d[\d.,:/]*%?(?:st|nd|rd|th)?")
#: Units that a number may stand before.
UNITS = frozenset("mm cm m km in ft mi mg g kg lb oz ml l s sec min h hr hour hours day days week weeks month months year years dollar dollars cent cents euro euros percent mph kmh meter meters metre metres mile miles gram grams kilogram kilograms liter liters litre litres second seconds minute minutes inch inches foot feet".split())
EDGES = "\"'`.,;:!?()[]{}<>*_~|…“”‘’«»¿¡"
NUM, UNIT, NAME = "\0n", "\0u", "\0p"
SLOTS = (NUM, UNIT, NAME)
#: Words whose forms a task remembers.
MEMO = 300_000
#: Share of the item's words, numbers apart, that an occurrence keeps as they are (two at least): slots alone are of one form in many texts.
KEPT = 0.2
#: Matches of windows looked at together.
PAIRS = 1 << 18
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def _forms(raw: str) -> tuple[str, str]:
    """Literal and template form of a word, empty for punctuation only."""
    bare = raw.strip(EDGES)
    if not bare:
        return "", ""
    low = bare.lower()
    if (bare[0].isdigit() or bare[0] in "+-$€£") and NUMBER.fullmatch(bare):
        return low, NUM
    return low, NAME if bare[0].isupper() else low


def canonical(text: str | None) -> tuple[list[str], list[str]]:
    """Literal and template words of a text; words of punctuation only are left out."""
    forms = [f for f in map(_forms, ASCII_SPACE.split(text or "")) if f[0]]
    literal, template = [f[0] for f in forms], [f[1] for f in forms]
    for i in range(1, len(forms)):
        if literal[i] in UNITS and template[i - 1] == NUM:
            template[i] = UNIT
    return literal, template


def _code(form: str) -> int:
    return xxhash.xxh64_intdigest(form.encode())


class _Coder:
    """Raw words by their hash, sorted, and in ``table`` for each: literal and template hash, what it is (``PLAIN``, ``NO_WORD``, a number or a unit), when it was last met."""

    PLAIN, NO_WORD, IS_NUM, IS_UNIT = range(4)

    def __init__(self):
        self.known, self.table, self.tick = np.empty(0, "u8"), np.empty((4, 0), "u8"), 0
        self.powers = Powers()
        self.slots = {slot: _code(slot) for slot in SLOTS}

    @staticmethod
    def at() -> _Coder:
        """The process's coder; what it knows of words serves the next task."""
        return of_process(("benchmark",), _Coder)

    def _learn(self, hashes: np.ndarray, words: list[str]) -> None:
        rows = []
        for raw in words:
            literal, template = _forms(raw)
            code = _code(literal)
            kind = self.NO_WORD if not literal else self.IS_NUM if template == NUM else self.IS_UNIT if literal in UNITS else self.PLAIN
            rows.append((code, self.slots.get(template, code), kind, self.tick))
        place = np.searchsorted(self.known, hashes)
        self.known = np.insert(self.known, place, hashes)
        self.table = np.insert(self.table, place, np.array(rows, "u8").T, axis=1)

    def channels(self, portion: Portion) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Literal and template hashes of the words of all texts, and the text of each."""
        self.tick += 1
        if len(self.known) > MEMO:
            kept = self.table[3] > np.median(self.table[3])
            self.known, self.table = self.known[kept], self.table[:, kept]
        distinct, first, inverse = np.unique(portion.hashes, return_index=True, return_inverse=True)
        at = np.searchsorted(self.known, distinct)
        new = at == len(self.known)
        new[~new] = self.known[at[~new]] != distinct[~new]
        if new.any():
            self._learn(distinct[new], portion.words_at(first[new]))
            at = np.searchsorted(self.known, distinct)
        self.table[3, at] = self.tick
        codes = at[inverse]
        literal, template, kind = (row[codes] for row in self.table[:3])
        text = np.repeat(np.arange(len(portion.counts)), portion.counts)
        if (kind == self.NO_WORD).any():
            kept = kind != self.NO_WORD
            literal, template, kind, text = literal[kept], template[kept], kind[kept], text[kept]
        after = np.flatnonzero((kind[1:] == self.IS_UNIT) & (kind[:-1] == self.IS_NUM) & (text[1:] == text[:-1])) + 1
        template[after] = self.slots[UNIT]
        return literal, template, text


def windows(words: np.ndarray, channel: int, width: int) -> np.ndarray:
    """A hash of each window of hashed words."""
    found = np.full(max(len(words) - width + 1, 0), channel * 8 + width, "u8")
    for i in range(width):
        found = (found ^ words[i : i + len(found)]) * MULTIPLIER
        found ^= found >> np.uint64(29)
    return found


def _known_windows(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each window of known words, and where those windows start. Unknown words are -1."""
    found = windows(ids.astype("u8"), 1, WINDOW)
    if not len(found):
        return found, np.empty(0, np.int64)
    gone = np.concatenate(([0], np.cumsum(ids < 0)))
    at = np.flatnonzero(gone[WINDOW:] == gone[:-WINDOW])
    return found[at], at


def _item_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct windows of each item, how many there are of the channel, and how many words each spans."""
    for batch in batches:
        for item, text in zip(batch.column("item").to_pylist(), batch.column("text").to_pylist()):
            forms = canonical(text)
            width = min(WINDOW, len(forms[0]))
            for channel, words in enumerate(forms if width == WINDOW else forms[:1] if width else ()):
                found = np.unique(windows(np.array([_code(w) for w in words], "u8"), channel, width))
                n = len(found)
                yield pa.RecordBatch.from_arrays([pa.array([item] * n, pa.int64()), pa.array([channel] * n, pa.int32()), pa.array([width] * n, pa.int32()), pa.array([n] * n, pa.int32()), pa.array(found.view("i8"))], ["item", "channel", "width", "n", "window"])


def _found(known: BitMap, widths: list[int]):
    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _Coder.at()
        for batch in batches:
            rows = batch.column("row").to_numpy()
            for portion in portions(batch.column("text"), coder.powers, most=1 << 20):
                literal, template, text = coder.channels(portion)
                for width in widths:
                    for channel, words in enumerate((literal, template) if width == WINDOW else (literal,)):
                        hashes = windows(words, channel, width)
                        at = np.flatnonzero(known.has(hashes))
                        at = at[text[at] == text[at + width - 1]]
                        if at.size:
                            # a window of a text counts once
                            pairs = np.unique(np.stack((text[at].astype("u8"), hashes[at])), axis=1)
                            yield pa.RecordBatch.from_arrays([pa.array(rows[portion.first + pairs[0].astype(np.int64)]), pa.array(pairs[1].view("i8"))], ["row", "window"])

    return found


class Item:
    """A benchmark item and where texts hold it."""

    def __init__(self, text: str):
        self.literal, self.template = canonical(text)
        self.words: dict[str, int] = {}
        for w in self.template:
            self.words.setdefault(w, len(self.words))

    def occurrence(self, literal: list[str], template: list[str]) -> float:
        """The best slot share of an occurrence of the item, -1 without one.

        Matching windows are taken together by start minus place in the item: equal ones, those within half the
        item's length (words put in or left out), and all of the text. An occurrence has SHARE of the item's windows.
        """
        own = self.template
        last = len(own) - WINDOW + 1
        held = self.words.get
        codes = _known_windows(np.array([self.words[w] for w in own]))[0]
        order = np.argsort(codes, kind="stable")
        found, at = _known_windows(np.fromiter((held(w, -1) for w in template), np.int64, len(template)))
        low, high = np.searchsorted(codes, found, "left", sorter=order), np.searchsorted(codes, found, "right", sorter=order)
        hit = high > low
        low, times, at = low[hit], (high - low)[hit], at[hit]
        most = max(1, PAIRS // last)
        best, reach = -1.0, len(own) + len(own) // 2
        for a in range(0, max(len(at), 1), most):
            # a stretch of matches, and those after it that an occurrence can reach
            b = int(np.searchsorted(at, at[min(a + most, len(at)) - 1] + reach, "right")) if len(at) else 0
            several = times[a:b]
            starts = np.repeat(at[a:b], several)
            places = order[np.repeat(low[a:b] - np.cumsum(several) + several, several) + np.arange(several.sum())]
            best = max(best, self._best(starts, places, literal))
            if best >= 1.0:
                break
        return best

    def _best(self, starts: np.ndarray, places: np.ndarray, literal: list[str]) -> float:
        own = self.template
        need = SHARE * (len(own) - WINDOW + 1) - 1e-9
        by = np.argsort(starts - places, kind="stable")
        starts, places = starts[by], places[by]
        shift = starts - places
        offsets, first = np.unique(shift, return_index=True)
        best, before = -1.0, first
        for slack in (0, len(own) // 2):
            ends = np.searchsorted(shift, offsets + slack, "right")
            some = (ends - first >= need) & (ends > before)
            before = ends
            for a, b in zip(first[some].tolist(), ends[some].tolist()):
                best = max(best, self._slots(starts[a:b], places[a:b], literal, need))
                if best >= 1.0:
                    return best
        return max(best, self._slots(starts, places, literal, need))

    def _slots(self, starts: np.ndarray, places: np.ndarray, literal: list[str], need: float) -> float:
        """Share of the slots under these windows that are consistent, the least of all types and both ways; -1 for too few windows or kept words."""
        values, own = self.literal, self.template
        if len(np.unique(places)) < need:
            return -1.0
        steps = np.arange(WINDOW)
        pairs = np.stack(np.divmod(np.unique((places[:, None] + steps) * len(literal) + starts[:, None] + steps), len(literal)))
        kept = {i for i, s in pairs.T.tolist() if values[i] == literal[s] and own[i] != NUM}
        if len(kept) < max(KEPT * len(own), 2):
            return -1.0
        shares = [1.0]
        for kind in SLOTS:
            mine = [(values[i], literal[s]) for i, s in pairs.T.tolist() if own[i] == kind]
            for way in (mine, [(b, a) for a, b in mine]):
                told: dict[str, Counter] = {}
                for a, b in way:
                    told.setdefault(a, Counter())[b] += 1
                if mine:
                    shares.append(sum(max(x.values()) for x in told.values()) / len(mine))
        return min(shares)


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the slot share of rows with enough template windows."""
    items: dict[str, Item] = {}
    read, forms = None, ([], [])
    for batch in chain.from_iterable(map(sliced, batches)):
        slots = []
        for text, item, share in zip(*(batch.column(c) for c in ("text", "item_text", "template_share"))):
            if (share.as_py() or 0.0) < SHARE - 1e-9:
                slots.append(0.0)
                continue
            if len(items) > 10_000:
                items.clear()
            item, text = item.as_py(), text.as_py()
            if item not in items:
                items[item] = Item(item)
            if text != read:
                read, forms = text, canonical(text)
            slots.append(max(items[item].occurrence(*forms), 0.0))
        kept = batch.drop_columns(["text", "item_text"])
        yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(slots, pa.float64())], [*kept.schema.names, "slot_share"])


def scan(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """A row for each document (doc_id, text) and item (item_id, text) that it holds: doc_id, item_id, literal_share, template_share, slot_share."""
    kind, item_kind = (df.schema[c].dataType.simpleString() for df, c in ((docs, "doc_id"), (benchmark, "item_id")))
    items = benchmark.where("text is not null").select("item_id", "text").distinct().withColumn("item", F.xxhash64("item_id", "text"))
    own = Staged(items.mapInArrow(_item_windows, "item long, channel int, width int, n int, window long"), "benchmark-windows").read()
    widths = sorted(r["width"] for r in own.select("width").distinct().collect())  # WINDOW of them at most
    rows = docs.select("doc_id", "text").where("text is not null").withColumn("row", F.xxhash64("doc_id", "text"))
    met = rows.select("row", "text").mapInArrow(_found(bit_map(own, "window"), widths), "row long, window long")
    # rows of one id and text have one number, and their windows count once
    shared = met.join(own.select("window", "item", "channel", "n"), "window").groupBy("row", "item", "channel", "n").agg(F.count_distinct("window").alias("held"))
    enough = shared.where(F.col("held") >= F.col("n") * SHARE - 1e-9).withColumn("share", F.col("held") / F.col("n"))
    share = lambda channel: F.coalesce(F.max(F.when(F.col("channel") == channel, F.col("share"))), F.lit(0.0))
    held = Staged(enough.groupBy("row", "item").agg(share(0).alias("literal_share"), share(1).alias("template_share")), "benchmark-held").read()
    texts = rows.join(held.select("row").distinct(), "row", "left_semi").dropDuplicates(["row"])
    asked = held.join(items.withColumnRenamed("text", "item_text"), "item").join(texts, "row").select("doc_id", "item_id", "literal_share", "template_share", "text", "item_text")
    shape = f"doc_id {kind}, item_id {item_kind}, literal_share double, template_share double, slot_share double"
    said = asked.mapInArrow(_verify, shape).where((F.col("literal_share") > 0) | (F.col("slot_share") >= SHARE - 1e-9))
    return said.groupBy("doc_id", "item_id").agg(*[F.max(c).alias(c) for c in ("literal_share", "template_share", "slot_share")])


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that hold no item. A row without a doc_id stays."""
    held = scan(docs.where("doc_id is not null"), benchmark).select("doc_id").distinct()
    return docs.join(held, "doc_id", "left_anti").select(docs.columns)
