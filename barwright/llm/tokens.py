"""Token-id files: each document's ids compressed on their own with a shared zstandard dictionary.

The dictionary is trained on the ids of a bounded sample of documents (``SAMPLE`` of them in
expectation, chosen by a hash; it changes the size of the files, never their content). Documents are
range-partitioned by doc_id before they are encoded, so only texts are shuffled, once. A file is a
Parquet table of blocks: a row holds the frames of some hundred documents end to end, their ids,
token counts and byte offsets, the dictionary's hash, and the tokens before the block in its part. The
dictionary is a table beside it, so a file is opened by its path alone (``TokenFile``). One document is found by the blocks' doc_id ranges and read by slicing its frame (``read_one``).

Ids are stored as unsigned 16-bit integers, or 32-bit where the vocabulary needs it. Null text counts
as empty (the end id alone); null doc_ids come first; repeated doc_ids follow the order of their texts'
hash; an empty table gives an empty file and result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import os
import re
import zlib
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import small_batches, staged_path, text_or_empty
from .words import Powers, of_process, spans, stretch_hashes

END, SAMPLE, DICT_BYTES, BLOCK_DOCS, BLOCK_BYTES = 1, 2000, 65536, 256, 1 << 20
BLOCKS = "part int, block long, dict_hash string, first_doc long, last_doc long, docs array<long>, tokens array<int>, offsets array<long>, start long, total long, width int, data binary"
#: Parts of words that a process remembers.
MEMO = 600_000
#: Documents handed to the writer at once, so that a task never holds all its texts in the JVM and in Python.
BATCH_DOCS = 1024


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


#: What the short way is held against the tokenizer on before it is taken, apart and as one text.
PROBE = (
    "The THE the Don't don't it's IT'S 'tis we'll we'LL they've y'all's o'clock' 's 'S ''s x's's",
    "a1b22c 3.14 (foo) [bar]. \"quoted.\" foo.'s end... wait--what?! a_b c/d e@f.g #h $5 50% \\ ^ ~`",
    "tab\tline\nfeed\rcarriage\x0bvertical\x0cform \x00 \x07 \x1f \u00a0 \u2003 \u3000 space",
    "Über ÜBER ﬁne naïve ciónñas. çà, élève; straße STRASSE œuvre ÿ× ÷ø µ ª º ¼ İstanbul ΣΊΣΥΦΟΣ Σ ΑΣ ΑΣ. ſ K Å",
    "e\u0301 cafe\u0301. a\u0300\u0316b \u0301x n\u0303, i\u0307 \u1e9b\u0323 한국어 \u1112\u1161\u11ab 日本語。 中文，标点 ไทย हिन्दी العربية",
    "\U0001f600 \U0001f468\u200d\U0001f469 “hello”. ‘so’, «oui» … – — €5 £3 ½ ² ① ٣ Ⅷ",
    "<|endoftext|> <|ENDOFTEXT|> x<|startoftext|>y <|end oftext|> <| |>",
    "",
    " \t\n ",
)
LATIN = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+")
LETTER, HIGH = np.zeros(256, bool), np.arange(256) >= 128
LETTER[[*range(65, 91), *range(97, 123)]] = True


class Encoder:
    """Ids of whole texts.

    The tokenizer never joins across white space, nor the letters that a word begins with and a sign or digit after them.
    So such parts of words are found and hashed as in ``words``, and each is encoded once and remembered (the ``MEMO``
    parts met last). That holds for the vocabulary in use, not for any: it is tried on ``PROBE`` first, and a tokenizer
    that gives other ids encodes whole texts by itself.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # one task, one thread
        self.tokenizer = Tokenizer.from_file(path)
        size = self.tokenizer.get_vocab_size()
        self.width = 2 if size <= 1 << 16 else 4
        self.closing = np.array([(self.tokenizer.id_to_token(i) or "").endswith("</w>") for i in range(size)])
        self.powers = Powers()
        self._forget(np.empty(0, np.int64), empty=True)
        self.tick, self.parted = 0, True
        texts = [*PROBE, " ".join(PROBE), "\n".join(PROBE)]
        plain = [e + [END] for e in self._encoded(texts)]
        self.parted = [x.tolist() for x in self.encode(pa.array(texts, pa.string()))] == plain

    @staticmethod
    def at(path: str) -> Encoder:
        """The process's encoder; what it remembers serves the next task."""
        return of_process(("tokens", path), lambda: Encoder(path))

    def _encoded(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _forget(self, kept: np.ndarray, empty: bool = False) -> None:
        """Known parts: sorted hashes, and of each the place and number of its ids and when it was last met."""
        if empty:
            self.known, self.ids = np.empty(0, "u8"), np.empty(0, "<u4")
            self.start, self.count, self.met = (np.empty(0, np.int64) for _ in range(3))
            return
        count = self.count[kept]
        self.ids = self.ids[_ranges(self.start[kept], count)]
        self.known, self.count, self.met, self.start = self.known[kept], count, self.met[kept], np.cumsum(count) - count

    def _learn(self, hashes: np.ndarray, parts: list[str]) -> None:
        """Words of Latin letters are encoded end to end: each closes with an id that only ends of words have."""
        latin = np.fromiter(map(bool, map(LATIN.fullmatch, parts)), bool, len(parts))
        order, made, count = [], [self.ids], []
        rest = np.flatnonzero(~latin).tolist()
        at = np.flatnonzero(latin)
        for i in range(0, len(at), 2000):
            some = at[i : i + 2000].tolist()
            ids = np.array(self._encoded([" ".join([parts[n] for n in some])])[0], "<u4")
            ends = np.flatnonzero(self.closing[ids]) + 1
            if len(ends) != len(some):
                rest += some
                continue
            order += some
            made.append(ids)
            count.append(np.diff(ends, prepend=0))
        single = self._encoded([parts[n] for n in rest])
        order += rest
        made.append(np.fromiter(chain.from_iterable(single), "<u4"))
        count = np.concatenate([*count, np.fromiter(map(len, single), np.int64, len(single))])
        start = len(self.ids) + np.cumsum(count) - count
        back = np.argsort(np.array(order, np.int64))
        self.ids = np.concatenate(made)
        place = np.searchsorted(self.known, hashes)
        self.known = np.insert(self.known, place, hashes)
        self.start, self.count = np.insert(self.start, place, start[back]), np.insert(self.count, place, count[back])
        self.met = np.insert(self.met, place, self.tick)

    def _parts(self, data: np.ndarray, bounds: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Words are parted after the letters they begin with if an ASCII sign or digit follows."""
        letter = LETTER[data]
        run = letter | HIGH[data]
        # two bytes of a Latin-1 letter end a run of letters as well
        before = letter.copy()
        before[1:] |= (data[:-1] == 0xC3) & (data[1:] != 0x97) & (data[1:] != 0xB7)
        stops = np.append(np.flatnonzero(~run), len(data))
        stop = stops[np.searchsorted(stops, starts)]
        cut = (stop > starts) & (stop < ends)
        cut[cut] = before[stop[cut] - 1]
        return np.sort(np.concatenate((starts, stop[cut]))), np.sort(np.concatenate((ends, stop[cut])))

    def encode(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """The ids of each text, END included. Null is empty."""
        if not self.parted:
            for some in texts:
                yield np.array(self._encoded([some.as_py() or ""])[0] + [END], "<u4")
            return
        for _, data, bounds, starts, ends in spans(texts, _lower, 1 << 20):
            starts, ends = self._parts(data, bounds, starts, ends)
            hashes, first, inverse = np.unique(stretch_hashes(data, starts, ends, self.powers), return_index=True, return_inverse=True)
            self.tick += 1
            at = np.searchsorted(self.known, hashes)
            new = at == len(self.known)
            new[~new] = self.known[at[~new]] != hashes[~new]
            if new.any():
                raw = data.tobytes()
                self._learn(hashes[new], [raw[a:b].decode() for a, b in zip(starts[first[new]].tolist(), ends[first[new]].tolist())])
                at = np.searchsorted(self.known, hashes)
            self.met[at] = self.tick
            at = at[inverse]
            count = self.count[at]
            ids = self.ids[_ranges(self.start[at], count)]
            sums = np.append(0, np.cumsum(count))
            stops = sums[np.searchsorted(starts, bounds)]
            ids, stops = np.insert(ids, stops[1:], END), stops + np.arange(len(stops))
            for a, b in zip(stops[:-1].tolist(), stops[1:].tolist()):
                yield ids[a:b]
            if len(self.known) > MEMO:
                self._forget(np.flatnonzero(self.met > np.median(self.met)))


def _lower(texts: pa.Array) -> pa.Array:
    """Special tokens are told by their case; the tokenizer lowers all else."""
    return pc.if_else(pc.match_substring(texts, "<|"), texts, pc.ascii_lower(texts))


def _ranges(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each, count of them, end to end."""
    before = np.cumsum(count) - count
    return np.repeat(start - before, count) + np.arange(count.sum())


def _trainer(path_of: Callable[[], str]):
    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.at(path_of())
        samples = []
        for batch in batches:
            for ids in encoder.encode(batch.column("text")):
                raw = ids.astype(f"<u{encoder.width}").tobytes()
                samples += [raw[i : i + DICT_BYTES] for i in range(0, len(raw), DICT_BYTES)]
        samples.sort()
        try:
            made = zstandard.train_dictionary(DICT_BYTES, samples).as_bytes()
        except zstandard.ZstdError:  # too little to train on: the samples themselves serve as content
            made = b"".join(samples)[-DICT_BYTES:]
        yield pa.RecordBatch.from_arrays([pa.array([made], pa.binary())], ["made"])

    return train


def train_dictionary(docs: DataFrame, path_of: Callable[[], str] = default_path, sample: int = SAMPLE) -> bytes:
    rows = docs.count()
    share = F.pmod(F.xxhash64(F.lit("dictionary"), "doc_id"), F.lit(1 << 30)) < int(min(1.0, sample / max(rows, 1)) * (1 << 30))
    chosen = docs.where(share).select(text_or_empty().alias("text")).limit(4 * sample).coalesce(1)
    made = chosen.mapInArrow(_trainer(path_of), "made binary").first()
    return bytes(made["made"]) if made else b""


def _dictionary(made: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(made) if len(made) >= 8 else None


def _writer(path_of: Callable[[], str], made: bytes):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.at(path_of())
        packer = zstandard.ZstdCompressor(level=3, dict_data=_dictionary(made)) if _dictionary(made) else zstandard.ZstdCompressor(level=3)
        part, name = TaskContext.get().partitionId(), hashlib.sha256(made).hexdigest()
        number = start = held = 0
        kind = f"<u{encoder.width}"
        docs: list = []
        frames: list[bytes] = []
        counts: list[int] = []

        def flush() -> pa.RecordBatch:
            nonlocal number, start, held
            total = sum(counts)
            ids = [d for d in docs if d is not None]
            row = [part, number, name, min(ids, default=None), max(ids, default=None), list(docs), list(counts), np.cumsum([0] + [len(f) for f in frames]).tolist(), start, total, encoder.width, b"".join(frames)]
            kinds = [pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
            number, start, held = number + 1, start + total, 0
            for x in (docs, frames, counts):
                x.clear()
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds)], [c.split()[0] for c in BLOCKS.split(", ")])

        for batch in batches:
            for doc, ids in zip(batch.column("doc_id").to_pylist(), encoder.encode(batch.column("text"))):
                docs.append(doc)
                counts.append(len(ids))
                frames.append(packer.compress(ids.astype(kind).tobytes()))
                held += len(frames[-1])
                if len(docs) >= BLOCK_DOCS or held >= BLOCK_BYTES:
                    yield flush()
        if docs:
            yield flush()

    return write


class TokenFile:
    """A folder of two Parquet tables: ``blocks`` and ``dictionary`` (name, made). Nothing else is needed to read it."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        found = spark.read.parquet(f"{path}/dictionary").first()
        self.name, self.made = found["name"], bytes(found["made"])

    def blocks(self) -> DataFrame:
        return self.spark.read.schema(BLOCKS).parquet(f"{self.path}/blocks")

    def read(self) -> DataFrame:
        """doc_id, start, n_tokens, ids_crc32 from the file, by decompressing every frame."""
        held = self.blocks()
        # one row per part of the file: as many as the shuffle had partitions
        parts = held.groupBy("part").agg(F.sum("total").alias("total")).withColumn("before", F.sum("total").over(Window.orderBy("part")) - F.col("total")).select("part", "before").collect()
        return held.mapInArrow(_reader(self.made, dict(map(tuple, parts))), "doc_id long, start long, n_tokens long, ids_crc32 long")

    def read_one(self, doc_id: int) -> list[list[int]]:
        """Ids of the documents of that id, reading only blocks whose range holds it and slicing out its frames."""
        packed = []
        for row in self.blocks().where((F.col("first_doc") <= doc_id) & (F.col("last_doc") >= doc_id)).orderBy("part", "block").toLocalIterator():
            frames = _Unpacker(self.made, row["dict_hash"])
            packed += [frames.ids(row["data"][row["offsets"][i] : row["offsets"][i + 1]], row["width"]).tolist() for i, d in enumerate(row["docs"]) if d == doc_id]
        return packed


class _Unpacker:
    def __init__(self, made: bytes, name: str):
        if hashlib.sha256(made).hexdigest() != name:
            raise ValueError("the block was written with another dictionary")
        known = _dictionary(made)
        self.unpack = (zstandard.ZstdDecompressor(dict_data=known) if known else zstandard.ZstdDecompressor()).decompress

    def ids(self, frame: bytes, width: int) -> np.ndarray:
        return np.frombuffer(self.unpack(frame), f"<u{width}").astype("<u4")


def _reader(made: bytes, before: dict[int, int]):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in chain.from_iterable(batch.slice(i, 1).to_pylist() for i in range(len(batch))):
                frames, start, out = _Unpacker(made, row["dict_hash"]), before[row["part"]] + row["start"], []
                for i, (doc, n) in enumerate(zip(row["docs"], row["tokens"])):
                    ids = frames.ids(row["data"][row["offsets"][i] : row["offsets"][i + 1]], row["width"])
                    if len(ids) != n:
                        raise ValueError(f"document {doc}: {len(ids)} ids, {n} in the index")
                    out.append((doc, start, n, zlib.crc32(ids.tobytes())))
                    start += n
                yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in zip(*out)], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return read


def write(docs: DataFrame, path: str | None = None, path_of: Callable[[], str] = default_path, sample: int = SAMPLE) -> TokenFile:
    """Encode every whole text of ``docs`` (doc_id, text) into a file at ``path`` (new; by default in the shared folder), in ascending doc_id order.
    ``path_of`` gives the tokenizer's path where it runs."""
    spark = docs.sparkSession
    path = path or staged_path(spark, "tokens")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    made = train_dictionary(rows, path_of, sample)
    spark.createDataFrame([(hashlib.sha256(made).hexdigest(), made)], "name string, made binary").coalesce(1).write.parquet(f"{path}/dictionary")
    tie = F.xxhash64("text")
    placed = rows.withColumn("tie", tie).repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")
    with small_batches(spark, BATCH_DOCS):
        placed.mapInArrow(_writer(path_of, made), BLOCKS).write.parquet(f"{path}/blocks")
    return TokenFile(spark, path)


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32, read back from the file."""
    return write(docs).read()
