"""Best-fit packing of token sequences, planned on the histogram of lengths.

A document is its tokens and an end id; one longer than a sequence is cut, and its first piece takes
what isn't a whole sequence. Encoding tasks count their pieces by length as they go, so each piece
knows its rank among its task's pieces of that length. Counts by task and length, added up in Spark,
give its rank among all. The plan sees only how many pieces of each length there are: best fit, longest
first, puts groups of equal pieces into groups of equally full sequences. It is a list of runs ("ranks
from..to of this length go to these sequences, so many in each, from this offset"), of a size bounded
by the sequence length and not by the input; a piece finds its slot by joining on length and rank.

Encoding works on words with the white space before them, through a bounded cache: the vocabulary's
own split never joins a character that isn't white space with white space after it, so the ids of a
text are those of its words in order. ``write_pieces`` expects a vocabulary with that split
(``byte_bpe_50k.json``).

Defined cases: a null or empty text is the end id alone. Every row is a document of its own, also with
a null or repeated doc_id. Which of two pieces of one length takes which of their slots depends on the
input's partitions; the number of sequences and all lengths and offsets do not. A very long text is
encoded in one task. Empty tables give empty results; extra columns are ignored.
"""

from __future__ import annotations

import functools
import gc
import json
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import text as T
from .store import BATCH_ROWS, arrow_rows, materialise
from .tokens import byte_alphabet

CAPACITY = 1024
END_ID = 2
CACHE_WORDS = 600_000
#: Longer words are encoded each time.
CACHED_BYTES = 64

#: White space of Unicode.
_SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_WORD = re.compile(f"[{_SPACE}]*[^{_SPACE}]+|[{_SPACE}]+")
#: What libraries don't agree on as white space, and the start of the added token's spelling: such texts are encoded whole.
_WHOLE = ("\x1c", "\x1d", "\x1e", "\x1f", "\u180e", "\u200b", "\ufeff", "<|")
#: The same, and white space beyond ASCII, in UTF-8: such texts are cut one by one.
_SPECIAL = re.compile("|".join([*_WHOLE[:4], *(re.escape(c) for c in _WHOLE[4:]), *"\x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000"]).encode() + b"|\xe2\x80[\x80-\x8a]")
_LETTER = "A-Za-zÀ-ÖØ-öø-ÿŒœ"
#: Any other character sends a word through the vocabulary's whole pipeline; the others' pieces are cut here by its own rule.
_ODD = re.compile(r"[^\x01\t-\r\x20-\x7EÀ-ÖØ-öø-ÿŒœ“”‘’–—…«»€£¿¡]")
#: That rule; ``\x01`` stands between words.
_PIECE = re.compile(rf"\x01|'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTER}]+| ?[0-9]+| ?[^\x01\t-\r {_LETTER}0-9]+|[\t-\r ]+(?![^\x01\t-\r ])|[\t-\r ]+")


class WordEncoder(dict):
    """The ids of words as little-endian 32-bit integers, each word encoded once while it is in the cache.

    A slice's distinct words are told apart by Arrow, byte by byte. The pieces of all new plain ones go to the library's BPE model in one call; the
    bytes that ids stand for tell where each word ends.
    """

    def __init__(self, tokenizer_json: str):
        from tokenizers import Tokenizer

        super().__init__()
        rules = json.loads(tokenizer_json)
        self._whole = Tokenizer.from_str(tokenizer_json)
        self._pieces = Tokenizer.from_str(json.dumps(rules | {"pre_tokenizer": {"type": "WhitespaceSplit"}, "added_tokens": []}))
        self._alphabet = dict(enumerate(byte_alphabet())) | {0: " ", 1: ""}
        self._size = np.zeros(max(rules["model"]["vocab"].values()) + 1, np.int64)
        for token, i in rules["model"]["vocab"].items():
            self._size[i] = len(token)  # a character for each byte

    def _learn(self, words: list[bytes]) -> None:
        joined, names = b"\x01".join(words).decode("utf-8", "replace"), words
        new = joined.split("\x01")
        if len(new) != len(words) or _ODD.search(joined):
            new = [x.decode("utf-8", "replace") for x in words]
            odd = [i for i, x in enumerate(new) if _ODD.search(x) or "\x01" in x]
            for i, x in zip(odd, self._whole.encode_batch_fast([new[i] for i in odd], add_special_tokens=False), strict=True):
                self[words[i]] = np.array(x.ids, "<u4").tobytes()
            left = sorted(set(range(len(new))).difference(odd))
            new, names = [new[i] for i in left], [words[i] for i in left]
            joined = "\x01".join(new)
        plain = names
        if not plain:
            return
        raw = (joined + "\x01").encode()
        spelled = "\0".join(_PIECE.findall(joined)).encode().decode("latin-1").translate(self._alphabet)
        ids = np.array(self._pieces.encode_batch_fast([spelled], add_special_tokens=False)[0].ids, "<u4")
        close = np.flatnonzero(np.frombuffer(raw, np.uint8) == 1)
        ends = np.searchsorted(np.cumsum(self._size[ids]), close - np.arange(len(close))) + 1
        data, start = ids.tobytes(), 0
        for word, end in zip(plain, (4 * ends).tolist(), strict=True):
            self[word] = data[start:end]
            start = end

    def encode(self, texts: list[bytes], end_id: int = END_ID) -> list[bytes]:
        """The ids of each text, and the end id."""
        special = [i for i, x in enumerate(texts) if _SPECIAL.search(x)]
        plain = list(texts)
        for i in special:
            plain[i] = b""
        words, indices, places = T.distinct_words(np.frombuffer(b"".join(plain), np.uint8), np.cumsum([0, *map(len, plain)]))
        out = T.joined_values(self._ids(words), indices, places)
        for i in special:
            out[i] = self._by_words(texts[i].decode("utf-8", "replace"))
        end = struct.pack("<I", end_id)
        return [x + end for x in out]

    def _ids(self, words: list[bytes]) -> list[bytes]:
        """The ids of each of some distinct words."""
        if len(self) + len(words) > CACHE_WORDS:
            self.clear()
        new = [x for x in words if x not in self]
        if new:
            self._learn(new)
        out = list(map(self.__getitem__, words))
        for x in [x for x in new if len(x) > CACHED_BYTES]:
            del self[x]
        return out

    def _by_words(self, text: str) -> bytes:
        if any(c in text for c in _WHOLE):
            return np.array(self._whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        words = [x.encode() for x in _WORD.findall(text)]
        known = list(dict.fromkeys(words))
        return b"".join(map(dict(zip(known, self._ids(known), strict=True)).__getitem__, words))


@functools.lru_cache(maxsize=1)
def word_encoder(tokenizer_json: str) -> WordEncoder:
    """A worker's encoder: its later tasks find the words of the earlier ones."""
    return WordEncoder(tokenizer_json)


def cut(n: int, capacity: int = CAPACITY) -> list[int]:
    """The lengths of a document's pieces."""
    first = n % capacity
    return [first] * (first > 0) + [capacity] * (n // capacity)


def _pieces(s: T.Slice, encoder: WordEncoder, part: int, seen: list[int], end_id: int, capacity: int) -> pa.RecordBatch:
    """The pieces of a slice's documents; ``seen`` counts the task's by length."""
    names, pieces, starts, lengths, ids, places = [], [], [], [], [], []
    for name, data in zip(s.batch.column(0).to_pylist(), encoder.encode([s.text_bytes(i) for i in range(s.n)], end_id), strict=True):
        start = 0
        for k, n in enumerate(cut(len(data) // 4, capacity)):
            names.append(name)
            pieces.append(k)
            starts.append(start)
            lengths.append(n)
            ids.append(data[4 * start : 4 * (start + n)])
            places.append(seen[n])
            seen[n] += 1
            start += n
    return pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(pieces, pa.int32()), pa.array(starts, pa.int64()), pa.array(lengths, pa.int64()), pa.array(ids, pa.binary()), pa.array([part] * len(names), pa.int32()), pa.array(places, pa.int64())], ["doc_id", "piece", "start", "length", "ids", "part", "place"])


def write_pieces(docs: DataFrame, tokenizer_file: str, end_id: int = END_ID, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids, part, place) of ``docs(doc_id, text)``: ``ids`` are little-endian 32-bit integers, ``place`` the rank by length in task ``part``."""
    spark = docs.sparkSession
    with open(tokenizer_file, encoding="utf-8") as f:
        model = spark.sparkContext.broadcast(f.read())  # one vocabulary: its size doesn't depend on the input

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, seen = word_encoder(model.value), TaskContext.get().partitionId(), [0] * (capacity + 1)
        gc.disable()  # a slice is millions of strings and no cycle
        try:
            for s in T.slices(batches):
                yield _pieces(s, encoder, part, seen, end_id, capacity)
        finally:
            gc.enable()

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    with arrow_rows(spark, BATCH_ROWS):
        return materialise(own.mapInArrow(run, "doc_id long, piece int, start long, length long, ids binary, part int, place long"), "pieces")


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Runs (length, first rank, rank after the last, first sequence, pieces in each, offset) of best fit, longest first.

    ``free`` has ranges of sequences with the same room left. All pieces of a length that fit a
    sequence go there before the next one is opened, as best fit one by one would do: the sequence
    just used has the least room that still fits.
    """
    free: dict[int, list[tuple[int, int]]] = {}
    runs, sequences = [], 0
    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        for room in range(length, capacity + 1):
            ranges = free.get(room, [])
            while left and ranges:
                first, n = ranges.pop()
                left, rank = _fill(runs, free, (first, n), room, length, left, rank, capacity)
            if not left:
                break
        if left:
            each = capacity // length
            n = -(-left // each)
            _fill(runs, free, (sequences, n), capacity, length, left, rank, capacity)
            sequences += n
    return runs


def _fill(runs: list, free: dict, sequences: tuple[int, int], room: int, length: int, left: int, rank: int, capacity: int) -> tuple[int, int]:
    """Put up to ``left`` pieces into a range of sequences; (pieces left, next rank)."""
    first, n = sequences
    each = room // length
    full = min(n, left // each)
    more = left - full * each if full < n else 0
    for begin, count, k in ((first, full, each), (first + full, int(more > 0), more)):
        if count:
            runs.append((length, rank, rank + count * k, begin, k, capacity - room))
            rank += count * k
            free.setdefault(room - k * length, []).append((begin, count))
    used = full + (more > 0)
    if used < n:
        free.setdefault(room, []).append((first + used, n - used))
    return left - full * each - more, rank


def pack(docs: DataFrame, tokenizer_file: str, end_id: int = END_ID, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids, sequence_id, offset): every piece and its place in a sequence."""
    spark = docs.sparkSession
    pieces = write_pieces(docs, tokenizer_file, end_id, capacity)
    by_task = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = materialise(by_task.withColumn("base", F.coalesce(F.sum("n").over(earlier), F.lit(0))), "piece-counts")
    counts = {r.length: r.n for r in bases.groupBy("length").agg(F.sum("n").alias("n")).toLocalIterator()}  # at most one row a length
    slots = spark.createDataFrame(plan(counts, capacity), "length long, low long, high long, first long, each long, at long")
    ranked = pieces.join(bases.select("part", "length", "base"), ["part", "length"]).withColumn("rank", F.col("base") + F.col("place"))
    placed = ranked.join(F.broadcast(slots), "length").where((F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high")))  # bounded by the capacity
    within = F.col("rank") - F.col("low")
    return placed.select("doc_id", "piece", "start", "length", "ids", (F.col("first") + F.floor(within / F.col("each"))).alias("sequence_id"), (F.col("at") + within % F.col("each") * F.col("length")).alias("offset"))


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, length, doc_ids, offsets, ids): whole sequences, each of at most the capacity."""
    rows = packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "doc_id", "length", "ids"))).alias("r"))
    joined = F.aggregate("r", F.lit(b""), lambda a, x: F.concat(a, x["ids"]))
    return rows.select("sequence_id", F.aggregate("r", F.lit(0).cast("long"), lambda a, x: a + x["length"]).alias("length"), F.col("r.doc_id").alias("doc_ids"), F.col("r.offset").alias("offsets"), joined.alias("ids"))


def report(docs: DataFrame, tokenizer_file: str) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset)."""
    return pack(docs, tokenizer_file).select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")
