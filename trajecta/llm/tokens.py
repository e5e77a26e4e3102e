"""Token-id output in patched frame-of-reference blocks.

Documents are dealt by ranges of doc_id, sorted, encoded with a public tokenizer, and written as
shards. A shard is one binary value; Spark's Parquet writer is the container, so a write commits
atomically on any file system and survives lost executors. Layout of a shard, little-endian:

    "TPF1", u32 block size, u64 ids, u32 documents, u32 blocks
    i64 doc_id per document, u8 null flag per document, u64 first id per document and the end
    u64 start of each block's bytes and the end (the block index)
    per block: u32 minimum, u8 width, u16 exceptions, packed low bits, u16 places, u32 high bits

A block holds ids less their minimum, packed at the width that ``PERCENTILE`` of them fit into;
higher bits of the others stand in the exception list. ``decode_range`` reads any range of ids
through the block index.

Encoding works on words and the pre-tokens of the vocabulary's own split, through bounded caches: the
tokenizer drops white space, so the ids of a text are those of its words in order. Pre-tokens of plain Latin
text are cut here and go to the library's BPE model; words with any other character go through its
whole pipeline. ``write_tokens`` expects a vocabulary with that split (``word_bpe_49k.json``).

Defined cases: a null text is empty; an empty text gives the end id alone; rows with equal doc_id
are ordered by their text's hash; a null doc_id sorts first; empty tables give empty output; extra
columns are ignored; a very long text is one document of its shard, held once in its task.
"""

from __future__ import annotations

import functools
import json
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import text as T

BLOCK = 1024
PERCENTILE = 95
SHARD_IDS = 1 << 18
END_ID = 1
CACHE_PIECES = 400_000
CACHE_WORDS = 600_000
#: Text of a slice: a frequent word is looked up once in each.
SLICE_BYTES = 8 << 20
#: Longer words are put together each time.
CACHED_BYTES = 64
_HEAD = struct.Struct("<4sIQII")
_BLOCK_HEAD = struct.Struct("<IBH")


#: Characters that the pre-tokenizer's rules are spelled out for here; NFC and lower-casing treat each alone.
_PLAIN = re.compile(r"[\x20\t\n\r\x0b\x0c\x21-\x7EÀ-ÖØ-öø-ÿŒœ“”‘’–—…«»€£]*")
#: The vocabulary file's own split of lower-cased text, over those characters.
_PIECE = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿœ]+|[0-9]|[^a-zß-öø-ÿœ0-9\x20\t\n\r\x0b\x0c]+")
#: The same where ``\x01`` stands between words, and the id that stands for it.
_MARKED = re.compile(_PIECE.pattern.replace("[^a-z", "[^\x01a-z") + "|\x01")
_BETWEEN = 0xFFFFFFFF


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(other)) for b in range(256)]


class Encoder(dict):
    """Ids of pieces as little-endian u32 bytes, each distinct piece encoded once while it is in the cache.

    A key is a pre-token of the vocabulary's split or, after a line break, a whole word with characters
    outside ``_PLAIN``. New pre-tokens of a slice go to the library's BPE in one call; the ids of each
    end with one that closes a word, so the result falls apart again into pieces. A slice's distinct words
    are told apart by Arrow, byte by byte; what each is put together from is kept in a cache of its own.
    """

    def __init__(self, tokenizer_json: str):
        from tokenizers import Tokenizer

        super().__init__()
        self._words: dict[bytes, bytes] = {}
        self._whole = Tokenizer.from_str(tokenizer_json)
        rules = json.loads(tokenizer_json)
        suffix = rules["model"]["end_of_word_suffix"]
        self._pieces = Tokenizer.from_str(json.dumps(rules | {"normalizer": None, "pre_tokenizer": {"type": "WhitespaceSplit"}, "added_tokens": []}))
        self._closes = np.zeros(max(rules["model"]["vocab"].values()) + 1, bool)
        self._closes[[i for t, i in rules["model"]["vocab"].items() if t.endswith(suffix)]] = True
        self._alphabet = {b: c for b, c in enumerate(byte_alphabet()) if b != 0x20}

    def _learn(self, new: list[str]) -> None:
        plain, odd = [x for x in new if x[0] != "\n"], [x for x in new if x[0] == "\n"]
        spelled = " ".join(plain).encode().decode("latin-1").translate(self._alphabet)
        ids = np.array(self._pieces.encode_batch_fast([spelled], add_special_tokens=False)[0].ids, "<u4")
        end = 4 * (np.flatnonzero(self._closes[ids]) + 1)
        if len(end) != len(plain):
            raise RuntimeError("the vocabulary doesn't close each piece with one id")
        data, start = ids.tobytes(), 0
        for piece, e in zip(plain, end.tolist(), strict=True):
            self[piece] = data[start:e]
            start = e
        for piece, x in zip(odd, self._whole.encode_batch_fast([x[1:] for x in odd], add_special_tokens=False), strict=True):
            self[piece] = np.array(x.ids, "<u4").tobytes()

    def encode(self, texts: list[bytes], end_id: int | None = END_ID) -> list[np.ndarray]:
        """The ids of each text, and the end id."""
        words, indices, places = T.distinct_bare_words(np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)]))
        end = b"" if end_id is None else struct.pack("<I", end_id)
        return [np.frombuffer(x + end, "<u4") for x in T.joined_values(self._ids(words), indices, places)]

    def _ids(self, words: list[bytes]) -> list[bytes]:
        """The ids of each of some distinct words."""
        known = self._words
        if len(known) + len(words) > CACHE_WORDS:
            known.clear()
        found = list(map(known.get, words))
        new = [x for x, ids in zip(words, found, strict=True) if ids is None]
        if not new:
            return found
        made = self._learn_words(new)
        known.update((x, ids) for x, ids in zip(new, made, strict=True) if len(x) <= CACHED_BYTES)
        left = iter(made)
        return [next(left) if ids is None else ids for ids in found]

    def _learn_words(self, new: list[bytes]) -> list[bytes]:
        """The ids of words, put together from those of their pieces."""
        names, plain = [x.decode("utf-8", "replace") for x in new], _PLAIN.fullmatch
        whole = {i: "\n" + x for i, x in enumerate(names) if "<|" in x or not plain(x)}
        for i in whole:
            names[i] = ""
        pieces = _MARKED.findall("\x01".join([*names, ""]).lower())
        wanted = {*pieces, *whole.values()} - {"\x01"}
        if len(self) + len(wanted) > CACHE_PIECES:
            self.clear()
        if unknown := [x for x in wanted if x not in self]:
            self._learn(unknown)
        self["\x01"] = struct.pack("<I", _BETWEEN)
        data = b"".join(map(self.__getitem__, pieces))
        del self["\x01"]
        ends = (4 * np.flatnonzero(np.frombuffer(data, "<u4") == _BETWEEN)).tolist()
        made = [data[a:b] for a, b in zip([0, *(x + 4 for x in ends[:-1])], ends, strict=True)]
        for i, piece in whole.items():
            made[i] = self[piece]
        return made


@functools.lru_cache(maxsize=1)
def piece_encoder(tokenizer_json: str) -> Encoder:
    """A worker's encoder: its later tasks find the pieces of the earlier ones."""
    return Encoder(tokenizer_json)


def _packed(values: np.ndarray, width: int) -> np.ndarray:
    """Rows of values packed at ``width`` bits each."""
    used = -(-width // 8)
    raw = np.ascontiguousarray(values.astype("<u4").view(np.uint8).reshape(*values.shape, 4)[:, :, :used])
    if width % 8 == 0:
        return raw.reshape(len(values), -1)
    bits = np.unpackbits(raw, axis=2, bitorder="little")[:, :, :width]
    return np.packbits(bits.reshape(len(values), -1), axis=1, bitorder="little")


def encode_blocks(ids: np.ndarray, block: int = BLOCK, percentile: int = PERCENTILE) -> list[bytes]:
    """Each block of ids as bytes."""
    n = -(-len(ids) // block)
    full = np.zeros(n * block, np.uint32)
    full[: len(ids)] = ids
    full[len(ids) :] = ids[-1] if len(ids) else 0
    table = full.reshape(n, block)
    low = table.min(axis=1)
    rest = table - low[:, None]
    at = min(block - 1, block * percentile // 100)
    limit = np.partition(rest, at, axis=1)[:, at]
    width = np.ceil(np.log2(limit.astype(np.float64) + 1)).astype(np.int64)
    out: list[bytes] = [b""] * n
    for wide in np.unique(width):
        rows = np.flatnonzero(width == wide)
        values = rest[rows]
        packed = _packed(values & np.uint32((1 << int(wide)) - 1), int(wide))
        high = values >> np.uint32(wide) if wide < 32 else np.zeros_like(values)
        for k, r in enumerate(rows):
            size = min(block, len(ids) - r * block)
            places = np.flatnonzero(high[k, :size])
            out[r] = _BLOCK_HEAD.pack(int(low[r]), int(wide), len(places)) + packed[k, : (size * int(wide) + 7) // 8].tobytes() + places.astype("<u2").tobytes() + high[k, places].astype("<u4").tobytes()
    return out


def decode_block(data: memoryview, size: int) -> np.ndarray:
    low, width, n = _BLOCK_HEAD.unpack_from(data, 0)
    at = _BLOCK_HEAD.size
    packed = (size * width + 7) // 8
    out = np.zeros(size, np.uint32)
    if width:
        bits = np.unpackbits(np.frombuffer(data, np.uint8, packed, at), bitorder="little", count=size * width).reshape(size, width)
        whole = np.zeros((size, 4), np.uint8)
        got = np.packbits(bits, axis=1, bitorder="little")
        whole[:, : got.shape[1]] = got
        out = whole.view("<u4").ravel().copy()
    if n:
        places = np.frombuffer(data, "<u2", n, at + packed)
        out[places] |= np.frombuffer(data, "<u4", n, at + packed + 2 * n) << np.uint32(width)
    return out + np.uint32(low)


def encode_shard(doc_ids: list[int | None], lengths: list[int], ids: np.ndarray, block: int = BLOCK, percentile: int = PERCENTILE) -> bytes:
    blocks = encode_blocks(ids, block, percentile)
    index = np.cumsum([0, *map(len, blocks)]).astype("<u8")
    return b"".join(
        [
            _HEAD.pack(b"TPF1", block, len(ids), len(doc_ids), len(blocks)),
            np.array([x or 0 for x in doc_ids], "<i8").tobytes(),
            np.array([x is None for x in doc_ids], np.uint8).tobytes(),
            np.cumsum([0, *lengths]).astype("<u8").tobytes(),
            index.tobytes(),
            *blocks,
        ]
    )


class Shard:
    """A shard's documents and ids, read through its block index."""

    def __init__(self, data: bytes):
        magic, self.block, self.n_ids, n, self.n_blocks = _HEAD.unpack_from(data, 0)
        if magic != b"TPF1":
            raise ValueError("not a token shard")
        at = _HEAD.size
        ids = np.frombuffer(data, "<i8", n, at)
        null = np.frombuffer(data, np.uint8, n, at + 8 * n)
        self.doc_ids = [None if z else int(x) for x, z in zip(ids, null, strict=True)]
        at += 9 * n
        self.starts = np.frombuffer(data, "<u8", n + 1, at).astype(np.int64)
        at += 8 * (n + 1)
        self.index = np.frombuffer(data, "<u8", self.n_blocks + 1, at).astype(np.int64)
        self.body = memoryview(data)[at + 8 * (self.n_blocks + 1) :]

    def decode_range(self, first: int, last: int) -> np.ndarray:
        """The ids first..last-1, decoding only the blocks that hold them."""
        if last <= first:
            return np.zeros(0, np.uint32)
        a, b = first // self.block, (last - 1) // self.block
        parts = [decode_block(self.body[self.index[k] : self.index[k + 1]], min(self.block, self.n_ids - k * self.block)) for k in range(a, b + 1)]
        return np.concatenate(parts)[first - a * self.block : last - a * self.block]


def write_tokens(docs: DataFrame, path: str, tokenizer_file: str, end_id: int = END_ID, shard_ids: int = SHARD_IDS, block: int = BLOCK, percentile: int = PERCENTILE) -> None:
    """Encode ``docs(doc_id, text)`` and write its shards, in ascending doc_id order, to ``path``."""
    spark = docs.sparkSession
    with open(tokenizer_file, encoding="utf-8") as f:
        model = spark.sparkContext.broadcast(f.read())  # one vocabulary: its size doesn't depend on the input

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part = piece_encoder(model.value), TaskContext.get().partitionId()
        names, lengths, pieces, held, before, shard = [], [], [], 0, 0, 0

        def flush() -> pa.RecordBatch:
            data = encode_shard(names, lengths, np.concatenate(pieces), block, percentile)
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([shard], pa.int32()), pa.array([before], pa.int64()), pa.array([held], pa.int64()), pa.array([data], pa.binary())], ["part", "shard", "first", "n_ids", "payload"])

        for s in T.slices(batches, limit=SLICE_BYTES):
            encoded = encoder.encode([s.text_bytes(i) for i in range(s.n)], end_id)
            for name, ids in zip(s.batch.column(0).to_pylist(), encoded, strict=True):
                names.append(name)
                lengths.append(len(ids))
                pieces.append(ids)
                held += len(ids)
                if held >= shard_ids:
                    yield flush()
                    before, shard, held = before + held, shard + 1, 0
                    names, lengths, pieces = [], [], []
        if names:
            yield flush()

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    tie = F.xxhash64("text")
    dealt = own.repartitionByRange(F.col("doc_id"), tie).sortWithinPartitions(F.col("doc_id"), tie)
    shards = dealt.mapInArrow(run, "part int, shard int, first long, n_ids long, payload binary")
    shards.write.option("compression", "zstd").option("parquet.block.size", 16 << 20).parquet(path)


def _offsets(shards: DataFrame) -> DataFrame:
    """(part, base): ids before each write task's; one row per task, so small at any size."""
    totals = shards.groupBy("part").agg(F.sum("n_ids").alias("n"))
    return totals.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("base"))


def read_tokens(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32[, ids]) of every document in the shards at ``path``."""
    shards = spark.read.schema("part int, shard int, first long, n_ids long, payload binary").parquet(path)
    extra = ", ids array<int>" if with_ids else ""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                shard = Shard(batch.column(2)[row].as_py())
                first, ids = batch.column(1)[row].as_py(), shard.decode_range(0, shard.n_ids)
                start, size = shard.starts[:-1], np.diff(shard.starts)
                crc = [zlib.crc32(ids[a : a + n].astype("<u4").tobytes()) for a, n in zip(start, size, strict=True)]
                arrays = [pa.array(shard.doc_ids, pa.int64()), pa.array([batch.column(0)[row].as_py()] * len(size), pa.int32()), pa.array(start + first), pa.array(size), pa.array(crc, pa.int64())]
                names = ["doc_id", "part", "local", "n_tokens", "ids_crc32"]
                if with_ids:
                    arrays.append(pa.ListArray.from_arrays(pa.array(shard.starts.astype(np.int32)), pa.array(ids.astype(np.int32))))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(arrays, names)

    docs = shards.select("part", "first", "payload").mapInArrow(run, f"doc_id long, part int, local long, n_tokens long, ids_crc32 long{extra}")
    located = docs.join(F.broadcast(_offsets(shards)), "part")
    return located.select("doc_id", (F.col("base") + F.col("local")).alias("start"), "n_tokens", "ids_crc32", *(["ids"] if with_ids else []))
