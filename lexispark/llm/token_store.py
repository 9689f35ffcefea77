"""Token-id files with constant-time keyed access.

A store is a folder of shards in ascending key order. ``shard-K.ids`` holds raw ids, nothing else, little-endian,
16 bits each where the vocabulary allows and 32 otherwise; ``shard-K.keys`` the documents' keys in order, 64 bits each;
``shard-K.idx`` a minimal perfect hash over the documents, whose slots give start, length, position and fingerprint.
Every row has a slot of its own: what is hashed is the key and how many equal keys the shard has before it (null keys
count apart). A look-up takes a few ranged reads of fixed size, whatever the shard's size. Files are written under a
task's own name and renamed, so a repeated or speculative task leaves one whole file.
"""

from __future__ import annotations

import json
import math
import uuid
import zlib
from array import array
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import ChunkedEncoder, byte_letters, checked, letters_only
from .common import qualified, shared_dir, single_threaded, slices

#: Multiplier and shifts of the 64-bit finaliser used for keys.
MIX_A, MIX_B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
#: Bytes of input to a shard: at least, up to as many shards as shuffles have partitions; and at most, beyond these.
SHARD_LEAST, SHARD_MOST = 16 << 20, 128 << 20
#: Bytes of input for each shard of an input that is too small for one of these per core.
SHARD_SMALL = 1 << 20
#: Entries of a generation of each worker's cache.
CACHE = 900_000
_encoders: dict[int, ChunkedEncoder] = {}


def mix(keys: np.ndarray, seed: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = keys + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x9E3779B97F4A7C15) % 2**64)
        h = (h ^ (h >> np.uint64(30))) * MIX_A
        h = (h ^ (h >> np.uint64(27))) * MIX_B
        return h ^ (h >> np.uint64(31))


def mix_pair(keys: np.ndarray, turn: np.ndarray, seed: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(mix(keys, 2 * seed) + turn * MIX_B, 2 * seed + 1)


#: Seed of fingerprints, beyond all levels, and what a null key's turn begins with.
FINGER, NULL_TURN = 1 << 20, 1 << 62


def fingers(keys: np.ndarray, turn: np.ndarray) -> np.ndarray:
    return (mix_pair(keys, turn, FINGER) >> np.uint64(32)).astype("<u4")


def turns(keys: np.ndarray, nulls: int) -> np.ndarray:
    """How many equal keys stand before each of the keys in order, of which the first ``nulls`` are null."""
    at = np.arange(len(keys), dtype=np.int64)
    new = np.concatenate([[True], keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, bool)
    if nulls < len(keys):
        new[nulls] = True
    first = np.maximum.accumulate(np.where(new, at, 0)) if len(keys) else at
    turn = at - first
    turn[:nulls] = NULL_TURN + at[:nulls]
    return turn.view(np.uint64)


class PerfectHash:
    """Minimal perfect hash by levels: a pair alone in its cell of a level is placed there, the rest go on. The slot is
    the number of set cells before its cell, which running counts per 64 cells give in constant time."""

    GAMMA = 2.0

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels  # uint64 words of each level's bits
        words = np.concatenate(levels) if levels else np.zeros(0, np.uint64)
        counts = np.bitwise_count(words).astype(np.int64)
        self.before = np.cumsum(counts) - counts
        self.first = np.cumsum([0, *(len(x) for x in levels)])

    @classmethod
    def build(cls, keys: np.ndarray, turn: np.ndarray) -> "PerfectHash":
        """``keys`` and ``turn``: distinct pairs of uint64."""
        levels = []
        while len(keys):
            words = max(1, int(np.ceil(len(keys) * cls.GAMMA / 64)))
            cell = (mix_pair(keys, turn, len(levels)) % np.uint64(words * 64)).astype(np.int64)
            once = np.bincount(cell, minlength=words * 64) == 1
            levels.append(np.packbits(once, bitorder="little").view("<u8").astype(np.uint64))
            rest = ~once[cell]
            keys, turn = keys[rest], turn[rest]
        return cls(levels)

    def slots(self, keys: np.ndarray, turn: np.ndarray) -> np.ndarray:
        """Slot of each pair, -1 where no level claims it (a stranger may still get a slot: compare fingerprints)."""
        out = np.full(len(keys), -1, dtype=np.int64)
        left = np.arange(len(keys))
        for k, bits in enumerate(self.levels):
            if not len(left):
                break
            cell = (mix_pair(keys[left], turn[left], k) % np.uint64(len(bits) * 64)).astype(np.int64)
            word, bit = cell >> 6, (cell & 63).astype(np.uint64)
            hit = (bits[word] >> bit) & np.uint64(1) == 1
            below = np.bitwise_count(bits[word] & ((np.uint64(1) << bit) - np.uint64(1))).astype(np.int64)
            out[left[hit]] = (self.before[self.first[k] + word] + below)[hit]
            left = left[~hit]
        return out


def encoder(spec: str) -> ChunkedEncoder:
    key = hash(spec)
    if key not in _encoders:
        single_threaded()
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_str(spec)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        model, to_letters = tokenizer.model, dict(enumerate(byte_letters()))
        space = to_letters[0x20]

        def encode(text: str) -> bytes:
            word = text[1:] if text[:1] == " " else text
            if word.isascii() and word.isalpha():  # one pre-token, whose bytes stand for themselves
                ids = [t.id for t in model.tokenize(f"{space}{word}" if word is not text else word)]
            elif letters_only(word):  # one pre-token: straight to the library's model
                ids = [t.id for t in model.tokenize(text.encode().decode("latin-1").translate(to_letters))]
            else:
                ids = tokenizer.encode(text, add_special_tokens=False).ids
            return array("I", ids).tobytes()

        specials = {t["content"]: t["id"] for t in json.loads(spec).get("added_tokens", [])}
        _encoders.clear()
        _encoders[key] = ChunkedEncoder(specials, encode, CACHE)
    return _encoders[key]


def _open(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder)


def _put(files: fs.FileSystem, path: str, parts: Iterator[bytes]) -> None:
    own = f"{path}.{uuid.uuid4().hex}"
    try:
        with files.open_output_stream(own) as out:
            for x in parts:
                out.write(x)
        files.move(own, path)
    except BaseException:
        if files.get_file_info(own).type != fs.FileType.NotFound:
            files.delete_file(own)
        raise


#: An index file: so many header bytes (64-bit numbers: width, documents, null keys, levels, words of each level), then
#: word and count before it of all levels, then a record for each slot.
HEADER, WORD = 1024, np.dtype([("bits", "<u8"), ("before", "<u8")])
RECORD = np.dtype([("start", "<u8"), ("length", "<u4"), ("doc", "<u4"), ("finger", "<u4"), ("unused", "<u4")])


def _index(keys: np.ndarray, nulls: int, lengths: np.ndarray, width: int) -> bytes:
    hashed, turn = keys.view(np.uint64), turns(keys, nulls)
    mph = PerfectHash.build(hashed, turn)
    records = np.zeros(len(keys), RECORD)
    slot = mph.slots(hashed, turn)
    for name, values in (("start", np.cumsum(lengths) - lengths), ("length", lengths), ("doc", np.arange(len(keys))), ("finger", fingers(hashed, turn))):
        records[name][slot] = values
    words = np.zeros(sum(map(len, mph.levels)), WORD)
    if len(words):
        words["bits"], words["before"] = np.concatenate(mph.levels), mph.before
    head = np.array([width, len(keys), nulls, len(mph.levels), *map(len, mph.levels)], "<u8").tobytes()
    return head.ljust(HEADER, b"\0") + words.tobytes() + records.tobytes()


class Shard:
    """Reader of one shard; the header, which has a fixed size, is read once."""

    def __init__(self, folder: str, k: int):
        self.files, root = _open(folder)
        self.path = f"{root}/shard-{k:06d}"
        self.index, self.payload = (self.files.open_input_file(f"{self.path}.{x}") for x in ("idx", "ids"))
        head = np.frombuffer(self._at(0, HEADER), "<u8").astype(np.int64)
        self.width, self.docs, self.nulls, levels = head[:4].tolist()
        self.words = head[4 : 4 + levels].tolist()
        self.records_at = HEADER + sum(self.words) * WORD.itemsize

    def _at(self, start: int, size: int) -> bytes:
        return self.index.read_at(size, start)

    def ids(self, start: int, length: int) -> np.ndarray:
        return np.frombuffer(self.payload.read_at(length * self.width, start * self.width), f"<u{self.width}")

    def get(self, key: int | None, turn: int = 0) -> np.ndarray | None:
        """Ids of the row that has this key and so many equal keys before it, None if there is none. Reads a word a
        level, a record, a key and the ids."""
        known, own = np.array([key or 0], np.int64).view(np.uint64), np.array([turn + (NULL_TURN if key is None else 0)], np.uint64)
        at = HEADER
        for k, words in enumerate(self.words):
            cell = int(mix_pair(known, own, k)[0]) % (words * 64)
            bits, before = np.frombuffer(self._at(at + (cell >> 6) * WORD.itemsize, WORD.itemsize), WORD)[0].tolist()
            if bits >> (cell & 63) & 1:
                slot = before + (bits & (1 << (cell & 63)) - 1).bit_count()
                record = np.frombuffer(self._at(self.records_at + slot * RECORD.itemsize, RECORD.itemsize), RECORD)[0]
                if record["finger"] != fingers(known, own)[0]:
                    return None
                with self.files.open_input_file(f"{self.path}.keys") as f:  # a fingerprint may be a stranger's
                    if int.from_bytes(f.read_at(8, int(record["doc"]) * 8), "little", signed=True) != (key or 0) or (record["doc"] < self.nulls) != (key is None):
                        return None
                return self.ids(int(record["start"]), int(record["length"])).astype(np.uint32)
            at += words * WORD.itemsize
        return None

    def documents(self, rows: int = 256) -> Iterator[tuple[list, np.ndarray, np.ndarray, list[np.ndarray]]]:
        """Keys, starts, lengths and ids of runs of documents in order: each key is looked up in the perfect hash, its
        fingerprint compared, and its ids are read from where the slot says."""
        with self.files.open_input_file(f"{self.path}.keys") as f:
            keys = np.frombuffer(f.read(), "<i8").astype(np.int64)
        words = np.frombuffer(self._at(HEADER, sum(self.words) * WORD.itemsize), WORD)["bits"].astype(np.uint64)
        records = np.frombuffer(self._at(self.records_at, self.docs * RECORD.itemsize), RECORD)
        mph, turn = PerfectHash(np.split(words, np.cumsum(self.words)[:-1]) if self.words else []), turns(keys, self.nulls)
        for k in range(0, len(keys), rows):
            known, own = keys[k : k + rows].view(np.uint64), turn[k : k + rows]
            slot = mph.slots(known, own)
            found = records[slot]
            if (slot < 0).any() or (found["finger"] != fingers(known, own)).any():
                raise ValueError(f"{self.path}: the index lacks a key")
            starts, lengths = found["start"].astype(np.int64), found["length"].astype(np.int64)
            low = int(starts.min())
            span = self.ids(low, int((starts + lengths).max()) - low)
            names = [None if k + i < self.nulls else x for i, x in enumerate(keys[k : k + rows].tolist())]
            yield names, starts, lengths, [span[a - low : a - low + n] for a, n in zip(starts.tolist(), lengths.tolist(), strict=True)]


def shard_count(df: DataFrame) -> int:
    """By the plan's estimate of its input; results do not depend on it."""
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    shuffled = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if size >= 1 << 60:  # not known
        return shuffled
    # a small input keeps all cores busy: encoding is what takes time
    busy = min(df.sparkSession.sparkContext.defaultParallelism, math.ceil(size / SHARD_SMALL))
    return max(1, busy, min(math.ceil(size / SHARD_LEAST), shuffled), math.ceil(size / SHARD_MOST))


def write_store(df: DataFrame, folder: str, tokenizer_path: str, end_id: int = 2, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode every whole text, append ``end_id``, write the shards; returns one row per shard: ``shard, docs, ids, low, high``.

    Null texts are empty (the end id alone). Keys are range-partitioned, so shard order is key order; null keys come
    first; rows of one key are ordered by their text and may fall into several shards. Repeated rows are rows of their
    own. Other columns are not read; an empty table gives no shard. The number of shards follows the input's size.
    """
    with open(tokenizer_path, encoding="utf-8") as f:
        spec = f.read()
    known = checked(spec)
    top = max([*known["model"]["vocab"].values(), *(t["id"] for t in known.get("added_tokens", [])), end_id], default=0)
    width = 2 if top < 1 << 16 else 4
    folder = qualified(df.sparkSession, folder)
    files, root = _open(folder)
    files.create_dir(root)
    source = df.select(F.col(f"`{key}`").cast("long").alias("k"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("t"))
    # a key of any share of the rows spreads over shards
    order = ["k", F.xxhash64("t").alias("h"), F.monotonically_increasing_id().alias("n")]
    dealt = source.select("t", *order).repartitionByRange(shard_count(df), "k", "h", "n").sortWithinPartitions("k", "h", "t").select("k", "t", F.spark_partition_id().alias("shard"))

    def write(batches):
        encode, files, root = encoder(spec), *_open(folder)
        tail, keys, lengths, shard, nulls = np.array([end_id], dtype="<u4").tobytes(), array("q"), array("q"), None, 0

        def payload():
            nonlocal shard, nulls
            for part in slices(batches):
                shard = part.column(2)[0].as_py()
                nulls += part.column(0).null_count
                keys.frombytes(part.column(0).fill_null(0).to_numpy(zero_copy_only=False).astype("<i8").tobytes())
                found = [encode(x) + tail for x in part.column(1).to_pylist()]
                lengths.extend(len(x) // 4 for x in found)
                yield np.frombuffer(b"".join(found), dtype="<u4").astype(f"<u{width}").tobytes()

        own = f"{root}/part.{uuid.uuid4().hex}"
        try:
            with files.open_output_stream(own) as out:
                for x in payload():
                    out.write(x)
            if shard is not None:
                files.move(own, f"{root}/shard-{shard:06d}.ids")
            else:
                files.delete_file(own)
        except BaseException:
            if files.get_file_info(own).type != fs.FileType.NotFound:
                files.delete_file(own)
            raise
        if shard is None:
            return
        known, sizes = np.frombuffer(keys, np.int64), np.frombuffer(lengths, np.int64)
        _put(files, f"{root}/shard-{shard:06d}.keys", iter([known.astype("<i8").tobytes()]))
        _put(files, f"{root}/shard-{shard:06d}.idx", iter([_index(known, nulls, sizes, width)]))
        low, high = (int(known[nulls]), int(known[-1])) if nulls < len(known) else (None, None)
        yield pa.RecordBatch.from_pylist(
            [{"shard": shard, "docs": len(known), "ids": int(sizes.sum()), "low": low, "high": high}],
            schema=pa.schema([("shard", pa.int32()), ("docs", pa.int64()), ("ids", pa.int64()), ("low", pa.int64()), ("high", pa.int64())]),
        )

    return dealt.mapInArrow(write, "shard int, docs long, ids long, low long, high long")


class TokenStore:
    """A written store: ``manifest`` has a row per shard (never per document)."""

    def __init__(self, folder: str, manifest: list):
        self.folder, self.manifest = folder, sorted(manifest, key=lambda r: r["shard"])
        self.keyed = [r for r in self.manifest if r["high"] is not None]
        self.highs, self.open = [r["high"] for r in self.keyed], {}

    def get(self, key: int) -> np.ndarray | None:
        """Ids of the first row with this key, None if there is none. One shard is asked, found by bisection."""
        at = bisect_left(self.highs, key)
        if at == len(self.keyed) or key < self.keyed[at]["low"]:
            return None
        shard = self.keyed[at]["shard"]
        if shard not in self.open:
            if len(self.open) >= 64:
                self.open.clear()
            self.open[shard] = Shard(self.folder, shard)
        return self.open[shard].get(key)

    def read(self, spark) -> DataFrame:
        """Every document, read back from the files through the perfect hash: ``doc_id, start, n_tokens, ids_crc32``.
        ``start`` counts the ids of all documents before it; an empty store gives no rows."""
        folder, first, rows = self.folder, 0, []
        for row in self.manifest:
            rows.append((row["shard"], first))
            first += row["ids"]
        if not rows:
            return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")
        tasks = spark.range(0, len(rows), 1, len(rows))

        def read(batches):
            for batch in batches:
                for shard, at in (rows[i] for i in batch.column(0).to_pylist()):
                    for keys, starts, lengths, ids in Shard(folder, shard).documents():
                        crc = [zlib.crc32(x.astype("<u4")) for x in ids]
                        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(at + starts, pa.int64()), pa.array(lengths, pa.int64()), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

        return tasks.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def build_store(df: DataFrame, tokenizer_path: str, folder: str | None = None, end_id: int = 2) -> TokenStore:
    folder = qualified(df.sparkSession, folder or f"{shared_dir(df.sparkSession)}/tokens-{uuid.uuid4().hex}")
    return TokenStore(folder, write_store(df, folder, tokenizer_path, end_id).collect())
