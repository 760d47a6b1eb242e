"""Token ids in binary shards, each document compressed with a shared zstandard dictionary.

A shard file is

    magic "MQTOK1\\0\\0", u32 version 2, u32 documents, u64 sha256 prefix of the dictionary, u64 index length
    frames: one zstandard frame for each document, of its ids as little-endian u32
    index:  zstandard frame of int64 doc_id[n], u64 offset[n + 1], u32 tokens[n], u8 null[n] (1: the id is null)

with numbers in little-endian order, so one short document is read by one seek and one small frame.
Shards hold ascending ranges of doc_id and, within one id, of the text's crc32. The dictionary lies beside them; its hash in each header
keeps a shard from being read with another one. It is trained on about sample_docs documents picked
by a hash: only compression depends on the sample.

A task writes its shard under a name of its own and renames it, so a repeated task leaves the same
file. Files go where pyarrow.fs resolves the folder's address, below spark.checkpoint.dir here.

Defined cases: a null or empty text has the end id only; null ids sort first and read back as null;
repeated rows are repeated documents (ordered by their crc32 and text among equal ids); an empty
table gives no shards and an empty result; very long texts are one frame each; other columns, whatever
their names, are ignored.
"""

from __future__ import annotations

import hashlib
import itertools
import os
import re
import struct
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import n_partitions, sample_texts, shared_dir, with_row_key

HEAD = "<8sIIQQ"
MAGIC = b"MQTOK1\0\0"
VERSION = 2

#: Words with the white space before them, cut before the punctuation that ends a word. The
#: byte-level pattern never joins what such a cut parts, so chunks encode alone as in their text.
_CHUNK = re.compile(r"[ \t\n\r]*[A-Za-zÀ-ÖØ-öø-ÿ]+(?=[,.;:!?%$&*#|])|[ \t\n\r]*[^ \t\n\r]+|[ \t\n\r]+$")
#: With other white space, or a special token's brackets, the text is encoded whole.
_SPACES = "\x0b\x0c\x1c-\x1f\x85\xa0 ᠎ -​    　﻿"
_WHOLE = re.compile(f"[{_SPACES}]|<[|]")
#: Marks after a word (fixed values), cut from it so that fewer different pieces are left.
_MARKS = ",.;:!?"
_EDGE = " \n" + _MARKS
_OTHER = re.compile(f"[\t\r\0{_SPACES}]")
_STRAY = re.compile(f"[{_MARKS}](?<=[\\W_].)")


def _uneven(text: str) -> bool:
    """False for a text of single spaces and line ends between words only, and marks after letters and numbers only: it may be cut at each of them."""
    # one search for each, as a pattern that begins with one class is found several times as fast as alternatives
    return any(x in text for x in ("  ", "\n\n", " \n", "\n ", "<|")) or bool(_OTHER.search(text) or _STRAY.search(text))


class Encoder:
    """Encodes as tokenizers does, remembering about max_words chunks."""

    def __init__(self, path: str, end_id: int, max_words: int = 800_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer, self.max_words = Tokenizer.from_file(path), max_words
        vocabulary = self.tokenizer.get_vocab()
        self.size = np.zeros(max(vocabulary.values()) + 1, dtype=np.int64)  # bytes of each token
        for token, i in vocabulary.items():
            self.size[i] = len(token)
        self.chunks: dict[str, bytes] = {}  # by the whole chunk
        self.pieces: dict[str, bytes] = {}  # by what follows a space, or by a line end and what follows it
        self.end = struct.pack("<I", end_id)

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype="<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _rows(self, chunks: list[str], together: int = 512) -> Iterator[bytes]:
        """The ids of chunks that are one space or line end and what follows it: encoded in rows, as they don't touch, and told apart by their bytes."""
        rows = ["".join(chunks[k : k + together]) for k in range(0, len(chunks), together)]
        for row, e in zip(rows, self.tokenizer.encode_batch_fast(rows, add_special_tokens=False), strict=True):
            raw = np.frombuffer(row.encode("utf-8", "surrogatepass"), dtype=np.uint8)
            ends = np.append(np.flatnonzero((raw == 32) | (raw == 10))[1:], len(raw))
            ids = np.array(e.ids, dtype="<u4")
            stops = (4 * (np.searchsorted(np.cumsum(self.size[ids]), ends) + 1)).tolist()
            data = ids.tobytes()
            yield from map(data.__getitem__, map(slice, [0, *stops[:-1]], stops))

    def _learn_pieces(self, pieces: set[str]) -> None:
        """Firsts, marked by a zero character, and what begins with a mark have no space before them."""
        alone = [p for p in pieces if p[0] in "\0" + _MARKS]
        self.pieces.update(zip(alone, self._encode([p.removeprefix("\0") for p in alone]), strict=True))
        rest = list(pieces.difference(alone))
        self.pieces.update(zip(rest, self._rows([p if p[0] == "\n" else f" {p}" for p in rest]), strict=True))

    def __call__(self, texts: list[str | None], together: int = 256) -> Iterator[bytes]:
        """Little-endian u32 ids of each text with the end id."""
        for k in range(0, len(texts), together):
            some = [t or "" for t in texts[k : k + together]]
            for known in (self.pieces, self.chunks):
                if len(known) > self.max_words:  # what came first is mostly the commonest
                    kept = dict(itertools.islice(known.items(), self.max_words // 2))
                    known.clear()
                    known.update(kept)
            cuts: list[list[str] | None] = []  # None: encoded whole
            stores: list[dict[str, bytes]] = []
            gaps: list[list[int]] = []
            found: list[list[bytes | None]] = []
            new: tuple[set[str], set[str]] = set(), set()
            for t in some:
                even = bool(t) and t[0] not in _EDGE and t[-1] not in " \n" and not _uneven(t)
                if even:
                    for x in "\n" + _MARKS:
                        t = t.replace(x, f" {x}")
                    cut = t.split(" ")
                    cut[0] = f"\0{cut[0]}"  # the first has no space before it
                else:
                    cut = None if _WHOLE.search(t) else _CHUNK.findall(t)
                known = self.pieces if even else self.chunks
                f = list(map(known.get, cut or ()))
                gap = [i for i, x in enumerate(f) if x is None]
                new[even].update([cut[i] for i in gap])
                cuts.append(cut)
                stores.append(known)
                gaps.append(gap)
                found.append(f)
            if new[1]:
                self._learn_pieces(new[1])
            if new[0]:
                chunks = list(new[0])
                self.chunks.update(zip(chunks, self._encode(chunks), strict=True))
            for t, c, known, gap, f in zip(some, cuts, stores, gaps, found, strict=True):
                for i in gap:
                    f[i] = known[c[i]]
                yield (self._encode([t])[0] if c is None else b"".join(f)) + self.end


_encoders: dict[tuple, Encoder] = {}


def encoder(path: str, end_id: int) -> Encoder:
    """One for each Python worker, as workers are used again."""
    if (path, end_id) not in _encoders:
        _encoders[path, end_id] = Encoder(path, end_id)
    return _encoders[path, end_id]


def _fs(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{os.path.abspath(uri)}")


def _dump(fs, path: str, data: list[bytes]) -> None:
    temp = f"{path}.{uuid.uuid4().hex}.tmp"
    with fs.open_output_stream(temp) as f:
        for x in data:
            f.write(x)
    fs.move(temp, path)


def train(docs: DataFrame, tokenizer: str, end_id: int, sample_docs: int = 400, size: int = 65_536) -> bytes:
    """A dictionary from a bounded sample of whole documents; empty if there is too little to train on."""
    import zstandard

    rows = with_row_key(docs.select(F.col("text").cast("string").alias("text")), "row")
    texts = sample_texts(rows, "row", sample_docs)
    samples = list(encoder(tokenizer, end_id)(texts))
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b""


def _stamp(dictionary: bytes) -> int:
    return int.from_bytes(hashlib.sha256(dictionary).digest()[:8], "little")


def write(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 2, partitions: int | None = None, level: int = 3) -> list[tuple[str, int, int]]:
    """Write all documents below folder; (path, documents, tokens) of each shard in ascending order."""
    import zstandard

    dictionary = train(docs, tokenizer, end_id)
    fs, root = _fs(folder)
    fs.create_dir(root, recursive=True)
    _dump(fs, f"{root}/dictionary.zdict", [dictionary])
    stamp = _stamp(dictionary)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        encode, comp = encoder(tokenizer, end_id), zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
        ids, nulls, counts, lengths = [], [], array("I"), array("Q")
        store, place = _fs(folder)
        path = f"{place}/shard-{TaskContext.get().partitionId():06d}.mqt"
        temp = f"{path}.{uuid.uuid4().hex}.body"
        with store.open_output_stream(temp) as body:
            for b in batches:
                ids.append(b.column("doc_id").fill_null(0).to_numpy())
                nulls.append(b.column("doc_id").is_null().to_numpy(zero_copy_only=False))
                for raw in encode(b.column("text").to_pylist()):
                    frame = comp.compress(raw)
                    body.write(frame)
                    lengths.append(len(frame))
                    counts.append(len(raw) // 4)
        if not counts:
            store.delete_file(temp)
            return
        offset = np.concatenate([[0], np.cumsum(np.array(lengths, "<u8"))]).astype("<u8")
        index = zstandard.ZstdCompressor().compress(np.concatenate(ids).astype("<i8").tobytes() + offset.tobytes() + np.array(counts, "<u4").tobytes() + np.concatenate(nulls).astype("u1").tobytes())
        whole = f"{path}.{uuid.uuid4().hex}.tmp"
        with store.open_output_stream(whole) as out, store.open_input_stream(temp) as body:
            out.write(struct.pack(HEAD, MAGIC, VERSION, len(counts), stamp, len(index)))
            while x := body.read(1 << 22):
                out.write(x)
            out.write(index)
        store.delete_file(temp)
        store.move(whole, path)
        yield pa.RecordBatch.from_pydict({"path": [path], "documents": [len(counts)], "tokens": [sum(counts)]})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    order = ["doc_id", F.crc32(F.col("text").cast("binary"))]  # rows of one id are cut by their texts
    ranged = rows.repartitionByRange(partitions or n_partitions(docs.sparkSession), *order).sortWithinPartitions(*order, "text")
    return sorted(tuple(r) for r in ranged.mapInArrow(run, "path string, documents long, tokens long").collect())


class Shard:
    """Random access to one shard file."""

    def __init__(self, fs, path: str, dictionary: bytes):
        import zstandard

        self.file = fs.open_input_file(path)
        magic, version, self.n, stamp, size = struct.unpack(HEAD, self.file.read(struct.calcsize(HEAD)))
        if magic != MAGIC or version != VERSION:
            raise ValueError(f"{path} is not a shard")
        if stamp != _stamp(dictionary):
            raise ValueError(f"{path} was written with another dictionary")
        end = self.file.size()
        self.file.seek(end - size)
        raw = zstandard.ZstdDecompressor().decompress(self.file.read(size))
        n = self.n
        self.ids = np.frombuffer(raw, "<i8", n)
        self.offset = np.frombuffer(raw, "<u8", n + 1, 8 * n)
        self.tokens = np.frombuffer(raw, "<u4", n, 8 * (2 * n + 1))
        self.null = np.frombuffer(raw, "u1", n, 8 * (2 * n + 1) + 4 * n).astype(bool)
        self._zstd = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)

    def raw(self, k: int) -> bytes:
        """The ids of document k as little-endian u32."""
        self.file.seek(struct.calcsize(HEAD) + int(self.offset[k]))
        return self._zstd.decompress(self.file.read(int(self.offset[k + 1] - self.offset[k])), max_output_size=4 * int(self.tokens[k]))


def read(spark, folder: str, shards: list[tuple[str, int, int]]) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 for every document, from the files."""
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    if not shards:
        return spark.createDataFrame([], schema)
    starts = itertools.accumulate([0, *(s[2] for s in shards[:-1])])
    table = spark.createDataFrame([(p, s) for (p, _, _), s in zip(shards, starts, strict=True)], "path string, first long").repartition(len(shards), "path")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, root = _fs(folder)
        dictionary = fs.open_input_stream(f"{root}/dictionary.zdict").read()
        for b in batches:
            for path, first in zip(b["path"], b["first"], strict=True):
                s = Shard(fs, path, dictionary)
                start = first + np.concatenate([[0], np.cumsum(s.tokens[:-1], dtype=np.int64)])
                crc = [zlib.crc32(s.raw(k)) for k in range(s.n)]
                ids = pd.array(s.ids, dtype="Int64")
                ids[s.null] = pd.NA
                yield pd.DataFrame({"doc_id": ids, "start": start, "n_tokens": s.tokens.astype("int64"), "ids_crc32": crc})

    return table.mapInPandas(run, schema)


def round_trip(docs: DataFrame, tokenizer: str, end_id: int = 2) -> DataFrame:
    """Write the documents to a new shared folder and read them back."""
    folder = shared_dir(docs.sparkSession)
    return read(docs.sparkSession, folder, write(docs, folder, tokenizer, end_id))
