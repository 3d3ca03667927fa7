"""Token-ID output as Arrow files of fixed-length sequences (operator 6).

A corpus is written as shards in ascending ``doc_id`` order. Each shard is an Arrow IPC file whose record batches
hold ``ids`` (fixed-size list of unsigned integers, ``length`` a row) and ``mask`` (one bit a token, packed into a
fixed-size list of bytes; 0 marks padding, which only a shard's last sequence has). All rows are equally long, so
row i lies at a known place and a memory map hands out sequences and masks without copying. A second Arrow file
holds the shard's index: doc_id, begin and n_tokens of each document.

1. Documents are range-partitioned by (doc_id, hash of the text), into as many shards as hold ``SHARD_BYTES`` of text each, and
   sorted: one task writes one shard, in a stream that holds a few thousand sequences at most. A file appears under its name only when it is complete, and a task
   that runs again writes the same bytes, so lost executors and speculative tasks do no harm.
2. The number of tokens of each shard (one row a shard) gives the place of each shard's first token in the corpus.
3. Reading goes over the shards' files in parallel.

Encoding splits a text before single spaces and line ends that stand between visible characters, where the
tokenizer's own pattern splits too; pieces repeat a lot, so each is encoded once and kept in a bounded table. Texts
with other white space are split at fewer places, or not at all. The ids equal those of whole texts.

Defined cases: a null or empty text has the end id alone; equal doc_ids are ordered by their texts' hashes, and equal
rows follow each other; a null doc_id comes first; a text of any length is encoded whole; an empty table gives no shards and
no rows; further columns are ignored, whatever their names.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from array import array
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import load, reach, scratch_path
from ..sources.stores import rename_over

TOKENIZER, END_ID, LENGTH, ROWS = "byte_bpe_50k.json", 2, 2048, 512
MOST_PIECES, LONGEST_KEPT, SHARD_BYTES, INDEX_ROWS = 1_200_000, 64, 128 << 20, 1 << 16
INDEX = pa.schema([("doc_id", pa.int64()), ("begin", pa.int64()), ("n_tokens", pa.int64())])

#: Fixed by the byte-level tokenizers' public definition: where their pattern cuts a text, and the letter that stands for
#: each byte (itself if it is printable, else the next free one from 256 on).
PATTERN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
_PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTE_LETTERS = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in _PRINTABLE)}
SPACE_LETTER, LINE_LETTER, MARKS = chr(BYTE_LETTERS[32]), chr(BYTE_LETTERS[10]), "!\"#$%&()*+,-./:;=>?@[\\]^_`{|}~'"
#: Pieces whose characters have long-settled classes, and no start of a special token.
LATIN = re.compile(r"\n?[!-;=-~\u00A1-\u00AC\u00AE-\u024F]+")

_encoders: dict[str, Encoder] = {}


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Encodes texts piece by piece; a Python worker keeps one for all its tasks."""

    DOUBLE, OTHER = ("  ", " \n", "\n ", "\n\n"), re.compile(r"[^\S \n]")
    SINGLE = re.compile(r"(?<=\S) (?=\S)")

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2") if self.tokenizer.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        self.known: dict[str, bytes] = {}
        self.marks: dict[str, bytes] = {}
        plan = json.loads(self.tokenizer.to_str())
        cut = plan["pre_tokenizer"] or {}
        self.byte_level = cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut.get("add_prefix_space", True) and plan["normalizer"] is None

    @classmethod
    def of(cls, path: str) -> Encoder:
        if path not in _encoders:
            _encoders[path] = cls(path)
        return _encoders[path]

    def _plain(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.dtype).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _odd(self, text: str) -> bool:
        """Whether there is white space that is not one space or line end between visible characters."""
        return any(pair in text for pair in self.DOUBLE) or text[:1].isspace() or text[-1:].isspace() or self.OTHER.search(text) is not None

    def _model(self, part: str) -> bytes:
        """The ids of one part of the tokenizer's pattern."""
        letters = part.replace(" ", SPACE_LETTER).replace("\n", LINE_LETTER) if part.isascii() else part.encode().decode("latin-1").translate(BYTE_LETTERS)
        return array(self.dtype.char, [t.id for t in self.tokenizer.model.tokenize(letters)]).tobytes()

    def _latin(self, key: str) -> bytes:
        """The ids of a piece of Latin text: cut as the tokenizer's own pattern does, then merged by its model."""
        if key.isalpha():
            return self._model(f" {key}")
        word = key.rstrip(MARKS)
        if word.isalpha():  # one word and its punctuation
            if word not in self.known:
                self.known[word] = self._model(f" {word}")
            marks = key[len(word) :]
            if marks not in self.marks:
                self.marks[marks] = self._model(marks)
            return self.known[word] + self.marks[marks]
        return b"".join(map(self._model, PATTERN.findall(key if key[0] == "\n" else f" {key}")))

    def _fill(self, keys: set[str]) -> None:
        latin = [k for k in keys if LATIN.fullmatch(k)] if self.byte_level else []
        for k in latin:
            self.known[k] = self._latin(k)
        rest = sorted(keys.difference(latin))
        self.known.update(zip(rest, self._plain([k if k[0] == "\n" else f" {k}" for k in rest]), strict=True))

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """The ids of each text. Keys of the table stand for a space and the key, or for a key that begins with a line end."""
        if len(self.known) > MOST_PIECES:
            self.known, self.marks = {}, {}
        split = [self.SINGLE.split(t) if self._odd(t) else t.replace("\n", " \n").split(" ") for t in (t or "" for t in texts)]
        heads = self._plain([pieces[0] for pieces in split])
        flat = [p for pieces in split for p in pieces[1:]]
        ids = list(map(self.known.get, flat))
        if None in ids:
            at = [i for i, x in enumerate(ids) if x is None]
            missing = {flat[i] for i in at}
            self._fill(missing)
            for i in at:
                ids[i] = self.known[flat[i]]
            for p in missing:
                if len(p) > LONGEST_KEPT:
                    del self.known[p]
        out, begin = [], 0
        for head, pieces in zip(heads, split, strict=True):
            end = begin + len(pieces) - 1
            out.append(np.frombuffer(head + b"".join(ids[begin:end]), self.dtype))
            begin = end
        return out


def _store(uri: str) -> tuple[pa.fs.FileSystem, str]:
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


class ShardWriter:
    """Streams token ids into the two files of one shard."""

    def __init__(self, uri: str, shard: int, attempt: int, dtype: np.dtype, length: int = LENGTH) -> None:
        self.fs, self.dir = _store(uri)
        self.name, self.length, self.dtype = f"shard-{shard:06d}", length, dtype
        self.part = f"{self.dir}/_{self.name}-{attempt}"
        item = pa.uint16() if dtype.itemsize == 2 else pa.uint32()
        self.schema = pa.schema([("ids", pa.list_(pa.field("item", item, False), length)), ("mask", pa.list_(pa.field("item", pa.uint8(), False), length // 8))])
        self.item, self.held, self.waiting, self.total = item, [], 0, 0
        self.index: list[tuple[int | None, int, int]] = []
        self.fs.create_dir(self.dir, recursive=True)
        self.sink, self.index_sink = (self.fs.open_output_stream(f"{self.part}.{kind}") for kind in ("arrow", "index.arrow"))
        self.file, self.index_file = pa.ipc.new_file(self.sink, self.schema), pa.ipc.new_file(self.index_sink, INDEX)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.index.append((doc_id, self.total, len(ids)))
        self.held.append(ids)
        self.waiting += len(ids)
        self.total += len(ids)
        if len(self.index) >= INDEX_ROWS:
            self._flush_index()
        if self.waiting >= ROWS * self.length:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        flat = np.concatenate(self.held) if self.held else np.zeros(0, self.dtype)
        size = ROWS * self.length
        n_full = len(flat) // size * size
        parts = [flat[i : i + size] for i in range(0, n_full, size)] + ([flat[n_full:]] if last and n_full < len(flat) else [])
        for part in parts:
            rows = -(-len(part) // self.length)
            padded = np.zeros(rows * self.length, self.dtype)
            padded[: len(part)] = part
            mask = np.packbits(np.arange(rows * self.length) < len(part), bitorder="little")
            arrays = [pa.FixedSizeListArray.from_arrays(pa.array(a, k), type=f.type) for a, k, f in zip((padded, mask), (self.item, pa.uint8()), self.schema, strict=True)]
            self.file.write_batch(pa.record_batch(arrays, schema=self.schema))
        self.held = [] if last else [flat[n_full:].copy()]
        self.waiting = 0 if last else len(flat) - n_full

    def _flush_index(self) -> None:
        columns = list(zip(*self.index, strict=True)) or [[], [], []]
        self.index_file.write_batch(pa.record_batch([pa.array(c, pa.int64()) for c in columns], schema=INDEX))
        self.index = []

    def close(self) -> None:
        self._flush(True)
        self._flush_index()
        for held in (self.file, self.sink, self.index_file, self.index_sink):
            held.close()
        for kind in ("index.arrow", "arrow"):
            rename_over(self.fs, f"{self.part}.{kind}", f"{self.dir}/{self.name}.{kind}")


class ShardReader:
    """Random access to a shard; on a local or mounted folder nothing is copied."""

    def __init__(self, uri: str, shard: int) -> None:
        fs, folder = _store(uri)
        at = f"{folder}/shard-{shard:06d}"
        source = pa.memory_map(f"{at}.arrow") if fs.type_name == "local" else fs.open_input_file(f"{at}.arrow")
        self.file = pa.ipc.open_file(source)
        self.length = self.file.schema.field("ids").type.list_size
        self.index = pa.ipc.open_file(fs.open_input_file(f"{at}.index.arrow")).read_all()
        self._last: tuple[int, pa.RecordBatch | None] = (-1, None)

    def _batch(self, b: int) -> pa.RecordBatch:
        if self._last[0] != b:
            self._last = (b, self.file.get_batch(b))
        return self._last[1]

    def sequence(self, i: int) -> np.ndarray:
        return self._batch(i // ROWS).column(0).flatten().to_numpy()[i % ROWS * self.length : (i % ROWS + 1) * self.length]

    def mask(self, i: int) -> np.ndarray:
        packed = self._batch(i // ROWS).column(1).flatten().to_numpy()[i % ROWS * self.length // 8 : (i % ROWS + 1) * self.length // 8]
        return np.unpackbits(packed, bitorder="little").astype(bool)

    def tokens(self, begin: int, n: int) -> np.ndarray:
        """n tokens from the shard's begin-th on; a view, unless they cross record batches."""
        size, parts = ROWS * self.length, []
        while n > 0:
            b, at = divmod(begin, size)
            part = self._batch(b).column(0).flatten().to_numpy()[at : at + n]
            parts.append(part)
            begin, n = begin + len(part), n - len(part)
        return parts[0] if len(parts) == 1 else np.concatenate(parts) if parts else np.zeros(0, np.uint16)


def write_tokens(docs: DataFrame, uri: str, tokenizer: str | None = None, text: str = "text", end_id: int = END_ID, length: int = LENGTH) -> list[tuple[int, int, int]]:
    """Write all documents under ``uri``; (shard, first token's place in the corpus, tokens) of each shard."""
    spark = docs.sparkSession
    reach(spark)
    path = tokenizer or tokenizer_path()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder, writer = Encoder.of(path), None
        shard, attempt = TaskContext.get().partitionId(), TaskContext.get().taskAttemptId()
        end = np.array([end_id], encoder.dtype)
        for batch in batches:
            for some in _some(batch):
                writer = writer or ShardWriter(uri, shard, attempt, encoder.dtype, length)
                for doc_id, ids in zip(some.column(0).to_pylist(), encoder.encode(some.column(1).to_pylist()), strict=True):
                    writer.add(doc_id, np.concatenate([ids, end]))
        if writer is not None:
            writer.close()
            yield pa.RecordBatch.from_pydict({"shard": [shard], "n": [writer.total]}, schema=pa.schema([("shard", pa.int64()), ("n", pa.int64())]))

    ordered = docs.select(F.col("doc_id").cast("long"), F.col(text).alias("text"), F.xxhash64(text).alias("h"))
    size = ordered.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // SHARD_BYTES))
    ordered = ordered.repartitionByRange(shards, "doc_id", "h").sortWithinPartitions("doc_id", "h").select("doc_id", "text")
    shards = sorted((r["shard"], r["n"]) for r in ordered.mapInArrow(write, "shard long, n long").collect())
    return [(s, at - n, n) for (s, n), at in zip(shards, accumulate(n for _, n in shards), strict=True)]


def _some(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    from .words import pieces

    return pieces(iter([batch]), batch.schema.names[1], 1 << 19)


def read_documents(spark: SparkSession, uri: str, shards: list[tuple[int, int, int]]) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of each document, from the files."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                reader = ShardReader(uri, shard)
                begins, counts = (reader.index.column(c).to_numpy() for c in ("begin", "n_tokens"))
                for i in range(0, len(begins), 5000):
                    crc = [zlib.crc32(reader.tokens(b, n).astype("<u4").tobytes()) for b, n in zip(begins[i : i + 5000].tolist(), counts[i : i + 5000].tolist(), strict=True)]
                    own = reader.index.column("doc_id").slice(i, 5000).combine_chunks()
                    yield pa.RecordBatch.from_arrays([own, pa.array(begins[i : i + 5000] + start), pa.array(counts[i : i + 5000]), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    table = spark.createDataFrame([(s, at) for s, at, _ in shards], "shard long, start long")
    return table.repartition(max(1, len(shards)), "shard").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def tokenize(docs: DataFrame, uri: str | None = None, **options) -> DataFrame:
    """Write ``docs`` as token files (by default in the shared folder) and report each document as read back."""
    spark = docs.sparkSession
    uri = uri or scratch_path(spark, "tokens")
    return read_documents(spark, uri, write_tokens(docs, uri, **options))


def op6_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenize(load(spark, sf_dir, "documents").select("doc_id", "text"))
