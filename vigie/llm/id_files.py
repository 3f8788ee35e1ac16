"""Token ids in files: one zstandard frame per document, a shared dictionary, an offset index.

A folder holds ``dictionary-<sha256>.zdict`` and any number of ``<name>.ids`` files. All numbers are
little-endian. An id file is, in this order:

    head    MAGIC, bytes per id (u32), SHA-256 of the dictionary (32 bytes, zeros without one)
    frames  one zstandard frame per document, compressed by itself with the dictionary
    index   one entry per document: frame offset (u64), frame bytes (u32), crc32 of its ids as
            u32 (u32), first token in the file (u64), document number (i64), 1 if it has none (u8)
    tail    index offset (u64), documents (u64), tokens (u64), MAGIC

So a document is read with three short reads: the tail, its entry and its frame.
"""

from __future__ import annotations

import codecs
import gc
import hashlib
import json
import re
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F
from tokenizers import Tokenizer

from vigie.session import fresh_folder, stored

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"
END_ID = 0
LEVEL = 3
# A file is closed once it has so many bytes of frames or so many documents.
FILE_BYTES = 128 << 20
FILE_DOCS = 1_000_000
# The dictionary's own size, and the sample it is trained on: documents, and characters of each at most.
DICTIONARY_BYTES = 64 << 10
SAMPLE_DOCS = 1_000
SAMPLE_CHARS = 8_192
# Tasks that read files, at most.
READERS = 10_000
# Chunks and pieces whose ids a task remembers, and characters of one at most.
CHUNKS = 800_000
CHUNK_CHARS = 40
# Texts that are cut, or given to the library, at once.
CUT_TEXTS = 2_000
WHOLE_TEXTS = 500

MAGIC = b"VIGIEID1"
HEAD = "<8sI32s"
TAIL = "<QQQ8s"
ENTRY = np.dtype([("at", "<u8"), ("size", "<u4"), ("crc", "<u4"), ("first", "<u8"), ("number", "<i8"), ("absent", "u1")])
# --- fixed values: how a byte-level tokenizer splits text, and how it writes bytes -------------
# A space goes with the word after it and with nothing before it, so no token crosses the place
# before a space that no white space follows.
BLANKS = [chr(number) for number in range(1 << 16) if chr(number).isspace()]
PIECES = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
# Bytes that are written as the character of their own number; the others follow from 256 on.
PLAIN_BYTES = ((33, 126), (161, 172), (174, 255))
# Signs after a word; no piece holds a letter and one of them.
SIGNS = ".,;:!?"
# A single line end between a sign and a letter is a piece.
LINE_END = ord("\n")
# Characters whose classes all versions of the character tables agree on.
SETTLED = re.compile("[\\x00-\u024f]*")


def _byte_letters() -> str:
    """The character that stands for each byte."""
    plain = {byte for first, last in PLAIN_BYTES for byte in range(first, last + 1)}
    others = iter(range(256, 512))
    return "".join(chr(byte if byte in plain else next(others)) for byte in range(256))


def _set(numbers: Iterable[int]) -> np.ndarray:
    found = np.zeros(256, bool)
    found[list(numbers)] = True
    return found


# White space of one byte, and that of two or three: its first bytes, and all of them as one number.
BLANK = _set(ord(blank) for blank in BLANKS if blank.isascii())
WIDE_BLANKS = np.array([int.from_bytes(blank.encode().ljust(3, b"\0")) for blank in BLANKS if not blank.isascii()], np.uint32)
WIDE_FIRST = _set(WIDE_BLANKS >> 16)
SIGN = _set(SIGNS.encode())
LETTER = _set(byte for byte in range(128) if chr(byte).isalpha())
# First bytes of U+00C0 to U+023F: all letters but two.
LETTER_FIRST, NO_LETTERS = _set(range(0xC3, 0xC9)), ("\u00d7".encode(), "\u00f7".encode())


def _chunks(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Texts (of type large_string, without nulls) in chunks, and where in these each text begins; their number comes last.

    A text is cut before a space that another character than white space follows, between a letter
    and a sign, and around a single line end between a sign and a letter. The chunks lie where the
    texts do; every text has at least one.
    """
    _, offsets, data = texts.buffers()
    starts = np.frombuffer(offsets, "<i8")[texts.offset:texts.offset + len(texts) + 1]
    first, end = int(starts[0]), int(starts[-1])
    # Some zeros stand before and after the texts.
    held = np.zeros(end - first + 6, np.uint8)
    if end > first:
        held[2:end - first + 2] = np.frombuffer(data, np.uint8)[first:end]
    begins = np.zeros(len(held), bool)
    begins[starts - first + 2] = True
    # A space that begins a text cuts nothing off; one at a text's end is followed by nothing of it.
    cuts = np.flatnonzero((held == 0x20) & ~begins)
    cuts = cuts[~(BLANK[held] | begins)[cuts + 1]]
    wide = np.flatnonzero(WIDE_FIRST[held[cuts + 1]])
    if len(wide):
        one, two, three = (held[cuts[wide] + n].astype(np.uint32) for n in (1, 2, 3))
        # Characters that begin with a byte below 0xE0 have two.
        number = one << 16 | two << 8 | np.where(one < 0xE0, 0, three)
        cuts = np.delete(cuts, wide[np.isin(number, WIDE_BLANKS)])
    signs = np.flatnonzero(SIGN[held] & ~begins)
    last, first_byte = held[signs - 1], held[signs - 2]
    letters = LETTER[last] | (LETTER_FIRST[first_byte] & (last >= 0x80))
    for one, two in NO_LETTERS:
        letters &= ~((first_byte == one) & (last == two))
    lines = np.flatnonzero((held == LINE_END) & ~begins)
    lines = lines[SIGN[held[lines - 1]] & LETTER[held[lines + 1]] & ~begins[lines + 1]]
    cuts = np.sort(np.concatenate([cuts, signs[letters], lines, lines + 1])) + first - 2
    earlier = np.searchsorted(cuts, starts)
    places = np.insert(cuts, earlier, starts).astype("<i8")
    chunks = pa.LargeStringArray.from_buffers(len(places) - 1, pa.py_buffer(places), data or pa.py_buffer(b""))
    return chunks, earlier + np.arange(len(starts))


def _cuttable(described: dict) -> bool:
    """Whether the tokenizer splits as ``_chunks`` and ``PIECES`` say, and changes nothing before it splits."""
    split = described.get("pre_tokenizer") or {}
    return (
        split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space")
        and described.get("normalizer") is None
        and all(" " not in token["content"] and any(not c.isalpha() and c not in SIGNS for c in token["content"])
                and len(_chunks(pa.array([token["content"]], pa.large_string()))[0]) == 1
                and not (token["lstrip"] or token["rstrip"] or token["single_word"])
                for token in described.get("added_tokens", []))
    )


class Encoder:
    """Ids of whole texts; the chunks between cuts, which mostly repeat, are encoded once.

    The library splits slowly, so chunks of settled characters are split here and their pieces given
    to its model; all other chunks, and texts for other kinds of tokenizers, are encoded by it whole.
    """

    def __init__(self, vocabulary: str, end: int | None = END_ID):
        self.tokenizer = Tokenizer.from_str(vocabulary)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        described = json.loads(vocabulary)
        self.cut, self.known, self.pieces = _cuttable(described), {}, {}
        self.special = [token["content"] for token in described.get("added_tokens", [])]
        self.split, self.letters = regex.compile(PIECES).findall, _byte_letters()
        self.end = b"" if end is None else struct.pack("<I", end)

    def _whole(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(one.ids, "<u4").tobytes() for one in found]

    def _piece(self, piece: str) -> bytes:
        """The ids of one piece as the tokenizer splits them."""
        tokens = self.tokenize(codecs.charmap_decode(piece.encode(), "strict", self.letters)[0])
        return struct.pack(f"<{len(tokens)}I", *[token.id for token in tokens])

    def _known_piece(self, piece: str) -> bytes:
        found = self.pieces.get(piece)
        if found is None:
            self.pieces[piece] = found = self._piece(piece)
        return found

    def _learn(self, chunks: list[str]) -> None:
        """Adds chunks to those known."""
        self.tokenize = self.tokenizer.model.tokenize
        known, settled, others = self.known, SETTLED.fullmatch, []
        for chunk in chunks:
            if len(chunk) > CHUNK_CHARS or not (chunk.isascii() or settled(chunk)):
                others.append(chunk)
            elif chunk.removeprefix(" ").isalpha():
                known[chunk] = self._piece(chunk)
            elif any(token in chunk for token in self.special):
                others.append(chunk)
            else:
                known[chunk] = b"".join(map(self._known_piece, self.split(chunk)))
        known.update(zip(others, self._whole(others)))

    def encode(self, texts: list[str] | pa.Array) -> Iterator[bytes]:
        """The ids of each text as little-endian u32, with the end id."""
        if not self.cut:
            for at in range(0, len(texts), WHOLE_TEXTS):
                part = texts[at:at + WHOLE_TEXTS]
                part = part.to_pylist() if isinstance(part, pa.Array) else part
                yield from (ids + self.end for ids in self._whole(part))
            return
        for at in range(0, len(texts), CUT_TEXTS):
            part = texts[at:at + CUT_TEXTS]
            part = part.cast(pa.large_string()) if isinstance(part, pa.Array) else pa.array(part, pa.large_string())
            chunks, before = _chunks(part)
            coded = chunks.dictionary_encode()
            distinct = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
            found = list(map(self.known.get, distinct))
            missing = [number for number, ids in enumerate(found) if ids is None]
            fresh = [distinct[number] for number in missing]
            self._learn(fresh)
            for number, chunk in zip(missing, fresh):
                found[number] = self.known[chunk]
            ids = pa.array(found, pa.large_binary()).take(coded.indices)
            for chunk in fresh:
                if len(chunk) > CHUNK_CHARS:
                    del self.known[chunk]
            if len(self.known) + len(self.pieces) > CHUNKS:
                self.known.clear()
                self.pieces.clear()
            _, offsets, data = ids.buffers()
            ends, joined = np.frombuffer(offsets, "<i8")[before].tolist(), memoryview(data or b"")
            for first, last in zip(ends, ends[1:]):
                yield b"".join((joined[first:last], self.end))


def _single_threaded() -> None:
    """Tasks share the cores already."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"


@dataclass(frozen=True)
class Dictionary:
    """The shared dictionary: its bytes and their SHA-256; no bytes stand for none."""

    data: bytes

    @property
    def digest(self) -> bytes:
        return hashlib.sha256(self.data).digest() if self.data else bytes(32)

    @property
    def name(self) -> str:
        return f"dictionary-{self.digest.hex()}.zdict"

    def loaded(self) -> zstandard.ZstdCompressionDict | None:
        return zstandard.ZstdCompressionDict(self.data) if self.data else None

    @staticmethod
    def train(samples: list[bytes], size: int = DICTIONARY_BYTES) -> "Dictionary":
        """From serialized id arrays; without enough of them, their bytes themselves serve."""
        samples = [sample for sample in samples if sample]
        try:
            trained = zstandard.train_dictionary(min(size, max(256, sum(map(len, samples)) // 10)), samples, k=64, d=8)
            return Dictionary(trained.as_bytes())
        except (zstandard.ZstdError, ValueError):
            return Dictionary(b"".join(samples)[-size:])


def _width(tokenizer: Tokenizer) -> int:
    return 2 if tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else 4


class FileWriter:
    """Writes one id file front to back; holds the index entries and nothing else."""

    def __init__(self, sink, dictionary: Dictionary, width: int, level: int = LEVEL):
        self.sink, self.width, self.entries, self.tokens = sink, width, [], 0
        self.compress = zstandard.ZstdCompressor(level=level, dict_data=dictionary.loaded()).compress
        sink.write(struct.pack(HEAD, MAGIC, width, dictionary.digest))
        self.size = struct.calcsize(HEAD)

    def add(self, number: int | None, ids: bytes) -> None:
        """One document; ``ids`` are little-endian u32."""
        frame = self.compress(ids if self.width == 4 else np.frombuffer(ids, "<u4").astype("<u2").tobytes())
        self.sink.write(frame)
        self.entries.append((self.size, len(frame), zlib.crc32(ids), self.tokens, number or 0, number is None))
        self.size += len(frame)
        self.tokens += len(ids) // 4

    def close(self) -> None:
        self.sink.write(np.array(self.entries, ENTRY).tobytes())
        self.sink.write(struct.pack(TAIL, self.size, len(self.entries), self.tokens, MAGIC))
        self.sink.close()


class FileReader:
    """Documents of one id file by position, each by a read of its entry and its frame."""

    def __init__(self, files: fs.FileSystem, path: str):
        self.source = files.open_input_file(path)
        size = self.source.size()
        magic, self.width, digest = struct.unpack(HEAD, self.source.read_at(struct.calcsize(HEAD), 0))
        self.index, self.docs, self.tokens, again = struct.unpack(TAIL, self.source.read_at(struct.calcsize(TAIL), size - struct.calcsize(TAIL)))
        if magic != MAGIC or again != MAGIC:
            raise ValueError(f"{path} is no id file")
        data = b""
        if digest != bytes(32):
            with files.open_input_file(f"{path.rpartition('/')[0]}/dictionary-{digest.hex()}.zdict") as source:
                data = source.read()
            if hashlib.sha256(data).digest() != digest:
                raise ValueError(f"the dictionary of {path} does not match its hash")
        self.unpack = zstandard.ZstdDecompressor(dict_data=Dictionary(data).loaded()).decompress

    def entries(self, at: int, n: int) -> np.ndarray:
        n = min(n, self.docs - at)
        return np.frombuffer(self.source.read_at(n * ENTRY.itemsize, self.index + at * ENTRY.itemsize), ENTRY)

    def _ids(self, frame: bytes) -> np.ndarray:
        return np.frombuffer(self.unpack(frame), "<u4" if self.width == 4 else "<u2").astype("<u4")

    def document(self, at: int) -> tuple[int | None, np.ndarray]:
        """Number and ids of the document at a position."""
        if not 0 <= at < self.docs:
            raise IndexError(f"no document {at} among {self.docs}")
        entry = self.entries(at, 1)[0]
        ids = self._ids(self.source.read_at(int(entry["size"]), int(entry["at"])))
        return None if entry["absent"] else int(entry["number"]), ids

    def documents(self, step: int = 4096, stretch: int = 8 << 20) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """Number, first token in the file and ids of all documents, in their order; checked by crc32."""
        for at in range(0, self.docs, step):
            entries = self.entries(at, step)
            first = 0
            while first < len(entries):
                start = int(entries[first]["at"])
                # Frames lie in order, so some are read together.
                ends = entries["at"][first:].astype(np.int64) + entries["size"][first:] - start
                n = max(1, int(np.searchsorted(ends, stretch, "right")))
                data = self.source.read_at(int(ends[n - 1]), start)
                for entry in entries[first:first + n]:
                    place = int(entry["at"]) - start
                    ids = self._ids(data[place:place + int(entry["size"])])
                    if zlib.crc32(ids.tobytes()) != entry["crc"]:
                        raise ValueError("a document does not match its crc32")
                    yield None if entry["absent"] else int(entry["number"]), int(entry["first"]), ids
                first += n


def _held(vocabulary: str) -> str:
    with open(vocabulary, encoding="utf-8") as file:
        return file.read()


def sampled(docs: DataFrame, held: str, rows: int, chars: int, end: int | None) -> list[bytes]:
    """Serialized ids of at most ``rows`` documents of at most ``chars`` characters, those of smallest hash."""
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _single_threaded()
        encoder = Encoder(held, end)
        width = _width(encoder.tokenizer)
        for batch in batches:
            ids = [np.frombuffer(one, "<u4").astype(f"<u{width}").tobytes() for one in encoder.encode(batch.column(0))]
            yield pa.RecordBatch.from_pydict({"ids": pa.array(ids, pa.binary())})

    short = docs.filter(F.length("text").between(1, chars)).orderBy(F.xxhash64("number", "text"), "text").limit(rows)
    return sorted(bytes(row.ids) for row in short.select("text").mapInArrow(encode, "ids binary").toLocalIterator())


FILES = "part int, piece int, path string, docs long, tokens long, bytes long"


def write_files(
    docs: DataFrame, folder: str, key: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY,
    end: int | None = END_ID, level: int = LEVEL, file_bytes: int = FILE_BYTES, sample_docs: int = SAMPLE_DOCS,
    sample_chars: int = SAMPLE_CHARS, dictionary_bytes: int = DICTIONARY_BYTES,
) -> DataFrame:
    """Writes the ids of every document in ascending order of ``key``; one row per file, with ``first``, its first token.

    Texts are dealt out by ranges of the key, encoded where they are written, and never stored as
    ids elsewhere. Null keys come first; rows of one key follow a hash of their text, so equal rows
    may change places, which changes nothing. A hot key is spread over ranges. File names are new for
    each attempt of a task and only those of attempts that ended well are returned, so a lost
    executor leaves files that nobody reads. The vocabulary file is read here and travels with the tasks.
    """
    held = _held(vocabulary)
    docs = docs.select(F.col(key).cast("long").alias("number"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    dictionary = Dictionary.train(sampled(docs, held, sample_docs, sample_chars, end), dictionary_bytes)
    files, root = fs.FileSystem.from_uri(folder)
    files.create_dir(root, recursive=True)
    if dictionary.data:
        with files.open_output_stream(f"{root}/{dictionary.name}") as sink:
            sink.write(dictionary.data)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _single_threaded()
        files, root = fs.FileSystem.from_uri(folder)
        encoder = Encoder(held, end)
        part, writer, done = TaskContext.get().partitionId(), None, []

        def finish() -> None:
            writer.close()
            done.append((part, len(done), path, len(writer.entries), writer.tokens, writer.size))

        # Many small values and no cycles: looking for some takes a quarter of the time.
        gc.disable()
        try:
            for batch in batches:
                for number, ids in zip(batch.column(0).to_pylist(), encoder.encode(batch.column(1))):
                    if writer is None:
                        path = f"{root}/{uuid.uuid4().hex}.ids"
                        writer = FileWriter(files.open_output_stream(path), dictionary, _width(encoder.tokenizer), level)
                    writer.add(number, ids)
                    if writer.size >= file_bytes or len(writer.entries) >= FILE_DOCS:
                        finish()
                        writer = None
        finally:
            gc.enable()
        if writer is not None:
            finish()
        if done:
            columns = list(zip(*done))
            types = [pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
            names = [field.split(" ")[0] for field in FILES.split(", ")]
            yield pa.RecordBatch.from_pydict({name: pa.array(c, t) for name, c, t in zip(names, columns, types)})

    dealt = (
        docs.withColumns({"hash": F.xxhash64("text"), "row": F.monotonically_increasing_id()})
        .repartitionByRange("number", "hash", "row").sortWithinPartitions("number", "hash")
    )
    written = stored(dealt.select("number", "text").mapInArrow(write, FILES), "id-files")
    # One row per file of FILE_BYTES: what is summed up in order is small.
    before = Window.orderBy("part", "piece").rowsBetween(Window.unboundedPreceding, -1)
    return stored(written.withColumn("first", F.coalesce(F.sum("tokens").over(before), F.lit(0))), "id-files")


READ = "{key} long, start long, n_tokens long, ids_crc32 long{ids}"


def read_files(written: DataFrame, folder: str, key: str = "doc_id", ids: bool = True) -> DataFrame:
    """Every document of the written files: its number, ``start``, ``n_tokens``, ``ids_crc32`` and its ``ids``.

    One file is one row of work; its documents are read one after the other and checked.
    """
    schema = READ.format(key=key, ids=", ids array<int>" if ids else "")

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        files, _ = fs.FileSystem.from_uri(folder)
        names = [field.split(" ")[0] for field in schema.split(", ")]

        def frame(rows: list[tuple]) -> pd.DataFrame:
            return pd.DataFrame(rows, columns=names).astype({key: "Int64"})

        for batch in batches:
            for path, first in zip(batch["path"], batch["first"]):
                rows, held = [], 0
                for number, start, found in FileReader(files, path).documents():
                    row = (number, first + start, len(found), zlib.crc32(found.tobytes()))
                    rows.append((*row, found.astype(np.int32)) if ids else row)
                    held += len(found) if ids else 1
                    if held > 500_000:
                        yield frame(rows)
                        rows, held = [], 0
                if rows:
                    yield frame(rows)

    tasks = max(1, min(written.count(), READERS))
    return written.select("path", "first").repartition(tasks, "path").mapInPandas(read, schema)


def read_document(written: DataFrame, folder: str, position: int) -> tuple[int | None, list[int]]:
    """Number and ids of the document at a position in the whole order, without reading any other."""
    before = Window.orderBy("part", "piece").rowsBetween(Window.unboundedPreceding, -1)
    places = written.withColumn("skipped", F.coalesce(F.sum("docs").over(before), F.lit(0)))
    row = places.filter((F.col("skipped") <= position) & (F.col("skipped") + F.col("docs") > position)).first()
    if row is None:
        raise IndexError(f"no document at position {position}")
    number, ids = FileReader(fs.FileSystem.from_uri(folder)[0], row["path"]).document(position - row["skipped"])
    return number, ids.tolist()


def roundtrip(docs: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY, ids: bool = False) -> DataFrame:
    """Writes the ids of ``docs`` to files in the shared folder and reads every document back.

    Null and empty texts are the end id alone. Rows of a null key come first, repeated rows are
    documents of their own, extra columns are not written; no rows give no files and no documents.
    Special tokens spelled out in a text are encoded as the library does by default.
    """
    folder = fresh_folder(docs.sparkSession, "token-ids")
    return read_files(write_files(docs, folder, key, text, vocabulary), folder, key, ids)
