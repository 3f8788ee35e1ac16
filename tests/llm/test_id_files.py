"""Token files: an exact round trip, the ids against the library, single reads, and what a loss leaves."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyarrow import fs
from tokenizers import Tokenizer

import edges
from vigie.llm import id_files
from vigie.llm.queries import QUERIES
from vigie.session import fresh_folder

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(id_files.VOCABULARY)


def ids_of(tokenizer, text):
    return tokenizer.encode(text or "", add_special_tokens=False).ids + [0]


def plain(tokenizer, rows):
    """Rows in order are (number, text)."""
    out, start = [], 0
    for number, text in rows:
        ids = ids_of(tokenizer, text)
        out.append((number, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_query_equals_library(spark, tokenizer):
    rows = sorted(edges.given_rows(SF_DIR, "documents", "doc_id", "text"))
    found = QUERIES["op12_token_files"](spark, SF_DIR)
    assert found.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    assert sorted(tuple(r) for r in found.collect()) == plain(tokenizer, rows)


def test_chunks_equal_whole_texts(tokenizer):
    """Texts cut at spaces get the ids of whole texts, whatever white space and signs they hold."""
    rng = random.Random(3)
    alphabet = ["a", "B", "é", "日", "1", "'", "'s", "'ll", ".", "!", " ", "  ", "\n", "\t", " ", " ", "\x1c", "\x85", "​", "　", "<|endoftext|>", "😀", "́"]
    texts = ["".join(rng.choices(alphabet, k=rng.randint(0, 30))) for _ in range(4000)]
    texts += [" " * n + "x" for n in range(5)] + ["", " ", "\n ", " \n x", "x" * 3000, " x" * 3000, "ab " * 20_000, " " * 100_000, "word" * 500 + " end"]
    with open(id_files.VOCABULARY) as file:
        encoder = id_files.Encoder(file.read())
    assert encoder.cut
    found = list(encoder.encode(texts))
    assert [np.frombuffer(ids, "<u4").tolist() for ids in found] == [ids_of(tokenizer, text) for text in texts]
    encoder.cut = False
    assert list(encoder.encode(texts)) == found


def test_signs_and_line_ends_between_chunks(tokenizer):
    """Cuts at signs and single line ends change no id, whatever stands around them."""
    rng = random.Random(5)
    alphabet = ["a", "Zé", "é", "×", "÷", "Ā", "ȿ", "日", "7", "'s", ".", ",", "?", "\n", "\r", " ", "\xa0", "\x85", "\u2028", "\u3000", "«", "—", "<|endoftext|>", "|>", "<|"]
    texts = ["".join(rng.choices(alphabet, k=rng.randint(0, 12))) for _ in range(20_000)]
    texts += ["a.\nb", "a.\n\nb", "a\n.b", "a.\n", ".\nb", "a\xa0\nb", "it's.", "it'.s", "é.", "×.", "a.\né", " ", "a ", " a", "  a", "a.\n b"]
    with open(id_files.VOCABULARY) as file:
        encoder = id_files.Encoder(file.read())
    wanted = [ids_of(tokenizer, text) for text in texts]
    assert [np.frombuffer(ids, "<u4").tolist() for ids in encoder.encode(texts)] == wanted
    # A part of a column is cut where its own texts lie.
    column = pa.array(texts).slice(7, 5000)
    assert [np.frombuffer(ids, "<u4").tolist() for ids in encoder.encode(column)] == wanted[7:5007]


def test_chunks_are_encoded_once():
    """The model gets a word once, whatever sign follows it, and nothing twice that begins a text."""
    with open(id_files.VOCABULARY) as file:
        encoder = id_files.Encoder(file.read())
    asked = []
    piece, whole = encoder._piece, encoder._whole
    encoder._piece = lambda text: asked.append(text) or piece(text)
    encoder._whole = lambda texts: asked.extend(texts) or whole(texts)
    texts = ["One word, one word. Two\nWord", "One, word! A word."] * 3
    first = list(encoder.encode(texts))
    assert len(asked) == len(set(asked)) and " word," not in asked
    asked.clear()
    assert list(encoder.encode(texts)) == first and not asked


def test_other_tokenizers_get_whole_texts():
    with open("/opt/tokenizers/word_bpe_49k.json") as file:
        held = file.read()
    encoder = id_files.Encoder(held, end=None)
    assert not encoder.cut
    own = Tokenizer.from_str(held)
    texts = ["Two  words.", "", "A\nB c"]
    wanted = [own.encode(text, add_special_tokens=False).ids for text in texts]
    assert [np.frombuffer(ids, "<u4").tolist() for ids in encoder.encode(texts)] == wanted


def test_edges(spark, tokenizer):
    docs = edges.documents(spark)
    found = id_files.roundtrip(docs, ids=True).collect()
    assert len(found) == len(edges.TEXTS)
    assert sorted((r.doc_id is not None, r.doc_id, r.ids) if r.doc_id is not None else (False, 0, r.ids) for r in found) == sorted(
        (key is not None, key or 0, ids_of(tokenizer, text)) for key, text, _ in edges.TEXTS)
    by_start = sorted(found, key=lambda r: r.start)
    assert [r.doc_id for r in by_start] == sorted((r.doc_id for r in found), key=lambda n: (n is not None, n or 0))
    at = 0
    for row in by_start:
        assert row.start == at and row.n_tokens == len(row.ids)
        assert row.ids_crc32 == zlib.crc32(np.array(row.ids, "<u4").tobytes())
        at += row.n_tokens
    assert id_files.roundtrip(edges.empty(spark)).count() == 0


def test_many_files_and_single_reads(spark, tokenizer):
    """Files are closed at a size; any position is read by itself, and starts run on over files."""
    rows = [(i, f"document {i} " + "some common words " * (i % 9)) for i in range(500)]
    random.Random(1).shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id BIGINT, text STRING").repartition(6)
    folder = fresh_folder(spark, "token-ids")
    written = id_files.write_files(docs, folder, file_bytes=2000)
    assert written.count() > 6
    found = id_files.read_files(written, folder, ids=False)
    assert sorted(tuple(r) for r in found.collect()) == plain(tokenizer, sorted(rows))
    for position in (0, 17, 499):
        assert id_files.read_document(written, folder, position) == (position, ids_of(tokenizer, dict(rows)[position]))
    with pytest.raises(IndexError):
        id_files.read_document(written, folder, 500)
    files, root = fs.FileSystem.from_uri(folder)
    names = [f.base_name for f in files.get_file_info(fs.FileSelector(root))]
    assert sum(name.endswith(".zdict") for name in names) == 1
    # The dictionary helps short documents: they take less than alone.
    raw = sum(len(ids_of(tokenizer, text)) * 2 for _, text in rows)
    assert written.agg({"bytes": "sum"}).first()[0] - 500 * id_files.ENTRY.itemsize < raw


def test_damage_is_noticed(spark, tmp_path):
    docs = spark.createDataFrame([(1, "one two three"), (2, "four")], "doc_id BIGINT, text STRING")
    folder = f"file://{tmp_path}/ids"
    written = id_files.write_files(docs, folder).collect()
    path = written[0].path
    files, _ = fs.FileSystem.from_uri(folder)
    assert [number for number, _, _ in id_files.FileReader(files, path).documents()] == [1, 2][: written[0].docs]
    dictionary = next(iter((tmp_path / "ids").glob("*.zdict")))
    dictionary.write_bytes(b"other")
    with pytest.raises(ValueError, match="hash"):
        id_files.FileReader(files, path)


def test_one_hot_number(spark, tokenizer):
    """A number that a third of all rows have is spread over several files."""
    rows = [(7 if i % 3 else i, f"text {i % 50}") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id BIGINT, text STRING").repartition(4)
    folder = fresh_folder(spark, "token-ids")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        written = id_files.write_files(docs, folder)
        assert written.filter("docs > 0").count() >= 6 and written.agg({"docs": "max"}).first()[0] < 1000
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    found = sorted(tuple(r) for r in id_files.read_files(written, folder, ids=False).collect())
    assert sum(r[2] for r in found) == sum(r[2] for r in plain(tokenizer, rows))
