"""BPE encoding and decoding by a distinct-word table.

Texts are split into words in Spark tasks, each distinct word that recurs is encoded once, and the ids
come back by position. Words of the table that fit in a proven size are broadcast, the most frequent
first; of the others a task encodes each where it meets it, which takes less than a join of every text
with a rare word. Decoding joins ids with the pieces of the vocabulary, a table whose size is the
tokenizer's own.
"""

from __future__ import annotations

import re
from array import array
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm.common import slices, stored
from lodestone.llm.tokenizers_io import default_path, load

# The pattern of the tokenizer's file, for characters below U+0180. Plain letters come first, as most words have no others.
_LETTERS = "a-zªµºß-öø-ſ"
_WORD = re.compile(rf"[a-z]++(?![{_LETTERS}])|[{_LETTERS}]+|[0-9²³¹¼½¾]|'s|'t|'re|'ve|'m|'ll|'d|[^\s{_LETTERS}0-9²³¹¼½¾]+")
# Characters for which str.lower() and the pattern may differ from the library, and its special strings.
_ODD = re.compile("[\x1c-\x1fİƀ-\U0010ffff]")
_SPECIAL = ("<|startoftext|>", "<|endoftext|>")
_SPACE = re.compile("[ \t\n\r\x0b\x0c]+")


def _other(text: str) -> bool:
    return "<|" in text and any(x in text for x in _SPECIAL) or _ODD.search(text) is not None


def words_of(text: str) -> list[str]:
    """Parts of text whose encodings, one after another, are the text's.

    They are the tokenizer's own words in lower case. Where a run between white space holds a special
    string or a character that the pattern above doesn't cover, the run as it is.
    """
    if not _other(text):
        return _WORD.findall(text.lower())
    out: list[str] = []
    for run in _SPACE.split(text):
        if _other(run):
            out.append(run)
        elif run:
            out += _WORD.findall(run.lower())
    return out


def key_of(word: str) -> int:
    """Of 64 bits; a Table tells two words of one key apart."""
    return xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass")) - (1 << 63)


def distinct_words(docs: DataFrame, text_col: str) -> DataFrame:
    """word, n: each distinct word of all texts and its number of occurrences."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        emit = lambda: pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["word", "n"])
        for batch in slices(batches):
            for text in batch.column(0).to_pylist():
                if text:
                    seen.update(words_of(text))
                if len(seen) > 200_000:
                    yield emit()
                    seen.clear()
        yield emit()

    return docs.select(F.col(text_col)).mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def encode_table(words: DataFrame, path: str) -> DataFrame:
    """word, n, key, ids (binary: little-endian unsigned 32-bit): each of words encoded once."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = load(path)
        for batch in batches:
            ws = batch.column(0).to_pylist()
            ids = [np.array(e.ids, "<u4").tobytes() for e in tokenizer.encode_batch_fast(ws, add_special_tokens=False)] if ws else []
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([key_of(w) for w in ws], pa.int64()), pa.array(ids, pa.binary())], ["word", "n", "key", "ids"])

    return words.mapInArrow(encode, "word string, n long, key long, ids binary")


class Table:
    """Words and their ids, sorted by key: flat arrays of the keys, of where each one's ids and letters (UTF-8) begin, and of ids and letters themselves."""

    def __init__(self, keys: bytes, n_ids: np.ndarray, ids: bytes, n_letters: np.ndarray, letters: bytes):
        begins = lambda n: array("I", np.concatenate([[0], np.cumsum(n)]).astype(np.uint32).tobytes())
        self.keys, self.id_at, self.letter_at, self.ids, self.letters = array("q", keys), begins(n_ids * 4), begins(n_letters), ids, letters

    def find(self, word: str) -> bytes | None:
        """The ids of word, little-endian and of 32 bits; None if it isn't here."""
        key, letters = key_of(word), word.encode("utf-8", "surrogatepass")
        i = bisect_left(self.keys, key)
        while i < len(self.keys) and self.keys[i] == key:
            if self.letters[self.letter_at[i] : self.letter_at[i + 1]] == letters:
                return self.ids[self.id_at[i] : self.id_at[i + 1]]
            i += 1
        return None


#: Bytes of a word in a Table, besides its letters and ids.
_ROW = 16


def _fetch(table: DataFrame) -> Table:
    """Collects a table whose size has been checked, a quarter of the keys at a time, so that the driver holds it hardly more than once."""

    def flat(column: pa.Array) -> tuple[np.ndarray, bytes]:
        column = column.cast(pa.binary())
        offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int32)
        return np.diff(offsets), column.buffers()[2][offsets[0] : offsets[-1]].to_pybytes() if offsets[-1] > offsets[0] else b""

    keys, n_ids, ids, n_letters, letters = [], [np.zeros(0, np.int32)], [], [np.zeros(0, np.int32)], []
    for quarter in range(-2, 2):
        for batch in table.where(F.shiftright("key", 62) == quarter).select("key", "ids", "word").toArrow().sort_by("key").to_batches():
            keys.append(batch.column(0).to_numpy().tobytes())
            for column, n, data in ((batch.column(1), n_ids, ids), (batch.column(2), n_letters, letters)):
                lengths, got = flat(column)
                n.append(lengths)
                data.append(got)
    return Table(b"".join(keys), np.concatenate(n_ids) // 4, b"".join(ids), np.concatenate(n_letters), b"".join(letters))


#: Words of the table that a worker remembers, in two halves, and the characters of the longest of them.
REMEMBERED, LONGEST = 1 << 18, 64


class Known(dict):
    """word -> its ids, little-endian and of 32 bits: from the table, or else by the tokenizer.

    A worker remembers words of the table until half of REMEMBERED others have come since; those that recur stay.
    """

    def __init__(self, table: Table, path: str):
        super().__init__()
        self.table, self.path, self.before = table, path, {}

    def __missing__(self, word: str) -> bytes:
        ids = self.before.get(word)
        if ids is None:
            ids = self.table.find(word)
            if ids is None:
                return np.array(load(self.path).encode(word, add_special_tokens=False).ids, "<u4").tobytes()
            if len(word) > LONGEST:
                return ids
        if len(self) * 2 >= REMEMBERED:
            self.before = dict(self)
            self.clear()
        self[word] = ids
        return ids


def bpe_encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer_path: str | None = None, table_bytes: int = 64 << 20, decode: bool = False) -> DataFrame:
    """id_col and each text's token ids, a binary of little-endian unsigned 32-bit numbers; a null text counts as empty.

    With decode, also text: the ids decoded as by bpe_decode(), in the same pass.

    Of the table of words that occur twice or more, as many as take table_bytes, the most frequent first,
    are broadcast. Other words are encoded in the task that meets them; both give the same ids.
    """
    spark, path = docs.sparkSession, tokenizer_path or default_path()
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    table = stored(encode_table(distinct_words(rows, "text").where("n > 1"), path), "words").withColumn("often", F.floor(F.log2("n")).cast("int"))
    held, least = 0, 64
    for often, size in table.groupBy("often").agg(F.sum(F.octet_length("ids") + F.octet_length("word") + _ROW)).orderBy(F.desc("often")).collect():  # a row for each power of two
        if held + size > table_bytes:
            break
        held, least = held + size, often
    pieces = spark.sparkContext.broadcast(Pieces(path)) if decode else None
    shared = spark.sparkContext.broadcast(Known(_fetch(table.where(F.col("often") >= least)), path))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value.__getitem__
        for batch in slices(batches):
            ids = [b"".join(map(known, words_of(text))) for text in batch.column(1).to_pylist()]
            texts = [pa.array([pieces.value.text(np.frombuffer(i, "<u4")) for i in ids], pa.string())] if decode else []
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary()), *texts], ["id", "ids", "text"][: 2 + decode])

    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("ids", T.BinaryType()), *([T.StructField("text", T.StringType())] if decode else [])])
    return rows.mapInArrow(encode, schema).select(F.col("id").alias(id_col), *schema.names[1:])


class Pieces:
    """The id-to-piece table as flat bytes; it has as many rows as the tokenizer's vocabulary."""

    def __init__(self, path: str):
        tokenizer = load(path)
        size = max(tokenizer.get_vocab(with_added_tokens=True).values(), default=-1) + 1
        pieces = [tokenizer.id_to_token(i) for i in range(size)]
        raw = [b"" if p is None else p.encode() + b" " for p in pieces]
        self.flat, self.n = np.frombuffer(b"".join(raw), np.uint8), np.array([len(r) for r in raw], np.int64)
        self.start = np.cumsum(self.n) - self.n

    def text(self, ids: np.ndarray) -> str:
        """The pieces of ids with a space between; ids without a piece are left out."""
        ids = ids[ids < len(self.n)]
        k = self.n[ids]
        at = np.repeat(self.start[ids] - (np.cumsum(k) - k), k) + np.arange(int(k.sum()))
        return self.flat[at].tobytes()[:-1].decode()


def bpe_decode(encoded: DataFrame, id_col: str = "doc_id", tokenizer_path: str | None = None) -> DataFrame:
    """id_col, ids and text: the pieces of the ids, special ones too, as the library's decode() without a decoder joins them.

    The id-to-piece table is broadcast. Ids beyond the vocabulary have no piece and are left out; null ids give a null text.
    """
    shared = encoded.sparkSession.sparkContext.broadcast(Pieces(tokenizer_path or default_path()))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = [None if got is None else shared.value.text(np.frombuffer(got, "<u4")) for got in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], ["id", "ids", "text"])

    schema = T.StructType([T.StructField("id", encoded.schema[id_col].dataType), T.StructField("ids", T.BinaryType()), T.StructField("text", T.StringType())])
    return encoded.select(F.col(id_col).alias("id"), "ids").mapInArrow(decode, schema).withColumnRenamed("id", id_col)


def digests(docs: DataFrame, table_bytes: int = 64 << 20) -> DataFrame:
    back = bpe_encode(docs, decode=True, table_bytes=table_bytes)
    return back.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.encode("text", "UTF-8"), 256).alias("decoded_sha256"))


def op9_bpe(spark, sf_dir: str) -> DataFrame:
    """Every row of `documents`, repeated ones too; a null text counts as empty."""
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))
