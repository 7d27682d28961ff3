"""Token counts: short texts word by word, huge ones by overlap resynchronisation.

The tokens of a short text are those of its words, and a task encodes a word that it has just seen only once.

A huge text is encoded in chunks that overlap. Two neighbours are spliced at a position in their
overlap where both end a token at a word's end, begin the next one after it, and agree on every
token from there to the overlap's last such boundary. White space ends words for this tokenizer, and
so do digits and a change between letters and punctuation, so tokens on one side don't depend on the
other; that both encodings agree is checked, not assumed. Without such a position the overlap is
doubled, up to all that is open; without one there, the open text is doubled and encoded anew, so
that a text without boundaries costs twice its own encoding.
"""

from __future__ import annotations

import unicodedata
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm.bpe import words_of
from lodestone.llm.common import slices
from lodestone.llm.tokenizers_io import default_path, load


_SPACES = " \t\n\r\x0b\x0c"
#: Characters that the tokenizer's contractions and special strings are made of.
_JOINS = "'<|>"


class _Encoded:
    """The tokens of text[start:end]: offsets (relative to start) and ids."""

    def __init__(self, tokenizer, text: str, start: int, end: int):
        e = tokenizer.encode(text[start:end], add_special_tokens=False)
        self.start, self.offsets, self.ids = start, e.offsets, e.ids

    def at(self, place: int) -> int:
        """The number of tokens that begin before a place in the text."""
        return bisect_left(self.offsets, (place - self.start,))

    def ends_by(self, place: int) -> bool:
        """Whether the tokens that begin before a place end there at the latest."""
        i = self.at(place)
        return not i or self.offsets[i - 1][1] <= place - self.start

    def between(self, first: int, last: int) -> list[tuple[int, int, int]]:
        i, j = self.at(first), self.at(last)
        return [(a + self.start, b + self.start, t) for (a, b), t in zip(self.offsets[i:j], self.ids[i:j], strict=True)]


def _ends_word(a: str, b: str) -> bool:
    """Whether a word surely ends between two neighbouring characters, whatever stands around them.

    Not beside marks, which may join the character before, nor beside apostrophes and the signs of special strings.
    """
    if a in _SPACES or b in _SPACES:
        return True
    x, y = unicodedata.category(a)[0], unicodedata.category(b)[0]
    if x == "N" and y in "LN" or x == "L" and y == "N":
        return True
    return (x == "L" and y in "PS" and b not in _JOINS) or (x in "PS" and y == "L" and a not in _JOINS)


def _cuts(text: str, start: int, end: int) -> tuple[int, int] | None:
    """The first and the last position in text[start:end] before which a word surely ends; None if there aren't two."""
    first = next((i for i in range(start + 1, end) if _ends_word(text[i - 1], text[i])), None)
    if first is None:
        return None
    last = next(i for i in range(end - 1, start, -1) if _ends_word(text[i - 1], text[i]))
    return (first, last) if last > first else None


def _splice(left: _Encoded, right: _Encoded, first: int, last: int) -> int | None:
    """first, if it is a stable boundary: left's tokens count before it, right's from it.

    The first cut of the overlap comes after what may be half a word in `right`, and the last one before
    what may be half a word in `left`; between them both must have the same tokens.
    """
    if not all(tokens.ends_by(p) for tokens in (left, right) for p in (first, last)):
        return None
    a = left.between(first, last)
    return first if a and a == right.between(first, last) else None


def count_huge(tokenizer, text: str, chunk: int, overlap: int) -> int:
    """The number of tokens of text, from overlapping chunks of about `chunk` characters, longer ones where words don't end."""
    if len(text) <= chunk:
        return len(tokenizer.encode(text, add_special_tokens=False).ids)
    total, begin = 0, 0  # tokens of text[:begin] are counted
    end = chunk
    left = _Encoded(tokenizer, text, 0, end)
    while end < len(text):
        to = min(len(text), end + (chunk if end - begin <= 2 * chunk else end - begin))
        width = min(overlap, end - begin)
        while True:
            cut, found = None, _cuts(text, end - width, end)
            if found:
                right = _Encoded(tokenizer, text, end - width, to)
                cut = _splice(left, right, *found)
            if cut is not None or width == end - begin:
                break
            width = min(2 * width, end - begin)
        if cut is None:  # no boundary in all that is open: one chunk from its beginning
            left, end = _Encoded(tokenizer, text, begin, to), to
            continue
        total += left.at(cut) - left.at(begin)
        begin, left, end = cut, right, to
    return total + len(left.ids) - left.at(begin)


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer_path: str | None = None, chunk: int = 1 << 14, overlap: int = 256, limit: int = 2048) -> DataFrame:
    """id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit) for each row; null text counts as empty.

    Texts of more than `chunk` characters go through count_huge(), the others through their words. Without added special tokens; special strings in a text are read as the library's default does.
    The tokenizer must be of the kind that bpe.words_of() splits for: white space ends words and has no tokens.
    """
    path = tokenizer_path or default_path()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = load(path)
        known: dict[str, int] = {}
        for batch in slices(batches):
            texts = ["" if t is None else t for t in batch.column(1).to_pylist()]
            n = [count_huge(tokenizer, t, chunk, overlap) if len(t) > chunk else 0 for t in texts]
            words = [words_of(t) if len(t) <= chunk else [] for t in texts]
            if len(known) > 200_000:
                known.clear()
            fresh = list({w for ws in words for w in ws if w not in known})
            known.update(zip(fresh, map(len, tokenizer.encode_batch_fast(fresh, add_special_tokens=False)), strict=True))
            n = [a + sum(map(known.__getitem__, ws)) for a, ws in zip(n, words, strict=True)]
            sizes = [len(t.encode("utf-8", "surrogatepass")) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], ["id", "n_bytes", "n_tokens", "over_limit"])

    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType())])
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(count, schema).withColumnRenamed("id", id_col)


def op6_token_counts(spark, sf_dir: str) -> DataFrame:
    """Every row of `documents`, repeated ones too; a null text counts as empty."""
    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
