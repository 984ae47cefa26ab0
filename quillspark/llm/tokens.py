"""Encoding of a whole corpus with a public tokenizer, by forced-boundary splitting.

A pair of bytes that occurs inside no token of the vocabulary can't be merged, so a cut between them is certain.
Texts are cut at such pairs, the fragments are encoded independently, and their ids are concatenated. Fragments
repeat, so each task encodes a fragment once; very long texts are cut into blocks that several tasks encode.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Where the vocabulary is read from, on the driver; it is sent to the tasks.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the vocabulary's pattern of words.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# White space by the pattern.
_SPACES = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
#: Texts with more characters are encoded in blocks of about this size.
BLOCK_CHARS = 1 << 18
#: Fragments that a task remembers at most before it starts afresh.
REMEMBERED = 300_000


def read_vocabulary(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def forced_pairs(ranks: dict[bytes, int]) -> np.ndarray:
    """[256, 256], true where the two bytes never follow each other inside a token."""
    inside = np.zeros((256, 256), dtype=bool)
    for token in ranks:
        if len(token) > 1:
            b = np.frombuffer(token, dtype=np.uint8)
            inside[b[:-1], b[1:]] = True
    return ~inside


class FragmentEncoder:
    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN):
        import tiktoken

        self.forced = forced_pairs(ranks)
        self.plain = tiktoken.Encoding("plain", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.known: dict[str, list[int]] = {}
        self.space = np.zeros(0x3002, dtype=bool)
        self.space[_SPACES] = True
        self.word = np.zeros(0x3002, dtype=bool)
        self.word[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True

    def cuts(self, text: str) -> np.ndarray:
        """Positions where a cut changes nothing: a forced pair, and no change to how the pattern reads either side.

        The pattern looks past white space and reads an apostrophe with what follows, so no cut is made after white
        space, nor before an apostrophe that doesn't follow an ASCII letter or digit.
        """
        cp = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
        a, b = cp[:-1], cp[1:]
        last = np.where(a < 0x80, a, 0x80 | (a & 0x3F))
        first = np.where(b < 0x80, b, np.where(b < 0x800, 0xC0 | (b >> 6), np.where(b < 0x10000, 0xE0 | (b >> 12), 0xF0 | (b >> 18))))
        low = np.minimum(a, 0x3001)
        ok = self.forced[last, first] & ~self.space[low] & ((b != 39) | self.word[low])
        return np.flatnonzero(ok) + 1

    def __call__(self, text: str | None) -> list[int]:
        """The ids of a text; [] where it is null or empty."""
        if not text:
            return []
        out: list[int] = []
        known, at = self.known, 0
        for end in [*self.cuts(text).tolist(), len(text)]:
            part = text[at:end]
            ids = known.get(part)
            if ids is None:
                ids = known[part] = self.plain(part)
            out += ids
            at = end
        if len(known) > REMEMBERED:
            known.clear()
        return out

    def blocks(self, text: str, size: int) -> Iterator[str]:
        """The text in blocks of at least ``size`` characters, cut where a cut changes nothing."""
        at, n = 0, len(text)
        while n - at > size:
            window, step = None, size
            while window is None and at + step < n:
                near = self.cuts(text[at + step - 1 : at + step + size])
                window = at + step - 1 + int(near[0]) if len(near) else None
                step += size
            if window is None:
                break
            yield text[at:window]
            at = window
        yield text[at:]


def encode_corpus(df: DataFrame, id_col: str, text: str, vocabulary: str = VOCABULARY, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """id_col and ids (array<int>): the ids of each text without special tokens; text that resembles one is plain text.

    Empty and null texts give an empty list. One row for each row of df, repeated ids too. Ordinary texts are encoded where they are read; only blocks of long ones are shuffled.
    """
    spark = df.sparkSession
    ranks = spark.sparkContext.broadcast(read_vocabulary(vocabulary))
    kind = dict(df.dtypes)[id_col]
    made: list[FragmentEncoder] = []

    def encoder() -> FragmentEncoder:
        if not made:
            made.append(FragmentEncoder(ranks.value))
        return made[0]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                lists = [encoder()(t) for t in part.column(part.num_columns - 1).to_pylist()]
                ids = pa.ListArray.from_arrays(np.cumsum([0, *map(len, lists)]).astype(np.int32), pa.array(np.fromiter((x for i in lists for x in i), dtype=np.int32, count=sum(map(len, lists)))))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], ids], names=[*part.schema.names[:-1], "ids"])

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row, key, t in zip(b.column(0), b.column(1), b.column(2).to_pylist()):
                for n, piece in enumerate(encoder().blocks(t, block_chars)):
                    yield pa.RecordBatch.from_arrays([pa.array([row.as_py()], pa.int64()), pa.array([key.as_py()], b.schema.field(1).type), pa.array([n], pa.int32()), pa.array([piece])], names=["row", "id", "block", "text"])

    rows = df.select(F.col(id_col).alias("id"), F.col(text).alias("text"))
    long = F.coalesce(F.length("text") > block_chars, F.lit(False))
    short = rows.where(~long).mapInArrow(encode, f"id {kind}, ids array<int>")
    # a row's number, so that rows of one id stay apart: fixed by where the row is read
    blocks = rows.where(long).select(F.monotonically_increasing_id().alias("row"), "id", "text").mapInArrow(split, f"row bigint, id {kind}, block int, text string").repartition("row", "block")
    parts = blocks.mapInArrow(encode, f"row bigint, id {kind}, block int, ids array<int>")
    whole = parts.groupBy("row").agg(F.first("id").alias("id"), F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("block", "ids"))), lambda x: x["ids"])).alias("ids")).drop("row")
    return short.unionByName(whole).withColumnRenamed("id", id_col)
