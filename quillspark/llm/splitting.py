"""Oversized texts cut into pieces at natural boundaries, by pointer doubling over the boundaries of whole batches.

Every boundary is joined to its farthest legal successor, the last boundary that a piece starting there can reach
(overlap included). Squaring the table of successors, as often as the longest chain of cuts asks for, marks all cuts
of all texts of a batch at once, without walking any text from its start.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.lookalikes import INVISIBLE
from quillspark.llm.sentences import sentence_ends
from quillspark.operators.ordering import running_total
from quillspark.shared import Scratch

LIMIT, OVERLAP = 1_000, 150
LEVELS = ["paragraph", "line", "sentence", "word", "none"]
_B = rf"[^\S\r\n{INVISIBLE}]|[{INVISIBLE}]"
_GAPS = {
    "paragraph": re.compile(rf"(?:{_B})*(?:\r\n|\r|\n)(?:(?:{_B})*(?:\r\n|\r|\n))+(?:{_B})*"),
    "line": re.compile(r"[^\S\r\n]*(?:\r\n|\r|\n)\s*"),
    "word": re.compile(r"\s+"),
}


def units(text: str, level: str, most: int = 1) -> list[tuple[int, int]]:
    """Start and end of the units of a text at a level, without the blanks between them.

    At level ``none`` the units are words, and what is longer than ``most`` in parts of at most ``most`` characters.
    """
    n = len(text)
    if level == "sentence":
        ends = sentence_ends(text)
        starts = [0, *ends[:-1]]
    elif level == "none":
        return [(i, min(i + most, e)) for s, e in units(text, "word") for i in range(s, e, most)]
    else:
        gaps = [(m.start(), m.end()) for m in _GAPS[level].finditer(text)]
        starts, ends = [0, *[e for _, e in gaps]], [*[s for s, _ in gaps], n]
    out = []
    for s, e in zip(starts, ends):
        while s < e and text[s].isspace():
            s += 1
        while e > s and text[e - 1].isspace():
            e -= 1
        if e > s:
            out.append((s, e))
    return out


class Boundaries:
    """The units of many texts in one row of numbers: texts lie far apart, so that no piece reaches from one into another."""

    def __init__(self, texts: list[list[tuple[int, int]]], limit: int):
        self.limit = limit
        self.sizes = np.array([len(t) for t in texts], dtype=np.int64)
        self.first = np.concatenate([[0], np.cumsum(self.sizes)])
        base = np.concatenate([[0], np.cumsum([(t[-1][1] if t else 0) + 4 * limit for t in texts])])[: len(texts)]
        flat = np.array([x for t in texts for x in t], dtype=np.int64).reshape(-1, 2)
        at = np.repeat(base, self.sizes)
        self.start, self.end = flat[:, 0] + at, flat[:, 1] + at
        self.last = np.repeat(self.first[1:], self.sizes)  # the first unit behind a unit's text

    def successors(self, room: np.ndarray | int) -> np.ndarray:
        """For each unit the unit that the next piece starts with, when its own piece has ``room`` characters; itself where it doesn't fit."""
        return np.maximum(np.minimum(np.searchsorted(self.end, self.start + room, side="right"), self.last), np.arange(len(self.start)))

    def cuts(self, successor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Marks of the units that pieces start with, and per text whether every piece fits."""
        n = len(successor)
        # the end of a text leads to itself, not into the next text; so does a unit that doesn't fit
        jump = np.append(np.where(successor == self.last, n, successor), n)
        marked = np.zeros(n + 1, dtype=bool)
        marked[self.first[:-1][self.sizes > 0]] = True
        done = False
        while not done:
            marked[jump[np.flatnonzero(marked)]] = True
            twice = jump[jump]
            done, jump = bool((twice == jump).all()), twice
        stuck = marked[:n] & (successor == np.arange(n))
        text = np.repeat(np.arange(len(self.sizes)), self.sizes)
        return marked[:n], np.bincount(text[stuck], minlength=len(self.sizes)) == 0


def coarsest(texts: list[str], limit: int = LIMIT) -> tuple[list[str], dict[int, list[tuple[int, int]]]]:
    """Per text the coarsest level at which cutting alone leaves every piece within the limit; the units there (none for ``none``)."""
    found, kept, open_ = ["none"] * len(texts), {}, list(range(len(texts)))
    for level in LEVELS[:-1]:
        if not open_:
            break
        at = [units(texts[i], level) for i in open_]
        b = Boundaries(at, limit)
        _, fits = b.cuts(b.successors(limit))
        for i, u, ok in zip(open_, at, fits):
            if ok:
                found[i], kept[i] = level, u
        open_ = [i for i, ok in zip(open_, fits) if not ok]
    return found, kept


def pieces(texts: list[str], limit: int = LIMIT, overlap: int = OVERLAP) -> list[list[tuple[int, int, int]]]:
    """Per text its pieces as (start, fresh, end): from start to fresh is the end of the piece before, at most ``overlap``.

    A piece takes as many units as leave room for a whole overlap; a unit larger than that takes a shorter overlap.
    Overlaps start at a word where they can. A word longer than a piece is cut at equal steps, the largest that divide the
    limit and the room beside an overlap. Texts within the limit are one piece; texts that show nothing are too.
    """
    levels, at = coarsest(texts, limit)
    out: list[list[tuple[int, int, int]]] = [[(0, 0, len(t))] for t in texts]
    big = [i for i, t in enumerate(texts) if len(t) > limit]
    all_units = [at.get(i) if i in at else units(texts[i], "none", math.gcd(limit, limit - overlap)) for i in big]
    b = Boundaries([u or [(0, len(texts[i]))] for i, u in zip(big, all_units)], limit)
    with_room, without = b.successors(limit - overlap), b.successors(limit)
    successor = np.where(with_room > np.arange(len(with_room)), with_room, without)
    firsts = b.first[:-1]
    successor[firsts] = without[firsts]  # the first piece has nothing before it
    marked, _ = b.cuts(successor)
    for k, i in enumerate(big):
        own = all_units[k]
        if not own:
            continue
        text = texts[i]
        heads = [h - b.first[k] for h in np.flatnonzero(marked[b.first[k] : b.first[k + 1]]) + b.first[k]]
        result = []
        for j, h in enumerate(heads):
            fresh = own[h][0]
            end = own[(heads[j + 1] if j + 1 < len(heads) else len(own)) - 1][1]
            start = fresh
            if j:
                start = max(end - limit, fresh - overlap, result[-1][0])
                space = re.search(r"\s", text[start:fresh])
                if start > 0 and not text[start - 1].isspace() and space and start + space.end() < fresh:
                    start += space.end()
                start = min(start, fresh)
            result.append((int(start), int(fresh), int(end)))
        out[i] = result
    return out


def coarsest_boundaries(df: DataFrame, id_col: str, text: str, limit: int = LIMIT) -> DataFrame:
    """id_col and boundary for each text over ``limit`` characters; repeated ids count once, rows without id are left out. Nothing is shuffled but ids and levels."""
    kind = dict(df.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(coarsest(part.column(1).to_pylist(), limit)[0])], names=["id", "boundary"])

    long = df.where((F.length(text) > limit) & F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text).alias("text"))
    return long.mapInArrow(run, f"id {kind}, boundary string").dropDuplicates(["id"]).withColumnRenamed("id", id_col)


def split_oversized(df: DataFrame, id_col: str, group: str, order: str, text: str, keep: list[str], limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """All texts as pieces of at most ``limit`` characters: id_col, group, piece_index, overlap, text and the ``keep`` columns.

    piece_index counts from 0 through the pieces of a group, by ``order``, then id, then place in the text. Rows with
    one id count once, rows without id are left out. Null and empty texts have no piece. Rows of a null group are numbered as one group. Only the
    keys and cut positions are ordered; texts are joined to them by id.
    """
    scratch = Scratch(df.sparkSession)
    rows = df.select(id_col, group, order, *keep, F.col(text).alias("text")).where((F.length("text") > 0) & F.col(id_col).isNotNull()).dropDuplicates([id_col])
    rows = scratch.save(rows, "rows")  # read twice: to be cut, and to be joined with the cuts
    kind = {c: t for c, t in df.dtypes}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                cuts = [[{"start": s, "fresh": f, "end": e} for s, f, e in p] for p in pieces(part.column(3).to_pylist(), limit, overlap)]
                t = pa.list_(pa.struct([("start", pa.int32()), ("fresh", pa.int32()), ("end", pa.int32())]))
                yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(cuts, t)], names=["id", "g", "o", "cuts"])

    cut = rows.select(F.col(id_col).alias("id"), F.col(group).alias("g"), F.col(order).alias("o"), "text")
    cut = cut.mapInArrow(run, f"id {kind[id_col]}, g {kind[group]}, o {kind[order]}, cuts array<struct<start:int,fresh:int,end:int>>")
    based = running_total(cut.withColumn("n", F.size("cuts")), ["g"], ["o", "id"], "n", "base", scratch)
    whole = rows.join(based.select(F.col("id").alias(id_col), "cuts", "base"), id_col)
    each = whole.select(id_col, group, *keep, "text", "base", F.posexplode("cuts").alias("p", "c"))
    return each.select(id_col, group, *keep, (F.col("base") + F.col("p")).cast("int").alias("piece_index"), (F.col("c.fresh") - F.col("c.start")).alias("overlap"), F.expr("substring(text, c.start + 1, c.end - c.start)").alias("piece"))
