"""Evaluation texts in training text, by Wu-Manber search for all their passages at once.

Every run of ``words`` words of a test item is a pattern (every run of ``chars`` characters where the item is
written in Han or kana), so all patterns have one length. A table of blocks of two symbols tells how far the
search may skip; where it may not, the patterns ending in that block are compared directly.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.forms import _MARKS, Rewriter, corpus_classes, folded

#: Words, or characters in Chinese and Japanese, that a passage must share.
WORDS, CHARS = 10, 20
#: Items searched for in one pass over the corpus, about; more items take more passes.
ITEMS_A_PASS = 20_000

_TAG = re.compile(r"</?[A-Za-z][^<>\n]{0,200}>|&(?:[a-zA-Z]{2,8}|#\d{1,6});")
#: Tags of any length, over line breaks too; what stands between two comparison signs can look like one.
_LONG_TAG = re.compile(r"</?[A-Za-z][^<>]*>")
_WORD = re.compile(f"[^\\W_](?:[^\\W_]|[{_MARKS}])*")
_WIDE = re.compile("[぀-ヿ㐀-鿿豈-﫿]")


class WuManber:
    """Search for many patterns of one length in sequences of symbols."""

    def __init__(self, patterns: dict[tuple, set[int]], length: int):
        self.length = length
        self.skip: dict[tuple, int] = {}
        self.ending: dict[tuple, dict[tuple, set[int]]] = {}
        for p, items in patterns.items():
            for at in range(1, length):
                block = p[at - 1 : at + 1]
                self.skip[block] = min(self.skip.get(block, length), length - 1 - at)
            self.ending.setdefault(p[-2:], {})[p] = items

    def find(self, seq: Sequence) -> set[int]:
        """Items with a pattern somewhere in ``seq``, a tuple or a string."""
        out: set[int] = set()
        n, m, skip = len(seq), self.length, self.skip
        at = m - 1
        while at < n:
            step = skip.get(seq[at - 1 : at + 1], m - 1)
            if step:
                at += step
                continue
            hit = self.ending[seq[at - 1 : at + 1]].get(seq[at + 1 - m : at + 1])
            if hit:
                out |= hit
            at += 1
        return out


class Matcher:
    """Finds test items in texts; built from (item, texts) pairs and look-alike classes made with ``fold``."""

    def __init__(self, items: list[tuple[int, list[str]]], classes: dict[str, str], words: int = WORDS, chars: int = CHARS):
        self.form = Rewriter(classes)
        by_words: dict[tuple, set[int]] = {}
        by_chars: dict[str, set[int]] = {}
        self.vocabulary: dict[str, int] = {}
        for item, texts in items:
            for found in [f for text in texts for f in self.readings(text)]:
                joined = "".join(found)
                if len(_WIDE.findall(joined)) * 2 > len(joined):
                    for i in range(len(joined) - chars + 1):
                        by_chars.setdefault(joined[i : i + chars], set()).add(item)
                else:
                    seq = tuple(self.vocabulary.setdefault(w, len(self.vocabulary)) for w in found)
                    for i in range(len(seq) - words + 1):
                        by_words.setdefault(seq[i : i + words], set()).add(item)
        self.by_words, self.by_chars = WuManber(by_words, words), WuManber(by_chars, chars)

    def readings(self, text: str) -> list[list[str]]:
        """The words of a text regardless of case, punctuation, markup, line breaks and look-alikes; once more without long tags if it may have some."""
        text = self.form(folded(text))
        if "<" in text or "&" in text:
            text = _TAG.sub(" ", text)
        texts = [text]
        if "<" in text and (bare := _LONG_TAG.sub(" ", text)) != text:
            texts.append(bare)
        return [_WORD.findall(t) for t in texts]

    def __call__(self, text: str | None) -> set[int]:
        out: set[int] = set()
        get = self.vocabulary.get
        wide = bool(text and self.by_chars.skip and _WIDE.search(text))
        for found in self.readings(text) if text else []:
            if self.by_words.skip:
                out |= self.by_words.find(tuple([get(w, -1) for w in found]))
            if wide:
                out |= self.by_chars.find("".join(found))
        return out


def leaks(corpus: DataFrame, id_col: str, text: str, items: DataFrame, item_id: str, fields: list[str], words: int = WORDS, chars: int = CHARS) -> DataFrame:
    """Distinct (id_col, item_id): texts that share a passage with one of an item's fields.

    Null texts and fields share nothing; repeated rows count once. The corpus isn't shuffled: the patterns of about
    ITEMS_A_PASS items go to every task, and larger test sets take several passes.
    """
    test = items.select(F.col(item_id).alias("item"), *fields).where("item is not null").distinct()
    passes = max(1, -(-test.count() // ITEMS_A_PASS))
    classes = corpus_classes([(corpus, text), *[(items, f) for f in fields]], fold=True)
    kind, out = dict(corpus.dtypes)[id_col], None
    for at in range(passes):
        # one pass's items at a time are on the driver
        some = [(r[0], [x for x in r[1:] if x]) for r in test.where(F.pmod(F.xxhash64("item"), F.lit(passes)) == at).collect()]
        made: list[Matcher] = []

        def run(batches: Iterator[pa.RecordBatch], some=some, made=made) -> Iterator[pa.RecordBatch]:
            if not made:
                made.append(Matcher(some, classes, words, chars))
            for b in batches:
                ids, hits = [], []
                for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    for x in sorted(made[0](t)):
                        ids.append(i)
                        hits.append(x)
                yield pa.RecordBatch.from_arrays([pa.array(ids, b.schema.field(0).type), pa.array(hits, pa.int64())], names=["id", "item"])

        one = corpus.select(id_col, text).mapInArrow(run, f"id {kind}, item bigint")
        out = one if out is None else out.unionByName(one)
    return out.distinct().toDF(id_col, item_id)
