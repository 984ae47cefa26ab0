"""One form for texts that look the same.

Look-alike classes over strings and code points are found by union-find: fixed twins, the decompositions of the
Unicode tables, and the composed and decomposed spellings of accented letters. Each class is represented by its
most frequent member in the corpus, and texts are rewritten greedily by an automaton of all other members.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from quillspark.llm.lookalikes import INVISIBLE, LATIN_TWINS, MARK_TWINS, OTHER_TWINS, TWO_FACED
from quillspark.operators.skew import skew_join
from quillspark.shared import Scratch

# Decompositions that a reader sees as different.
SEEN = ("<super>", "<sub>", "<circle>", "<fraction>", "<square>")
_MARKS = "".join(chr(c) for c in range(0x300, 0x10000) if unicodedata.combining(chr(c)) and not 0x900 <= c < 0xE00 and c != 0x34F)
_CLUSTER = re.compile(f"[^{_MARKS}][{_MARKS}]+|[{_MARKS}]{{2,}}")
_MARK = re.compile(f"[{_MARKS}]")
_JAMO = re.compile("[ᄀ-ᇿ]{2,}")


class Classes:
    """Union-find over strings."""

    def __init__(self) -> None:
        self.up: dict[str, str] = {}

    def find(self, x: str) -> str:
        root = x
        while (above := self.up.setdefault(root, root)) != root:
            root = above
        while x != root:
            self.up[x], x = root, self.up[x]
        return root

    def join(self, a: str, b: str) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)

    def members(self) -> dict[str, list[str]]:
        out: dict[str, list[str]] = {}
        for x in list(self.up):
            out.setdefault(self.find(x), []).append(x)
        return out


def decomposed(ch: str) -> str:
    """The decomposition that looks the same, accents in canonical order of code points; ch itself where there is none."""
    tag, _, parts = unicodedata.decomposition(ch).rpartition(">")
    if not parts or 0xAC00 <= ord(ch) < 0xD7A4:
        return ch
    if tag + ">" * bool(tag) in SEEN:
        return ch
    out = "".join(decomposed(chr(int(x, 16))) for x in parts.split())
    if tag and out.strip() != out and len(out) > 1:  # a spacing accent: drawn apart from a letter
        return ch
    return _ordered(out)


def _ordered(s: str) -> str:
    """s with each run of combining marks sorted by class and code point."""
    return re.sub(f"[{_MARKS}]{{2,}}", lambda m: "".join(sorted(m.group(), key=lambda c: (unicodedata.combining(c), c))), s)


def spelling(cluster: str, letters: dict[int, str | None] | None = None) -> str:
    """An accented cluster in its fully decomposed spelling, accents in order; its characters rewritten by ``letters``."""
    letters = letters or {}
    return _ordered("".join(map(decomposed, cluster.translate(letters))).translate(letters))


def look_alike_classes(counts: dict[str, int], fold: bool = False) -> dict[str, str]:
    """Member -> representative, for all members that aren't their class's representative.

    ``counts``: how often each code point and each decomposed spelling of a composed letter occurs. Other strings
    (ligatures and the like) count as often as their rarest code point. The most frequent member represents its
    class; at equal counts the shortest, then the smallest. Blanks, hyphens and apostrophes are represented by the
    ASCII one. With ``fold``, the cases of a letter are one class too; the classes are then meant for texts after ``folded``.
    """
    if fold:
        lower: Counter[str] = Counter()
        for s, n in counts.items():
            low = folded(s)
            lower.update({x: n for x in ([low] if len(low) == len(s) else low)})
        counts = lower
    classes = Classes()
    for row in map(str.split, (LATIN_TWINS + OTHER_TWINS).splitlines()):
        for ch in row[1:]:
            if not (fold and ord(ch) in TWO_FACED):
                classes.join(row[0], ch)
    for row in MARK_TWINS:
        for ch in row[1:]:
            classes.join(row[0], ch)
    have = {c for s in counts for c in s}
    marks = [c for c in have if unicodedata.combining(c)]
    composed = {unicodedata.normalize("NFC", b + m) for b in have for m in marks if unicodedata.normalize("NFC", b + m) != b + m} if marks else set()
    composed |= {unicodedata.normalize("NFC", c + m) for c in composed if len(c) == 1 for m in marks}
    for ch in have | {c for c in composed if len(c) == 1}:
        apart = decomposed(ch)
        if apart != ch:
            classes.join(ch, apart)
    if fold:
        for s in list(classes.up):
            classes.join(s, folded(s))
    # a string whose parts have twins looks like the string of the twins: join it with the string of class roots
    for _ in range(2):
        for s in [x for x in classes.up if len(x) > 1]:
            classes.join(s, "".join(classes.find(c) if len(classes.find(c)) == 1 else c for c in s))

    def seen(s: str) -> int:
        if len(s) == 1 or any(map(unicodedata.combining, s)):
            return counts.get(s, 0)
        return min(counts.get(c, 0) for c in s)

    ascii_first = {row[0] for row in MARK_TWINS}
    best = [(group, next((x for x in group if x in ascii_first), None) or min(group, key=lambda x: (-seen(x), len(x), x))) for group in classes.members().values()]
    letters = {ord(x): to for group, to in best for x in group if len(x) == 1 and x != to}
    out = {}
    for group, to in best:
        # strings are met in texts whose single characters were rewritten before
        to = to if len(to) == 1 else spelling(to, letters)
        for x in group:
            x = x if len(x) == 1 else spelling(x, letters)
            if x != to:
                out[x] = to
    return out


_TWO_FACED = re.compile("[" + "".join(map(chr, TWO_FACED)) + "]")


def folded(text: str) -> str:
    """A text without case. Capitals whose small form looks like another letter go by their own look first."""
    return (text.translate(TWO_FACED) if _TWO_FACED.search(text) else text).casefold()


class Rewriter:
    """Rewrites texts to their form. Built from the classes of ``look_alike_classes``."""

    def __init__(self, to: dict[str, str]):
        import ahocorasick

        self.single = {ord(k): v for k, v in to.items() if len(k) == 1} | {ord(c): None for c in INVISIBLE} | {0x0D: "\n"}
        # what a single code point is rewritten to may itself be a member's part: follow to the end
        self.changes = re.compile("[" + "".join(re.escape(chr(c)) for c in self.single) + "]|  ")
        self.strings = ahocorasick.Automaton()
        for k, v in to.items():
            if len(k) > 1:
                self.strings.add_word(k, (len(k), v))
        self.any = len(self.strings) > 0
        # most strings hold accents; a text without an accent, nor one of the others, holds none
        loose = [k for k in to if len(k) > 1 and not _MARK.search(k)]
        self.loose = re.compile("|".join(map(re.escape, loose))) if loose else None
        if self.any:
            self.strings.make_automaton()
        self.cluster = lru_cache(65536)(lambda s: spelling(s, self.single))

    def __call__(self, text: str | None) -> str | None:
        """The form of a text: null stays null, a text that shows nothing gives the empty string."""
        if text is None:
            return None
        if "\r" in text:
            text = text.replace("\r\n", "\n")
        if self.changes.search(text):
            text = text.translate(self.single)
        if not text.isascii():
            accents = _MARK.search(text)
            if accents:
                text = _CLUSTER.sub(lambda m: self.cluster(m.group()), text)
            if _JAMO.search(text):
                text = _JAMO.sub(lambda m: unicodedata.normalize("NFC", m.group()), text)
            if self.any and (accents or self.loose and self.loose.search(text)):
                out, at = [], 0
                for end, (size, new) in self.strings.iter_long(text):
                    out += (text[at : end + 1 - size], new)
                    at = end + 1
                if at:
                    text = "".join(out) + text[at:]
        if "  " in text:
            text = re.sub("  +", " ", text)
        return "\n".join(x.strip() for x in text.strip().split("\n")) if "\n" in text else text.strip()


_IS_MARK = np.zeros(0x110000, dtype=bool)
_IS_MARK[list(map(ord, _MARKS))] = True


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(0x110000, dtype=np.int64)
    spelled: Counter[str] = Counter()
    for b in batches:
        text = "\n".join(x for x in b.column(0).to_pylist() if x)
        at = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        if len(at):
            found = np.bincount(at)
            total[: len(found)] += found
            if _IS_MARK[: len(found)][found > 0].any():
                spelled.update(map(spelling, _CLUSTER.findall(text)))
    # spellings of composed letters: as many as Unicode has, whatever the texts hold
    one = {s: n for s, n in spelled.items() if len(unicodedata.normalize("NFC", s)) == 1}
    (ids,) = np.nonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array([*map(chr, ids), *one]), pa.array([*total[ids].tolist(), *one.values()], pa.int64())], names=["s", "n"])


def symbol_counts(texts: DataFrame, col: str) -> DataFrame:
    """How often each code point, and each decomposed spelling of a composed letter, occurs in a column: s, n. One pass, counted per partition before the shuffle."""
    return texts.select(col).mapInArrow(_count_batches, "s string, n bigint").groupBy("s").agg(F.sum("n").alias("n"))


def corpus_classes(columns: Iterable[tuple[DataFrame, str]], fold: bool = False) -> dict[str, str]:
    """Look-alike classes by the counts of whole columns. What reaches the driver is at most one row per Unicode code point and composed letter."""
    parts = [symbol_counts(df, c) for df, c in columns]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return look_alike_classes({r.s: r.n for r in every.groupBy("s").agg(F.sum("n").alias("n")).collect()}, fold)


def form_udf(classes: dict[str, str]):
    """A column function that rewrites texts to their form."""
    made: list[Rewriter] = []

    def rewrite(s: pd.Series) -> pd.Series:
        if not made:
            made.append(Rewriter(classes))
        return s.map(made[0], na_action="ignore")

    return F.pandas_udf(rewrite, StringType())


def _formed(df: DataFrame, group: str, id_col: str, text: str, classes: dict[str, str], scratch: Scratch) -> DataFrame:
    """Distinct group, id, raw (digest of the text), form (digest of its form) of the texts that show something, written once."""
    form = form_udf(classes)
    keyed = df.where(F.col(text).isNotNull()).select(F.col(group).alias("group"), F.col(id_col).alias("id"), F.unhex(F.md5(text)).alias("raw"), form(text).alias("form"))
    keyed = keyed.where(F.col("form") != "").select("group", "id", "raw", F.unhex(F.md5("form")).alias("form")).distinct()
    return scratch.save(keyed, "forms")


def looks_same_pairs(df: DataFrame, group: str, id_col: str, text: str, classes: dict[str, str]) -> DataFrame:
    """Pairs id_a < id_b of one ``group`` whose texts have one form but aren't identical: group, id_a, id_b.

    Repeated rows count once. Null texts and texts that show nothing form no pairs, nor do rows of a null group. Texts
    are replaced by 128-bit digests of text and form before any shuffle; forms with only one text are left out before
    pairing; ids of a form held by many rows are spread by a salt, so that its pairs, which the result has to hold, are
    made by many tasks. ``looks_same_classes`` gives the same links in one row per text.
    """
    scratch = Scratch(df.sparkSession)
    keyed = _formed(df, group, id_col, text, classes, scratch)
    several = keyed.groupBy("group", "form").agg(F.min("raw").alias("lo"), F.max("raw").alias("hi")).where("lo != hi").select("group", "form")
    members = scratch.save(skew_join(keyed, several, ["group", "form"], "left_semi", spread=["id"]), "members")
    scratch.drop(keyed)
    a = members.withColumnRenamed("id", "id_a").withColumnRenamed("raw", "raw_a")
    b = members.withColumnRenamed("id", "id_b").withColumnRenamed("raw", "raw_b")
    apart = (F.col("id_a") < F.col("id_b")) & (F.col("raw_a") != F.col("raw_b"))
    found = skew_join(a, b, ["group", "form"], "inner", spread=["id_a"], residual=apart, hot_rows=2_000)
    return found.select(F.col("group").alias(group), "id_a", "id_b").distinct()


def looks_same_classes(df: DataFrame, group: str, id_col: str, text: str, classes: dict[str, str]) -> DataFrame:
    """Membership of each text in its class of equal looks: group, id, class_id, members, spellings.

    class_id is the smallest id of the class, members the number of its ids, spellings that of its distinct texts. All
    links of ``looks_same_pairs`` are between members of one class whose texts differ. Texts that show nothing have no
    class, nor have rows of a null group; repeated rows count once; an id with several texts has a row for each form.
    """
    scratch = Scratch(df.sparkSession)
    keyed = _formed(df, group, id_col, text, classes, scratch)
    # one row per spelling first, so that what is counted distinct is small
    per = keyed.groupBy("group", "form", "raw").agg(F.min("id").alias("lo"), F.count(F.lit(1)).alias("n")).groupBy("group", "form").agg(F.min("lo").alias("class_id"), F.sum("n").alias("members"), F.count(F.lit(1)).alias("spellings"))
    out = skew_join(keyed, per, ["group", "form"], "inner", spread=["id"])
    return out.select(F.col("group").alias(group), "id", "class_id", "members", "spellings").distinct()
