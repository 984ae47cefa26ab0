"""Sentence boundaries across languages and scripts, by semi-Markov dynamic programming over whole spans.

A text is cut into blocks at blank lines. Headings, list items, table rows and formulas on a line of their own
are units as they are; the other lines of a block form a paragraph. In a paragraph every run of closing marks is
a candidate, and the best chain of spans between candidates is chosen. The score of a span joins its length, how
it opens, how it closes, and whether the quotations and brackets within it are balanced. Spans may be of any length;
far starts are compared by their best alone, so that a paragraph takes time in proportion to its length.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from quillspark.llm.lookalikes import INVISIBLE, LATIN

# Abbreviations after which a sentence goes on, in lower case without the last point.
GOES_ON = set(
    """dr prof mr mrs ms messrs st jr sr hon rev gen col lt sgt capt mme mlle mm me pr ts ths th.s pgs pgs.ts gs gs.ts bs cn ks nxb tp tr q p
    pp fig figs sec eq ch chap art vol vols no nos nr abs abb kap tab bd hrsg vgl cf i.e e.g viz vs approx ca al bldg dept univ
    z.b d.h u.a bzw evtl ggf inkl exkl sog str dipl ing bsp
    стр рис табл гл см напр т.е им ул проф доц акад тыс гос ок
    ziff abt डॉ प्रो श्री सु पं tt tx""".replace("\n", " ").split(" ")
) | {"z. b", "d. h", "т. е"}
# Those of them that go on only before a number.
BEFORE_NUMBER = set("no nos p pp fig figs s sec art tab eq tr q ch chap abs al ref vol vols kap bd nr nos стр рис табл".split())
# Abbreviations that may also end a sentence.
MAY_END = {"v.v", "etc", "usw", "u.s.w", "т. д", "т.д", "т. п", "т.п", "др", "пр", "a.m", "p.m", "u.s", "u.k", "u.n", "inc", "ltd", "co", "corp", "jan", "feb", "aug", "sept", "oct", "nov", "dec", "г", "гг", "в", "đ", "vnđ"}
# Titles that open an attribution after a quotation.
TITLES = {"ths", "ts", "pgs", "pgs.ts", "gs", "gs.ts", "bs", "ks", "cn", "dr", "prof", "mr", "mrs", "ms"}
# German months, after which an ordinal's point is no end.
MONTHS = {"januar", "februar", "märz", "april", "mai", "juni", "juli", "august", "september", "oktober", "november", "dezember"}

#: Characters before a point that are looked at: some words, each as long as the longest abbreviation.
_LOOK_BACK = 3 * max(map(len, GOES_ON | MAY_END | TITLES))
#: Length from which a span's length costs no more than it does already.
_FAR = 1_800

_I = f"[{INVISIBLE}]"
_CLOSERS = "\"”’»«“」』】〉》）)］\\]}｣"
_LINE = re.compile(r"([^\r\n]*)(\r\n|\r|\n|\Z)")
_SHOWS = re.compile(rf"[^\s{INVISIBLE}]")
_BULLET = re.compile(rf"[\s{INVISIBLE}]*(?:[-–—*•·▪◦‣+]|\([0-9a-zđ]{{1,3}}\)|[a-zđ]\))[\s{INVISIBLE}]+\S")
_NUMBER = re.compile(rf"[\s{INVISIBLE}]*(?:\d{{1,3}}|[ivxIVX]{{1,5}})(?:\.\d{{1,3}})*[.)．）、][\s{INVISIBLE}]*(?=\S)(?!\d)")
_FIRST = re.compile(rf"[\s{INVISIBLE}]*(?:1|[iIa])[.)]")
_NAMED = re.compile(rf"[\s{INVISIBLE}]*(?:(?:điều|chương|mục|phần|bài|bước|section|chapter|part|article|step|kapitel|abschnitt|teil|chapitre|partie|глава|раздел|статья|बाब|अध्याय|บทที่|ข้อ)\s+[\dIVX]+|第\s*[\d一二三四五六七八九十]+\s*[章节条節条])", re.I)
_ROW = re.compile(r"[^\S\r\n]\|[^\S\r\n]|^\s*\|.*\|\s*$")
_MATH = re.compile(r"[=≤≥≈∑√∏∫∇±×÷<>^]")
_WORD = re.compile(r"[^\W\d_]{3,}")
_MARK = re.compile(r"[.!?…‽。！？｡．।॥؟۔]+")
_PAIRS = re.compile(r"[\"“”„«»「」『』【】（）()\[\]［］｢｣]")
_OPENS = {"“": "”", "„": "“”", "«": "»", "「": "」", "『": "』", "【": "】", "（": "）)", "(": ")）", "[": "]", "［": "］", "｢": "｣", "»": "«"}
_BRACKETS = "（()）[]［］【】"
_SIGN = re.compile(r"[^\S\r\n]?[\u2600-\u27bf\U0001f300-\U0001faff]\ufe0f?[.!?。！？]+")
_THAI = re.compile(rf"(?<=[ก-๎]){_I}*[^\S]+(?:{_I}|\s)*(?=[ก-๎])")
_TOKEN = re.compile(r"(?:[^\W\d_]+\. ?){0,2}[^\W\d_\u0900-\u097f]+\Z|[\u0900-\u097f]+\Z")
_ENDED = re.compile(rf"[.!?…。！？।；;:：][{re.escape(_CLOSERS)}]*\Z")
_JOINED = re.compile(r"(?:[^\W\d_A-Z]{2}|\d)[.!?]+\Z")
_WIDE = re.compile("[぀-ヿ㐀-鿿豈-﫿ｦ-ﾟ]")


def _pairs(text: str) -> tuple[dict[int, int], list[int]]:
    """Close position -> open position of matched quotes and brackets; the matched opening positions in order."""
    stack: list[tuple[str, int]] = []
    waiting: dict[str, int] = {}  # open marks on the stack, by the closing mark they wait for
    matched: dict[int, int] = {}

    def push(ch: str, at: int) -> None:
        stack.append((ch, at))
        for x in _OPENS.get(ch, ch):
            waiting[x] = waiting.get(x, 0) + 1

    def pop_from(k: int) -> None:
        for ch, _ in stack[k:]:
            for x in _OPENS.get(ch, ch):
                waiting[x] -= 1
        del stack[k:]

    for m in _PAIRS.finditer(text):
        ch, at = m.group(), m.start()
        if waiting.get(ch):
            hit = next(k for k in range(len(stack) - 1, -1, -1) if ch in _OPENS.get(stack[k][0], stack[k][0]))
            matched[at] = stack[hit][1]
            pop_from(hit)
        elif ch == '"' or ch in _OPENS:
            push(ch, at)
    return matched, sorted(matched.values())


def _capital(text: str, at: int) -> bool:
    """Whether a capitalised word, perhaps quoted, starts at ``at``: then a blank was left out before it."""
    at += text[at] in "\"“„«("
    return text[at : at + 1].isupper() and (text[at + 1 : at + 2].isalpha() or text[at + 1 : at + 2].isspace())


def _opening(text: str, at: int) -> tuple[float, str, int]:
    """Score of a span that starts at ``at``; the first character it shows beside quotes and brackets; where that is."""
    n = len(text)
    while at < n and (text[at].isspace() or text[at] in INVISIBLE):
        at += 1
    first = at
    while at < n and (text[at] in "\"“„«「『【（([［｢'‘*_#" or text[at].isspace() or text[at] in INVISIBLE):
        at += 1
    if at >= n:
        return 0.0, "", first
    ch = text[at]
    if ch.islower():
        return -6.0, ch, first
    if ch in ",;:—–、，；：)]）":
        return -6.0, ch, first
    if ch.isupper() or ch.istitle():
        return 1.0, ch, first
    if ch.isdigit():
        return 0.25, ch, first
    return (1.0 if unicodedata.category(ch)[0] == "L" else 0.0), ch, first


def _closing(text: str, mark: re.Match, closers: list[int], nxt: str, nxt_at: int) -> float:
    """Score of closing a span with ``mark``, with the closing quotes and brackets at ``closers``, before the character ``nxt``."""
    run = mark.group()
    quoted = any(text[c] not in _BRACKETS for c in closers)
    if set(run) == {"."} and len(run) == 1:
        before = text[max(0, mark.start() - _LOOK_BACK) : mark.start()].replace(" ", " ").translate(_NOTHING)
        score = 1.5
        word = _TOKEN.search(before)
        if word and not closers:
            w = word.group()
            low = w.lower()
            forms = {f for x in (low, w.translate(LATIN).lower()) for f in (x, x.rsplit(" ", 1)[-1], x.split(" ", 1)[-1])}
            glued = re.search(r"[^\W\d_]{3,}\.([^\W\d_]+)\Z", low)
            forms |= {glued.group(1)} if glued else set()
            if forms & MAY_END:
                score = 0.25
            elif forms & GOES_ON - BEFORE_NUMBER or forms & BEFORE_NUMBER and nxt.isdigit():
                score = -6.0
            elif re.search(r"(?:\A|[ .])[^\W\d_]\Z", low) and (w[-1].isupper() or re.match(r"[^\W\d_]\.", text[nxt_at : nxt_at + 2])):
                score = -4.0
        elif before[-1:].isdigit() and not closers:
            follows = re.match(r"[^\W\d_]+", text[nxt_at : nxt_at + 12])
            if follows and follows.group().lower() in MONTHS:
                score = -6.0
    elif set(run) <= {".", "…", "．"} and "．" not in run:
        score = 0.5
    else:
        score = 2.0
    if quoted:
        if nxt and nxt in "とっ、，,—–-":
            score -= 8.0
        elif not set(run) <= {".", "…"}:
            if not _WIDE.match(nxt or " "):
                title = re.match(r"[^\W\d_]+(?:\.[^\W\d_]+)?(?=\.)", text[nxt_at : nxt_at + 16])
                if title and title.group().lower() in TITLES:
                    score -= 8.0
    return score


_NOTHING = {ord(c): None for c in INVISIBLE}


class _Far:
    """The best starts of spans that lie far back, for each number of open pairs around them.

    All that tells such starts apart for a later end is the score of their chain, the pairs around them and on which
    side of the end's own openers they lie; so for each stretch between openers the best start of each depth suffices.
    """

    def __init__(self) -> None:
        #: depth -> starts and scores of: records from the left, records from the right, all
        self.by: dict[int, tuple[list[int], list[float], list[int], list[float], list[int], list[float]]] = {}

    def add(self, i: int, depth: int, score: float) -> None:
        left, left_s, right, right_s, every, every_s = self.by.setdefault(depth, ([], [], [], [], [], []))
        if not left or score >= left_s[-1]:
            left.append(i)
            left_s.append(score)
        while right and right_s[-1] <= score:
            right.pop()
            right_s.pop()
        for xs, x in ((right, i), (right_s, score), (every, i), (every_s, score)):
            xs.append(x)

    def best(self, a: int, b: int, first: int, end: int) -> list[int]:
        """The best start in [a, b) for each depth, where all starts lie in [first, end); of equal ones the last."""
        out = []
        for left, _, right, _, every, every_s in self.by.values():
            if b == end:
                out += right[bisect_left(right, a) :][:1]
            elif a == first:
                out += left[: bisect_left(left, b)][-1:]
            else:  # between two openers of pairs that close together
                lo, hi = bisect_left(every, a), bisect_left(every, b)
                if lo < hi:
                    out.append(max(zip(every_s[lo:hi], every[lo:hi]))[1])
        return out


def _paragraph(text: str) -> list[int]:
    """Ends of the sentences of a paragraph, as offsets in it."""
    n = len(text)
    matched, opens = _pairs(text)
    closes = sorted(matched)
    # candidates: (end, score of closing, score of opening after it, matched openers of its closers, start of what follows)
    cands: list[tuple[int, float, float, list[int], int]] = []
    for m in _MARK.finditer(text):
        end, closers = m.end(), []
        while end < n:
            step = end
            while step < n and text[step] in INVISIBLE:
                step += 1
            if step + 1 < n and text[step].isspace() and text[step + 1] in "»" and step + 1 in matched:
                step += 1
            if step < n and step in matched:
                closers.append(step)
                end = step + 1
            elif step < n and closers and text[step] in ".!?。！？":
                end = step + 1
            elif (more := _SIGN.match(text, end)) is not None:  # a picture between marks of one end
                end = more.end()
            elif step < n and text[step] in "’'" and not (step + 1 < n and text[step + 1].isalnum()):
                end = step + 1
            else:
                break
        wide = m.group()[-1] in "。！？｡।॥"
        after = end
        while after < n and text[after] in INVISIBLE:
            after += 1
        if after < n and not text[after].isspace() and not wide and not (_JOINED.search(text, max(0, m.start() - 2), m.end()) and _capital(text, after)):
            continue
        score, ch, at = _opening(text, end)
        if at >= n:
            continue
        cands.append((end, _closing(text, m, closers, ch if text[at : at + 1] == ch else text[at : at + 1], at), score, [matched[c] for c in closers], at))
    if "ก" <= max(text, default="") and _THAI.search(text):
        for m in _THAI.finditer(text):
            cands.append((m.start(), 4.0, 1.0, [], _opening(text, m.start())[2]))
        cands.sort(key=lambda c: c[0])
    if not cands:
        return [n]
    ends = [c[0] for c in cands] + [n]
    # open pairs around each end, by the pairs whose two sides lie on both sides of it
    depth = [bisect_left(opens, e) - bisect_left(closes, e) for e in ends[:-1]] + [0]
    starts = [0] + [c[4] for c in cands]
    best, back = [0.0] + [float("-inf")] * len(ends), [0] * (len(ends) + 1)

    def span(i: int, j: int, close: float, owners: list[int], around: int) -> float:
        """Score of the best chain whose last span is the one from start i to end j."""
        e, s = ends[j], starts[i]
        score = close - 8.0 * abs(around - (depth[i - 1] if i else 0)) - 8.0 * (around > 0)
        for o in owners:
            if o > s + 2 and text[o] in _BRACKETS:
                score -= 5.0
            elif _WIDE.match(text, e):  # after a quotation in such scripts an attribution may follow at once
                score -= 0.5 if text[max(0, o - 1)] in "：:" else 6.0
            elif o > s + 2:
                score -= 0.5
        length = e - s
        if length < 3:
            score -= 1.5
        elif length > 300:
            score -= min(3.0, 0.002 * (length - 300))
        return best[i] + score

    far, first, near = _Far(), 0, 0  # starts before ``first`` are never better; those from first to near are far back
    for j, e in enumerate(ends):
        last = j == len(cands)
        close = 0.0 if last else cands[j][1] + cands[j][2]
        owners = [] if last else cands[j][3]
        around = 0 if last else depth[j]
        # an interior end that is certain and outside all pairs is always better cut than kept
        if j and depth[j - 1] == 0 and cands[j - 1][1] + cands[j - 1][2] > 2.4 and not cands[j - 1][3]:
            far, first, near = _Far(), j, j
        while near <= j and starts[near] <= e - _FAR:
            far.add(near, depth[near - 1] if near else 0, best[near])
            near += 1
        tried = list(range(j, near - 1, -1))
        if near > first:
            edges = [first, *sorted({min(max(bisect_left(starts, o - 2), first), near) for o in owners}), near]
            tried += sorted({i for a, b in zip(edges, edges[1:]) for i in far.best(a, b, first, near)}, reverse=True)
        for i in tried:
            score = span(i, j, close, owners, around)
            if score > best[j + 1]:
                best[j + 1], back[j + 1] = score, i
    out, j = [], len(ends)
    while j:
        out.append(ends[j - 1])
        j = back[j]
    return out[::-1]


def _is_formula(line: str) -> bool:
    line = line.strip()
    if line.startswith("$") and line.endswith("$") and len(line) > 1:
        return True
    return bool(_MATH.search(line)) and len(_WORD.findall(line)) <= 1 and not _ENDED.search(line)


def sentence_ends(text: str | None) -> list[int]:
    """End positions of the sentences of a text, in characters; [] where it is null or shows nothing."""
    if not text or not _SHOWS.search(text):
        return []
    ends: list[int] = []
    lines = [(m.start(1), m.end(1)) for m in _LINE.finditer(text) if m.end() > m.start() or m.start() == 0]
    block: list[tuple[int, int]] = []

    def paragraph(a: int, b: int) -> None:
        for e in _paragraph(text[a:b]):
            end = a + e
            while end > a and text[end - 1].isspace():
                end -= 1
            if end > a and (not ends or end > ends[-1]) and _SHOWS.search(text, ends[-1] if ends else 0, end):
                ends.append(end)

    def whole(a: int, b: int) -> None:
        while b > a and text[b - 1].isspace():
            b -= 1
        if b > a and _SHOWS.search(text, a, b):
            ends.append(b)

    def flush() -> None:
        open_at, listing = None, True
        for k, (a, b) in enumerate(block):
            line = text[a:b]
            unit = bool(_ROW.search(line)) or _is_formula(line) or bool(_BULLET.match(line) and (listing or line.lstrip()[:1] in "•▪◦‣"))
            if not unit and _NUMBER.match(line):
                unit = listing or bool(_FIRST.match(line) and open_at is not None and _ENDED.search(text[open_at : block[k - 1][1]]) and k + 1 < len(block) and _NUMBER.match(text[block[k + 1][0] : block[k + 1][1]]))
            if not unit and len(block) == 1 and _NAMED.match(line) and len(line) <= 120 and not _ENDED.search(line.rstrip()):
                unit = True
            if unit:
                if open_at is not None:
                    paragraph(open_at, block[k - 1][1])
                    open_at = None
                whole(a, b)
                listing = True
            else:
                if open_at is None:
                    open_at = a
                listing = False
        if open_at is not None:
            paragraph(open_at, block[-1][1])
        block.clear()

    for a, b in lines:
        if _SHOWS.search(text, a, b):
            block.append((a, b))
        elif block:
            flush()
    if block:
        flush()
    return ends


@F.pandas_udf(ArrayType(IntegerType()))
def _ends(texts: pd.Series) -> pd.Series:
    return texts.map(sentence_ends)


def sentence_arrays(df: DataFrame, text: str, out: str = "ends") -> DataFrame:
    """The columns of df without the text, and ``out``, the end positions of its sentences; an empty array where it has none."""
    keep = [c for c in df.columns if c not in (text, out)]
    return df.select(*keep, _ends(F.col(text)).alias(out))


def sentences(df: DataFrame, text: str, out: str = "end_pos") -> DataFrame:
    """One row per sentence: the columns of df without the text, and ``out``, the sentence's end position.

    Null, empty and blank texts have none. Repeated rows give repeated sentences. No shuffle: the texts go
    through one Arrow function that returns positions, and the rest stays in the JVM.
    """
    keep = [c for c in df.columns if c not in (text, out)]
    # exploded in one step: a filter on the arrays, as Spark adds before an explode of a column, would cut every text twice
    return df.select(*keep, F.explode(_ends(F.col(text))).alias(out))
