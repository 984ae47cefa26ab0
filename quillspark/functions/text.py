"""Text functions as Spark expressions; only Unicode normalisation needs Arrow."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType

# Words that carry no meaning for search.
STOPWORDS = """và là của có các được cho trong với khi này đó một những đến từ theo để ra vào thì mà hay hoặc nếu vì do bởi nên
cũng đã sẽ đang rồi tại trên dưới về như thế ở bằng lại nó rằng phải không chỉ còn đây kia ấy""".split()
# Signs that make a line a formula, and what hints at mathematics in a line.
MATH_SIGNS = "[∑√∏∫≤≥≠⇒⇐→←±·×÷∈∀∅∩∪⊆⊇≡∇∂]"
FORMULA = MATH_SIGNS + r"|\)/\(|\$"
MATH_HINT = r"[∑√∏∫≤≥≠⇒⇐→←±·×÷∈∀∅∩∪⊆≡]|\)/\(|/\{|\^\{|_\{|="
# Lines that read like headings: numbered, Roman, steps, and by their first words.
NUMBERED = r"^(\d+(?:\.\d+){0,3})\s+(\S.*)$"
ROMAN = r"^([IVXLCDM]{1,5})\.\s*(\S.*)$"
STEP = r"(?i)^(Bước\s+\d+)\s*[:.\-]?\s*(\S.*)$"
KEYWORD = r"(?i)^(Mục\s*lục|Phụ\s*lục|Tài\s*liệu\s*tham\s*khảo|Kết\s*luận|Giới\s*thiệu|Tổng\s*kết)\b"
# Greetings and small talk, which need no retrieval.
GREETING = (
    r"(?i)^\s*(xin\s*chào|hello|hi+|hey+|chào\s+bạn|cảm\s*ơn|thanks|thank\s*you|tạm\s*biệt|goodbye|bye|bạn\s+là\s+ai[?!]*"
    r"|bạn\s+có\s+thể\s+làm\s+gì[?!]*|trợ\s+lý|đang\s+sẵn\s*sàng|ok[?!.]*|okay[?!.]*)[\s.!?]*$"
)
# What ends a line.
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"
# Glyph codes of damaged fonts, and a damaged root sign.
GLYPH_CODE, ROOT_GLYPH = r"\(cid:\d+\)", "\uf8e6"
WORD, COMPOUND = r"[\p{L}\p{N}_]+", "_|[a-z0-9][A-Z]"
#: Characters that canonical composition may change or join with the one before; all others stay as they are. Letters of
#: most Latin texts are told by the first two ranges and looked for in none of the others.
COMPOSES = r"[[^\x00-\x{2ff}\x{1e00}-\x{1f70}]&&[\p{M}\x{340}-\x{345}\x{374}\x{37e}\x{387}\x{958}-\x{95f}\x{9dc}-\x{9df}\x{a33}\x{a36}\x{a59}-\x{a5e}\x{b5c}\x{b5d}\x{f43}-\x{fb9}\x{1100}-\x{11ff}\x{1f71}-\x{1fff}\x{2000}\x{2001}\x{2126}\x{212a}\x{212b}\x{2329}\x{232a}\x{2adc}\x{f900}-\x{faff}\x{fb1d}-\x{fb4f}\x{1d15e}-\x{1d1c0}\x{2f800}-\x{2fa1f}]]"


def _nfc(s: pd.Series) -> pd.Series:
    return s.map(lambda t: unicodedata.normalize("NFC", t), na_action="ignore")


def nfc(col) -> Column:
    """Canonical composition; of texts that it can't change, the common case, only a null is sent to Python."""
    c = F.col(col) if isinstance(col, str) else col
    changes = c.rlike(COMPOSES)
    return F.when(changes, F.pandas_udf(_nfc, StringType())(F.when(changes, c))).otherwise(c)


def clean_artifacts(c: Column) -> Column:
    """Glyph codes of damaged fonts become blanks, the private root sign a real one."""
    return F.replace(F.regexp_replace(c, GLYPH_CODE, " "), F.lit(ROOT_GLYPH), F.lit("√"))


def normalize(col) -> Column:
    """Composed, each run of white space one blank, no blanks around."""
    return F.trim(F.regexp_replace(nfc(col), r"\s+", " "))


def normalize_structure(col) -> Column:
    """Composed and cleaned, blanks collapsed in each line, at most one blank line in a row."""
    lines = F.transform(F.split(clean_artifacts(nfc(col)), LINE_END), lambda x: F.trim(F.regexp_replace(x, r"[ \t]+", " ")))
    return F.regexp_replace(F.regexp_replace(F.array_join(lines, "\n"), "\n{3,}", "\n\n"), r"^\n+|\n+$", "")


def words(col) -> Column:
    """Lower-case words of a text; null gives none."""
    c = F.col(col) if isinstance(col, str) else col
    return F.coalesce(F.regexp_extract_all(F.lower(c), F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def subwords(token: Column) -> Column:
    """Parts of a compound or camel-case token with more than one letter, in lower case."""
    apart = F.split(F.regexp_replace(token, "(?<=[a-z0-9])(?=[A-Z])", " "), r"[\s_]+")
    return F.filter(F.transform(apart, lambda x: F.lower(x)), lambda x: F.length(x) > 1)


def search_tokens(col, segmented: Callable[[Column], Column] | None = None) -> Column:
    """Search terms of a text: composed lower-case words without stopwords, each followed by its own parts where it is a compound.

    ``segmented`` is a word segmenter that joins the syllables of a word by underscores; without one, words are runs of
    letters, digits and underscores. Null gives none.
    """
    c = nfc(col)
    if segmented is not None:
        c = segmented(c)
    none = F.array().cast("array<string>")
    found = lambda x: F.coalesce(F.regexp_extract_all(x, F.lit(WORD), F.lit(0)), none)
    kept = F.filter(found(c), lambda t: ~F.replace(F.lower(t), F.lit("_"), F.lit(" ")).isin(*STOPWORDS))
    parts = lambda t: F.filter(subwords(t), lambda p: (p != F.lower(t)) & ~p.isin(*STOPWORDS))
    compound = F.flatten(F.transform(kept, lambda t: F.concat(F.array(F.lower(t)), F.when(t.rlike(COMPOUND), parts(t)).otherwise(none))))
    # most texts have no compound
    return F.when(c.rlike(COMPOUND), compound).otherwise(F.filter(found(F.lower(c)), lambda t: ~t.isin(*STOPWORDS)))


def index_text(title: Column, section: Column, text: Column) -> Column:
    """The text under a line that names its title and section; the bare text where neither is there."""
    head = F.concat_ws(" › ", F.nullif(title, F.lit("")), F.nullif(section, F.lit("")))
    return F.when(head == "", text).otherwise(F.concat(head, F.lit("\n"), text))


def heading_label(line: Column) -> Column:
    """The label of a line that reads like a heading (numbered, Roman, step, keyword), else null."""
    t = F.regexp_replace(line, r"(?U)^\s+|\s+$", "")
    of = lambda pattern, joint: F.when(t.rlike("(?U)" + pattern), F.concat(F.regexp_extract(t, "(?U)" + pattern, 1), F.lit(joint), F.regexp_extract(t, "(?U)" + pattern, 2)))
    return F.coalesce(of(NUMBERED, " "), of(ROMAN, ". "), of(STEP, ": "), F.when(t.rlike("(?U)" + KEYWORD), t))


def has_math(line: Column) -> Column:
    """Whether a line holds a hint of mathematics, and so is no heading."""
    return line.rlike(MATH_HINT)


def is_atomic_line(line: Column) -> Column:
    """Whether a line must not be cut: a table row, a table mark, a formula."""
    return line.startswith("[BẢNG]") | line.contains(" | ") | line.rlike(FORMULA)


def content_key(model: Column, text: Column) -> Column:
    """Cache key of a text under a model."""
    return F.sha2(F.concat(model, F.lit("::"), text), 256)


def cited_labels(answer: Column) -> Column:
    """Distinct numbers in square brackets, ascending."""
    return F.sort_array(F.array_distinct(F.transform(F.regexp_extract_all(answer, F.lit(r"\[(\d{1,9})\]"), F.lit(1)), lambda x: x.cast("int"))))


def slices(text: Column, size: int) -> Column:
    """A text in pieces of ``size`` characters; none for the empty text."""
    return F.when(F.length(text) > 0, F.transform(F.sequence(F.lit(1), F.length(text), F.lit(size)), lambda i: F.substr(text, i, F.lit(size)))).otherwise(F.array().cast("array<string>"))


def read_json(raw: Column) -> Column:
    """A variant: the text as JSON, else what stands between its first { and last }, else null."""
    return F.coalesce(F.try_parse_json(raw), F.try_parse_json(F.regexp_extract(raw, r"(?s)\{.*\}", 0)))


def is_greeting(text: Column) -> Column:
    """Whether a text is nothing but a greeting or small talk."""
    return text.rlike("(?U)" + GREETING)


def python_round(value: Column, digits: int) -> Column:
    """A double rounded as its exact binary value says, ties to even; null stays null."""

    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: round(x, digits), na_action="ignore")

    return F.pandas_udf(run, DoubleType())(value)
