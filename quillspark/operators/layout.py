"""Lines of text from placed glyphs: fractions, rows, gaps, headings, page blocks.

A glyph is (doc_id, page, c, x0, x1, cx, cy, size); a bar is (doc_id, page, x0, x1, y). Pages are independent, so
order-dependent steps run per page; a page is a bounded sheet.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import text as X

LINE = "doc_id bigint, page int, line_no int, line string, size double"
NO_SPACE = 3.5
#: Pages that are handed to Python together.
PAGES_A_GROUP = 100


def glyph_char(c: Column, font: Column) -> Column:
    """Characters of extension fonts that stand for large operators."""
    return F.when(F.upper(font).contains("CMEX"), F.translate(c, "XPqYZR", "∑∑√∏∫∫")).otherwise(c)


def fraction_bars(drawings: DataFrame, page_width: Column) -> DataFrame:
    """Horizontal strokes that can be fraction bars: nearly level, 14 wide at least, at most three fifths of the page."""
    w = F.col("x1") - F.col("x0")
    flat = F.abs(F.col("y1") - F.col("y0")) < F.when(F.col("kind") == "line", 0.8).otherwise(1.6)
    return drawings.where(flat & (w >= 14) & (w <= 0.6 * page_width)).select("doc_id", "page", "x0", "x1", ((F.col("y0") + F.col("y1")) / 2).alias("y"))


def _upper_median(values: list[float], default: float) -> float:
    return sorted(values)[len(values) // 2] if values else default


def _join(row: list[dict], space: float) -> str:
    out, before = "", None
    for g in sorted(row, key=lambda g: g["x0"]):
        if g.get("atom"):
            out += " " * bool(out and not out.endswith(" ")) + g["c"]
            before = None
            continue
        if before is not None and g["x0"] - before > 0.6 * space and not out.endswith(" ") and g["c"] != " ":
            out += " "
        out += g["c"]
        before = g["x1"]
    return out.strip()


def fractions(glyphs: list[dict], bars: list[dict], space: float) -> list[dict]:
    """Glyphs with what stands over and under each bar replaced by one token; a glyph belongs to the first bar that claims it."""
    used: set[int] = set()
    made = []
    for bar in bars:
        near = [(i, g) for i, g in enumerate(glyphs) if i not in used and bar["x0"] - 2 <= g["cx"] <= bar["x1"] + 2 and g["c"].strip()]
        over = [(i, g) for i, g in near if bar["y"] - 11 < g["cy"] < bar["y"] - 0.3]
        under = [(i, g) for i, g in near if bar["y"] + 0.3 < g["cy"] < bar["y"] + 11]
        if not over or not under or max(len(over), len(under)) > 40:
            continue
        top, low = (sum(g["cy"] for _, g in s) / len(s) for s in (over, under))
        if low - top < 6:
            continue
        claimed = {i for i, _ in over + under}
        left, right = (f(g[k] for _, g in over) for f, k in ((min, "x0"), (max, "x1")))
        beside = [g for i, g in enumerate(glyphs) if i not in claimed and abs(g["cy"] - top) < 3 and (0 <= left - g["x1"] < space or 0 <= g["x0"] - right < space)]
        if beside:
            continue
        used |= claimed
        text = lambda s: _join([g for _, g in s], space)
        made.append({"c": f"({text(over)})/({text(under)})", "x0": left, "x1": max(g["x1"] for _, g in over + under), "cx": bar["x0"], "cy": bar["y"], "size": 0.0, "atom": True})
    return [g for i, g in enumerate(glyphs) if i not in used] + made


def rows(glyphs: list[dict], within: float = 4.0) -> list[list[dict]]:
    """Glyphs by row: each joins the first row whose first glyph is within reach, so rows don't chain."""
    out: list[list[dict]] = []
    for g in sorted(glyphs, key=lambda g: (round(g["cy"], 1), g["x0"])):
        row = next((r for r in out if abs(r[0]["cy"] - g["cy"]) <= within), None)
        if row is None:
            out.append([g])
        else:
            row.append(g)
    return sorted(out, key=lambda r: min(g["cy"] for g in r))


def page_lines(glyphs: DataFrame, bars: DataFrame) -> DataFrame:
    """Lines of each page in reading order, with their largest glyph size."""

    columns = ["doc_id", "page", "line_no", "line", "size"]

    def page(marks: list[dict], strokes: list[dict]) -> list[tuple[str, float]]:
        space = _upper_median([m["x1"] - m["x0"] for m in marks if m["c"] == " "], NO_SPACE)
        marks = fractions(marks, sorted(strokes, key=lambda b: (b["y"], b["x0"])), space)
        found = [(_join(r, space), max([m["size"] for m in r if not m.get("atom")], default=0.0)) for r in rows(marks)]
        return [(t, float(s)) for t, s in found if t]

    def run(g: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        marks: dict[tuple, list[dict]] = {}
        strokes: dict[tuple, list[dict]] = {}
        for m in g.to_dict("records"):
            marks.setdefault((m["doc_id"], m["page"]), []).append(m)
        for m in b.to_dict("records"):
            strokes.setdefault((m["doc_id"], m["page"]), []).append(m)
        out = [(*k, n, t, s) for k, v in marks.items() for n, (t, s) in enumerate(page(v, strokes.get(k, [])), 1)]
        return pd.DataFrame(out, columns=columns)

    share = F.pmod(F.xxhash64("doc_id", "page"), F.lit(max(1, glyphs.select("doc_id", "page").distinct().count() // PAGES_A_GROUP))).alias("share")
    return glyphs.select("*", share).groupBy("share").cogroup(bars.select("*", share).groupBy("share")).applyInPandas(run, LINE)


def headings(lines: DataFrame) -> DataFrame:
    """lines with ``label``: null unless the line is a heading by its form, its size against the document's upper median, and its length."""
    mid = lines.groupBy("doc_id").agg(F.sort_array(F.collect_list("size")).alias("s")).select("doc_id", F.coalesce(F.get("s", F.floor(F.size("s") / 2).cast("int")), F.lit(12.0)).alias("mid"))
    tall = F.col("size") >= F.greatest(1.15 * F.col("mid"), F.lit(11.0))
    ok = tall & (F.length("line") <= 80) & ~X.has_math(F.col("line"))
    return lines.join(mid, "doc_id").withColumn("label", F.when(ok, X.heading_label(F.col("line")))).drop("mid")


def boilerplate(lines: DataFrame, share: float = 0.5) -> DataFrame:
    """doc_id, line, n: lines of 1 to 60 characters that stand on many pages: ``share`` of them, three at least, in documents of three pages or more."""
    pages = lines.groupBy("doc_id").agg(F.countDistinct("page").alias("pages")).where("pages >= 3")
    per = lines.where("length(line) between 1 and 60").select("doc_id", "page", "line").distinct().groupBy("doc_id", "line").agg(F.count(F.lit(1)).alias("n"))
    return per.join(pages, "doc_id").where(F.col("n") >= F.greatest(F.lit(3), F.floor(F.col("pages") * share))).select("doc_id", "line", "n")


def drop_boilerplate(lines: DataFrame, share: float = 0.5) -> DataFrame:
    """lines without the boilerplate of their document."""
    return lines.join(boilerplate(lines, share).select("doc_id", "line"), ["doc_id", "line"], "left_anti")


def empty_pages(lines: DataFrame, body: DataFrame, least: int = 3) -> DataFrame:
    """Pages (doc_id, page) of ``lines`` on which ``body``, what is left without boilerplate, has fewer than ``least`` characters: they have to be read otherwise."""
    left = body.groupBy("doc_id", "page").agg(F.sum(F.length("line")).alias("chars")).where(F.col("chars") >= least)
    return lines.select("doc_id", "page").distinct().join(left, ["doc_id", "page"], "left_anti")


def blocks(lines: DataFrame) -> DataFrame:
    """Blocks of body lines: doc_id, page, run, section, text. A heading labels what follows, over page ends too; a page ends a block."""
    labelled = headings(lines)
    over = Window.partitionBy("doc_id").orderBy("page", "line_no").rowsBetween(Window.unboundedPreceding, 0)
    runs = labelled.withColumn("section", F.last("label", ignorenulls=True).over(over)).withColumn("run", F.sum(F.col("label").isNotNull().cast("int")).over(over)).where("label is null")
    packed = runs.groupBy("doc_id", "page", "run", "section").agg(F.sort_array(F.collect_list(F.struct("line_no", "line"))).alias("l"))
    return packed.select("doc_id", "page", "run", "section", F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("text"))
