"""Splitting of oversized texts at natural boundaries (problem 5).

A text is a row of units with a boundary of some strength between any two: section, paragraph, line, sentence, word,
character. Units are tokens (longest runs of other than white space) or characters; inside a token of characters every
boundary is one of characters, so a limit in characters also cuts tokens that are over it. Ranges over the limit are split
at the strongest boundaries they have, then at the next ones, and the parts of one split are packed greedily; each piece
repeats the tail of the one before it.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHARACTER, WORD, SENTENCE, LINE, PARAGRAPH, SECTION = range(6)
UNITS = ("tokens", "characters")
_TOKEN = re.compile(r"\S+")
_BREAK = re.compile(r"\r\n|[\n\r\x0b\x0c\x85  ]")
_END = re.compile(r"[.!?…。！？;][\"'”’»)\]]*$")
_OPEN = re.compile(r"[\"'“‘«(\[]*[^\W_]")
# Tokens that end with a point without ending a sentence, in lower case.
ABBREVIATIONS = frozenset("tp. tx. q. p. ts. ths. gs. pgs. ks. bs. cn. tr. đ. tt. nđ. qđ. stt. v.v. vv. mr. mrs. ms. dr. prof. no. vs. etc. e.g. i.e. co. ltd. inc. corp. jr. sr. st. fig. art. sec. approx.".split())
_HEADING = re.compile(r"(?:#{1,6}\s|(?:điều|khoản|chương|mục|phần|phụ lục|article|section|chapter|part|appendix)\s+[\divxlc]+\b|[IVXLC]+\.\s|\d+(?:\.\d+)+\.?\s)", re.IGNORECASE)


def _strengths(text: str, spans: list[tuple[int, int]]) -> list[int]:
    """Strength of the boundary after each token but the last."""
    out = []
    for (_, end), (start, stop) in zip(spans[:-1], spans[1:], strict=True):
        breaks = len(_BREAK.findall(text, end, start))
        if breaks:
            out.append(SECTION if _HEADING.match(text, start) else PARAGRAPH if breaks > 1 else LINE)
            continue
        token = text[spans[len(out)][0] : end]
        opens = _OPEN.match(text, start, stop)
        short = token.lower().lstrip("\"'“‘«([") in ABBREVIATIONS or re.fullmatch(r"[\"'(]?(?:[^\W\d_]\.)+|\d{1,3}[.)]", token)
        last = opens[0][-1] if opens else ""
        out.append(SENTENCE if _END.search(token) and not short and (last.isupper() or last.isdigit() or token[-1] == ";") else WORD)
    return out


def ranges(strengths: list[int], tokens: int, first: int, budget: int, lowest: int = WORD) -> list[tuple[int, int]]:
    """Ranges of units that partition 0..tokens: the first of at most ``first`` units, the others of ``budget``."""
    done: list[tuple[int, int]] = []

    def room() -> int:
        return budget if done else first

    places = {v: [i + 1 for i, x in enumerate(strengths) if x >= v] for v in range(lowest + 1, SECTION + 1)}

    def at_level(lo: int, hi: int, level: int) -> list[int]:
        p = places[level]
        return p[bisect_right(p, lo) : bisect_left(p, hi)]

    def split(lo: int, hi: int, level: int) -> None:
        if hi - lo <= room():
            done.append((lo, hi))
            return
        if level == lowest:
            while lo < hi:
                step = min(room(), hi - lo)
                while step > 1 and lo + step < hi and strengths[lo + step - 1] < level:
                    step -= 1  # a mark stays with its letter, unless the marks alone are over the limit
                if strengths[lo + step - 1 : lo + step] and strengths[lo + step - 1] < level and lo + step < hi:
                    step = min(room(), hi - lo)
                done.append((lo, lo + step))
                lo += step
            return
        cuts = at_level(lo, hi, level)
        if not cuts:
            split(lo, hi, level - 1)
            return
        at = lo
        for k, cut in enumerate(cuts := [*cuts, hi]):
            follow = cuts[k + 1] if k + 1 < len(cuts) else None
            if follow is not None and follow - at <= room():
                continue  # the next part still fits in this piece
            if cut > at:
                split(at, cut, level - 1)
                at = cut

    if tokens:
        split(0, tokens, SECTION)
    return done


def _characters(text: str, spans: list[tuple[int, int]], strengths: list[int]) -> list[int]:
    """Strength of the boundary after each character but the last, from the first token to the end of the last one.

    White space belongs to the token before it. Before a combining mark there is none.
    """
    out = []
    for (start, end), (follow, _), s in zip(spans, [*spans[1:], (spans[-1][1], 0)], [*strengths, CHARACTER], strict=True):
        out += [CHARACTER - 1 if unicodedata.combining(text[i + 1]) else CHARACTER for i in range(start, end - 1)]
        out += [CHARACTER] * (follow - end) + [s]
    return out[:-1]


def pieces(text: str | None, limit: int | None, overlap: int | None, unit: str = "tokens") -> list[tuple[str, int, int]]:
    """(piece, units, units shared with the piece before) in order; ``unit``: ``tokens`` or ``characters``.

    A null text has no piece; a blank text or one within the limit is its own piece, as stored; a null limit is none, one
    under 1 counts as 1; a null or negative overlap is none, and one of the limit or more counts as half the limit, as
    pieces must advance. Oversized texts: pieces run from the start of their first token to the end of their last one.
    """
    if text is None:
        return []
    if unit not in UNITS:
        raise ValueError(f"unit is one of {', '.join(UNITS)}")
    spans = [m.span() for m in _TOKEN.finditer(text)]
    size = len(spans) if unit == "tokens" else len(text)
    if limit is None or size <= limit or not spans:
        return [(text, size, 0)]
    limit = max(1, limit)
    overlap = max(0, overlap or 0)
    if overlap >= limit:
        overlap = limit // 2
    out = []
    if unit == "characters":
        base, end = spans[0][0], spans[-1][1]
        for lo, hi in ranges(_characters(text, spans, _strengths(text, spans)), end - base, limit, limit - overlap, CHARACTER):
            start = max(0, lo - overlap) if out else lo
            out.append((text[base + start : base + hi], hi - start, lo - start))
        return out
    for lo, hi in ranges(_strengths(text, spans), len(spans), limit, limit - overlap):
        start = max(0, lo - overlap) if out else lo
        out.append((text[spans[start][0] : spans[hi - 1][1]], hi - start, lo - start))
    return out


def split_texts(df: DataFrame, id_col: str = "chunk_id", text_col: str = "text", limit_col: str = "chunk_size_tokens", overlap_col: str = "chunk_overlap_tokens", unit: str = "tokens") -> DataFrame:
    """(id_col, piece, pieces, text, tokens, shared): every text as its pieces, ``piece`` from 0, as in ``pieces``.

    ``unit`` is what limit and overlap count, and then also ``tokens`` and ``shared``.

    A repeated row gives its pieces each time, an empty input gives an empty result, and extra columns are ignored. Rows
    never leave their partition, so no source is too hot.
    """
    kind = df.schema[id_col].dataType.simpleString()

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for i, t, n, o in zip(b["id"], b["t"], b["n"], b["o"], strict=True):
                made = pieces(t, None if pd.isna(n) else int(n), None if pd.isna(o) else int(o), unit)
                rows += [(i, k, len(made), *p) for k, p in enumerate(made)]
            yield pd.DataFrame(rows, columns=[id_col, "piece", "pieces", "text", "tokens", "shared"]).astype({"piece": "int32", "pieces": "int32", "tokens": "int32", "shared": "int32"})

    # ids travel as strings: pandas would turn whole numbers among nulls into floats
    made = df.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("t"), F.col(limit_col).cast("int").alias("n"), F.col(overlap_col).cast("int").alias("o")).mapInPandas(cut, f"`{id_col}` string, piece int, pieces int, text string, tokens int, shared int")
    return made.withColumn(id_col, F.col(id_col).cast(kind))
