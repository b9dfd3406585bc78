"""Structure of statements: pages, sections, fields and signals, read from a text in one pass of Python.

Phrases are looked for in copies of the text whose letters are exchanged one for one, without accents or in one case, so a
place in a copy is a place in the text. A copy without white space tells at the price of a search for a literal whether a
phrase can occur at all; patterns run only for those that can, and amounts are looked up by place, so no line is read again for
every label on it.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, IntegerType, MapType, StringType, StructField, StructType

from veriscope.functions import lexicons as lx
from veriscope.functions import rules as rl
from veriscope.functions import text as tx

#: Bytes of texts that are parsed before their rows are sent on.
BATCH = 8 << 20
FIELDS = ("ten_cong_ty", "ky_bao_cao", *lx.AMOUNTS)


def _cases() -> np.ndarray:
    """The lower case of the upper case of every Latin character, as the (?iu) of Java's patterns compares them."""
    out = np.arange(0x110000, dtype=np.uint32)
    for o in (*range(0x250), *range(0x1E00, 0x1F00), *range(0x2100, 0x2150)):
        upper = chr(o).upper()
        lower = (upper if len(upper) == 1 else chr(o)).lower()
        out[o] = ord("i") if o == 0x130 else ord(lower) if len(lower) == 1 else o
    return out


def _bare(cases: np.ndarray) -> np.ndarray:
    """``cases``, and letters that ``text.phrase`` takes for an unaccented one as that one."""
    base = np.arange(0x110000, dtype=np.uint32)
    for letter, variants in tx.VARIANTS.items():
        base[[int(cases[ord(v)]) for v in variants]] = ord(letter)
    return base[cases]


def _words() -> np.ndarray:
    """Characters that ``text.clean`` keeps; any other as a blank."""
    out = np.arange(0x110000, dtype=np.uint32)
    kept = (out >= 0xC0) & (out <= 0x1EF9)
    kept[[ord(c) for c in "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz_"]] = True
    return np.where(kept, out, np.uint32(ord(" ")))


def _odd() -> np.ndarray:
    """Whether a character that ``_words`` keeps is none of a word, or becomes more than one in lower case."""
    out = np.zeros(0x110000, dtype=bool)
    out[[o for o in range(0xC0, 0x1EFA) if not chr(o).isalnum() or not chr(o).lower().isalnum()]] = True
    return out


def _blanks() -> np.ndarray:
    """White space but line ends as blanks."""
    out = np.arange(0x110000, dtype=np.uint32)
    out[[o for o in range(0x3001) if chr(o).isspace() and o != 10]] = ord(" ")
    return out


CASES = _cases()
BARE = _bare(CASES)
WORDS, ODD, BLANKS = _words(), _odd(), _blanks()


def codes(t: str) -> np.ndarray:
    return np.frombuffer(t.encode("utf-32-le"), "<u4")


def letters(cp: np.ndarray) -> str:
    return str(cp.data, "utf-32-le")


def exchanged(t: str, table: np.ndarray) -> str:
    return letters(table[codes(t)])


def squeezed(t: str) -> str:
    """Without the white space that a denoised text has."""
    return t.replace(" ", "").replace("\n", "")


class Phrases:
    """Some phrases, with any white space or none between their words, in a text whose letters were exchanged by ``table``."""

    def __init__(self, phrases: Sequence[str], table: np.ndarray) -> None:
        made = [exchanged(p, table).split() for p in phrases]
        self.pattern = "(?:" + "|".join(r"\s*".join(map(re.escape, p)) for p in made) + ")"
        self.literals = tuple("".join(p) for p in made)
        self.compiled = re.compile(self.pattern)

    def possible(self, bare: str) -> bool:
        return any(p in bare for p in self.literals)

    def finditer(self, t: str) -> Iterator[re.Match[str]]:
        return self.compiled.finditer(t)

    def search(self, t: str, bare: str) -> re.Match[str] | None:
        return self.compiled.search(t) if self.possible(bare) else None


class Near:
    """One of ``then`` on the line of ``first`` with at most so many characters between."""

    def __init__(self, first: str, within: int, then: Sequence[str] | str) -> None:
        self.first, self.then = Phrases([first], CASES), Phrases([then] if isinstance(then, str) else then, CASES)
        self.compiled = re.compile(f"{self.first.pattern}.{{0,{within}}}{self.then.pattern}")

    def holds(self, t: str, bare: str) -> bool:
        return self.first.possible(bare) and self.then.possible(bare) and self.compiled.search(t) is not None


# a border as Java's: numerals that aren't digits are no part of a word, marks on a letter are
_NUMERALS = "".join(c for c in map(chr, range(0x3400)) if unicodedata.category(c) in ("Nl", "No"))
_PART, _SIGN = rf"[^\W{_NUMERALS}]", r"[̀-ͯ]"
_BEFORE, _AFTER = rf"(?<!{_PART})(?<!{_PART}{_SIGN})(?<!{_PART}{_SIGN}{_SIGN})", rf"(?!{_PART}|{_SIGN})"

_MARK = re.compile(r"(?i)-{2,}[ \t]*TRANG[ \t]*([0-9]+)[ \t]*-{2,}")
# a run of five is of one character or holds two different ones side by side
_RULERS, _RULED = re.compile(r"[_\-.]{5,}"), [a * 5 if a == b else a + b for a in "_-." for b in "_-."]
_NOISE = re.compile(r"(?m)^\s*[^a-zA-Z0-9À-ỹ\n]{5,}\s*$")
_FOOTERS = re.compile(r"(?mi)^\s*(?:[-–—]?\s*[0-9]+\s*[-–—]?|Trang\s*[0-9]+(?:/[0-9]+)?|Page\s*[0-9]+)\s*$")
_BREAKS = re.compile(r"\n{3,}")
_TAG, _URL, _ENTITY, _TOKEN, _DIGIT = re.compile("<[^>]+>"), re.compile(r"https?://\S+"), re.compile("&[a-z]+;"), re.compile(r"\w+"), re.compile(r"\d")
_FIGURE = r"[0-9]{1,3}(?:[,.\s]+[0-9]{3}){2,}"
_STARTS = re.compile(r"[0-9](?=[0-9]{0,2}(?:[,.\s]+[0-9]{3}){2})")
_PLAIN, _BRACKETED, _ASCII_DIGIT = re.compile(_FIGURE), re.compile(rf"\(?{_FIGURE}\)?"), re.compile("[0-9]")
_ROUND = re.compile(rf"{_BEFORE}([0-9]+)(?:,000){{2,}}{_AFTER}")


_BORDER = re.compile(_BEFORE)


class Code:
    """A line's code on the official form: a number of its own, or what ``ma so`` ends with."""

    def __init__(self, number: int) -> None:
        self.literals = (str(number),)
        self.compiled = re.compile(f"{number}{_AFTER}")

    def finditer(self, plain: str) -> Iterator[re.Match[str]]:
        for m in self.compiled.finditer(plain):
            if _BORDER.match(plain, at := m.start()):
                yield m
            elif plain.endswith("so", 0, at):
                head = plain[: at - 2].rstrip()
                if head.endswith("ma") and _BORDER.match(head, len(head) - 2):
                    yield m


_SECTIONS = {k: Phrases(h, BARE) for k, h in lx.SECTIONS.items()}
# of each field: its labels, and the characters that may lie between lines
_AMOUNTS = {k: [(Code(g), 80) if isinstance(g, int) else (Phrases(g, BARE), 120) for g in labels] for k, labels in lx.AMOUNTS.items()}
_COMPANY = re.compile(rf"{Phrases(['cong ty'], BARE).pattern}\s+")
_NAME = re.compile(rf"(?m){_COMPANY.pattern}(?:{Phrases(lx.COMPANY_FORMS, BARE).pattern})?\s*(.{{5,120}}?)(?:\n|{Phrases(lx.COMPANY_ENDS, BARE).pattern}|$)")
_SUFFIX = Phrases(lx.COMPANY_SUFFIXES, BARE)
_ENGLISH = re.compile(rf"(?m)^([A-Z][A-Z&,.\s]{{10,120}}{Phrases(lx.COMPANY_SUFFIXES, np.arange(0x250, dtype=np.uint32)).pattern})")
_QUARTER = re.compile(rf"{Phrases(lx.QUARTERS, BARE).pattern}\s*([0-9])\s*(?:{Phrases(['nam', 'year'], BARE).pattern})?\s*([0-9]{{4}})")
_YEAR = re.compile(rf"{Phrases(lx.YEARS, BARE).pattern}\s+([0-9]{{4}})")
_PERIOD = re.compile(rf"{Phrases(lx.PERIODS, BARE).pattern}[^\n]*?([0-9]{{4}})")
_SIGNALS = [(f"tu_khoa_{name}", Phrases(p, CASES)) for name, p in lx.FRAUD_SIGNALS] + [("co_giao_dich_ben_lien_quan", Phrases(lx.RELATED_PARTIES, CASES))]
_OPINIONS, _REFUSED, _LASTING, _PROVISION = Phrases(lx.ADVERSE_OPINIONS, CASES), Near(*lx.REFUSED), Near(*lx.LASTING_LOSS), Phrases([lx.PROVISION[0]], CASES)
_PROVIDED = re.compile(rf"{_PROVISION.pattern}.{{0,{lx.PROVISION[1]}}}([0-9.]{{8,}})")
_STOP = frozenset(w for w in lx.STOP_WORDS if len(w) > 1)
# with the inner words, which stand alone where the compound is
_COMPOUNDS = [(c, c.replace(" ", "_"), frozenset(c.split()[1:-1])) for c in lx.COMPOUNDS]


def pages(t: str) -> list[dict]:
    """(page, content) between page marks; text before the first mark is dropped; without marks one page 1. A number beyond
    an int is null."""
    parts = _MARK.split(t) if "--" in t else [t]
    if len(parts) == 1:
        return [{"page": 1, "content": t.strip()}]
    numbers = (n.lstrip("0") or "0" for n in parts[1::2])
    return [{"page": int(n) if len(n) < 10 or len(n) == 10 and n <= "2147483647" else None, "content": c.strip()} for n, c in zip(numbers, parts[2::2], strict=True)]


def denoised(t: str) -> str:
    """``text.denoise`` of the composed text."""
    s = exchanged(unicodedata.normalize("NFC", t), BLANKS)
    while "  " in s:
        s = s.replace("  ", " ")
    if any(p in s for p in _RULED):
        s = _RULERS.sub(" ", s)
    s = _FOOTERS.sub("", _NOISE.sub("", s))
    return (_BREAKS.sub("\n\n", s) if "\n\n\n" in s else s).strip()


def quality(t: str) -> float:
    """``text.quality`` of a text and its ``text.terms``."""
    s = unicodedata.normalize("NFC", _TAG.sub(" ", t)).replace("\xa0", " ") if "<" in t else t
    s = _URL.sub(" ", s) if "http" in s else s
    s = _ENTITY.sub(" ", s) if "&" in s else s
    cp = WORDS[codes(s)]
    tokens = letters(cp).lower().split()
    words, s = set(tokens), " ".join(tokens)
    joins = [(c, joined) for c, joined, inner in _COMPOUNDS if inner <= words and c in s]
    for c, joined in joins:
        s = s.replace(c, joined)
    if ODD[cp].any():
        tokens = _TOKEN.findall(s)
    elif joins:
        tokens = s.split()
    sizes, stops = list(map(len, tokens)), [len(x) for x in tokens if x in _STOP]
    raw = t.split()
    noisy = len([1 for x in raw if len(x) > 6 and _DIGIT.search(x)])
    n, short = len(raw), sizes.count(1)
    m = len(sizes) - short - len(stops)
    long = m - sizes.count(2) + stops.count(2)
    return min(1.0, max(0.0, 0.6 * m / max(n, 1) + 0.5 * long / max(m, 1) - 0.3 * noisy / max(n, 1))) if n else 0.0


def sections(t: str, plain: str, bare: str, headings: Mapping[str, Phrases] = _SECTIONS) -> list[tuple[str, str]]:
    """Sections with their texts, from the first mention of a heading, with or without accents, to the next section; else
    the full text."""
    found = sorted((m.start(), k) for k, h in headings.items() if (m := h.search(plain, bare)))
    ends = [at for at, _ in found[1:]] + [len(t)]
    return [(k, t[at:end].strip()) for (at, k), end in zip(found, ends, strict=True)] if found else [("full_text", t)]


def amount(plain: str, bare: str, starts: Sequence[int], labels: Sequence[tuple], signed: bool = False) -> str | None:
    """The amount that follows a label, as written: of the first group of labels that has one.

    An amount is one to three digits and two or more groups of three; ``starts`` has the places where one can begin. It stands
    on the label's line, or else after at most 120 characters without a digit from the line's end on (80 after a code).
    """
    for label, gap in labels:
        if not any(p in bare for p in label.literals):
            continue
        line = -1
        for m in label.finditer(plain):
            at = m.end()
            i = bisect_left(starts, at)
            if i == len(starts):
                break
            if line < at and (line := plain.find("\n", at)) < 0:
                line = len(plain)
            first, least = starts[i], at
            if first >= line:
                least, digit = line, _ASCII_DIGIT.search(plain, line, line + gap + 2)
                if digit is None or digit.start() != first:
                    continue
            if signed and first > least and plain[first - 1] == "(":
                first -= 1
            if first - line <= gap:
                return (_BRACKETED if signed else _PLAIN).match(plain, first)[0]
    return None


def company_name(t: str, plain: str, bare: str) -> str | None:
    """The name after ``công ty`` at the start of a line, up to the line's end or a tax or address label; else a line in
    capitals that ends with an English company suffix."""
    for c in _COMPANY.finditer(plain) if "congty" in bare else ():
        if (c.start() == 0 or plain[c.start() - 1] == "\n") and (m := _NAME.match(plain, c.start())):
            if name := t[m.start(1) : m.end(1)].strip():
                return name
            break
    m = _ENGLISH.search(t) if _SUFFIX.possible(bare) else None
    return m[1].strip() if m else None


def period(plain: str) -> str | None:
    """``quarter year``, or the year that a label of years or of a period's end is followed by."""
    if m := _QUARTER.search(plain):
        return f"{m[1]} {m[2]}"
    m = _YEAR.search(plain) or _PERIOD.search(plain)
    return m[1] if m else None


def fraud_signals(t: str, bare: str) -> list[str]:
    """``rules.fraud_signals`` of a text in one case."""
    rounds = sum(x.endswith("000") for x in _ROUND.findall(t)) if ",000,000" in t else 0
    return [f"so_tien_tron_bat_thuong_{rounds}_lan"] * (rounds > 5) + [name for name, p in _SIGNALS if p.search(t, bare)]


_STRINGS = ArrayType(StringType())
SCHEMA = StructType(
    [StructField("text_clean", StringType()), StructField("pages", ArrayType(StructType([StructField("page", IntegerType()), StructField("content", StringType())]))), StructField("sections", MapType(StringType(), StringType()))]
    + [StructField(f"{k}_raw", StringType()) for k in FIELDS]
    + [StructField("fraud_signals", _STRINGS), StructField("ocr_quality", DoubleType()), StructField("_adverse", BooleanType()), StructField("_lasting", BooleanType()), StructField("_provision", StringType())]
)
_ARROW = [pa.string(), pa.list_(pa.struct([("page", pa.int32()), ("content", pa.string())])), pa.map_(pa.string(), pa.string()), *[pa.string()] * len(FIELDS), pa.list_(pa.string()), pa.float64(), pa.bool_(), pa.bool_(), pa.string()]


def parsed(text: str | None) -> tuple:
    """The values of ``SCHEMA`` for a text; a null text has a page and a full text that are null, no signals and no quality."""
    if text is None:
        return (None, [{"page": 1, "content": None}], [("full_text", None)], *[None] * len(FIELDS), [], 0.0, None, None, None)
    t = denoised(text)
    cp = codes(t)
    plain, cased = letters(BARE[cp]), letters(CASES[cp])
    bare, dense = squeezed(plain), squeezed(cased)
    starts = [m.start() for m in _STARTS.finditer(plain)]
    amounts = [amount(plain, bare, starts, labels, k in lx.SIGNED) if starts else None for k, labels in _AMOUNTS.items()]
    provided = _PROVIDED.search(cased) if _PROVISION.possible(dense) else None
    adverse = _OPINIONS.search(cased, dense) is not None or _REFUSED.holds(cased, dense)
    return (t, pages(text), sections(t, plain, bare), company_name(t, plain, bare), period(plain), *amounts, fraud_signals(cased, dense), quality(t), adverse, _LASTING.holds(cased, dense), provided[1] if provided else "")


def _batches(kept: Sequence[str], text_col: str):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(b.schema.get_field_index(text_col))
            at, step = 0, max(1, int(len(b) * BATCH / max(texts.nbytes, 1)))
            while at < len(b):
                rows = list(zip(*map(parsed, texts.slice(at, step).to_pylist()), strict=True))
                made = [pa.array(v, t) for v, t in zip(rows, _ARROW, strict=True)]
                yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(k)).slice(at, step) for k in kept), *made], [*kept, *SCHEMA.names])
                at += step

    return run


def parse_documents(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds pages, sections, fields, quality, signals, label and a snippet to raw texts; null texts give nulls.

    Each field comes as text (``_raw``) and as a number where it reads as one (``_num``). Unlike a snippet alone, the cleaned
    text stays in ``text_clean``, so the result can go straight into training.
    """
    kept = [k for k in df.columns if k not in SCHEMA.names]
    base = df.mapInArrow(_batches(kept, text_col), StructType([*(df.schema[k] for k in kept), *SCHEMA.fields]))
    base = base.withColumns({f"{k}_num": tx.accounting_number(F.col(f"{k}_raw")) for k in FIELDS})
    t: Column = F.col("text_clean")
    distress = rl.distress_signals(t, F.col("loi_nhuan_sau_thue_num"), F.col("doanh_thu_num"), F.col("_lasting"), F.col("_provision"))
    base = base.withColumns({"distress_signals": distress, "auto_label": rl.auto_label(t, F.col("fraud_signals"), F.col("_adverse"))})
    return base.withColumns({"suggested_review": (F.col("ocr_quality") < 0.5) | (F.size("fraud_signals") > 0), "text_snippet": F.left(t, F.lit(500)), "char_count": F.length(t)}).drop("_adverse", "_lasting", "_provision")
