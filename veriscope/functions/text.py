"""Column builders for normalising, tokenising and cutting text. All stay inside the JVM but NFC of marked texts."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from veriscope.functions import lexicons as lx

#: White space and word characters as the same class in every regex dialect.
WS = r"[\t\n\x0B\f\r \x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
NOT_WS = "[^" + WS[1:]
BLANK = WS.replace(r"\n", "")
WORD = r"[\p{L}\p{N}_]"


def _folds() -> tuple[str, str]:
    """Letters whose decomposition without marks is one other character, and đ."""
    src, dst = ["đ", "Đ"], ["d", "D"]
    for o in [*range(0xC0, 0x3000)]:
        base = [c for c in unicodedata.normalize("NFD", chr(o)) if unicodedata.category(c) != "Mn"]
        if len(base) == 1 and base[0] != chr(o):
            src.append(chr(o))
            dst.append("d" if base[0] == "đ" else "D" if base[0] == "Đ" else base[0])
    return "".join(src), "".join(dst)


FOLD_FROM, FOLD_TO = _folds()


def fold_accents(t: Column) -> Column:
    """Text without diacritics; đ is d."""
    return F.translate(F.regexp_replace(t, r"\p{Mn}", ""), FOLD_FROM, FOLD_TO)


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def once(df: DataFrame, **made: Column) -> DataFrame:
    """Adds columns that are made once per row however often they are read: a generator of one row, into which the optimizer
    can't inline them as it does into a projection that holds a Python function."""
    for name, c in made.items():
        df = df.select(*(F.col(f"`{k}`") for k in df.columns if k != name), F.explode(F.array(c)).alias(name))
    return df


def one_of(words: Sequence[str], marks: str = "") -> str:
    """A pattern of exactly one of the words, with any of ``marks`` around it."""
    around = f"[{re.escape(marks)}]*" if marks else ""
    return f"^{around}(?:{'|'.join(map(re.escape, sorted(words)))}){around}$"


def _variants() -> dict[str, str]:
    """Every unaccented letter with the letters that fold to it."""
    out: dict[str, str] = {}
    for a, b in zip(FOLD_FROM, FOLD_TO, strict=True):
        if a.isalpha() and b.isascii() and (ord(a) < 0x250 or 0x1E00 <= ord(a) < 0x1F00):
            out[b.lower()] = out.get(b.lower(), "") + a
    return out


VARIANTS = _variants()


def phrase(words: str, accents: bool = True) -> str:
    """A pattern of the words with any white space, or none, between them; without ``accents`` letters match all variants."""
    made = (w if accents else "".join(f"[{c}{VARIANTS[c]}]" if c in VARIANTS else c for c in w) for w in (re.escape(w) for w in words.split()))
    return f"{WS}*".join(made)


def any_phrase(phrases: Sequence[str], accents: bool = True) -> str:
    return "(?:" + "|".join(phrase(p, accents) for p in phrases) + ")"


def fold_literal(s: str) -> str:
    """``fold_accents`` of a constant, at plan time."""
    out = "".join(c for c in unicodedata.normalize("NFD", s) if unicodedata.category(c) != "Mn")
    return out.replace("đ", "d").replace("Đ", "D")


def strip(t: Column) -> Column:
    return F.regexp_replace(t, f"^{WS}+|{WS}+$", "")


def collapse(t: Column) -> Column:
    """Lower case, runs of white space as one space, stripped."""
    return F.trim(F.regexp_replace(F.lower(t), f"{WS}+", " "))


def fold(t: Column) -> Column:
    """``collapse`` of the text without accents: what phrases are matched against."""
    return collapse(fold_accents(t))


@F.pandas_udf(StringType())
def _nfc(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in texts:
        yield s.map(lambda t: unicodedata.normalize("NFC", t), na_action="ignore")


def nfc(t: Column) -> Column:
    """Composed form; only texts with marks or decomposable signs travel to Python."""
    return F.coalesce(_nfc(F.when(t.rlike(r"[\p{M}\x{2126}\x{212A}\x{212B}\x{1F71}-\x{1FFD}\x{2000}\x{2001}]"), t)), t)


def clean(t: Column) -> Column:
    """Without tags, URLs, entities and marks; lower case with single spaces."""
    s = nfc(F.regexp_replace(t, "<[^>]+>", " "))
    s = F.regexp_replace(F.replace(s, F.lit("\xa0"), F.lit(" ")), f"https?://{NOT_WS}+", " ")
    s = F.regexp_replace(s, "&[a-z]+;", " ")
    return collapse(F.regexp_replace(s, f"[^0-9A-Za-zÀ-ỹ_{WS[1:]}+", " "))


def word_tokens(t: Column) -> Column:
    return F.regexp_extract_all(F.lower(t), F.lit(f"({WORD}+)"), F.lit(1))


def ws_tokens(t: Column) -> Column:
    return F.filter(F.split(t, f"{WS}+"), lambda x: x != "")


def join_compounds(t: Column, compounds: Sequence[str] = lx.COMPOUNDS) -> Column:
    """Compound phrases as one word each, in list order."""
    for c in compounds:
        t = F.replace(t, F.lit(c), F.lit(c.replace(" ", "_")))
    return t


def kept_tokens(tokens: Column, stop: Sequence[str] = tuple(lx.STOP_WORDS)) -> Column:
    words = F.array(*map(F.lit, stop))
    return F.filter(tokens, lambda x: (F.length(x) > 1) & ~F.array_contains(words, x))


def terms(t: Column) -> Column:
    """Full preprocessing: clean, join compounds, tokenise, drop stop words."""
    return kept_tokens(word_tokens(join_compounds(clean(t))))


def is_english(t: Column, keywords: Sequence[str] = tuple(lx.ENGLISH_KEYWORDS)) -> Column:
    """Over nine tenths ASCII and at least three keyword tokens."""
    words = F.array(*map(F.lit, keywords))
    ascii_ = F.length(F.regexp_replace(t, r"[^\x00-\x7F]", "")) / F.greatest(F.length(t), F.lit(1))
    return (ascii_ > 0.9) & (F.size(F.filter(word_tokens(t), lambda x: F.array_contains(words, x))) >= 3)


def segments(t: Column) -> Column:
    """Parts between line breaks and after sentence ends, stripped, without empty ones."""
    return F.filter(F.transform(F.split(t, rf"\n{{2,}}|[\n\r]+|(?<=[.?!]){WS}+"), strip), lambda x: x != "")


def windows(t: Column, size: int = 768, overlap: int = 120) -> Column:
    """Windows of ``size`` characters that overlap; a text within one window is itself."""
    s, step = strip(t), size - overlap
    last = F.greatest(F.ceil((F.length(s) - overlap) / F.lit(float(step))) - 1, F.lit(0)).cast("int")
    cut = F.transform(F.sequence(F.lit(0), last), lambda i: strip(F.substring(s, i * step + 1, F.lit(size))))
    return F.filter(cut, lambda x: x != "")


def count_of(t: Column, phrase: str) -> Column:
    """Non-overlapping occurrences of a constant."""
    return (F.length(t) - F.length(F.replace(t, F.lit(phrase), F.lit("")))) / len(phrase)


def matching(t: Column, char_class: str) -> Column:
    """How many characters are of a class."""
    return F.regexp_count(t, F.lit(f"[{char_class}]"))


def quality(t: Column, tokens: Column) -> Column:
    """Text quality in [0, 1] from raw tokens and preprocessed ``tokens``; 0 without raw tokens."""
    raw = ws_tokens(t)
    noisy = F.size(F.filter(raw, lambda x: x.rlike(r"\p{Nd}") & (F.length(x) > 6)))
    n, m = F.size(raw), F.size(tokens)
    score = F.lit(0.6) * m / F.greatest(n, F.lit(1)) + F.lit(0.5) * F.size(F.filter(tokens, lambda x: F.length(x) >= 3)) / F.greatest(m, F.lit(1)) - F.lit(0.3) * noisy / F.greatest(n, F.lit(1))
    return F.when(n == 0, 0.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), score)))


def mask_leaks(t: Column, phrases: Sequence[str] = tuple(lx.LEAKING_PHRASES)) -> Column:
    for p in phrases:
        t = F.regexp_replace(t, f"(?iu){p}", "[MASK]")
    return t


def denoise(t: Column) -> Column:
    """Without the usual noise of scanned pages."""
    s = F.regexp_replace(t, f"{BLANK}+", " ")
    s = F.regexp_replace(s, r"[_\-.]{5,}", " ")
    s = F.regexp_replace(s, rf"(?md)^{WS}*[^a-zA-Z0-9À-ỹ\n]{{5,}}{WS}*$", "")
    s = F.regexp_replace(s, rf"(?mdiu)^{WS}*(?:[-–—]?{WS}*\d+{WS}*[-–—]?|Trang{WS}*\d+(?:/\d+)?|Page{WS}*\d+){WS}*$", "")
    return strip(F.regexp_replace(s, r"\n{3,}", "\n\n"))


def accounting_number(t: Column) -> Column:
    """A number as accountants write it; null where it can't be read. Brackets and a leading minus mean negative."""
    s = F.regexp_replace(t, f"{WS}+", "")
    negative = (s.startswith("(") & s.endswith(")")) | s.startswith("-")
    bare = F.regexp_replace(F.regexp_replace(s, r"[()]", ""), "^-+", "")
    value = F.replace(F.regexp_replace(bare, r"[,.](?=\d{3}(?:\D|$))", ""), F.lit(","), F.lit(".")).try_cast("double")
    return F.when(negative, -value).otherwise(value)


def numbers(t: Column) -> Column:
    """Numbers in a text: points group, a comma separates decimals; what then can't be read is left out."""
    found = F.regexp_extract_all(t, F.lit(r"(\d+(?:[.,]\d+)*)"), F.lit(1))
    return F.filter(F.transform(found, lambda x: F.replace(F.replace(x, F.lit("."), F.lit("")), F.lit(","), F.lit(".")).try_cast("double")), lambda x: x.isNotNull())


def counted(tokens: Column) -> Column:
    """Array of (term, tf) of an array of tokens: sorted once, each run of equal ones counted by where the next begins."""
    n = F.size(tokens)

    def runs(s: Column) -> Column:
        starts = F.filter(F.transform(s, lambda x, i: F.struct(x.alias("term"), i.alias("at"))), lambda x: (x["at"] == 0) | (x["term"] != F.element_at(s, F.greatest(x["at"], F.lit(1)))))
        return let(starts, lambda r: F.transform(r, lambda x, j: F.struct(x["term"].alias("term"), (F.when(j + 1 < F.size(r), F.element_at(r, F.least(j + 2, F.size(r)))["at"]).otherwise(n) - x["at"]).alias("tf"))))

    return let(F.array_sort(tokens), runs)
