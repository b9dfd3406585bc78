"""Texts decoded with a wrong character encoding: detection and restoration (problem 2).

Every chain of up to ``MAX_STEPS`` wrong decodings that can explain a text is undone, each different result is compressed
with one zstandard dictionary per language, and the chain with the least description length (bits of the compressed text,
of naming the scripts that the dictionaries don't know, and of naming the chain) wins; the empty chain costs nothing, so a
text is left unchanged unless undoing a chain makes it shorter to describe. A step undoes well-formed damage only, so
passages are repaired inside sound text, of whatever script. Letters lost as question marks are found by description
length too: a text is damaged where naming the letters that were meant makes it shorter.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import cache, lru_cache, partial

import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits that each step of a chain costs; what a replaced character costs.
STEP_BITS = 12
MAX_STEPS = 3
#: What naming a script costs that the dictionaries have no letters of, and naming a lost letter and its place.
SCRIPT_BITS, LOST_BITS = 64, 10
#: Faster levels of compression don't always describe a shorter text in fewer bits.
LEVEL = 12
#: At most so many texts train the dictionaries; the size of each in bytes.
SAMPLE_TEXTS, DICT_BYTES = 6000, 32768

# 8-bit encodings that UTF-8 text is often read in, as the standard library names them.
MISREAD_AS = ("cp1252", "latin-1", "cp1258", "cp1250", "cp1251", "mac_roman", "cp437", "cp850")
# The 8-bit Vietnamese standard TCVN 5712 part 3 as shown in Windows-1252, and the letters meant.
TCVN3_SHOWN = "µ¸¶·¹¨»¾¼½Æ©ÇÊÈÉË®ÌÐÎÏÑªÒÕÓÔÖ×ÝØÜÞßãáâä«åèæçé¬êíëìîïóñòô\xadõøö÷ùúýûüþ¡¢§£¤¥¦"
TCVN3_MEANT = "àáảãạăằắẳẵặâầấẩẫậđèéẻẽẹêềếểễệìíỉĩịòóỏõọôồốổỗộơờớởỡợùúủũụưừứửữựỳýỷỹỵĂÂĐÊÔƠƯ"
#: Letters of Vietnamese.
VIETNAMESE = "".join(c for o in [*range(0xC0, 0x250), *range(0x1EA0, 0x1EFA)] if (c := chr(o)) in "ăĂâÂđĐêÊôÔơƠưƯýÝ" or 0x1EA0 <= o <= 0x1EF9 or unicodedata.normalize("NFD", c)[0] in "aeiouyAEIOUY" and unicodedata.normalize("NFD", c)[1:] in ("̀", "́", "̃") or c in "ĩĨũŨ")
PLAIN = "\t\n\r -~" + VIETNAMESE + "“”‘’–—…€₫"



@cache
def _chars(codec: str) -> dict[int, str]:
    """Byte to character; bytes without one show as the control character of that number, as browsers do."""
    out = {}
    for b in range(0x80, 0x100):
        try:
            out[b] = bytes([b]).decode(codec)
        except UnicodeDecodeError:
            out[b] = chr(b)
    return out


def _class(codec: str, lo: int, hi: int) -> str:
    return "[" + "".join(re.escape(_chars(codec)[b]) for b in range(lo, hi + 1)) + "]"


@cache
def _damage(codec: str) -> re.Pattern:
    """Well-formed UTF-8 sequences as they show in ``codec``."""
    tail = _class(codec, 0x80, 0xBF)
    return re.compile(f"(?:{_class(codec, 0xC2, 0xDF)}{tail}|{_class(codec, 0xE0, 0xEF)}{tail}{{2}}|{_class(codec, 0xF0, 0xF4)}{tail}{{3}})+")


def _gate() -> re.Pattern:
    """A text in which this finds nothing has no candidate decoding: no unusual character, no damage of usual ones."""
    usual, pairs, leads = re.compile(f"[{PLAIN}]"), [], ""
    for codec in MISREAD_AS:
        lead, tail = ("".join(re.escape(c) for b in at if usual.fullmatch(c := _chars(codec)[b])) for at in (range(0xC2, 0xF5), range(0x80, 0xC0)))
        if lead and tail:
            pairs.append(f"[{lead}][{tail}]")
            leads += lead
    return re.compile(rf"[^{PLAIN}]|(?=[{leads}])(?:{'|'.join(dict.fromkeys(pairs))})|\?[^\W\d_]|(?<=[^\W\d_])\?(?:\s*[,;:)–]|\s+[a-zà-ÿđ])")


GATE = _gate()
#: What the dictionaries don't know: characters of other scripts, and Latin letters beyond those of European languages.
_RARE = re.compile("[^\x00-\u017f\u01a0\u01a1\u01af\u01b0\u0300-\u036f\u1ea0-\u1ef9\u2000-\u2bff\u3000\ufb00-\ufb06\ufe00-\ufe0f\ufeff\uff00-\uffff]")
_THREE_BYTES = re.compile("((?:(?![\u1ea0-\u1ef9\u2000-\u2bff\u3000\ufb00-\ufb06\ufe00-\ufe0f\ufeff\uff00-\uffff])[\u0800-\U0010ffff])+)")

_CONTROL = re.compile("[\x80-\x84\x86-\x9f]")


@cache
def _script(c: str) -> str:
    return unicodedata.name(c, "").partition(" ")[0] if unicodedata.category(c)[0] in "LMN" else ""


@cache
def _meaningless(c: str) -> bool:
    if unicodedata.category(c) in ("Cc", "Cn", "Co", "Cs"):
        return c not in "\t\n\r"
    # marks and modifiers of no script, but for the tone and vowel marks of Vietnamese
    return 0x2B0 <= ord(c) <= 0x36F and c not in "\u0300\u0301\u0302\u0303\u0306\u0309\u031b\u0323"


@cache
def _bytes(codec: str) -> dict[str, int]:
    return {c: b for b, c in _chars(codec).items()}


def _damaged(text: str) -> bool:
    """Whether a decoded sequence is itself damage of a usual kind, as after two wrong decodings."""
    return any(_damage(c).search(text) for c in MISREAD_AS)


def undo_utf8(text: str, codec: str) -> str:
    """Replaces each well-formed sequence by what its bytes mean in UTF-8; invalid ones stay."""
    table = _bytes(codec)

    def back(m: re.Match) -> str:
        try:
            meant = bytes(table[c] for c in m[0]).decode("utf-8")
        except UnicodeDecodeError:
            return m[0]
        return meant if not any(map(_meaningless, meant)) or _damaged(meant) else m[0]

    return _damage(codec).sub(back, text)


_TCVN3 = str.maketrans(TCVN3_SHOWN, TCVN3_MEANT)
#: Characters that TCVN3 text shows and Vietnamese doesn't have.
_ODD = "[" + "".join(re.escape(c) for c in TCVN3_SHOWN if c not in VIETNAMESE) + "]"
_TCVN3_ODD = re.compile(rf"(?<=[^\W\d_]){_ODD}|{_ODD}(?=[^\W\d_])")
_NOT_TCVN3 = re.compile("[đĐơƠưƯăĂẠ-ỹ]")
_SENTENCES = re.compile(r"(?<=[.!?;])\s+|\n")


def undo_tcvn3(text: str) -> str:
    """Rewrites the sentences that hold at least two characters inside words that Vietnamese doesn't have, and none
    of the letters that such text can't show."""
    if len(_TCVN3_ODD.findall(text)) < 2:
        return text
    out, at = [], 0
    for m in [*_SENTENCES.finditer(text), None]:
        end = m.start() if m else len(text)
        part = text[at:end]
        out.append(part.translate(_TCVN3) if len(_TCVN3_ODD.findall(part)) >= 2 and not _NOT_TCVN3.search(part) else part)
        if m:
            out.append(m[0])
            at = m.end()
    return "".join(out)


#: Encoded sequences lie in runs of characters beyond ASCII, which are few and short and come again and again.
_RUN = re.compile("([^\x00-\x7f]+)")


#: What each codec's step makes of a run, remembered.
_UNDO = {codec: lru_cache(1 << 16)(partial(undo_utf8, codec=codec)) for codec in MISREAD_AS}


class _Text:
    """A text as the runs it is made of, so that a step is a look at each different run."""

    def __init__(self, text: str):
        self.pieces = _RUN.split(text)
        self.runs = self.pieces[1::2]
        self.first = tuple(dict.fromkeys(self.runs))

    def joined(self, now: tuple[str, ...]) -> str:
        self.pieces[1::2] = map(dict(zip(self.first, now, strict=True)).__getitem__, self.runs)
        return "".join(self.pieces)


#: Question marks that stand for letters a code page lacked.
_LOST = re.compile(r"(?<=[^\W\d_])\?+(?=[^\W\d_])|(?<=[^\W\d_])\?+(?=\s*[,;:)–]|\s+[a-zà-ÿđ])|(?:(?<=\s)|^)\?+(?=[^\W\d_])")
# The bytes that Windows-1252 doesn't define; their characters get lost as U+FFFD.
UNDEFINED_1252 = "\x9d\x81\x8d\x90\x8f"


_VIETNAMESE_ONLY = re.compile("[ạảấầậắặẹẻếềểễệịỉọỏốồổộớờợụủứừựđơư]")
_BEYOND_ENGLISH = re.compile("[^\\x00-\\x7f–“”‘’]")


class Describer:
    """Description lengths of texts under one dictionary per language."""

    def __init__(self, dictionaries: dict[str, bytes]):
        kind = zstandard.DICT_TYPE_AUTO
        self.by = [zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(d, dict_type=kind), write_content_size=False, write_checksum=False, write_dict_id=False) for _, d in sorted(dictionaries.items()) if d] or [zstandard.ZstdCompressor(level=LEVEL)]

    def bits(self, text: str) -> int:
        named = SCRIPT_BITS * bool(_CONTROL.search(text))  # no sound text holds any
        rare = set(_RARE.findall(text))
        if rare:
            named += SCRIPT_BITS * len({script for c in rare if (script := _script(c))})
            if max(rare) >= "\u0800":  # once a script is named, each of its characters takes two bytes, wherever its block is
                parts = (t.encode("utf-16-be" if i & 1 else "utf-8", "surrogatepass") for i, t in enumerate(_THREE_BYTES.split(text)))
                return 8 * self._bytes_of(b"".join(parts)) + named
        return 8 * self._bytes_of(text.encode("utf-8", "surrogatepass")) + named

    def _bytes_of(self, raw: bytes) -> int:
        return min(len(c.compress(raw)) for c in self.by)

    def best(self, text: str) -> tuple[str, list[str]]:
        """The restored text and the chain of steps undone, outermost first; (text, []) if none pays.

        Every different text that some chain leads to is measured, once, under its shortest chain.
        """
        best, chosen, seen, whole = self.bits(text), (text, []), {text}, _Text(text)
        frontier: list[tuple[_Text, tuple[str, ...], str, list[str]]] = [(whole, whole.first, text, [])]
        tried = {(id(whole), whole.first)}
        for depth in range(1, MAX_STEPS + 1):
            grown = []
            for of, now, t, chain in frontier:
                for codec in MISREAD_AS:
                    after = tuple(map(_UNDO[codec], now))
                    if (id(of), after) not in tried:
                        tried.add((id(of), after))
                        grown.append((of, after, of.joined(after), [*chain, f"utf-8 as {codec}"]))
                if (u := undo_tcvn3(t)) != t:
                    made = _Text(u)
                    grown.append((made, made.first, u, [*chain, "tcvn3 as cp1252"]))
            frontier = []
            for x in grown:
                if x[2] not in seen:
                    seen.add(x[2])
                    frontier.append(x)
                    if (bits := self.bits(x[2]) + STEP_BITS * depth) < best:
                        best, chosen = bits, (x[2], x[3])
        return chosen

    def lost(self, text: str) -> bool:
        """Whether question marks in and at words stand for letters: naming these describes the text in fewer bits.

        A place pays what the best letter saves there, beyond the cost of naming it; together they must pay for a step.
        """
        paid = 0
        for m in _LOST.finditer(text):
            for i in range(m.start(), m.end()):
                before, after = text[max(0, i - 20) : i], text[i + 1 : i + 21]
                paid += max(0, self.bits(before + "?" + after) - LOST_BITS - min(self.bits(before + c + after) for c in VIETNAMESE))
                if paid > STEP_BITS:
                    return True
        return False

    def restore(self, text: str) -> tuple[str, list[str], bool]:
        """The restored text, the chain, and whether characters were lost for good."""
        guess = text
        if "�" in text:  # a lost byte is one of five: each place takes the one that describes its surroundings best
            while (i := guess.find("�")) >= 0:
                a, b = guess[max(0, i - 24) : i], guess[i + 1 : i + 25].replace("�", "")
                tries = [(self.bits(u), k, u_) for k, u_ in enumerate(UNDEFINED_1252) if (u := undo_utf8(a + u_ + b, "cp1252")) and u_ not in u]
                guess = guess[:i] + (min(tries)[2] if tries else "\0") + guess[i + 1 :]
            guess = guess.replace("\0", "�")
        restored, chain = self.best(guess)
        if not chain:
            restored = text
        lost = "�" in text or "?" in text and self.lost(text)
        return restored, chain + ["lost characters"] * lost, lost


def train_dictionaries(df: DataFrame, id_col: str = "sample_id", text_col: str = "text") -> dict[str, bytes]:
    """One dictionary per language from at most ``SAMPLE_TEXTS`` different texts of 40 to 2000 characters: those least by a hash.

    Only texts without a suspicious character train: those with a letter that only Vietnamese has, and those in ASCII and
    quotation marks as English. The bound keeps what reaches the driver at a few MB at any size of the input; tasks only
    send texts whose hash is likely to be among the least.
    """
    every = df.count()
    share = max(1, min(1 << 20, -(-(4 * SAMPLE_TEXTS << 20) // max(every, 1))))
    texts = df.select(F.col(text_col).alias("t"), F.xxhash64(text_col).alias("h")).where(F.length("t").between(40, 2000) & (F.pmod("h", F.lit(1 << 20)) < share))
    once = texts.groupBy("h").agg(F.first("t").alias("t"))  # a text of many copies counts once
    sample = [r.t for r in once.orderBy(F.pmod("h", F.lit(1 << 20)), "h").limit(SAMPLE_TEXTS).collect()]
    clean = sorted({t for t in sample if not GATE.search(t)})
    out = {}
    for name, some in (("vi", [t for t in clean if _VIETNAMESE_ONLY.search(t)]), ("en", [t for t in clean if not _BEYOND_ENGLISH.search(t)])):
        raw = [t.encode() for t in some]
        try:
            out[name] = zstandard.train_dictionary(DICT_BYTES, raw).as_bytes()
        except zstandard.ZstdError:  # too few texts to train: they serve as the dictionary
            out[name] = b"\n".join(raw)[-DICT_BYTES:]
    return out


def restore_texts(df: DataFrame, id_col: str = "sample_id", text_col: str = "text", dictionaries: dict[str, bytes] | None = None) -> DataFrame:
    """Rows whose text was decoded wrongly, wholly or in part: (id_col, restored string, chain array<string>, lossy boolean).

    Null, empty and sound texts give no row; an empty input gives an empty result; a repeated row gives a row each time;
    extra columns are ignored. Where bytes were lost the row is given with what could be had back.
    """
    dictionaries = train_dictionaries(df, id_col, text_col) if dictionaries is None else dictionaries
    kind = df.schema[id_col].dataType.simpleString()

    def repair(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        describer = Describer(dictionaries)
        for b in batches:
            rows = []
            for i, t in zip(b["id"], b["t"], strict=True):
                if not GATE.search(t):
                    continue
                restored, chain, lost = describer.restore(t)
                if chain:
                    rows.append((i, restored, chain, lost))
            yield pd.DataFrame(rows, columns=[id_col, "restored", "chain", "lossy"])

    # ids travel as strings: pandas would turn whole numbers among nulls into floats
    texts = df.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("t")).where("t <> ''")
    made = texts.mapInPandas(repair, f"`{id_col}` string, restored string, chain array<string>, lossy boolean")
    return made.withColumn(id_col, F.col(id_col).cast(kind))
