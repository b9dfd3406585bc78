"""Look-alike characters from the public Unicode confusables data.

Spark itself carries that data, compiled, in its ICU library; it is read from there, or from a library or data file named
in the environment as ``VERISCOPE_CONFUSABLES``. Nothing of it is kept in this package.
"""

from __future__ import annotations

import glob
import os
import struct
import unicodedata
import zipfile
from functools import cache

#: Scripts whose letters are told from Latin ones by the eye no better than those of the data.
SCRIPTS = ("CYRILLIC", "GREEK", "COPTIC", "ARMENIAN", "CHEROKEE", "LISU")
# Letters that the data leaves out or sees otherwise.
OVERRIDES = {"ӏ": "l", "Ð": "Đ", "Ɖ": "Đ"}
_MEMBER, _MAGIC = "com/ibm/icu/impl/data/icudata/confusables.cfu", 0x3845FDEF


def _data() -> bytes:
    import pyspark

    here = os.path.dirname(os.path.abspath(pyspark.__file__))
    named = os.environ.get("VERISCOPE_CONFUSABLES")
    places = [named] if named else [p for d in (os.path.join(here, "jars"), os.path.join(os.environ.get("SPARK_HOME", here), "jars"), os.path.join(here, "..", "..", "jars")) for p in sorted(glob.glob(os.path.join(d, "icu4j-*.jar")))]
    for p in places:
        if zipfile.is_zipfile(p):
            with zipfile.ZipFile(p) as z:
                return z.read(_MEMBER)
        with open(p, "rb") as f:
            return f.read()
    raise FileNotFoundError("no ICU library beside Spark: name one, or its confusables.cfu, in VERISCOPE_CONFUSABLES")


@cache
def prototypes() -> dict[str, str]:
    """Every character of the data and what it looks like."""
    raw = _data()
    raw = raw[struct.unpack(">H", raw[:2])[0] :]
    magic, _, _, keys_at, keys, values_at, values, text_at, size = struct.unpack(">9I", raw[:36])
    if magic != _MAGIC:
        raise ValueError("not confusables data")
    text = raw[text_at : text_at + 2 * size].decode("utf-16-be", "surrogatepass")
    out = {}
    for k, v in zip(struct.unpack(f">{keys}I", raw[keys_at : keys_at + 4 * keys]), struct.unpack(f">{values}H", raw[values_at : values_at + 2 * values]), strict=True):
        length = (k >> 24) + 1
        out[chr(k & 0xFFFFFF)] = chr(v) if length == 1 else text[v : v + length]
    return out


def script(c: str) -> str:
    return unicodedata.name(c, "").partition(" ")[0]


@cache
def letters() -> dict[str, dict[str, str]]:
    """By script, its letters that look like one Latin letter, and which; LATIN: variants of Latin letters.

    The data has one prototype for I and l, which case tells apart: a capital one is an I. Of the Latin block only letters
    that are another's small capital or a lone Roman numeral are taken, and g and a of the other shape; letters with a
    missing dot or a hook show a difference.
    """
    out: dict[str, dict[str, str]] = {s: {} for s in (*SCRIPTS, "LATIN")}
    for c, p in sorted(prototypes().items()):
        kind, name = unicodedata.category(c), unicodedata.name(c, "")
        if len(p) == 1 and p.isascii() and p.isalpha() and ord(c) > 0x7F and kind in ("Lu", "Ll", "Lo"):
            looks = "I" if p == "l" and kind != "Ll" else p
            if script(c) in SCRIPTS:
                out[script(c)][c] = looks
            elif name in ("LATIN SMALL LETTER SCRIPT G", "LATIN SMALL LETTER ALPHA") or name.startswith("LATIN LETTER SMALL CAPITAL ") and name[-2:] == f" {p.upper()}":
                out["LATIN"][c] = looks
    for o in range(0x2160, 0x2180):
        if len(n := unicodedata.normalize("NFKC", chr(o))) == 1:
            out["LATIN"][chr(o)] = n
    for c, p in OVERRIDES.items():
        out[script(c)][c] = p
    return out
