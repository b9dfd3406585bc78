"""One consistent form for texts that look the same (problem 1).

Characters that show alike are brought to one spelling in four steps: invisible characters go, width and space
variants become plain, look-alike letters become their Latin prototype on the decomposed text, and each token is
then written in the script that all its letters resolve to. The last step only depends on the prototypes, so two
texts that look the same always end up equal; letters of a script that has no Latin look-alike keep a token in
that script, so genuine Cyrillic, Greek or Armenian words stay what they are.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from veriscope.llm.confusables import letters, script
from veriscope.session import staged

# Hyphens of one position, and characters that show nothing.
HYPHENS = "‐‑﹣－"
INVISIBLE_EXTRA = "­͏؜ᅟᅠ឴឵᠋᠌᠍᠎᠏ㅤﾠ"

LATIN_VARIANTS = letters()["LATIN"]
SCRIPTS = {s: m for s, m in letters().items() if s != "LATIN"}


def _invisible(c: str) -> bool:
    o = ord(c)
    return c in INVISIBLE_EXTRA or unicodedata.category(c) == "Cf" and not 0x600 <= o <= 0x6DD or 0xFE00 <= o <= 0xFE0F or 0xE0100 <= o <= 0xE01EF


def _plain(c: str) -> str | None:
    """What a character shows as, where that differs from itself; None: keep it."""
    if _invisible(c):
        return ""
    if c in HYPHENS:
        return "-"
    if unicodedata.category(c) == "Zs":
        return " "
    kind = unicodedata.decomposition(c).partition(" ")[0]
    if kind in ("<wide>", "<narrow>") or 0xFB00 <= ord(c) <= 0xFB06:
        return unicodedata.normalize("NFKC", c)
    return None


#: The planes that have such characters: beyond them lie ideographs and unassigned numbers.
PLAIN = {o: p for o in (*range(0x80, 0x20000), *range(0xE0000, 0xE1000)) if (p := _plain(chr(o))) is not None}
PROTOTYPE = {ord(a): b for m in letters().values() for a, b in m.items()}
#: Latin letter -> the scripts that have a letter of its looks.
RESOLVED = {b: {s for s, m in SCRIPTS.items() if b in m.values()} for m in SCRIPTS.values() for b in m.values()}
SPELLING = {s: {b: a for a, b in reversed(m.items())} for s, m in SCRIPTS.items()}


def _inert(c: str) -> bool:
    d = unicodedata.normalize("NFD", c)
    return ord(c) not in PLAIN and unicodedata.normalize("NFC", c) == c and not unicodedata.combining(c) and not any(ord(x) in PROTOTYPE for x in d) and script(c) not in SCRIPTS and not 0x1100 <= ord(c) <= 0x11FF


def _ranges(codes: list[int]) -> str:
    out, i = [], 0
    while i < len(codes):
        j = i
        while j + 1 < len(codes) and codes[j + 1] == codes[j] + 1:
            j += 1
        out.append(f"\\U{codes[i]:08x}-\\U{codes[j]:08x}")
        i = j + 1
    return "".join(out)


#: Finds a character that may have to change; most texts have none and are returned as they are.
ACTIVE = re.compile("[^" + _ranges([o for o in range(0x2600) if _inert(chr(o)) and o != 0x0D]) + "]")
_TOKEN = re.compile(r"[^\W\d_](?:[^\W\d_]|[\u0300-\u036f])*")
_LETTERS = "".join(f"\\U{o:08x}" for o in range(0x370, 0x1F000) if script(chr(o)) in SCRIPTS)
_FOREIGN = re.compile(f"[{_LETTERS}]")
_FOREIGN_OR_VARIANT = re.compile(f"[{_LETTERS}{''.join(LATIN_VARIANTS)}]")
_PLAIN = re.compile("\r\n|[" + _ranges(sorted(PLAIN)) + "]")
_PROTOTYPE = re.compile("[" + "".join(map(chr, PROTOTYPE)) + "]")


def _plain_of(match: re.Match) -> str:
    return "\n" if match[0] == "\r\n" else PLAIN[ord(match[0])]


def _prototype_of(match: re.Match) -> str:
    return PROTOTYPE[ord(match[0])]



def resolved(token: str) -> set[str]:
    """The scripts other than Latin that can spell a decomposed token: the intersection of its letters' script sets.

    A letter that looks like a Latin one is of all scripts with such a letter; any other letter only of its own.
    """
    fit = set(SCRIPTS)
    for c in token:
        if not unicodedata.combining(c):
            own = script(c)
            fit &= {own} if own in SCRIPTS else RESOLVED.get(c, set())
    return fit


def _spell(match: re.Match) -> str:
    """A token with letters that only other scripts have is written in the script that can spell all of it, if one can."""
    token = match[0]
    if not _FOREIGN.search(token):
        return token
    fit = resolved(token)
    return "".join(SPELLING[min(fit)].get(c, c) for c in token) if fit else token


def confusable(token: str) -> tuple[str, list[str]] | None:
    """Whether a token as stored is confusable: (``mixed`` or ``whole``, its scripts), or none.

    Mixed: its letters are of several scripts, and one script can spell it. Whole: all are of one script other than Latin,
    and Latin letters look the same. A word that only its own script can spell is none, nor is one that no script can.
    """
    plain = unicodedata.normalize("NFD", _PLAIN.sub(_plain_of, token))
    own = {script(c) if script(c) in SCRIPTS else "LATIN" for c in plain if c.isalpha()}
    if own <= {"LATIN"}:
        return None
    prototype = _PROTOTYPE.sub(_prototype_of, plain)
    if not _FOREIGN.search(prototype):  # Latin letters can spell it
        return ("whole" if len(own) == 1 else "mixed", sorted(own))
    return ("mixed", sorted(own)) if len(own) > 1 and resolved(prototype) else None


def canonical(text: str | None) -> str | None:
    """The consistent form of ``text``: a null stays null, a text without active characters is returned unchanged.

    Case, accents, wording, line breaks (``\\r\\n`` shows as ``\\n``), dashes and the number of spaces are kept.
    """
    if text is None or not ACTIVE.search(text):
        return text
    t = _PLAIN.sub(_plain_of, text)
    if not _FOREIGN_OR_VARIANT.search(t):
        return unicodedata.normalize("NFC", t)
    t = _PROTOTYPE.sub(_prototype_of, unicodedata.normalize("NFD", t))
    if _FOREIGN.search(t):
        t = _TOKEN.sub(_spell, t)
    return unicodedata.normalize("NFC", t)


@F.pandas_udf(StringType())
def _canonical(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in texts:
        yield pd.Series([canonical(t) if isinstance(t, str) else None for t in s], index=s.index, dtype=object)


def consistent_form(text: Column) -> Column:
    """Column of :func:`canonical` texts (Arrow batches)."""
    return _canonical(text)


def confusable_tokens(df: DataFrame, id_col: str = "sample_id", text_col: str = "text") -> DataFrame:
    """(id_col, token, kind, scripts, spelling): every different token of a row that is mixed-script or whole-script
    confusable, as in ``confusable``, with its consistent spelling.

    Null and empty texts give no row, a repeated row gives its tokens each time, an empty input gives an empty result; extra
    columns are ignored. Rows never leave their partition.
    """
    kind = df.schema[id_col].dataType.simpleString()

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for i, t in zip(b["id"], b["t"], strict=True):
                if _FOREIGN.search(t):
                    for token in dict.fromkeys(_TOKEN.findall(t)):
                        if _FOREIGN.search(token) and (c := confusable(token)):
                            rows.append((i, token, *c, canonical(token)))
            yield pd.DataFrame(rows, columns=[id_col, "token", "kind", "scripts", "spelling"])

    # ids travel as strings: pandas would turn whole numbers among nulls into floats
    made = df.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("t")).where("t <> ''").mapInPandas(find, f"`{id_col}` string, token string, kind string, scripts array<string>, spelling string")
    return made.withColumn(id_col, F.col(id_col).cast(kind))


def lookalike_pairs(df: DataFrame, id_col: str = "sample_id", text_col: str = "text") -> DataFrame:
    """Pairs of rows whose stored texts differ but have the same consistent form: ``sample_a < sample_b``.

    Null texts and texts without a letter or digit give no pair; equal stored texts are no case; ids repeated
    with the same text count once. An empty input gives an empty result, and extra columns are ignored.

    Only forms with two or more different stored texts go on, and of those the different texts are paired, by hash, before
    the ids join: a text's copies, however many, are never compared with each other. Texts travel as 64-bit hashes of both
    forms (two independent hashes of the form), never themselves.
    """
    t = F.col(text_col)
    rows = (
        df.select(F.col(id_col).alias("id"), t.alias("t"))
        .where(F.col("id").isNotNull() & t.rlike(r"[\p{L}\p{N}]"))
        .withColumn("c", consistent_form(F.col("t")))
        .select("id", F.xxhash64("c").alias("k"), F.hash("c").alias("k2"), F.xxhash64("t").alias("h"))
    )
    rows = staged(rows, "forms")  # hashes alone, so that texts are read and normalised once
    several = rows.groupBy("k", "k2").agg(F.min("h").alias("lo"), F.max("h").alias("hi")).where("lo <> hi").select("k", "k2")
    few = rows.join(several, ["k", "k2"], "left_semi")
    texts = few.select("k", "k2", "h").distinct()
    pairs = texts.withColumnRenamed("h", "ha").join(texts.withColumnRenamed("h", "hb"), ["k", "k2"]).where("ha < hb")
    ids = few.select("k", "h", "id").distinct()
    a, b = ids.select("k", F.col("h").alias("ha"), F.col("id").alias("a")), ids.select("k", F.col("h").alias("hb"), F.col("id").alias("b"))
    met = pairs.join(a, ["k", "ha"]).join(b, ["k", "hb"]).where("a <> b")
    return met.select(F.least("a", "b").alias("sample_a"), F.greatest("a", "b").alias("sample_b")).distinct()
