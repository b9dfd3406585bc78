"""Encoding of texts with a public byte-level BPE vocabulary (problem 7).

Texts are cut into words by the vocabulary's own pattern; each different word of a partition is merged once, by a
recursive DuckDB query over token-position rows: every step joins the neighbouring tokens with the merge table and
contracts each word's pair of least rank, leftmost first, wherever it occurs, until no pair is left. (A pair that holds a
contracted token ranks later, so one occurrence after the other would lead to the same tokens.) Only rows of words that
still change are carried on. Long words are first cut where no token of the vocabulary can span, which changes nothing
either. Words already merged are remembered by the worker, so the work follows the number of different words. Decoding is
an ordered aggregation of the tokens' bytes. Nothing is trained and no vocabulary is copied: the path of the file is a
parameter.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"
#: Words that a worker remembers, and characters encoded at once; both only bound memory.
REMEMBERED, CHARS_AT_ONCE, BYTES_AT_ONCE = 2_000_000, 4_000_000, 500_000
#: Bytes over which a word is cut before it is merged; shorter ones aren't worth the look.
LONG_WORD = 64

# Fixed value: the public pattern that cuts texts into words for this vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: The same in the standard library's faster syntax, for texts without the characters that its classes see otherwise.
_FAST = re.compile(r"'(?:[stmd]|re|ve|ll)| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
_UNLIKE: re.Pattern | None = None


def _unlike() -> re.Pattern:
    """Characters of which the two syntaxes differ in class."""
    global _UNLIKE
    if _UNLIKE is None:
        import regex
        import sys

        every = "".join(map(chr, [*range(0xD800), *range(0xE000, sys.maxunicode + 1)]))
        a = [set(regex.findall(p, every)) for p in (r"\p{L}", r"\p{N}", r"\s")]
        b = [set(re.findall(p, every)) for p in (r"[^\W\d_]", r"\d", r"\s")]
        odd = sorted(set().union(*(x ^ y for x, y in zip(a, b, strict=True))))
        runs: list[list[int]] = []
        for o in map(ord, odd):
            if runs and runs[-1][1] == o - 1:
                runs[-1][1] = o
            else:
                runs.append([o, o])
        _UNLIKE = re.compile("[" + "".join(f"\\U{x:08x}-\\U{y:08x}" for x, y in runs) + "]")
    return _UNLIKE


def _byte_letters() -> dict[int, str]:
    """The letter by which byte-level vocabularies write each byte: itself where it can be seen, else from U+0100 on."""
    seen = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out = {b: chr(b) for b in seen}
    for b in range(256):
        if b not in out:
            out[b] = chr(0x100 + len(out) - len(seen))
    return out


class Encoder:
    """One vocabulary with its merge table in a DuckDB connection of this process."""

    STEP = """
        WITH RECURSIVE state(word, place, token, done) AS (
            SELECT word, place, token, false FROM start
            UNION ALL (
                WITH open AS (SELECT word, place, token FROM state WHERE NOT done),
                next AS (SELECT word, place, token, lead(token) OVER w AS other, lead(place) OVER w AS gone FROM open WINDOW w AS (PARTITION BY word ORDER BY place)),
                pair AS (SELECT n.word, n.place, n.gone, m.rank, m.merged, m.a = m.b AS twins FROM next n JOIN merges m ON n.token = m.a AND n.other = m.b),
                best AS (SELECT word, min(rank) AS rank FROM pair GROUP BY word),
                now AS (SELECT p.* FROM pair p JOIN best b ON p.word = b.word AND p.rank = b.rank),
                apart AS (
                    SELECT word, place, gone, merged FROM now WHERE NOT twins
                    UNION ALL
                    SELECT word, place, gone, merged FROM (
                        SELECT *, row_number() OVER (PARTITION BY word, run ORDER BY place) AS k FROM (
                            SELECT *, sum(opens) OVER (PARTITION BY word ORDER BY place) AS run FROM (
                                SELECT *, CASE WHEN lag(gone) OVER (PARTITION BY word ORDER BY place) = place THEN 0 ELSE 1 END AS opens FROM now WHERE twins
                            )
                        )
                    ) WHERE k % 2 = 1
                )
                SELECT o.word, o.place, coalesce(c.merged, o.token), b.word IS NULL
                FROM open o LEFT JOIN best b ON o.word = b.word LEFT JOIN apart c ON o.word = c.word AND o.place = c.place LEFT JOIN apart g ON o.word = g.word AND o.place = g.gone
                WHERE g.word IS NULL
            )
        )
        SELECT word, token FROM state WHERE done ORDER BY word, place
    """

    def __init__(self, path: str):
        import duckdb

        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        ids = model["vocab"]
        letters = _byte_letters()
        self.of_byte = np.array([ids[letters[b]] for b in range(256)], np.int32)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.con = duckdb.connect(config={"threads": 1, "memory_limit": "400MB"})
        table = pa.table({"a": pa.array([ids[x] for x, _ in pairs], pa.int32()), "b": pa.array([ids[y] for _, y in pairs], pa.int32()), "rank": pa.array(range(len(pairs)), pa.int32()), "merged": pa.array([ids[x + y] for x, y in pairs], pa.int32())})
        self.con.register("given", table)
        self.con.execute("CREATE TABLE merges AS SELECT * FROM given")
        byte = {c: b for b, c in letters.items()}
        self.token_pair, self.inside = np.zeros(1 << 16, bool), np.zeros(1 << 24, bool)
        for x, y in pairs:
            t = [byte[c] for c in x + y]
            if len(t) == 2:
                self.token_pair[t[0] << 8 | t[1]] = True
            for i in range(len(t) - 2):
                self.inside[t[i] << 16 | t[i + 1] << 8 | t[i + 2]] = True
        self.number: dict[str, int] = {}
        self.flat, self.start = np.empty(0, np.int32), np.zeros(1, np.int64)

    def cut(self, word: bytes) -> list[bytes]:
        """A word's parts between places that no token spans: one that did would be the two bytes there, or hold them with
        the byte before or after."""
        b = np.frombuffer(word, np.uint8).astype(np.int32)
        pair = b[:-1] << 8 | b[1:]
        three = self.inside[pair[:-1] << 8 | b[2:]]
        spanned = self.token_pair[pair]
        spanned[1:] |= three
        spanned[:-1] |= three
        at = [0, *(np.flatnonzero(~spanned) + 1).tolist(), len(word)]
        return [word[i:j] for i, j in zip(at[:-1], at[1:], strict=True)]

    def learn(self, fresh: list[str]) -> None:
        """Merges words not met before and remembers their ids."""
        base, parts, index, counts = len(self.number), {}, [], []
        for w in fresh:
            raw = w.encode("utf-8", "surrogatepass")
            made = [raw] if len(raw) <= LONG_WORD else self.cut(raw)
            index += [parts.setdefault(p, len(parts)) for p in made]
            counts.append(len(made))
        flat, start = self.merge(list(parts))
        index, ends = np.array(index), np.cumsum(counts)
        sizes = start[index + 1] - start[index]
        total = np.concatenate([[0], np.cumsum(sizes)])
        tokens = flat[np.arange(total[-1]) + np.repeat(start[index] - total[:-1], sizes)]
        self.start = np.concatenate([self.start, self.start[-1] + total[ends]])
        self.flat = np.concatenate([self.flat, tokens])
        self.number.update((w, base + i) for i, w in enumerate(fresh))

    def merge(self, parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The tokens of all parts, and where each part starts (n + 1)."""
        tokens, starts, lo = [], [np.zeros(1, np.int64)], 0
        while lo < len(parts):
            hi, held = lo, 0
            while hi < len(parts) and (hi == lo or hi - lo < 20_000 and held + len(parts[hi]) <= BYTES_AT_ONCE):
                held += len(parts[hi])
                hi += 1
            some = parts[lo:hi]
            lo = hi
            sizes = np.array([len(w) for w in some])
            word = np.repeat(np.arange(len(some), dtype=np.int32), sizes)
            place = (np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)).astype(np.int32)
            start = pa.table({"word": word, "place": place, "token": self.of_byte[np.frombuffer(b"".join(some), np.uint8)]})
            self.con.register("start", start)
            got = self.con.execute(self.STEP).fetchnumpy()
            self.con.unregister("start")
            tokens.append(np.asarray(got["token"], np.int32))
            starts.append(starts[-1][-1] + np.cumsum(np.bincount(np.asarray(got["word"], np.int64), minlength=len(some))))
        return np.concatenate([np.empty(0, np.int32), *tokens]), np.concatenate(starts)

    def encode(self, texts: list[str | None]) -> pa.ListArray:
        """The ids of each text; a null and an empty text have none."""
        unlike = _unlike()
        found: list[str] = []
        counts = np.zeros(len(texts), np.int64)
        for i, t in enumerate(texts):
            if t:
                if unlike.search(t):
                    import regex

                    words = regex.findall(PATTERN, t)
                else:
                    words = _FAST.findall(t)
                counts[i] = len(words)
                found += words
        if len(self.number) > REMEMBERED:
            self.number, self.flat, self.start = {}, np.empty(0, np.int32), np.zeros(1, np.int64)
        fresh = [w for w in dict.fromkeys(found) if w not in self.number]
        if fresh:
            self.learn(fresh)
        index = np.fromiter(map(self.number.__getitem__, found), np.int64, len(found))
        sizes = self.start[index + 1] - self.start[index]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        flat = self.flat[np.arange(ends[-1]) + np.repeat(self.start[index] - ends[:-1], sizes)]
        return pa.ListArray.from_arrays(pa.array(ends[np.concatenate([[0], np.cumsum(counts)])], pa.int32()), pa.array(flat, pa.int32()))


_ENCODERS: dict[str, Encoder] = {}


def encode_texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """(id_col, ids): the token ids of each row's text, without special tokens; their names in a text are plain text.

    A null and an empty text both give an empty list; white space has ids of its own; a repeated row gives a row each
    time; an empty input gives an empty result; extra columns are ignored. Rows never leave their partition.
    """
    schema = StructType([StructField(id_col, df.schema[id_col].dataType), StructField("ids", ArrayType(IntegerType(), False), False)])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if vocabulary not in _ENCODERS:
            _ENCODERS[vocabulary] = Encoder(vocabulary)
        encoder = _ENCODERS[vocabulary]
        for b in batches:
            keys, texts = b.column(0), b.column(1).to_pylist()
            lo = 0
            while lo < len(texts):
                hi, chars = lo, 0
                while hi < len(texts) and (hi == lo or chars + len(texts[hi] or "") <= CHARS_AT_ONCE):
                    chars += len(texts[hi] or "")
                    hi += 1
                yield pa.RecordBatch.from_arrays([keys.slice(lo, hi - lo), encoder.encode(texts[lo:hi])], names=[id_col, "ids"])
                lo = hi

    return df.select(F.col(id_col), F.col(text_col)).mapInArrow(encode, schema)


def decode_ids(df: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", vocabulary: str = VOCABULARY) -> DataFrame:
    """(id_col, text): the text that each row's token ids stand for, by an ordered aggregation of the tokens' bytes.

    A null and an empty list give an empty text; an id that the vocabulary lacks is an error; bytes that aren't UTF-8, as of
    a list cut inside a letter, show as U+FFFD. A repeated row gives a row each time, an empty input an empty result; extra
    columns are ignored. Rows never leave their partition.
    """
    schema = StructType([StructField(id_col, df.schema[id_col].dataType), StructField("text", StringType(), False)])

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        with open(vocabulary, encoding="utf-8") as f:
            model = json.load(f)
        byte = {c: b for b, c in _byte_letters().items()}
        given = {**model["model"]["vocab"], **{t["content"]: t["id"] for t in model.get("added_tokens", [])}}
        added = {t["id"] for t in model.get("added_tokens", [])}
        raw = {i: t.encode() if i in added else bytes(byte[c] for c in t) for t, i in given.items()}
        con = duckdb.connect(config={"threads": 1, "memory_limit": "400MB"})
        names = pa.table({"id": pa.array(list(raw), pa.int64()), "bytes": pa.array([b.hex() for b in raw.values()])})
        con.register("given", names)
        con.execute("CREATE TABLE vocabulary AS SELECT * FROM given")
        for b in batches:
            lists = b.column(1).to_pylist()
            rows = pa.table({"row": pa.array([i for i, x in enumerate(lists) for _ in x or ()], pa.int64()), "place": pa.array([k for x in lists for k in range(len(x or ()))], pa.int64()), "id": pa.array([t for x in lists for t in x or ()], pa.int64())})
            con.register("tokens", rows)
            got = con.execute("SELECT row, string_agg(bytes, '' ORDER BY place), count(*) - count(bytes) FROM tokens LEFT JOIN vocabulary USING (id) GROUP BY row").fetchall()
            con.unregister("tokens")
            if any(unknown for _, _, unknown in got):
                raise ValueError("token ids that the vocabulary lacks")
            texts = {i: bytes.fromhex(h).decode("utf-8", "replace") for i, h, _ in got}
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([texts.get(i, "") for i in range(len(lists))])], names=[id_col, "text"])

    return df.select(F.col(id_col), F.col(ids_col)).mapInArrow(decode, schema)
