"""Evaluation texts that leak into a training corpus (problem 8).

Winnowing: of every ``window`` consecutive k-word grams of a text the one of least hash is kept, with k + window - 1 equal
to the shared span to be found, so that every span of that many words in both texts leaves a common fingerprint. Document
fingerprints are joined with those of the items; each hit is extended word by word in both directions, which gives the
exact span and discards hits that stay too short.

Words are compared without case and accents. The item index is broadcast only up to ``BROADCAST_WORDS`` words and
``BROADCAST_BYTES`` of items. Beyond that nothing but hashes and places is shuffled: fingerprints that both sides hold tell
where to look, and there the spans of full length around them are joined, so a stock phrase that is shorter than a span
brings no pair together however often it occurs; spans in a row on both sides are one run.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from veriscope.llm.shingles import chunks, grams, words
from veriscope.llm.textforms import canonical
from veriscope.session import staged

SPAN, GRAM = 12, 6
BROADCAST_WORDS, BROADCAST_BYTES = 2_000_000, 32 << 20
#: Hits extended at once, which bounds memory whatever a text repeats.
HITS_AT_ONCE = 1 << 18


@cache
def fold_table() -> np.ndarray:
    """Code point to the one it is compared as: lower case, without accents, d for đ."""
    table = np.arange(0x110000, dtype=np.uint32)
    for o in [*range(0x41, 0x3000), *range(0xA640, 0xABC0), *range(0x10400, 0x10450)]:
        c = unicodedata.normalize("NFD", chr(o).lower())
        base = [x for x in c if not unicodedata.combining(x)]
        if len(base) == 1:
            table[o] = ord("d" if base[0] == "đ" else base[0])
    return table


_MARKS = {o: None for o in range(0x300, 0x370)}


def comparable(text: str) -> str:
    """The consistent form, without the accents that no letter takes up."""
    t = canonical(text)
    return t if t.isascii() or not any("\u0300" <= c <= "\u036f" for c in set(t)) else t.translate(_MARKS)


class Prints:
    """Words and winnowed fingerprints of some texts."""

    def __init__(self, texts: list[str], span: int, k: int):
        fold, w = fold_table(), span - k + 1
        texts = [comparable(t) for t in texts]
        made = [words(texts[lo:hi], fold) for lo, hi in chunks([len(t) for t in texts])]
        self.words = np.concatenate([np.empty(0, np.uint64), *(h for h, _ in made)])
        size = np.concatenate([np.empty(0, np.int64), *(np.diff(s) for _, s in made)])
        self.start = np.concatenate([[0], np.cumsum(size)])
        g, at = grams(self.words, self.start, k)
        count = np.diff(at)
        doc = np.repeat(np.arange(len(texts)), count)
        place = np.arange(len(g)) - np.repeat(at[:-1], count)
        # least hash of the window that starts at each gram; windows that pass the end of a text are void
        top = np.uint64(2**64 - 1)
        least = np.full(len(g), top)
        if len(g) >= w:
            full = np.lib.stride_tricks.sliding_window_view(g, w).min(axis=1)
            ok = (place + w <= np.repeat(count, count))[: len(full)]
            least[: len(full)] = np.where(ok, full, top)
        # a gram is kept if it is the least of one of the windows that hold it, that is, equals the greatest such minimum
        kept = np.zeros(len(g), bool)
        for back in range(w):
            m = least[: len(g) - back] if back else least
            kept[back:] |= (g[back:] == m) & (place[back:] >= back)
        self.hash, self.doc, self.place = g[kept], doc[kept], place[kept]


class ItemIndex:
    """Fingerprints of the items in order of hash, and the items' words."""

    def __init__(self, ids: np.ndarray, prints: Prints):
        order = np.argsort(prints.hash, kind="stable")
        self.ids, self.words, self.start = ids, prints.words, prints.start
        self.hash, self.at, self.item = prints.hash[order], (prints.start[prints.doc] + prints.place)[order], prints.doc[order]

    def leaks(self, p: Prints, span: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(document, item, length of the longest shared run seen) for runs of at least ``span`` words."""
        lo, hi = np.searchsorted(self.hash, p.hash), np.searchsorted(self.hash, p.hash, side="right")
        hits = np.flatnonzero(hi > lo)
        while len(hits):
            ends = np.cumsum(hi[hits] - lo[hits])
            take = max(1, int(np.searchsorted(ends, HITS_AT_ONCE, side="right")))
            now, hits = hits[:take], hits[take:]
            many = hi[now] - lo[now]
            i = np.repeat(now, many)
            j = np.arange(len(i)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(lo[now], many)
            doc, item = p.doc[i], self.item[j]
            x, y = p.start[doc] + p.place[i], self.at[j]
            run = np.zeros(len(i), np.int64)
            for step, open_ in ((1, np.arange(len(i))), (-1, np.arange(len(i)))):
                far = 0 if step > 0 else -1
                while len(open_):
                    a, b = x[open_] + far, y[open_] + far
                    inside = (a < p.start[doc[open_] + 1]) & (b < self.start[item[open_] + 1]) if step > 0 else (a >= p.start[doc[open_]]) & (b >= self.start[item[open_]])
                    open_, a, b = open_[inside], a[inside], b[inside]
                    open_ = open_[p.words[a] == self.words[b]]
                    run[open_] += 1
                    far += step
            ok = run >= span
            yield doc[ok], item[ok], run[ok]


def _rows(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return df.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).where(F.col("id").isNotNull() & F.col("t").rlike(r"[\p{L}\p{N}]"))


def leaked_items(docs: DataFrame, items: DataFrame, doc_col: str = "doc_id", item_col: str = "item_id", text_col: str = "text", span: int = SPAN, gram: int = GRAM, broadcast_words: int = BROADCAST_WORDS) -> DataFrame:
    """(doc_col, item_col, words): documents that hold at least ``span`` consecutive words of an item, and how many.

    Null ids, null and empty texts and items of fewer words leak nothing; repeated rows give a pair once, with its longest run; an
    empty table gives an empty result; extra columns are ignored.
    """
    small = _rows(items, item_col, text_col)
    doc_kind, item_kind = docs.schema[doc_col].dataType.simpleString(), items.schema[item_col].dataType.simpleString()
    schema = f"`{doc_col}` {doc_kind}, `{item_col}` {item_kind}, words int"
    size = small.agg(F.coalesce(F.sum(F.regexp_count("t", F.lit(r"[\p{L}\p{N}]+"))), F.lit(0)), F.coalesce(F.sum(F.octet_length("t")), F.lit(0))).first()
    corpus = _rows(docs, doc_col, text_col)
    if size[0] <= broadcast_words and size[1] <= BROADCAST_BYTES:
        rows = small.toPandas()  # bounded by the check
        index = ItemIndex(rows["id"].values, Prints(rows["t"].tolist(), span, gram))
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                for lo, hi in chunks(b["t"].str.len().tolist()):
                    p, ids = Prints(b["t"].iloc[lo:hi].tolist(), span, gram), b["id"].values[lo:hi]
                    for doc, item, run in shared.value.leaks(p, span):
                        yield pd.DataFrame({doc_col: ids[doc], item_col: shared.value.ids[item], "words": run.astype(np.int32)})

        found = corpus.mapInPandas(search, schema)
    else:

        def prints(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                for lo, hi in chunks(b["t"].str.len().tolist()):
                    p = Prints(b["t"].iloc[lo:hi].tolist(), span, gram)
                    yield pd.DataFrame({"id": b["id"].values[lo:hi][p.doc], "h": p.hash.view(np.int64)}).drop_duplicates()

        def spans_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            """The full spans that hold a fingerprint of the other side."""
            for b in batches:
                for lo, hi in chunks(b["t"].str.len().tolist()):
                    p = Prints(b["t"].iloc[lo:hi].tolist(), span, gram)
                    met = [np.frombuffer(np.array(x, np.int64).tobytes(), np.uint64) for x in b["hs"].iloc[lo:hi]]
                    of = np.repeat(np.arange(hi - lo), [len(x) for x in met])
                    seek, known = np.stack([of.astype(np.uint64), np.concatenate([np.empty(0, np.uint64), *met])], 1), np.stack([p.doc.astype(np.uint64), p.hash], 1)
                    pair = np.dtype([("d", "u8"), ("h", "u8")])
                    hit = np.isin(np.ascontiguousarray(known).view(pair).reshape(-1), np.ascontiguousarray(seek).view(pair).reshape(-1))
                    g, at = grams(p.words, p.start, span)
                    doc, place = p.doc[hit], p.place[hit]
                    many = np.diff(at)[doc]
                    first, last = np.maximum(place - (span - gram), 0), np.minimum(place, many - 1)
                    count = np.maximum(last - first + 1, 0)
                    k = np.repeat(np.arange(len(doc)), count)
                    where = first[k] + np.arange(len(k)) - np.repeat(np.cumsum(count) - count, count)
                    yield pd.DataFrame({"id": b["id"].values[lo:hi][doc[k]], "s": g[at[doc[k]] + where].view(np.int64), "place": where}).drop_duplicates()

        def near(rows: DataFrame, mine: DataFrame, other: DataFrame, name: str, kind: str) -> DataFrame:
            """(name, s, place) of one side's spans around the fingerprints that the other side has too."""
            found = mine.join(other.select("h").distinct(), "h", "left_semi").groupBy("id").agg(F.collect_set("h").alias("hs"))
            return rows.join(found, "id").mapInPandas(spans_of, f"id {kind}, s bigint, place bigint").distinct().select(F.col("id").alias(name), "s", F.col("place").alias(f"{name}_at"))

        a, b = staged(corpus.mapInPandas(prints, f"id {doc_kind}, h bigint"), "prints"), staged(small.mapInPandas(prints, f"id {item_kind}, h bigint"), "prints")
        both = near(corpus, a, b, "d", doc_kind).join(near(small, b, a, "i", item_kind), "s").select("d", "i", "d_at", (F.col("d_at") - F.col("i_at")).alias("shift")).distinct()
        # spans in a row on both sides: their places less their rank stay the same
        run = F.col("d_at") - F.row_number().over(Window.partitionBy("d", "i", "shift").orderBy("d_at"))
        found = both.withColumn("run", run).groupBy("d", "i", "shift", "run").agg((F.count("*") + F.lit(span - 1)).cast("int").alias("words")).select(F.col("d").alias(doc_col), F.col("i").alias(item_col), "words")
    return found.groupBy(doc_col, item_col).agg(F.max("words").alias("words"))
