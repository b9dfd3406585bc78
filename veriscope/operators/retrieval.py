"""Search over texts and vectors, and the training sets of retrieval models."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from veriscope.functions import text as tx
from veriscope.session import staged

K1, B = 1.5, 0.75


#: Different terms of all queries up to which each document looks them up in its row; more are joined.
ROW_TERMS = 20_000


def bm25(queries: DataFrame, docs: DataFrame, query: str, doc: str, query_tokens: Column, doc_tokens: Column, top: int = 5) -> DataFrame:
    """(query, doc, score, rank): the best documents of each query by BM25, the least id on ties.

    Every document is tokenised once: its length and its counts of terms that queries hold are written down, and statistics,
    document frequencies and scores are made from those. Scores are combined before the ranking shuffle.
    """
    q = staged(queries.select(query, F.explode(F.array_distinct(query_tokens)).alias("term")), "queries")
    wanted = q.select("term").distinct()
    d = tx.once(docs.select(doc, doc_tokens.alias("_t")), _t=F.col("_t"))
    if wanted.count() <= ROW_TERMS:
        terms = wanted.agg(F.collect_list("term").alias("_wanted"))  # bounded by the check
        found = d.join(F.broadcast(terms)).select(doc, F.size("_t").alias("_len"), F.array_intersect("_t", F.coalesce("_wanted", F.array().cast("array<string>"))).alias("_f"), "_t")
        hits = F.when(F.size("_f") == 0, F.array().cast("array<struct<term:string,tf:int>>")).otherwise(F.filter(tx.counted(F.col("_t")), lambda x: F.array_contains("_f", x["term"])))
        rows = staged(found.select(doc, "_len", hits.alias("_h")), "documents")
    else:
        rows = staged(d.select(doc, F.size("_t").alias("_len"), tx.counted(F.col("_t")).alias("_h")), "documents")
    stats = rows.agg(F.count("*").alias("n"), F.avg("_len").alias("avg")).first()
    n, avg = float(stats.n), F.lit(float(stats.avg or 1.0))
    tf = rows.select(doc, "_len", F.inline("_h")).join(F.broadcast(wanted) if wanted.count() <= ROW_TERMS else wanted, "term", "left_semi")
    idf = tf.groupBy("term").agg(F.count("*").alias("_df"))
    weight = F.log(F.lit(1.0) + (F.lit(n) - F.col("_df") + 0.5) / (F.col("_df") + 0.5)) * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("_len") / avg))
    scores = tf.join(q.join(idf, "term"), "term").select(query, doc, weight.alias("w")).groupBy(query, doc).agg(F.sum("w").alias("score"))
    # rounded scores rank, so that the order of a sum can't swap ties
    w = Window.partitionBy(query).orderBy(F.desc(F.round("score", 9)), doc)
    return scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)


#: Standards that are broadcast at most; a larger knowledge base is searched (``bm25``), not compared row by row.
MOST_STANDARDS = 10_000


def few(standards: DataFrame) -> DataFrame:
    """The standards, once their number is known to be small enough to broadcast."""
    if (n := standards.count()) > MOST_STANDARDS:
        raise ValueError(f"{n} standards, at most {MOST_STANDARDS} can be compared row by row")
    return standards


def first_standard(docs: DataFrame, standards: DataFrame, key: str, ref: str) -> DataFrame:
    """(key, chunk_id): the first standard that holds a word of the reference, else the first of all. More than
    ``MOST_STANDARDS`` raise."""
    standards = few(standards)
    s = standards.select("chunk_id", F.lower(F.concat_ws(" ", "source", "article", "title")).alias("_hay"), F.col("position"))
    fallback = s.agg(F.min_by("chunk_id", "position").alias("_default"))
    d = docs.select(key, tx.ws_tokens(F.lower(F.coalesce(F.col(ref), F.lit("")))).alias("_w"))
    hit = d.join(F.broadcast(s), F.exists("_w", lambda w: F.col("_hay").contains(w)), "left").groupBy(key).agg(F.min_by("chunk_id", "position").alias("_c"))
    return hit.join(F.broadcast(fallback)).select(key, F.coalesce("_c", "_default").alias("chunk_id"))


def hard_negatives(positives: DataFrame, standards: DataFrame, key: str, n: int = 3, seed: str = "42") -> DataFrame:
    """(key, chunk_id, position): n other chunks per row in the order of a seeded hash.

    Chunks are drawn from an array of the small table inside each row, so no pairs are shuffled.
    """
    every = few(standards).agg(F.sort_array(F.collect_list("chunk_id")).alias("_all"))
    pick = F.slice(F.array_sort(F.transform(F.filter("_all", lambda c: c != F.col("chunk_id")), lambda c: F.struct(F.md5(F.concat_ws(":", F.col(key).cast("string"), c, F.lit(seed))).alias("h"), c.alias("c")))), 1, n)
    return positives.join(F.broadcast(every)).select(key, F.posexplode(pick).alias("position", "_x")).select(key, F.col("_x.c").alias("chunk_id"), "position")


#: Queries that meet all vectors in one pass, and those multiplied with a batch at once; both bound memory.
QUERY_BLOCK, QUERIES_AT_ONCE = 16_384, 512


def cosine_top(queries: DataFrame, vectors: DataFrame, key: str, vector: str, top: int = 5) -> DataFrame:
    """(query, key, score, rank): the nearest other vectors of each query by cosine, the least id on ties.

    Queries are a stated set. They go in blocks of ``QUERY_BLOCK``; each block is broadcast, every task keeps the best
    rows of its vectors for each query while it streams them, and only those are shuffled: vectors never are. Null and
    zero vectors, and those with a null id, are left out; a repeated id counts once per query.
    """
    kind = vectors.schema[key].dataType.simpleString()
    q = queries.where(F.col(vector).isNotNull() & F.col(key).isNotNull()).select(F.col(key).alias("_q"), F.col(vector).alias("_v")).dropDuplicates(["_q"])
    blocks = max(1, -(-q.count() // QUERY_BLOCK))
    base = vectors.where(F.col(vector).isNotNull() & F.col(key).isNotNull()).select(F.col(key).alias("_k"), F.col(vector).alias("_x"))
    found = None
    for b in range(blocks):
        rows = q.where(F.pmod(F.xxhash64("_q"), F.lit(blocks)) == b).toPandas()  # a block
        part = _nearest(base, rows, key, kind, top)
        found = part if found is None else found.union(part)
    w = Window.partitionBy("query").orderBy(F.desc(F.round("score", 9)), key)
    best = found.groupBy("query", key).agg(F.max("score").alias("score"))
    return best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)


def _nearest(base: DataFrame, rows: pd.DataFrame, key: str, kind: str, top: int) -> DataFrame:
    """The best ``top`` vectors of each task for each query of a block, without the query itself."""
    v = np.stack(rows["_v"].values).astype(float) if len(rows) else np.empty((0, 1))
    size = np.linalg.norm(v, axis=1)
    ids, v = rows["_q"].values[size > 0], v[size > 0] / size[size > 0, None]
    shared = base.sparkSession.sparkContext.broadcast((ids, v))

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        qs, v = shared.value
        kept: list[pd.DataFrame] = []
        for b in batches:
            b = b.drop_duplicates("_k").sort_values("_k")
            if not len(b) or not len(qs):
                continue
            k, x = b["_k"].values, np.stack(b["_x"].values).astype(float)
            norm = np.linalg.norm(x, axis=1)
            k, x = k[norm > 0], x[norm > 0] / norm[norm > 0, None]
            for lo in range(0, len(qs), QUERIES_AT_ONCE):
                s = v[lo : lo + QUERIES_AT_ONCE] @ x.T
                # one whole number orders by score to nine places, then by id
                order = ((np.round(s * 1e9).astype(np.int64) + 2 * 10**9) << 30) - np.arange(len(k))
                order[qs[lo : lo + QUERIES_AT_ONCE, None] == k[None, :]] = -1
                n = min(top, len(k))
                at = np.argpartition(-order, n - 1, axis=1)[:, :n] if n else np.empty((len(s), 0), int)
                r, c = np.nonzero(np.take_along_axis(order, at, 1) >= 0)
                kept.append(pd.DataFrame({"query": qs[lo + r], key: k[at[r, c]], "score": s[r, at[r, c]]}))
            if len(kept) > 64:
                kept = [_best(pd.concat(kept), key, top)]
        if kept:
            yield _best(pd.concat(kept), key, top)

    return base.mapInPandas(search, f"query {kind}, `{key}` {kind}, score double")


def _best(found: pd.DataFrame, key: str, top: int) -> pd.DataFrame:
    found = found.assign(_s=-found["score"].round(9)).drop_duplicates(["query", key])
    return found.sort_values(["query", "_s", key]).groupby("query").head(top).drop(columns="_s")


def embedding_triples(docs: DataFrame, positives: DataFrame, negatives: DataFrame, standards: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, query, positive, negative): training rows of an embedding model."""
    s = few(standards).select("chunk_id", F.col("text").alias("_t"))
    p = positives.join(F.broadcast(s), "chunk_id").select(key, F.col("_t").alias("positive"))
    n = negatives.join(F.broadcast(s), "chunk_id").select(key, F.col("_t").alias("negative"))
    return docs.select(key, F.col(text).alias("query")).join(p, key).join(n, key)


def reranker_pairs(docs: DataFrame, positives: DataFrame, negatives: DataFrame, standards: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, query, passage, label): the positive and each negative of a row."""
    s = few(standards).select("chunk_id", F.col("text").alias("passage"))
    both = positives.select(key, "chunk_id", F.lit(1).alias("label")).union(negatives.select(key, "chunk_id", F.lit(0).alias("label")))
    return docs.select(key, F.col(text).alias("query")).join(both.join(F.broadcast(s), "chunk_id"), key).select(key, "query", "passage", "label")


def chat_rows(records: DataFrame, system: str, text: str = "text") -> DataFrame:
    """(id, messages): fine-tuning rows of records with label, risk_level, standard_ref and finding; a null text counts as empty."""
    answer = F.to_json(F.struct("label", "risk_level", "standard_ref", "finding", F.when(F.col("label") == "BINH_THUONG", 0.82).otherwise(0.76).alias("confidence")))
    message = lambda role, c: F.struct(F.lit(role).alias("role"), c.alias("content"))
    return records.select("id", F.to_json(F.array(message("system", F.lit(system)), message("user", F.coalesce(F.col(text), F.lit(""))), message("assistant", answer))).alias("messages"))


def lexical_tokens(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, tokens): lower-case white-space tokens of a lexical index."""
    return df.select(key, tx.ws_tokens(F.lower(F.coalesce(F.col(text), F.lit("")))).alias("tokens"))


def knowledge_base(chunks: DataFrame) -> DataFrame:
    """The chunks of a table that can be searched: one row per id, with a text; source, article and title trimmed, blank for
    none, and the place of the chunk in its article."""
    text = tx.strip(F.coalesce("text", F.lit("")))
    kept = chunks.where("chunk_id is not null").select("chunk_id", *(F.trim(F.coalesce(c, F.lit(""))).alias(c) for c in ("source", "article", "title")), text.alias("text"), "chunk_index", "total_chunks").where("text <> ''")
    return kept.groupBy("chunk_id").agg(F.min(F.struct("source", "article", "title", "text", "chunk_index", "total_chunks")).alias("r")).select("chunk_id", "r.*")


def prompt_rows(records: DataFrame, system: str, template: str, context: DataFrame | None = None, key: str = "id", text: str = "text", label: str = "label") -> DataFrame:
    """(key, system, user, gold_label, char_count): a prompt per record from ``template``, in which ``{text}`` and
    ``{context}`` stand for the record's text and its passages. ``context``: (key, passage, rank), joined line by line; a
    record without any has an empty context."""
    rows = records.select(key, F.coalesce(F.col(text), F.lit("")).alias("_t"), F.col(label).alias("gold_label"))
    if context is None:
        rows = rows.withColumn("_c", F.lit(""))
    else:
        listed = context.groupBy(key).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "passage"))), lambda x: x["passage"]), "\n").alias("_c"))
        rows = rows.join(listed, key, "left").withColumn("_c", F.coalesce("_c", F.lit("")))
    user = F.replace(F.replace(F.lit(template), F.lit("{context}"), F.col("_c")), F.lit("{text}"), F.col("_t"))
    return rows.select(key, F.lit(system).alias("system"), user.alias("user"), "gold_label", F.length("_t").alias("char_count"))


def encoder_rows(records: DataFrame, key: str = "id", text: str = "text", label: str = "label_int", split: str = "split", longest: int = 20_000) -> DataFrame:
    """(key, text, label_int, split): what an encoder is trained on: texts that aren't blank, with a label and a split, cut
    into windows where they are over ``longest`` characters, so that no part is lost."""
    rows = records.where(F.col(label).isNotNull() & F.col(split).isNotNull()).select(key, tx.strip(F.coalesce(F.col(text), F.lit(""))).alias("text"), F.col(label).alias("label_int"), F.col(split).alias("split")).where("text <> ''")
    parts = F.when(F.length("text") <= longest, F.array("text")).otherwise(tx.windows(F.col("text"), longest, 0))
    return rows.select(key, F.posexplode(parts).alias("part", "text"), "label_int", "split")


# Settings of the retrieval set.
RETRIEVAL_CONFIG = {"top_k": 5, "negatives": 3, "retriever": "bm25", "reranker": None, "kb_source": "kb_chunks"}
