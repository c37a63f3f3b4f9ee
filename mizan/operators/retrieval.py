"""Ranked retrieval as joins over postings and two-phase top-k over vectors.

A hit frame is (query_id, rank, chunk_id, score), ranked from 1 by score (rounded to SCORE_DIGITS so
that sums taken in another order tie alike), then chunk_id. Queries are a batch: one plan answers
all of them. Duplicate chunk ids are one chunk; null and empty texts are chunks without tokens.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from mizan.functions.text import normalize_arabic, tokens_of_normal
from mizan.session import materialise, materialise_by, shuffle_partitions

# --- fixed values: Okapi parameters -----------------------------------------------------------
K1, B, EPSILON = 1.5, 0.75, 0.25
# -----------------------------------------------------------------------------------------------
SCORE_DIGITS = 6
#: Query vectors that are multiplied in one pass over the corpus.
QUERIES_PER_PASS = 4_096
#: Query terms up to which their side of a join is broadcast; beyond, the join shuffles by term.
BROADCAST_ROWS = 200_000


@dataclass
class TextIndex:
    """postings(term, chunk_id, dl, tf), chunks(chunk_id, dl), terms(term, df); one row: n, avgdl."""

    postings: DataFrame
    chunks: DataFrame
    terms: DataFrame
    totals: DataFrame


def tokenised(rows: DataFrame, key: str, text: str, as_key: str) -> DataFrame:
    """`as_key`, toks; in two steps, as the normal form is used several times."""
    return rows.select(F.col(key).alias(as_key), normalize_arabic(F.col(text)).alias("_n")).select(as_key, tokens_of_normal(F.col("_n")).alias("toks"))


def build_index(chunks: DataFrame, chunk_id: str = "chunk_id", text: str = "text") -> TextIndex:
    """Postings with term frequencies. Texts are tokenised once and shuffled once, by chunk; the counts are
    written as a table bucketed by chunk, so neither document frequencies nor the sums of scores of any later
    search move the postings again. A chunk without tokens is one row without a term."""
    n = shuffle_partitions(chunks.sparkSession)
    toks = tokenised(chunks, chunk_id, text, "chunk_id").repartition(n, "chunk_id")
    rows = toks.select("chunk_id", F.size("toks").alias("dl"), F.explode_outer("toks").alias("term"))
    stored = materialise_by(rows.groupBy("chunk_id", "dl", "term").agg(F.count("term").alias("tf")), "chunk_id")
    postings = stored.filter("term is not null")
    lengths = stored.groupBy("chunk_id").agg(F.max("dl").alias("dl"))
    terms = postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    totals = lengths.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.avg("dl"), F.lit(0.0)).alias("avgdl"))
    return TextIndex(postings, lengths, terms, totals)


def hashed_vectors(rows: DataFrame, key: str, text: str, as_key: str, dims: int = 256) -> DataFrame:
    """`as_key`, vec: token counts, each token added with its own sign at its own place by its MD5; the declared
    stand-in for a trained encoder. Texts without tokens have no vector. `dims` is at most 256."""
    t = tokenised(rows, key, text, as_key).repartition(as_key).select(as_key, F.explode("toks").alias("term")).select(as_key, F.md5("term").alias("h"))
    place = F.conv(F.substring("h", 1, 2), 16, 10).cast("int") % dims
    w = t.groupBy(as_key, place.alias("i")).agg(F.sum(F.when(F.substring("h", 3, 1) < "8", 1.0).otherwise(-1.0)).alias("w"))
    m = w.groupBy(as_key).agg(F.map_from_entries(F.collect_list(F.struct("i", "w"))).alias("m"))
    return m.select(as_key, F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0.0))).alias("vec"))


def bounded(side: DataFrame) -> DataFrame:
    """The stated queries' side of a join, written once, and broadcast if its size was found small."""
    side = materialise(side)
    return F.broadcast(side) if side.count() <= BROADCAST_ROWS else side


def idf_table(ix: TextIndex) -> DataFrame:
    """term, idf; negative values give way to a quarter of the mean."""
    raw = ix.terms.join(F.broadcast(ix.totals), F.lit(True)).select("term", "df", (F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)).alias("raw"))
    mean = raw.agg(F.coalesce(F.avg("raw"), F.lit(0.0)).alias("mean"))
    return raw.join(F.broadcast(mean), F.lit(True)).select("term", F.when(F.col("raw") < 0, F.col("mean") * EPSILON).otherwise(F.col("raw")).alias("idf"))


def query_terms(questions: DataFrame, query_id: str, text: str) -> DataFrame:
    """query_id, term, qtf: repeated query terms count repeatedly."""
    t = tokenised(questions, query_id, text, "query_id").select("query_id", F.explode("toks").alias("term"))
    return t.groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("qtf"))


def ranked(scored: DataFrame, k: int, by: str = "query_id", tie: str = "chunk_id") -> DataFrame:
    """The k best rows of each query by rounded score; Spark keeps only k rows per task before it shuffles."""
    w = W.partitionBy(by).orderBy(F.desc("score"), F.asc(tie))
    return scored.withColumn("score", F.round("score", SCORE_DIGITS)).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def bm25_scores(ix: TextIndex, terms: DataFrame) -> DataFrame:
    """query_id, chunk_id, score of every chunk that shares a term with the query."""
    weighted = bounded(terms.join(idf_table(ix), "term").join(F.broadcast(ix.totals), F.lit(True)).select("query_id", "term", (F.col("qtf") * F.col("idf")).alias("w"), "avgdl"))
    dl = F.col("dl") / F.greatest(F.col("avgdl"), F.lit(1e-9))
    tf = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * dl))
    hits = ix.postings.join(weighted, "term").select("query_id", "chunk_id", (F.col("w") * tf).alias("s"))
    return hits.groupBy("query_id", "chunk_id").agg(F.sum("s").alias("score"))


def bm25_search(ix: TextIndex, questions: DataFrame, k: int, query_id: str = "query_id", text: str = "query") -> DataFrame:
    """Top k chunks of every question that has tokens; where fewer match, chunks with score 0 follow in
    order of their id."""
    terms = query_terms(questions, query_id, text)
    # k rows per query, read three times below
    top = materialise(ranked(bm25_scores(ix, terms), k).select("query_id", "rank", "chunk_id", "score"))
    return padded(top, terms.select("query_id").distinct(), ix.chunks, k)


def padded(top: DataFrame, asked: DataFrame, chunks: DataFrame, k: int) -> DataFrame:
    """The hits of every asked query_id, with chunks of score 0 where fewer than k matched."""
    short = top.groupBy("query_id").agg(F.count(F.lit(1)).alias("have"))
    short = asked.join(short, "query_id", "left").select("query_id", F.coalesce("have", F.lit(0)).alias("have")).filter(F.col("have") < k)
    # at most 2k ids can be needed: k may already be among the hits
    filler = chunks.select("chunk_id").orderBy("chunk_id").limit(2 * k)
    spare = short.join(F.broadcast(filler), F.lit(True)).join(top.select("query_id", "chunk_id"), ["query_id", "chunk_id"], "left_anti")
    w = W.partitionBy("query_id").orderBy("chunk_id")
    pad = spare.withColumn("i", F.row_number().over(w)).filter(F.col("i") + F.col("have") <= k)
    pad = pad.select("query_id", "chunk_id", F.lit(0.0).alias("score"), (F.col("i") + F.col("have")).cast("int").alias("rank"))
    return top.select("query_id", "rank", "chunk_id", "score").unionByName(pad)


def sparse_search(docs: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Dot product of sparse vectors in long form: docs(chunk_id, term, weight), queries(query_id, term, weight)."""
    q = bounded(queries.withColumnRenamed("weight", "qw"))
    s = docs.join(q, "term").groupBy("query_id", "chunk_id").agg(F.sum(F.col("weight") * F.col("qw")).alias("score"))
    return ranked(s, k).select("query_id", "rank", "chunk_id", "score")


def unit(v: Column) -> Column:
    """L2-normalised vector; a zero vector stays."""
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return F.transform(v, lambda x: F.when(norm > 0, x / norm).otherwise(x.cast("double")))


def _passes(queries: DataFrame, id_col: str, vec: str) -> Iterator[tuple[list, np.ndarray]]:
    """Blocks of at most QUERIES_PER_PASS query vectors."""
    ids, rows = [], []
    for r in queries.select(F.col(id_col).alias("i"), F.col(vec).alias("v")).filter("i is not null and v is not null").toLocalIterator():
        ids.append(r.i)
        rows.append(r.v)
        if len(ids) == QUERIES_PER_PASS:
            yield ids, np.array(rows, np.float64)
            ids, rows = [], []
    if ids:
        yield ids, np.array(rows, np.float64)


def dense_search(vectors: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", vec: str = "embedding", cosine: bool = True, query_id: str | None = None) -> DataFrame:
    """Exact top k by inner product (of unit vectors, if `cosine`): each task multiplies its rows with a
    block of queries and keeps its k best, a window keeps the k best of all. Null vectors are no rows. Ids
    are whole numbers or strings.
    """
    asked = query_id or id_col
    kinds = [vectors.schema[id_col].dataType.simpleString(), queries.schema[asked].dataType.simpleString()]
    schema = f"query_id {kinds[1]}, chunk_id {kinds[0]}, score double"
    out = None
    for ids, q in _passes(queries, asked, vec):
        if cosine:
            q = q / np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-30)
        shared = vectors.sparkSession.sparkContext.broadcast((ids, q))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            ids, q = shared.value
            best_i, best_s, kind = None, np.zeros((len(ids), 0)), None
            for b in batches:
                if not b.num_rows:
                    continue
                kind = b.column(0).type
                rows, col = np.array(b.column(0).to_pylist()), b.column(1)
                v = col.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(rows), -1)
                if cosine:
                    v = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-30)
                s = np.concatenate([best_s, np.round(q @ v.T, SCORE_DIGITS)], axis=1)
                i = np.broadcast_to(rows, (len(ids), len(rows)))
                i = i if best_i is None else np.concatenate([best_i, i], axis=1)
                order = np.lexsort((i, -s), axis=1)[:, :k]
                best_s, best_i = np.take_along_axis(s, order, 1), np.take_along_axis(i, order, 1)
            if best_i is not None:
                n = best_s.shape[1]
                yield pa.RecordBatch.from_arrays([pa.array([x for x in ids for _ in range(n)]), pa.array(best_i.ravel().tolist(), kind), pa.array(best_s.ravel())], names=["query_id", "chunk_id", "score"])

        local = vectors.filter(F.col(id_col).isNotNull() & F.col(vec).isNotNull()).select(id_col, vec).mapInArrow(run, schema)
        part = ranked(local, k)
        out = part if out is None else out.unionByName(part)
    if out is None:
        empty = vectors.sparkSession.createDataFrame([], f"query_id {kinds[1]}, rank int, chunk_id {kinds[0]}, score double")
        return empty
    return out.select("query_id", "rank", "chunk_id", "score")


def maxsim_search(vectors: DataFrame, queries: DataFrame, k: int, vec: str = "vec") -> DataFrame:
    """Late interaction: vectors(chunk_id, pos, vec), queries(query_id, pos, vec); the score is the sum
    over query vectors of the best inner product with a unit vector of the chunk.

    Query vectors travel in blocks; a task reduces each (query vector, chunk) to its maximum.
    """
    numbered = queries.select("query_id", F.col(vec).alias("v")).toLocalIterator()
    out, block = None, []

    def reduced(rows: list) -> DataFrame:
        ids, q = np.array([r.query_id for r in rows]), np.array([r.v for r in rows], np.float64)
        q = q / np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-30)
        shared = vectors.sparkSession.sparkContext.broadcast((ids, q))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, q = shared.value
            for b in batches:
                if not b.num_rows:
                    continue
                chunk = b.column(0).to_numpy(zero_copy_only=False)
                v = b.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(chunk), -1)
                v = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-30)
                order = np.argsort(chunk, kind="stable")
                own, first = np.unique(chunk[order], return_index=True)
                best = np.maximum.reduceat(q @ v[order].T, first, axis=1)
                n = len(own)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(ids, n)), pa.array(np.repeat(np.arange(len(ids)), n)), pa.array(np.tile(own, len(ids))), pa.array(best.ravel())], names=["query_id", "q", "chunk_id", "best"]
                )

        part = vectors.filter(F.col(vec).isNotNull()).select(F.col("chunk_id").cast("bigint"), vec).mapInArrow(run, "query_id bigint, q bigint, chunk_id bigint, best double")
        return part.groupBy("query_id", "q", "chunk_id").agg(F.max("best").alias("best")).groupBy("query_id", "chunk_id").agg(F.sum("best").alias("score"))

    current = None
    rows_of: list[list] = []
    for r in numbered:
        # a query's vectors stay in one block
        if current is not None and r.query_id != current and len(block) >= QUERIES_PER_PASS:
            rows_of.append(block)
            block = []
        block.append(r)
        current = r.query_id
    rows_of.append(block)
    for rows in rows_of:
        if rows:
            part = reduced(rows)
            out = part if out is None else out.unionByName(part)
    if out is None:
        return vectors.select(F.lit(0).cast("bigint").alias("query_id"), F.lit(0).alias("rank"), F.col("chunk_id").cast("bigint").alias("chunk_id"), F.lit(0.0).alias("score")).filter(F.lit(False))
    # a query whose vectors fell into several blocks is summed over them
    return ranked(out.groupBy("query_id", "chunk_id").agg(F.sum("score").alias("score")), k).select("query_id", "rank", "chunk_id", "score")


def rerank(hits: DataFrame, k: int, scorer: Column | None = None) -> DataFrame:
    """Re-orders hits(query_id, rank, chunk_id, query, text) by a scorer column, first k. Without one,
    the share of the query's tokens that the text holds stands in (a declared stand-in)."""
    if scorer is None:
        hits = hits.withColumns({"_q": normalize_arabic(F.col("query")), "_t": normalize_arabic(F.col("text"))})
        hits = hits.withColumns({"_q": F.array_distinct(tokens_of_normal(F.col("_q"))), "_t": tokens_of_normal(F.col("_t"))})
        scorer = F.size(F.array_intersect("_q", "_t")) / F.greatest(F.size("_q"), F.lit(1))
    scored = hits.withColumn("score", F.round(scorer, SCORE_DIGITS))
    w = W.partitionBy("query_id").orderBy(F.desc("score"), F.asc("rank"))
    return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).drop("_q", "_t")
