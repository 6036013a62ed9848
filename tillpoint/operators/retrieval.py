"""Text retrieval jobs (R1-R3): chunking, nearest vectors, context assembly.

The reference only calls third-party libraries for these; they are rebuilt as
Spark jobs over the documents / embeddings tables.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def chunk_text(df: DataFrame, id_col: str, text_col: str, size: int = 1000, overlap: int = 200) -> DataFrame:
    """Fixed-stride chunks of at most ``size`` characters, consecutive
    chunks sharing ``overlap`` characters; a text of n > size characters gives
    ``1 + ceil((n - size) / (size - overlap))`` chunks, empty texts none.  Every
    character of every text is in some chunk (whole texts, no prefixes)."""
    stride = size - overlap
    n = F.char_length(F.col(text_col))
    chunks = F.when(n <= size, F.lit(1)).otherwise(1 + F.ceil((n - size) / stride))
    return (df.where(n > 0)
              .select(id_col, text_col, F.explode(F.sequence(F.lit(0), (chunks - 1).cast("int"))).alias("chunk_no"))
              .select(id_col, "chunk_no", F.substring(F.col(text_col), F.col("chunk_no") * stride + 1, size)
                      .alias("chunk")))


def label_centroids(vectors: DataFrame, key: str, vec: str) -> DataFrame:
    """Mean vector per key, dimension by dimension (posexplode + grouped avg)."""
    e = vectors.select(key, F.posexplode(vec).alias("d", "x"))
    per_dim = e.groupBy(key, "d").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return per_dim.groupBy(key).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("d", "x"))), lambda s: s["x"]).alias("centroid"))


def _block_topk(x: np.ndarray, ids: np.ndarray, qmat: np.ndarray, q_sq: np.ndarray, k: int,
                max_cells: int):
    """Top ``k`` rows of ``x`` per query row of ``qmat`` by (Euclidean distance,
    id), as ``(query index, row index, distance)`` arrays.

    Distances are screened with ``|x|^2 + |q|^2 - 2 x.q`` (one matrix product
    per block of queries; a block holds at most ``max_cells`` row x query
    cells).  Every row within a rounding margin of the k-th screened value is a
    candidate; candidates get the direct ``sqrt(sum((x - q)^2))`` and are
    ordered by it, so the result is the exact top ``k`` with exact ties."""
    n, dim = x.shape
    x_sq = np.einsum("ij,ij->i", x, x)
    block = max(1, max_cells // max(n, 1))
    qi_out, ri_out, d_out = [], [], []
    for lo in range(0, qmat.shape[0], block):
        qb = qmat[lo:lo + block]
        d2 = x_sq[:, None] + q_sq[None, lo:lo + block] - 2.0 * (x @ qb.T)
        for j in range(qb.shape[0]):
            col = d2[:, j]
            if n > k:
                kth = np.partition(col, k - 1)[k - 1]
                margin = 8.0 * (dim + 2) * np.finfo(np.float64).eps * (x_sq.max() + q_sq[lo + j])
                cand = np.nonzero(col <= kth + margin)[0]
            else:
                cand = np.arange(n)
            exact = np.sqrt(((x[cand] - qb[j]) ** 2).sum(axis=1))
            pick = cand[np.lexsort((ids[cand], exact))[:k]]
            qi_out.append(np.full(len(pick), lo + j))
            ri_out.append(pick)
            d_out.append(np.sqrt(((x[pick] - qb[j]) ** 2).sum(axis=1)))
    if not qi_out:
        return np.zeros(0, int), np.zeros(0, int), np.zeros(0)
    return np.concatenate(qi_out), np.concatenate(ri_out), np.concatenate(d_out)


def _merge_topk(qi: np.ndarray, ids: np.ndarray, dist: np.ndarray, k: int):
    """Keep the first ``k`` entries per query index by (distance, id)."""
    order = np.lexsort((ids, dist, qi))
    qi, ids, dist = qi[order], ids[order], dist[order]
    start = np.r_[0, np.flatnonzero(qi[1:] != qi[:-1]) + 1] if len(qi) else np.zeros(0, int)
    rank = np.arange(len(qi)) - np.repeat(start, np.diff(np.r_[start, len(qi)]))
    keep = rank < k
    return qi[keep], ids[keep], dist[keep]


def nearest(vectors: DataFrame, id_col: str, vec: str, queries: DataFrame, qid: str, qvec: str, k: int = 3,
            block_bytes: int = 32 << 20, max_cells: int = 4 << 20) -> DataFrame:
    """R2: the ``k`` vectors nearest (Euclidean) to each query vector, ties by id.

    Any number of queries: they are cut by a hash of their id into blocks of about
    ``block_bytes``, and each block is broadcast and compared with all vectors in one
    pass, so its answer is final and no more than a block is on the driver.  Each
    partition of ``vectors`` keeps one running top ``k`` per query over its Arrow
    batches (``_block_topk`` per batch, working memory bounded by ``max_cells``
    distances), so the shuffle carries at most k rows per query and partition, and
    ``row_number() <= k`` merges them (a partial ``WindowGroupLimit``).  With several
    blocks each one's result is written to the shared folder before the next."""
    from tillpoint.session import materialize

    stats = queries.agg(F.count(F.lit(1)).alias("n"), F.max(F.size(qvec)).alias("dim")).first()
    blocks = max(1, -(-stats["n"] * 8 * max(stats["dim"] or 1, 1) // block_bytes))
    block = F.pmod(F.xxhash64(qid), F.lit(blocks))
    out = None
    for b in range(blocks):
        got = _nearest_block(vectors, id_col, vec, queries.where(block == b), qid, qvec, k, max_cells)
        got = got if blocks == 1 else materialize(got, "nearest")
        out = got if out is None else out.unionByName(got)
    return out


def _nearest_block(vectors, id_col, vec, queries, qid, qvec, k, max_cells):
    qrows = queries.select(qid, qvec).collect()
    qids = [r[0] for r in qrows]
    qmat = np.array([np.asarray(r[1], dtype=np.float64) for r in qrows]) if qrows else np.zeros((0, 0))
    bq = vectors.sparkSession.sparkContext.broadcast((qids, qmat))
    id_type = dict(vectors.dtypes)[id_col]
    q_type = dict(queries.dtypes)[qid]

    def topk(batches):
        ids_, mat = bq.value
        q_sq = np.einsum("ij,ij->i", mat, mat) if len(ids_) else np.zeros(0)
        qid_arr = np.asarray(ids_, dtype=object)
        best = None  # running top k per query over all batches of this partition
        for pdf in batches:
            if pdf.empty or not ids_:
                continue
            x = np.stack(pdf[vec].map(lambda a: np.asarray(a, dtype=np.float64)).to_numpy())
            ids = pdf[id_col].to_numpy()
            qi, ri, dist = _block_topk(x, ids, mat, q_sq, k, max_cells)
            cur = (qi, ids[ri], dist)
            best = cur if best is None else _merge_topk(*[np.concatenate([a, b]) for a, b in zip(best, cur)], k)
        if best is not None and len(best[0]):
            yield pd.DataFrame({"query_id": qid_arr[best[0]], id_col: best[1], "distance": best[2]})

    part = vectors.select(id_col, vec).mapInPandas(
        topk, f"query_id {q_type}, {id_col} {id_type}, distance double")
    w = Window.partitionBy("query_id").orderBy("distance", id_col)
    return part.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


# How a pattern is found in a text before the exact check: by three inner words, by its
# longest inner word, by its first three characters, or by its first one.
_KINDS = ("words3", "word", "chars3", "char")


def _pattern_keys(text):
    """The best key that every text with the pattern must hold.  A word with white space
    on both sides in the pattern is a whole word of the text."""
    inner = F.expr(f"slice(split({text}, '\\\\s+'), 2, greatest(size(split({text}, '\\\\s+')) - 2, 0))")
    longest = F.array_max(F.transform(inner, lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"]
    return F.when(F.size(inner) >= 3, F.struct(F.lit("words3").alias("kind"), F.xxhash64(
        F.get(inner, F.lit(0)), F.get(inner, F.lit(1)), F.get(inner, F.lit(2))).alias("key"))).when(
        F.size(inner) >= 1, F.struct(F.lit("word").alias("kind"), F.xxhash64(longest).alias("key"))).when(
        F.length(text) >= 3, F.struct(F.lit("chars3").alias("kind"), F.xxhash64(F.substring(text, 1, 3)).alias("key"))).otherwise(
        F.struct(F.lit("char").alias("kind"), F.xxhash64(F.substring(text, 1, 1)).alias("key")))


def _text_keys(texts: DataFrame, kind: str) -> DataFrame:
    """``(_t, key)``: distinct keys of one kind of each text ``(_t, _tt)``.  The parts are
    a column of their own, so that they are made once per text."""
    cut = texts.select("_t", F.split("_tt", r"\s+" if kind.startswith("word") else "").alias("w"))
    n = 3 if kind.endswith("3") else 1
    runs = F.slice("w", F.lit(1), F.greatest(F.size("w") - (n - 1), F.lit(0)))
    if kind == "words3":
        key = lambda w, i: F.xxhash64(w, F.get("w", i + 1), F.get("w", i + 2))
    elif kind == "chars3":
        key = lambda w, i: F.xxhash64(F.concat(w, F.get("w", i + 1), F.get("w", i + 2)))
    else:
        key = lambda w, i: F.xxhash64(w)
    keys = cut.select("_t", F.array_distinct(F.transform(runs, key)).alias("keys"))
    # explode() would infer a filter on the array's size and push it, split and all, below
    return keys.select("_t", F.explode_outer("keys").alias("key")).where("key is not null")


def contains_matches(texts: DataFrame, text_id: str, text_col: str, patterns: DataFrame, pid: str,
                     pcol: str) -> DataFrame:
    """Every (pattern, text) pair where the text contains the pattern exactly.

    An equi-join on the hash of one key per pattern (three words, where it has them)
    gives the candidates; ``contains`` decides.  Texts are read once per kind of key that
    the patterns have (four at most), whatever the number of patterns; no pattern is
    collected, and a key that very many texts hold is split as any skewed join.  Empty
    patterns match nothing."""
    pats = patterns.select(F.col(pid).alias("_p"), F.col(pcol).alias("_pt")).where(F.octet_length("_pt") > 0)
    keyed = pats.select("_p", "_pt", _pattern_keys("_pt").alias("k")).select("_p", "_pt", "k.kind", "k.key")
    kinds = {r[0] for r in keyed.select("kind").distinct().collect()}
    own = texts.select(F.col(text_id).alias("_t"), F.col(text_col).alias("_tt")).where("_tt is not null")
    found = None
    for kind in (k for k in _KINDS if k in kinds):
        hit = keyed.where(F.col("kind") == kind).join(_text_keys(own, kind), "key").select("_p", "_pt", "_t")
        found = hit if found is None else found.union(hit)
    if found is None:
        found = pats.join(own.select("_t").limit(0), F.lit(False)).select("_p", "_pt", "_t")
    return (found.join(own, "_t").where(F.contains("_tt", "_pt")).select(F.col("_p").alias(pid), F.col("_t").alias(text_id))
            .distinct())


def assemble_context(retrieved: DataFrame, query: str, rank: str, text: str, sep: str = "\n\n") -> DataFrame:
    """Per query, the retrieved texts joined in rank order (the retrieved
    set is a top-k, so each group is bounded by k)."""
    return retrieved.groupBy(query).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(rank, text))), lambda s: s[text]), sep)
        .alias("context"), F.count(F.lit(1)).alias("n_retrieved"))
