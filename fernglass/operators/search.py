"""Ranked code search over chunks, for a batch of queries at a time.

Two rankers (substring BM25 and declared names) each see the scope before they
rank; reciprocal rank fusion joins them; post-filters and the class/method
de-duplication follow the cut, as that order decides results.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fernglass.functions.text import MIN_TERM, is_code_like, name_keys
from fernglass.operators.chunks import latest
from fernglass.session import materialize

RRF_K = 60
#: BM25 parameters and the floor of a term's weight: fixed values.
K1, B, IDF_FLOOR = 1.2, 0.75, 1e-6

Queries = list[tuple[int, str]]


def query_terms(query: str) -> list[str]:
    return [t.lower() for t in re.findall(r"[A-Za-z0-9_]+", query) if len(t) >= MIN_TERM]


def name_terms(query: str) -> list[str]:
    return list(dict.fromkeys(t for t in re.findall(r"[A-Za-z0-9_$]+", query) if re.search(r"[A-Z_$]|[A-Za-z][0-9]|[0-9][A-Za-z]", t)))


def occurrences(content: Column, term: str) -> Column:
    """Overlapping occurrences of a literal in lower-cased text; most texts hold none, which a plain search tells."""
    return F.when(content.contains(term), F.regexp_count(content, F.lit(f"(?=\\Q{term}\\E)"))).otherwise(0)


def bm25(chunks: DataFrame, queries: Queries, *, scope: Column | None = None, at: str | None = None) -> DataFrame:
    """(query_id, chunk_id, score) of every chunk that contains a term; lower is better.

    Document counts and lengths come from the whole table, whatever the scope.
    With ``at``, rows are states of chunks and the one of the greatest ``at``
    counts. The text is read once and never moves: each row is reduced to its
    length and term counts, these are settled and written, and the statistics
    (one row) and the scores come from them.
    """
    terms = sorted({t for _, q in queries for t in query_terms(q)})
    inside = F.lit(True) if scope is None else F.coalesce(scope, F.lit(False))
    low = chunks.select("chunk_id", inside.alias("in_scope"), F.lower("content").alias("low"), *([] if at is None else [at]))
    tf = low.select("chunk_id", "in_scope", F.greatest(F.length("low") - 2, F.lit(0)).alias("d"), F.array(*[occurrences(F.col("low"), t) for t in terms]).alias("tf"), *([] if at is None else [at]))
    tf = materialize(tf if at is None else latest(tf, "chunk_id", at, ["in_scope", "d", "tf"]))
    stats = tf.agg(F.count("*").alias("n_all"), F.sum("d").alias("d_all"), F.array(*[F.count_if(F.col("tf")[i] > 0) for i in range(len(terms))]).alias("df"))
    # stats is one row
    rows = tf.filter("in_scope and exists(tf, f -> f > 0)").crossJoin(F.broadcast(stats))
    norm = K1 * (1 - B + B * F.col("d") / (F.col("d_all") / F.col("n_all")))

    def part(i: int) -> Column:
        n, f = F.col("df")[i], F.col("tf")[i]
        idf = F.log((F.col("n_all") - n + 0.5) / (n + 0.5))
        idf = F.when(idf <= 0, IDF_FLOOR).otherwise(idf)
        return F.when(f > 0, idf * f * (K1 + 1) / (f + norm)).otherwise(0.0)

    scores = []
    for qid, q in queries:
        own = [terms.index(t) for t in query_terms(q)]
        hit = reduce(lambda a, b: a | b, [F.col("tf")[i] > 0 for i in set(own)], F.lit(False))
        total = -reduce(lambda a, b: a + b, [part(i) for i in own], F.lit(0.0))
        scores.append(F.when(hit, F.struct(F.lit(qid).alias("query_id"), total.alias("score"))))
    out = rows.select("chunk_id", F.explode(F.filter(F.array(*scores), lambda s: s.isNotNull())).alias("s"))
    return out.select("s.query_id", "chunk_id", "s.score")


def top(scored: DataFrame, k: int, *order: Column, rank: str = "rank") -> DataFrame:
    """The first ``k`` per query with their 1-based rank."""
    return scored.withColumn(rank, F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).filter(F.col(rank) <= k)


def declared(spark: SparkSession, chunks: DataFrame, queries: Queries, *, scope: Column | None = None) -> DataFrame:
    """(query_id, chunk_id, match, multiplicity): chunks whose name, or last name segment, is a code-like query term.

    Names are exploded to lookup keys, so the match is an equi-join; the other
    side is the terms of the query batch.
    """
    terms = [(qid, t.lower()) for qid, q in queries for t in name_terms(q)]
    wanted = spark.createDataFrame(terms, "query_id int, key string")
    rows = chunks.filter("symbol_name is not null")
    rows = rows if scope is None else rows.filter(scope)
    keys = rows.select("chunk_id", F.explode(name_keys(F.col("symbol_name"))).alias("k")).select("chunk_id", "k.key", "k.kind")
    hit = keys.join(F.broadcast(wanted), "key")  # as many rows as the queries have terms
    best = hit.groupBy("query_id", "chunk_id").agg(F.min(F.struct("kind", "key")).alias("m")).select("query_id", "chunk_id", F.col("m.kind").alias("match"), F.col("m.key").alias("key"))
    return best.withColumn("multiplicity", F.count("*").over(Window.partitionBy("query_id", "key")))


def rank_declared(rows: DataFrame, k: int) -> DataFrame:
    """Full matches first, then rarer names, then chunk_id."""
    return top(rows, k, F.col("match"), F.col("multiplicity"), F.col("chunk_id"), rank="d_rank")


def fuse(lexical: DataFrame, names: DataFrame, k: int = RRF_K) -> DataFrame:
    """Reciprocal rank fusion of (query_id, chunk_id, f_rank) and (query_id, chunk_id, d_rank)."""
    part = lambda c: F.coalesce(1.0 / (k + F.col(c)), F.lit(0.0))
    both = lexical.select("query_id", "chunk_id", "f_rank").join(names.select("query_id", "chunk_id", "d_rank"), ["query_id", "chunk_id"], "full_outer")
    return both.withColumn("rrf", part("f_rank") + part("d_rank"))


def fused_order() -> list[Column]:
    return [F.desc("rrf"), F.asc_nulls_last("f_rank"), F.asc_nulls_last("d_rank"), F.asc("chunk_id")]


def drop_collisions(ranked: DataFrame, limit: int) -> DataFrame:
    """Class shells and their methods: the kind that ranks first is kept, the other suppressed, up to ``limit`` rows.

    ``ranked`` has query_id, chunk_id, chunk_type, file_path, symbol_name,
    parent_symbol, rank. Adds ``hint``: on the first kept row of a class, the
    suppressed methods in rank order or the suppressed class. Closed form: per
    class the kind at the least rank wins.
    """
    cls = F.when(F.col("chunk_type") == "class_shell", F.col("symbol_name")).when(F.col("chunk_type") == "method", F.col("parent_symbol"))
    rows = ranked.withColumn("cls", cls).withColumn("class_key", F.when(F.col("cls").isNotNull(), F.concat_ws("\x00", "file_path", "cls")))
    w = Window.partitionBy("query_id", "class_key")
    rows = rows.withColumn("first_kind", F.min_by("chunk_type", "rank").over(w))
    rows = rows.withColumn("kept", F.col("class_key").isNull() | (F.col("chunk_type") == F.col("first_kind")))
    order = Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("new_rank", F.sum(F.col("kept").cast("int")).over(order))
    rows = rows.filter((F.col("new_rank") < limit) | ((F.col("new_rank") == limit) & F.col("kept")))
    gone = rows.filter(~F.col("kept")).groupBy("query_id", "class_key").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "symbol_name"))), lambda x: x["symbol_name"]), ",").alias("gone"))
    kept = rows.filter("kept").withColumn("nth", F.row_number().over(Window.partitionBy("query_id", "class_key").orderBy("rank")))
    out = kept.join(gone, ["query_id", "class_key"], "left")
    return out.select("query_id", "chunk_id", F.col("new_rank").alias("rank"), F.when((F.col("nth") == 1) & F.col("class_key").isNotNull(), F.col("gone")).alias("hint"))


def fused_search(
    spark: SparkSession,
    chunks: DataFrame,
    queries: Queries,
    *,
    limit: int = 10,
    scope: Column | None = None,
    post: Column | None = None,
    declaration_ranker: bool = True,
    states: DataFrame | None = None,
) -> DataFrame:
    """The whole search: (query_id, rank, chunk_id, rrf, hint).

    With ``states``, texts are ranked from these rows (the latest file_mtime counts), and ``chunks`` need not have them.
    """
    lexical = top(bm25(chunks if states is None else states, queries, scope=scope, at=None if states is None else "file_mtime"), 8 * limit, F.asc("score"), F.asc("chunk_id"), rank="f_rank")
    names = rank_declared(declared(spark, chunks, queries, scope=scope), 4 * limit if declaration_ranker else 0)
    cut = top(fuse(lexical, names), 4 * limit, *fused_order())
    found = cut.join(chunks.select("chunk_id", "chunk_type", "file_path", "symbol_name", "parent_symbol", "is_exported"), "chunk_id")
    found = found if post is None else found.filter(post)
    rrf = found.select("query_id", "chunk_id", "rrf")
    return drop_collisions(found, limit).join(rrf, ["query_id", "chunk_id"]).select("query_id", "rank", "chunk_id", "rrf", "hint")


def window_effects(lexical: DataFrame, names: DataFrame, limit: int) -> DataFrame:
    """How the declared-name ranker moves the window: rank with and without it, changed rows only."""
    with_d = top(fuse(lexical, names), limit, *fused_order(), rank="rank_with").select("query_id", "chunk_id", "rank_with")
    without = lexical.filter(F.col("f_rank") <= limit).select("query_id", "chunk_id", F.col("f_rank").alias("rank_without"))
    both = with_d.join(without, ["query_id", "chunk_id"], "full_outer")
    return both.filter(~F.col("rank_with").eqNullSafe(F.col("rank_without")))


def suggestions(passes: list[DataFrame], limit: int) -> DataFrame:
    """Ordered union of (query_id, symbol_name, file_path, pos), first pass wins per symbol and path, capped."""
    rows = reduce(lambda a, b: a.unionByName(b), [p.select("query_id", "symbol_name", "file_path", "pos", F.lit(i).alias("pass_no")) for i, p in enumerate(passes)])
    w = Window.partitionBy("query_id", "symbol_name", "file_path").orderBy("pass_no", "pos")
    once = rows.withColumn("n", F.row_number().over(w)).filter("n = 1")
    return top(once, limit, F.col("pass_no"), F.col("pos"), F.col("symbol_name"), F.col("file_path")).select("query_id", "rank", "symbol_name", "file_path", "pass_no")


def code_like_terms(terms: Column) -> Column:
    return F.filter(terms, is_code_like)
