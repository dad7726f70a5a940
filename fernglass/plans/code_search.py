"""Code search over the chunk table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fernglass.functions.paths import glob_match, glob_to_regex
from fernglass.functions.text import clip, contains_phrase, first_doc_comment, identifier_words, identifiers, phrase_tokens, trigram_similarity
from fernglass.operators import search as S
from fernglass.operators.chunks import latest
from fernglass.session import table

ASKED = [(1, "flush remote schema retry"), (2, "the narrow commit of a workspace PocketRibbonMap pinCrateSummit"), (3, "QuorumLedgerMap shelf overview"), (4, "PolicyNodeView measureBeaconSpan path")]
LIMIT = 10
SCOPE = "**/src/core/**"
COLUMNS = ["chunk_id", "file_path", "start_line", "content", "chunk_type", "symbol_name", "parent_symbol", "is_exported"]


def chunks(spark: SparkSession, sf: str) -> DataFrame:
    return latest(table(spark, sf, "chunks"), "chunk_id", "file_mtime", COLUMNS)


def declarations(spark: SparkSession, sf: str) -> DataFrame:
    """Chunks in force without their texts."""
    return latest(table(spark, sf, "chunks"), "chunk_id", "file_mtime", [c for c in COLUMNS if c != "content"])


def _lexical(spark: SparkSession, sf: str, scope: Column | None = None) -> DataFrame:
    return S.bm25(table(spark, sf, "chunks"), ASKED, scope=scope, at="file_mtime")


def search_bm25_topk(spark: SparkSession, sf: str) -> DataFrame:
    got = S.top(_lexical(spark, sf), LIMIT, F.asc("score"), F.asc("chunk_id"))
    return got.select("query_id", "rank", "chunk_id", F.round("score", 6).alias("score"))


def search_bm25_scoped(spark: SparkSession, sf: str) -> DataFrame:
    got = S.top(_lexical(spark, sf, glob_match(F.col("file_path"), SCOPE)), LIMIT, F.asc("score"), F.asc("chunk_id"))
    return got.select("query_id", "rank", "chunk_id", F.round("score", 6).alias("score"))


def identifier_phrase_count(spark: SparkSession, sf: str) -> DataFrame:
    tokens = chunks(spark, sf).select("chunk_id", phrase_tokens(F.col("content")).alias("t"))
    names = ["never more than", "copyright 2025", "new map", "let i"]
    flags = F.explode(F.array(*[F.struct(F.lit(n).alias("phrase"), contains_phrase(F.col("t"), n.split()).alias("hit")) for n in names])).alias("p")
    return tokens.select(flags).groupBy("p.phrase").agg(F.count_if("p.hit").alias("n_chunks"))


def identifier_near_miss(spark: SparkSession, sf: str) -> DataFrame:
    tokens = chunks(spark, sf).select("chunk_id", phrase_tokens(F.col("content")).alias("t"))
    wanted = F.array(*[F.lit(x) for x in ("scaffold", "istanbul", "typings")])
    return tokens.filter(F.arrays_overlap("t", wanted)).select("chunk_id", F.size(F.array_intersect(wanted, F.array_distinct("t"))).alias("n_terms"))


def split_identifier_terms(spark: SparkSession, sf: str) -> DataFrame:
    names = chunks(spark, sf).filter("symbol_name is not null").select("symbol_name").distinct()
    return names.select("symbol_name", F.array_join(identifier_words(F.col("symbol_name")), " ").alias("words"))


def trigram_similarity_topk(spark: SparkSession, sf: str) -> DataFrame:
    names = chunks(spark, sf).filter("symbol_name is not null and chunk_type <> 'method'").select("symbol_name", "file_path", "start_line").distinct()
    scored = names.withColumn("score", trigram_similarity(F.lit("flushRemoteSchema"), F.col("symbol_name"))).filter("score >= 0.3")
    got = S.top(scored.withColumn("query_id", F.lit(1)), 20, F.desc("score"), F.asc("file_path"), F.asc("start_line"), F.asc("symbol_name"))
    return got.select("rank", "symbol_name", "file_path", F.round("score", 9).alias("score"))


def declex_rank(spark: SparkSession, sf: str) -> DataFrame:
    rows = S.rank_declared(S.declared(spark, declarations(spark, sf), ASKED), 4 * LIMIT)
    return rows.select("query_id", "d_rank", "chunk_id", "match", "multiplicity")


def _rankers(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    lexical = S.top(_lexical(spark, sf), 8 * LIMIT, F.asc("score"), F.asc("chunk_id"), rank="f_rank")
    return lexical, S.rank_declared(S.declared(spark, declarations(spark, sf), ASKED), 4 * LIMIT)


def rrf_fusion(spark: SparkSession, sf: str) -> DataFrame:
    got = S.top(S.fuse(*_rankers(spark, sf)), 4 * LIMIT, *S.fused_order())
    return got.select("query_id", "rank", "chunk_id", F.round("rrf", 12).alias("rrf"))


def fused_search(spark: SparkSession, sf: str) -> DataFrame:
    got = S.fused_search(spark, declarations(spark, sf), ASKED, states=table(spark, sf, "chunks"), limit=LIMIT)
    return got.select("query_id", "rank", "chunk_id", F.round("rrf", 12).alias("rrf"), "hint")


def fused_search_exported(spark: SparkSession, sf: str) -> DataFrame:
    got = S.fused_search(spark, declarations(spark, sf), ASKED, states=table(spark, sf, "chunks"), limit=LIMIT, scope=glob_match(F.col("file_path"), "**/*.ts"), post=F.col("is_exported"))
    return got.select("query_id", "rank", "chunk_id")


def fusion_window_effects(spark: SparkSession, sf: str) -> DataFrame:
    return S.window_effects(*_rankers(spark, sf), LIMIT)


def shell_method_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """De-duplication over the chunks of each repository, longest first, up to 50 rows kept."""
    return _dedup(spark, sf, 50)


def shell_method_dedup_all(spark: SparkSession, sf: str) -> DataFrame:
    """De-duplication over all chunks, longest first within each repository."""
    return _dedup(spark, sf, (1 << 63) - 1)


def _dedup(spark: SparkSession, sf: str, limit: int) -> DataFrame:
    states = table(spark, sf, "chunks").withColumn("size", F.length("content"))
    rows = latest(states, "chunk_id", "file_mtime", [*(c for c in COLUMNS if c != "content"), "size"]).withColumn("query_id", F.substring_index("file_path", "/", 1))
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("size"), F.asc("chunk_id"))))
    return S.drop_collisions(rows, limit).withColumnRenamed("query_id", "repo")


MISSED = "splitFreshNodes"


def zero_result_assist(spark: SparkSession, sf: str) -> DataFrame:
    """What to offer for a query without results, within the scope: similar names, chunks of the query's words, near misses."""
    states = table(spark, sf, "chunks")
    inside = glob_match(F.col("file_path"), "**/packages/**")
    c = declarations(spark, sf).filter(F.col("symbol_name").isNotNull() & inside).withColumn("query_id", F.lit(1))
    like = S.top(c.filter("chunk_type <> 'method'").withColumn("score", trigram_similarity(F.lit(MISSED), F.col("symbol_name"))).filter("score >= 0.3"), 5, F.desc("score"), F.asc("file_path"), F.asc("start_line"), F.asc("symbol_name"), F.asc("chunk_id"), rank="pos")
    split = S.top(S.bm25(states, [(1, " ".join(ASSIST_WORDS))], scope=inside, at="file_mtime"), 5, F.asc("score"), F.asc("chunk_id"), rank="pos").join(c.drop("query_id"), "chunk_id")
    flags = F.arrays_overlap(phrase_tokens(F.col("content")), F.array(F.lit(MISSED.lower()[:-1]), F.lit("fresh")))
    hit = latest(states.withColumn("hit", flags), "chunk_id", "file_mtime", ["hit"]).filter("hit").select("chunk_id")
    near = S.top(c.join(hit, "chunk_id"), 20, F.asc("chunk_id"), rank="pos")
    return S.suggestions([like, split, near], 12)


#: The words of MISSED, as identifier_words splits it.
ASSIST_WORDS = ("split", "fresh", "nodes")


def doc_excerpt_extract(spark: SparkSession, sf: str) -> DataFrame:
    doc = first_doc_comment(F.col("content"))
    return chunks(spark, sf).select("chunk_id", F.length(clip(F.col("content"))).alias("clipped"), (F.length("content") > 500).alias("truncated"), F.length(doc).alias("doc_length"))


def scope_glob_filter(spark: SparkSession, sf: str) -> DataFrame:
    return chunks(spark, sf).filter(glob_match(F.col("file_path"), "harborline/**/src/*/*.ts")).groupBy("file_path").agg(F.count("*").alias("n_chunks"))


def prefix_range_scan(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "files").filter(F.col("path").startswith("harborline/packages/b")).select("file_id", "path")


def identifier_bm25_topk(spark: SparkSession, sf: str) -> DataFrame:
    """BM25 over the identifier bags instead of the text."""
    bags = chunks(spark, sf).select("chunk_id", F.array_join(identifiers(F.col("content")), " ").alias("content"))
    got = S.top(S.bm25(bags, ASKED), LIMIT, F.asc("score"), F.asc("chunk_id"))
    return got.select("query_id", "rank", "chunk_id", F.round("score", 6).alias("score"))


def word_bag_match(spark: SparkSession, sf: str) -> DataFrame:
    """Chunks by how many words of a camel-case name their identifiers' parts hold."""
    wanted = F.array(*[F.lit(w) for w in ("flush", "remote", "schema", "budget")])
    bags = chunks(spark, sf).select("chunk_id", identifier_words(F.array_join(identifiers(F.col("content")), " ")).alias("words"))
    return bags.select("chunk_id", F.size(F.array_intersect("words", wanted)).alias("n_words")).filter("n_words >= 3")


_SQ = "'"
_CHUNKS = "c AS (SELECT chunk_id, arg_max(struct_pack(file_path, start_line, content, chunk_type, symbol_name, parent_symbol, is_exported), file_mtime) AS s FROM chunks GROUP BY chunk_id), k AS (SELECT chunk_id, s.* FROM c)".replace(
    "struct_pack(file_path, start_line, content, chunk_type, symbol_name, parent_symbol, is_exported)",
    "struct_pack(file_path := file_path, start_line := start_line, content := content, chunk_type := chunk_type, symbol_name := symbol_name, parent_symbol := parent_symbol, is_exported := is_exported)",
)


def _bm25_sql(scope: str = "") -> str:
    """CTE scored(query_id, chunk_id, score): the BM25 formula, for terms that do not overlap themselves."""
    terms = ", ".join(f"({qid}, {i}, '{t}')" for qid, q in ASKED for i, t in enumerate(S.query_terms(q)))
    return f"""{_CHUNKS}, t(query_id, pos, term) AS (VALUES {terms}), low AS (SELECT chunk_id, file_path, lower(content) AS x, greatest(length(content) - 2, 0) AS d FROM k),
st AS (SELECT count(*) AS n_all, sum(d) AS d_all FROM low),
f AS (SELECT term, chunk_id, file_path, d, (length(x) - length(replace(x, term, ''))) / length(term) AS f FROM low, (SELECT DISTINCT term FROM t) u WHERE contains(x, term)),
df AS (SELECT term, count(*) AS n FROM f GROUP BY term),
scored AS (SELECT query_id, chunk_id, -sum(CASE WHEN ln((n_all - n + 0.5) / (n + 0.5)) <= 0 THEN 1e-6 ELSE ln((n_all - n + 0.5) / (n + 0.5)) END * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * d / (d_all / n_all)))) AS score
  FROM t JOIN f USING (term) JOIN df USING (term), st {scope} GROUP BY query_id, chunk_id)"""


def _declared_sql(scope: str = "") -> str:
    terms = ", ".join(f"({qid}, '{t.lower()}')" for qid, q in ASKED for t in S.name_terms(q))
    return f"""dt(query_id, key) AS (VALUES {terms}), nk AS (SELECT chunk_id, lower(symbol_name) AS key, 'full' AS kind FROM k WHERE symbol_name IS NOT NULL {scope}
  UNION ALL SELECT chunk_id, split_part(lower(symbol_name), '.', -1), 'segment' FROM k WHERE symbol_name LIKE '%.%' {scope}),
db AS (SELECT query_id, chunk_id, min(kind) AS match, arg_min(key, kind || key) AS key FROM nk JOIN dt USING (key) GROUP BY query_id, chunk_id),
dm AS (SELECT *, count(*) OVER (PARTITION BY query_id, key) AS multiplicity FROM db),
dr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY match, multiplicity, chunk_id) AS d_rank FROM dm), dd AS (SELECT * FROM dr WHERE d_rank <= {4 * LIMIT})"""


_RANKED = f"fr AS (SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9), chunk_id) AS f_rank FROM scored), ff AS (SELECT * FROM fr WHERE f_rank <= {8 * LIMIT})"
_FUSED = f"""fu AS (SELECT query_id, chunk_id, f_rank, d_rank, coalesce(1.0::DOUBLE / (60 + f_rank), 0) + coalesce(1.0::DOUBLE / (60 + d_rank), 0) AS rrf FROM ff FULL JOIN dd USING (query_id, chunk_id)),
fo AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rrf DESC, f_rank NULLS LAST, d_rank NULLS LAST, chunk_id) AS rank FROM fu)"""
_DEDUP = """cl AS (SELECT r.*, CASE WHEN (chunk_type = 'class_shell' AND symbol_name IS NOT NULL) THEN file_path || '|' || symbol_name WHEN (chunk_type = 'method' AND parent_symbol IS NOT NULL) THEN file_path || '|' || parent_symbol END AS ck FROM ranked r),
fk AS (SELECT *, first_value(chunk_type) OVER (PARTITION BY query_id, ck ORDER BY rank) AS fk FROM cl),
kp AS (SELECT *, (ck IS NULL OR chunk_type = fk) AS kept FROM fk), nr AS (SELECT *, sum(kept::INT) OVER (PARTITION BY query_id ORDER BY rank) AS nr FROM kp),
cu AS (SELECT * FROM nr WHERE nr < {limit} OR (nr = {limit} AND kept)), go AS (SELECT query_id, ck, string_agg(symbol_name, ',' ORDER BY rank) AS gone FROM cu WHERE NOT kept GROUP BY query_id, ck),
ke AS (SELECT *, row_number() OVER (PARTITION BY query_id, ck ORDER BY rank) AS nth FROM cu WHERE kept),
done AS (SELECT ke.query_id, ke.chunk_id, CAST(nr AS BIGINT) AS rank, CASE WHEN nth = 1 AND ke.ck IS NOT NULL THEN gone END AS hint FROM ke LEFT JOIN go ON ke.query_id = go.query_id AND ke.ck = go.ck)"""


_TS = glob_to_regex("**/*.ts")


def _tri(c: str) -> str:
    return f"list_distinct(list_transform(range(1, length({c}) - 1), lambda i: substr(lower({c}), i, 3)))"


def _dice(a: str, b: str) -> str:
    return f"CASE WHEN length({a}) >= 3 AND length({b}) >= 3 THEN 2.0::DOUBLE * len(list_intersect({_tri(a)}, {_tri(b)})) / (len({_tri(a)}) + len({_tri(b)})) ELSE 0 END"


_TOKENS = "list_filter(regexp_split_to_array(lower(content), '[^A-Za-z0-9]+'), lambda x: x <> '')"
_PHRASE = " UNION ALL ".join(f"SELECT '{p}' AS phrase, count(*) FILTER (WHERE (' ' || array_to_string({_TOKENS}, ' ') || ' ') LIKE '% {p} %') AS n_chunks FROM k" for p in ["never more than", "copyright 2025", "new map", "let i"])

QUERIES = {
    f.__name__: f
    for f in (
        search_bm25_topk, search_bm25_scoped, identifier_phrase_count, identifier_near_miss, split_identifier_terms, trigram_similarity_topk, declex_rank, rrf_fusion, fused_search,
        fused_search_exported, fusion_window_effects, identifier_bm25_topk, word_bag_match, shell_method_dedup, shell_method_dedup_all, zero_result_assist, doc_excerpt_extract, scope_glob_filter, prefix_range_scan,
    )
}
ORACLE = {
    "search_bm25_topk": f"WITH {_bm25_sql()}, {_RANKED} SELECT query_id, CAST(f_rank AS INT) AS rank, chunk_id, round(score, 6) AS score FROM ff WHERE f_rank <= {LIMIT}",
    "search_bm25_scoped": f"WITH {_bm25_sql(f'WHERE regexp_matches(file_path, {_SQ}{glob_to_regex(SCOPE)}{_SQ})')}, {_RANKED} SELECT query_id, CAST(f_rank AS INT) AS rank, chunk_id, round(score, 6) AS score FROM ff WHERE f_rank <= {LIMIT}",
    "identifier_phrase_count": f"WITH {_CHUNKS} {_PHRASE}",
    "identifier_near_miss": f"WITH {_CHUNKS} SELECT chunk_id, len(list_intersect(['scaffold', 'istanbul', 'typings'], list_distinct({_TOKENS}))) AS n_terms FROM k WHERE list_has_any({_TOKENS}, ['scaffold', 'istanbul', 'typings'])",
    "trigram_similarity_topk": f"WITH {_CHUNKS}, n AS (SELECT DISTINCT symbol_name, file_path, start_line FROM k WHERE symbol_name IS NOT NULL AND chunk_type <> 'method'), s AS (SELECT *, {_dice(_SQ + 'flushRemoteSchema' + _SQ, 'symbol_name')} AS score FROM n), r AS (SELECT *, row_number() OVER (ORDER BY score DESC, file_path, start_line, symbol_name) AS rank FROM s WHERE score >= 0.3) SELECT CAST(rank AS INT) AS rank, symbol_name, file_path, round(score, 9) AS score FROM r WHERE rank <= 20",
    "declex_rank": f"WITH {_CHUNKS}, {_declared_sql()} SELECT query_id, CAST(d_rank AS INT) AS d_rank, chunk_id, match, multiplicity FROM dd",
    "rrf_fusion": f"WITH {_bm25_sql()}, {_RANKED}, {_declared_sql()}, {_FUSED} SELECT query_id, CAST(rank AS INT) AS rank, chunk_id, round(rrf, 12) AS rrf FROM fo WHERE rank <= {4 * LIMIT}",
    "fused_search": f"WITH {_bm25_sql()}, {_RANKED}, {_declared_sql()}, {_FUSED}, ranked AS (SELECT fo.*, k.* EXCLUDE (chunk_id) FROM fo JOIN k USING (chunk_id) WHERE rank <= {4 * LIMIT}), {_DEDUP.format(limit=LIMIT)} SELECT done.query_id, done.rank, chunk_id, round(rrf, 12) AS rrf, hint FROM done JOIN fo USING (query_id, chunk_id)",
    "fused_search_exported": f"WITH {_bm25_sql(f'WHERE regexp_matches(file_path, {_SQ}{_TS}{_SQ})')}, {_RANKED}, {_declared_sql(f'AND regexp_matches(file_path, {_SQ}{_TS}{_SQ})')}, {_FUSED}, ranked AS (SELECT fo.*, k.* EXCLUDE (chunk_id) FROM fo JOIN k USING (chunk_id) WHERE rank <= {4 * LIMIT} AND is_exported), {_DEDUP.format(limit=LIMIT)} SELECT query_id, rank, chunk_id FROM done",
    "shell_method_dedup_all": f"WITH {_CHUNKS}, ranked AS (SELECT *, split_part(file_path, '/', 1) AS query_id, row_number() OVER (PARTITION BY split_part(file_path, '/', 1) ORDER BY length(content) DESC, chunk_id) AS rank FROM k), {_DEDUP.format(limit=1 << 62)} SELECT query_id AS repo, chunk_id, rank, hint FROM done",
    "fusion_window_effects": f"WITH {_bm25_sql()}, {_RANKED}, {_declared_sql()}, {_FUSED}, a AS (SELECT query_id, chunk_id, CAST(rank AS INT) AS rank_with FROM fo WHERE rank <= {LIMIT}), b AS (SELECT query_id, chunk_id, CAST(f_rank AS INT) AS rank_without FROM ff WHERE f_rank <= {LIMIT}) SELECT * FROM a FULL JOIN b USING (query_id, chunk_id) WHERE rank_with IS DISTINCT FROM rank_without",
    "shell_method_dedup": f"WITH {_CHUNKS}, ranked AS (SELECT *, split_part(file_path, '/', 1) AS query_id, row_number() OVER (PARTITION BY split_part(file_path, '/', 1) ORDER BY length(content) DESC, chunk_id) AS rank FROM k), {_DEDUP.format(limit=50)} SELECT query_id AS repo, chunk_id, rank, hint FROM done",
    "split_identifier_terms": f"WITH {_CHUNKS}, n AS (SELECT DISTINCT symbol_name FROM k WHERE symbol_name IS NOT NULL), w AS (SELECT symbol_name, list_filter(list_transform(regexp_split_to_array(regexp_replace(regexp_replace(symbol_name, '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '([A-Z]+)([A-Z][a-z])', '\\1 \\2', 'g'), '[^A-Za-z0-9]+'), lambda x: lower(x)), lambda x: length(x) >= 3) AS w FROM n) SELECT symbol_name, array_to_string(list_filter(w, lambda x, i: list_position(w, x) = i), ' ') AS words FROM w",
    "doc_excerpt_extract": f"WITH {_CHUNKS} SELECT chunk_id, CASE WHEN length(content) > 500 THEN 501 ELSE length(content) END AS clipped, length(content) > 500 AS truncated, nullif(length(regexp_extract(content, '(?s)/\\*\\*.*?\\*/')), 0) AS doc_length FROM k",
    "scope_glob_filter": f"WITH {_CHUNKS} SELECT file_path, count(*) AS n_chunks FROM k WHERE regexp_matches(file_path, '{glob_to_regex('harborline/**/src/*/*.ts')}') GROUP BY 1",
    "prefix_range_scan": "SELECT file_id, path FROM files WHERE path >= 'harborline/packages/b' AND path < 'harborline/packages/c'",
}
