"""Graph queries over symbols, edges, imports and re-exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fernglass.functions.paths import canonical_path
from fernglass.functions.text import pascal_types
from fernglass.operators import checker as C
from fernglass.operators import graph as G
from fernglass.operators.chunks import latest, once
from fernglass.plans.graph_orphans import _sql_path
from fernglass.session import table


def symbols(spark: SparkSession, sf: str) -> DataFrame:
    return G.current_symbols(table(spark, sf, "symbols"))


def edges(spark: SparkSession, sf: str) -> DataFrame:
    return G.distinct_edges(table(spark, sf, "edges"))


def imports(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "imports").select("import_id", "file_path", "ordinal", "module", "symbols", "is_external", canonical_path(F.col("resolved_path")).alias("resolved_path"))
    return once(rows, "import_id")


def _calls(spark: SparkSession, sf: str) -> DataFrame:
    return edges(spark, sf).filter("edge_type = 'POTENTIAL_CALL'").select(F.col("from_id").alias("src"), F.col("to_id").alias("dst"))


def _most_called(spark: SparkSession, sf: str) -> DataFrame:
    return _calls(spark, sf).groupBy("dst").count().orderBy(F.desc("count"), "dst").limit(3).select(F.col("dst").alias("node"))


def graph_direct_callers(spark: SparkSession, sf: str) -> DataFrame:
    return G.direct_callers(edges(spark, sf), symbols(spark, sf))


def graph_transitive_callers(spark: SparkSession, sf: str) -> DataFrame:
    return G.closure(_calls(spark, sf), _most_called(spark, sf))


def graph_transitive_callers_all(spark: SparkSession, sf: str) -> DataFrame:
    """(target, node, depth): the callers of every called symbol."""
    return G.closure_of_all(_calls(spark, sf))


def graph_bounded_chain(spark: SparkSession, sf: str) -> DataFrame:
    calls = _calls(spark, sf).groupBy("src").agg(F.min("dst").alias("dst"))
    return G.chain(calls)


def graph_named_chain(spark: SparkSession, sf: str) -> DataFrame:
    """The declaration at the end of every named re-export."""
    return G.named_chain(edges(spark, sf), symbols(spark, sf))


def _stars(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "re_export_files").filter("to_file_id is not null and to_file_id <> from_file_id").select(F.col("from_file_id").alias("src"), F.col("to_file_id").alias("dst")).distinct()


def graph_star_closure_named_wins(spark: SparkSession, sf: str) -> DataFrame:
    """Files that re-export a file of the first repository by star, without those that name a symbol of theirs in an edge."""
    homes = table(spark, sf, "files").filter(F.col("path").startswith("harborline/") | F.col("path").startswith("mosswick/")).select(F.col("file_id").alias("node"))
    found = G.closure(_stars(spark, sf), homes)
    return found.join(_named(spark, sf), "node", "left_anti").withColumnRenamed("node", "file_id")


def _named(spark: SparkSession, sf: str) -> DataFrame:
    named = edges(spark, sf).filter("edge_type = 'RE_EXPORTS'").select(F.col("from_id").alias("symbol_id")).join(symbols(spark, sf), "symbol_id").select(F.col("file_path").alias("path"))
    return table(spark, sf, "files").join(named, "path", "left_semi").select(F.col("file_id").alias("node"))


def graph_star_closure_all(spark: SparkSession, sf: str) -> DataFrame:
    """(target, file_id, depth): as graph_star_closure_named_wins, from every re-exported file of every repository."""
    stars = _stars(spark, sf)
    found = G.closure(stars, stars.select(F.col("dst").alias("target"), F.col("dst").alias("node")), by=("target",))
    return found.join(_named(spark, sf), "node", "left_anti").withColumnRenamed("node", "file_id")


def graph_in_degree(spark: SparkSession, sf: str) -> DataFrame:
    return G.in_degree(edges(spark, sf))


def graph_pagerank(spark: SparkSession, sf: str) -> DataFrame:
    links = edges(spark, sf).filter(F.col("edge_type").isin("POTENTIAL_CALL", "IMPLEMENTS")).select(F.col("from_id").alias("src"), F.col("to_id").alias("dst"))
    return G.pagerank(links, symbols(spark, sf).select(F.col("symbol_id").alias("id")))


def symbol_lookup_exported_first(spark: SparkSession, sf: str) -> DataFrame:
    return G.lookup_names(symbols(spark, sf).filter("kind <> 'export'")).select("name", "place", "symbol_id")


def implementors_with_methods(spark: SparkSession, sf: str) -> DataFrame:
    return G.implementors(edges(spark, sf), symbols(spark, sf))


def type_context_priority(spark: SparkSession, sf: str) -> DataFrame:
    chunks = latest(table(spark, sf, "chunks"), "chunk_id", "file_mtime", ["chunk_id", "file_path", "content", "chunk_type"]).filter(F.col("chunk_type").isin("function", "method"))
    wanted = chunks.select("file_path", F.explode(pascal_types(F.col("content"))).alias("type_name"))
    return G.resolve_types(wanted, symbols(spark, sf), imports(spark, sf))


def raw_calls(spark: SparkSession, sf: str) -> DataFrame:
    """Call records as extraction leaves them: names and evidence, targets not resolved."""
    s = symbols(spark, sf)
    e = edges(spark, sf).filter("edge_type = 'POTENTIAL_CALL'")
    src, dst = s.select(F.col("symbol_id").alias("from_id"), "file_path"), s.select(F.col("symbol_id").alias("to_id"), F.col("name").alias("to_name"))
    return e.join(src, "from_id").join(dst, "to_id").select("file_path", F.col("edge_id").alias("ordinal"), "to_name", "resolution")


def edge_resolution_rules(spark: SparkSession, sf: str) -> DataFrame:
    return G.resolve_calls(raw_calls(spark, sf), symbols(spark, sf), imports(spark, sf))


def edge_resolution_chains(spark: SparkSession, sf: str) -> DataFrame:
    """As edge_resolution_rules, with imports followed through named and star re-exports."""
    files = table(spark, sf, "files").filter("deleted_at is null")
    return G.resolve_calls(raw_calls(spark, sf), symbols(spark, sf), imports(spark, sf), (edges(spark, sf), files, _stars(spark, sf)))


def edge_insert_ignore(spark: SparkSession, sf: str) -> DataFrame:
    return edges(spark, sf)


def project_skeleton(spark: SparkSession, sf: str) -> DataFrame:
    return G.skeleton(symbols(spark, sf), "harborline/packages", 4)


def dependencies_explode(spark: SparkSession, sf: str) -> DataFrame:
    rows = imports(spark, sf).select("import_id", "file_path", "module", "is_external", "resolved_path", F.explode_outer("symbols").alias("symbol"))
    return rows.select("import_id", "file_path", "module", "is_external", "resolved_path", "symbol")


def exports_by_file(spark: SparkSession, sf: str) -> DataFrame:
    rows = symbols(spark, sf).filter("is_exported and kind <> 'method'")
    return G.page(rows, ["file_path"], 3, F.col("line"), F.col("ordinal"), F.col("symbol_id")).select("file_path", "place", "name", "truncated_total")


def honest_page_cap(spark: SparkSession, sf: str) -> DataFrame:
    rows = G.direct_callers(edges(spark, sf), symbols(spark, sf))
    return G.page(rows, ["target_id"], 5, F.col("file_path"), F.col("line"), F.col("caller_id")).select("target_id", "place", "caller_id", "truncated_total")


def named_symbols(spark: SparkSession, sf: str) -> DataFrame:
    """(symbol_id, name, bare, file_path) of every declaration; bare is the last part of the name."""
    return symbols(spark, sf).filter("kind <> 'export'").select("symbol_id", "name", F.substring_index("name", ".", -1).alias("bare"), "file_path")


def potential_matches_anti(spark: SparkSession, sf: str) -> DataFrame:
    """Chunks that mention a symbol's bare name in files without a verified call of it, counted by symbol.

    Mentions are counted by name and file before symbols come in, so a name
    that many symbols share is never paired with each of its mentions.
    """
    s = named_symbols(spark, sf)
    c = latest(table(spark, sf, "chunks"), "chunk_id", "file_mtime", ["chunk_id", "file_path", "start_line", "content", "chunk_type"]).filter("chunk_type <> 'class_shell'")
    words = c.select("file_path", F.explode(F.array_distinct(F.regexp_extract_all("content", F.lit(r"\b[A-Za-z_$][A-Za-z0-9_$]*\b"), F.lit(0)))).alias("bare"))
    mentions = words.groupBy("bare", "file_path").agg(F.count("*").alias("n"))
    verified = G.direct_callers(edges(spark, sf), symbols(spark, sf)).select(F.col("target_id").alias("symbol_id"), "file_path").distinct()
    known = verified.join(s.select("symbol_id", "bare"), "symbol_id").join(mentions, ["bare", "file_path"]).groupBy("symbol_id").agg(F.sum("n").alias("known"))
    total = mentions.groupBy("bare").agg(F.sum("n").alias("total"))
    left = F.col("total") - F.coalesce("known", F.lit(0))
    return s.join(total, "bare").join(known, "symbol_id", "left").select("symbol_id", "name", left.alias("n_chunks")).filter("n_chunks > 0")


def rename_impact(spark: SparkSession, sf: str) -> DataFrame:
    """For the function with the most callers."""
    s = symbols(spark, sf)
    names = _most_called(spark, sf).join(s, F.col("node") == F.col("symbol_id")).select("name").orderBy("name").limit(1).collect()
    return G.rename_impact(edges(spark, sf), s, table(spark, sf, "re_export_files"), names[0].name if names else "")


def call_site_verdicts(spark: SparkSession, sf: str) -> DataFrame:
    """Syntactic verdict of every mention of a declared name outside its own file, by symbol."""
    s = named_symbols(spark, sf).select("symbol_id", "name", F.col("file_path").alias("home"))
    files = table(spark, sf, "files").filter("deleted_at is null and content is not null and not path like '%.md'").select("path", "content", "mtime")
    found = C.mentions(files, s).join(s.select("symbol_id", "home"), "symbol_id").filter("file_path <> home")
    return C.fresh(C.classify(found), files).groupBy("symbol_id", "verdict").agg(F.count("*").alias("n_sites"))


def checker_buckets(spark: SparkSession, sf: str) -> DataFrame:
    """Possible call sites by the package that owns their file."""
    s = named_symbols(spark, sf).select("symbol_id", "name")
    files = table(spark, sf, "files").filter("deleted_at is null and content is not null").select("path", "content", "mtime")
    projects = files.filter("not path like '%.md'").select(F.col("path").alias("file_path"), F.substring_index("path", "/", 1).alias("project"))
    return C.bucket_projects(C.mentions(files, s), projects)


_BASE = f"""s AS (SELECT symbol_id, arg_max(struct_pack(name := name, kind := kind, file_path := file_path, line := line, ordinal := ordinal, is_exported := is_exported), indexed_at) AS x FROM symbols WHERE deleted_at IS NULL GROUP BY symbol_id),
sy AS (SELECT symbol_id, x.* FROM s), e AS (SELECT from_id, to_id, edge_type, min(edge_id) AS edge_id FROM edges WHERE to_id <> '' GROUP BY ALL),
ed AS (SELECT DISTINCT e.*, resolution, call_line, context FROM e JOIN edges o USING (edge_id, from_id, to_id, edge_type)),
im AS (SELECT DISTINCT import_id, file_path, ordinal, module, symbols, is_external, {_sql_path('resolved_path')} AS resolved_path FROM imports),
dc AS (SELECT to_id AS target_id, from_id AS caller_id, name AS caller, file_path, coalesce(call_line, line) AS line, coalesce(context, '') AS context, coalesce(resolution, 'same_file') AS resolution FROM ed JOIN sy ON from_id = symbol_id WHERE edge_type = 'POTENTIAL_CALL'),
ca AS (SELECT DISTINCT from_id AS src, to_id AS dst FROM ed WHERE edge_type = 'POTENTIAL_CALL')"""
_R = f"WITH RECURSIVE {_BASE}"
_W = f"WITH {_BASE}"
_LATEST = "ch AS (SELECT chunk_id, arg_max(struct_pack(file_path := file_path, content := content, chunk_type := chunk_type), file_mtime) AS c FROM chunks GROUP BY chunk_id)"

QUERIES = {
    f.__name__: f
    for f in (
        graph_direct_callers, graph_transitive_callers, graph_transitive_callers_all, graph_bounded_chain, graph_named_chain, graph_star_closure_named_wins, graph_star_closure_all, graph_in_degree, graph_pagerank, symbol_lookup_exported_first, implementors_with_methods,
        type_context_priority, edge_resolution_rules, edge_resolution_chains, edge_insert_ignore, project_skeleton, dependencies_explode, exports_by_file, honest_page_cap, potential_matches_anti, rename_impact, call_site_verdicts, checker_buckets,
    )
}
ORACLE = {
    "graph_direct_callers": _W + " SELECT * FROM dc",
    "graph_transitive_callers": _R
    + """, top AS (SELECT dst FROM ca GROUP BY dst ORDER BY count(*) DESC, dst LIMIT 3), up(node, depth) AS (SELECT src, 1 FROM ca WHERE dst IN (SELECT dst FROM top)
  UNION SELECT ca.src, depth + 1 FROM up JOIN ca ON ca.dst = up.node WHERE depth < 60) SELECT node, min(depth) AS depth FROM up GROUP BY node""",
    "graph_bounded_chain": _W
    + """, l AS (SELECT src, min(dst) AS dst FROM ca GROUP BY src), a1 AS (SELECT src AS node, dst AS e, 1 AS hops FROM l),
  a2 AS (SELECT node, coalesce(dst, e) AS e, hops + (dst IS NOT NULL)::INT AS hops FROM a1 LEFT JOIN l ON e = src), a3 AS (SELECT node, coalesce(dst, e) AS e, hops + (dst IS NOT NULL)::INT AS hops FROM a2 LEFT JOIN l ON e = src),
  a4 AS (SELECT node, coalesce(dst, e) AS e, hops + (dst IS NOT NULL)::INT AS hops FROM a3 LEFT JOIN l ON e = src), a5 AS (SELECT node, coalesce(dst, e) AS e, hops + (dst IS NOT NULL)::INT AS hops FROM a4 LEFT JOIN l ON e = src)
  SELECT node, e AS "end", hops FROM a5""",
    "graph_star_closure_named_wins": _R
    + """, st AS (SELECT DISTINCT from_file_id AS src, to_file_id AS dst FROM re_export_files WHERE to_file_id IS NOT NULL AND to_file_id <> from_file_id),
  up(node, depth) AS (SELECT src, 1 FROM st JOIN files ON dst = file_id WHERE path LIKE 'harborline/%' OR path LIKE 'mosswick/%' UNION SELECT st.src, depth + 1 FROM up JOIN st ON st.dst = up.node WHERE depth < 30)
  SELECT node AS file_id, min(depth) AS depth FROM up WHERE node NOT IN (SELECT file_id FROM files JOIN (SELECT file_path FROM ed JOIN sy ON from_id = symbol_id WHERE edge_type = 'RE_EXPORTS') n ON path = file_path) GROUP BY node""",
    "graph_in_degree": _W + " SELECT to_id, count(*) AS in_degree FROM ed WHERE edge_type IN ('POTENTIAL_CALL', 'IMPLEMENTS') GROUP BY to_id",
    "symbol_lookup_exported_first": _W + " SELECT name, CAST(row_number() OVER (PARTITION BY name ORDER BY is_exported DESC, file_path, line, ordinal, symbol_id) AS INT) AS place, symbol_id FROM sy WHERE kind <> 'export'",
    "implementors_with_methods": _W
    + """, m AS (SELECT split_part(name, '.', 1) AS class, file_path, string_agg(split_part(name, '.', -1), ',' ORDER BY line, split_part(name, '.', -1)) AS methods FROM (SELECT DISTINCT name, file_path, line FROM sy WHERE kind = 'method') GROUP BY 1, 2)
  SELECT i.name AS interface, c.name AS class, c.file_path, c.line, coalesce(methods, '') AS methods FROM ed JOIN sy i ON to_id = i.symbol_id AND i.kind = 'interface' JOIN sy c ON from_id = c.symbol_id LEFT JOIN m ON m.class = c.name AND m.file_path = c.file_path WHERE edge_type = 'IMPLEMENTS'""",
    "type_context_priority": _W
    + f""", {_LATEST}, w AS (SELECT DISTINCT c.file_path, unnest(regexp_extract_all(c.content, '\\b[A-Z][A-Za-z0-9]*\\b')) AS type_name FROM ch WHERE c.chunk_type IN ('function', 'method')),
  ty AS (SELECT symbol_id, name AS type_name, file_path AS home, line, is_exported FROM sy WHERE kind IN ('interface', 'type', 'class_shell')), nm AS (SELECT DISTINCT file_path, resolved_path, unnest(symbols) AS type_name FROM im WHERE resolved_path IS NOT NULL),
  al AS (SELECT file_path, type_name, 1 AS priority, symbol_id, home, line FROM w JOIN ty USING (type_name) WHERE home = file_path UNION ALL SELECT w.file_path, w.type_name, 2, symbol_id, home, line FROM w JOIN nm USING (file_path, type_name) JOIN ty USING (type_name) WHERE home = resolved_path
  UNION ALL SELECT file_path, type_name, 3, symbol_id, home, line FROM w JOIN ty USING (type_name) WHERE is_exported)
  SELECT file_path, type_name, priority, symbol_id, home FROM al WHERE type_name NOT IN ({", ".join(f"'{t}'" for t in ("Function", "Object", "Promise", "Array", "Map", "Set", "WeakMap", "WeakSet", "Record", "Partial", "Error"))}) QUALIFY row_number() OVER (PARTITION BY file_path, type_name ORDER BY priority, home, line, symbol_id) = 1""",
    "edge_resolution_rules": _W
    + """, rc AS (SELECT f.file_path, edge_id, t.name AS to_name, resolution FROM ed JOIN sy f ON from_id = f.symbol_id JOIN sy t ON to_id = t.symbol_id WHERE edge_type = 'POTENTIAL_CALL'),
  fi AS (SELECT * FROM rc QUALIFY row_number() OVER (PARTITION BY file_path, to_name ORDER BY edge_id) = 1),
  he AS (SELECT name, file_path, symbol_id FROM sy WHERE kind <> 'export' QUALIFY row_number() OVER (PARTITION BY name, file_path ORDER BY line, ordinal, symbol_id) = 1),
  an AS (SELECT name, symbol_id FROM sy WHERE kind <> 'export' QUALIFY row_number() OVER (PARTITION BY name ORDER BY file_path, line, ordinal, symbol_id) = 1),
  na AS (SELECT file_path, ordinal, resolved_path, unnest(symbols) AS i_name, generate_subscripts(symbols, 1) AS p FROM im), nf AS (SELECT * FROM na QUALIFY row_number() OVER (PARTITION BY file_path, i_name ORDER BY ordinal, p) = 1),
  j AS (SELECT fi.file_path, fi.to_name, resolution, nf.i_name, v.symbol_id AS v_id, d.symbol_id AS d_id, g.symbol_id AS g_id FROM fi
    LEFT JOIN nf ON nf.file_path = fi.file_path AND nf.i_name = CASE WHEN resolution IN ('field_type', 'parameter_type', 'new_expression', 'super_method') THEN split_part(to_name, '.', 1) ELSE to_name END
    LEFT JOIN he v ON v.name = to_name AND v.file_path = nf.resolved_path LEFT JOIN he d ON d.name = to_name AND d.file_path = fi.file_path LEFT JOIN an g ON g.name = to_name)
  SELECT file_path, to_name, resolution AS rule, CASE WHEN resolution IN ('same_file', 'this_method') THEN d_id WHEN resolution = 'import' THEN v_id WHEN resolution = 'super_method' THEN CASE WHEN i_name IS NOT NULL THEN v_id ELSE d_id END
    WHEN resolution IN ('field_type', 'parameter_type', 'new_expression') THEN coalesce(CASE WHEN i_name IS NOT NULL THEN v_id ELSE d_id END, g_id) ELSE g_id END AS symbol_id FROM j
  WHERE CASE WHEN resolution IN ('same_file', 'this_method') THEN d_id WHEN resolution = 'import' THEN v_id WHEN resolution = 'super_method' THEN CASE WHEN i_name IS NOT NULL THEN v_id ELSE d_id END
    WHEN resolution IN ('field_type', 'parameter_type', 'new_expression') THEN coalesce(CASE WHEN i_name IS NOT NULL THEN v_id ELSE d_id END, g_id) ELSE g_id END IS NOT NULL""",
    "edge_insert_ignore": _W + " SELECT * FROM ed",
    "rename_impact": _R
    + """, top AS (SELECT dst FROM ca GROUP BY dst ORDER BY count(*) DESC, dst LIMIT 3), f AS (SELECT * FROM sy WHERE name = (SELECT min(name) FROM sy WHERE symbol_id IN (SELECT dst FROM top))),
  rx AS (SELECT DISTINCT from_path AS src, to_path AS dst FROM re_export_files WHERE from_path IS NOT NULL AND to_path IS NOT NULL),
  up(node, depth) AS (SELECT src, 1 FROM rx WHERE dst IN (SELECT file_path FROM f) UNION SELECT rx.src, depth + 1 FROM up JOIN rx ON rx.dst = up.node WHERE depth < 40)
  SELECT 'declaration' AS part, file_path, line, name AS detail FROM f UNION ALL SELECT 'caller', file_path, line, caller FROM dc WHERE target_id IN (SELECT symbol_id FROM f)
  UNION ALL SELECT 'barrel', node, NULL, 'depth ' || min(depth) FROM up GROUP BY node""",
    "checker_buckets": _W
    + """, l AS (SELECT path, unnest(string_split(content, chr(10))) AS t, generate_subscripts(string_split(content, chr(10)), 1) AS i FROM files WHERE deleted_at IS NULL AND content IS NOT NULL),
  w AS (SELECT DISTINCT path, i, unnest(regexp_extract_all(t, '\\b[A-Za-z_$][\\w$]*\\b')) AS bare FROM l)
  SELECT CASE WHEN path LIKE '%.md' THEN NULL ELSE split_part(path, '/', 1) END AS project, count(*) AS n_candidates FROM w JOIN sy ON bare = split_part(sy.name, '.', -1) AND kind <> 'export' GROUP BY 1""",
    "project_skeleton": _W
    + """ SELECT file_path, string_agg(name, ',' ORDER BY line, ordinal, name) AS exports, count(*) AS n_exports FROM sy WHERE is_exported AND kind <> 'method' AND starts_with(file_path, 'harborline/packages')
  AND length(ltrim(substr(file_path, 20), '/')) - length(replace(ltrim(substr(file_path, 20), '/'), '/', '')) < 4 GROUP BY file_path""",
    "dependencies_explode": _W + " SELECT import_id, file_path, module, is_external, resolved_path, symbol FROM im LEFT JOIN LATERAL (SELECT unnest(symbols) AS symbol) ON true",
    "exports_by_file": _W
    + " SELECT file_path, CAST(p AS INT) AS place, name, CASE WHEN n > 3 THEN n END AS truncated_total FROM (SELECT *, row_number() OVER (PARTITION BY file_path ORDER BY line, ordinal, symbol_id) AS p, count(*) OVER (PARTITION BY file_path) AS n FROM sy WHERE is_exported AND kind <> 'method') WHERE p <= 3",
    "honest_page_cap": _W
    + " SELECT target_id, CAST(p AS INT) AS place, caller_id, CASE WHEN n > 5 THEN n END AS truncated_total FROM (SELECT *, row_number() OVER (PARTITION BY target_id ORDER BY file_path, line, caller_id) AS p, count(*) OVER (PARTITION BY target_id) AS n FROM dc) WHERE p <= 5",
    "potential_matches_anti": _W
    + f""", {_LATEST}, w AS (SELECT DISTINCT chunk_id, c.file_path AS file_path, unnest(regexp_extract_all(c.content, '\\b[A-Za-z_$][A-Za-z0-9_$]*\\b')) AS name FROM ch WHERE c.chunk_type <> 'class_shell'),
  h AS (SELECT chunk_id, w.file_path, symbol_id, sy.name FROM w JOIN sy ON w.name = split_part(sy.name, '.', -1) WHERE kind <> 'export') SELECT symbol_id, name, count(*) AS n_chunks FROM h ANTI JOIN (SELECT DISTINCT target_id AS symbol_id, file_path FROM dc) v USING (symbol_id, file_path) GROUP BY 1, 2""",
}
