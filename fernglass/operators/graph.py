"""Code graph: lookups, closures, edge resolution and centrality."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fernglass.operators.chunks import current
from fernglass.operators.reach import Reach
from fernglass.session import materialize

SYMBOLS = ["symbol_id", "name", "kind", "file_path", "line", "ordinal", "is_exported"]


def first_by(rows: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row per key in a total order."""
    return rows.withColumn("nth", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("nth = 1").drop("nth")


def current_symbols(symbols: DataFrame) -> DataFrame:
    return current(symbols, "symbol_id", SYMBOLS)


def distinct_edges(edges: DataFrame) -> DataFrame:
    """Insert-ignore on (from, to, type): the edge with the least id survives. Combines before it shuffles."""
    s = F.min(F.struct("edge_id", "resolution", "call_line", "context")).alias("s")
    return edges.filter("to_id <> ''").groupBy("from_id", "to_id", "edge_type").agg(s).select("from_id", "to_id", "edge_type", "s.*")


def direct_callers(edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """(target_id, caller_id, caller, file_path, line, context, resolution) of every resolved call."""
    calls = edges.filter("edge_type = 'POTENTIAL_CALL'")
    rows = calls.join(symbols, calls.from_id == symbols.symbol_id)
    return rows.select(
        F.col("to_id").alias("target_id"),
        F.col("from_id").alias("caller_id"),
        F.col("name").alias("caller"),
        "file_path",
        F.coalesce("call_line", "line").alias("line"),
        F.coalesce("context", F.lit("")).alias("context"),
        F.coalesce("resolution", F.lit("same_file")).alias("resolution"),
    )


#: Rounds of a closure whose tables are merged into one.
MERGED = 16


def closure(links: DataFrame, start: DataFrame, max_depth: int | None = None, hops: int = 4, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, node, depth): everything that reaches ``start`` (by, node) against the direction of ``links`` (src, dst), start excluded unless on a cycle.

    Breadth first over written tables, apart for each value of ``by``. A round
    expands ``hops`` levels in one plan, drops what earlier rounds found and
    keeps the least depth, so cycles end it and deep chains cost few jobs.
    """
    # read in every round, so worth writing once
    links = materialize(links.select("src", "dst").distinct())
    frontier = materialize(start.select(*by, "node").distinct())
    levels, depth = [], 0
    while max_depth is None or depth < max_depth:
        seen = reduce(lambda x, y: x.unionByName(y), levels).select(*by, "node") if levels else None
        steps, at = None, frontier
        for _ in range(hops if max_depth is None else min(hops, max_depth - depth)):
            depth += 1
            at = links.join(at, links.dst == at.node).select(*by, F.col("src").alias("node")).distinct()
            at = at if seen is None else at.join(seen, [*by, "node"], "left_anti")
            level = at.withColumn("depth", F.lit(depth))
            steps = level if steps is None else steps.unionByName(level)
        # only what is new is written; every MERGED rounds the tables are made one, so plans stay short
        levels.append(materialize(steps.groupBy(*by, "node").agg(F.min("depth").alias("depth"))))
        frontier = levels[-1].filter(F.col("depth") == depth).select(*by, "node")
        if frontier.isEmpty():
            break
        if len(levels) == MERGED:
            levels = [materialize(reduce(lambda x, y: x.unionByName(y), levels))]
    return reduce(lambda x, y: x.unionByName(y), levels) if levels else start.select(*by, "node", F.lit(0).alias("depth")).limit(0)


#: Links that are shipped to the workers; beyond, they are joined. Tasks of a search.
SHIPPED, TASKS = 1 << 20, 1 << 10


def closure_of_all(links: DataFrame, shipped: int = SHIPPED) -> DataFrame:
    """(target, node, depth): ``closure`` from every dst of ``links`` (src, dst), apart for each.

    The pairs can be as many as the square of the nodes. Up to ``shipped`` links
    every task searches its targets in memory and pairs are neither shuffled
    nor written on the way; more links are joined level by level, with the same
    result.
    """
    links = materialize(links.select("src", "dst").filter("dst is not null").distinct())
    n, spark = links.count(), links.sparkSession
    if not 0 < n <= shipped:
        return closure(links, links.select(F.col("dst").alias("target"), F.col("dst").alias("node")), by=("target",))
    ends = links.toArrow()  # SHIPPED at most
    both = pa.chunked_array(ends.column("src").chunks + ends.column("dst").chunks).combine_chunks()
    # what has no name is a node that nothing reaches
    names = pc.unique(both)
    code = pc.index_in(both, names).to_numpy()
    graph = Reach(code[:n], code[n:], len(names))
    sent, batches = spark.sparkContext.broadcast(graph), graph.batches()

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for i in batch.column(0).to_pylist():
                for found in sent.value.search(i):
                    yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int32)) for x in found], names=["t", "n", "depth"])

    # one row, so that names are looked up where the pairs arise
    named = spark.createDataFrame(pa.table({"names": pa.array([names.take(pa.array(graph.order)).to_pylist()], pa.list_(both.type))}))
    pairs = spark.range(0, batches, 1, min(batches, TASKS)).mapInArrow(run, "t int, n int, depth int").crossJoin(F.broadcast(named))
    return pairs.select(F.get("names", "t").alias("target"), F.get("names", "n").alias("node"), "depth")


def chain(links: DataFrame, hops: int = 5) -> DataFrame:
    """(node, end, hops): follows single links (src, dst) up to ``hops`` steps; ``links`` has one dst per src."""
    step = links.select(F.col("src").alias("at"), F.col("dst").alias("to"))
    rows = links.select(F.col("src").alias("node"), F.col("dst").alias("end"), F.lit(1).alias("hops"))
    for _ in range(hops - 1):
        rows = rows.join(step, rows.end == step["at"], "left").select("node", F.coalesce("to", "end").alias("end"), (F.col("hops") + F.col("to").isNotNull().cast("int")).alias("hops"))
    return rows


def named_chain(edges: DataFrame, symbols: DataFrame, hops: int = 5) -> DataFrame:
    """(marker, symbol_id, hops): named re-exports followed up to ``hops`` edges to the first symbol that is no marker itself.

    A marker's edge of least id counts; a chain that is longer, runs in a circle
    or ends in a symbol that is gone has no row.
    """
    step = edges.filter("edge_type = 'RE_EXPORTS'").groupBy("from_id").agg(F.min_by("to_id", "edge_id").alias("symbol_id"))
    step = materialize(step.join(symbols.select("symbol_id", (F.col("kind") == "export").alias("again")), "symbol_id"))
    at = step.select(F.col("from_id").alias("marker"), "symbol_id", "again")
    found = []
    for hop in range(1, hops + 1):
        found.append(at.filter("not again").select("marker", "symbol_id", F.lit(hop).alias("hops")))
        at = at.filter("again").select("marker", F.col("symbol_id").alias("from_id")).join(step, "from_id").select("marker", "symbol_id", "again")
    return reduce(lambda a, b: a.unionByName(b), found)


def through_barrels(wanted: DataFrame, symbols: DataFrame, edges: DataFrame, files: DataFrame, stars: DataFrame) -> DataFrame:
    """(path, name, symbol_id) of the ``wanted`` (path, name) that a file only re-exports: by name, else by star from the file of lowest id.

    ``files`` has path and file_id, ``stars`` the re-exporting file as src and the re-exported as dst.
    """
    decl = symbols.filter("kind <> 'export'")
    wanted = materialize(wanted.select("path", "name").dropna().distinct().join(decl.select(F.col("file_path").alias("path"), "name"), ["path", "name"], "left_anti"))
    markers = symbols.filter("kind = 'export'").select(F.col("file_path").alias("path"), "name", "line", "ordinal", F.col("symbol_id").alias("marker")).join(wanted, ["path", "name"], "left_semi")
    named = first_by(markers, ["path", "name"], F.col("line"), F.col("ordinal"), F.col("marker")).join(named_chain(edges, symbols), "marker").select("path", "name", F.col("symbol_id").alias("n_id"))
    homes = files.select("path", "file_id").distinct()
    start = homes.join(wanted.select("path"), "path", "left_semi").select(F.col("path").alias("target"), F.col("file_id").alias("node"))
    reached = closure(stars.select(F.col("dst").alias("src"), F.col("src").alias("dst")), start, by=("target",))
    reached = reached.join(homes.select(F.col("file_id").alias("node"), F.col("path").alias("file_path")), "node")
    held = decl.select("file_path", "name", "line", "ordinal", "symbol_id").join(wanted.select("name").distinct(), "name", "left_semi")
    rows = wanted.join(reached.withColumnRenamed("target", "path"), "path").join(held, ["file_path", "name"])
    by_star = first_by(rows, ["path", "name"], F.col("node"), F.col("line"), F.col("ordinal"), F.col("symbol_id")).select("path", "name", F.col("symbol_id").alias("s_id"))
    return named.join(by_star, ["path", "name"], "full_outer").select("path", "name", F.coalesce("n_id", "s_id").alias("symbol_id"))


def in_degree(edges: DataFrame, types: tuple[str, ...] = ("POTENTIAL_CALL", "IMPLEMENTS")) -> DataFrame:
    return edges.filter(F.col("edge_type").isin(*types)).groupBy("to_id").agg(F.count("*").alias("in_degree"))


def pagerank(edges: DataFrame, nodes: DataFrame, *, rounds: int = 100, damping: float = 0.85, tolerance: float = 1e-8) -> DataFrame:
    """(id, rank): damped random walk with the mass of dangling nodes spread evenly, until no more than ``tolerance`` moves in a round.

    ``edges`` (src, dst; each row counts) and ``nodes`` (id) are written once; lineage is cut every round.
    """
    nodes = materialize(nodes.select("id").distinct())
    n = nodes.count()
    if n == 0:
        return nodes.withColumn("rank", F.lit(0.0))
    links = edges.select("src", "dst").join(nodes.withColumnRenamed("id", "src"), "src").join(nodes.withColumnRenamed("id", "dst"), "dst")
    out = links.groupBy("src").agg(F.count("*").alias("out"))
    links = materialize(links.join(out, "src"))
    ranks = materialize(nodes.join(out.withColumnRenamed("src", "id"), "id", "left").select("id", F.col("out").isNull().alias("dangling"), F.lit(1.0 / n).alias("rank")))
    loose = ranks.agg(F.coalesce(F.sum(F.when(F.col("dangling"), F.col("rank"))), F.lit(0.0))).first()[0]
    for _ in range(rounds):
        given = links.join(ranks.select(F.col("id").alias("src"), "rank"), "src").groupBy("dst").agg(F.sum(F.col("rank") / F.col("out")).alias("got"))
        base = (1 - damping) / n + damping * loose / n
        new = (F.lit(base) + damping * F.coalesce("got", F.lit(0.0))).alias("rank")
        ranks = materialize(ranks.join(given.withColumnRenamed("dst", "id"), "id", "left").select("id", "dangling", F.col("rank").alias("old"), new))
        moved, loose = ranks.agg(F.sum(F.abs(F.col("rank") - F.col("old"))), F.coalesce(F.sum(F.when(F.col("dangling"), F.col("rank"))), F.lit(0.0))).first()
        if moved < tolerance:
            break
    return ranks.select("id", "rank")


def lookup_names(symbols: DataFrame) -> DataFrame:
    """Every symbol with its place among those of its name: exported first, then path, line and ordinal."""
    w = Window.partitionBy("name").orderBy(F.desc("is_exported"), "file_path", "line", "ordinal", "symbol_id")
    return symbols.withColumn("place", F.row_number().over(w))


def implementors(edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """Interfaces with the classes that implement them and the methods of a class of that name in the class's file."""
    kinds = symbols.filter("kind = 'interface'").select(F.col("symbol_id").alias("to_id"), F.col("name").alias("interface"))
    links = edges.filter("edge_type = 'IMPLEMENTS'").join(kinds, "to_id")
    classes = links.join(symbols.select(F.col("symbol_id").alias("from_id"), F.col("name").alias("class"), "file_path", "line"), "from_id")
    methods = symbols.filter("kind = 'method'").select(F.substring_index("name", ".", 1).alias("class"), "file_path", F.substring_index("name", ".", -1).alias("method"), F.col("line").alias("at"))
    named = methods.groupBy("class", "file_path").agg(F.array_join(F.transform(F.array_sort(F.collect_set(F.struct("at", "method"))), lambda m: m["method"]), ",").alias("methods"))
    return classes.join(named, ["class", "file_path"], "left").select("interface", "class", "file_path", "line", F.coalesce("methods", F.lit("")).alias("methods"))


def resolve_types(wanted: DataFrame, symbols: DataFrame, imports: DataFrame) -> DataFrame:
    """(file_path, type_name) to the declaring symbol: same file, then a named import's file, then an exported one anywhere."""
    types = symbols.filter(F.col("kind").isin("interface", "type", "class_shell")).select(F.col("symbol_id"), F.col("name").alias("type_name"), F.col("file_path").alias("home"), "line", "is_exported")
    wanted = wanted.select("file_path", "type_name").distinct()
    same = wanted.join(types, "type_name").filter("file_path = home").withColumn("priority", F.lit(1))
    named = imports.filter("resolved_path is not null").select("file_path", "resolved_path", F.explode("symbols").alias("type_name")).distinct()
    via = wanted.join(named, ["file_path", "type_name"]).join(types, "type_name").filter("resolved_path = home").drop("resolved_path").withColumn("priority", F.lit(2))
    # the first exported one per name is all that can be picked, so a common name stays one row
    exported = first_by(types.filter("is_exported"), ["type_name"], F.col("home"), F.col("line"), F.col("symbol_id"))
    anywhere = wanted.join(exported, "type_name").withColumn("priority", F.lit(3))
    rows = reduce(lambda a, b: a.unionByName(b), [same, via, anywhere])
    return first_by(rows, ["file_path", "type_name"], F.col("priority"), F.col("home"), F.col("line"), F.col("symbol_id")).select("file_path", "type_name", "priority", "symbol_id", "home")


def resolve_calls(calls: DataFrame, symbols: DataFrame, imports: DataFrame, barrels: tuple[DataFrame, DataFrame, DataFrame] | None = None) -> DataFrame:
    """(file_path, to_name, symbol_id, rule): call targets by the rule of their evidence.

    ``calls`` has file_path, ordinal, to_name, resolution. The first call of a
    name in a file decides its rule. Same-file evidence looks in the file,
    imports in the file the name was first imported from, typed receivers in
    the import of their type, then the file, then anywhere by name. With
    ``barrels`` (edges, files, stars), what an imported file does not declare
    is looked for where it re-exports from.
    """
    first = first_by(calls, ["file_path", "to_name"], F.col("ordinal"))
    decl = symbols.filter("kind <> 'export'")
    here = first_by(decl, ["name", "file_path"], F.col("line"), F.col("ordinal"), F.col("symbol_id")).select(F.col("name").alias("d_name"), F.col("file_path").alias("d_path"), F.col("symbol_id").alias("d_id"))
    anywhere = first_by(decl, ["name"], F.col("file_path"), F.col("line"), F.col("ordinal"), F.col("symbol_id")).select(F.col("name").alias("g_name"), F.col("symbol_id").alias("g_id"))
    names = first_by(imports.select("file_path", "ordinal", "resolved_path", F.posexplode("symbols").alias("at", "i_name")), ["file_path", "i_name"], F.col("ordinal"), F.col("at")).select(F.col("file_path").alias("i_path"), "i_name", "resolved_path")
    typed = F.col("resolution").isin("field_type", "parameter_type", "new_expression", "super_method")
    key = F.when(typed, F.substring_index("to_name", ".", 1)).otherwise(F.col("to_name"))
    rows = first.withColumn("i_key", key)
    rows = rows.join(names, (rows.file_path == names.i_path) & (rows.i_key == names.i_name), "left")
    via = here.select(F.col("d_name").alias("v_name"), F.col("d_path").alias("v_path"), F.col("d_id").alias("v_id"))
    rows = rows.join(via, (rows.to_name == via.v_name) & (rows.resolved_path == via.v_path), "left").join(here, (rows.to_name == here.d_name) & (rows.file_path == here.d_path), "left")
    if barrels is not None:
        beyond = through_barrels(rows.select(F.col("resolved_path").alias("path"), F.col("to_name").alias("name")), symbols, *barrels).select(F.col("path").alias("b_path"), F.col("name").alias("b_name"), F.col("symbol_id").alias("b_id"))
        rows = rows.join(beyond, (rows.to_name == beyond.b_name) & (rows.resolved_path == beyond.b_path), "left").withColumn("v_id", F.coalesce("v_id", "b_id"))
    rows = rows.join(anywhere, rows.to_name == anywhere.g_name, "left")
    target = (
        F.when(F.col("resolution").isin("same_file", "this_method"), F.col("d_id"))
        .when(F.col("resolution") == "import", F.col("v_id"))
        .when(F.col("resolution") == "super_method", F.when(F.col("i_name").isNotNull(), F.col("v_id")).otherwise(F.col("d_id")))
        .when(typed, F.coalesce(F.when(F.col("i_name").isNotNull(), F.col("v_id")).otherwise(F.col("d_id")), F.col("g_id")))
        .otherwise(F.col("g_id"))
    )
    return rows.select("file_path", "to_name", target.alias("symbol_id"), F.col("resolution").alias("rule")).filter("symbol_id is not null")


def link_edges(raw: DataFrame, symbols: DataFrame, imports: DataFrame, barrels: tuple[DataFrame, DataFrame, DataFrame] | None = None) -> DataFrame:
    """(from_id, to_id, edge_type, resolution, call_line) of extracted edges (file_path, ordinal, from_name, to_name, edge_type, resolution, call_line).

    The source is the last symbol of that name in the file. Calls go where
    ``resolve_calls`` finds them. A base class or interface is the first
    declaration of that bare name anywhere; a re-exported name is declared in the
    file its module resolves to, or beyond it where ``barrels`` are given. Edges
    without a source or a target are left out, repeated ones kept once.
    """
    last = first_by(symbols, ["name", "file_path"], F.desc("line"), F.desc("ordinal"), F.desc("symbol_id")).select(F.col("name").alias("from_name"), "file_path", F.col("symbol_id").alias("from_id"))
    rows = raw.join(last, ["from_name", "file_path"])
    calls = resolve_calls(raw.filter("edge_type = 'POTENTIAL_CALL'").select("file_path", "ordinal", "to_name", "resolution"), symbols, imports, barrels)
    called = rows.filter("edge_type = 'POTENTIAL_CALL'").join(calls.select("file_path", "to_name", F.col("symbol_id").alias("to_id")), ["file_path", "to_name"])
    decl = symbols.filter("kind <> 'export'")
    anywhere = first_by(decl, ["name"], F.col("file_path"), F.col("line"), F.col("ordinal"), F.col("symbol_id")).select(F.col("name").alias("to_name"), F.col("symbol_id").alias("to_id"))
    structural = rows.filter(F.col("edge_type").isin("EXTENDS", "IMPLEMENTS")).join(anywhere, "to_name")
    here = first_by(decl, ["name", "file_path"], F.col("line"), F.col("ordinal"), F.col("symbol_id")).select(F.col("name").alias("to_name"), F.col("file_path").alias("resolved_path"), F.col("symbol_id").alias("here_id"))
    sources = first_by(imports.filter("resolved_path is not null").select("file_path", "ordinal", "resolved_path", F.explode("symbols").alias("from_name")), ["file_path", "from_name"], F.col("ordinal")).drop("ordinal")
    named = rows.filter("edge_type = 'RE_EXPORTS'").join(sources, ["file_path", "from_name"]).join(here, ["to_name", "resolved_path"], "left")
    if barrels is None:
        named = named.withColumn("to_id", F.col("here_id"))
    else:
        beyond = through_barrels(named.select(F.col("resolved_path").alias("path"), F.col("to_name").alias("name")), symbols, *barrels).select(F.col("path").alias("resolved_path"), F.col("name").alias("to_name"), F.col("symbol_id").alias("beyond_id"))
        named = named.join(beyond, ["resolved_path", "to_name"], "left").withColumn("to_id", F.coalesce("here_id", "beyond_id"))
    columns = ["from_id", "to_id", "edge_type", "resolution", "call_line", "ordinal"]
    every = reduce(lambda a, b: a.unionByName(b), [x.select(*columns) for x in (called, structural, named)]).filter("to_id is not null")
    kept = every.groupBy("from_id", "to_id", "edge_type").agg(F.min(F.struct("ordinal", "call_line", "resolution")).alias("s"))
    return kept.select("from_id", "to_id", "edge_type", "s.resolution", "s.call_line")


def skeleton(symbols: DataFrame, directory: str, max_depth: int | None = None) -> DataFrame:
    """Exports per file below a directory, in line order, methods left out."""
    rows = symbols.filter(F.col("is_exported") & F.col("file_path").startswith(directory) & (F.col("kind") != "method"))
    if max_depth is not None:
        rest = F.ltrim(F.substring("file_path", F.lit(len(directory) + 1), F.length("file_path")), F.lit("/"))
        rows = rows.filter(F.size(F.split(rest, "/")) - 1 < max_depth)
    names = F.transform(F.array_sort(F.collect_list(F.struct("line", "ordinal", "name"))), lambda x: x["name"])
    return rows.groupBy("file_path").agg(F.array_join(names, ",").alias("exports"), F.count("*").alias("n_exports"))


def page(rows: DataFrame, keys: list[str], cap: int, *order: Column) -> DataFrame:
    """The first ``cap`` rows per key with the honest total, given only when rows were left out."""
    total = rows.groupBy(*keys).agg(F.count("*").alias("of"))
    first = rows.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("place") <= cap)
    same = reduce(lambda x, y: x & y, [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in keys])
    out = first.alias("l").join(total.alias("r"), same).select("l.*", "of")
    return out.withColumn("truncated_total", F.when(F.col("of") > cap, F.col("of"))).drop("of")


def rename_impact(edges: DataFrame, symbols: DataFrame, re_exports: DataFrame, name: str) -> DataFrame:
    """Everything a rename of ``name`` touches: declarations, callers, and files that re-export its home."""
    found = symbols.filter(F.col("name") == name)
    decls = found.select(F.lit("declaration").alias("part"), "file_path", "line", F.col("name").alias("detail"))
    calls = direct_callers(edges.join(found.select(F.col("symbol_id").alias("to_id")), "to_id", "left_semi"), symbols).select(F.lit("caller").alias("part"), "file_path", "line", F.col("caller").alias("detail"))
    homes = found.select(F.col("file_path").alias("node")).distinct()
    barrels = closure(re_exports.select(F.col("from_path").alias("src"), F.col("to_path").alias("dst")).dropna(), homes)
    return decls.unionByName(calls).unionByName(barrels.select(F.lit("barrel").alias("part"), F.col("node").alias("file_path"), F.lit(None).cast("int").alias("line"), F.concat(F.lit("depth "), "depth").alias("detail")))
