"""Causal paths of pages: anchors, the bounded search between them, features, classes, guarantees and ranking.

All pages and all their anchors advance together, one job for each hop.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..model import CAUSAL_EDGES
from .traversal import dropped, few, page_subtree, settled

# Edges that read, that write models, and that may be followed from a model or field back to its writer.
SOURCE_EDGES = ("Reads", "ActionReads", "ActionValidates", "ActionLoadsData")
SINK_EDGES = ("Writes", "ActionWrites")
WRITER_EDGES = ("ActionWrites", "Writes", "FieldWrite")
# Parts of a field path that tell a physical field, and the field that ranking prefers.
PHYSICAL = ("tbl.", "phoneNumber", "fact_")
PREFERRED_FIELD = "phoneNumber"
# Hops, paths of an anchor, of a page, primary paths of an anchor, of a page, edges of a path that may explain.
MAX_DEPTH, PER_ANCHOR, PER_PAGE, PRIMARY_PER_ANCHOR, PRIMARY_PER_PAGE, MAX_EDGES = 5, 15, 10_000, 3, 100, 6
# The order in which guarantees are met.
GUARANTEES = ("action_write", "cross_page_writer", "data_prerequisite", "display_gate", "target_component", "value_source")

# Edges that a path may have to answer a question; a question about writers needs a writing edge, too.
INTENT_EDGES = {
    "display": ("DependsOn", "Contains"),
    "value_source": ("Reads", "ActionReads", "FieldAlias", "DataflowOutput", "DataflowInput"),
    "writer": ("Reads", "Contains", "FieldAlias", "Writes", "ActionWrites", "FieldWrite"),
    "availability": ("DependsOn", "DataflowInput"),
    "action": ("Triggers", "ActionWrites", "DependsOn"),
}

_ROLES = ("target", "source", "sink", "bridge")


def _with_meta(edges: DataFrame) -> DataFrame:
    """edges with json_path and source_expr, from their meta (JSON) where they have any."""
    meta = lambda key: F.get_json_object("meta", f"$.{key}") if "meta" in edges.columns else F.lit(None).cast("string")
    return edges.select("src", "dst", "edge_type", "field_path", meta("json_path").alias("json_path"), meta("source_expr").alias("source_expr"))


def _held(edges: DataFrame, tree: DataFrame) -> DataFrame:
    """What the subtrees (page, node) read, write and trigger, of edges with meta."""
    return edges.where(F.col("edge_type").isin(*SOURCE_EDGES, *SINK_EDGES, "Triggers")).join(tree, F.col("src") == F.col("node")).drop("node")


_READS = lambda: F.col("edge_type").isin(*SOURCE_EDGES)
_WRITES = lambda: F.col("edge_type").isin(*SINK_EDGES)


def _rank() -> Column:
    return F.when(_READS(), 0).when(_WRITES(), 1).otherwise(2)


def _read_ids() -> Column:
    """What a reading edge reads: its end, and the local field that its source expression names."""
    at = F.instr("source_expr", ".")
    local = F.when((at > 1) & (F.length("source_expr") > at) & ~F.startswith("source_expr", F.lit("$")), F.concat(F.lit("field:"), "source_expr"))
    return F.array_compact(F.array("dst", local))


def _written_ids() -> Column:
    """What a writing edge writes: its end, and a field path with a dot."""
    return F.array_compact(F.array("dst", F.when(F.col("field_path").contains("."), F.col("field_path"))))


def page_anchors(nodes: DataFrame, edges: DataFrame, bridges: DataFrame | None = None) -> DataFrame:
    """(page, anchor, id, rank): what the paths of every page start from and lead to.

    target: components that read (rank 0), write (1) or trigger something (2), at the first rank that holds; source: what
    is read, and the local field that a source expression names; sink: what is written, and field paths with a dot;
    bridge: writers on other pages of the models and fields read, and of bridges (page, id) those given; excluded:
    conditions on other pages that depend on those models and fields. rank is null but for targets.
    """
    rows = _with_meta(edges)
    tree = settled(page_subtree(edges).join(nodes.select(F.col("id").alias("node"), "node_type"), "node"))
    out = settled(_held(rows, tree).select("page", "src", "node_type", "dst", "edge_type", "field_path", "source_expr"))
    targets = out.where("node_type = 'Component'").groupBy("page", F.col("src").alias("id")).agg(F.min(_rank()).alias("rank"))
    sources = out.where(_READS()).select("page", F.explode(_read_ids()).alias("id")).distinct()
    sinks = out.where(_WRITES()).select("page", F.explode(_written_ids()).alias("id")).distinct()
    held = out.where(_READS() & F.col("dst").rlike("^(model|field):")).select("page", F.col("dst").alias("of")).distinct()
    into = rows.where(F.col("edge_type").isin(*WRITER_EDGES, "DependsOn")).join(nodes.select(F.col("id").alias("src"), "path"), "src").select(F.col("dst").alias("of"), "src", "path", "edge_type")
    other = held.join(into, "of").where(F.concat(F.lit("page:"), "path") != F.col("page"))
    near = other.where("edge_type <> 'DependsOn'").select("page", F.col("src").alias("id"))
    near = (near.unionByName(bridges.select("page", "id")) if bridges is not None else near).distinct()
    barred = other.where("edge_type = 'DependsOn' AND src LIKE 'cond:%'").select("page", F.col("src").alias("id")).distinct()
    none = F.lit(None).cast("int").alias("rank")
    parts = [targets.select("page", F.lit("target").alias("anchor"), "id", "rank")]
    parts += [df.select("page", F.lit(name).alias("anchor"), "id", none) for name, df in (("source", sources), ("sink", sinks), ("bridge", near), ("excluded", barred))]
    every = parts[0]
    for x in parts[1:]:
        every = every.unionByName(x)
    return every


def anchor_counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(page, anchor, n, first_id): the rows of page_anchors counted, and the first id.

    A writer is a bridge of nearly every page, so pairs of both are not made rows before they are counted: the pages that
    read a model or field are listed as numbers, and a writer adds up the lists of what it writes.
    """
    rows = _with_meta(edges)
    tree = settled(page_subtree(edges).join(nodes.select(F.col("id").alias("node"), "node_type"), "node"))
    out = settled(_held(rows, tree).select("page", "src", "node_type", "dst", "edge_type", "field_path", "source_expr"))
    targets = out.where("node_type = 'Component'").select("page", F.col("src").alias("id")).distinct()
    read = out.where(_READS()).select("page", "dst", F.explode(_read_ids()).alias("id"))
    read = settled(read.groupBy("page", "id").agg(F.max((F.col("id") == F.col("dst")) & F.col("dst").rlike("^(model|field):")).alias("whole")))
    sinks = out.where(_WRITES()).select("page", F.explode(_written_ids()).alias("id")).distinct()
    pages = settled(read.select("page").distinct().withColumn("no", F.row_number().over(W.orderBy("page"))))
    lists = read.where("whole").join(few(pages), "page").groupBy(F.col("id").alias("of")).agg(F.collect_list("no").alias("nos"))
    kind = F.when(F.col("edge_type").isin(*WRITER_EDGES), "bridge").when((F.col("edge_type") == "DependsOn") & F.startswith("src", F.lit("cond:")), "excluded")
    into = rows.where(F.col("edge_type").isin(*WRITER_EDGES, "DependsOn") & F.col("dst").rlike("^(model|field):")).select("src", F.col("dst").alias("of"), kind.alias("anchor")).where("anchor IS NOT NULL").distinct()
    met = into.join(lists, "of").join(nodes.where("path IS NOT NULL").select(F.col("id").alias("src"), F.concat(F.lit("page:"), "path").alias("page")), "src")
    met = met.join(few(pages), "page", "left").select("src", "anchor", F.array_remove("nos", F.coalesce("no", F.lit(0))).alias("nos"))
    met = met.groupBy("src", "anchor").agg(F.array_distinct(F.flatten(F.collect_list("nos"))).alias("nos"))
    counted = lambda df: df.agg(F.count("*").alias("n"), F.min("id").alias("first_id"))
    near = counted(met.select(F.col("src").alias("id"), "anchor", F.explode("nos").alias("no")).groupBy("no", "anchor")).join(few(pages), "no").select("page", "anchor", "n", "first_id")
    parts = [counted(df.groupBy("page", F.lit(name).alias("anchor"))) for name, df in (("target", targets), ("source", read), ("sink", sinks))]
    for x in parts:
        near = near.unionByName(x)
    return near


class _Given:
    """Anchors of a table (page, anchor, id, rank)."""

    def __init__(self, anchors: DataFrame):
        self.anchors = settled(anchors.where(F.col("anchor").isin(*_ROLES)).select("page", "anchor", "id", "rank"))
        self.targets = self.anchors.where("anchor = 'target'").select("page", "id", "rank")

    def of(self, wanted: DataFrame) -> DataFrame:
        return self.anchors.select("page", "id", "anchor").join(wanted, ["page", "id"], "left_semi")

    def drop(self) -> None:
        dropped(self.anchors)


class _Met:
    """The anchors of page_anchors, made for the nodes alone that a search meets: bridges are many more than these."""

    def __init__(self, nodes: DataFrame, edges: DataFrame):
        self.nodes, self.rows = nodes, _with_meta(edges)
        self.tree = settled(page_subtree(edges).join(nodes.select(F.col("id").alias("node")), "node", "left_semi").select("page", "node"))
        first = self.rows.where(F.col("edge_type").isin(*SOURCE_EDGES, *SINK_EDGES, "Triggers")).groupBy("src").agg(F.min(_rank()).alias("rank"))
        components = nodes.where("node_type = 'Component'").select(F.col("id").alias("src"))
        rows = first.join(components, "src").join(self.tree.withColumnRenamed("node", "src"), "src")
        self.targets = settled(rows.groupBy("page", F.col("src").alias("id")).agg(F.min("rank").alias("rank")))

    def of(self, wanted: DataFrame) -> DataFrame:
        """(page, id, anchor) of nodes (page, id)."""
        wanted = settled(wanted)
        ids = settled(wanted.select("id").distinct())
        into = self.rows.where(F.col("edge_type").isin(*WRITER_EDGES) & F.col("dst").rlike("^(model|field):")).join(few(ids).withColumnRenamed("id", "src"), "src", "left_semi")
        into = settled(into.select("src", F.col("dst").alias("of")).distinct())
        # what the wanted nodes write may be read on their pages: then they are bridges
        asked = settled(ids.unionByName(into.select(F.col("of").alias("id"))).distinct())
        reads = settled(self.rows.where(_READS()).select("src", "dst", F.explode(_read_ids()).alias("id")).join(few(asked), "id", "left_semi"))
        read = settled(few(reads).join(self.tree, F.col("src") == F.col("node")).groupBy("page", "id").agg(F.max(F.col("id") == F.col("dst")).alias("whole")))
        writes = settled(self.rows.where(_WRITES()).select("src", F.explode(_written_ids()).alias("id")).join(few(ids), "id", "left_semi"))
        written = few(writes).join(self.tree, F.col("src") == F.col("node")).select("page", "id").distinct()
        path_of = self.nodes.select(F.col("id").alias("src"), "path").join(few(ids).withColumnRenamed("id", "src"), "src", "left_semi")
        writers = wanted.withColumnRenamed("id", "src").join(into, "src").join(read.where("whole").select("page", F.col("id").alias("of")), ["page", "of"], "left_semi")
        writers = writers.join(path_of, "src").where(F.concat(F.lit("page:"), "path") != F.col("page")).select("page", F.col("src").alias("id"))
        targets = self.targets.join(few(wanted), ["page", "id"], "left_semi")
        parts = [("target", targets), ("source", read), ("sink", written), ("bridge", writers)]
        every = None
        for name, df in parts:
            rows = df.select("page", "id", F.lit(name).alias("anchor"))
            every = rows if every is None else every.unionByName(rows)
        out = settled(every.join(wanted, ["page", "id"], "left_semi").distinct())
        dropped(wanted, ids, into, asked, reads, read, writes)
        return out

    def drop(self) -> None:
        dropped(self.tree, self.targets)


def causal_steps(nodes: DataFrame, edges: DataFrame, starts: DataFrame | None = None, first: int | None = None) -> DataFrame:
    """(src, dst, best, again): one row for each pair of nodes that a path may go between.

    Edges of the causal kinds go forward; from models and fields the edges that write them also go back to the writer.
    best is the first of parallel edges by kind, direction and field; again the first one that may return to a node that
    the path has, which an alias may going forward and a field write going back.

    From some nodes (id, a settled table) only, if starts are given, then as a settled table, and to so many ends of each
    node only, in their order, if first is. Such steps are few beside the nodes, which are read for their ends and not
    shuffled.
    """
    node = lambda rows, name: rows.select(F.col("id").alias(name), F.col("path").alias(f"{name}_path"), F.col("node_type").alias(f"{name}_type"))
    rows = _with_meta(edges)
    some = lambda df: df if starts is None else df.join(few(starts).select(F.col("id").alias("src")), "src", "left_semi")
    ahead = some(rows.where(F.col("edge_type").isin(*CAUSAL_EDGES)).withColumn("back", F.lit(False)))
    back = rows.where(F.col("edge_type").isin(*WRITER_EDGES) & F.col("edge_type").isin(*CAUSAL_EDGES) & F.col("dst").rlike("^(model|field):"))
    back = some(back.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "edge_type", "field_path", "json_path", "source_expr", F.lit(True).alias("back")))
    both, used = ahead.unionByName(back), []
    if starts is not None:
        both = settled(both)
        ends = settled(both.select(F.col("src").alias("id")).union(both.select("dst")).distinct())
        nodes = settled(nodes.select("id", "path", "node_type").join(few(ends), "id", "left_semi"))
        used = [both, ends, nodes]
    if first is not None:  # only ends that are nodes count
        place = F.dense_rank().over(W.partitionBy("src").orderBy("dst"))
        both = both.join(nodes.select(F.col("id").alias("dst")), "dst", "left_semi").withColumn("n", place).where(F.col("n") <= first).drop("n")
    both = both.join(node(nodes, "src"), "src").join(node(nodes, "dst"), "dst")
    both = both.select("src", "dst", F.struct("edge_type", "back", "field_path", "json_path", F.col("src_path").alias("from_path"), F.col("src_type").alias("from_type"), F.col("dst_path").alias("to_path"), F.col("dst_type").alias("to_type")).alias("edge"))
    twice = F.col("edge.edge_type") == F.when(F.col("edge.back"), "FieldWrite").otherwise("FieldAlias")
    steps = both.groupBy("src", "dst").agg(F.min("edge").alias("best"), F.min(F.when(twice, F.col("edge"))).alias("again"))
    if starts is not None:
        steps = settled(steps)
        dropped(*used)
    return steps


_EDGE = "struct<edge_type:string,back:boolean,field_path:string,json_path:string,from_path:string,from_type:string,to_path:string,to_type:string>"


def causal_paths(nodes: DataFrame, edges: DataFrame, anchors: DataFrame | None = None, depth: int = MAX_DEPTH, per_anchor: int = PER_ANCHOR, per_page: int = PER_PAGE) -> DataFrame:
    """(page, rank, anchor, nodes, steps, roles, place): the first paths from each target anchor of every page.

    A path counts if it has two edges or more, or if it leads to an anchor. An anchor's paths are taken in order of their
    length, then their nodes. place numbers a page's paths by the anchor's rank and id, per_page at most. roles says for
    each node of the path which anchors of the page it is. anchors are those of page_anchors, unless some are given.

    A page's anchors are searched in their order, so many at once as could fill the page, then twice as many: a page
    whose anchors so far have per_page paths is done, as every path of a later anchor has a higher place.
    """
    known = _Met(nodes, edges) if anchors is None else _Given(anchors)
    turn = F.row_number().over(W.partitionBy("page").orderBy("rank", "anchor"))
    waiting = settled(known.targets.select("page", "rank", F.col("id").alias("anchor")).withColumn("turn", turn))
    found, upto = None, -(-per_page * 5 // (per_anchor * 4))
    while True:
        now = settled(waiting.where(F.col("turn") <= upto).drop("turn"))
        more = _searched(nodes, edges, known, now, depth, per_anchor)
        dropped(now)
        found = more if found is None else found.unionByName(more)
        full = found.groupBy("page").count().where(F.col("count") >= per_page).select("page")
        left = settled(waiting.where(F.col("turn") > upto).join(full, "page", "left_anti"))
        dropped(waiting)
        waiting = left
        if waiting.isEmpty():
            break
        upto *= 3  # the next ones are twice as many
    dropped(waiting)
    known.drop()
    place = F.row_number().over(W.partitionBy("page").orderBy("rank", "anchor", F.size("nodes"), "nodes"))
    return found.withColumn("place", place).where(F.col("place") <= per_page)


def _searched(nodes: DataFrame, edges: DataFrame, known: _Met | _Given, starts: DataFrame, depth: int, per_anchor: int) -> DataFrame:
    """The first paths from each of some anchors (page, rank, anchor), without their places.

    An anchor that has per_anchor paths goes no further, so beyond the second hop a frontier holds fewer than per_anchor
    paths of an anchor, and of a node's edges only so many can matter as could fill what an anchor lacks. A hop reads the
    edges and anchors of the nodes that its frontier has come to, and no others.
    """

    def with_roles(rows: DataFrame) -> DataFrame:
        """rows with the role of their last node."""
        of = known.of(rows.select("page", F.element_at("nodes", -1).alias("id")).distinct())
        flags = [F.max(F.col("anchor") == x).alias(x) for x in _ROLES]
        of = of.groupBy("page", "id").agg(*flags).select(F.col("page").alias("p"), F.col("id").alias("i"), F.struct(*_ROLES).alias("role"))
        none = F.struct(*[F.lit(False).alias(x) for x in _ROLES])
        rows = rows.join(of, (F.col("page") == F.col("p")) & (F.element_at("nodes", -1) == F.col("i")), "left").drop("p", "i")
        return settled(rows.withColumn("roles", F.concat("roles", F.array(F.coalesce("role", none)))).drop("role"))

    role = "struct<" + ",".join(f"{x}:boolean" for x in _ROLES) + ">"
    paths = with_roles(starts.select("page", "rank", "anchor", F.array("anchor").alias("nodes"), F.array().cast(f"array<{_EDGE}>").alias("steps"), F.array().cast(f"array<{role}>").alias("roles")))
    found, have = None, None
    for hop in range(1, depth + 1):
        ends = settled(paths.select(F.element_at("nodes", -1).alias("id")).distinct())
        links = causal_steps(nodes, edges, ends, per_anchor + depth + 1 if hop > 1 else None)
        grown = paths.join(links, F.element_at("nodes", -1) == F.col("src"))
        edge = F.when(F.array_contains("nodes", F.col("dst")), F.col("again")).otherwise(F.col("best"))
        grown = grown.withColumn("edge", edge).where("edge IS NOT NULL").withColumn("nodes", F.concat("nodes", F.array("dst")))
        first = F.row_number().over(W.partitionBy("page", "anchor").orderBy("nodes"))
        if hop > 1:  # an anchor that has fewer than per_anchor paths by now keeps all of them
            grown = grown.withColumn("k", first).where(F.col("k") <= per_anchor)
        bare = settled(grown.select("page", "rank", "anchor", "nodes", F.concat("steps", F.array("edge")).alias("steps"), "roles", *(["k"] if hop > 1 else [])))
        dropped(paths, ends, links)
        grown = with_roles(bare)
        dropped(bare)
        last = F.element_at("roles", -1)
        counted = grown if hop > 1 else grown.where(last["target"] | last["source"] | last["sink"] | last["bridge"]).withColumn("k", first)
        lacking = F.lit(per_anchor)
        if have is not None:
            counted = counted.join(have.withColumnsRenamed({"page": "p", "anchor": "a"}), (F.col("page") == F.col("p")) & (F.col("anchor") == F.col("a")), "left").drop("p", "a")
            lacking = per_anchor - F.coalesce("have", F.lit(0))
        taken = settled(counted.where(F.col("k") <= F.least(lacking, F.lit(per_anchor))).drop("k", "have"))
        found = taken if found is None else found.unionByName(taken)
        have = settled(found.groupBy("page", "anchor").agg(F.count("*").alias("have")))
        done = have.where(F.col("have") >= per_anchor).select("page", "anchor")
        paths = settled(grown.drop("k").join(done, ["page", "anchor"], "left_anti"))
        dropped(grown)
        if paths.isEmpty():
            break
    dropped(paths)
    return found


def field_paths(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Paths as of causal_paths that say which action on another page writes the very field that a component reads.

    The expression of a component's read, ``${model.field}``, names its local field; an alias leads to the canonical one,
    whose writers count if the field path of the write ends in the canonical field's name. rank is 9.
    """
    rows = _with_meta(edges)
    path_of = nodes.select("id", "path", "node_type")
    tree = page_subtree(edges).where("node LIKE 'comp:%'")
    expr = F.regexp_replace(F.regexp_replace("source_expr", "^\\$\\{", ""), "\\}$", "")
    reads = rows.where(F.col("edge_type").isin(*SOURCE_EDGES)).join(tree, F.col("src") == F.col("node")).withColumn("expr", expr)
    reads = reads.where("instr(expr, '.') > 1 AND length(expr) > instr(expr, '.') AND NOT startswith(expr, '$')").select("page", F.col("src").alias("anchor"), F.concat(F.lit("field:"), "expr").alias("local"), "field_path", F.coalesce("json_path", F.lit("")).alias("json_path"))
    alias = rows.where("edge_type = 'FieldAlias'").select(F.col("src").alias("local"), F.col("dst").alias("canonical"), F.col("field_path").alias("alias_path"))
    alias = alias.join(path_of.select(F.col("id").alias("canonical"), F.col("path").alias("canonical_path")), "canonical")
    write = rows.where("edge_type = 'FieldWrite'").select(F.col("dst").alias("canonical"), F.col("src").alias("writer"), F.col("field_path").alias("write_path"))
    write = write.join(path_of.select(F.col("id").alias("writer"), F.col("path").alias("writer_path")), "writer")
    name = F.substring_index("canonical", ".", -1)
    page = F.substring("page", 6, 1 << 20)
    full = reads.join(alias, "local").join(write, "canonical").where((F.col("writer_path") != page) & F.endswith(F.coalesce("write_path", F.lit("")), name))
    edge = lambda kind, back, field, json, from_path, from_type, to_path, to_type: F.struct(F.lit(kind).alias("edge_type"), F.lit(back).alias("back"), field.alias("field_path"), json.alias("json_path"), from_path.alias("from_path"), F.lit(from_type).alias("from_type"), to_path.alias("to_path"), F.lit(to_type).alias("to_type"))
    none = F.lit(None).cast("string")
    steps = F.array(
        edge("Reads", False, F.col("field_path"), F.col("json_path"), page, "Component", page, "Field"),
        edge("FieldAlias", False, F.col("alias_path"), none, page, "Field", F.col("canonical_path"), "Field"),
        edge("FieldWrite", True, F.col("write_path"), none, F.col("canonical_path"), "Field", F.col("writer_path"), "Action"),
    )
    role = lambda on: F.struct(*[F.lit(x == on).alias(x) for x in _ROLES])
    key = ["page", "anchor", "local", "canonical", "writer"]
    out = full.select(*key, F.array("anchor", "local", "canonical", "writer").alias("nodes"), steps.alias("steps"), F.array(role("target"), role("source"), role(""), role("")).alias("roles"))
    return out.groupBy("page", F.lit(9).alias("rank"), "anchor", "nodes").agg(F.min("steps").alias("steps"), F.first("roles").alias("roles"))


def page_candidates(nodes: DataFrame, edges: DataFrame, anchors: DataFrame | None = None, depth: int = MAX_DEPTH, per_anchor: int = PER_ANCHOR) -> DataFrame:
    """causal_paths and, behind them, the field_paths that they have not."""
    found = settled(causal_paths(nodes, edges, anchors, depth, per_anchor))
    more = field_paths(nodes, edges).join(found.select("page", "nodes"), ["page", "nodes"], "left_anti")
    place = PER_PAGE + F.row_number().over(W.partitionBy("page").orderBy("anchor", "nodes"))
    return found.unionByName(more.withColumn("place", place).select(found.columns))


def features(paths: DataFrame) -> DataFrame:
    """paths with the features that classes, guarantees and ranking go by."""
    page = F.substring("page", 6, 1 << 20)
    step = lambda holds: F.exists("steps", holds)
    node = lambda name: F.exists("roles", lambda r: r[name])
    kind = lambda s, *kinds: s["edge_type"].isin(*kinds)
    field = lambda s, part: F.coalesce(s["field_path"].contains(part), F.lit(False))
    out = paths.withColumns({
        "length": F.size("steps"),
        "kinds": F.transform("steps", lambda s: s["edge_type"]),
        "has_target": node("target"),
        "has_read": node("source"),
        "has_write": node("sink"),
        "has_bridge": node("bridge"),
        "has_field_write": step(lambda s: kind(s, "FieldWrite")),
        "has_alias": step(lambda s: kind(s, "FieldAlias")),
        "has_condition": step(lambda s: (s["from_type"] == "Condition") | (s["to_type"] == "Condition")),
        "has_filter": F.exists(F.arrays_zip("steps", F.slice("nodes", 1, F.size("steps")).alias("a"), F.slice("nodes", 2, F.size("steps")).alias("b")), lambda z: (z["steps"]["edge_type"] == "DependsOn") & (z["a"].startswith("model:") | z["b"].startswith("model:"))),
        "has_json_path": step(lambda s: s["json_path"].isNotNull()),
        "same_page": step(lambda s: (s["from_path"] == page) & (s["to_path"] == page)),
        "has_physical": step(lambda s: field(s, PHYSICAL[0]) | field(s, PHYSICAL[1]) | field(s, PHYSICAL[2])),
        "has_preferred": step(lambda s: field(s, PREFERRED_FIELD)),
        "only_structure": F.forall("steps", lambda s: kind(s, "Contains", "Triggers")),
        "n_files": F.size(F.array_distinct(F.flatten(F.transform("steps", lambda s: F.array(s["from_path"], s["to_path"]))))),
        "writes_elsewhere": step(lambda s: kind(s, *WRITER_EDGES) & (s["to_path"] != page)),
        "off_page": F.exists(F.arrays_zip("steps", F.slice("roles", 1, F.size("steps")).alias("a"), F.slice("roles", 2, F.size("steps")).alias("b")), lambda z: ((z["steps"]["from_path"] != page) | (z["steps"]["to_path"] != page)) & ~z["a"]["bridge"] & ~z["b"]["bridge"]),
    })
    return out.withColumn("has_cross_writer", F.col("has_bridge") | F.col("writes_elsewhere")).drop("has_bridge", "writes_elsewhere")


def classified(paths: DataFrame) -> DataFrame:
    """Paths with features, class and reason by the first rule that holds, confidence and terminals."""
    c = F.col
    data = c("has_read") | c("has_write") | c("has_condition") | c("has_physical")
    rules = [
        (c("only_structure"), "rejected", "structure_only"),
        (c("length") > MAX_EDGES, "rejected", "too_long"),
        (c("off_page") & ~c("has_cross_writer") & ~c("has_physical"), "related", "other_page"),
        (c("has_alias") & c("has_field_write") & c("has_cross_writer") & c("has_target") & c("has_physical"), "primary", "field_chain"),
        (data & c("has_target") & (c("has_physical") | c("has_cross_writer")), "primary", "target_with_evidence"),
        (data & c("has_target") & c("same_page") & (c("has_read") | c("has_write")), "primary", "same_page_chain"),
        (c("has_condition") & c("same_page") & (c("has_filter") | c("has_target")), "supporting", "same_page_gate"),
        (data, "candidate", "data_alone"),
    ]
    name, reason = F.lit("related"), F.lit("no_data")
    for holds, cls, why in reversed(rules):
        name, reason = F.when(holds, cls).otherwise(name), F.when(holds, why).otherwise(reason)
    confidence = F.when(c("has_physical") & c("has_target"), "high").when(c("has_read") | c("has_write"), "medium").otherwise("low")
    ends = F.array_compact(F.array(*[F.when(c(x), y) for x, y in (("has_target", "TargetComponent"), ("has_cross_writer", "CrossPageWriter"), ("has_filter", "DataFilter"), ("has_physical", "SinkPhysicalField"))]))
    return features(paths).withColumns({"class": name, "reason": reason, "confidence": confidence, "terminals": F.when(F.size(ends) > 0, ends).otherwise(F.array(F.lit("Unknown")))})


def guarantee(name: str) -> Column:
    """Whether a path with features meets a guarantee."""
    c = F.col
    return {
        "action_write": c("has_write"),
        "cross_page_writer": c("has_cross_writer"),
        "data_prerequisite": c("has_filter") | c("has_condition"),
        "display_gate": c("has_target") & c("has_condition"),
        "target_component": c("has_target"),
        "value_source": c("has_physical") & (c("has_read") | c("has_write")),
    }[name]


def path_score() -> Column:
    c = lambda x: F.col(x).cast("int")
    short = F.when(F.col("length") <= 2, 2).when(F.col("length") <= 3, 1).otherwise(0)
    return 3 * c("has_physical") + 2 * c("has_target") + 2 * c("has_cross_writer") + short + c("has_filter") + 5 * c("has_preferred") + 4 * c("has_alias")


def selected(paths: DataFrame, selector: str = "rules") -> DataFrame:
    """Classified paths with promoted (the guarantee that a path was promoted for), score, and order among the primary ones.

    Guarantees are met in their order. Of a page whose primary paths don't meet one, the first candidate path that does,
    else the first supporting one, becomes primary, unless it was taken for a guarantee before. Primary paths are ordered
    by score, length and place, promoted ones behind the others; those beyond three of an anchor or a hundred of a page
    become candidates (demoted). The selector "none" makes every path primary, "classes" leaves classes as they are; both
    promote and demote nothing and order primary paths by place.
    """
    if selector != "rules":
        if selector not in ("none", "classes"):
            raise ValueError(f"selector must be rules, none or classes, not {selector}")
        rows = paths.withColumn("class", F.lit("primary")) if selector == "none" else paths
        order = F.row_number().over(W.partitionBy("page", "class").orderBy("place"))
        return rows.withColumns({"promoted": F.lit(None).cast("string"), "score": path_score(), "order": F.when(F.col("class") == "primary", order), "demoted": F.lit(False)})
    page = W.partitionBy("page")
    pool = F.when(F.col("class") == "candidate", 0).when(F.col("class") == "supporting", 1)
    rows = paths.withColumn("was", F.col("class")).withColumn("promoted", F.lit(None).cast("int"))
    for k, name in enumerate(GUARANTEES):
        holds = guarantee(name)
        met = F.max((F.col("was") == "primary") & holds).over(page)
        free = F.when(pool.isNotNull() & F.col("promoted").isNull() & holds, F.struct(pool.alias("pool"), F.col("place")))
        rows = rows.withColumns({"met": met, "next": F.min(free).over(page), "free": free})
        rows = rows.withColumn("promoted", F.when(~F.col("met") & (F.col("free") == F.col("next")), k).otherwise(F.col("promoted"))).drop("met", "next", "free")
    primary = (F.col("was") == "primary") | F.col("promoted").isNotNull()
    order = [F.desc("score"), F.asc("length"), F.asc(F.coalesce("promoted", F.lit(-1))), F.asc("place")]
    rows = rows.withColumns({"score": path_score(), "is_primary": primary})
    rows = rows.withColumn("k", F.row_number().over(W.partitionBy("page", "anchor", "is_primary").orderBy(*order)))
    few = F.col("is_primary") & (F.col("k") <= PRIMARY_PER_ANCHOR)
    rows = rows.withColumn("few", few).withColumn("order", F.row_number().over(W.partitionBy("page", "few").orderBy(*order)))
    kept = F.col("few") & (F.col("order") <= PRIMARY_PER_PAGE)
    cls = F.when(kept, "primary").when(F.col("is_primary"), "candidate").otherwise(F.col("was"))
    rows = rows.withColumns({"class": cls, "demoted": F.col("is_primary") & ~kept, "order": F.when(kept, F.col("order"))})
    named = F.get(F.array(*[F.lit(x) for x in GUARANTEES]), F.col("promoted"))
    return rows.withColumn("promoted", named).drop("was", "is_primary", "k", "few")


def unmet_guarantees(paths: DataFrame) -> DataFrame:
    """(page, guarantee): what the primary paths of a page, as they were classified, don't meet."""
    met = paths.groupBy("page").agg(*[F.max((F.col("class") == "primary") & guarantee(x)).alias(x) for x in GUARANTEES])
    missing = F.array_compact(F.array(*[F.when(~F.col(x), x) for x in GUARANTEES]))
    return met.select("page", F.explode(missing).alias("guarantee"))


def partitioned(paths: DataFrame, intent: str | Column) -> DataFrame:
    """Selected paths with status and reject_reason for a question: proven (a primary path that fits it), candidate (another that fits) or rejected.

    Any path fits the questions "context" and "auto".
    """
    asked = F.lit(intent) if isinstance(intent, str) else intent
    only = lambda kinds: F.forall("kinds", lambda k: k.isin(*kinds))
    fits, writes = F.lit(True), F.exists("kinds", lambda k: k.isin(*WRITER_EDGES))
    for name, kinds in INTENT_EDGES.items():
        fits = F.when(asked == name, only(kinds)).otherwise(fits)
    wrong = F.when(F.col("class") == "rejected", "path_selector_rejected").when((asked == "writer") & ~writes, "writer_intent_requires_write_edge").when(~fits, F.concat(F.lit("edge_type_not_allowed_for_"), asked, F.lit("_intent")))
    rows = paths.withColumn("reject_reason", wrong)
    return rows.withColumn("status", F.when(F.col("reject_reason").isNotNull(), "rejected").when(F.col("class") == "primary", "proven").otherwise("candidate"))
