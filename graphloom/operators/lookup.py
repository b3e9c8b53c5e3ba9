"""Finding nodes: keywords, near misses, target normalisation and resolution. Every operator takes many targets at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .traversal import FEW, settled


def by_id(nodes: DataFrame, targets: DataFrame) -> DataFrame:
    """Point lookups of a table of ids (target)."""
    return targets.join(nodes, F.col("target") == F.col("id"), "left")


def of_type(nodes: DataFrame, part: str) -> DataFrame:
    return nodes.where(F.lower("node_type").contains(part.lower()))


def keyword_score(keyword: Column) -> Column:
    """100 for an equal id or name, 80 for a part of one, 50 for a part of the path; case does not matter."""
    k, id_, name = F.lower(keyword), F.lower("id"), F.lower("name")
    return F.when((id_ == k) | (name == k), 100).when(id_.contains(k) | name.contains(k), 80).when(F.lower("path").contains(k), 50)


def find(nodes: DataFrame, keywords: list[str], limit: int = 20, node_type: str | None = None) -> DataFrame:
    """(keyword, rank, id, node_type, score, confidence): the best matches of each keyword; ties by id.

    The keywords are literals, exploded per node and filtered by their score before the ranking shuffles anything.
    """
    rows = of_type(nodes, node_type) if node_type else nodes
    rows = rows.select("id", "node_type", "name", "path", F.explode(F.array(*[F.lit(k) for k in keywords])).alias("keyword"))
    scored = rows.withColumn("score", keyword_score(F.col("keyword"))).where("score IS NOT NULL")
    order = W.partitionBy("keyword").orderBy(F.desc("score"), "id")
    ranked = scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)
    confidence = F.when(F.col("score") >= 100, "high").when(F.col("score") >= 80, "medium").otherwise("low")
    return ranked.select("keyword", "rank", "id", "node_type", F.col("score").cast("int").alias("score"), confidence.alias("confidence"))


def prefix(id_: Column) -> Column:
    return F.when(F.instr(id_, ":") > 0, F.substring_index(id_, ":", 1))


def bare(id_: Column) -> Column:
    """The last part of an id: behind the kind, the page and the component."""
    return F.element_at(F.split(F.substring(id_, F.instr(id_, ":") + 1, F.length(id_)), "\\|"), -1)


def resolve_bare(nodes: DataFrame, names: DataFrame, kind: str) -> DataFrame:
    """(name, status, ids): unique, ambiguous (all ids, sorted) or missing; never the first match."""
    local = nodes.where(F.col("id").startswith(f"{kind}:")).select(bare(F.col("id")).alias("local"), "id")
    found = names.join(local, F.col("name") == F.col("local"), "left").groupBy("name").agg(F.sort_array(F.collect_set("id")).alias("ids"))
    status = F.when(F.size("ids") == 0, "missing").when(F.size("ids") == 1, "unique").otherwise("ambiguous")
    return found.select("name", status.alias("status"), F.array_join("ids", ",").alias("ids"))


# Beginnings of a target, and how many candidates an ambiguous one gets.
TARGET_PREFIXES = ("comp:", "action:", "field:", "model:", "page:", "dataflow:")
MOST_CANDIDATES = 12


def _split(id_: Column) -> Column:
    """(kind, content, parts in lower case, forms): forms are what the first part may be called, without its file suffix: itself and every path end."""
    kind = F.substring_index(id_, ":", 1)
    content = F.substring(id_, F.instr(id_, ":") + 1, F.length(id_))
    parts = F.split(F.lower(content), "\\|")
    return F.struct(kind.alias("kind"), content.alias("content"), parts.alias("parts"))


def _forms(part: Column) -> Column:
    """A path without its file suffix, and all its ends behind a slash."""
    plain = F.regexp_replace(part, "\\.(spg|tbl)$", "")
    steps = F.split(plain, "/")
    return F.transform(F.sequence(F.lit(1), F.size(steps)), lambda k: F.array_join(F.slice(steps, k, F.size(steps)), "/"))


def _rest(parts: Column, upto: Column) -> Column:
    return F.array_join(F.slice(parts, F.lit(2), upto - 1), "|")


def normalise_targets(nodes: DataFrame, targets: DataFrame) -> DataFrame:
    """(target, tier, status, ids): ids that a prefixed target means, by the first tier that has any.

    -1 none; 0 the id itself; 1 the file by the end of its path, all other parts equal; 2 another kind, the same content; 3 the
    parts that are written, of an id with more; 4 an id whose parts end a longer target; 5 the node's own name alone;
    6 another file, all other parts equal. One id in the tier resolves the target, several make it ambiguous (the first
    ones, sorted, are given). Case and file suffixes do not matter but in tier 0. Every tier is an equi-join: names that
    a node may go by are exploded from its own path. All ids of a page share some of these names, so few targets are sent
    to the nodes, which are read and not shuffled, and what a target means is cut before its rows meet.
    """
    starts = lambda c: F.array_contains(F.array(*[F.lit(x) for x in TARGET_PREFIXES]), F.concat(F.substring_index(c, ":", 1), F.lit(":")))
    known = settled(targets.select("target").distinct().where(starts(F.col("target"))))
    t = known.withColumn("w", _split(F.col("target")))
    n = settled(nodes.select("id").where(starts(F.col("id")))).withColumn("h", _split(F.col("id")))
    size = lambda x: F.size(f"{x}.parts")
    first = lambda x: F.get(f"{x}.parts", F.lit(0))
    last = lambda x: F.element_at(f"{x}.parts", -1)
    joined = lambda x: F.array_join(f"{x}.parts", "|")
    plain = lambda c: F.regexp_replace(c, "\\.(spg|tbl)$", "")
    whole = t.select("target", "w.kind", size("w").alias("size"), plain(first("w")).alias("file"), _rest(F.col("w.parts"), size("w")).alias("rest"))
    every = n.select("id", "h.kind", "h.parts", size("h").alias("size"), F.explode(_forms(first("h"))).alias("file"))
    same = every.select("id", "kind", "size", "file", _rest(F.col("parts"), F.col("size")).alias("rest"))
    heads = every.where("size > 1").select("id", "kind", "file", "parts", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("size")).select("id", "kind", "size", "file", _rest(F.col("parts"), F.col("size")).alias("rest"))
    ends = t.where(size("w") > 1).select("target", "w.kind", F.explode(F.transform(F.sequence(F.lit(2), size("w")), lambda k: F.array_join(F.slice("w.parts", k, size("w")), "|"))).alias("end"))
    asked = F.broadcast if known.count() <= FEW else lambda df: df
    tiers = [
        (0, n.join(asked(t.select("target")), F.col("target") == F.col("id"))),
        (1, same.join(asked(whole), ["kind", "size", "file", "rest"])),
        (2, n.select("id", "h.kind", F.lower("h.content").alias("c")).join(asked(t.select("target", F.col("w.kind").alias("k"), F.lower("w.content").alias("c"))), "c").where("k <> kind")),
        (3, heads.join(asked(whole), ["kind", "size", "file", "rest"])),
        (4, n.select("id", "h.kind", joined("h").alias("end")).join(asked(ends), ["kind", "end"])),
        (5, n.where(size("h") > 1).select("id", "h.kind", F.explode(_forms(last("h"))).alias("file")).join(asked(whole.where("size = 1").select("target", "kind", "file")), ["kind", "file"])),
        (6, n.select("id", "h.kind", size("h").alias("size"), _rest(F.col("h.parts"), size("h")).alias("rest")).join(asked(whole.where("size > 1").select("target", "kind", "size", "rest")), ["kind", "size", "rest"])),
    ]
    found = None
    for tier, rows in tiers:
        rows = rows.select("target", F.lit(tier).alias("tier"), "id")
        found = rows if found is None else found.unionByName(rows)
    # a tier may have an id more than once: equal rows have one rank, and the first tier has the first ranks
    place = F.dense_rank().over(W.partitionBy("target").orderBy("tier", "id"))
    first_ones = settled(found.withColumn("k", place).where(F.col("k") <= MOST_CANDIDATES).select("target", "tier", "id").distinct())
    best = first_ones.groupBy("target").agg(F.min("tier").alias("tier"))
    kept = first_ones.join(best, ["target", "tier"]).groupBy("target", "tier").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    status = F.when(F.col("tier") == 0, "exact").when(F.size("ids") == 1, "resolved").otherwise("ambiguous")
    meant = kept.select("target", "tier", status.alias("status"), F.array_join("ids", ",").alias("ids"))
    lost = targets.select("target").distinct().join(meant, "target", "left_anti").select("target", F.lit(-1).alias("tier"), F.lit("not_found").alias("status"), F.lit("").alias("ids"))
    return meant.unionByName(lost)


def with_prefix(nodes: DataFrame, start: str, limit: int | None = None) -> DataFrame:
    """Ids that begin so, sorted."""
    rows = nodes.where(F.col("id").startswith(start)).select("id").orderBy("id")
    return rows.limit(limit) if limit else rows
