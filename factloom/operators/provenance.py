"""Provenance graphs: shortest evidence paths, neighbourhoods and coverage by frontier joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from factloom.session import materialize


def evidence_paths(edges: DataFrame, roots: DataFrame, targets: DataFrame) -> DataFrame:
    """The shortest directed path from every root to the first node of each target type (GR-2).

    edges: src, dst; roots: root; targets: node, kind. All roots advance at
    once; each node is entered once per root, ties go to the smallest path.
    The rounds end when no root reaches a new node, so paths have any length and
    cycles end. Returns root, kind, node, depth int and path (array). A root that is itself
    a target has depth 0. Null ends take no part; repeated edges count once.
    """
    links = edges.select("src", "dst").where("src is not null and dst is not null").distinct()
    frontier = roots.select("root").where("root is not null").distinct().select("root", F.col("root").alias("node"), F.array("root").alias("path"))
    seen = frontier
    while True:
        onward = frontier.join(links, F.col("node") == F.col("src")).select("root", F.col("dst").alias("node"), F.concat("path", F.array("dst")).alias("path"))
        fresh = onward.groupBy("root", "node").agg(F.min("path").alias("path")).join(seen.select("root", "node"), ["root", "node"], "left_anti")
        frontier = materialize(fresh, "frontier")
        if frontier.limit(1).count() == 0:
            break
        seen = seen.unionByName(frontier)
    reached = seen.join(targets.select("node", "kind").distinct(), "node").withColumn("depth", F.size("path") - 1)
    first = reached.groupBy("root", "kind").agg(F.min(F.struct("depth", "path", "node")).alias("first"))
    return first.select("root", "kind", "first.node", "first.depth", "first.path")


def neighbourhood(edges: DataFrame, roots: DataFrame, max_depth: int = 4) -> DataFrame:
    """All nodes within max_depth steps of each root, whatever the edges' direction (GR-3): root, node, depth int."""
    both = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    both = both.where("src is not null and dst is not null").distinct()
    frontier = roots.select("root").distinct().select("root", F.col("root").alias("node"), F.lit(0).alias("depth"))
    seen = frontier
    for depth in range(1, max_depth + 1):
        onward = frontier.join(both, F.col("node") == F.col("src")).select("root", F.col("dst").alias("node")).distinct()
        frontier = materialize(onward.join(seen, ["root", "node"], "left_anti").withColumn("depth", F.lit(depth)), "near")
        if frontier.limit(1).count() == 0:
            break
        seen = seen.unionByName(frontier)
    return seen


def uncovered(facts: DataFrame, paths: DataFrame, kinds: list[str]) -> DataFrame:
    """Facts (root) and the kinds of evidence that no path of theirs reaches (GR-5)."""
    wanted = facts.select("root").distinct().withColumn("kind", F.explode(F.array(*[F.lit(k) for k in kinds])))
    return wanted.join(paths.select("root", "kind"), ["root", "kind"], "left_anti")


def blast_radius(changed: DataFrame, *hops: tuple[DataFrame, str]) -> DataFrame:
    """What depends on changed nodes, level by level (JN-14, AG-6).

    hops: (edges with src and dst, kind of dst) in order. Returns distinct kind, target_id.
    """
    level, out = changed.select(F.col("node").alias("src")).distinct(), None
    for edges, kind in hops:
        level = level.join(edges.select("src", "dst"), "src").select(F.col("dst").alias("src")).distinct()
        hit = level.select(F.lit(kind).alias("kind"), F.col("src").alias("target_id"))
        out = hit if out is None else out.unionByName(hit)
    return out


def marked_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges with edge_id, the node ids src and dst, kind and orphan (GR-1): whether an end is no node.

    nodes: kind, ref; edges: src_kind, src_ref, dst_kind, dst_ref, kind. Equal
    edges count once; kinds hold no |. Ends are looked for by kind and ref; ids,
    of 64 letters each, are made after the joins, so that no shuffle carries them.
    """
    known = nodes.where("kind is not null and ref is not null").select("kind", F.col("ref").cast("string").alias("ref")).distinct()
    refs = edges.select("src_kind", F.col("src_ref").cast("string").alias("src_ref"), "dst_kind", F.col("dst_ref").cast("string").alias("dst_ref"), "kind").distinct()
    end = lambda e: known.select(F.col("kind").alias(f"{e}_kind"), F.col("ref").alias(f"{e}_ref"), F.lit(True).alias(f"__{e}"))
    marked = refs.join(end("src"), ["src_kind", "src_ref"], "left").join(end("dst"), ["dst_kind", "dst_ref"], "left")
    both = F.coalesce(F.col("__src") & F.col("__dst"), F.lit(False))
    named = marked.select(node_id("src_kind", "src_ref").alias("src"), node_id("dst_kind", "dst_ref").alias("dst"), "kind", (~both).alias("orphan"))
    return named.select(F.sha2(F.concat_ws("|", "kind", "src", "dst"), 256).alias("edge_id"), "src", "dst", "kind", "orphan")


def graph(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Deterministic graph tables (GR-1): nodes with node_id, edges with edge_id, and edges that lack an end.

    nodes: kind, ref; edges as in marked_edges. Equal rows count once; null refs are no nodes.
    """
    made = nodes.where("ref is not null").select(node_id("kind", "ref").alias("node_id"), "kind", "ref").dropDuplicates(["node_id"])
    marked = marked_edges(nodes, edges)
    return made, marked.where("not orphan").drop("orphan"), marked.where("orphan").drop("orphan")


def node_id(kind: str, ref: str):
    """The id of a node, which depends on nothing but its kind and its ref."""
    return F.sha2(F.concat_ws("|", kind, ref), 256)


def bundles(artifacts: DataFrame, bundle: str, name: str, digest: str) -> DataFrame:
    """Sealed evidence bundles (GR-4, DQ-11): n_artifacts, n_repeated names and the manifest's digest.

    The digest covers name and digest of every artifact, sorted. A bundle's
    artifacts are digested in 256 shards by the name's hash before the shards'
    digests are joined, so that no task holds a whole bundle. A name that
    repeats keeps its smallest digest; null names take no part.
    """
    per_name = artifacts.where(F.col(name).isNotNull()).groupBy(bundle, F.col(name).cast("string").alias("__name")).agg(F.coalesce(F.min(digest), F.lit("")).alias("__digest"), F.count("*").alias("__n"))
    line = F.concat_ws(":", "__name", "__digest")
    shard = F.substring(F.sha2("__name", 256), 1, 2)
    shards = per_name.groupBy(bundle, shard.alias("__shard")).agg(
        F.sha2(F.array_join(F.sort_array(F.collect_list(line)), "\n"), 256).alias("__digest"), F.count("*").alias("__n"), F.count_if(F.col("__n") > 1).alias("__repeated")
    )
    whole = F.sort_array(F.collect_list(F.concat("__shard", "__digest")))
    return shards.groupBy(bundle).agg(F.sum("__n").alias("n_artifacts"), F.sum("__repeated").alias("n_repeated"), F.sha2(F.array_join(whole, "\n"), 256).alias("bundle_digest"))


def broken_bundles(sealed: DataFrame, artifacts: DataFrame, bundle: str, name: str, digest: str) -> DataFrame:
    """Bundles whose artifacts no longer give the digest they were sealed with, or that lack artifacts (DQ-11)."""
    now = bundles(artifacts, bundle, name, digest).select(bundle, F.col("bundle_digest").alias("found_digest"))
    return sealed.join(now, bundle, "left").where(~F.col("bundle_digest").eqNullSafe(F.col("found_digest")))
