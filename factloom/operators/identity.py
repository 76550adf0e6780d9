"""Entity resolution: scored candidates inside blocks, then one decision per input."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import AtomicType

from factloom.functions.columns import normalize_identity
from factloom.session import discard, materialize

# Points of each kind of agreement or conflict.
POINTS = {
    "provider": 40, "provider_conflict": -100, "model_id": 40, "external_id": 40, "alias": 35, "name": 20, "family": 15, "version": 15, "version_conflict": -60,
    "critical_conflict": -20, "lifecycle_conflict": -40,
}

# Inputs in a slice and entities in a list of ambiguous(), and rows that a task of it makes. Fields of LIST values fill whole bytes.
SLICE, LIST, ROWS = 1024, 256, 2**23


def _same(left: Column, right: Column) -> Column:
    return F.coalesce(left == right, F.lit(False))


def _plain(c: str) -> Column:
    return normalize_identity(F.col(c).cast("string"))


def _classes(entities: DataFrame) -> DataFrame:
    """Entities of equal scoring attributes as one row, prefixed __e_, with their number __n and smallest id."""
    has = set(entities.columns)
    rows = entities.select(
        F.col("provider").alias("__e_provider"),
        F.col("model_id").alias("__e_model_id"),
        F.array_sort(F.array_distinct("external_ids")).alias("__e_external_ids"),
        F.array_sort(F.array_distinct(F.transform("aliases", normalize_identity))).alias("__e_aliases"),
        (F.col("key") if "key" in has else F.lit(None).cast("string")).alias("__e_key"),
        _plain("name").alias("__e_name"),
        _plain("family").alias("__e_family"),
        F.col("version").alias("__e_version"),
        (_same(F.col("lifecycle"), F.lit("retired")) if "lifecycle" in has else F.lit(False)).alias("__e_retired"),
        F.col("entity_id"),
    )
    return rows.groupBy(*rows.columns[:-1]).agg(F.count("*").alias("__n"), F.min("entity_id").alias("entity_id"))


def _named_pairs(inputs: DataFrame, classes: DataFrame) -> DataFrame:
    """Inputs beside the classes that share more with them than provider, family and version, by equi-joins.

    A model id or an external id reaches classes of any provider; a name, an
    alias or a key those of the input's own.
    """
    own = F.col("provider") == F.col("__e_provider")
    ids = inputs.withColumn("__id", F.explode("external_ids")).join(classes.withColumn("__e_id", F.explode("__e_external_ids")), F.col("__id") == F.col("__e_id"))
    aliases = inputs.join(classes.withColumn("__e_alias", F.explode("__e_aliases")), own & (F.col("__key") == F.col("__e_alias")))
    pairs = inputs.join(classes, F.col("model_id") == F.col("__e_model_id")).unionByName(ids.drop("__id", "__e_id"))
    pairs = pairs.unionByName(aliases.drop("__e_alias")).unionByName(inputs.join(classes, own & (F.col("__name") == F.col("__e_name"))))
    return pairs.unionByName(inputs.join(classes, own & (F.col("key") == F.col("__e_key")))).distinct()


def _unnamed(shapes: DataFrame, classes: DataFrame) -> DataFrame:
    """For each (provider, __family, version, __active) the best score that its provider's entities reach by family and version alone.

    Adds score, entity_id (the smallest of that score), __conflict and __n,
    their number. Entities are only counted, by (provider, family, version) and
    coarser; those of another family are the total without the own family, and
    their smallest id is one of the two smallest of different families. A score
    with a version conflict is never above 0, so its ids don't matter.
    """
    base = materialize(classes.groupBy("__e_provider", "__e_family", "__e_version", "__e_retired").agg(F.sum("__n").alias("__n"), F.min("entity_id").alias("entity_id")), "identity-counts")
    shapes = materialize(shapes, "identity-shapes")
    at = POINTS["provider"]
    whole, none = ["provider", "__family", "version", "__active"], F.lit(None).cast(base.schema["entity_id"].dataType)
    family = F.col("__family") == F.col("__e_family")
    provider = F.col("provider") == F.col("__e_provider")
    out = []

    def add(rows: DataFrame, score: Column, entity: Column, n: Column, conflict: bool = False) -> None:
        out.append(rows.select(*whole, score.cast("long").alias("score"), entity.alias("entity_id"), F.lit(conflict).alias("__conflict"), n.alias("__n")))

    def level(asked: DataFrame, rows: DataFrame, keys: list[str], on: Column, points: Column) -> None:
        """Groups that stand in one relation to the input's version, by own and other families."""
        families = rows.groupBy(*keys, "__e_family").agg(F.sum("__n").alias("__n"), F.min("entity_id").alias("entity_id"))
        same = asked.join(families, on & family)
        add(same, points + POINTS["family"], F.col("entity_id"), F.col("__n"))
        add(same, points, none, -F.col("__n"))
        inside = Window.partitionBy(*keys)
        ranked = families.withColumn("__all", F.sum("__n").over(inside)).withColumn("__rank", F.row_number().over(inside.orderBy("entity_id"))).where("__rank <= 2")
        one, two = F.col("__rank") == 1, F.col("__rank") == 2
        totals = ranked.groupBy(*keys).agg(F.max("__all").alias("__n"), F.max(F.when(one, F.col("entity_id"))).alias("__one"), F.max(F.when(one, F.col("__e_family"))).alias("__e_family"), F.max(F.when(two, F.col("entity_id"))).alias("__two"))
        add(asked.join(totals, on), points, F.when(F.coalesce(family, F.lit(False)), F.col("__two")).otherwise(F.col("__one")), F.col("__n"))

    dated, undated = shapes.where("version is not null"), shapes.where("version is null")
    with_version, without = base.where("__e_version is not null"), base.where("__e_version is null")
    version = provider & (F.col("version") == F.col("__e_version"))
    retired = F.when(F.col("__active") & F.col("__e_retired"), POINTS["lifecycle_conflict"]).otherwise(0)
    level(dated, with_version, ["__e_provider", "__e_version", "__e_retired"], version, F.lit(at + POINTS["version"]) + retired)
    level(dated, without, ["__e_provider"], provider, F.lit(at))
    level(undated, base, ["__e_provider"], provider, F.lit(at))
    low, lower = F.lit(at + POINTS["version_conflict"] + POINTS["family"]), F.lit(at + POINTS["version_conflict"])
    for keys, on, sign in ((["__e_provider"], provider, 1), (["__e_provider", "__e_version"], version, -1)):
        n = F.lit(sign) * F.col("__n")
        add(dated.join(with_version.groupBy(*keys).agg(F.sum("__n").alias("__n")), on), lower, none, n, True)
        own = dated.join(with_version.groupBy(*keys, "__e_family").agg(F.sum("__n").alias("__n")), on & family)
        add(own, low, none, n, True)
        add(own, lower, none, -n, True)
    scores = reduce(DataFrame.unionByName, out).groupBy(*whole, "score", "__conflict").agg(F.sum("__n").alias("__n"), F.min("entity_id").alias("entity_id")).where("__n > 0")
    best = scores.groupBy(*whole).agg(F.max(F.struct("score", "entity_id", "__conflict", "__n")).alias("b"))
    return best.select(*whole, "b.*")


def resolve(inputs: DataFrame, entities: DataFrame) -> DataFrame:
    """One decision per distinct input (ID-1, ID-2, TK-4).

    inputs: provider, model_id, external_ids, key, name, family, version, and
    optionally critical_conflict (boolean), lifecycle and candidate_source;
    entities: the same with entity_id and aliases (array), key and lifecycle
    optional. Names, families, aliases and keys are compared normalised; this
    is done once per row, not per pair. Equal inputs are scored once, and so
    are entities whose scoring attributes are equal. Null attributes agree with
    nothing.

    An input meets only the classes that share a model id, external id, name,
    alias or key with it. All others of its provider differ in family and
    version alone and are looked up as counts, so rows grow with the inputs, not
    with inputs times entities.

    Returns the input columns, score long (0 without a candidate), entity_id
    (null unless auto_link) and decision: needs_review for AI suggestions,
    else create_new (no score above 0), rejected (the best has another provider
    or version), auto_link (the best is unique and a deterministic key
    matched) or needs_review.
    """
    names = inputs.columns
    yes = lambda c: F.coalesce(F.col(c), F.lit(False)) if c in names else F.lit(False)
    active = _same(F.col("lifecycle"), F.lit("active")) if "lifecycle" in names else F.lit(False)
    helpers = {"__name": _plain("name"), "__family": _plain("family"), "__key": _plain("key"), "__active": active}
    distinct = materialize(inputs.distinct().withColumns(helpers), "identity-inputs")
    classes = materialize(_classes(entities), "identity-classes")
    same_provider, same_version = _same(F.col("provider"), F.col("__e_provider")), _same(F.col("version"), F.col("__e_version"))
    features = {
        "provider": same_provider,
        "provider_conflict": ~same_provider,
        "model_id": _same(F.col("model_id"), F.col("__e_model_id")),
        "external_id": F.coalesce(F.arrays_overlap("external_ids", "__e_external_ids"), F.lit(False)),
        "alias": F.coalesce(F.array_contains("__e_aliases", F.col("__key")), F.lit(False)),
        "name": _same(F.col("__name"), F.col("__e_name")),
        "family": _same(F.col("__family"), F.col("__e_family")),
        "version": same_version,
        "version_conflict": F.coalesce(F.col("version") != F.col("__e_version"), F.lit(False)),
        "lifecycle_conflict": F.col("__active") & F.col("__e_retired") & same_version,
    }
    score = sum((F.when(hit, POINTS[name]).otherwise(0) for name, hit in features.items()), F.lit(0)).cast("long")
    strong = features["model_id"] | features["external_id"] | features["alias"] | _same(F.col("key"), F.col("__e_key"))
    # A key of its own adds no points, so such a class is among the counted ones already.
    counted = same_provider & ~(features["model_id"] | features["external_id"] | features["alias"] | features["name"])
    named = _named_pairs(distinct, classes).select(
        *names, score.alias("score"), "entity_id", (features["provider_conflict"] | features["version_conflict"]).alias("__conflict"), strong.alias("__strong"), F.when(counted, 0).otherwise(F.col("__n")).alias("__n")
    )
    shape = ["provider", "__family", "version", "__active"]
    best = _unnamed(distinct.select(*shape).distinct(), classes)
    best = best.select(*[F.col(c).alias(f"{c}__b") for c in shape], "score", "entity_id", "__conflict", F.lit(False).alias("__strong"), "__n")
    on = reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"{c}__b")) for c in shape])
    rows = distinct.join(best, on, "left").select(*names, "score", "entity_id", "__conflict", "__strong", "__n").unionByName(named)
    # Inputs are distinct, so the best of each comes from one aggregate with partial results.
    top = F.max(F.struct("score", (-F.col("entity_id")).alias("order"), "entity_id", "__conflict", "__strong")).alias("__best")
    by_score = rows.groupBy(*names, "score").agg(top, F.sum("__n").alias("__ties"))
    found = by_score.groupBy(*names).agg(F.max("__best").alias("__best"), F.max_by("__ties", "score").alias("__ties"))
    total = F.col("__best.score") + F.when(yes("critical_conflict"), POINTS["critical_conflict"]).otherwise(0)
    suggested = _same(F.col("candidate_source"), F.lit("ai_suggestion")) if "candidate_source" in names else F.lit(False)
    decision = (
        F.when(suggested, "needs_review")
        .when(F.coalesce(total <= 0, F.lit(True)), "create_new")
        .when(F.col("__best.__conflict"), "rejected")
        .when((F.col("__ties") == 1) & F.col("__best.__strong"), "auto_link")
        .otherwise("needs_review")
    )
    shown = F.when(suggested, 0).otherwise(F.coalesce(total, F.lit(0))).cast("long")
    out = found.select(*names, shown.alias("score"), F.col("__best.entity_id").alias("__id"), decision.alias("decision"))
    return out.withColumn("entity_id", F.when(F.col("decision") == "auto_link", F.col("__id"))).drop("__id")


def survivors(merges: DataFrame) -> DataFrame:
    """Follow merges (entity_id, merged_into) to the surviving entity by pointer doubling (ID-7).

    Returns entity_id, survivor_id and on_cycle of every merged entity. An
    entity has one merge (of several the smallest counts). Rounds go on until
    no chain grows, so chains may have any length. Entities that lead into a
    cycle have no survivor: null, on_cycle true. Rows with nulls are left out.
    """
    links = merges.where("entity_id is not null and merged_into is not null").groupBy("entity_id").agg(F.min("merged_into").alias("survivor_id"))
    links = materialize(links, "merges")
    longest, reach = links.count(), 1  # a chain without a cycle has at most that many links
    while True:
        onward = links.select(F.col("entity_id").alias("survivor_id"), F.col("survivor_id").alias("__next"))
        step = materialize(links.join(onward, "survivor_id", "left").select("entity_id", "survivor_id", "__next"), "merges")
        discard(links)
        going = step.where("__next is not null").limit(1).count() > 0
        if not going or reach > longest:
            turning = F.col("__next").isNotNull()
            return step.select("entity_id", F.when(~turning, F.col("survivor_id")).alias("survivor_id"), turning.alias("on_cycle"))
        links, reach = materialize(step.select("entity_id", F.coalesce("__next", "survivor_id").alias("survivor_id")), "merges"), 2 * reach
        discard(step)


def ambiguous(inputs: DataFrame, keyed: DataFrame, key: str) -> DataFrame:
    """Inputs whose key belongs to several entities, one row for each of these (ID-3).

    That is inputs times entities of a key, however many there are, so each key
    is cut twice: its inputs are dealt to slices of about SLICE, its entities
    cut to lists of up to LIST, which every slice gets. A task takes each list
    over a whole slice before the next one, so it holds one slice, and columns
    repeat every LIST rows or change every LIST rows, which keeps files small.
    """
    owners = keyed.where(F.col(key).isNotNull()).select(key, "entity_id").distinct()
    several = owners.groupBy(key).agg(F.count("*").alias("__owners")).where("__owners > 1")
    sizes = materialize(several.join(inputs.groupBy(key).agg(F.count("*").alias("__inputs")), key).withColumn("__slices", F.ceil(F.col("__inputs") / SLICE)), "ambiguous-keys")
    whole = sizes.agg(F.sum("__slices"), F.sum(F.col("__inputs") * F.col("__owners").cast("double"))).first()
    # Lists are few bytes but many rows, so the number of tasks goes by rows.
    tasks = max(int(inputs.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(whole[0] or 1, math.ceil((whole[1] or 1) / ROWS), 10_000))
    dealt = F.struct(key, "__slice").alias("__slice")  # one column, which a constant key does not take out of the deal
    upto = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n))
    share = F.when(F.col("entity_id").isNotNull(), F.pmod(F.xxhash64("entity_id"), F.ceil(F.col("__owners") / (16 * LIST))))
    shares = owners.join(sizes, key).groupBy(key, "__slices", share.alias("__share")).agg(F.sort_array(F.collect_list("entity_id")).alias("__all"))
    cut = shares.select("*", upto(F.greatest(F.ceil(F.size("__all") / LIST) - 1, F.lit(0))).alias("__list")).withColumn("__entities", F.slice("__all", (F.col("__list") * LIST + 1).cast("int"), LIST))
    lists = cut.select(key, "__entities", upto(F.col("__slices") - 1).alias("__slice")).select(dealt, "__entities")
    plain = [f.name for f in inputs.schema.fields if isinstance(f.dataType, AtomicType)]
    rows = inputs.join(sizes.select(key, "__slices"), key).withColumn("__slice", F.pmod(F.xxhash64(*plain), F.col("__slices"))).select(dealt, *inputs.columns)
    pairs = lists.repartition(tasks, "__slice").join(rows.repartition(tasks, "__slice").hint("merge"), "__slice")
    # The list of a null entity is empty, so it gives its one row too.
    return pairs.select(key, *[c for c in inputs.columns if c != key], F.explode_outer("__entities").alias("entity_id"))


def check_operations(entities: DataFrame, operations: DataFrame) -> DataFrame:
    """Add problem to merges, splits and reversals (ID-4, ID-5, ID-6).

    entities: entity_id, provider; operations: op_id, kind, source_id,
    target_id, undoes, one row for each merge and for each child of a split
    (op_id repeats); a reversal only names the op it undoes. problem, on all
    rows of the op: unknown_entity, same_entity, other_provider, few_children
    (under 2), unknown_operation, unknown_kind or null.
    """
    one = entities.select("entity_id", "provider").distinct()
    source = one.select(F.col("entity_id").alias("source_id"), F.col("provider").alias("__p"))
    target = one.select(F.col("entity_id").alias("target_id"), F.col("provider").alias("__q"))
    undone = operations.where(F.col("kind").isin("merge", "split")).select(F.col("op_id").alias("undoes"), F.lit(True).alias("__known")).distinct()
    rows = operations.join(source, "source_id", "left").join(target, "target_id", "left").join(undone, "undoes", "left")
    problem = (
        F.when(F.coalesce(~F.col("kind").isin("merge", "split", "reverse"), F.lit(True)), "unknown_kind")
        .when(F.col("kind") == "reverse", F.when(F.col("__known").isNull(), "unknown_operation"))
        .when(F.col("__p").isNull() | F.col("__q").isNull(), "unknown_entity")
        .when(F.col("source_id") == F.col("target_id"), "same_entity")
        .when(F.col("__p") != F.col("__q"), "other_provider")
    )
    per_op = rows.groupBy("op_id").agg(
        F.min(problem).alias("__worst"), F.first("kind", ignorenulls=True).alias("__kind"), F.count_distinct("target_id").alias("__children")
    )
    whole = F.coalesce("__worst", F.when((F.col("__kind") == "split") & (F.col("__children") < 2), "few_children"))
    return operations.join(per_op.select("op_id", whole.alias("problem")), "op_id", "left")


def apply_operations(entities: DataFrame, checked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entities and lineage edges after a log of operations (ID-4 to ID-6).

    checked comes from check_operations; rows with a problem do nothing.
    Reversing takes away only that operation's rows, so later ones stay. Returns
    (entity_id, state: active, merged or split, merged_into) and edges (src,
    dst, kind: alias_of or version_of, op_id). If several merges stand for an
    entity, that of the smallest op_id counts.
    """
    sound = checked.where("problem is null")
    undone = sound.where("kind = 'reverse'").select(F.col("undoes").alias("op_id")).distinct()
    stands = sound.where(F.col("kind").isin("merge", "split")).join(undone, "op_id", "left_anti")
    merged = F.min(F.when(F.col("kind") == "merge", F.struct("op_id", "target_id"))).alias("__merge")
    what = stands.groupBy(F.col("source_id").alias("entity_id")).agg(merged, F.count_if(F.col("kind") == "split").alias("__splits"))
    state = F.when(F.col("__merge").isNotNull(), "merged").when(F.col("__splits") > 0, "split").otherwise("active")
    out = entities.select("entity_id").distinct().join(what, "entity_id", "left").select("entity_id", state.alias("state"), F.col("__merge.target_id").alias("merged_into"))
    merge = F.col("kind") == "merge"
    edges = stands.select(
        F.when(merge, F.col("source_id")).otherwise(F.col("target_id")).alias("src"),
        F.when(merge, F.col("target_id")).otherwise(F.col("source_id")).alias("dst"),
        F.when(merge, "alias_of").otherwise("version_of").alias("kind"),
        "op_id",
    )
    return out, edges.distinct()


def apply_reviews(candidates: DataFrame, reviews: DataFrame, key: str, time: str, tie: str, verdict: str) -> DataFrame:
    """Add resolution to candidates: the first review's verdict of each key, else pending (ID-8)."""
    first = reviews.groupBy(key).agg(F.min_by(verdict, F.struct(time, tie)).alias("resolution"))
    return candidates.join(first, key, "left").withColumn("resolution", F.coalesce("resolution", F.lit("pending")))
