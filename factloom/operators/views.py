"""Views that put an entity, a fact, an identity, a bundle or an incident beside what belongs to it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from factloom.operators.dossier import Child, dossier


def newest(rows: DataFrame, key: str, at: list[str], columns: list[str], name: str) -> DataFrame:
    """The newest row of each key, by `at`, as one struct column; an aggregate with partial results (JN-19, GOV-5)."""
    return rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(F.struct(*columns), F.struct(*at)).alias(name))


def with_newest(roots: DataFrame, key: str, logs: dict[str, tuple[DataFrame, list[str], list[str]]]) -> DataFrame:
    """Roots with the newest row of each log (JN-19): name to (rows, time and tie columns, columns shown); null without any."""
    out = roots
    for name, (rows, at, columns) in logs.items():
        out = out.join(newest(rows, key, at, columns, name), key, "left")
    return out


def fact_dossier(projection: DataFrame, decisions: DataFrame, observations: DataFrame, evidence: DataFrame, version_id: str = "fact_version_id") -> DataFrame:
    """Effective versions with their decision, observations and evidence (JN-12).

    projection: keys and current_version_id as of some time (visibility.project);
    decisions: version_id and decision. Lists show at most 20 rows, counts are whole.
    """
    roots = projection.where("current_version_id is not null").withColumnRenamed("current_version_id", version_id).join(decisions, version_id, "left")
    children = {"observations": Child(observations, ["observation_id"], [F.col("observation_id")]), "evidence": Child(evidence, ["evidence_ref"], [F.col("evidence_ref")])}
    return dossier(roots, version_id, children)


def incident_detail(incidents: DataFrame, key: str, logs: dict[str, tuple[DataFrame, list[str], list[str]]], calls: DataFrame, at: list[str], shown: list[str], most: int = 25) -> DataFrame:
    """Incidents with the newest row of each log and their `most` newest model calls (JN-19): n_calls and calls, newest first by `at`."""
    return dossier(with_newest(incidents, key, logs), key, {"calls": Child(calls, shown, [F.desc(c) for c in at], most)})


def entity_timeline(entities: DataFrame, facts: DataFrame, versions: DataFrame, relations: DataFrame, decisions: DataFrame | None = None, key: str = "entity_id", most: int = 20) -> DataFrame:
    """Entities with their current facts, versions (newest first), relations and, where given, decisions (decision_id, outcome, decided_at; newest first) (JN-15)."""
    children = {
        "facts": Child(facts, ["predicate", "state"], [F.col("predicate")], most),
        "versions": Child(versions, ["fact_version_id", "transaction_from"], [F.desc("transaction_from"), F.desc("fact_version_id")], most),
        "relations": Child(relations, ["target_id"], [F.col("target_id")], most),
    }
    if decisions is not None:
        children["decisions"] = Child(decisions, ["decision_id", "outcome", "decided_at"], [F.desc("decided_at"), F.desc("decision_id")], most)
    return dossier(entities, key, children)


def identity_graph(entities: DataFrame, external_ids: DataFrame, aliases: DataFrame, lineage: DataFrame, candidates: DataFrame | None = None, decisions: DataFrame | None = None, key: str = "entity_id", most: int = 20) -> DataFrame:
    """Entities with external ids, aliases and the lineage rows that name them at either end, each once (JN-17). lineage: from_id, to_id, kind.

    Where given, candidates (candidate_id, score; the best first) and decisions
    (candidate_id, decision, decided_at; the newest first) come as lists too. A
    decision belongs to every entity that its candidate names.
    """
    both = lineage.select(F.col("from_id").alias(key), "from_id", "to_id", "kind").unionByName(lineage.select(F.col("to_id").alias(key), "from_id", "to_id", "kind")).distinct()
    children = {
        "external_ids": Child(external_ids.select(key, "external_id").distinct(), ["external_id"], [F.col("external_id")], most),
        "aliases": Child(aliases.select(key, "alias").distinct(), ["alias"], [F.col("alias")], most),
        "lineage": Child(both, ["from_id", "to_id", "kind"], [F.col("from_id"), F.col("to_id"), F.col("kind")], most),
    }
    if candidates is not None:
        children["candidates"] = Child(candidates, ["candidate_id", "score"], [F.desc("score"), F.col("candidate_id")], most)
    if candidates is not None and decisions is not None:
        of = candidates.select(key, "candidate_id").distinct().join(decisions, "candidate_id")
        children["decisions"] = Child(of, ["candidate_id", "decision", "decided_at"], [F.desc("decided_at"), F.desc("candidate_id")], most)
    return dossier(entities, key, children)


def bundle_view(bundles: DataFrame, artifacts: DataFrame, evidence: DataFrame, key: str = "bundle_id", most: int = 50) -> DataFrame:
    """Evidence bundles with their artifacts and evidence rows (JN-18)."""
    children = {"artifacts": Child(artifacts, ["name", "digest"], [F.col("name"), F.col("digest")], most), "evidence": Child(evidence, ["evidence_ref"], [F.col("evidence_ref")], most)}
    return dossier(bundles, key, children)


def operations(tenants: DataFrame, key: str, alerts: DataFrame, open_alert: Column, logs: dict[str, tuple[DataFrame, list[str], list[str]]]) -> DataFrame:
    """Tenants with their number of open alerts and the newest row of each log, such as backups and costs (GOV-5)."""
    counts = alerts.where(open_alert).groupBy(key).agg(F.count("*").alias("n_open_alerts"))
    out = with_newest(tenants.join(counts, key, "left"), key, logs)
    return out.withColumn("n_open_alerts", F.coalesce("n_open_alerts", F.lit(0)).cast("long"))
