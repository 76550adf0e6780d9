"""From nested source rows to admitted observations: readers, flattening, endpoint match, admission, authority."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Nested shape of a product row as collectors write it.
PRODUCT_SCHEMA = (
    "source_url string, captured_at timestamp, product struct<id:string,title:string,availability:string,"
    "purchase_price:struct<amount:double,currency:string,label:string,raw_text:string,nearby_text:string>,monthly_payment:struct<amount:double>>,"
    "independent_sources struct<jsonld_price:double,public_api_price:double>"
)
#: Nested shape of a source observation.
OBSERVATION_SCHEMA = "observation_id string, source_id string, source_type string, url string, observed_at timestamp, records array<struct<kind:string,key:string,name:string,amount:double>>"

# The kind of record that a mapping of a source type takes; the other types take notices.
RECORD_KINDS = {"pricing": "pricing", "catalog": "model"}


def read_nested(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON rows under a declared nested schema (SRC-2); a row that is no JSON object gives `_corrupt` with its text and nulls."""
    return spark.read.schema(f"{schema}, _corrupt string").option("columnNameOfCorruptRecord", "_corrupt").json(path)


def parse_nested(rows: DataFrame, column: str, schema: str) -> DataFrame:
    """The fields of a JSON text column under a declared schema (SRC-2), beside the other columns."""
    return rows.withColumn("__parsed", F.from_json(column, schema)).select(*[c for c in rows.columns if c != column], "__parsed.*")


def normalize_products(products: DataFrame) -> DataFrame:
    """Product rows of PRODUCT_SCHEMA as 13 flat columns (SRC-3). Missing parts are null."""
    price = "product.purchase_price"
    paths = {
        "entity_id": "product.id", "title": "product.title", "observed_purchase_price": f"{price}.amount", "monthly_payment": "product.monthly_payment.amount", "currency": f"{price}.currency",
        "availability": "product.availability", "purchase_context": f"{price}.nearby_text", "purchase_label": f"{price}.label", "raw_purchase_text": f"{price}.raw_text",
        "jsonld_price": "independent_sources.jsonld_price", "public_api_price": "independent_sources.public_api_price", "source_url": "source_url", "captured_at": "captured_at",
    }
    return products.select(*[F.col(path).alias(name) for name, path in paths.items()])


def flatten_records(observations: DataFrame) -> DataFrame:
    """One row for each record whose kind fits its observation's source_type (PF-1), with its place `pos` in the list."""
    wanted = F.lit("notice")
    for source_type, kind in RECORD_KINDS.items():
        wanted = F.when(F.col("source_type") == source_type, kind).otherwise(wanted)
    rest = [c for c in observations.columns if c != "records"]
    return observations.select(*rest, F.posexplode("records").alias("pos", "record")).where(F.col("record.kind") == wanted)


def source_value(path: str, record: str = "record") -> Column:
    """The value at a path of the record, or of the observation where it begins with $observation (FN-13)."""
    if path.startswith("$observation."):
        return F.col(path.removeprefix("$observation."))
    return F.col(f"{record}.{path}")


def matches_endpoint(url: Column, host: Column, prefix: Column) -> Column:
    """Whether a URL is https without user info, on the host (in any case), at the path or below it (PF-3). Null counts as no match."""
    part = lambda name: F.try_parse_url(url, F.lit(name))
    path = F.coalesce(F.nullif(part("PATH"), F.lit("")), F.lit("/"))
    base = F.when((F.length(prefix) > 1) & prefix.endswith("/"), F.substring(prefix, F.lit(1), F.length(prefix) - 1)).otherwise(prefix)
    fine = (F.lower(part("PROTOCOL")) == "https") & part("USERINFO").isNull() & (F.lower(part("HOST")) == F.lower(host))
    return F.coalesce(fine & ((path == base) | path.startswith(F.concat(base, F.lit("/")))), F.lit(False))


def admit(fields: DataFrame, mappings: DataFrame, sources: DataFrame, transforms: list[str], most_paths: int = 20, most_refs: int = 20) -> DataFrame:
    """Admission of canonical fields (DQ-12).

    fields: source_id, mapping_id, canonical_path, transform, source_paths and
    evidence_refs (arrays), trust; mappings: mapping_id, mapping_state,
    schema_state, targets (array); sources: source_id (registered ones). Adds
    violations (array, in this order) and admitted. Nulls violate their rule.
    """
    known = sources.select("source_id", F.lit(True).alias("__known")).distinct()
    out = fields.join(mappings, "mapping_id", "left").join(known, "source_id", "left")
    yes = lambda c: F.coalesce(c, F.lit(False))
    rules = {
        "unknown_context": F.col("__known") & F.col("targets").isNotNull(),
        "inactive_mapping": (F.col("mapping_state") == "active") & (F.col("schema_state") == "active"),
        "unverified_source": F.col("trust") == "verified",
        "undefined_target": F.array_contains("targets", F.col("canonical_path")),
        "transform_not_allowed": F.col("transform").isin(*transforms),
        "source_paths": F.size("source_paths").between(1, most_paths),
        "evidence_refs": F.size("evidence_refs").between(0, most_refs),
    }
    violations = F.array_compact(F.array(*[F.when(~yes(rule), F.lit(name)) for name, rule in rules.items()]))
    return out.select(*fields.columns, violations.alias("violations")).withColumn("admitted", F.size("violations") == 0)


def gate_authority(candidates: DataFrame, policy_sources: DataFrame, authorities: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Candidates with authority, quarantined ones and rejected ones (JN-2).

    A candidate (source_id, predicate, trust_state, field_state) needs a source
    in the policy and an active authority for its predicate that is not
    forbidden, else it is rejected; one of these that is not verified, or whose
    field is not, is quarantined.
    """
    allowed = authorities.where(F.col("active") & (F.col("authority") != "forbidden")).select("source_id", "predicate").distinct()
    members = policy_sources.select("source_id").distinct().withColumn("__member", F.lit(True))
    # One pass over the candidates: both sides are distinct, so rows are neither lost nor doubled.
    marked = candidates.join(allowed.withColumn("__allowed", F.lit(True)), ["source_id", "predicate"], "left").join(members, "source_id", "left")
    granted = F.col("__allowed").isNotNull() & F.col("__member").isNotNull()
    verified = F.coalesce((F.col("trust_state") == "verified") & (F.col("field_state") == "verified"), F.lit(False))
    pick = lambda condition: marked.where(condition).select(*candidates.columns)
    return pick(granted & verified), pick(granted & ~verified), pick(~granted)


def append_new(existing: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """Incoming rows whose key neither exists yet nor stands twice among them (CDC-7, SRC-6); of rows that share a key any one stays. Null keys are left out."""
    return incoming.where(F.col(key).isNotNull()).dropDuplicates([key]).join(existing.select(key), key, "left_anti")


def append_to(rows: DataFrame, path: str, key: str, partition: str | None = None) -> int:
    """Append rows with new keys to an append-only parquet table (SRC-6); returns how many. Written rows are never changed."""
    spark = rows.sparkSession
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)
    fresh = append_new(spark.read.parquet(path) if there else rows.limit(0), rows, key)
    n = fresh.count()
    if n:
        writer = fresh.write.mode("append")
        (writer.partitionBy(partition) if partition else writer).parquet(path)
    return n
