"""The public relations of an index as temporary views, resolved late: links between sources are joined when they are read."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from runledger.operators import links
from runledger.sources import dialect, metadata, store

#: Relations in the order of their declaration, with columns as (name, type, nullable).
PUBLIC = {
    "sources": [("source_id", "INTEGER", False), ("locator", "TEXT", False), ("runtime", "TEXT", False)],
    "records": [("record_id", "INTEGER", False), ("source_id", "INTEGER", False), ("source_position", "INTEGER", False), ("content_range", "TEXT", False), ("fingerprint", "TEXT", False), ("occurred_at", "INTEGER", True)],
    "sessions": [("session_id", "INTEGER", False), ("runtime", "TEXT", False), ("native_id", "TEXT", False), ("identity_record_id", "INTEGER", False), ("created_at", "INTEGER", True), ("name", "TEXT", True), ("working_directory", "TEXT", True), ("source_ids", "TEXT", False), ("forked_from", "TEXT", True), ("delegated_from", "TEXT", True)],
    "loops": [("loop_id", "INTEGER", False), ("session_id", "INTEGER", False), ("session_position", "INTEGER", False), ("native_id", "TEXT", True), ("start_record_id", "INTEGER", False), ("end", "TEXT", True), ("model", "TEXT", True), ("usage", "TEXT", True)],
    "items": [("item_id", "INTEGER", False), ("session_id", "INTEGER", False), ("loop_id", "INTEGER", True), ("loop_position", "INTEGER", True), ("occurred_at", "INTEGER", True), ("record_ids", "TEXT", False), ("semantic", "TEXT", False)],
    "blobs": [("blob_id", "INTEGER", False), ("text", "TEXT", False), ("full_bytes", "INTEGER", False), ("estimated_tokens", "INTEGER", False)],
    "item_search": [("gram", "TEXT", False), ("item_id", "INTEGER", False)],
    "item_search_terms": [("term", "TEXT", False), ("item_id", "INTEGER", False), ("item_terms", "INTEGER", False), ("positions", "ARRAY", False)],
    "session_metadata": [("session_id", "INTEGER", True), ("runtime", "TEXT", False), ("native_id", "TEXT", False), ("metadata", "TEXT", False), ("version", "INTEGER", False), ("updated_at", "INTEGER", False)],
}
_PLACE = 1 << 32


def _id(place: str) -> F.Column:
    return F.col("source_id") * _PLACE + F.col(place)


def _session_id(runtime: str = "runtime", native: str = "native_id") -> F.Column:
    return F.shiftrightunsigned(F.xxhash64(runtime, native), 1)


def _sessions(facts: DataFrame, sources: DataFrame) -> DataFrame:
    """One row for each runtime and native id; facts come from the lowest source that has them."""
    keyed = facts.withColumn("session_id", _session_id())
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("source_id"))).alias(c)
    merged = keyed.groupBy("session_id", "runtime", "native_id").agg(
        F.min_by(_id("identity"), "source_id").alias("identity_record_id"), F.min("created_at").alias("created_at"), first("name"), first("working_directory"),
        F.to_json(F.sort_array(F.collect_set("source_id"))).alias("source_ids"),
    )
    candidates = keyed.select("session_id", "runtime", "source_id", F.explode("parents").alias("p")).select(
        "session_id", "runtime", "source_id", F.col("p.kind").alias("kind"), F.col("p.native_id").alias("parent_native_id"), F.col("p.locator").alias("parent_locator"), (F.col("source_id") * _PLACE + F.col("p.record")).alias("record_id")
    )
    located = sources.join(keyed.select("source_id", "session_id"), "source_id").select("locator", "session_id")
    parents = links.resolve_parents(candidates, merged, located)
    body = F.to_json(F.struct(F.col("parent_session_id").alias("session_id"), "record_id"))
    wide = parents.groupBy("session_id").agg(F.max(F.when(F.col("kind") == "forked_from", body)).alias("forked_from"), F.max(F.when(F.col("kind") == "delegated_from", body)).alias("delegated_from"))
    return merged.join(wide, "session_id", "left")


def register(spark: SparkSession, index: str, metadata_path: str | None = None) -> store.Manifest:
    """Creates the public views over the newest snapshot and returns its manifest; later syncs don't change them."""
    manifest = store.load(index)
    part = {name: store.relation(spark, index, name, manifest) for name in store.SCHEMAS}
    sources = spark.createDataFrame([(c["source_id"], at, c["runtime"]) for at, c in manifest.sources.items()], "source_id long, locator string, runtime string")
    sessions = _sessions(part["sessions"], sources)
    own = part["sessions"].select("source_id", _session_id().alias("session_id"), F.col("created_at").alias("source_created_at"), "runtime")
    loops = part["loops"].drop("generation").join(F.broadcast(own), "source_id")
    spine = Window.partitionBy("session_id").orderBy(F.coalesce("started_at", "source_created_at").asc_nulls_last(), "source_id", "ordinal")
    end = F.when(F.col("end").isNotNull(), F.to_json(F.struct((F.col("source_id") * _PLACE + F.col("end")).alias("record_id"), "outcome")))
    loops = loops.select(_id("ordinal").alias("loop_id"), "session_id", (F.row_number().over(spine) - 1).alias("session_position"), "native_id", _id("start").alias("start_record_id"), end.alias("end"), "model", "usage")

    blob_id = lambda c: F.shiftrightunsigned(F.conv(F.substring(c, 1, 16), 16, -10).cast("long"), 1)
    blobs = part["blobs"].groupBy("blob_hash").agg(F.min_by(F.struct("text", "full_bytes", "estimated_tokens"), "source_id").alias("b")).select(blob_id("blob_hash").alias("blob_id"), "b.*")
    known = sessions.select(F.col("session_id").alias("_child"), "runtime", F.col("native_id").alias("child_native_id"))
    items = part["items"].join(F.broadcast(own), "source_id").join(known, ["runtime", "child_native_id"], "left")
    reference = F.regexp_replace("value", F.lit(r'\{"blob_hash": ?"[0-9a-f]+"\}'), F.concat(F.lit('{"blob_id":'), blob_id("blob_hash").cast("string"), F.lit("}")))
    value = F.when(F.col("blob_hash").isNotNull(), reference).otherwise(F.col("value"))
    extra = F.concat(
        F.when(F.col("call_ordinal").isNotNull(), F.concat(F.lit('"call_item_id":'), _id("call_ordinal").cast("string"), F.lit(","))).otherwise(""),
        F.when(F.col("_child").isNotNull(), F.concat(F.lit('"'), F.col("child_kind"), F.lit('":'), F.col("_child").cast("string"), F.lit(","))).otherwise(""),
    )
    merged = F.when(extra == "", value).when(value == "{}", F.concat(F.lit("{"), F.regexp_replace(extra, ",$", ""), F.lit("}"))).otherwise(F.concat(F.lit("{"), extra, F.substring(value, F.lit(2), F.length(value))))
    semantic = F.concat(F.lit('{"role":"'), F.col("role"), F.lit('","value":'), merged, F.lit(',"evidence_strength":"'), F.col("evidence_strength"), F.lit('"}'))
    full = items.select(
        _id("ordinal").alias("item_id"), "session_id", _id("loop").alias("loop_id"), "loop_position", "occurred_at",
        F.to_json(F.transform("records", lambda r: F.col("source_id") * _PLACE + r)).alias("record_ids"), semantic.alias("semantic"), "role", "tool_name", "searchable", blob_id("blob_hash").alias("blob_id"), "runtime",
    )
    postings = {name: store.relation(spark, index, name, manifest) for name in store.POSTINGS}
    views = {
        "sources": sources,
        "records": part["records"].select(_id("source_position").alias("record_id"), "source_id", "source_position", F.to_json(F.struct("start", "end")).alias("content_range"), "fingerprint", "occurred_at"),
        "sessions": sessions.select(*[c for c, _, _ in PUBLIC["sessions"]]),
        "loops": loops,
        "items": full.select(*[c for c, _, _ in PUBLIC["items"]]),
        "blobs": blobs,
        "item_search": postings["item_grams"].select(*[c for c, _, _ in PUBLIC["item_search"]]),
        "item_search_terms": postings["item_terms"].select(*[c for c, _, _ in PUBLIC["item_search_terms"]]),
        "item_term_counts": postings["item_term_counts"].select("item_id", "item_terms"),
        "session_metadata": links.with_metadata(sessions, metadata.table(spark, metadata_path)).select(*[c for c, _, _ in PUBLIC["session_metadata"]]),
        "item_facts": full.drop("semantic", "record_ids"),
    }
    for name, df in views.items():
        df.createOrReplaceTempView(name)
    dialect.register(spark)
    return manifest


def status(spark: SparkSession, index: str) -> dict:
    """Totals, sources whose end isn't complete, and the roles that were observed by runtime. Needs registered views."""
    manifest = store.load(index)
    totals = {name: spark.table(name).count() for name in ("records", "sessions", "loops", "items")}
    roles = spark.sql("SELECT role, count(*) AS items, array_join(sort_array(collect_set(runtime)), ',') AS runtimes FROM item_facts GROUP BY role ORDER BY role").collect()
    return {"sources": len(manifest.sources), "incomplete": sum(not c["complete"] for c in manifest.sources.values()), **totals, "roles": [r.asDict() for r in roles], "bytes": sum(os.path.getsize(p) for p in manifest.sources if os.path.exists(p))}
