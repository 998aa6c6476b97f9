"""Champions of a scope: publications in order, each checked against the one in force."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

# Least length of the comment of a promotion.
MIN_COMMENT = 5
OUTCOME = "outcome string, reason string, previous_version string, valid_to timestamp"


def publications(events: DataFrame, scope: list[str]) -> DataFrame:
    """Every event with its outcome: PUBLISHED, UNCHANGED (already in force) or REFUSED with a reason.

    Events have at (timestamp), seq, version, expected (the version the author took to be in force, or null), actor
    (null if not authorised), certified, gate_ready and comment_length, and are taken in the order of (at, seq). What an
    event shows by itself is checked first; the rest are folded in order, where a publication keeps the version before
    it as previous_version and the time of the next one as valid_to. A scope's events run through one task, one at a
    time; nothing is held but the version in force.
    """
    own = (
        F.when(F.col("actor").isNull(), "UNAUTHORISED").when(~F.coalesce("certified", F.lit(False)), "UNCERTIFIED")
        .when(~F.coalesce("gate_ready", F.lit(False)), "GATE_NOT_READY").when(F.coalesce("comment_length", F.lit(0)) < MIN_COMMENT, "COMMENT_TOO_SHORT")
        .when(F.col("version").isNull(), "NO_VERSION")
    )
    judged = events.withColumn("_reason", own)
    refused = judged.filter("_reason is not null").select(
        *events.columns, F.lit("REFUSED").alias("outcome"), F.col("_reason").alias("reason"), F.lit(None).cast("string").alias("previous_version"),
        F.lit(None).cast("timestamp").alias("valid_to"))
    names = events.columns
    at, version, expected = (names.index(c) for c in ("at", "version", "expected"))
    keys = [names.index(c) for c in scope]

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, here, current, open_ = None, None, None, None

        def closed(row: dict | None, until) -> list[dict]:
            return [] if row is None else [{**row, "valid_to": until}]

        for batch in batches:
            schema, done = batch.schema, []
            for row in batch.to_pylist():
                key = tuple(row[names[k]] for k in keys)
                if key != here:
                    done += closed(open_, None)
                    here, current, open_ = key, None, None
                wanted, new = row[names[expected]], row[names[version]]
                base = {"reason": None, "previous_version": current, "valid_to": None}
                if new == current:
                    done.append({**row, **base, "outcome": "UNCHANGED"})
                elif wanted is not None and wanted != current:
                    done.append({**row, **base, "outcome": "REFUSED", "reason": "STALE_PREDECESSOR"})
                else:
                    done += closed(open_, row[names[at]])
                    open_, current = {**row, **base, "outcome": "PUBLISHED"}, new
            yield from rows_of(done, schema)
        if schema is not None:
            yield from rows_of(closed(open_, None), schema)

    def rows_of(done: list[dict], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        more = [("outcome", pa.string()), ("reason", pa.string()), ("previous_version", pa.string()), ("valid_to", schema.field(at).type)]
        if done:
            yield from pa.Table.from_pylist(done, pa.schema([*schema, *[pa.field(*m) for m in more]])).to_batches()

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in events.schema)
    kept = judged.filter("_reason is null").select(*names).repartition(*scope).sortWithinPartitions(*scope, "at", "seq")
    return kept.mapInArrow(fold, f"{kinds}, {OUTCOME}").unionByName(refused)


def in_force(published: DataFrame) -> DataFrame:
    """Publications with their validity: ACTIVE for the last of a scope, RETIRED for the others."""
    rows = published.filter("outcome = 'PUBLISHED'")
    return rows.withColumn("status", F.when(F.col("valid_to").isNull(), "ACTIVE").otherwise("RETIRED"))


def champion_at(rows: DataFrame, published: DataFrame, scope: list[str], at: str) -> DataFrame:
    """Adds the champion in force at a row's time (null if none): the publication whose interval holds it."""
    spans = in_force(published).select(
        *[F.col(c).alias(f"_{c}") for c in scope], F.col("version").alias("champion_version"), F.col("at").alias("_from"), F.col("valid_to").alias("_to"))
    met = (F.col(at) >= F.col("_from")) & (F.col("_to").isNull() | (F.col(at) < F.col("_to")))
    for c in scope:
        met &= F.col(c) == F.col(f"_{c}")
    return rows.join(spans, met, "left").drop("_from", "_to", *[f"_{c}" for c in scope])
