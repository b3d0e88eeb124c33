"""The action queue as keyed state of a stream: suggestions and changes of status come in, what becomes of actions goes out.

Events are rows (kind, at, id, type, targets, description, confidence, status, note) of three kinds: ``generation`` says that
at ``at`` a whole set of suggestions was made, ``suggestion`` is one of them, and ``status`` sets an action's status. Actions are kept
in buckets by their id; a generation goes to every bucket, so that each finds out which of its actions are no longer
suggested. State is the stream's own: it is restored from the checkpoint, and nothing else is read to go on.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from notelake.operators import graph
from notelake.plans.store import Store

EVENTS = "kind string, at string, id string, type string, targets array<string>, description string, confidence double, status string, note string"
_HISTORY = "array<struct<at:string,from:string,to:string,note:string>>"
QUEUE = f"id string, type string, targets array<string>, description string, confidence double, status string, stale boolean, archived_reason string, updated_at string, created_at string, closed_at string, history {_HISTORY}, priority string"
_SAID = ("type", "targets", "description", "confidence")
#: Session settings without which a stream has no keyed state of this kind.
PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def suggested(old: dict | None, now: dict, at: str) -> dict:
    """An action that is suggested: as it was, with what is said now."""
    if old is None:
        return {**now, "status": "proposed", "stale": False, "archived_reason": None, "updated_at": at, "created_at": at, "closed_at": None, "history": []}
    changed = any(old[c] != now[c] for c in _SAID)
    status = old["status"] if old["status"] in graph.STATUSES else "proposed"
    return {**old, **now, "status": status, "stale": False, "updated_at": at if changed else old["updated_at"]}


def not_suggested(old: dict, at: str) -> dict:
    """An action that is no longer suggested: a proposed one is archived, an open one stale, a closed one as it was."""
    if old["status"] == "proposed":
        return {**old, "status": "archived", "stale": True, "archived_reason": "suggestion_not_current", "updated_at": at}
    return {**old, "stale": True} if old["status"] in graph.STATUSES[:3] else old


def changed_status(old: dict, status: str, at: str, note: str) -> dict:
    reason = old["archived_reason"] or note or "manual_update" if status == "archived" else old["archived_reason"]
    entry = {"at": at, "from": old["status"], "to": status, "note": note}
    return {**old, "status": status, "updated_at": at, "closed_at": at if status in graph.STATUSES[3:] else None, "archived_reason": reason, "history": [*old["history"], entry]}


class Bucket(StatefulProcessor):
    """The actions of one bucket by id, each as JSON."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.actions = handle.getMapState("actions", "id string", "action string")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        events = pd.concat(list(rows))  # those of one bucket in one micro-batch
        known = {k[0]: json.loads(v[0]) for k, v in self.actions.iterator()}
        before = dict(known)
        for at, part in events.sort_values("at", kind="stable").groupby("at", sort=True):
            if (part["kind"] == "generation").any():
                now = {r["id"]: {"targets": list(r["targets"] if r["targets"] is not None else []), **{c: r[c] for c in ("type", "description")}, "confidence": None if pd.isna(r["confidence"]) else float(r["confidence"])} for r in part[part["kind"] == "suggestion"].to_dict("records")}
                for i in set(known) | set(now):
                    known[i] = suggested(known.get(i), now[i], at) if i in now else not_suggested(known[i], at)
            for r in part[part["kind"] == "status"].to_dict("records"):
                if r["id"] in known and r["status"] in graph.STATUSES:
                    known[r["id"]] = changed_status(known[r["id"]], r["status"], at, (r["note"] or "").strip())
        out = []
        for i, action in known.items():
            if before.get(i) != action:
                self.actions.updateValue((i,), (json.dumps(action),))
                out.append({"id": i, "action": json.dumps(action)})
        yield pd.DataFrame(out, columns=["id", "action"])

    def close(self) -> None:
        pass


def queue_changes(events: DataFrame, buckets: int = 64) -> DataFrame:
    """The actions that a micro-batch of ``events`` changed, as rows of the queue."""
    own = F.pmod(F.xxhash64("id"), F.lit(buckets)).cast("int")
    every = F.sequence(F.lit(0), F.lit(buckets - 1))
    dealt = events.withColumn("bucket", F.explode(F.when(F.col("kind") == "generation", every).otherwise(F.array(own))))
    changed = dealt.groupBy("bucket").transformWithStateInPandas(Bucket(), "id string, action string", "Update", "None")
    kinds = ", ".join(x for x in QUEUE.split(", ") if not x.startswith(("id ", "priority ")))
    rows = changed.select("id", F.from_json("action", kinds).alias("a")).select("id", "a.*")
    return rows.withColumn("priority", graph.priority(F.col("confidence"))).select(*[c.split()[0] for c in QUEUE.split(", ")])


def follow_queue(events: DataFrame, store: Store, checkpoint: str, name: str = "queue", buckets: int = 64) -> None:
    """Keeps the table ``name`` of ``store`` up to a stream of ``events`` until its input is used up."""
    events.sparkSession.conf.set(*PROVIDER)

    def write(batch: DataFrame, number: int) -> None:  # a batch that is repeated writes the same rows again
        store.append(name, batch)

    query = queue_changes(events, buckets).writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
