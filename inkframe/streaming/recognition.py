"""Streaming consensus and memory learning; both share their core with the batch operators."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from inkframe.operators.memory import learn
from inkframe.operators.votes import consensus, defer_incomplete


#: Stands for a round in the state of an item that was emitted.
SETTLED = -1


def collect_rounds(votes: DataFrame, rounds: int = 3, delay: str = "10 minutes", wait_ms: int = 600_000) -> DataFrame:
    """Votes (item_id, round, char, confidence, ts) -> one row per item, emitted when its last round arrives or the wait is over.

    State per item is one vote of each round, the largest character as in the batch form: at most
    ``rounds`` entries. A settled item leaves a mark until the watermark has passed it by ``wait_ms``,
    so votes that come again or late open no second row.
    """
    schema = "item_id string, complete boolean, votes array<struct<round:long,char:string,confidence:double>>"
    state = "rounds array<long>, chars array<string>, confs array<double>"

    def step(key: tuple, batches: Iterator[pd.DataFrame], st: GroupState):
        have = {r: (c, f) for r, c, f in zip(*st.get)} if st.exists else {}
        done, newest, settled = False, 0, SETTLED in have
        none = pd.DataFrame({"item_id": [], "complete": [], "votes": []})
        if settled:
            if st.hasTimedOut:
                st.remove()
            else:
                for _ in batches:
                    pass
                st.setTimeoutTimestamp(st.getCurrentWatermarkMs() + wait_ms)
            yield none
            return
        if st.hasTimedOut:
            done = bool(have)
        else:
            for pdf in batches:
                newest = max(newest, int(pdf["ts_ms"].max()) if len(pdf) else 0)
                for r, c, f in zip(pdf["round"], pdf["char"], pdf["confidence"]):
                    vote = (None if pd.isna(c) else c, float(f))
                    have[int(r)] = max(have.get(int(r), vote), vote, key=lambda v: (v[0] is not None, v[0] or "", v[1]))
            done = len(have) >= rounds
        if done:
            st.update(([SETTLED], [None], [0.0]))
            st.setTimeoutTimestamp(max(newest, st.getCurrentWatermarkMs()) + wait_ms)
            rows = [{"round": r, "char": c, "confidence": f} for r, (c, f) in sorted(have.items())]
            yield pd.DataFrame({"item_id": [key[0]], "complete": [len(have) >= rounds], "votes": [rows]})
        elif have:
            st.update(([*have], [v[0] for v in have.values()], [v[1] for v in have.values()]))
            # wait from the newest vote on; the watermark itself starts at zero
            st.setTimeoutTimestamp(max(newest, st.getCurrentWatermarkMs()) + wait_ms)
            yield none

    v = votes.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)
    v = v.withColumn("ts_ms", F.unix_millis("ts"))
    return v.groupBy("item_id").applyInPandasWithState(step, schema, state, "append", GroupStateTimeout.EventTimeTimeout)


def settle(collected: DataFrame) -> DataFrame:
    """Consensus of complete items, deferral of the others; the batch operators on the collected rounds."""
    rows = collected.select("item_id", "complete", F.explode("votes").alias("v")).select("item_id", "complete", "v.*")
    a = consensus(rows.where("complete"), ["item_id"]).select("item_id", "char", "confidence", "note", F.array_join("candidates", ",").alias("candidates"))
    b = defer_incomplete(rows.where("not complete"), ["item_id"]).select("item_id", "char", "confidence", "note", F.array_join("candidates", ",").alias("candidates"))
    return a.unionByName(b)


def stream_consensus(votes: DataFrame, path: str, checkpoint: str, rounds: int = 3, delay: str = "10 minutes"):
    """Write settled items to ``path`` as they complete or time out."""

    def sink(batch: DataFrame, epoch: int) -> None:
        # one folder per epoch: a repeated epoch overwrites itself
        settle(batch).write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    q = collect_rounds(votes, rounds, delay).writeStream.foreachBatch(sink).outputMode("append")
    return q.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_learn(evidence: DataFrame, path: str, checkpoint: str, empty: DataFrame, delay: str = "1 day"):
    """Merge evidence into the memory table at ``path``; repeated evidence keys count once.

    Every epoch writes a new version next to the old one, so a failed or repeated epoch cannot lose
    or double anything. ``empty`` is a memory table without rows (the schema).
    """
    e = evidence.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)
    e = e.dropDuplicatesWithinWatermark(["project_id", "aspect", "sig", "char", "evidence_key"])

    def merge(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        old = empty if epoch == 0 else spark.read.parquet(f"{path}/version={epoch - 1}")
        learn(old, batch.drop("ts")).write.mode("overwrite").parquet(f"{path}/version={epoch}")

    q = e.writeStream.foreachBatch(merge).outputMode("append")
    return q.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
