"""Following a log of changes: an append-only folder of JSON lines, read as a stream.

Each line is ``{"seq": n, "statement": text, "params": json text}``.  Changes are applied in the order of
``seq`` over all files, each number once.  What has been applied is kept with the graph
(``GraphSession.applied``, ranges of numbers), not with the stream: a session that follows again goes on
where its graph is, and a new session starts from an empty record and applies the whole log.

A change whose number is below one that has been applied, and that is new, cannot be applied
in order any more: it is refused with an error, as are two different changes of one number.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..errors import ExecutionFailed
from ..session import GraphSession

SCHEMA = "seq bigint, statement string, params string"
#: Changes that are brought to the driver at a time; statements are applied one after another.
AT_A_TIME = 10_000


def _known(session: GraphSession, seq: int) -> bool:
    return any(a <= seq <= b for a, b in session.applied)


def catch_up(session: GraphSession, log: DataFrame) -> None:
    """Apply all changes of the log after the last one that the graph holds, in order."""
    last = None
    while True:
        after = session.applied[-1][1] if session.applied else None
        new = log if after is None else log.where(F.col("seq") > after)
        rows = new.where("seq is not null").orderBy("seq", "statement", "params").limit(AT_A_TIME).collect()
        if not rows:
            return
        for r in rows:
            if last is not None and r.seq == last.seq:
                if (r.statement, r.params) != (last.statement, last.params):
                    raise ExecutionFailed(f"there are two changes with the number {r.seq}")
                continue
            session.cypher(r.statement, **json.loads(r.params or "{}"))
            last = r
            if session.applied and session.applied[-1][1] == r.seq - 1:
                session.applied[-1] = (session.applied[-1][0], r.seq)
            else:
                session.applied.append((r.seq, r.seq))


def follow(session: GraphSession, folder: str, checkpoint: str, files_per_batch: int = 16) -> StreamingQuery:
    """Apply what is in the folder and stop when all of it has been applied (start again to go on)."""
    catch_up(session, session.spark.read.schema(SCHEMA).json(folder))

    def apply(batch: DataFrame, _: int) -> None:
        before = session.applied[-1][1] if session.applied else None
        if before is not None:
            for r in batch.where(F.col("seq") <= before).select("seq").distinct().toLocalIterator():
                if not _known(session, r.seq):
                    raise ExecutionFailed(f"the change {r.seq} comes after the change {before} has been applied")
        catch_up(session, batch)

    stream = session.spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_per_batch).json(folder)
    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def tail(session: GraphSession, folder: str, from_seq: int = 0) -> DataFrame:
    """The changes from a sequence number on."""
    return session.spark.read.schema(SCHEMA).json(folder).where(F.col("seq") >= from_seq).orderBy("seq")
