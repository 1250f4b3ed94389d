"""Subscriptions that change while points stream: each point goes to those whose subscription is open at its time.

Two streams meet: points, and what subscribers ask for (subscribe, with or without a lease, and unsubscribe). Both wait in state until the watermark has passed
them and are then taken in the order of their times, so results do not depend on how the streams were cut into batches. At one instant
unsubscribing comes first, then subscribing, then points: a subscription holds from its time on, up to but not at its end. A lease runs out by itself;
subscribing again prolongs it, never shortens it. A point is delivered once to a subscriber, however many of its topics match.

Points are dealt by a hash of their number into `shards`, so that no topic is one task; each shard knows all open subscriptions, and what subscribers
ask for is sent to each. State in a shard: what waits, as Arrow batches that are sorted by time, and a row for each open subscription. Batches are read in the order of
their first times and taken many rows at a time: requests become stretches of time, and points are looked up in them.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidemark.streaming.streams import instant, zone_free

#: Kinds of rows, in their order at one instant.
UNSUBSCRIBE, SUBSCRIBE, POINT = 0, 1, 2
ROW = "at_us long, kind int, subscriber string, topic string, lease_us long, category string, value double, seq long"
DELIVERED = "subscriber string, topic string, at timestamp, value double, seq long"
SHAPE = pa.schema([("at_us", pa.int64()), ("kind", pa.int32()), ("subscriber", pa.string()), ("topic", pa.string()), ("lease_us", pa.int64()), ("category", pa.string()), ("value", pa.float64()), ("seq", pa.int64())])
#: No lease.
FOREVER = 2**62
#: Before and after all times.
NEVER, ALWAYS = -(2**62), 2**63 - 1
#: Rows are sorted for state, and taken out of it, about so many at a time; batches there have so many; so many may be delivered at a time.
AT_ONCE, BATCH, OUT_AT_ONCE = 500_000, 50_000, 1_000_000


@contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """Streams that start in here keep their state in RocksDB, as this kind of state has to be."""
    key, kind = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    before = spark.conf.get(key, None)
    spark.conf.set(key, kind)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def _packed(rows: pa.Table) -> bytes:
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, rows.schema, options=pa.ipc.IpcWriteOptions(compression="lz4")) as f:
        f.write_table(rows)
    return out.getvalue().to_pybytes()


def stretches(asked: pd.DataFrame, until: dict[tuple[str, str], int]) -> pd.DataFrame:
    """(subscriber, topic, since, end, to): from `since` up to `to` the subscription is open; it ends at `end` if nothing else is asked for. By subscription and time.

    `asked` (at_us, kind, subscriber, topic, lease_us) holds requests, `until` the ends of subscriptions that are open before.
    """
    before = pd.DataFrame([(*k, v) for k, v in until.items()], columns=["subscriber", "topic", "end"]).astype({"end": "int64"}).assign(at_us=NEVER, kind=SUBSCRIBE)
    subscribes = (asked["kind"] == SUBSCRIBE).to_numpy()
    at, lease = asked["at_us"].to_numpy(), asked["lease_us"].to_numpy()
    now = asked[["subscriber", "topic", "at_us", "kind"]].assign(end=np.where(subscribes, np.minimum(FOREVER, at + lease), NEVER))
    rows = pd.concat([before, now], ignore_index=True) if len(before) else now.reset_index(drop=True)
    own = rows.groupby(["subscriber", "topic"], sort=False).ngroup().to_numpy()
    order = np.lexsort((rows["kind"], rows["at_us"], own))
    rows, own = rows.iloc[order].reset_index(drop=True), own[order]
    last = np.append(own[1:] != own[:-1], True)[: len(own)]
    begins = np.insert(last[:-1], 0, True)[: len(own)] | (rows["kind"] == UNSUBSCRIBE).to_numpy()  # what was asked for earlier no longer counts
    end = rows["end"].groupby(np.cumsum(begins)).cummax().to_numpy()
    following = np.where(last, ALWAYS, np.append(rows["at_us"].to_numpy()[1:], ALWAYS)[: len(own)])
    return pd.DataFrame({"subscriber": rows["subscriber"], "topic": rows["topic"], "since": rows["at_us"], "end": end, "to": np.minimum(end, following), "last": last})


def matched(points: pd.DataFrame, open_: pd.DataFrame) -> pd.DataFrame:
    """(subscriber, topic, at, value, seq): each of the points (at_us, topic, category, value, seq), in order of time, once for each subscriber with a stretch that is open for it."""
    who, names = pd.factorize(open_["subscriber"])
    since, to, at = open_["since"].to_numpy(), open_["to"].to_numpy(), points["at_us"].to_numpy()
    of = {**points.groupby("topic").indices, **points.groupby("category").indices, **dict.fromkeys(("metrics.*", "category.*"), np.arange(len(points)))}
    found = [np.zeros(0, np.int64)]
    for topic, k in open_.groupby("topic").indices.items():
        if topic in of:
            there = of[topic]
            first, n = (np.searchsorted(at[there], x[k]) for x in (since, to))
            n -= first
            place = np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())
            found.append(there[place] * len(names) + np.repeat(who[k], n))
    each, to_whom = np.divmod(np.unique(np.concatenate(found)), max(1, len(names)))
    rows = points.iloc[each]
    return pd.DataFrame({"subscriber": np.asarray(names, object)[to_whom], "topic": rows["topic"].to_numpy(), "at": rows["at_us"].to_numpy().astype("datetime64[us]"), "value": rows["value"].to_numpy(float), "seq": rows["seq"].to_numpy("int64")})


class Deliveries(StatefulProcessor):
    """What waits in one shard, and the subscriptions that are open there."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "first_us long, number long", "rows binary")
        self.until = handle.getMapState("until", "subscriber string, topic string", "until_us long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        names = [x.split()[0] for x in ROW.split(", ")]
        numbers, held = self._numbers(), []
        for frame in rows:
            held.append(pa.Table.from_pandas(frame[names], SHAPE, preserve_index=False))
            if sum(x.num_rows for x in held) >= AT_ONCE:
                self._keep(held, numbers)
                held = []
        if held:
            self._keep(held, numbers)
        yield from self._due(timerValues.getCurrentWatermarkInMs(), numbers)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        yield from self._due(timerValues.getCurrentWatermarkInMs(), self._numbers())

    def _numbers(self) -> dict[int, int]:
        """How many batches wait by their first times."""
        found: dict[int, int] = {}
        for first, _ in self.waiting.keys():
            found[first] = found.get(first, 0) + 1
        return found

    def _keep(self, rows: list[pa.Table], numbers: dict[int, int]) -> None:
        sorted_ = pa.concat_tables(rows).sort_by("at_us").combine_chunks()
        for a in range(0, sorted_.num_rows, BATCH):
            first = sorted_["at_us"][a].as_py()
            self.waiting.updateValue((first, numbers.get(first, 0)), (_packed(sorted_.slice(a, BATCH)),))
            numbers[first] = numbers.get(first, 0) + 1

    def _due(self, watermark_ms: int, numbers: dict[int, int]) -> Iterator[pd.DataFrame]:
        """Take what waits up to the watermark, in order; a timer is set for the first of the rest."""
        due = watermark_ms * 1000
        ready = sorted(x for x in numbers if x < due)
        before = {tuple(k): v[0] for k, v in self.until.iterator()} if ready else {}
        open_, held = dict(before), SHAPE.empty_table()
        for first, end in zip(ready, [*ready[1:], due], strict=False):
            keys = [(first, k) for k in range(numbers.pop(first))]
            held = pa.concat_tables([held, *(pa.ipc.open_stream(self.waiting.getValue(k)[0]).read_all() for k in keys)])
            for k in keys:
                self.waiting.removeKey(k)
            if held.num_rows >= AT_ONCE or end == due:  # nothing that is still to be read comes before `end`
                now = pc.less(held["at_us"], end)
                yield from self._taken(held.filter(now).to_pandas(), open_)
                held = held.filter(pc.invert(now)).combine_chunks()
        if held.num_rows:
            self._keep([held], numbers)
        for k in before.keys() - open_.keys():
            self.until.removeKey(k)
        for k, end in open_.items():
            if before.get(k) != end:
                self.until.updateValue(k, (end,))
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        if numbers:
            self.handle.registerTimer(min(numbers) // 1000 + 1)

    def _taken(self, rows: pd.DataFrame, open_: dict[tuple[str, str], int]) -> Iterator[pd.DataFrame]:
        """What rows deliver; `open_`, the ends of open subscriptions, is brought up to their last instant."""
        if not len(rows):
            return
        is_point = (rows["kind"] == POINT).to_numpy()
        found = stretches(rows[~is_point], open_)
        last = int(rows["at_us"].max())
        ends = found[found["last"] & (found["end"] > last)]  # leases that have run out are left out
        open_.clear()
        open_.update(zip(zip(ends["subscriber"], ends["topic"], strict=True), ends["end"].tolist(), strict=True))
        found = found[found["since"] < found["to"]]
        points = rows[is_point].sort_values("at_us", kind="stable")
        if len(points) and len(found):
            subscriptions = found.groupby(["subscriber", "topic"]).ngroups  # a point is delivered at most so often
            each = max(1, OUT_AT_ONCE // subscriptions)
            for a in range(0, len(points), each):
                made = matched(points.iloc[a : a + each], found)
                if len(made):
                    yield made

    def close(self) -> None:
        pass


def deliveries(points: DataFrame, asked: DataFrame, metrics: DataFrame, shards: int = 64, delay: str = "1 hour") -> DataFrame:
    """(subscriber, topic, ts, value, seq), a stream: each point once for each subscriber with an open subscription to its metric, its category or all of a kind.

    `points` (metric, ts, value, seq) and `asked` (subscriber, topic, ts, action, lease) are streams; action is subscribe or unsubscribe, lease an interval of
    day to second or null. Rows later than the watermark (`delay` behind the newest of either stream) are dropped. `metrics` is a table; metrics without a
    category are custom. Points without metric, value or number and requests without subscriber or topic are left out. Start the stream inside `rocksdb`.
    """
    categories = metrics.select(F.col("name").alias("metric"), "category")
    named = points.where("metric is not null and value is not null and seq is not null").join(categories, "metric", "left").select(
        instant().alias("at"), F.lit(POINT).alias("kind"), F.lit("").alias("subscriber"), F.concat(F.lit("metrics."), "metric").alias("topic"),
        F.lit(0).cast("long").alias("lease_us"), F.concat(F.lit("category."), F.coalesce("category", F.lit("custom"))).alias("category"), "value", "seq",
        F.pmod(F.xxhash64("seq"), F.lit(shards)).cast("int").alias("shard"),
    )
    action = F.when(F.col("action") == "subscribe", SUBSCRIBE).when(F.col("action") == "unsubscribe", UNSUBSCRIBE)
    lease = (F.extract(F.lit("DAY"), "lease") * 86_400 + F.extract(F.lit("HOUR"), "lease") * 3600 + F.extract(F.lit("MINUTE"), "lease") * 60 + F.extract(F.lit("SECOND"), "lease")) * 1_000_000
    control = asked.where(action.isNotNull() & F.col("subscriber").isNotNull() & F.col("topic").isNotNull()).select(
        instant().alias("at"), action.alias("kind"), "subscriber", "topic", F.coalesce(lease.cast("long"), F.lit(FOREVER)).alias("lease_us"), F.lit("").alias("category"),
        F.lit(0.0).alias("value"), F.lit(-1).cast("long").alias("seq"), F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"),
    )
    both = named.withWatermark("at", delay).unionByName(control.withWatermark("at", delay)).withColumn("at_us", F.unix_micros("at"))
    found = both.groupBy("shard").transformWithStateInPandas(Deliveries(), DELIVERED, "Append", "EventTime")
    return found.select("subscriber", "topic", zone_free(F.col("at")).alias("ts"), "value", "seq")
