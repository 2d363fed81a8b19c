"""Problem 4: runs of identical or near-identical consecutive events.

Events are range-sorted by (service, source, offset), so the chunks (ranges)
are of equal size whatever one source holds.  Each chunk encodes its runs
locally; runs inside a chunk are final.  Only the first and the last run of a
chunk may go on in a neighbour: these, at most two rows per chunk, are merged
by a prefix pass over their summaries (first event, last event, count, extent),
which is associative.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logweave.functions.instants import parse_instants
from logweave.operators.combine import combine_batches
from logweave.operators.instants import clean_name, service_zones

#: Share of word positions in which two templates must agree to be near-identical.
AGREE = 0.8
#: Events a run has at least.
MIN_EVENTS = 3

_NONE = np.iinfo(np.int64).max


def near(a: list[str] | None, b: list[str] | None, agree: float = AGREE) -> bool:
    """Whether two word lists have the same length and agree in enough positions; null and empty ones never do."""
    return bool(a and b and len(a) == len(b) and sum(x == y for x, y in zip(a, b)) >= agree * len(a) - 1e-9)


def _words(text) -> list[str] | None:
    return text.lower().split() if isinstance(text, str) else None


_EDGE = T.StructType(
    [T.StructField(c, T.StringType()) for c in ("service", "source", "first_event_id", "last_event_id", "first_template", "first_text", "last_template", "last_text")]
    + [T.StructField(c, T.LongType()) for c in ("n_events", "first_us", "last_us", "part", "seq")]
    + [T.StructField("edge", T.BooleanType())]
)


def _encode(agree: float, min_events: int):
    """Runs of one sorted chunk; those that may go on in another chunk are marked ``edge``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part = TaskContext.get().partitionId()
        words: dict[str, list[str] | None] = {}
        last: dict | None = None  # the event before
        held: dict | None = None  # the run that is still open
        seq = 0
        for pdf in batches:
            us, ok = parse_instants(pdf["ts"], pdf["zone"], pdf["order"], parse_instants(pdf["observed"], pdf["zone"], pdf["order"]))
            lo, hi = np.where(ok, us, _NONE), np.where(ok, us, -_NONE)
            ids = pdf["event_id"].to_numpy(object)
            group = np.empty(len(pdf), dtype=object)
            group[:] = list(zip(pdf["service"], pdf["source"]))
            again = np.zeros(len(pdf), dtype=bool)
            again[1:] = (ids[1:] == ids[:-1]) & (group[1:] == group[:-1])
            if last is not None and len(pdf):
                again[0] = ids[0] == last["id"] and group[0] == last["group"]
            keep = np.flatnonzero(~again)
            if not len(keep):
                continue
            ids, group, lo, hi = ids[keep], group[keep], lo[keep], hi[keep]
            tpl, text = pdf["template_id"].to_numpy(object)[keep], pdf["text"].to_numpy(object)[keep]
            n = len(keep)
            link = np.zeros(n, dtype=bool)
            same_group = np.zeros(n, dtype=bool)
            same_group[1:] = group[1:] == group[:-1]
            link[1:] = same_group[1:] & (tpl[1:] == tpl[:-1])
            if len(words) > 200_000:
                words.clear()

            def split(t):
                if t not in words:
                    words[t] = _words(t)
                return words[t]

            for i in np.flatnonzero(same_group & ~link):
                link[i] = near(split(text[i - 1]), split(text[i]), agree)
            if last is not None:
                link[0] = last["group"] == group[0] and (last["tpl"] == tpl[0] or near(_words(last["text"]), _words(text[0]), agree))
            starts = np.flatnonzero(~link)
            cuts = np.unique(np.concatenate(([0], starts)))
            ends = np.append(cuts[1:], n) - 1
            first, final = np.minimum.reduceat(lo, cuts), np.maximum.reduceat(hi, cuts)
            rows = []
            for k, (a, z) in enumerate(zip(cuts.tolist(), ends.tolist())):
                if k == 0 and link[0] and held is not None:
                    held.update(z_id=ids[z], z_tpl=tpl[z], z_text=text[z], n=held["n"] + z - a + 1, lo=min(held["lo"], first[0]), hi=max(held["hi"], final[0]))
                    continue
                if held is not None:
                    if held["seq"] == 0 or held["n"] >= min_events:
                        rows.append(held)
                    seq += 1
                held = dict(group=group[a], a_id=ids[a], a_tpl=tpl[a], a_text=text[a], z_id=ids[z], z_tpl=tpl[z], z_text=text[z], n=z - a + 1, lo=first[k], hi=final[k], seq=seq)
            last = dict(id=ids[-1], group=group[-1], tpl=tpl[-1], text=text[-1])
            if rows:
                yield frame(rows, False, part)
        if held is not None:
            yield frame([held], True, part)

    def frame(rows: list[dict], tail: bool, part: int) -> pd.DataFrame:
        who = [r["group"] for r in rows]
        none = [r["lo"] == _NONE for r in rows]
        us = lambda k: pd.Series(pd.array([pd.NA if x else int(r[k]) for r, x in zip(rows, none)], dtype="Int64"))
        edge = [tail or r["seq"] == 0 for r in rows]
        pick = lambda k: [r[k] if e else None for r, e in zip(rows, edge)]
        return pd.DataFrame({
            "service": [w[0] for w in who], "source": [w[1] for w in who], "first_event_id": [r["a_id"] for r in rows], "last_event_id": [r["z_id"] for r in rows],
            "first_template": pick("a_tpl"), "first_text": pick("a_text"), "last_template": pick("z_tpl"), "last_text": pick("z_text"),
            "n_events": [r["n"] for r in rows], "first_us": us("lo"), "last_us": us("hi"), "part": part, "seq": [r["seq"] for r in rows], "edge": edge,
        })

    return run


def _linked(agree: float) -> Column:
    """Whether an edge run goes on from the edge run before it in another chunk: the same rule as inside a chunk, words split alike."""

    @F.pandas_udf(T.BooleanType())
    def alike(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([near(_words(x), _words(y), agree) for x, y in zip(a, b)], dtype=bool)

    return F.coalesce(F.col("_before") & ((F.col("_template") == F.col("first_template")) | alike("_text", "first_text")), F.lit(False))


def event_runs(events: DataFrame, services: DataFrame, agree: float = AGREE, min_events: int = MIN_EVENTS, partitions: int | None = None) -> DataFrame:
    """Maximal runs of at least ``min_events`` events: service, source, first_event_id, last_event_id, n_events, first_us, last_us.

    Each event_id of a source counts once (of copies the one with the smallest
    timestamp text); events without template_id, event_id, source or service
    are passed over and end no run.  first_us and last_us are null if no
    timestamp of the run is readable.
    """
    rows = events.where("template_id is not null and event_id is not null and source is not null and service_name is not null and offset is not null")
    rows = rows.select(clean_name("service_name").alias("service"), "source", F.col("offset").cast("long").alias("offset"), "event_id", "template_id", F.col("normalized_template").alias("text"), F.col("timestamp").alias("ts"), F.col("observed_timestamp").alias("observed"))
    zones = service_zones(services).select(F.col("_service").alias("service"), F.col("_zone").alias("zone"), F.col("_order").alias("order"))
    rows = rows.join(zones, "service", "left")
    key = ["service", "source", "offset", "event_id"]
    rows = combine_batches(rows, [*key, "template_id", "text", "ts", "zone", "order"], least=["observed"])
    ranged = rows.repartitionByRange(partitions, *key) if partitions else rows.repartitionByRange(*key)
    runs = ranged.sortWithinPartitions(*key, "ts", "observed").mapInPandas(_encode(agree, min_events), _EDGE)
    # one pass over the runs: edges meet the edges of their source, runs inside a chunk stand for themselves
    slot = F.when(F.col("edge"), F.lit(-1).cast("long")).otherwise(F.col("part"))
    by = ["service", "source", "_slot"]
    order = Window.partitionBy(*by).orderBy("part", "seq")
    prior = runs.withColumn("_slot", slot).select("*", *[F.lag(c).over(order).alias(a) for c, a in (("last_template", "_template"), ("last_text", "_text"), ("part", "_part"))])
    prior = prior.withColumn("_before", F.col("edge") & (F.col("_part") < F.col("part")))
    chained = prior.withColumn("_chain", F.sum(F.when(_linked(agree), 0).otherwise(1)).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    at = F.struct("part", "seq")
    merged = chained.groupBy(*by, "_chain").agg(F.min_by("first_event_id", at).alias("first_event_id"), F.max_by("last_event_id", at).alias("last_event_id"), F.sum("n_events").alias("n_events"), F.min("first_us").alias("first_us"), F.max("last_us").alias("last_us"))
    return merged.select("service", "source", "first_event_id", "last_event_id", "n_events", "first_us", "last_us").where(F.col("n_events") >= min_events)


def found(runs: DataFrame) -> DataFrame:
    """The columns of p4_found."""
    return runs.select("first_event_id", "last_event_id", "n_events", F.coalesce(F.floor((F.col("last_us") - F.col("first_us")) / 1000).cast("long"), F.lit(0).cast("long")).alias("duration_ms"))
