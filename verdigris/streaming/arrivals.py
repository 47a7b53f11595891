"""Arrivals checked against each other: near copies among what a stream has brought within a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from verdigris.operators.similarity import hash_bands

LINK = "late bigint, early bigint, bits int, at timestamp"
#: Seen hashes of a class and band value: hash, the last item that had it and when (microseconds).
SEEN = "highs array<bigint>, lows array<bigint>, ids array<bigint>, times array<bigint>"


def links(items: DataFrame, most: int, keep: str = "1 hour", late: str = "10 minutes", key: str = "vec_id", high: str = "high", low: str = "low", label: str = "label", at: str = "ts", forest: bool = False) -> DataFrame:
    """late, early, bits, at of a stream: arrivals with an item of their class that came within keep before them (or, in
    event time, up to late after) and whose 64-bit hash differs in at most most bits.

    Hashes that close agree in one of most + 1 bands, so arrivals meet their like in the state of (class, band, value):
    there is one entry for each hash, with the item that had it last, so that copies make neither state nor links
    grow. An arrival is linked to each entry that is near enough, in the first band they share only: it has a link if and only if
    there is a near item in time, and links hold together what all near pairs hold together as long as no entry in
    between has expired. Entries expire by a timer once the watermark is keep past them. Rows more than late behind the
    newest are late and dropped, as are those with a null key, hash or time; null classes are one class. From one
    batch, rows are taken by time, then key; a batch's rows of one class and band value are in one task, so the source must
    bound its batches (maxFilesPerTrigger and the like). late must not exceed keep, as an entry's last item hides earlier ones.
    With forest, of the links of a batch's rows in one state only those that hold the same items together: fewer than rows and entries.
    """
    keep_us, late_us = (_microseconds(items, x) for x in (keep, late))
    if late_us > keep_us:
        raise ValueError("late must not exceed keep")
    rows = items.select(F.col(key).cast("bigint").alias("id"), F.col(high).cast("bigint").alias("high"), F.col(low).cast("bigint").alias("low"), F.col(label).cast("string").alias("of"), F.col(at).cast("timestamp").alias("at"))
    rows = rows.dropna(subset=["id", "high", "low", "at"]).withWatermark("at", late)
    bands = rows.withColumn("bands", F.array(*hash_bands("high", "low", most + 1))).select("*", F.posexplode("bands").alias("n", "band"))
    edges = [round(i * 64 / (most + 1)) for i in range(most + 2)]

    def meet(name: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen = dict(zip(*_entries(state)))
        mark = state.getCurrentWatermarkMs() * 1000
        if not state.hasTimedOut:
            new = pd.concat(list(pdfs))
            new["us"] = new["at"].astype("datetime64[us]").astype("int64")
            out = _links(new.sort_values(["us", "id"]), seen, int(name[1]), most, keep_us, edges, forest)
            if len(out):
                yield out
        seen = {h: x for h, x in seen.items() if x[1] + keep_us >= mark}
        if not seen:
            state.remove()
            return
        state.update(([h for h, _ in seen], [w for _, w in seen], [i for i, _ in seen.values()], [t for _, t in seen.values()]))
        state.setTimeoutTimestamp(max(min(t for _, t in seen.values()) + keep_us, mark) // 1000 + 1)

    grouped = bands.select("of", "n", "band", "id", "high", "low", "at").groupBy("of", "n", "band")
    return grouped.applyInPandasWithState(meet, LINK, SEEN, "append", GroupStateTimeout.EventTimeTimeout)


def _microseconds(df: DataFrame, interval: str) -> int:
    return df.sparkSession.sql(f"SELECT cast(unix_micros(timestamp '1970-01-01 00:00:00 UTC' + interval {interval}) as bigint)").first()[0]


def _entries(state: GroupState) -> tuple[list, list]:
    if not state.exists:
        return [], []
    highs, lows, ids, times = state.get
    return list(zip(highs, lows)), list(zip(ids, times))


def _links(rows: pd.DataFrame, seen: dict, band: int, most: int, keep: int, edges: list[int], forest: bool = False) -> pd.DataFrame:
    """Links of the rows, in order, to the entries of one band value, which take the rows up."""
    names = list(seen)
    place = {h: i for i, h in enumerate(names)}
    hashes = np.zeros(max(16, 2 * (len(names) + len(rows))), np.uint64)
    hashes[: len(names)] = [_whole(h) for h in names]
    ids, times = np.zeros(len(hashes), np.int64), np.zeros(len(hashes), np.int64)
    for i, (who, when) in enumerate(seen.values()):
        ids[i], times[i] = who, when
    before = [np.uint64(((1 << (z - a)) - 1) << a) for a, z in zip(edges[:band], edges[1 : band + 1])]
    # the items that entries stand for, those that were there and the rows, and what stands for what they are tied with
    node, root = np.arange(len(hashes)), np.arange(len(hashes) + len(rows))
    out = []
    for k, (high, low, who, when) in enumerate(zip(rows["high"].tolist(), rows["low"].tolist(), rows["id"].tolist(), rows["us"].tolist())):
        h = (high, low)
        n, whole, own = len(place), _whole(h), len(hashes) + k
        apart = hashes[:n] ^ np.uint64(whole)
        bits = np.bitwise_count(apart)
        near = np.flatnonzero(bits <= most)
        near = near[(np.abs(when - times[near]) <= keep) & (ids[near] != who)]
        for mask in before:  # those that share an earlier band meet there
            near = near[(apart[near] & mask) != 0]
        if forest and len(near):
            roots, first = np.unique(root[node[near]], return_index=True)
            near, root[own] = near[first], roots[0]
            for r in roots[1:]:
                root[root == r] = roots[0]
        if len(near):
            out.append((np.full(len(near), k), ids[near], bits[near]))
        i = place.setdefault(h, n)
        if i == n or when >= times[i]:
            hashes[i], ids[i], times[i], node[i] = whole, who, when, own
    for h, i in place.items():
        seen[h] = (int(ids[i]), int(times[i]))
    if not out:
        return pd.DataFrame([], columns=["late", "early", "bits", "at"])
    late, early, bits = (np.concatenate(x) for x in zip(*out))
    return pd.DataFrame({"late": rows["id"].to_numpy()[late], "early": early, "bits": bits.astype(np.int32), "at": rows["at"].array.take(late)})


def _whole(h: tuple[int, int]) -> int:
    return (h[0] & 0xFFFFFFFF) << 32 | (h[1] & 0xFFFFFFFF)
