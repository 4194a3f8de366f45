"""Replaying a log of lock requests: compare-owner leases with a time to live."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame


def replay(requests: DataFrame) -> DataFrame:
    """Rows (seq, at, key, owner, action, ttl) with ok and holder.

    acquire works on a free or expired key, refresh and release for its owner
    only, is_locked tells whether someone holds it.  Each key is one sequential
    pass over its requests.
    """
    ordered = requests.repartition("key").sortWithinPartitions("key", "seq")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, holder, until = None, None, 0
        for frame in frames:
            oks, holders = [], []
            for key, at, owner, action, ttl in zip(frame["key"], frame["at"], frame["owner"], frame["action"], frame["ttl"], strict=True):
                if key != last:
                    last, holder, until = key, None, 0
                if holder is not None and at >= until:
                    holder = None
                if action == "acquire":
                    ok = holder is None
                elif action == "is_locked":
                    ok = holder is not None
                else:
                    ok = holder == owner
                if ok and action in ("acquire", "refresh"):
                    holder, until = owner, at + ttl
                elif ok and action == "release":
                    holder = None
                oks.append(ok)
                holders.append(holder)
            yield frame[["seq", "key", "owner", "action"]].assign(ok=oks, holder=holders)

    return ordered.mapInPandas(run, "seq long, key string, owner string, action string, ok boolean, holder string")
