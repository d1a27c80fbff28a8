"""The rollover of biases over a stream of edits: state is the last toggle and the bases that it has set."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame

from terraline.streaming.ordered import ordered_fold


def rollover_stream(edits: DataFrame, key: str, order: str, flag: str, late: str = "10 seconds", idle_seconds: float | None = None) -> DataFrame:
    """Adds b1_new and b2_new to streaming edits, as ``functions.payoff.rollover`` does to all edits at once. With
    ``idle_seconds`` a key without edits for so long starts anew."""

    def moved(base, ref, constant, up, down):
        if None in (base, ref, constant, up, down) or not down or up / down <= 0:
            return None
        return base + (ref - constant) * math.log(up / down)

    def fold(known, us, row):
        if known is not None and idle_seconds is not None and us - known[0] > idle_seconds * 1e6:
            known = None
        was, bases = (known[1], list(known[2:])) if known else (False, [None, None])
        on = row[flag] is not None and bool(row[flag])
        a, b = row["x0_1"], row["x0_2"]
        new = []
        for k, (up, down) in enumerate(((b, a), (a, b))):
            own = row[f"b{k + 1}"]
            if on and not was and own is not None:
                bases[k] = float(own)
            value = moved(bases[k], row["refConst"], row[f"constant{k + 1}"], up, down) if on and a is not None and b is not None and a > 0 and b > 0 else None
            new.append(own if value is None else value)
        return (us, on, *bases), tuple(new)

    return ordered_fold(edits.withWatermark(order, late), key, order, fold, "us long, was boolean, base1 double, base2 double", "b1_new double, b2_new double", idle_seconds)
