"""A key's ticks of a micro-batch are held as arrays: memory of some bytes a tick, and the same alerts in any order of arrival."""

import tracemalloc
from types import SimpleNamespace

import numpy as np
import pandas as pd

from burnline.dims import HOUR
from burnline.operators.alerts import arming
from burnline.streaming.alerts import fold


def ticks(n, seed=1):
    rng = np.random.default_rng(seed)
    resets = np.where(rng.random(n) < 0.1, np.nan, (np.arange(n) // 50) * float(HOUR))
    return pd.DataFrame({"account": "a", "now_us": rng.permutation(n).astype(np.int64), "used": rng.random(n) * 100, "resets_us": resets, "rolling": rng.random(n) < 0.5, "condition": rng.random(n) < 0.3, "cleared": rng.random(n) < 0.02})


def state():
    out = SimpleNamespace(exists=False)
    out.update = lambda v: setattr(out, "held", v)
    return out


def test_fold_equals_a_plain_loop():
    rows, s = ticks(3000), state()
    got = pd.concat(fold(("a", "p", "k", "burn"), iter([rows[:1000], rows[1000:1001], rows[1001:]]), s))
    held, want = (True, None), []
    for t in rows.sort_values("now_us").to_dict("records"):
        held, fires = arming(held, t | {"resets_us": None if pd.isna(t["resets_us"]) else t["resets_us"]})
        want += [t["now_us"]] if fires else []
    assert want and got["fired_us"].tolist() == want and s.held[0] == held[0]


def test_fold_holds_few_bytes_a_tick():
    n, rows = 40_000, ticks(40_000)
    tracemalloc.start()
    list(fold(("a", "p", "k", "burn"), (rows[i : i + 10_000].copy() for i in range(0, n, 10_000)), state()))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 200 * n  # dictionaries took 500 and more
