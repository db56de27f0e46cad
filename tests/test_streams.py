"""Streams: out of order, twice, too late, restarted; equal to the batch."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lineloom import registry
from lineloom.config import ADAPTED as T
from lineloom.operators import detect
from lineloom.sources import adapters
from lineloom.streaming import alarms

FOLDER = "/root/testdata/sf0.001"


def test_latch_carries_its_state():
    opens, closes = np.array([0, 1, 1, 0, 0, 1], bool), np.array([0, 0, 0, 1, 0, 0], bool)
    assert alarms.latch(opens, closes, False)[0].tolist() == [False, True, False, False, False, True]
    assert alarms.latch(opens, closes, True)[0].tolist() == [False, False, False, False, False, True]
    for cut in range(1, 6):
        a, state = alarms.latch(opens[:cut], closes[:cut], False)
        b, _ = alarms.latch(opens[cut:], closes[cut:], state)
        assert [*a, *b] == alarms.latch(opens, closes, False)[0].tolist()
    assert alarms.latch(opens[:0], closes[:0], True)[1] is True


@pytest.fixture(scope="module")
def station(spark):
    """Two stations' rows for the stream, and the batch's alarms of them."""
    wide = adapters.slowed(registry._faulty(spark, FOLDER), adapters.by_station(spark, registry.SLOW)).where(F.col("station").isin(1, 2))
    sc = detect.score(wide, T).cache()
    flags = detect.flags(detect.with_flags(sc, T, causal=True)).select("station", "parameter", "vehicle", "type")
    bots = detect.bottlenecks(sc, T).select("station", F.lit("cycle_time"), "vehicle", F.lit("bottleneck"))
    return sc, alarms.station_rows(sc, detect.constraint_series(sc, T)).cache(), {tuple(r) for r in flags.union(bots).collect()}, detect.ewma_limit(sc, T).first()[0]


def processor(limit):
    return alarms.StationAlarms(limit, T, adapters.PARAMETERS)


def test_arrays_in_any_cut_equal_the_batch(station):
    """The processor alone, its past carried through pieces of any size."""
    _, rows, want, limit = station
    p, got = processor(limit), set()
    for key, piece in ((1, 1), (1, 37), (2, 1000)):
        d = rows.where(F.col("key") == key).orderBy("vehicle").toPandas()
        past, own = None, set()
        for i in range(0, len(d), piece):
            part = d.iloc[i : i + piece]
            found, past = p.due(part["vehicle"].to_numpy(), part[p.columns].to_numpy(float), past)
            own |= {(key, *f[:3]) for f in found}
        assert own == {w for w in want if w[0] == key}, (key, piece)
        got |= own
    assert {w[3] for w in got} == {"point", "persistent", "trend", "cross_parameter", "bottleneck"}


def test_shuffled_repeated_and_late_rows(spark, station):
    _, rows, want, limit = station
    p = processor(limit)
    source = rows.select("key", "vehicle", alarms.clock(F.col("vehicle")).alias("at"), *(F.col(c).cast("double").alias(c) for c in p.columns))
    turn = F.floor((F.col("vehicle") + F.pmod(F.col("vehicle") * 13 + F.col("key"), F.lit(25))) / 200)
    parts = [source.where(turn == i).orderBy(F.xxhash64("vehicle")) for i in range(4)]
    parts[1] = parts[1].unionByName(parts[0].where("vehicle > 185"))  # delivered again, still in time
    parts[3] = parts[3].unionByName(source.where("vehicle in (5, 6)"))  # long past the watermark
    got, late = alarms.replay(rows, p, parts)
    assert {tuple(r)[:4] for r in got.collect()} == want and got.count() == len(want)
    assert late == 4


def test_no_rows_no_alarms(spark, station):
    _, rows, _, limit = station
    got, late = alarms.replay(rows.limit(0), processor(limit))
    assert got.count() == 0 and late == 0
