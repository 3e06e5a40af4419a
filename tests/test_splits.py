import random

import pytest
from conftest import rows

from sparktape.operators import splits
from sparktape.schema import TapeError

ROWS = "symbol string, epoch_ms long"


def frame(spark, times, symbol="S"):
    return spark.createDataFrame([(symbol, int(t)) for t in times], ROWS)


def parts(df):
    out = {"train": [], "validation": []}
    for r in df.collect():
        out[r.part].append(r.epoch_ms)
    return sorted(out["train"]), sorted(out["validation"])


def test_seventy_thirty(spark):
    train, val = parts(splits.train_val_split(frame(spark, range(0, 10_000, 1000)), 0.7))
    assert (len(train), len(val)) == (7, 3) and max(train) < min(val)


def test_small_and_edge_ratios(spark):
    two = frame(spark, [0, 1000])
    assert [len(p) for p in parts(splits.train_val_split(two, 0.7))] == [1, 1]
    assert [len(p) for p in parts(splits.train_val_split(two, 0.0))] == [0, 2]
    assert [len(p) for p in parts(splits.train_val_split(two, 1.0))] == [2, 0]
    assert [len(p) for p in parts(splits.train_val_split(frame(spark, [5]), 0.3))] == [1, 0]


@pytest.mark.parametrize("seed", [1, 2])
def test_positions_equal_a_full_sort(spark, seed):
    rng = random.Random(seed)
    times = [rng.randint(0, 5) * 86_400_000 + rng.randint(0, 300) * 1000 + rng.randint(0, 2) for _ in range(400)]
    ordered = sorted(times)
    cut = ordered[int(400 * 0.7)]
    train, val = parts(splits.train_val_split(frame(spark, times), 0.7))
    assert train == [t for t in ordered if t < cut] and val == [t for t in ordered if t >= cut]


def test_report_and_leakage(spark):
    df = splits.train_val_split(frame(spark, range(0, 10_000, 1000)), 0.7)
    assert rows(splits.split_report(df, ["symbol", "part"])) == [
        ("S", "train", 7, 0, 6000, 70.0), ("S", "validation", 3, 7000, 9000, 30.0)
    ]
    assert rows(splits.leakage(df, ["symbol"])) == [("S", 0, 6000, 7000, True)]


def folds(df, k):
    out = {}
    for r in splits.kfold_split(df, k).collect():
        out.setdefault(r.fold, {"train": [], "validation": []})[r.part].append(r.epoch_ms)
    return out


def test_folds_expand_and_do_not_leak(spark):
    got = folds(frame(spark, range(0, 21_000, 1000)), 3)
    assert sorted(got) == [1, 2, 3]
    assert [len(got[i]["train"]) for i in (1, 2, 3)] == [5, 10, 15]
    assert [len(got[i]["validation"]) for i in (1, 2, 3)] == [5, 5, 6]
    for f in got.values():
        assert max(f["train"]) < min(f["validation"])


def test_equal_times_stay_on_one_side(spark):
    times = [i * 1000 for i in range(21)]
    times[5] = times[4]
    for f in folds(frame(spark, times), 3).values():
        assert not set(f["train"]) & set(f["validation"])


@pytest.mark.parametrize("k", [1, 0, -3])
def test_bad_k(spark, k):
    with pytest.raises(TapeError):
        splits.kfold_split(frame(spark, range(10)), k)


def test_impossible_folds(spark):
    with pytest.raises(Exception, match="not enough rows"):
        splits.kfold_split(frame(spark, [0, 1]), 3).collect()
    with pytest.raises(Exception, match="not enough rows"):
        splits.kfold_split(frame(spark, [7] * 12), 3).collect()
