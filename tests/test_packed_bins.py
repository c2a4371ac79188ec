"""Bins of a row travel as one value, and batches are cut by set, without a Python object per row."""

import numpy as np
import pyarrow as pa

from loomtab.operators import grower


def _batch(sets, bins):
    n = len(sets)
    columns = [pa.array(sets), pa.array(np.arange(n, dtype=np.int32) % 3), pa.array(np.arange(n)), pa.array(np.arange(n) / 2), grower._packed(bins)]
    return pa.RecordBatch.from_arrays(columns, ["rows", "fold", "row", "label", "bins"])


def test_bins_come_back_whole_and_in_parts():
    bins = np.random.default_rng(0).integers(0, 32, (50, 7)).astype(np.uint8)
    packed = grower._packed(bins)
    assert packed.to_pylist() == [b.tobytes() for b in bins]
    assert (grower._unpacked(packed) == bins).all()
    assert (grower._unpacked(packed.slice(11, 20)) == bins[11:31]).all()
    assert (grower._unpacked(pa.array([b.tobytes() for b in bins], pa.binary())) == bins).all()


def test_batches_are_cut_by_set():
    rng = np.random.default_rng(1)
    bins = rng.integers(0, 32, (60, 3)).astype(np.uint8)
    sets = rng.choice(["x/0", "x/1", "y/0"], 60)
    for batch, own_sets, own in ((_batch(sets, bins), sets, bins), (_batch(sets, bins).slice(13, 30), sets[13:43], bins[13:43]), (_batch(["x"] * 60, bins).slice(5, 9), np.array(["x"] * 9), bins[5:14])):
        found = {name: (row, b) for name, _, row, _, b in grower._by_set(batch)}
        assert sorted(found) == sorted(set(own_sets))
        for name, (row, b) in found.items():
            assert (b == own[own_sets == name]).all() and len(row) == (own_sets == name).sum()
