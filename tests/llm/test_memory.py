"""Passes over texts hold little beside the batch that they were given, and their results don't depend on how it is cut."""

import tracemalloc

import numpy as np
import pyarrow as pa

from fathom.llm import words
from fathom.llm.mixing import _measure
from fathom.llm.quality import FEATURES, STATS, Model, _pass, batch_stats
from fathom.llm.words import SPACE, Words, flat

RNG = np.random.default_rng(5)
MODEL = Model(np.zeros(STATS), np.ones(STATS), RNG.standard_normal((STATS, FEATURES)), RNG.uniform(0, 6, FEATURES), RNG.standard_normal(FEATURES + 1), np.array([-9.0, 9.0]), np.array([0.0, 1.0]))
WORDS = ["river", "café", "bridge", "a", "{slow}", "1999", "wait,"]
TEXTS = [" ".join(WORDS[(k * 7 + j * j) % 7] for j in range(500)) + str(k) for k in range(4000)]
TEXTS[7], TEXTS[8] = None, ""
BATCH = pa.RecordBatch.from_arrays([pa.array(range(len(TEXTS))), pa.array(TEXTS)], ["id", "text"])


def weigh(texts):
    return MODEL.probability(MODEL.raw(batch_stats(texts)))


def spent(run):
    """The pieces that ``run`` gives for the batch, and MB of NumPy arrays at the most."""
    tracemalloc.start()
    sizes, kept = [], []
    for b in run(iter([BATCH])):
        sizes.append(b.nbytes / 1e6)
        kept.append(b.column(0))
    most = tracemalloc.get_traced_memory()[1] / 1e6
    tracemalloc.stop()
    return sizes, pa.concat_arrays(kept), most


def test_quality_and_mix_send_parts_and_hold_little():
    weigh(pa.array(["a"]))
    sizes, ids, most = spent(_pass(MODEL, 1, 0.0))
    assert ids.to_pylist() == list(range(len(TEXTS)))
    assert max(sizes) < 6 and most < 30
    sizes, ids, most = spent(_measure(1, [0, 1], ["id", "text", "n", "w"], weigh, False))
    assert ids.to_pylist() == list(range(len(TEXTS)))
    assert max(sizes) < 6 and most < 30


def test_measures_are_those_of_each_text_alone():
    got = pa.Table.from_batches(_measure(1, [0], ["id", "n", "w"], weigh, True)(iter([BATCH, BATCH.slice(5, 3), BATCH.slice(0, 0)])))
    texts = TEXTS + TEXTS[5:8]
    assert got["n"].to_pylist() == [len((t or "").split()) for t in texts]
    alone = [weigh(pa.array([t], pa.string()))[0] for t in texts[:50]]
    assert np.allclose(got["w"].to_numpy()[:50], alone, rtol=0, atol=1e-9)


def test_a_long_text_leaves_no_powers_behind():
    data, offsets = flat(pa.array([" ".join(TEXTS[9:1100])]))
    assert len(data) > words.SLICE * 2
    got = Words(data, offsets, SPACE).hashes()
    assert max(map(len, words._powers.values())) <= words.SLICE + 4096
    some = flat(pa.array([TEXTS[9]]))
    first = Words(*some, SPACE).hashes()
    assert (got[: len(first)] == first).all()
