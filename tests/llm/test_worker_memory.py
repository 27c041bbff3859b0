"""What a Python worker holds in near-dedup follows the slice of texts, not the largest slice of any operator."""

import numpy as np
import pyarrow as pa

from squareframe.llm import flat, near_dedup


def _texts(n):
    return [f"the {i} quick brown fox jumps {i % 3} over the lazy dog number {i}" for i in range(n)]


def test_powers_are_made_as_far_as_texts_need_them(monkeypatch):
    monkeypatch.setattr(flat, "_powers", {})
    data, off = flat.flat(pa.array(_texts(2000)))
    near_dedup.shingle_sets(data, off, 5)
    assert sum(x.nbytes for both in flat._powers.values() for x in both) < 16 << 20
    short = flat.Prefix(data[:1000]).hash(3, 700)
    flat.powers(flat.BASE, 1 << 20)  # more of them are the same ones
    assert flat.Prefix(data[:1000]).hash(3, 700) == short


def test_the_map_of_needed_nodes_has_a_bit_for_each():
    data, off = flat.flat(pa.array(_texts(300)))
    nodes = near_dedup._nodes(*near_dedup.shingle_sets(data, off, 5))
    bits = np.zeros(1 << near_dedup.BITS >> 3, np.uint8)
    for x in near_dedup._lead(nodes[::7]).tolist():
        bits[x >> 3] |= 1 << (x & 7)
    run = near_dedup._each_node(5, near_dedup._needed(bits), ["node", "shingles"])
    got = [x for b in run(iter([pa.RecordBatch.from_arrays([pa.array(_texts(300))], ["text"])])) for x in b.column(0).to_pylist()]
    assert set(nodes[::7]) <= set(got) and len(got) < 60
