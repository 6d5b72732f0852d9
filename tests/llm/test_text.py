from __future__ import annotations

import numpy as np

from gaugelab.llm import text as tx


def test_powers_by_parts():
    for base in (tx._BASE, tx._BASE_INVERSE):
        for n in (0, 1, 4095, 4096, 4097, 20000):
            want, power = [], 1
            for _ in range(n):
                want.append(power)
                power = power * base % 2**64
            assert tx._power_table(base, n).tolist() == want
            some = np.arange(0, n, 7)
            assert tx._powers_at(base, some, n).tolist() == want[::7]


def test_a_word_has_one_hash_wherever_it_lies():
    raw = ("spring " * 3000 + "Spring springs").encode()
    data = np.frombuffer(raw, np.uint8)
    starts, ends, _ = tx.words(data, np.array([0, len(data)]), tx.SPACED)
    hashes = tx.word_hashes(data, starts, ends)
    assert len(set(hashes[:-1].tolist())) == 1 and hashes[-1] != hashes[0]
    assert tx.word_hashes(data, starts, ends, lower=False)[-2] != hashes[0]
