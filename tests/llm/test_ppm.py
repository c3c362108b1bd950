import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from filingframe.llm import ppm

from . import samples


def plain_bits(train: list[bytes], text: bytes, order: int, exclusion: bool) -> float:
    """Method C read off its definition, one symbol at a time."""
    seen: dict[bytes, Counter] = defaultdict(Counter)
    for t in train:
        padded = ppm.PAD * order + t + ppm.END
        for i in range(order, len(padded)):
            for j in range(order + 1):
                seen[padded[i - j : i]][padded[i]] += 1
    padded, total = ppm.PAD * order + text + ppm.END, 0.0
    for i in range(order, len(padded)):
        gone: set[int] = set()
        for j in range(order, -1, -1):
            counts = {s: c for s, c in seen[padded[i - j : i]].items() if not exclusion or s not in gone} if padded[i - j : i] in seen else {}
            n, d = sum(counts.values()), len(counts)
            if padded[i] in counts:
                total += math.log2((n + d) / counts[padded[i]])
                break
            if d:
                total += math.log2((n + d) / d)
            if exclusion:
                gone |= set(seen[padded[i - j : i]]) if padded[i - j : i] in seen else set()
        else:
            total += math.log2(255 - (len(seen[b""]) if exclusion else 0))
    return total


def tree(train: list[bytes], order: int, exclusion: bool) -> ppm.Contexts:
    keys, counts = ppm.gram_counts(train, order)
    return ppm.Contexts([ppm.lower_order(keys, counts, j) for j in range(order)] + [(keys, counts)], exclusion)


@pytest.mark.parametrize("exclusion", [True, False])
@pytest.mark.parametrize("order", [1, 3, 5])
def test_code_length_follows_the_definition(order, exclusion):
    rng = random.Random(2)
    train = [samples.text(rng, words=30).encode() for _ in range(5)]
    model = tree(train, order, exclusion)
    texts = [b"", b"the thing", train[0][:60], samples.text(rng, "de", 20).encode(), b"\x00\xc3\xa9zz"]
    got = ppm.text_bits(texts, order, model.bits)
    assert got == pytest.approx([plain_bits(train, t, order, exclusion) for t in texts])


def test_probabilities_of_the_next_symbol_sum_to_one():
    model = tree([b"abracadabra", b"abacus"], 2, True)
    for context in (b"ab", b"zz", b"ra", ppm.PAD * 2):
        base = int.from_bytes(context, "big") << 8
        keys = np.array([base + s for s in range(255)], np.uint64)
        assert np.exp2(-model.bits(keys)).sum() == pytest.approx(1)


def test_long_texts_are_continued_with_their_context():
    rng = random.Random(3)
    text = samples.text(rng, words=3000).encode()
    model = tree([text[:2000]], 4, True)
    parts = [g for g in ppm.segments([b"ab", text, b""], 4, limit=500)]
    assert len(parts) > 10
    bits = sum(model.bits(ppm.gram_keys(g, 4)[0]).sum() for g in parts)
    assert bits == pytest.approx(ppm.text_bits([b"ab", text, b""], 4, model.bits).sum())


def test_index_finds_all_keys_and_no_others():
    rng = np.random.default_rng(1)
    keys = np.unique(rng.integers(0, 2**62, 5000).astype(np.uint64))
    index = ppm.Index(keys)
    assert (index.find(keys) == np.arange(len(keys))).all()
    assert (index.find(keys + np.uint64(1))[~np.isin(keys + np.uint64(1), keys)] == -1).all()
    assert (ppm.Index(keys[:0]).find(keys[:3]) == -1).all()
