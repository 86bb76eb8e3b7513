import random

import numpy as np

from affinis.llm import wordhash as W


def test_words_and_windows(monkeypatch):
    rng = random.Random(5)
    for chunk in (7, 64, 1 << 20):
        monkeypatch.setattr(W, "CHUNK", chunk)
        data = b"".join(rng.choice([b"a", b"bc", b" ", b"\t", b"\x0b\x0c", b"\xc3\xa9", b"ddd"]) for _ in range(400))
        h, a, b = W.hash_words(data)
        assert [data[i:j] for i, j in zip(a, b, strict=True)] == data.split()
        seen = {}
        for w, x in zip(data.split(), h.tolist(), strict=True):
            assert seen.setdefault(w, x) == x
        assert len(set(seen.values())) == len(seen)
    h = np.array([rng.randrange(4) for _ in range(500)], np.uint64)
    for size in (1, 2, 3, 5, 8, 20, 50):
        w, seen = W.windows(h, size), {}
        assert len(w) == 500 - size + 1
        for i, x in enumerate(w.tolist()):
            assert seen.setdefault(tuple(h[i : i + size].tolist()), x) == x
        assert len(set(seen.values())) == len(seen)
    for window in (1, 2, 3, 7, 8, 43):
        assert W.minimisers(h, window).tolist() == [i + int(np.argmin(h[i : i + window])) for i in range(500 - window + 1)]


def test_texts_are_told_apart():
    docs = [b"", b"a b", b" ", b"c", b"d e f"]
    got = [(h.tolist(), o.tolist()) for _, _, h, o in W.texts(docs, 4)]
    assert sum([o for _, o in got], []) == [1, 1, 3, 4, 4, 4]
