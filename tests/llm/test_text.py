import re

import numpy as np

from roadglass.llm import _text


def test_word_hashes_tell_words_apart(monkeypatch):
    texts = ["", "The the THE  cat\tsat", "ça Ça é", "x" * 3000 + " y", " a\x0bb\x0cc\rd ", "the cat sat on the mat the cat"]
    want = [re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), t)) for t in texts]
    found = []
    for piece in (1 << 20, 64, 5):
        monkeypatch.setattr(_text, "PIECE", piece)
        with np.errstate(over="ignore"):
            words, starts, ends, joined, before = _text.batch_words([t.encode() for t in texts])
        assert [bytes(joined[a:b]).decode() for a, b in zip(starts, ends)] == [w for t in want for w in t]
        assert np.diff(before).tolist() == [len(t) for t in want]
        by: dict = {}
        for h, w in zip(words.tolist(), [w for t in want for w in t]):
            assert by.setdefault(w, h) == h
        assert len(set(by.values())) == len(by)
        found.append(words.tolist())
    assert found[0] == found[1] == found[2]


def test_shingles():
    texts = ["a b c d e f", "a b", "", "a b c d e", "a b c d e f"]
    with np.errstate(over="ignore"):
        words, _, _, _, before = _text.batch_words([t.encode() for t in texts])
        sh, at = _text.batch_shingles(words, before)
    assert np.diff(at).tolist() == [2, 1, 0, 1, 2]
    assert sh[0] == sh[3] == sh[4] and sh[1] == sh[5] and sh[2] not in sh[[0, 1]]
