import numpy as np
import pytest

from heronwatch.llm import suffixes


def contents_of(rng, lone):
    """Runs of which some windows recur, some start alike and some recur nowhere."""
    own = [rng.integers(0, 256, 120, np.uint8).tobytes() for _ in range(lone)]
    near = [b"same start of all " + bytes([97 + i % 3]) * 40 + bytes([65 + i % 2]) * 30 for i in range(6)]
    texts = [*own, *near, own[0][10:100] + own[1][:60], b"z" * 90, b"z" * 70]
    return texts, np.array([len(t) - suffixes.WINDOW + 1 for t in texts])


def windows(contents, n):
    return [t[i : i + suffixes.WINDOW] for t, k in zip(contents, n.tolist(), strict=True) for i in range(k)]


def same_classes(got, contents, n):
    want = np.unique(np.array(windows(contents, n), object), return_inverse=True)[1]
    pairs = set(zip(got.tolist(), want.tolist(), strict=True))
    return len(pairs) == len(set(got.tolist())) == len(set(want.tolist()))


def test_windows_that_nothing_equals_are_not_sorted(monkeypatch):
    contents, n = contents_of(np.random.default_rng(4), 40)
    sorted_, given = suffixes.Suffixes.sorted, []

    def watched(self, start):
        given.append(len(start))
        return sorted_(self, start)

    monkeypatch.setattr(suffixes.Suffixes, "sorted", watched)
    assert same_classes(suffixes.equal_windows(contents, n), contents, n)
    each = windows(contents, n)
    assert given == [sum(each.count(w) > 1 for w in each)] and given[0] < len(each) / 4


@pytest.mark.parametrize("kinds", [1, 2, 7])
def test_hashes_that_collide_are_told_apart_by_bytes(monkeypatch, kinds):
    contents, n = contents_of(np.random.default_rng(5), 8)
    monkeypatch.setattr(suffixes.Suffixes, "hashes", lambda self, x: self.data[x].astype(np.uint64) % np.uint64(kinds))
    assert same_classes(suffixes.equal_windows(contents, n), contents, n)


def test_suffixes_come_in_the_order_of_their_bytes():
    contents, n = contents_of(np.random.default_rng(6), 12)
    data = b"".join(contents)
    s = suffixes.Suffixes(np.frombuffer(data, np.uint8), suffixes.WINDOW)
    start = np.concatenate([np.arange(k) + at for k, at in zip(n.tolist(), np.cumsum([0, *map(len, contents[:-1])]).tolist(), strict=True)])
    told = [data[i : i + suffixes.WINDOW] for i in start[s.sorted(start)].tolist()]
    assert told == sorted(told)
    assert len(s.sorted(start[:0])) == 0
