from itertools import combinations

import numpy as np
from xxhash import xxh64_intdigest

from prosemill.llm import simhash


def plain_fingerprint(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(fps, radius):
    ids = sorted(fps)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in combinations(ids, 2):
        if (fps[a] ^ fps[b]).bit_count() <= radius:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {i: find(i) for i in ids}


def test_against_all_pairs(docs, texts):
    fps = {i: plain_fingerprint(t) for i, t in texts}
    want = groups(fps, 4)
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == len(texts)
    for r in got:
        assert (r.fingerprint, r.component_id) == (f"{fps[r.doc_id]:016x}", want[r.doc_id])


def test_links_of_random_and_planted_fingerprints():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
    near = [int(b) ^ sum(1 << int(k) for k in rng.choice(64, int(rng.integers(1, 8)), replace=False)) for b in base]
    fps = np.unique(np.concatenate([base, np.array(near, np.uint64)]))
    linked = {}
    for radius in (1, 4):
        pairs = set()
        for mask in simhash._masks(radius):
            a, b = simhash.group_links(fps, mask, radius)
            pairs |= {frozenset(p) for p in zip(a.tolist(), b.tolist(), strict=True)}
        nodes = {int(f): int(f) for f in fps}
        want = groups(nodes, radius)
        root = {int(f): int(f) for f in fps}

        def find(i, root=root):
            while root[i] != i:
                i = root[i]
            return i

        for p in pairs:
            if len(p) == 2:
                x, y = sorted(map(find, p))
                root[y] = x
        linked[radius] = {i: find(i) for i in nodes}
        assert linked[radius] == want


def test_wide_groups_are_split_exactly():
    base = np.uint64(0xABCDEF0123456789)
    fps = np.unique(base ^ (np.arange(3000, dtype=np.uint64) << np.uint64(40)))
    a, b = simhash.group_links(fps, (1 << 21) - 1, 4)
    assert len(np.unique(np.concatenate([a, b]))) == len(fps)


def test_empty(nothing):
    assert simhash.near_duplicates(nothing).count() == 0
