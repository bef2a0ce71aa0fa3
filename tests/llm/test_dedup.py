import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from corpus_fixture import words

from quillmark.llm import components, near_copies, segments, suffix, superkmer

LAST = 1 << 62


def order(doc_id):
    return LAST if doc_id is None else doc_id


def rows_of(df, *names):
    return Counter(tuple(bytes(r[n]) if isinstance(r[n], bytearray) else r[n] for n in names) for r in df.collect())


def passages(rows, size):
    first = {}
    for doc_id, text, _ in rows:
        w = words(text)
        for j in range(len(w) - size + 1):
            k = tuple(w[j : j + size])
            first[k] = min(first.get(k, LAST + 1), order(doc_id))
    out = []
    for doc_id, text, _ in rows:
        w = words(text)
        gone = [False] * len(w)
        for j in range(len(w) - size + 1):
            if first[tuple(w[j : j + size])] < order(doc_id):
                gone[j : j + size] = [True] * size
        out.append((doc_id, len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g)))
    return Counter(out)


@pytest.mark.parametrize("size,gram", [(13, 4), (5, 1), (4, 4)])
def test_passages_match_brute_force(docs, corpus, size, gram):
    got = rows_of(superkmer.deduplicate(docs, size, gram), "doc_id", "n_words", "n_removed", "kept")
    assert got == passages(corpus, size)


def strings(rows, size, keep_first):
    data = [(order(i), n, (t or "").encode()) for n, (i, t, _) in enumerate(rows)]
    places = defaultdict(list)
    for o, n, b in data:
        for j in range(len(b) - size + 1):
            places[b[j : j + size]].append((o, n, j))
    out = []
    for (o, n, b), (doc_id, _, _) in zip(data, rows):
        gone = bytearray(len(b))
        for j in range(len(b) - size + 1):
            if len(places[b[j : j + size]]) > 1 and not (keep_first and min(places[b[j : j + size]]) == (o, n, j)):
                gone[j : j + size] = b"\1" * size
        runs = len([1 for a, c in zip(b"\0" + bytes(gone), bytes(gone)) if c > a])
        out.append((doc_id, len(b), sum(gone), runs, bytes(x for x, g in zip(b, gone) if not g)))
    return Counter(out)


@pytest.mark.parametrize("size", [400, 60])
def test_strings_match_brute_force(docs, corpus, size):
    got = rows_of(suffix.deduplicate(docs, size, keep_first=False), "doc_id", "n_bytes", "n_removed", "n_spans", "kept")
    assert got == strings(corpus, size, False)


def test_first_copies_stay(spark, corpus):
    once = list({r[0]: r for r in corpus if r[0] is not None}.values())
    df = spark.createDataFrame(once, "doc_id long, text string, source string")
    got = rows_of(suffix.deduplicate(df, 100), "doc_id", "n_bytes", "n_removed", "n_spans", "kept")
    assert got == strings(once, 100, True)


def test_suffix_ranks_tell_strings_apart():
    line = np.frombuffer(b"abcabcabcabd" * 3, np.uint8)
    for size in (1, 3, 8, 11):
        ranks = suffix.suffix_ranks(line, size)
        for i in range(len(line) - size + 1):
            for j in range(len(line) - size + 1):
                assert (ranks[i] == ranks[j]) == (line[i : i + size].tobytes() == line[j : j + size].tobytes())


def test_suffix_order_prefixes_and_previous_factors():
    rng = np.random.default_rng(4)
    for alphabet, n in ((2, 90), (3, 120), (26, 60)):
        line = np.append(rng.integers(97, 97 + alphabet, n).astype(np.uint8), np.zeros(40, np.uint8))
        text = line.tobytes()
        ranks = suffix.suffix_ranks(line, 32)
        order = np.lexsort((np.arange(n), ranks[:n]))
        assert [text[i : i + 32] for i in order] == sorted(text[i : i + 32] for i in range(n))
        common = lambda i, j: next(k for k in range(33) if k == 32 or text[i + k] != text[j + k])
        lcp = np.concatenate(([0], suffix.common_prefixes(suffix.words_of(line), order[:-1], order[1:], 32)))
        assert lcp[1:].tolist() == [common(i, j) for i, j in zip(order, order[1:])]
        factors = np.empty(n, np.int64)
        factors[order] = suffix.smaller_factors(order, lcp)
        want = [max((common(i, j) for j in range(i)), default=0) for i in range(n)]
        assert factors.tolist() == want
        cut = np.empty(n, np.int64)
        cut[order] = suffix.smaller_factors(order, lcp, 3)
        assert cut.tolist() == [w if w >= 3 else 0 for w in want]


def test_gram_hashes_cover_exactly_their_items():
    h = np.arange(40, dtype=np.uint64) % np.uint64(7)
    for size in (1, 2, 3, 5, 8, 13):
        g = segments.gram_hashes(h, size)
        assert len(g) == len(h) - size + 1
        for i in range(len(g)):
            for j in range(len(g)):
                assert (g[i] == g[j]) == (h[i : i + size].tolist() == h[j : j + size].tolist())


def near(rows, size, percent):
    sets, nodes = [], defaultdict(list)
    for doc_id, text, _ in rows:
        w = words((text or "").translate({c: c + 32 for c in range(65, 91)}))
        s = {tuple(w[j : j + size]) for j in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} - {()}
        sets.append(s)
        if s and doc_id is not None:
            nodes[doc_id].append(s)
    up = {i: i for i in nodes}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(nodes)
    for a in ids:
        for b in ids:
            if a < b and any(100 * len(s & t) >= percent * len(s | t) for s in nodes[a] for t in nodes[b]):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return Counter(
        (i, len(s), root(i) if s and i is not None else i, not s or i is None or root(i) == i)
        for (i, _, _), s in zip(rows, sets))


@pytest.mark.parametrize("size", [4, 5])
def test_near_copies_match_brute_force(docs, corpus, size):
    got = rows_of(near_copies.groups(docs, size, 80), "doc_id", "n_shingles", "component_id", "kept")
    assert got == near(corpus, size, 80)


def test_components_of_chains_and_hubs(spark):
    links = [(i, i + 1) for i in range(0, 60)] + [(100, 100 + i) for i in range(1, 40)] + [(7, 7), (200, 201)]
    df = spark.createDataFrame(links, "a long, b long").repartition(5)
    got = {r["node"]: r["component"] for r in components.components(df).collect()}
    assert got == {**{i: 0 for i in range(61)}, **{100 + i: 100 for i in range(40)}, 200: 200, 201: 200}
    assert components.components(df.limit(0)).count() == 0


def test_empty_tables(empty):
    assert superkmer.deduplicate(empty).count() == 0
    assert suffix.deduplicate(empty).count() == 0
    assert near_copies.groups(empty).count() == 0


def test_input_columns_stay_and_clashing_ones_are_replaced(docs):
    done = superkmer.deduplicate(docs)
    assert done.columns == [*[c for c in docs.columns if c != "kept"], "n_words", "n_removed", "kept"]
    assert hashlib.sha256(done.filter("doc_id = 92").first()["kept"].encode()).hexdigest() == hashlib.sha256(b"one two").hexdigest()
