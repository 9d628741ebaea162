"""SimHash groups against plain Python."""
import random
import re

import numpy as np
import pytest
import xxhash

from churnlens.llm import simhash_dedup as m

from samples import ODD, WORDS


def fingerprint(text):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] if len(words) > 2 else [" ".join(words)] * bool(words)
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute(prints, radius=3):
    """component number of each fingerprint by all pairs."""
    parent = list(range(len(prints)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for i, a in enumerate(prints):
        for j in range(i):
            if (a ^ prints[j]).bit_count() <= radius:
                parent[find(i)] = find(j)
    return [find(i) for i in range(len(prints))]


def components(rows):
    prints = [fingerprint(t) for _, t, *_ in rows]
    group = brute(prints)
    low = {}
    for (d, *_), g in zip(rows, group):
        if d is not None:
            low[g] = min(low.get(g, d), d)
    return sorted(((d, f, low.get(g)) for (d, *_), f, g in zip(rows, prints, group)), key=str)


def got(df):
    return sorted(((r.doc_id, r.fp % 2 ** 64, r.component_id) for r in m.simhash_groups(df).collect()), key=str)


@pytest.mark.parametrize("text", [t for _, t in ODD if t] + ["A b C d E", "  a\tb\nc  ", "é É e"])
def test_fingerprint(text):
    assert m.fingerprint(text.encode()) == fingerprint(text)


def test_groups_equal_brute_force(docs):
    rnd = random.Random(1)
    rows, base = [], " ".join(rnd.choice(WORDS) + str(rnd.randrange(99)) for _ in range(900))
    for i in range(60):                                # near copies of long texts link at few bits
        words = base.split()
        for _ in range(i % 5):
            words[rnd.randrange(len(words))] = "changed"
        rows.append((500 - i, " ".join(words)))
    rows += [(1000 + i, " ".join(rnd.choice(WORDS) for _ in range(rnd.randrange(30)))) for i in range(120)]
    want = components(rows)
    assert got(docs(rows)) == want
    assert len({c for _, _, c in want}) < len({f for _, f, _ in want})     # some links join different fingerprints


def near_prints(seed, n):
    """Chains and stars of fingerprints a few bits apart."""
    rnd = random.Random(seed)
    out = [rnd.getrandbits(64) for _ in range(n)]
    for _ in range(3 * n):
        x = rnd.choice(out)
        for _ in range(rnd.randrange(1, 5)):
            x ^= 1 << rnd.randrange(64)
        out.append(x)
    return list(dict.fromkeys([*out, 0, 1, 2 ** 64 - 1, 2 ** 63]))


@pytest.mark.parametrize("split", [4, 8192])
def test_links_and_components(spark, split, monkeypatch):
    monkeypatch.setattr(m, "SPLIT", split)             # small: cells are split
    prints = near_prints(2, 150)
    signed = np.array(prints, np.uint64).view(np.int64).tolist()
    nodes = spark.createDataFrame([(x,) for x in signed], "fp long").repartition(5)
    roots = {r.node: r.root for r in m.components(m.links(nodes, 3)).collect()}
    group = brute(prints)
    want, mine = {}, {}
    for s, g in zip(signed, group):
        want.setdefault(g, set()).add(s)
        mine.setdefault(roots.get(s, s), set()).add(s)
    assert sorted(map(sorted, want.values())) == sorted(map(sorted, mine.values()))


def test_near_cells_are_all_within_reach():
    rnd = random.Random(5)
    for _ in range(300):
        a = rnd.getrandbits(64)
        b = a
        for _ in range(rnd.randrange(4)):
            b ^= 1 << rnd.randrange(64)
        ca, cb = (sum((x >> 48 - 16 * k & 0xFFFF).bit_count() * 17 ** (3 - k) for k in range(4)) for x in (a, b))
        assert ca == cb or cb in m.near_cells(ca, 3) or ca in m.near_cells(cb, 3)


def test_long_chain_is_one_component(spark):
    chain = [(1 << k) - 1 for k in range(0, 64, 3)]
    pairs = [(a, b) for a, b in zip(chain, chain[1:])]
    roots = m.components(spark.createDataFrame(pairs, "a long, b long")).collect()
    assert {r.root for r in roots} == {0} and len(roots) == len(chain) - 1


def test_odd_and_empty(docs, empty):
    assert got(docs(ODD, extra=True)) == components(ODD)
    assert m.simhash_groups(empty).count() == 0 and m.one_of_each_group(empty).count() == 0


def test_one_row_of_each_group(docs):
    rows = ODD + [(90, "one"), (91, "a whole other text of several words"), (91, "another of the same id"),
                  (92, "a whole other text of several words")]
    kept = sorted((r.doc_id is None, r.doc_id or 0, r.text or "") for r in m.one_of_each_group(docs(rows, extra=True)).collect())
    prints = [fingerprint(t) for _, t in rows]
    groups = {}
    for (d, t), g in zip(rows, brute(prints)):
        groups.setdefault(g, []).append((d is None, d or 0, fingerprint(t), t or ""))
    assert len(kept) == len(groups)
    assert {(a, b) for a, b, _ in kept} == {min(v)[:2] for v in groups.values()}
    assert m.one_of_each_group(docs(rows, extra=True)).columns == docs(rows, extra=True).columns


def test_hot_group_of_copies(docs):
    rows = [(i, "the same short text in very many documents") for i in range(3000)] + [(5000 + i, f"text {i} {i * 7} {i * 11}") for i in range(50)]
    out = m.one_of_each_group(docs(rows))
    assert out.where("doc_id < 3000").count() == 1
