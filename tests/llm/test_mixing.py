"""Mixing against plain Python: sharing by weight, Sainte-Lague seats, whole texts."""
import random

import pytest
from pyspark.sql import functions as F

from churnlens.llm import mixing as m

from samples import ODD


def shares(sizes, budget=1.5, repeat=2, weights=(5, 2, 1)):
    """Share by weight, stop what is above its cap, share the rest again."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, full = budget * sum(sizes.values()), {}
    while True:
        left = total - sum(full.values())
        open_w = sum(w[s] for s in order if s not in full)
        t = {s: full.get(s, left * w[s] / open_w if open_w else 0) for s in order}
        over = [s for s in order if s not in full and t[s] > repeat * sizes[s]]
        if not over:
            return t
        full |= {s: repeat * sizes[s] for s in over}


def seats(weights, n):
    """Highest quotients, one seat at a time."""
    won = [0] * len(weights)
    for _ in range(n if sum(weights) else 0):
        k = max(range(len(weights)), key=lambda i: (weights[i] / (2 * won[i] + 1), -i))
        won[k] += 1
    return won


@pytest.mark.parametrize("seed", range(6))
def test_sainte_lague(spark, seed):
    rnd = random.Random(seed)
    weights = [rnd.choice([0, 1, 7, 53, 340, 8000]) * rnd.random() for _ in range(rnd.randrange(1, 30))]
    n = rnd.choice([0, 1, 5, 40, 333])
    df = spark.createDataFrame(list(enumerate(weights)), "k long, w double")
    got = {r.k: r.quota for r in m.sainte_lague(df, [], "w", "k", F.lit(n)).collect()}
    assert [got[k] for k in range(len(weights))] == seats(weights, n)


def test_targets(spark):
    rnd = random.Random(7)
    for case in range(5):
        sizes = {f"s{i:02d}": rnd.choice([0, 3, 100, 5000, 90_000]) for i in range(rnd.randrange(1, 12))}
        sizes |= {None: 44} if case % 2 else {}
        if not sum(sizes.values()):
            continue
        df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
        got = {r.source: r.target for r in m.source_targets(df, 1.5, 2, (5, 2, 1)).collect()}
        want = shares(sizes)
        assert got == {s: pytest.approx(t) for s, t in want.items()}


def sample(prose):
    rows = [(i, prose(30 + i % 90, seed=i), "en", f"src{i % 4}" if i % 3 else "hot") for i in range(150)]
    return [*rows, (150, "", "en", "hot"), (151, None, "en", None), (152, "just four words here", "en", None)]


@pytest.mark.parametrize("shard_words", [500, 8_000_000])
def test_mix(docs, prose, shard_words):
    rows = sample(prose)
    out = m.mix_sources(docs(rows, extra=True), shard_words=shard_words, block=8)
    got = {r.row.doc_id: r for r in out.collect()}
    size = {d: len((t or "").split()) for d, t, *_ in rows}
    of = {s: sum(size[d] for d, _, _, x in rows if x == s) for s in {r[3] for r in rows}}
    want = shares(of)
    assert len(got) == len(rows)
    for d, _, _, s in rows:
        r = got[d]
        assert (r["size"], r.source_size) == (size[d], of[s]) and r.target == pytest.approx(want[s])
        assert 0 <= r.taken <= 2 * size[d]
    for s in of:
        taken = sum(got[d].taken for d, _, _, x in rows if x == s)
        shards = max(1, -(-of[s] // shard_words))
        assert abs(taken - want[s]) <= 8 * (2 + 2 * shards)
    again = {r.row.doc_id: r.taken for r in m.mix_sources(docs(rows).repartition(7), shard_words=shard_words, block=8).collect()}
    assert again == {d: r.taken for d, r in got.items()}
    other = {r.row.doc_id: r.taken for r in m.mix_sources(docs(rows), seed=5, shard_words=shard_words, block=8).collect()}
    assert other != again


def test_small_sources_get_their_share(docs, prose):
    """Sources below a block, with the production block: near the target, and the whole total."""
    size = {"a": 4, "b": 20, "c": 31, "d": 63, "e": 5000}
    rows = [(i, prose(n, seed=i), "en", s) for i, (s, n) in enumerate(size.items())]
    got = m.mix_sources(docs(rows)).collect()
    want = shares(size)
    for r in got:
        assert abs(r.taken - want[r.row.source]) <= 64 and r.taken <= 2 * r["size"]
    many = {f"s{i:04d}": 20 for i in range(2000)}
    want = shares(many)
    rows = [(i, prose(20, seed=i % 50), "en", s) for i, s in enumerate(many)]
    got = m.mix_sources(docs(rows)).collect()
    assert all(abs(r.taken - want[r.row.source]) <= 40 for r in got)
    assert abs(sum(r.taken for r in got) - 60_000) <= 64


@pytest.mark.parametrize("seed", range(2))
def test_capped_seats(spark, seed):
    """The highest quotients among those that a party can hold."""
    rnd = random.Random(seed)
    caps = [rnd.choice([1, 1, 1, 2, 40, 700]) for _ in range(60)]
    weights = [c * rnd.choice([1.0, 0.4, 0.4, 0.75]) for c in caps]
    offers = sorted(((-w / (2 * k - 1), i, k) for i, (w, c) in enumerate(zip(weights, caps)) for k in range(1, c + 1)))
    won = [0] * len(caps)
    for _, i, _ in offers[:int(sum(weights) + 0.5)]:
        won[i] += 1
    df = spark.createDataFrame(list(zip(range(len(caps)), weights, caps)), "k long, w double, c long")
    assert [r.quota for r in sorted(m.capped_seats(df, "w", "k", "c").collect())] == won


def test_a_block_comes_twice_only_when_all_came_once(docs, prose):
    rows = [(i, prose(64, seed=i), "en", "b" if i else "a") for i in range(40)]
    taken = [r.taken for r in m.mix_sources(docs(rows), block=64).collect() if r.row.doc_id]
    assert max(taken) <= 64 * 2 and min(taken) >= 64 - 64      # budget 1.5: every word once, half of them twice
    assert sum(t >= 64 for t in taken) >= 38


def test_texts_hold_the_words_taken(docs, prose):
    rows = sample(prose)
    df = docs(rows, extra=True)
    taken = {r.row.doc_id: r.taken for r in m.mix_sources(df).collect()}
    texts = m.mixed_texts(df)
    assert texts.columns == df.columns
    words = {}
    for r in texts.collect():
        assert r.n_chars == len(r.text)
        words[r.doc_id] = words.get(r.doc_id, 0) + len(r.text.split())
        original = dict((d, t) for d, t, *_ in rows)[r.doc_id]
        assert all(part in original for part in r.text.split("\n"))
    assert words == {d: t for d, t in taken.items() if t}


def test_odd_and_empty(odd, empty):
    assert m.mix_sources(odd).count() == len(ODD)
    assert m.mix_sources(empty).count() == 0 and m.mixed_texts(empty).count() == 0
    assert m.mixed_texts(odd).columns == odd.columns
