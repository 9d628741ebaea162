"""Collocations against plain Python; quotient filters give back what went in."""
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from churnlens.llm import collocations as m
from churnlens.llm import quotient_filter as qf

from samples import ODD

U = np.uint64


def plain(rows, least=10, most=2000):
    f, n = Counter(), Counter()
    for _, text, lang, _ in rows:
        lang = lang or "und"
        low = re.sub("[A-Z]", lambda x: x[0].lower(), text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in (1, 2, 3):
                f.update((lang, *words[i:i + k]) for i in range(len(words) - k + 1))
    candidates = {g: a for g, a in f.items() if len(g) > 2 and a >= least}
    out = {}
    for (lang, *w), a in candidates.items():
        if any(100 * candidates.get((lang, *t), 0) >= 50 * a for t in
               {g[1:] for g in candidates if len(g) == 4 and g[0] == lang and len(w) == 2 and (list(g[1:3]) == w or list(g[2:4]) == w)}):
            continue
        score, _, l, r = min((10**6 * a * a // (f[lang, *w[:k]] * f[lang, *w[k:]]), k, f[lang, *w[:k]], f[lang, *w[k:]])
                             for k in range(1, len(w)))
        out.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), l, r))
    return sorted((lang, k + 1, p.decode(), -a, l, r, n[lang], -s) for lang, found in out.items()
                  for k, (s, a, p, l, r) in enumerate(sorted(found)[:most]))


def result(df):
    return sorted((r.lang, r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in df.collect())


def full(rows):
    return [[*r, *(["en", "src0"][len(r) - 2:])][:4] for r in rows]


def corpus(prose):
    rows = [(i, prose(300, seed=i).replace("7", "").replace("1", "") + "\nNew York City, new york!", ["en", "de", None][i % 3]) for i in range(40)]
    rows += [(100 + i, "a a a a a b; a b\x0cA\tB  c\x0bd", "xx") for i in range(9)]
    rows += [(200, "und so weiter und so weiter " * 12, "und"), (201, "ÄÖ Über ÄÖ Über\r" * 11, "de")]
    return rows + [(300, "never twice", "yy")] * 9


@pytest.mark.parametrize("words, lexicon, entries", [(1_000_000, 300_000, 2_000_000), (50, 20, 16)])
def test_against_plain_python(docs, prose, monkeypatch, words, lexicon, entries):
    for name, value in (("SEGMENT_WORDS", words), ("SEGMENT_LEXICON", lexicon), ("SHARD_ENTRIES", entries)):
        monkeypatch.setattr(m, name, value)
    rows = corpus(prose)
    assert result(m.collocations(docs(rows, extra=True), most=150)) == plain(full(rows), most=150)


def test_scores_past_64_bits(spark):
    big = spark.createDataFrame([(3 * 10**12, 4 * 10**12, 5 * 10**12)], "a long, l long, r long")
    got = big.select(m._score(m.F.col("a"), m.F.col("l"), m.F.col("r")).alias("s")).first().s
    assert got == 10**6 * 9 * 10**24 // (20 * 10**24)


@st.composite
def filters(draw):
    bits = draw(st.integers(2, 42))
    words = draw(st.lists(st.tuples(*[st.integers(0, (1 << bits) - 1)] * 3), min_size=0, max_size=60))
    counts = draw(st.lists(st.sampled_from([1, 2, 254, 255, 256, 10**12]), min_size=len(words), max_size=len(words)))
    return bits, words, counts, draw(st.integers(0, min(6, qf.half_bits(bits) - 1)))


@given(filters())
@settings(max_examples=500, deadline=None)
def test_filters_lose_nothing(case):
    bits, words, counts, shard_bits = case
    grams = np.array(words, np.int64).reshape(-1, 3)
    packed = qf.pack(grams, bits)
    assert (qf.unpack(*packed, bits) == grams).all()
    spread = qf.permute(*packed, bits)
    assert all((x >> U(qf.half_bits(bits)) == 0).all() for x in spread)
    assert all((x == y).all() for x, y in zip(qf.restore(*spread, bits), packed))
    left, right, n = qf.summed(*spread, np.array(counts, np.int64))
    shard = (left >> U(qf.half_bits(bits) - shard_bits)).astype(int)
    back = Counter()
    for s in set(shard.tolist()):
        mine = shard == s
        merger = qf.Merger(bits, shard_bits, s)
        for some in (mine & (np.arange(len(n)) % 2 == k) for k in (0, 1)):      # two filters of the shard, merged twice over
            for _ in range(2):
                merger.add(qf.encode(left[some], right[some], n[some], bits, shard_bits))
        a, b, c = merger.settle()
        back.update({tuple(w): int(x) for w, x in zip(qf.unpack(*qf.restore(a, b, bits), bits).tolist(), c)})
    want = Counter()
    for w, c in zip(words, counts):
        want[tuple(w)] += 2 * c
    assert back == want


def test_filters_are_compact():
    rng = np.random.default_rng(5)
    grams = rng.integers(1, 1 << 20, (200_000, 3))
    left, right, n = qf.summed(*qf.permute(*qf.pack(grams, 20), 20), np.ones(len(grams), np.int64))
    shards = np.bincount((left >> U(26)).astype(int), minlength=16)
    assert shards.max() < 1.05 * shards.mean()
    size = sum(len(qf.encode(*(x[left >> U(26) == s] for x in (left, right, n)), 20, 4)) for s in range(16))
    assert size < 8 * len(n)        # 60 bits of key and a count


def test_odd_and_empty(odd, empty, monkeypatch):
    assert result(m.collocations(odd)) == plain(full(ODD))
    assert result(m.collocations(odd, least=1)) == plain(full(ODD), least=1)
    assert m.collocations(empty).count() == 0
