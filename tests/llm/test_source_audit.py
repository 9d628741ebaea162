"""Source divergence against plain Python; refinement of prefixes."""
import re
from collections import Counter, defaultdict

import pytest

from churnlens.llm import prefilter
from churnlens.llm import source_audit as m

from samples import ODD


def terms(text):
    return [re.sub("[A-Z]", lambda x: x[0].lower(), t) for t in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")]


def plain(rows, threshold=3, most=200):
    where, count, groups = defaultdict(set), Counter(), set()
    for d, t, lang, source in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        for x in terms(t):
            where[lang, x].add(d)
            count[lang, source, x] += 1
    out = []
    for lang in {g for g, _ in groups}:
        kept = sorted(x for (g, x), ids in where.items() if g == lang and len(ids) >= threshold)
        sources = sorted(s for g, s in groups if g == lang)
        n = {s: sum(count[lang, s, x] for x in kept) for s in sources}
        share = {s: {x: 1 + 10**9 * (count[lang, s, x] + 1) // (n[s] + len(kept)) for x in kept} for s in sources}
        both = {x: 1 + 10**9 * (sum(count[lang, s, x] for s in sources) + 1) // (sum(n.values()) + len(kept)) for x in kept}
        f = lambda p, q: (p - q) ** 2 // q
        for s in sources:
            pairs = [(sum(f(share[s][x], share[o][x]) for x in kept), o) for o in sources if o != s]
            over = [(f(share[s][x], both[x]), x) for x in kept if count[lang, s, x] and share[s][x] > both[x]]
            for part, found, limit in (("pair", pairs, None), ("term", over, most)):
                ranked = sorted(found, key=lambda r: (-r[0], r[1].encode()))[:limit]
                out += [(lang, s, part, i, v, k + 1) for k, (v, i) in enumerate(ranked)]
    return sorted(out)


def result(df):
    return sorted((r.lang, r.source, r.part, r.item, r.value, r.rank) for r in df.collect())


def full(rows):
    return [[*r, *(["en", "src0"][len(r) - 2:])][:4] for r in rows]


def corpus(prose):
    rows = [(i, prose(20 + i % 50, seed=i), ["en", "de"][i % 2], "hot" if i % 3 else f"s{i % 7}") for i in range(120)]
    rows += [(200 + i, "incomprehensibilities" + "abcdefgh"[i % 8] * (i % 4), "en", f"s{i % 3}") for i in range(30)]
    rows += [(300, "alone", "xx", "a"), (301, "", "xx", "b"), (302, None, None, None), (303, "Émile ünd ŒUVRE", "fr", None)]
    rows += [(304 + i, "Émile ÉMILE émile ünd", "fr", "f") for i in range(3)]
    return rows + [(307, "same id", "id", "q")] * 5 + [(None, "no id", "id", "q")] * 4


@pytest.mark.parametrize("first, side, tile, held, words, bucket", [(8, 256, 1_000_000, 500_000, 1_000_000, 100_000), (1, 2, 6, 7, 20, 9)])
def test_against_plain_python(docs, prose, monkeypatch, first, side, tile, held, words, bucket):
    for name, value in (("FIRST_LEVEL", first), ("SIDE", side), ("TILE", tile), ("HELD", held), ("WORDS", words), ("BUCKET", bucket)):
        monkeypatch.setattr(m, name, value)
    rows = corpus(prose)
    assert result(m.source_audit(docs(rows, extra=True), most=15)) == plain(rows, most=15)


def test_prefixes_are_refined_and_discarded(spark, docs):
    rows = docs([(i, f"shared{'ab'[i % 2]} rare{'abcdefghijkl'[i]} {'abcdefghijkl'[i]}own zz", "en", "a") for i in range(12)])
    rows = rows.selectExpr("doc_id AS doc", "text", "lang", "source", "0L AS slot")
    level = m._level(rows, 3, 0, None, None, 3)
    assert {bytes(r.key) for r in level.collect() if r.open} == {b"sha", b"rar"}
    one = spark.createDataFrame([(m._slot("en", b"sha"),)], "slot long")
    kept = spark.sparkContext.broadcast(prefilter.bitmap(one))
    got = m._level(rows, 7, 3, kept, None, 1).collect()
    assert {bytes(r.key) for r in got} == {b"shareda", b"sharedb"} and {r.n for r in got} == {6}


def test_a_full_filter_changes_nothing(docs, prose, monkeypatch):
    rows, real = corpus(prose), prefilter.bitmap
    full_one = m.np.full((1 << prefilter.BITS) // 8, 255, m.np.uint8)
    monkeypatch.setattr(m.prefilter, "bitmap", lambda slots: full_one if real(slots).any() else real(slots))
    assert result(m.source_audit(docs(rows))) == plain(rows)


def test_counts_past_64_bits(spark):
    big = spark.createDataFrame([(4 * 10**18, 5 * 10**18, 7)], "n long, words long, terms long")
    p = big.select(m._share(m.F.col("n"), m.F.col("words"), m.F.col("terms")).alias("p")).first().p
    assert p == 1 + 10**9 * (4 * 10**18 + 1) // (5 * 10**18 + 7)


def test_bitmap(spark):
    slots = [0, 1, 32767, 32768, (1 << prefilter.BITS) - 1]
    bits = prefilter.bitmap(spark.createDataFrame([(s,) for s in slots], "slot long"))
    assert prefilter.has(bits, m.np.array([*slots, 2, 32766, 32769])).tolist() == [True] * 5 + [False] * 3
    assert m.np.unpackbits(bits).sum() == 5


def test_odd_and_empty(odd, empty):
    assert result(m.source_audit(odd)) == plain(full(ODD))
    assert m.source_audit(empty).count() == 0


@pytest.mark.parametrize("words", [3, 1_000_000])
def test_first_level_as_arrays_counts_like_the_words_one_by_one(prose, monkeypatch, words):
    monkeypatch.setattr(m, "WORDS", words)
    texts = [prose(30, seed=i) for i in range(20)] + ["", "  ", "été abcdefgh abcdefghi abcdefgh ÉÉÉÉÉ 日本語日本語", "a\0b A"]
    counted = []
    for held in (m._Held(8, 0, None), m._HeldFirst(8, 0, None)):
        for i, t in enumerate(texts):
            held.add("en" if i % 2 else "", f"s{i % 3}", i % 4 or None, t.encode())
        batch, again = held.rows(), held.rows()
        assert again.num_rows == 0
        counted.append(sorted(map(str, batch.to_pylist())))
    assert counted[0] == counted[1]


def test_first_level_numbers_only_different_keys(monkeypatch):
    """Words are not looked up one by one."""
    asked = []
    real = m._Numbers.__missing__
    monkeypatch.setattr(m._Numbers, "__missing__", lambda self, v: asked.append(v) or real(self, v))
    held = m._HeldFirst(8, 0, None)
    held.add("en", "s", None, b"one two one two one " * 1000)
    batch = held.rows()
    assert len(asked) == 2 and sorted(batch.column("n").to_pylist()) == [2000, 3000]
