"""Decontamination against a plain search over all windows."""
import random
import string
from collections import Counter

import numpy as np
import pytest

from churnlens.llm import decontaminate as m

from samples import ODD


def words(text):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [w for w in (x.strip(string.punctuation) for x in text.encode().split() and [y.decode() for y in text.encode().split()]) if w]


def grams(w, n):
    return [tuple(w[i:i + n]) for i in range(len(w) - n + 1)]


def plain(rows, items, threshold=0.8):
    """(doc_id, item_id) -> best similarity over all windows."""
    out = {}
    for d, t, *_ in rows:
        for k, y in items:
            item = words(y)
            if not item:
                continue
            n = min(m.SHINGLE, len(item))
            want, all_ = Counter(grams(item, n)), grams(words(t), n)
            size = min(sum(want.values()), len(all_))
            best = 0
            for s in range(len(all_) - size + 1 if all_ else 0):
                both = sum((Counter(all_[s:s + size]) & want).values())
                best = max(best, both / (size + sum(want.values()) - both))
            if best >= threshold:
                out[d, k] = max(best, out.get((d, k), 0))
    return out


@pytest.fixture
def bench(spark):
    return lambda items: spark.createDataFrame(items, "item_id long, text string")


def got(df, items, **options):
    out = {}
    for r in df.select("doc_id", "text", m.contamination(items, **options).alias("hits")).collect():
        for h in r.hits:
            out[r.doc_id, h.item_id] = max(h.similarity, out.get((r.doc_id, h.item_id), 0))
    return out


def planted(prose):
    rnd = random.Random(6)
    items = [(i, prose(20 + i * 3, seed=1000 + i)) for i in range(12)] + [(50, "three short words"), (51, ""), (52, None), (None, prose(30, seed=77))]
    rows = [(i, prose(120, seed=i)) for i in range(30)]
    for i in range(30):
        w = items[i % 12][1].split()
        for _ in range(i // 12):                       # up to two changed words
            w[rnd.randrange(len(w))] = "other"
        text = " ".join(w).upper() if i % 4 == 0 else " ".join(w)
        rows.append((100 + i, f"{prose(50, seed=500 + i)} and {text}!! then {prose(40, seed=600 + i)}"))
    rows += [(200, items[3][1]), (201, "so three short words here"), (202, prose(30, seed=77)), (203, items[5][1] + " " + items[5][1])]
    return rows, items


def test_equals_plain_search(docs, bench, prose):
    rows, items = planted(prose)
    want = plain(rows, items)
    found = got(docs(rows, extra=True), bench(items))
    assert found == {k: pytest.approx(v) for k, v in want.items()}
    assert {d for d, _ in want} >= {200, 201, 202, 203, *range(100, 112)} and not any(d < 100 for d, _ in want)


def test_blocks_of_items_change_nothing(docs, bench, prose, monkeypatch):
    rows, items = planted(prose)
    whole = got(docs(rows), bench(items))
    monkeypatch.setattr(m, "ITEM_BYTES", 500)
    assert len(m.item_blocks(bench(items))) > 3 and got(docs(rows), bench(items)) == whole


def test_spans(docs, bench, prose):
    item = prose(40, seed=5)
    text = "Ä é " + prose(20, seed=6) + "\n(" + item + ") " + prose(20, seed=7)
    hit = docs([(1, text)]).select(m.contamination(bench([(9, item)])).alias("h")).first().h[0]
    assert text[hit.start:hit.end].strip("().") == item.strip(".") and hit.similarity == 1.0


def flipped(rnd, prints, most):
    """Copies of fingerprints with up to ``most`` bits changed."""
    out = prints.copy()
    for row in out:
        for b in rnd.choice(m.BITS, int(rnd.integers(0, most + 1)), replace=False):
            row[b // 32] ^= np.uint32(1 << int(b % 32))
    return out


def pairs(tiles):
    return [p for *_, w, i in tiles for p in zip(w.tolist(), i.tolist())]


@pytest.mark.parametrize("tile", [1 << 20, 64])
def test_hamming_blocks_find_all(monkeypatch, tile):
    monkeypatch.setattr(m, "TILE", tile)
    rnd = np.random.default_rng(4)
    prints = rnd.integers(0, 2 ** 32, (50, m.BLOCKS), np.uint32)
    prints[40:] = prints[:10]                                   # equal items
    windows = np.concatenate([flipped(rnd, prints[rnd.integers(0, 50, 400)], 60), prints[:5], prints[:5]])
    far = np.bitwise_count(windows[:, None] ^ prints[None]).sum(axis=2)
    for radius in (0, 2, 15, 39, 60):
        found = pairs(m.HammingBlocks(prints, radius).find(windows))
        assert len(found) == len(set(found))
        assert set(found) == set(zip(*(x.tolist() for x in np.nonzero(far <= radius))))


def test_the_index_is_selective():
    rnd = np.random.default_rng(5)
    prints, windows = (rnd.integers(0, 2 ** 32, (k, m.BLOCKS), np.uint32) for k in (1000, 2000))
    index = m.HammingBlocks(prints, m.RADIUS)
    assert len(set(pairs(index.candidates(windows)))) < 0.05 * 2_000_000
    assert len(pairs(index.find(windows))) < 200


def test_many_items_that_share_a_phrase_with_a_long_text(prose):
    """A text that repeats a phrase of all items: no memory for windows x items."""
    import tracemalloc
    phrase = "one phrase that all hold"
    items = [(k, f"{prose(18, seed=k)} {phrase} {prose(17, seed=9000 + k)}".encode()) for k in range(2000)]
    text = " ".join(f"{phrase} {prose(3, seed=70_000 + k)}" for k in range(6000)) + " " + items[77][1].decode()
    looked = m.Items(items, 0.8, m.RADIUS)
    tracemalloc.start()
    hits = looked.search(text.encode())
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(text) > 240_000 and [h["item_id"] for h in hits] == [77] and hits[0]["similarity"] == 1.0
    assert peak < 200e6


def test_odd_and_empty(odd, empty, bench, prose):
    items = bench([(1, "one"), (2, "no id here at all"), (3, prose(30))])
    found = got(odd, items)
    assert found == plain(ODD, [(1, "one"), (2, "no id here at all")])
    assert m.decontaminate(odd, items).columns == odd.columns
    assert m.decontaminate(odd, items).count() == len(ODD) - 4
    assert m.decontaminate(odd, items.where("false")).count() == len(ODD)
    assert m.decontaminate(empty, items).count() == 0
