"""Line dedup, the perfect hash and substring dedup against plain Python."""
import random
import re
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from churnlens.llm.line_dedup import line_dedup
from churnlens.llm.line_index import PerfectHash
from churnlens.llm.substring_dedup import repeated_spans, substring_dedup, units

from samples import ODD

BLANK = " \t\n\v\f\r"


def key_of(line):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(BLANK))


def brute_lines(rows, min_chars=40, min_docs=5):
    held = defaultdict(set)
    rank = lambda d: -(1 << 63) if d is None else d
    for doc, text, *_ in rows:
        for line in (text or "").split("\n"):
            held[key_of(line)].add(rank(doc))
    hot = {k: max(v) for k, v in held.items() if len(k) >= min_chars and len(v) >= min_docs}
    out = []
    for doc, text, *_ in rows:
        lines = (text or "").split("\n")
        keep = [x for x in lines if hot.get(key_of(x), rank(doc)) == rank(doc)]
        out.append((doc, len(lines), len(lines) - len(keep), "\n".join(keep)))
    return sorted(out, key=str)


def got_lines(df, **options):
    return sorted(((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in line_dedup(df, **options).collect()), key=str)


@given(st.sets(st.tuples(st.integers(0, 2 ** 64 - 1), st.integers(0, 2 ** 64 - 1)), max_size=300))
@settings(max_examples=50, deadline=None)
def test_perfect_hash_is_minimal(keys):
    keys = sorted(keys)
    hi, lo = (np.array([k[i] for k in keys], np.uint64) for i in (0, 1))
    slots = PerfectHash(hi, lo).slots(hi, lo)
    assert sorted(slots.tolist()) == list(range(len(keys)))


def test_perfect_hash_of_many_keys():
    rnd = np.random.default_rng(1)
    hi, lo = (rnd.integers(0, 2 ** 63, 100_000).astype(np.uint64) for _ in range(2))
    lo[:1000] = lo[0]                                   # keys that share one half
    assert np.array_equal(np.sort(PerfectHash(hi, lo).slots(hi, lo)), np.arange(len(hi)))


def test_line_dedup_equals_brute_force(docs):
    rnd = random.Random(3)
    pool = [f"{'Shared line number ' if i % 2 else 'Été partagé numéro '}{i} with enough characters to count" for i in range(12)]
    rows = []
    for d in range(9000, 9060):                        # spans two blocks of ids
        lines = [rnd.choice(pool) for _ in range(rnd.randrange(6))] + [f"own line {d} that is long enough to be a key of its own"]
        lines += ["  " + rnd.choice(pool).upper().replace("É", "é") + "\t", "short"]
        rnd.shuffle(lines)
        rows.append((d * 7, "\n".join(lines)))
    assert got_lines(docs(rows)) == brute_lines(rows)
    assert got_lines(docs(rows), min_chars=60, min_docs=9) == brute_lines(rows, 60, 9)


def test_a_line_held_by_almost_all(docs):
    rows = [(i, "The very same line that a large share of all documents hold\n" + f"tail {i}") for i in range(300)]
    out = {r[0]: r for r in got_lines(docs(rows))}
    assert out[299][2] == 0 and all(out[i][2] == 1 and out[i][3] == f"tail {i}" for i in range(299))


def test_ids_of_any_size(docs):
    line = "A line of more than forty characters, repeated everywhere"
    ids = [-(1 << 62) - 5, -4097, -1, 0, 4095, (1 << 53) + 1, (1 << 62) + 4095, (1 << 62) + 4096, (1 << 63) - 1]
    rows = [(i, f"{line}\nown {i}") for i in ids]
    assert got_lines(docs(rows)) == brute_lines(rows)


def test_repeated_rows_are_one_document(docs):
    line = "A line of more than forty characters, repeated everywhere"
    rows = [(i, line) for i in (1, 2, 3, 4)] + [(4, line)] * 3
    assert got_lines(docs(rows)) == brute_lines(rows)            # four documents: not enough
    rows += [(5, line), (5, line)]
    assert got_lines(docs(rows)) == brute_lines(rows)
    assert sum(r[2] for r in got_lines(docs(rows))) == 7


@pytest.mark.parametrize("op", [line_dedup, substring_dedup])
def test_odd_and_empty_tables(odd, empty, op):
    assert op(odd).count() == len(ODD)
    assert op(empty).count() == 0


def test_odd_lines(docs):
    assert got_lines(docs(ODD, extra=True)) == brute_lines(ODD)


HOT = "A line that a third of all documents hold, wherever their ids lie"


def far_apart(spark, n):
    """n documents with ids far apart; every third holds HOT, all hold a line of their own."""
    return spark.range(n, numPartitions=4).selectExpr(
        "xxhash64(id) AS doc_id",
        f"concat(if(id % 3 = 0, '{HOT}\\n', ''), 'own line of document ', id, ' with more than forty characters') AS text")


def records_of_calls(spark, n, monkeypatch):
    """The records of HOT in the largest call of a shard, and the heavy digests."""
    from churnlens.llm import exchange
    from churnlens.llm.line_dedup import RECORD, line_digests
    seen = {}

    def keep(summary, hot, shrink, dtype, whole=exchange._of_heavy):
        seen["hot"], seen["merged"] = hot, whole(summary, hot, shrink, dtype)
        return seen["merged"]

    def rest(summary, hot, dtype, whole=exchange._without):
        seen["rest"] = whole(summary, hot, dtype)
        return seen["rest"]
    monkeypatch.setattr(exchange, "_of_heavy", keep)
    monkeypatch.setattr(exchange, "_without", rest)
    out = line_dedup(far_apart(spark, n))
    monkeypatch.undo()
    want = np.frombuffer(line_digests(HOT.encode(), 40)[0], "<u8")[0]

    def most(df):
        held = {}
        for r in df.collect():
            got = np.frombuffer(bytes(r.payload), RECORD)
            held[r.shard] = held.get(r.shard, 0) + int((got["hi"] == want).sum())
        return max(held.values(), default=0)
    return out, seen["hot"], most(seen["merged"]), most(seen["rest"])


@pytest.mark.parametrize("n", [6_000, 24_000])
def test_a_hot_line_with_ids_far_apart_is_split(spark, monkeypatch, n):
    out, hot, merged, rest = records_of_calls(spark, n, monkeypatch)
    assert len(hot) == 1 and rest == 0
    assert merged <= 6 * 8                                # six a chunk, whatever n is
    assert out.agg({"n_dropped": "sum"}).first()[0] == n // 3 - 1
    last = far_apart(spark, n).where(f"text LIKE '{HOT}%'").agg({"doc_id": "max"}).first()[0]
    assert [r.doc_id for r in out.where(f"n_lines = 2 AND n_dropped = 0").collect()] == [last]


def test_heavy_digests_against_counts(spark, monkeypatch):
    from churnlens.llm import exchange
    from churnlens.llm.line_dedup import RECORD
    rnd = np.random.default_rng(8)
    monkeypatch.setattr(exchange, "HELD", 500)            # taken along in the closures of the test
    hi = np.minimum(rnd.zipf(1.3, 20_000), 5_000).astype(np.uint64) << np.uint64(40)
    rows = []
    for k in range(0, len(hi), 50):
        r = np.zeros(50, RECORD)
        r["hi"], r["doc"] = hi[k:k + 50], np.arange(k, k + 50)
        rows.append((0, k, 50, bytearray(r.tobytes())))
    df = spark.createDataFrame(rows, exchange._PACKED).repartition(4)
    shards = exchange._shards(spark)
    keys, n = np.unique(hi, return_counts=True)
    hot = exchange.heavy(df, RECORD)
    assert len(hot) <= shards and set(hot) <= set(keys[n >= len(hi) / shards])
    assert set(hot) >= set(keys[n >= 2 * len(hi) / shards + 2 * (len(hi) / 500 + 4)])
    left = sum(r.n for r in exchange._without(df, hot, RECORD).collect())
    assert left == int(n[~np.isin(keys, hot)].sum())


def test_a_hot_passage_with_ids_far_apart(docs, prose):
    passage = prose(60, seed=9)
    rows = [(i * 1_000_003 * (-1) ** i, f"{prose(30, seed=100 + i)} own{i} {passage if i % 3 == 0 else ''} {prose(30, seed=900 + i)}")
            for i in range(400)]
    spans = got_spans(docs(rows))
    assert spans == brute_spans(rows)
    first = min(d for d, t in rows if passage in t)
    assert len(spans) == len([d for d, t in rows if passage in t]) - 1 and {s[4] for s in spans} == {first}


# --- substring dedup ---------------------------------------------------------
def brute_spans(rows, min_words=25):
    first = {}
    order = sorted(((d, p, u[3]) for d, t in rows for p, u in enumerate(units((t or "").encode()))))
    for d, p, digest in order:
        first.setdefault(digest, (d, p))
    return sorted((d, *s) for d, t in rows for s in repeated_spans(d, (t or "").encode(), first, min_words))


def got_spans(df, **options):
    return sorted((r.doc_id, s.start, s.end, s.n_words, s.first_doc_id)
                  for r in substring_dedup(df, **options).collect() for s in r.spans)


def test_units_cover_all_words():
    text = "One two. Three four five six seven! Eight\nnine ten eleven twelve thirteen. Fourteen.\n\n  \nend"
    u = units(text.encode())
    assert sum(x[2] for x in u) == len(text.split())
    assert all(text[a:b].split() for a, b, *_ in u)
    assert [text[a:b] for a, b, *_ in u][0] == "One two. Three four five six seven!"


def test_passages_in_the_middle_of_lines(docs, prose):
    passage = prose(60, seed=9)
    rows = [(i, f"{prose(40, seed=100 + i)} own{i} {passage} {prose(30, seed=200 + i)}") for i in range(6)]
    rows += [(50 + i, prose(90, seed=300 + i)) for i in range(6)]
    spans = got_spans(docs(rows))
    assert {s[0] for s in spans} == {1, 2, 3, 4, 5} and all(s[4] == 0 for s in spans)
    assert spans == brute_spans(rows)
    for doc, start, end, *_ in spans:
        cut = dict(rows)[doc][start:end]
        assert cut in passage and len(cut.split()) >= 45


def test_substring_texts_and_offsets(docs, prose):
    passage = prose(55, seed=1).replace("alder", "ålder")
    rows = [(1, "É " + passage + "\nend of the first"), (2, "Ünique words here.\n" + passage.upper().lower() + "\nkept tail")]
    out = {r.doc_id: r for r in substring_dedup(docs(rows)).collect()}
    assert out[1].spans == [] and out[1].text == rows[0][1]
    assert len(out[2].spans) == 1
    s, text = out[2].spans[0], rows[1][1]
    assert out[2].text == text[:s.start] + text[s.end:] and "kept tail" in out[2].text


def test_short_common_lines_stay(docs, prose):
    rows = [(i, f"All rights reserved by nobody in particular.\n{prose(80, seed=i)}") for i in range(40)]
    assert got_spans(docs(rows)) == []


def test_many_copies_keep_the_first(docs, prose):
    text = prose(70, seed=4)
    rows = [(i, text) for i in range(5000, 4000, -3)]
    spans = got_spans(docs(rows))
    assert len(spans) == len(rows) - 1 and {s[4] for s in spans} == {min(d for d, _ in rows)}


def repeated_words(rows, n=51):
    """For each document whether each word is in a window of n words that an earlier one has."""
    first, out = {}, {}
    for doc, text in sorted(rows):
        words = text.lower().split()
        flags = [False] * len(words)
        grams = [" ".join(words[k:k + n]) for k in range(len(words) - n + 1)]
        for k, g in enumerate(grams):
            if first.setdefault(g, doc) != doc:
                flags[k:k + n] = [True] * n
        out[doc] = flags
    return out


@pytest.mark.parametrize("clause", [10, 45, 10_000])
def test_passages_cut_anywhere_against_all_windows(docs, clause):
    """Loss for each passage and each word, with clauses of 10 and 45 words and without marks."""
    rnd = random.Random(clause)

    def words(n):
        made = [f"{rnd.choice('bcdfgh')}{rnd.randrange(3000)}" for _ in range(n)]
        return [w + "," if k % clause == clause - 1 else w for k, w in enumerate(made)]
    base = [words(400) for _ in range(30)]
    rows = [(i, " ".join(b)) for i, b in enumerate(base)]
    for i in range(90):
        size, host = (51, 60, 100)[i % 3], words(200)
        at, to, b = rnd.randrange(400 - size), rnd.randrange(200), rnd.choice(base)
        rows.append((100 + i, " ".join(host[:to] + b[at:at + size] + host[to:])))
    gone = {d: [False] * len(t.split()) for d, t in rows}
    for doc, start, end, *_ in got_spans(docs(rows)):
        text = dict(rows)[doc]
        lo = len(text[:start].split())
        hi = lo + len(text[start:end].split())
        gone[doc][lo:hi] = [True] * (hi - lo)
    held = repeated_words(rows)
    share = {d: sum(g and h for g, h in zip(gone[d], held[d])) / sum(held[d]) for d in held if any(held[d])}
    assert set(share) == set(range(100, 190))
    assert min(share.values()) >= 25 / 51                                        # no passage is missed
    words_held = sum(sum(h) for h in held.values())
    kept = sum(h and not g for d in held for g, h in zip(gone[d], held[d]))
    assert kept <= 0.2 * words_held
    assert not any(g and not h for d in held for g, h in zip(gone[d], held[d]))  # nothing else goes


def test_units_are_short_and_loops_make_few():
    text = " ".join(f"w{k}" for k in range(5000)).encode()
    assert max(u[2] for u in units(text)) <= 11 and len(units(text)) <= 1200
    assert len(units(b"x " * 60_000)) <= 6000
    assert len({u[3] for u in units(b"x y z " * 1000)}) <= 6


def test_blank_lines_of_the_brute_key():
    assert key_of("\x0b A ") == "a " and re.match(r"a", key_of(" A "))
