"""Quality rules against plain Python."""
import re
import statistics

import pytest

from churnlens.llm.quality_rules import measure, quality_rules

from samples import ODD

NAMES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def plain(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    hit = {i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(3)} if len(grams) < 500 else \
        set(range(len(words)))
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)),
            len(lines) - len(set(lines)), len(hit))


@pytest.mark.parametrize("text", [t for _, t in ODD] + [
    "a b c a b c a b", "a a a a", "x\nx\n\n \nx\ny", "a#b *c* <d> $1 & | %", "é é é ü ü ü é é é"])
def test_measures(text):
    if text and len(text) > 100_000:
        assert measure(text.encode())["n_repeat_words"] == 60_000
        return
    assert tuple(measure((text or "").encode())[k] for k in NAMES) == plain(text)


def verdicts(rows, max_rate=0.5, default_weight=10.0):
    m = [plain(t) for _, t, *_ in rows]
    bad = [x[0] < 50 or 100 * x[4] > 50 * x[0] for x in m]
    hosts = {}
    for (*_, host), b in zip(rows, bad):
        n, f = hosts.get(host, (0, 0))
        hosts[host] = n + 1, f + b
    mean = sum(bad) / len(bad)
    rates = [f / n for n, f in hosts.values()]
    spread = (statistics.variance(rates) if len(rates) > 1 else 0) - mean * (1 - mean) * statistics.mean(1 / n for n, _ in hosts.values())
    weight = min(max(mean * (1 - mean) / spread - 1, 0), 1e9) if spread > 0 else default_weight
    ok = {h: (f + mean * weight) / (n + weight) <= max_rate for h, (n, f) in hosts.items()}
    return sorted(((d, *x, b, not b and ok[h]) for (d, _, _, h), x, b in zip(rows, m, bad)), key=str)


def got(df, **options):
    return sorted(((r.doc_id, *(r._quality[k] for k in NAMES), r._quality.base_failed, r._quality.kept)
                   for r in quality_rules(df, **options).collect()), key=str)


def test_hosts_are_rejected(docs, prose):
    rows = [(i, prose(80, seed=i), "en", "good") for i in range(40)] + [(100, "too short", "en", "good")]
    rows += [(200 + i, "too short", "en", "bad") for i in range(30)] + [(300, prose(80, seed=300), "en", "bad")]
    rows += [(400, prose(80, seed=400), "en", None), (401, "short", "en", None), (402, prose(60, seed=402), "en", "small")]
    want = verdicts(rows)
    assert got(docs(rows)) == want
    kept = {r[0] for r in want if r[-1]}
    assert 300 not in kept and set(range(40)) <= kept and 402 in kept


def test_one_host_keeps_its_clean_documents(docs, prose):
    rows = [(i, prose(80, seed=i), "en", "only") for i in range(20)] + [(50 + i, "short", "en", "only") for i in range(5)]
    assert got(docs(rows)) == verdicts(rows)
    assert sum(r[-1] for r in got(docs(rows))) == 20


def test_odd_and_empty(odd, empty):
    out = quality_rules(odd)
    assert out.count() == len(ODD) and out.columns == [*odd.columns, "_quality"]
    assert all(not r._quality.kept for r in out.collect())      # short, empty or one word over and over
    assert quality_rules(empty).count() == 0
    again = quality_rules(quality_rules(odd))                   # the result column replaces one of that name
    assert again.columns == out.columns and again.count() == len(ODD)
