"""Chunked encoding against the whole tokenizer; agreement points; reuse of chunks."""
import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from churnlens.llm import chunk_tokens as m

from samples import ODD

PATH = m.tokenizer_path()
WHOLE = Tokenizer.from_file(PATH)
PIECES = [*"aZ'sx1.<| \t\n\r\x0b\x0c\x1c\x85  　 é漢ß́", "don't", "a.", "b,", "é!", " naïve", "x<", " the", "\n\n", "  ", "<|endoftext|>", "\n<", "'ll"]


def ids(text):
    return WHOLE.encode(text or "", add_special_tokens=False).ids


@given(st.lists(st.sampled_from(PIECES), max_size=30).map("".join))
@settings(max_examples=3000, deadline=None)
def test_any_two_encodings_agree_at_agreement_points(text):
    raw = text.encode()
    at = m.agreement_points(np.frombuffer(raw, np.uint8)).tolist() if len(raw) > 1 else []
    for p in at:
        assert ids(raw[:p].decode()) + ids(raw[p:].decode()) == ids(text)
    for p in m.piece_starts(np.frombuffer(raw, np.uint8)).tolist() if len(raw) > 1 and b"<|" not in raw else []:
        assert ids(raw[:p].decode()) + ids(raw[p:].decode()) == ids(text)
    assert np.frombuffer(m.Encoder(PATH)([raw])[0], np.uint16).tolist() == ids(text)
    assert m.decode(np.array(ids(text), np.int64), PATH) == WHOLE.decode(ids(text), skip_special_tokens=False)


def test_chunks_follow_content(prose):
    a, shared = prose(400, seed=1).encode(), prose(3000, seed=2).encode()
    for text in (a, shared):
        ends = m.chunk_ends(np.frombuffer(text, np.uint8)).tolist()
        assert ends[-1] == len(text) and sorted(set(ends)) == ends
    there = {c[0] for c in m.chunks(shared)}
    moved = {c[0] for c in m.chunks(a + b" " + shared + b" " + a)}
    assert len(there) > 10 and len(there & moved) >= len(there) - 3     # the ends, and what the first 32 bytes cut
    rolled = m.chunk_ends(np.frombuffer(a + shared, np.uint8))      # 32 bytes on, the hash knows nothing of `a`
    alone = m.chunk_ends(np.frombuffer(shared, np.uint8)) + len(a)
    assert set(alone[alone > len(a) + 32].tolist()) <= set(rolled.tolist())


def expected(rows):
    out = []
    for d, t in rows:
        i = ids(t)
        out.append((-1 if d is None else d, len(i), hashlib.sha256(",".join(map(str, i)).encode()).hexdigest(),
                    hashlib.sha256(WHOLE.decode(i, skip_special_tokens=False).encode()).hexdigest()))
    return sorted(out)


def result(df):
    return sorted((-1 if r.doc_id is None else r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in df.collect())


def copies(prose):
    """Copies, shared passages, and texts of their own."""
    page, part = prose(2500, seed=1), prose(300, seed=2)
    rows = [(i, page + (" tail" * (i % 3))) for i in range(40)]
    rows += [(100 + i, prose(80, seed=i) + "\n\n" + part + "\n" + prose(50, seed=i + 50)) for i in range(60)]
    return rows + [(200, prose(9000, seed=999)), (201, "<|endoftext|>".join([part, page])), (202, "漢字" * 3000 + part)]


@pytest.mark.parametrize("bits", [4, 9])
def test_documents(docs, prose, monkeypatch, bits):
    monkeypatch.setattr(m, "CHUNK_BITS", bits)
    rows = copies(prose)
    df = docs(rows, extra=True)
    assert result(m.token_digests(df, PATH)) == expected(rows)
    encoded = m.encode_documents(df, PATH)
    assert {r.doc_id: list(r.ids) for r in encoded.collect()} == {d: ids(t) for d, t in rows}
    assert {r.doc_id: r.text for r in m.decode_documents(encoded, PATH).collect()} == dict(rows)


def test_a_shared_chunk_is_encoded_once_and_answered_once_a_group(spark, docs, prose):
    rows = m._rows(docs(copies(prose)))
    shared = spark.sparkContext.broadcast(m._seen(rows))
    answers = m._answers(m._requests(rows, shared), PATH).collect()
    asked = {(r.group, bytes(r.digest)) for r in answers}
    assert len(asked) == len(answers)
    digests = {d for _, d in asked}
    held = [{c[0] for c in m.chunks(t.encode())} for _, t in copies(prose)]
    assert digests >= {d for d in set().union(*held) if sum(d in h for h in held) > 1}
    body = m._bodies(rows, shared, PATH).collect()
    by_text = {r.doc: r for r in body}
    assert len(by_text[5].refs) >= 16 * 5          # a copied page comes from shared chunks
    assert len(by_text[200].refs) == 0


def test_a_full_filter_changes_nothing(docs, prose, monkeypatch):
    monkeypatch.setattr(m, "_seen", lambda rows: np.full((1 << m.prefilter.BITS) // 8, 255, np.uint8))
    rows = copies(prose)
    assert result(m.token_digests(docs(rows), PATH)) == expected(rows)


def test_odd_and_empty(odd, empty):
    assert result(m.token_digests(odd, PATH)) == expected(ODD)
    assert m.token_digests(empty, PATH).count() == 0


def test_very_long_texts(docs, prose):
    rows = [(1, "a" * 300_000), (2, " ".join([prose(2000, seed=3)] * 150)), (3, "\n" * 200_000)]
    assert result(m.token_digests(docs(rows), PATH)) == expected(rows)
