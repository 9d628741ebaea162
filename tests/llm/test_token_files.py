"""Token files: round trips and single-document access."""
import array
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from churnlens.llm import token_files as m

from samples import ODD


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(m.tokenizer_path())


def ids(tokenizer, text):
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]


@given(st.lists(st.text(st.sampled_from("aA bB\t\n\x0b\x0c\r\x1c\x85\u00a0\u2003éÉe\u0301ß漢'st0!<|endoftext|>Σς"), max_size=40), max_size=5))
@settings(max_examples=1500, deadline=None)
def test_words_encode_like_whole_texts(texts):
    tokenizer = Tokenizer.from_file(m.tokenizer_path()) if not hasattr(m, "_test_t") else m._test_t
    m._test_t = tokenizer
    got = m.Encoder(m.tokenizer_path(), 2)([t.encode() for t in texts])
    assert [array.array("I", g).tolist() for g in got] == [ids(tokenizer, t) for t in texts]


def expected(tokenizer, rows):
    out, start = [], 0
    for d, t in rows:
        i = ids(tokenizer, t)
        out.append((d, start, len(i), zlib.crc32(array.array("I", i).tobytes())))
        start += len(i)
    return out


def test_round_trip(spark, docs, prose, tokenizer, tmp_path):
    rows = [(i * 3, prose(i % 60, seed=i) + " É\n") for i in range(400)]
    path = str(tmp_path / "files")
    m.write_token_files(docs(rows[::-1], extra=True), path, m.tokenizer_path())
    got = sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in m.read_digests(spark, path).collect())
    assert got == expected(tokenizer, rows)
    assert {r.doc_id: r.tokens for r in m.read_tokens(spark, path).collect()} == {d: ids(tokenizer, t) for d, t in rows}
    one = m.read_tokens(spark, path, doc_id=300).collect()
    assert [(r.doc_id, r.start, r.tokens) for r in one] == [(300, got[100][1], ids(tokenizer, rows[100][1]))]
    assert m.read_tokens(spark, path, doc_id=301).count() == 0


def test_small_packs_and_many_parts(spark, docs, prose, tokenizer, tmp_path, monkeypatch):
    monkeypatch.setattr(m, "PACK_DOCS", 3)
    rows = [(i, prose(5 + i % 9, seed=i)) for i in range(100)]
    path = str(tmp_path / "files")
    m.write_token_files(docs(rows), path, m.tokenizer_path())
    got = sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in m.read_digests(spark, path).collect())
    assert got == expected(tokenizer, rows)


def test_the_dictionary_hash_is_checked(spark, docs, prose, tmp_path):
    path = str(tmp_path / "files")
    m.write_token_files(docs([(i, prose(40, seed=i)) for i in range(60)]), path, m.tokenizer_path())
    spark.createDataFrame([("0" * 64, b"other")], "sha256 string, dictionary binary").write.mode("overwrite") \
        .parquet(f"{path}/dictionary")
    with pytest.raises(ValueError):
        m.read_digests(spark, path)


def test_odd_tables(odd, tokenizer):
    got = sorted(((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in m.token_digests(odd).collect()), key=lambda r: r[1])
    order = sorted(ODD, key=lambda r: (r[0] is not None, r[0] or 0))
    assert [r[0] for r in got] == [d for d, _ in order]
    assert sorted((r[0] or -1, r[2], r[3]) for r in got) == sorted((d or -1, n, c) for d, _, n, c in expected(tokenizer, order))
    assert [r[1] for r in got] == [sum(x[2] for x in got[:k]) for k in range(len(got))]


def test_empty_table(empty):
    assert m.token_digests(empty).count() == 0


@pytest.mark.parametrize("text", ["\x1c<", '—"', "a—'s", "don't.", "'s", "é'", "x'll!", "²x.", "ªb,", "ﬁn.", "ǅ.", "'", "a''s", "１２,"])
def test_letters_and_marks(tokenizer, text):
    got = m.Encoder(m.tokenizer_path(), 2)([text.encode()])[0]
    assert array.array("I", got).tolist() == ids(tokenizer, text)
