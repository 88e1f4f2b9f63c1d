import base64

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import bpe
from tessera.llm.textops import chunks, tokenizer_file

PATH = tokenizer_file(bpe.VOCABULARY)
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@pytest.fixture(scope="module")
def known():
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def own(texts):
    c, out = bpe.codec(PATH), []
    for _, _, t in chunks(texts):
        ids, at, off = c.encode(t)
        out += [(ids[i:j].tolist(), at[i:j].tolist()) for i, j in zip(off[:-1], off[1:], strict=True)]
    return out


ALPHABET = st.sampled_from(list("ab stdmlvre'’  \n\t\r0129.,!?éßЖ中🙂 ́　A"))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.text(ALPHABET, max_size=40), st.text(max_size=30).filter(lambda s: s.isprintable())), min_size=1, max_size=8))
def test_like_a_regex_tokenizer(known, texts):
    for t, (ids, at) in zip(texts, own(texts), strict=True):
        assert ids == known.encode_ordinary(t), repr(t)
        raw = t.encode()
        ends = [*at[1:], len(raw)][: len(at)]
        assert [raw[i:j] for i, j in zip(at, ends, strict=True)] == [known.decode_single_token_bytes(i) for i in ids]


def test_whole_documents(spark, sf, known):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = bpe.encode(docs, check=True).collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert len(got) == len(texts) and all(r.round_trip for r in got)
    for r in got:
        assert r.token_ids == known.encode_ordinary(texts[r.doc_id]) and r.n_tokens == len(r.token_ids)


def test_edges_and_decoding(spark, known):
    rows = [(1, None, "x"), (2, "", "x"), (2, "", "x"), (3, "a" * 300_000, None), (4, "don't we'll\n\n x", "y"), (None, "z", "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    out = bpe.encode(df)
    assert out.columns == ["doc_id", "n_tokens", "token_ids", "token_offsets"]
    back = bpe.decode(out).collect()
    assert sorted((r.doc_id or 0, r.text or "") for r in back) == sorted((i or 0, t or "") for i, t, _ in rows)
    nothing = next(r for r in back if r.doc_id == 1)
    assert nothing.token_ids is None and nothing.text is None
    assert bpe.encode(df.limit(0)).count() == 0
    assert own(["a" * 5000])[0][0] == known.encode_ordinary("a" * 5000)
