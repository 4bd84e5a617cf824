import hashlib
import random

import public_tokenizers
import pytest
import tiktoken

from tallyloom.llm.byte_bpe import ByteBpe, Remembering, encode_documents, load_ranks, round_trip_digests

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def both():
    ranks = load_ranks(PATH)
    return ByteBpe(ranks, public_tokenizers.PATTERN), tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_ids_equal_the_library(both):
    bpe, library = both
    r = random.Random(3)
    texts = ["", " ", "  a", "a  b   c", "foo\n  bar \n\n baz ", "it's I'LL we've 'quoted' don't", "naïve 東京 😀😀 ١٢٣ á", "aaaaaaaaaaaaaaa", "\x1c \x1d x\x85 y\xa0 z", "<|endoftext|> x", "  a    b", "a\tb \t c"]
    alphabet = "ab  e\n\t's1,.é東😀\x1c\xa0　'"
    texts += ["".join(r.choice(alphabet) for _ in range(r.randrange(60))) for _ in range(1500)]
    texts += ["".join(r.choice("abcdefgh") for _ in range(r.randrange(2, 300))) for _ in range(200)]
    remembering = Remembering(bpe)
    for text in texts:
        ids = library.encode_ordinary(text)
        assert bpe.encode(text) == ids, repr(text)
        assert bpe.decode(ids) == text.encode()
        assert next(iter(remembering.texts([text]))) == (" ".join(map(str, ids)), text.encode()), repr(text)
    together = list(Remembering(bpe).texts(texts))
    assert [t for _, t in together] == [t.encode() for t in texts]
    assert [i for i, _ in together] == [" ".join(map(str, library.encode_ordinary(t))) for t in texts]


def test_very_long_pre_tokens(both):
    bpe, library = both
    for piece in ("ab" * 50_000, "".join(random.Random(1).choice("abcdefghijk") for _ in range(100_000)), "=" * 70_001):
        assert bpe.encode(piece) == library.encode_ordinary(piece)


def test_rows(spark, both):
    _, library = both
    rows = [(1, None, 5), (2, "", 5), (3, "the cat's 東京", 5), (3, "the cat's 東京", 5), (None, "x " * 40_000, 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    want = []
    for d, t, _ in rows:
        ids = library.encode_ordinary(t or "")
        want.append((d, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    got = [tuple(x) for x in round_trip_digests(docs, PATH, public_tokenizers.PATTERN).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want))
    full = encode_documents(docs, PATH, public_tokenizers.PATTERN).where("doc_id = 3").first()
    assert full.ids == library.encode_ordinary("the cat's 東京") and bytes(full.decoded) == "the cat's 東京".encode()
    assert round_trip_digests(docs.limit(0), PATH, public_tokenizers.PATTERN).count() == 0
