import random

import public_tokenizers
import sentencepiece
from tokenizers import Tokenizer

from tallyloom.llm.token_counts import PieceCounter, count_tokens, read_cache

PATH = public_tokenizers.path("piece_bpe_32k.model")


def test_counts_by_word_equal_the_library():
    r, model, ours = random.Random(2), sentencepiece.SentencePieceProcessor(model_file=PATH), PieceCounter(PATH)
    alphabet = "ab  e\n\t's1,.é東😀\xa0　ﬁ①▁thein\x00"
    texts = ["", " ", "  ", "a ", " a", "<s> x </s>", "a" * 5000, *("".join(r.choice(alphabet) for _ in range(r.randrange(50))) for _ in range(4000))]
    assert ours.by_word and ours.counts(texts) == [len(model.encode(t)) for t in texts]


def test_cache_is_used_and_appended(spark, tmp_path):
    cache, model = str(tmp_path / "cache"), sentencepiece.SentencePieceProcessor(model_file=PATH)
    rows = [(1, "one two", 3), (2, None, 3), (3, "one two", 3), (4, "", 3), (5, "x" * 300_000, 3), (5, "again", 3), (None, "no id", 3), (None, "no id", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, content int")
    want = sorted(str((d, len((t or "").encode()), n := len(model.encode(t or "")), n > 4096)) for d, t, _ in rows)
    assert sorted(str(tuple(r)) for r in count_tokens(docs, PATH, cache).collect()) == want
    assert read_cache(docs, cache).count() == 5
    assert sorted(str(tuple(r)) for r in count_tokens(docs, PATH, cache).collect()) == want
    assert read_cache(docs, cache).count() == 5
    # stored counts are trusted, another tokenizer has its own
    json = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(json)
    got = {r.doc_id: r.n_tokens for r in count_tokens(docs.where("doc_id < 5"), json, cache).collect()}
    assert got == {d: len(library.encode(t or "", add_special_tokens=False).ids) for d, t, _ in rows if d and d < 5}
    assert read_cache(docs, cache).count() == 7
    assert count_tokens(docs.limit(0), PATH, cache).count() == 0
