import math
import re
import unicodedata

import regex

from tallyloom.functions.prompt_features import prompt_features, utf16_hashes


def fnv(text):
    h = 2166136261
    data = text.encode("utf-16-le")
    for i in range(0, len(data), 2):
        h = (h ^ (data[i] | data[i + 1] << 8)) * 16777619 & 0xFFFFFFFF
    return h


def brute(text):
    normal = re.sub(r"[\s﻿]+", " ", unicodedata.normalize("NFKC", text or "").lower()).strip()
    words = regex.findall(r"[\p{L}\p{N}_]+", normal)
    vector = [0.0] * 48
    for w in words:
        vector[fnv(w) % 48] += -1 if fnv(w) & 0x80000000 else 1
    norm = math.sqrt(sum(v * v for v in vector))
    grams = ["\u0001".join(words)] if 0 < len(words) < 3 else ["\u0001".join(words[i : i + 3]) for i in range(len(words) - 2)]
    chars = len(normal.encode("utf-16-le")) // 2
    unique, digits = len(set(words)) / len(words) if words else 0, len(re.findall("[0-9]", normal)) / chars if chars else 0
    return normal, len(words), chars, [v / norm if norm else v for v in vector] + [math.log1p(len(words)), unique, digits], sorted({fnv(g) for g in grams})


def test_features_equal_plain_python(spark):
    texts = [None, "", " \n\t", "one", "one two", "Fix ﬁle №5 in the ＡＢＣ module", "É é é ǅ", "𝒳 math 😀 emoji_1 2024", "a b c a b c", "x" * 5000, "word " * 20_000, "﻿start  of text​", "Straße ß İstanbul", "under_score-dash 1,234.5"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string").repartition(2)
    for r in rows.select("i", prompt_features(rows["text"]).alias("f")).collect():
        normal, words, chars, vector, grams = brute(texts[r.i])
        assert (r.f.normalized, r.f.words, r.f.chars, r.f.trigrams) == (normal, words, chars, grams), texts[r.i]
        assert len(r.f.vector) == 51 and all(math.isclose(a, b, abs_tol=1e-12) for a, b in zip(r.f.vector, vector, strict=True))
    assert rows.limit(0).select(prompt_features(rows["text"]).alias("f")).count() == 0


def test_hashes_of_many_lengths():
    words = ["a" * n for n in range(40)] + ["é", "😀", "foobar", ""]
    assert utf16_hashes(words).tolist() == [fnv(w) for w in words] and utf16_hashes([]).tolist() == []


def test_few_texts_are_held_at_once(monkeypatch):
    from tallyloom.functions import prompt_features as m

    texts, seen, whole = [f"one two {i} three" for i in range(600)], [], m._features
    monkeypatch.setattr(m, "_features", lambda part: seen.append(len(part)) or whole(part))
    out = m._prompt_features.func(m.pd.Series(texts))
    assert seen == [256, 256, 88] and [*out["normalized"]] == texts and len(m._prompt_features.func(m.pd.Series([], dtype=object))) == 0
