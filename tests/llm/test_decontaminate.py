import random

from tallyloom.llm.decontaminate import Decontamination, _masks, common_length, contaminated, drop_contaminated

LETTERS = "abcdefghijklmnop"


def test_common_subsequence():
    r = random.Random(1)
    for _ in range(200):
        a, b = ([r.randrange(6) for _ in range(r.randrange(1, 30))] for _ in range(2))
        row = [0] * (len(b) + 1)
        for x in a:
            last = 0
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
        assert common_length(_masks(a), len(a), b) == row[-1]


def corpus(r):
    vocabulary = ["".join(r.choice(LETTERS) for _ in range(r.choice([3, 5, 8]))) for _ in range(4000)]
    common = ["the", "of", "in", "and", "to"]
    word = lambda: r.choice(common) if r.random() < 0.3 else r.choice(vocabulary)
    items = [(i, [word() for _ in range(r.choice([12, 18, 25, 36, 60, 150]))]) for i in range(40)]
    docs, want = [], set()
    for d in range(500):
        words = [word() for _ in range(r.choice([0, 5, 40, 300, 2000]))]
        if r.random() < 0.4:
            i, own = r.choice(items)
            own = list(own)
            kind = r.random()
            if kind < 0.4:  # a paraphrase: some words changed, some left out
                for _ in range(len(own) // 10):
                    own[r.randrange(len(own))] = r.choice(vocabulary)
                del own[r.randrange(len(own))]
            at = r.randrange(len(words) + 1)
            words[at:at] = [w.title() + r.choice(["", ",", "."]) for w in own] if kind < 0.7 else own
            want.add((d, i))
        docs.append((d, " ".join(words)))
    return docs, [(i, " ".join(w)) for i, w in items], want


def test_finds_leaks_and_keeps_clean_documents(spark):
    docs, items, want = corpus(random.Random(5))
    table = spark.createDataFrame([(d, t, 0, 1.0) for d, t in docs] + [(900, None, 0, 1.0), (901, "", 0, 1.0), (None, items[3][1], 0, 1.0)], "doc_id long, text string, item_id int, cosine double").repartition(3)
    benchmark = spark.createDataFrame([*items, (None, "x"), (77, None), (78, "")], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in contaminated(table, benchmark).collect()}
    assert (None, items[3][0]) in got
    got.discard((None, items[3][0]))
    assert got <= want and len(got) >= 0.97 * len(want)
    kept = drop_contaminated(table, benchmark)
    assert kept.columns == table.columns
    assert {r.doc_id for r in kept.collect()} == {d for d, _ in docs} - {d for d, _ in got} | {900, 901}
    # in several blocks of items the answer is the same
    assert {(r.doc_id, r.item_id) for r in contaminated(table, benchmark, Decontamination(items=15)).where("doc_id is not null").collect()} == got


def test_empty(spark):
    none, one = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    items = one.withColumnRenamed("doc_id", "item_id")
    assert contaminated(none, items).count() == 0 and contaminated(one, items.limit(0)).count() == 0
    assert drop_contaminated(one, items.limit(0)).count() == 1 and drop_contaminated(one, items).count() == 0


def test_item_in_a_third_of_the_rows(spark):
    r = random.Random(9)
    vocabulary = ["".join(r.choice(LETTERS) for _ in range(r.choice([3, 5, 8]))) for _ in range(4000)]
    text = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    items = [(i, text(n)) for i, n in enumerate((14, 25, 60))]
    copy = f"{text(20)} {items[0][1]} {text(20)}"
    docs, want = [(d, copy) for d in range(200)], {(d, 0) for d in range(200)}  # exact copies
    docs += [(d, f"{text(10)} {items[1][1]} {text(20)}") for d in range(200, 400)]  # a passage that many share
    want |= {(d, 1) for d in range(200, 400)}
    docs += [(d, text(60)) for d in range(400, 600)]
    docs += [(600, f"{text(200)} {items[0][1]} {text(100)}"), (601, f"{text(50)} {items[2][1]}")]
    want |= {(600, 0), (601, 2)}
    r.shuffle(docs)
    found = contaminated(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string"))
    got = {(x.doc_id, x.item_id) for x in found.collect()}
    assert got <= want and len(got) >= 0.9 * len(want) and {(600, 0), (601, 2)} <= got
    assert len({d for d, i in got if i == 0}) > 195 and len({d for d, i in got if i == 1}) > 170


def test_paraphrases_that_the_subsequence_check_accepts(spark):
    r = random.Random(11)
    vocabulary = ["".join(r.choice(LETTERS) for _ in range(r.choice([3, 5, 8]))) for _ in range(4000)]
    common = ["the", "of", "in", "and", "to", "a", "is", "on"]
    word = lambda: r.choice(common) if r.random() < 0.4 else r.choice(vocabulary)
    items = [(i, [word() for _ in range(r.choice([12, 15, 18, 30]))]) for i in range(60)]
    docs, want, p = [], {}, Decontamination()
    for d in range(600):
        i, own = r.choice(items)
        changed, share = list(own), r.choice([0.1, 0.2, 0.3])
        for k in r.sample(range(len(own)), round(len(own) * share)):
            changed[k] = r.choice(vocabulary)
        ending = own[-max(3, len(own) // 5) :]
        held, answer = common_length(_masks(own), len(own), changed) / len(own), common_length(_masks(ending), len(ending), changed) / len(ending)
        if held >= p.sure or held >= p.common and answer >= p.answer:
            want[d, i] = share
        docs.append((d, " ".join([word() for _ in range(r.randrange(60))] + changed + [word() for _ in range(r.randrange(60))])))
    found = contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id long, text string"))
    got = {(x.doc_id, x.item_id) for x in found.collect()}
    recall = {s: (sum(x == s for x in want.values()), sum(want[k] == s for k in got & want.keys())) for s in (0.1, 0.2, 0.3)}
    print("recall by share of changed words:", recall)
    assert all(n >= 0.95 * m for m, n in recall.values()), recall


def test_items_of_repeated_words(spark):
    """The bound before the subsequence check counts an item's words as often as it has them."""
    last = [f"word{i}" for i in range(10)]
    item, text = " ".join(["na"] * 10 + last), " ".join(["x1", "x2", *["na"] * 10, *last[-3:], "x3"])
    docs = spark.createDataFrame([(1, text), (2, " ".join(["na"] * 10)), (3, " ".join(["na", *last]))], "doc_id long, text string")
    benchmark = spark.createDataFrame([(7, item), (7, item)], "item_id long, text string")
    found = contaminated(docs, benchmark, Decontamination(cosine=-1.0)).collect()
    assert [(r.doc_id, r.item_id, r.common, r.answer) for r in found] == [(1, 7, 0.65, 0.75)]
