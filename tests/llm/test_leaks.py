import random

import numpy as np

from pagemill.llm import leaks

WORDS = [f"w{i}" for i in range(600)]


def corpus(n=300, seed=5):
    rng = random.Random(seed)
    items = [(i, " ".join(rng.choice(WORDS) for _ in range(50)), "en") for i in range(1, 21)]
    han = [chr(0x4E00 + i) for i in range(400)]
    items += [(i, "".join(rng.choice(han) for _ in range(60)), "zh") for i in range(21, 31)]
    docs, truth = [], set()
    for d in range(1000, 1000 + n):
        words = [rng.choice(WORDS) for _ in range(rng.randint(5, 200))]
        if d % 3 == 0:
            item, text, lang = rng.choice(items)
            parts = text.split() if lang == "en" else list(text)
            length = rng.choice([9, 11, 12, 13, 40] if lang == "en" else [15, 19, 20, 21, 50])
            at = rng.randrange(len(parts) - length + 1)
            passage = parts[at : at + length]
            place = rng.randrange(len(words))
            words[place:place] = [w.upper() + rng.choice(["", ",", "*"]) for w in passage] if lang == "en" else ["".join(passage[:7]) + "\n" + "，".join(passage[7:])]
            if length >= (12 if lang == "en" else 20):
                truth.add((item, d))
        docs.append((d, " ".join(words)))
    return docs, items, truth


def test_recall_against_brute_force(spark):
    docs, items, truth = corpus()
    d = spark.createDataFrame([(*x, "e", b"t") for x in docs], "doc_id long, text string, kind string, tok binary")
    i = spark.createDataFrame(items, "item_id long, text string, lang string")
    got = {(r["item_id"], r["doc_id"]) for r in leaks.find_leaks(d, i).collect()}
    assert not got - truth
    assert len(got & truth) >= 0.98 * len(truth) > 30
    blocks = leaks.find_leaks(d, i, settings=leaks.Settings(items_per_block=7))
    assert {(r["item_id"], r["doc_id"]) for r in blocks.collect()} == got


def test_paraphrases_and_answers(spark):
    rng = random.Random(2)
    item = [rng.choice(WORDS) for _ in range(24)]
    reworded = [w if i % 6 else "changed" for i, w in enumerate(item)]
    docs, items, _ = corpus(60)
    d = spark.createDataFrame([*docs, (5000, " ".join(reworded) + " w1 w2")], "doc_id long, text string")
    i = spark.createDataFrame([(99, " ".join(item) + "\nA) w1 w2 B) w9 w8", "en"), *items], "item_id long, text string, lang string")
    got = {(r["item_id"], r["doc_id"]): r for r in leaks.find_leaks(d, i, paraphrases=True, settings=leaks.Settings(paraphrase_cosine=0.6, paraphrase_share=0.7)).collect()}
    assert got[99, 5000]["kind"] == "paraphrase" and got[99, 5000]["answer_found"]


def test_odd_inputs(spark):
    docs, items, _ = corpus(30)
    text = items[0][1]
    d = spark.createDataFrame([(1, None), (2, ""), (None, text), (3, "short"), (4, " ".join(WORDS) * 200 + " " + text), (5, text), (6, text), (6, text), (7, "，。")], "doc_id long, text string")
    i = spark.createDataFrame([(50, text, None), (51, None, "en"), (None, text, "en"), (52, "two words", "en"), (50, text, None)], "item_id long, text string, lang string")
    assert {(r["item_id"], r["doc_id"]) for r in leaks.find_leaks(d, i).collect()} == {(50, 4), (50, 5), (50, 6)}
    assert leaks.find_leaks(d.limit(0), i).count() == 0
    assert leaks.find_leaks(d, i.limit(0)).count() == 0


def test_subsequence_and_folding():
    a, b = np.array([1, 2, 3, 4], dtype=np.uint32), np.array([2, 9, 4], dtype=np.uint32)
    assert leaks.common_subsequence(a, b) == 2 and leaks.common_subsequence(a, b[:0]) == 0
    assert leaks.words("**Ｗell**-​known <b>réｍark</b>, 3x") == ["well", "known", "rémark", "3x"]


def test_reworded_items_among_real_documents(spark):
    """At the default thresholds: items with every fifth word or character replaced, none of them verbatim."""
    folder = "/root/testdata/sf0.01"
    documents, items = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{folder}/eval_items.parquet")
    rng, rows, truth = random.Random(6), [], {}
    for r in items.orderBy("item_id").collect()[::2]:
        parts = leaks.words(r["text"])
        if len(parts) < 30:
            continue
        other = leaks.words("".join(rng.choice("天地玄黄宇宙洪荒") for _ in parts)) if r["lang"] == "zh" else [f"odd{i}" for i in range(len(parts))]
        changed = [other[i] if i % 5 == 4 else w for i, w in enumerate(parts)]
        truth[r["item_id"]] = 10**9 + len(rows)
        rows.append((truth[r["item_id"]], ("" if r["lang"] == "zh" else " ").join(changed)))
    found = leaks.find_leaks(documents.unionByName(spark.createDataFrame(rows, "doc_id long, text string")), items, paraphrases=True)
    got = {(r["item_id"], r["doc_id"]): r["kind"] for r in found.where("doc_id >= 1000000000").collect()}
    right = [k for k in truth.items() if k in got]
    print(len(truth), len(right), len(got) - len(right), [x for x in got.values()].count("verbatim"))
    assert len(right) >= 0.9 * len(truth) and len(got) - len(right) <= 0.2 * len(got)
