import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pagemill.llm import mix, split, tokens

RAW = open(tokens.VOCABULARY, "rb").read()


def count(text):
    return len(tokens.encoder(RAW)[0].encode_ordinary(text))


def checked(text, most, overlap):
    pieces = split.split_text(text, RAW, most, overlap)
    assert "".join(text[c:e] for s, e, c, _ in pieces) == text
    for s, e, c, n in pieces:
        assert n == count(text[s:e]) <= max(most, 4) or e - c <= 2
    return pieces


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab .\n。，é€中文😀", max_size=400), st.integers(4, 60), st.integers(0, 40))
def test_round_trip(text, most, overlap):
    checked(text, most, overlap)


def test_pieces_end_at_sentences_and_overlap():
    rng = random.Random(1)
    words = "alpha beta gamma delta epsilon zeta eta theta".split()
    text = "\n\n".join(" ".join(" ".join(rng.choice(words) for _ in range(9)).capitalize() + "." for _ in range(6)) for _ in range(60))
    pieces = checked(text, 200, 20)
    assert len(pieces) > 10
    assert all(text[:e].rstrip()[-1] == "." for _, e, _, _ in pieces)
    for (_, e, _, _), (s, _, c, _) in zip(pieces, pieces[1:]):
        assert c == e and 18 <= count(text[s:c]) <= 24
    # an edit at the front leaves the cuts of the rest where they are
    edited = "Another opening sentence here.\n\n" + text
    shift = len(edited) - len(text)
    cuts, moved = {e for _, e, _, _ in pieces}, {e - shift for _, e, _, _ in checked(edited, 200, 20)}
    assert len(cuts & moved) >= len(cuts) // 2


def test_edits_move_only_neighbouring_cuts(spark):
    """Real long documents, edited at the front and in the middle: nearly all other cuts stay where they are."""
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("length(text) > 8000").select("text").distinct().collect()
    kept = {"front": [0, 0], "middle": [0, 0]}
    for text in (r["text"] for r in rows):
        cuts = {e for _, e, _, _ in checked(text, 512, 32)}
        at = len(text) // 2
        for place, where in (("front", 0), ("middle", at)):
            edit = "One more sentence was written here. "
            moved = {e if e <= where else e - len(edit) for _, e, _, _ in checked(text[:where] + edit + text[where:], 512, 32)}
            far = {c for c in cuts if c < where or c > where + 4000}
            kept[place][0] += len(far & moved)
            kept[place][1] += len(far)
    print(kept)
    assert all(n > 50 and same >= 0.95 * n for same, n in kept.values()), kept


def test_chinese_sentences():
    rng = random.Random(2)
    text = "".join("".join(rng.choice("天地玄黄宇宙洪荒日月盈昃") for _ in range(rng.randint(5, 12))) + rng.choice("。！？") for _ in range(400))
    pieces = checked(text, 300, 30)
    assert len(pieces) > 10 and all(text[e - 1] in "。！？" for _, e, _, _ in pieces)


def test_texts_without_boundaries():
    assert len(checked("a" * 300_000, 1000, 50)) > 10
    assert len(checked("中" * 20_000, 100, 500)) > 10


def test_split_documents(spark):
    long = "One sentence of some words. " * 400
    docs = spark.createDataFrame([(1, long, "s", "x"), (2, "short", "s", "x"), (3, None, "s", "x"), (4, "", "s", "x"), (5, long, "none", "x"), (6, long, None, "x"), (1, long, "s", "x")], "doc_id long, text string, source string, piece_no string")
    limits = spark.createDataFrame([("s", 100, 10), ("s", 500, 1), ("none", None, 5), (None, 1, 1)], "source string, max_tokens int, overlap_tokens int")
    rows = split.split_documents(docs, limits).collect()
    assert {r["doc_id"] for r in rows} == {1} and all(r["n_tokens"] <= 100 for r in rows)
    assert len(rows) == 2 * rows[0]["n_pieces"]
    assert split.split_documents(docs.limit(0), limits).count() == 0


def deviations(plan):
    """Least and greatest units of each source over its line, over all slots; every unit comes once and in order."""
    done, sources, at = [0] * len(plan.sources), [], 0
    for k in range(plan.epochs):
        for slot, s, j in mix.epoch_slots(plan, k):
            assert slot == at and j == done[s]
            done[s], at = done[s] + 1, at + 1
            sources.append(s)
    assert at == plan.slots and done == plan.before(plan.slots)
    taken, line = np.array(sources), np.arange(1, at + 1)
    over = [np.cumsum(taken == s) - float(w) * line for s, w in enumerate(plan.weights)]
    return min(x.min() for x in over), max(x.max() for x in over)


def test_schedule_keeps_within_one_block():
    targets = [("a", 0.5, 1), ("b", 0.3, 1), ("c", 0.15, 2), ("d", 0.0499, 1), ("e", 0.0001, 3)]
    plenty = {s: 10**12 for s, _, _ in targets}
    for slots, epoch in ((1, 16), (100, 200), (5_000, 16), (50_000, 128), (1_000_000, 4096)):
        plan = mix.make_plan(targets, plenty, slots * 10, 10, epoch)
        least, most = deviations(plan)
        assert plan.slots == slots and -2 < least and most < 2, (slots, least, most)
    assert mix.make_plan([("a", 0.5, 1)], {}, None, 10).epochs == 0


def test_plans():
    def units(total, available, unit=10):
        plan = mix.make_plan(targets, available, total, unit)
        return dict(zip(plan.sources, plan.before(plan.slots)))

    targets = [("a", 0.5, 1), ("b", 0.3, 2), ("c", 0.2, 1)]
    assert units(None, {"a": 1000, "b": 100}) == {"a": 33, "b": 20}  # b gives all it has, twice
    assert units(1000, {"a": 1000, "b": 100, "c": 50}) == {"a": 75, "b": 20, "c": 5}
    assert units(10**6, {"a": 1000, "b": 100, "c": 50}) == {"a": 100, "b": 20, "c": 5}
    assert units(None, {}) == {} and units(0, {"a": 1000}) == {}
    assert sum(units(None, {"a": 1000, "b": 1000, "c": 5}).values()) == 2  # c has half a unit


def checked_mixture(rows, report, documents, targets, block):
    """The promises on real rows: whole texts in order, caps, shares, and the deviation at the end of every slot."""
    rows = rows.toPandas().sort_values(["slot", "position"])
    report = {r["source"]: r for r in report.collect()}
    total = rows["n_tokens"].sum()
    assert sum(r["tokens"] for r in report.values()) == total
    weight = {r["source"]: r["target_share"] for r in report.values() if r["available_tokens"]}
    weight = {s: w / sum(weight.values()) for s, w in weight.items()}
    per_slot = rows.groupby("slot").agg(source=("source", "first"), n_sources=("source", "nunique"), n=("n_tokens", "sum"))
    assert (per_slot["n_sources"] == 1).all() and list(per_slot.index) == list(range(len(per_slot)))
    assert (per_slot["n"] == block // 2).all()
    upto = per_slot["n"].cumsum()
    for s, w in weight.items():
        assert abs((per_slot["n"] * (per_slot["source"] == s)).cumsum() - w * upto).max() < block, s
        assert abs(report[s]["share"] - w) * total < block
    for (s, doc, no), spans in rows.groupby(["source", "doc_id", "repeat_no"]):
        assert no < report[s]["max_repeats"] and spans["start_token"].iloc[0] == 0
        assert (spans["start_token"].to_numpy()[1:] == spans["end_token"].to_numpy()[:-1]).all()
    for s, mine in rows.groupby("source"):  # the stream of a source has no gap
        assert (mine["position"].to_numpy()[1:] == (mine["position"] + mine["n_tokens"]).to_numpy()[:-1]).all()
    return rows, report


@pytest.mark.parametrize("block", [2048, 256])
def test_shares_of_real_documents(spark, block):
    folder = "/root/testdata/sf0.01"
    documents, targets = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/mix_targets.parquet")
    rows, report = checked_mixture(*mix.mixture(documents, targets, block_tokens=block, rows_per_bucket=100), documents, targets, block)
    sizes = {r["doc_id"]: count(r["text"]) for r in documents.where("text IS NOT NULL").collect()}
    assert (rows["end_token"] <= rows["doc_id"].map(sizes)).all() and report["podcast_note"]["tokens"] == 0
    assert sum(r["tokens"] for r in report.values()) > 20 * 2048


def test_mixture(spark):
    texts = [(i, f"text number {i} of a source with some words in it", "a" if i % 4 else "b", 9) for i in range(400)]
    docs = spark.createDataFrame([*texts, (900, texts[0][1], "b", 9), (901, None, "a", 9), (902, "", "a", 9), (903, "other", "z", 9), (904, "x", None, 9)], "doc_id long, text string, source string, slot int")
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.4, 3), ("gone", 0.1, 2), (None, 0.1, 1), ("z", 0.0, 1)], "source string, target_share double, max_repeats int")
    rows, report = mix.mixture(docs, targets, block_tokens=100)
    rows, report = rows.collect(), {r["source"]: r for r in report.collect()}
    uses = Counter(doc for doc, _ in {(r["doc_id"], r["repeat_no"]) for r in rows})
    assert max(uses.values()) <= 3 and 900 not in uses and not {901, 902, 903, 904} & set(uses)
    assert all(n == 1 for d, n in uses.items() if d % 4)
    assert report["gone"]["share"] == 0.0 and report["a"]["share"] == pytest.approx(5 / 9, abs=0.02) and report["b"]["share"] == pytest.approx(4 / 9, abs=0.02)
    assert sum(r["tokens"] for r in report.values()) == sum(r["n_tokens"] for r in rows)
    again, _ = mix.mixture(docs.repartition(5), targets, block_tokens=100, rows_per_bucket=20)
    assert {r["source"] for r in again.collect()} == {"a", "b"}
    assert mix.mixture(docs.limit(0), targets)[0].count() == 0
