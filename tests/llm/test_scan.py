import random
from collections import Counter

import numpy as np

from pagemill.llm import scan, scan_lines
from pagemill.llm.boosting import Boosted

NOUNS = "harbour temple lecture garden museum essay glacier treaty sample species journal region pattern library mixture document theory current balance vehicle".split()
VERBS = "measure convert examine restore protect observe describe collect imagine support".split()
TITLE = "Lantern Word Atlas"


def clean(rng):
    return f"the {rng.choice(NOUNS)} of the {rng.choice(NOUNS)} can {rng.choice(VERBS)} every {rng.choice(NOUNS)} and {rng.choice(VERBS)} it in {rng.randint(1900, 1999)}"


def wrapped(rng):
    words = clean(rng).split()
    k = rng.randint(4, 9)
    return " ".join(words[:k]) + "\n" + " ".join(words[k:])


def table(spark, rows):
    return spark.createDataFrame([(*r, "t", 1) for r in rows], "id string, text string, repaired string, n_joined int")


def test_repair(spark):
    rng = random.Random(3)
    rows = [(f"c{i}", wrapped(rng)) for i in range(600)]
    rows += [(f"h{i}", f"{rng.choice([f'{i}   {TITLE}', f'{TITLE}   {i}', TITLE, f'Unit {i} · {TITLE}'])}") for i in range(60)]
    dirty = {
        "join": ("the trea-\nty of the temple", "the treaty of the temple"), "soft": ("a gla¬\r\n  cier can measure it", "a glacier can measure it"),
        "misread": ("the harbonr of thc tcmple", None), "letter": ("the tbeory of the mu5eum", "the theory of the museum"), "page": ("the temple of\n— 35 —\nthe garden", "the temple of the garden"),
        "title": (f"the temple of\n{TITLE.upper()}\nthe garden", "the temple of the garden"), "number": ("735", ""), "roman": ("xlvii", ""), "between": ("the ener-\nPage 12\ngy", None),
    }
    fine = {"digits": "the MP3 sample and the 4K library", "cited": f"on page 35 of {TITLE} the temple", "list": "Word List 15", "wrap": "the temple\nof the garden", "empty": "", "compound": "both pre-\nand post-treaty", "long": "the temple of the garden " * 5000}
    rows += [(k, v[0]) for k, v in dirty.items()] + list(fine.items()) + [("null", None), ("wrap", fine["wrap"]), (None, "735")]
    got = {r["id"]: r for r in scan.repair_texts(table(spark, rows), ["id"]).collect()}
    flagged = {k for k, r in got.items() if r["n_joined"] + r["n_furniture"] + r["n_replaced"]}
    assert {k for k in flagged if k and k in fine} == set() and "null" not in got
    assert not [k for k in flagged if k and k[0] == "c" and k[1:].isdigit()]
    assert all(f"h{i}" in flagged for i in range(60))
    for k, (_, wanted) in dirty.items():
        assert k in flagged or wanted is None, k
        if wanted is not None:
            assert got[k]["repaired"] == wanted, k
    assert got["long"]["repaired"] == fine["long"].strip() and None in flagged


def test_joined_decisions_give_the_same(spark, monkeypatch):
    rng = random.Random(4)
    rows = [(f"c{i}", wrapped(rng)) for i in range(300)] + [("x", "the tbeory of the trea-\nty"), ("y", "12"), ("z", f"{TITLE}   4\nthe temple")]
    wanted = {(r["id"], r["repaired"]) for r in scan.repair_texts(table(spark, rows), ["id"]).collect()}
    monkeypatch.setattr(scan, "BROADCAST_BYTES", -1)
    assert {(r["id"], r["repaired"]) for r in scan.repair_texts(table(spark, rows), ["id"]).collect()} == wanted


def test_empty_table(spark):
    assert scan.repair_texts(table(spark, []), ["id"]).count() == 0


def test_lines():
    for s in ("35", "— 35 —", "p. 12", "Page 3", "pagc 3 of 540", "7 / 540", "[12]", "· 9 ·", "第 4 页", "xiv", "l4.", "lO."):
        assert scan_lines.is_count(s), s
    for s in ("", "word", "in 1990", "Word List 3", "mix up", "n.", "3D model"):
        assert not scan_lines.is_count(s), s
    assert scan_lines.title_cores(f"12   {TITLE}") == (True, [scan_lines.core_key(TITLE)])
    assert scan_lines.title_cores("灯塔词汇图册 第12单元") == (True, ["灯塔词汇图册"])
    assert scan_lines.title_cores("Word List 3") == (False, [])
    assert scan.confusion_cost("tbeory", "theory") == 1 and scan.confusion_cost("theories", "theory") >= 4 and scan.confusion_cost("iriforrn", "inform") == 2


def test_chinese_contexts(spark):
    rng = random.Random(6)
    words = ["人群", "未来", "天空", "土壤", "收入", "士兵", "知己", "日记"]
    rows = [(str(i), "，".join(rng.choice(words) + "的" + rng.choice(words) for _ in range(5))) for i in range(400)]
    rows += [("bad", "入群的末来，夭空的土壤"), ("good", "收入的士兵，人群的未来")]
    got = {r["id"]: r for r in scan.repair_texts(table(spark, rows), ["id"]).collect()}
    assert got["bad"]["repaired"] == "人群的未来，天空的土壤" and got["good"]["n_replaced"] == 0
    assert sum(r["n_replaced"] for k, r in got.items() if k != "bad") == 0


def test_boosting():
    rng = np.random.default_rng(0)
    x = rng.standard_normal((800, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.3)).astype(float)
    p = Boosted().fit(x[:600], y[:600]).probability(x[600:])
    assert ((p > 0.5) == y[600:]).mean() > 0.9
    assert (Boosted().fit(x, np.zeros(800)).probability(x) < 0.01).all()
    assert len(Boosted().fit(np.zeros((0, 4)), np.zeros(0)).probability(np.zeros((0, 4)))) == 0


def test_joined_decisions_that_follow_from_others(spark, monkeypatch):
    known = [("j", "harb\tonr", "1"), ("w", "harbonr", "harbour"), ("h", "的入群", "人"), ("w", "lantcrn", "lantern"), ("t", scan_lines.core_key(TITLE), "9,9,2")]

    rule = Boosted()  # a page number by its looks, or a core with evidence
    rule.forest = [[(f, 0.5, 1, 2), (-1, 0.0, 0.0, 0), (-1, 0.0, 20.0, 0)] for f in (0, 4)]
    monkeypatch.setattr(scan, "furniture", lambda texts, found: rule)
    monkeypatch.setattr(scan, "decisions", lambda texts: spark.createDataFrame(known, "kind string, key string, value string"))
    rows = [("join", "the harb-\nonr of it"), ("indent", "他的\n　　入群"), ("header", f"他的\n{TITLE}\n入群"), ("core", "the temple of\nLantcrn Word Atlas\nthe garden"), ("none", "fine")]
    for limit in (scan.BROADCAST_BYTES, -1):
        monkeypatch.setattr(scan, "BROADCAST_BYTES", limit)
        got = {r["id"]: r["repaired"] for r in scan.repair_texts(table(spark, rows), ["id"]).collect()}
        assert got == {"join": "the harbour of it", "indent": "他的人群", "header": "他的人群", "core": "the temple of the garden", "none": "fine"}, limit


def plant(kind, text, titles, counts, rng):
    """``text`` with one flaw of a kind put in, or None if it has no place for it."""
    ls = text.split("\n")
    if kind in ("header", "number"):
        at = rng.randrange(len(ls) + 1)
        n = rng.randint(1, 900)
        line = rng.choice([f"{n}", f"— {n} —", f"Page {n}", f"第 {n} 页", f"{n} / 950"]) if kind == "number" else rng.choice(titles)
        return "\n".join([*ls[:at], line, *ls[at:]])
    if kind == "chinese":
        spots = [(i, w) for i, w in scan_lines.han_windows(text) if counts["h", w] >= 8 and "^" not in w]
        if not spots:
            return None
        i, w = rng.choice(spots)
        return text[:i] + rng.choice([c for c in scan_lines._GROUP_OF[w[1]] if c != w[1]]) + text[i + 1 :]
    bare = scan_lines.without_ipa(text)
    spots = [m for m in scan_lines._WORD.finditer(bare) if m.group(0).islower() and m.group(0).isalpha() and len(m.group(0)) >= 6 and counts["w", m.group(0)] >= 20]
    if not spots:
        return None
    m = rng.choice(spots)
    if kind == "joined":
        k = rng.randint(2, len(m.group(0)) - 2)
        return text[: m.start() + k] + "-\n" + text[m.start() + k :]
    bad = scan._corrupted(m.group(0), np.random.default_rng(rng.randrange(10**6)))
    return bad and text[: m.start()] + bad + text[m.end() :]


def test_planted_flaws_by_kind(spark):
    """Each kind of flaw put into clean rows of the real tables: how many are found, and how many texts come out as they were."""
    from pagemill.llm import queries

    source = queries._scanned(spark, "/root/testdata/sf0.01")
    rows = scan.repair_texts(source, ["table_name", "row_id"]).collect()
    counts = Counter()
    for r in rows:
        counts.update(scan_lines.observe(r["text"]))
    titles = [r["text"] for r in rows if r["n_furniture"] == 1 and "\n" not in r["text"] and not scan_lines.is_count(r["text"])]
    clean = [r for r in rows if not r["n_furniture"] + r["n_joined"] + r["n_replaced"] and len(r["text"]) > 40]
    rng, planted = random.Random(11), {}
    for kind in ("joined", "latin", "chinese", "header", "number"):
        for r in rng.sample(clean, len(clean)):
            bad = len([k for k in planted if k[0] == kind]) < 100 and plant(kind, r["text"], titles, counts, rng)
            if bad:
                planted[kind, len(planted)] = (bad, r["repaired"])
    extra = spark.createDataFrame([("planted", f"{k} {i}", bad) for (k, i), (bad, _) in planted.items()], "table_name string, row_id string, text string")
    got = {r["row_id"]: r for r in scan.repair_texts(source.unionByName(extra), ["table_name", "row_id"]).where("table_name = 'planted'").collect()}
    found, same, n = Counter(), Counter(), Counter()
    for (kind, i), (_, wanted) in planted.items():
        r = got[f"{kind} {i}"]
        n[kind] += 1
        found[kind] += r["n_joined"] + r["n_furniture"] + r["n_replaced"] > 0
        same[kind] += r["repaired"] == wanted
    print({k: (n[k], found[k], same[k]) for k in n})
    assert all(n[k] >= 50 for k in n), n
    assert all(found[k] >= 0.9 * n[k] for k in n), found
    assert all(same[k] >= 0.85 * n[k] for k in n), same


def test_without_its_models_nothing_is_furniture_or_joined(spark, monkeypatch):
    rng = random.Random(3)
    rows = [(f"c{i}", wrapped(rng)) for i in range(300)] + [(f"h{i}", f"{TITLE}   {i}") for i in range(20)] + [("cut", "the trea-\nty of it"), ("two", "the pre-\nand the temple")]
    found = scan.repair_texts(table(spark, rows), ["id"]).where("n_furniture + n_joined > 0").select("id").collect()
    assert {r["id"] for r in found} == {f"h{i}" for i in range(20)} | {"cut"}
    monkeypatch.setattr(scan, "furniture", lambda texts, found: Boosted())
    monkeypatch.setattr(scan, "joins", lambda stats: stats.select("kind", "key", stats.kind.alias("value")).where("false"))
    assert scan.repair_texts(table(spark, rows), ["id"]).where("n_furniture + n_joined > 0").count() == 0
