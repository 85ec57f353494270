import random

import pytest

from pagemill.llm import labels, lookalike

REFERENCE = [("pos", "n.", "noun", "名词"), ("pos", "v.", "verb", "动词"), ("pos", "n./v.", "noun/verb", "名词/动词"), ("pos", "adj.", "adjective", "形容词"), ("pos", "vt.", "transitive verb", "及物动词"), ("pos", "vi.", "intransitive verb", "不及物动词"),
             ("cls", "PAGE_NUMBER", "page number", "页码"), ("cls", "FRONT_MATTER", "front matter", "卷首部分"), ("cls", None, None, None)]


def mapped(spark, values, reference=REFERENCE):
    ref = spark.createDataFrame(reference, "list_name string, code string, label_en string, label_zh string")
    df = spark.createDataFrame([(*v, 1, "x", 0.5) for v in values], "list_name string, value string, gram int, code string, score double")
    return {(r["list_name"], r["value"]): r["code"] for r in labels.map_to_list(df, ref).collect()}


def test_mapping(spark):
    wanted = {
        "N": "n.", "ｎ．": "n.", "noun (n.)": "n.", "n. 名词": "n.", " 名词。": "n.", "[v]": "v.", "nounverb": "n./v.", "noun and verb": "n./v.", "adjetcive": "adj.", "adejctive": "adj.", "intransitiv verb": "vi.", "transitve verb": "vt.",
        "?": "UNMATCHED", "": "UNMATCHED", "headword": "UNMATCHED", "see p. 12": "UNMATCHED", "x" * 50_000: "UNMATCHED",
    }
    got = mapped(spark, [("pos", v) for v in wanted] * 2 + [("pos", None), (None, "n.")])
    assert {k[1]: v for k, v in got.items() if k[0] == "pos"} == wanted
    got = mapped(spark, [("cls", v) for v in ("PageNumber", "type: FRONT_MATTER", "frnot mater", "n.", "页码")])
    assert [got["cls", v] for v in ("PageNumber", "type: FRONT_MATTER", "frnot mater", "n.", "页码")] == ["PAGE_NUMBER", "FRONT_MATTER", "FRONT_MATTER", "UNMATCHED", "PAGE_NUMBER"]


def test_mapping_ties_and_empty(spark):
    twice = [("pos", "a.", "same", None), ("pos", "b.", "same", None)]
    assert mapped(spark, [("pos", "same"), ("pos", "samee")], twice) == {("pos", "same"): "UNMATCHED", ("pos", "samee"): "UNMATCHED"}
    assert mapped(spark, [("pos", "n.")], []) == {("pos", "n."): "UNMATCHED"}
    assert mapped(spark, []) == {}


def test_mapping_to_a_long_list(spark):
    """Swapped letters and a hot value against 3,000 entries, by nothing but the score."""
    rng = random.Random(8)
    words = ["".join(rng.choice("bcdfglmnprstv") + rng.choice("aeiou") for _ in range(rng.randint(2, 4))) for _ in range(600)]
    names = sorted({f"{rng.choice(words)} {rng.choice(words)}" for _ in range(3000)})
    values = {}
    for name in rng.sample(names, 300):
        k = rng.randrange(len(name) - 1)
        values[name[:k] + name[k + 1] + name[k] + name[k + 2 :]] = name
    got = mapped(spark, [("place", v) for v in values] + [("place", next(iter(values)))] * 2000 + [("place", "zzyzx quux")], [("place", n, n, None) for n in names])
    right = sum(got["place", v] == n for v, n in values.items())
    assert right >= 0.98 * len(values) and got["place", "zzyzx quux"] == "UNMATCHED", right


def house(spark, rows):
    df = spark.createDataFrame([(*r, "r", "h", 1) for r in rows], "id string, profile string, text string, raw string, house string, pos int")
    return {r["id"]: r["house"] for r in lookalike.house_form(df, ["id"]).collect()}


def test_house_form(spark):
    rows = [
        ("1", "text", "re​mark"), ("2", "text", "rеmаrk"), ("3", "text", "remark"), ("4", "text", "café"), ("5", "text", "ｅｎｇｉｎｅ\xa0x　y "), ("6", "text", "⽤于，（年）"), ("7", "text", "用于，（年）"),
        ("8", "ipa", "ɡriːn"), ("9", "ipa", "gri:n"), ("10", "ipa", "ʤʌʹ∫"), ("11", "text", None), ("12", "text", ""), ("13", "text", "​"), ("14", "text", "a\nb"), ("15", "text", "ﬆudy ⅿoney"), ("16", "text", "а" * 60_000), ("17", "text", "·@—"),
    ]
    assert house(spark, rows) == {
        "1": "remark", "2": "remark", "4": "café", "5": "engine x y", "6": "用于，（年）", "9": "ɡriːn", "10": "dʒʌˈʃ", "13": "", "15": "study money", "16": "a" * 60_000}
    assert house(spark, []) == {}
    assert house(spark, [("1", "text", "саt")] * 2) == {"1": "cat"}


def test_trie_prefers_vocabulary():
    trie = lookalike.Trie()
    trie.add("Ivy", 2)
    trie.add("ivy", 9)
    choose = lambda c: [(c, 0.0), ("i", 0.0), ("I", 0.0)] if c == "І" else [(c, 0.0), ("", 0.0)] if c == "‍" else [(c, 0.0)]
    assert trie.nearest("Іv‍y", choose, 0.0) == "ivy"
    assert trie.nearest("zvy", choose, 0.0) is None
    assert trie.nearest("", choose, 0.0) is None


@pytest.mark.parametrize("profile", ["text", "ipa"])
def test_fold_is_stable(profile):
    for c in lookalike.TABLES[profile]:
        once = lookalike.fold(chr(c), profile)
        assert lookalike.fold(once, profile) == once, hex(c)


def test_vocabulary_chooses_among_readings(spark):
    rows = [("1", "text", "Ivy"), ("2", "text", "ӏvy"), ("3", "text", "lamp"), ("4", "text", "Іamp"), ("5", "text", "10 cups"), ("6", "text", "1О cups"), ("7", "text", "ӏeaf"), ("8", "text", "Тhe"), ("9", "text", "the")]
    assert house(spark, rows) == {"2": "Ivy", "4": "lamp", "6": "10 cups", "7": "leaf", "8": "The"}


def test_all_the_table_folds_is_found(spark):
    import re

    for profile in ("text", "lemma"):
        pattern = re.compile(re.sub(r"\\x\{(\w+)\}", lambda m: re.escape(chr(int(m.group(1), 16))), lookalike.odd_pattern(profile)))
        assert not [hex(c) for c in lookalike.TABLES[profile] if not pattern.search(f"a{chr(c)}a")]
    rows = [("1", "lemma", "cıty"), ("2", "lemma", "doɡ"), ("3", "text", "a ƅook 3×4"), ("4", "text", "doɡ"), ("5", "lemma", "séance"), ("6", "lemma", "ca\u0301t")]
    assert house(spark, rows) == {"1": "city", "2": "dog", "3": "a book 3x4", "6": "cát"}


def test_automaton_reads_doubles_within_its_budget(spark):
    rows = [("1", "text", "Illinois 100 village"), ("2", "text", "lllіnois"), ("3", "text", "1О0"), ("4", "text", "viІ1age"), ("5", "text", "0О1І"), ("6", "text", "v11І1age")]
    got = house(spark, rows)
    assert got == {"2": "Illinois", "3": "100", "4": "village", "5": "0O1I", "6": "v11I1age"}  # the last two reach no vocabulary
    assert lookalike.fold("lllіnois") == "lllinois" and lookalike.fold("viІ1age") == "viI1age"  # what the table alone gives


def test_long_odd_texts(spark):
    """Some 800 KB with 40,000 different odd tokens in one row."""
    text = " ".join(f"wоrd{i} plain{i}" for i in range(40_000))
    df = spark.createDataFrame([("a", "text", text)], "id string, profile string, text string")
    assert lookalike.house_form(df, ["id"]).first()["house"] == text.replace("о", "o")
