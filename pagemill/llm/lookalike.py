"""One consistent form for text whose characters look the same but differ.

Tokens in house form make up a vocabulary; it is kept as tries, and tokens that are not in house form walk through the
tries with a weighted automaton in which look-alikes and ignorables cost nothing and a plain letter or digit may be read as
its double (l, I, 1) at a price. A token that reaches vocabulary within the budget gets the cheapest, then most frequent
spelling; any other one is normalised by table.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagemill.session import materialize, partitions_for

#: Letters that look like a Latin letter, by that letter.
LATIN_TWINS = {
    "a": "аɑα", "b": "Ьƅ", "c": "сϲᴄ", "d": "ԁⅾ", "e": "еҽ", "f": "ẝ", "g": "ɡց", "h": "һհ", "i": "іıι", "j": "јϳ", "k": "κк", "l": "ⅼӏ∣",
    "m": "ⅿм", "n": "ոп", "o": "оοօ", "p": "рρ", "q": "ԛ", "r": "гᴦ", "s": "ѕꜱ", "u": "υս", "v": "νѵⅴ", "w": "ԝωᴡ", "x": "хⅹ×", "y": "уγү", "z": "ᴢ",
    "A": "АΑ", "B": "ВΒ", "C": "СϹⅭ", "D": "Ⅾ", "E": "ЕΕ", "H": "НΗ", "I": "ІΙӀ", "J": "Ј", "K": "КΚ", "L": "Ⅼ", "M": "МΜⅯ", "N": "Ν", "O": "ОΟ", "P": "РΡ",
    "S": "Ѕ", "T": "ТΤ", "V": "Ⅴ", "X": "ХΧⅩ", "Y": "ΥҮ", "Z": "Ζ", "-": "‐‑‒−﹣－",
}
#: Characters that look like more than one Latin letter or digit; the first is the table's.
AMBIGUOUS = {"ӏ": "lI", "∣": "lI", "Ӏ": "Il", "І": "Il", "Ι": "Il", "О": "O0", "Ο": "O0", "υ": "uv"}
#: Plain characters that print alike; in a token with odd characters one may stand for another at ``DOUBLE_COST``.
DOUBLES = {"I": "l1", "l": "I1", "1": "lI", "O": "0", "0": "O"}
#: Price of reading a plain character as its double, and what a token may cost in all.
DOUBLE_COST, BUDGET = 0.5, 1.0
#: One letter for those that an ambiguous character may stand for, in lower case.
_ONE_OF = str.maketrans({"i": "l", "1": "l", "0": "o", "v": "u"})
#: Letters and signs that look like one of the phonetic alphabet, by that one.
PHONETIC_TWINS = {
    "ˈ": "'’‘ʹ′´＇", "ˌ": "‚", "ː": ":：ː꞉", "ɡ": "gց", "ə": "әǝ", "ɑ": "αᾳ", "æ": "ӕ", "ʃ": "∫ſ", "θ": "ѳϴΘ", "ŋ": "ηղ", "ɛ": "εϵ", "ʒ": "ӡʓ", "ɔ": "ͻ", "ɪ": "ıɩ", "ʌ": "Λ",
    "ð": "δ", "ʊ": "υ", "dʒ": "ʤ", "tʃ": "ʧ", "ts": "ʦ", "dz": "ʣ",
}
#: Chinese radicals of the supplement block that stand for a character, by that character.
RADICAL_TWINS = dict(zip("⺌⺍⺝⺟⺠⺡⺢⺣⺤⺩⺪⺫⺬⺭⺮⺯⺰⺶⺷⺸⺹⺺⺻⺼⺽⺾⻁⻂⻃⻄⻅⻆⻇⻈⻉⻊⻋⻌⻍⻎⻏⻐⻑⻒⻓⻔⻕⻖⻗⻘⻙⻚⻛⻜⻝⻞⻟⻠⻡⻢⻣⻤⻥⻦⻧⻨⻩⻪⻫⻬⻭⻮⻯⻰⻳",
                         "小⺍月母民氵氺灬爫王疒目示礻竹糹纟羊羊羊老聿聿肉臼艹虎衤西西见角角讠贝足车辶辶辶邑钅長镸长门阜阜雨青韦页风飞食食飠饣首马骨鬼鱼鸟卤麦黄黾斉齐歯齿竜龙龟"))
#: Full-width signs that are usual in Chinese text and stay.
CHINESE_SIGNS = "，；：（）！？。、“”‘’《》〈〉「」『』【】—…·"


def _table(twins: dict[str, str]) -> dict[int, str]:
    return {ord(c): to for to, group in twins.items() for c in group if c != to}


def tables() -> dict[str, dict[int, str]]:
    """``str.translate`` tables of the profiles (``lemma`` is ``text`` without phonetic letters), made from the fixed values and Unicode's own mappings."""
    common = {ord(a): b for a, b in RADICAL_TWINS.items() if a != b}
    for start, end in ((0x2F00, 0x2FD6), (0xF900, 0xFAFF), (0xFF01, 0xFFEF), (0x2E80, 0x2EF4), (0xFB00, 0xFB07), (0x2160, 0x2180), (0x1D400, 0x1D7FF), (0x24B6, 0x24EA)):
        for code in range(start, end):
            folded = unicodedata.normalize("NFKC", chr(code))
            if folded != chr(code) and chr(code) not in CHINESE_SIGNS:
                common.setdefault(code, folded)
    for code in (*range(0x2000, 0x200B), 0xA0, 0x202F, 0x205F, 0x3000):
        common[code] = " "
    for code in (0xAD, 0x34F, 0x61C, 0x180E, *range(0x200B, 0x2010), *range(0x202A, 0x202F), *range(0x2060, 0x2070), *range(0xFE00, 0xFE10), 0xFEFF):
        common[code] = ""
    latin = common | _table(LATIN_TWINS)
    phonetic = common | {k: v for k, v in _table(LATIN_TWINS).items() if v.isalpha() and v.islower()} | _table(PHONETIC_TWINS)
    phonetic.pop(ord("ɡ"), None)
    phonetic.pop(ord("ɑ"), None)
    phonetic |= {0xFF07: "ˈ", 0xFF1A: "ː", 0xFF47: "ɡ"}
    latin.pop(ord("ɡ"), None)  # phonetic letters cited in running text are right there
    latin.pop(ord("ɑ"), None)
    lemma = latin | {ord("ɡ"): "g", ord("ɑ"): "a"}
    for table in (latin, lemma, phonetic):  # a replacement may be a look-alike itself
        for _ in range(3):
            table.update({k: v.translate(table) for k, v in table.items()})
    return {"text": latin, "lemma": lemma, "ipa": phonetic}


TABLES = tables()
#: Parts of a hot odd token in the join with its spelling.
SALTS = 8


def fold(text: str, profile: str = "text") -> str:
    """``text`` with every character replaced by the table, composed accents; line breaks stay."""
    return unicodedata.normalize("NFC", unicodedata.normalize("NFC", text).translate(TABLES[profile]))


def odd_pattern(profile: str) -> str:
    """A Java pattern that finds text the table could change; everything else is in house form as it is."""
    if profile == "ipa":
        return "[^a-fh-z ˈˌːɡəɑæʃθðŋɪʊɔɜʌʒɒɛˈ\\-]|^ | $"
    signs = "".join(c for c in CHINESE_SIGNS)
    phonetic = "" if profile == "lemma" else "ɐ-ʣʥʨ-ʰˈ-ː"
    usual = f"\\x00-\\x7FÀ-ɏ{phonetic}一-鿿{signs}"
    folded = "".join(c for c in map(chr, TABLES[profile]) if re.match(f"[{usual}]", c))  # few: a long class is slow
    return f"[^{usual}]|[{folded}]|^\\s|\\s$"


class Trie:
    """A trie of canonical spellings with their counts."""

    def __init__(self):
        self.root: dict = {}

    def add(self, word: str, count: int) -> None:
        node = self.root
        for c in word:
            node = node.setdefault(c, {})
        node[""] = max(count, node.get("", 0))

    def nearest(self, token: str, alternatives, budget: float) -> str | None:
        """The spelling reached at the least cost within ``budget``; among equals the most frequent, then the first.

        The automaton's states are (position in the token, trie node, cost). A step reads one character and follows one
        of its ``alternatives``: ``(string, cost)`` pairs, where the empty string skips an ignorable.
        """
        best: tuple | None = None
        seen: dict[tuple[int, int], float] = {}
        stack = [(0, self.root, 0.0, "")]
        while stack:
            at, node, cost, word = stack.pop()
            if cost > budget or seen.get((at, id(node)), budget + 1) <= cost:
                continue
            seen[at, id(node)] = cost
            if at == len(token):
                if "" in node:
                    found = (cost, -node[""], word)
                    best = found if best is None or found < best else best
                continue
            for string, extra in alternatives(token[at]):
                below = node
                for c in string:
                    below = below.get(c)
                    if below is None:
                        break
                if below is not None:
                    stack.append((at + 1, below, cost + extra, word + string))
        return best[2] if best else None


def _alternatives(profile: str):
    """What a character may stand for: look-alikes cost nothing, so the vocabulary chooses among an ambiguous one's, doubles cost."""
    table = TABLES[profile]

    def of(char: str):
        if profile == "ipa":
            return [(table.get(ord(char), char), 0.0)]
        if char in AMBIGUOUS:
            return [(c, 0.0) for c in AMBIGUOUS[char]]
        return [(table.get(ord(char), char), 0.0), *((c, DOUBLE_COST) for c in DOUBLES.get(char, ""))]

    return of


def _resolve(budget: float):
    """A function for one bucket: its vocabulary and odd tokens to the canonical spellings of the latter."""

    def run(bucket: pd.DataFrame) -> pd.DataFrame:
        odd = bucket[bucket["odd"]]
        wanted = set(zip(odd["profile"], odd["bucket_key"]))
        tries: dict[str, Trie] = {}
        for profile, word, count, is_odd, skeleton in bucket[["profile", "token", "n", "odd", "bucket_key"]].itertuples(index=False):
            if not is_odd and (profile, skeleton) in wanted:
                tries.setdefault(profile, Trie()).add(word, int(count))
        out = []
        for profile, token in zip(odd["profile"], odd["token"]):
            composed = unicodedata.normalize("NFC", token)
            spelling = tries[profile].nearest(composed, _alternatives(profile), budget) if profile in tries else None
            out.append((profile, token, fold(token, profile) if spelling is None else spelling, spelling is not None))
        return pd.DataFrame(out, columns=["profile", "token", "spelling", "in_vocabulary"])

    return run


def _skeletons(df: DataFrame) -> DataFrame:
    """``df`` with the ``bucket_key`` of each token: what is left of it under all steps, the same for all readings."""

    def run(batches):
        for b in batches:
            yield b.assign(bucket_key=[fold(t, p).lower().translate(_ONE_OF) for t, p in zip(b["token"], b["profile"])])

    return df.mapInPandas(run, "profile string, token string, n long, odd boolean, bucket_key string")


def spellings(tokens: DataFrame, budget: float = BUDGET, per_bucket: int = 50_000) -> DataFrame:
    """``profile, token, spelling, in_vocabulary`` of the odd ones of distinct ``profile, token, n, odd``.

    All steps keep a token's skeleton, so vocabulary and odd tokens meet in buckets of skeleton hashes: each
    bucket has the whole part of the vocabulary its tokens can reach, and the number of buckets follows the number
    of distinct tokens.
    """
    buckets = partitions_for(tokens.sparkSession, tokens.count(), per_bucket)
    keyed = _skeletons(tokens).withColumn("bucket", F.pmod(F.xxhash64("bucket_key"), F.lit(buckets)).cast("int"))
    return keyed.groupBy("bucket").applyInPandas(_resolve(budget), "profile string, token string, spelling string, in_vocabulary boolean")


_SEPARATORS = re.compile(r"([ \n\r\t])")
_BLANKS = dict.fromkeys((*range(0x2000, 0x200B), 0xA0, 0x202F, 0x205F, 0x3000), " ")


def _pieces(text: Column) -> Column:
    """Tokens and single separators in order; Unicode blanks other than line breaks count as a space."""
    return F.split(text, r"(?<=[ \n\r\t])|(?=[ \n\r\t])")


def _spaced(text: Column) -> Column:
    blanks = "".join(map(chr, _BLANKS))
    return F.translate(text, blanks, " " * len(blanks))


def house_form(df: DataFrame, key: list[str], text: str = "text", profile: str = "profile") -> DataFrame:
    """``key, house`` of the rows whose text is not in house form as it stands, ``house`` the text in house form.

    ``profile`` is ``text``, ``lemma`` or ``ipa``. Rows that are in house form are not returned (their text is its own house form).
    The vocabulary comes from all rows, counted with map-side combination, so a hot token is one row per task. Only odd
    tokens leave their rows, each once and under a digest of the row, and meet their spellings in a salted join; the
    texts themselves are moved once, to meet their spellings, so the shuffle is linear in their length.

    Defined results: null texts give no row; an empty text is in house form, one of blanks only becomes empty; texts
    of any length are cut into tokens; repeated keys give one row each; no vocabulary leaves the table alone.
    """
    rows = df.where(F.col(text).isNotNull()).select(*key, F.col(profile).alias("profile"), F.col(text).alias("__text"))
    is_odd = lambda c: F.when(F.col("profile") == "ipa", c.rlike(odd_pattern("ipa"))).when(F.col("profile") == "lemma", c.rlike(odd_pattern("lemma"))).otherwise(c.rlike(odd_pattern("text")))
    flagged = rows.withColumn("__odd", is_odd(F.col("__text")))
    words = flagged.select("profile", F.explode(_pieces(_spaced(F.col("__text")))).alias("token")).where("trim(token) <> '' AND token NOT IN ('\n', '\r', '\t')")
    counted = words.groupBy("profile", "token").agg(F.count("*").alias("n")).withColumn("odd", is_odd(F.col("token")))
    mapping = spellings(materialize(counted, "tokens")).select("profile", "token", "spelling")
    digest = F.sha2(F.concat_ws("\u0001", F.to_json(F.struct(*key, "profile")), "__text"), 256)
    odd_rows = materialize(flagged.where("__odd").drop("__odd").distinct().withColumn("__id", digest), "odd-rows")
    odd_tokens = odd_rows.select("__id", "profile", F.explode(F.array_distinct(F.filter(_pieces(_spaced(F.col("__text"))), is_odd))).alias("token"))
    odd_tokens = odd_tokens.withColumn("salt", F.pmod(F.xxhash64("__id"), F.lit(SALTS)).cast("int"))
    salted = mapping.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    found = odd_tokens.join(salted, ["profile", "token", "salt"]).groupBy("__id").agg(F.collect_list(F.struct("token", "spelling")).alias("__new"))
    whole = odd_rows.join(found, "__id", "left").select(*key, F.col("__text").alias("raw"), "__new")
    return _rewritten(whole).where("raw <> house")


def _rewritten(df: DataFrame) -> DataFrame:
    """``raw`` with its tokens respelled by ``__new`` as ``house``; Arrow batches, the other columns pass untouched."""
    schema = T.StructType([*[f for f in df.schema.fields if f.name != "__new"], T.StructField("house", T.StringType())])

    def run(batches):
        for b in batches:
            house = []
            for text, pairs in zip(b.column("raw").to_pylist(), b.column("__new").to_pylist()):
                new = {x["token"]: x["spelling"] for x in pairs or ()}
                house.append("".join(new.get(w, w) for w in _SEPARATORS.split(text.translate(_BLANKS))).strip(" \n\r\t"))
            kept = [i for i, name in enumerate(b.schema.names) if name != "__new"]
            yield pa.RecordBatch.from_arrays([*[b.column(i) for i in kept], pa.array(house, pa.string())], names=[*[b.schema.names[i] for i in kept], "house"])

    return df.mapInArrow(run, schema)
