"""Lines of scanned text: page furniture, word parts at line ends, words and Chinese contexts. Pure functions."""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections import Counter

from pagemill.llm.lookalike import TABLES

#: What a recogniser reads for what is printed.
CONFUSIONS = (
    ("c", "e"), ("e", "c"), ("@", "a"), ("5", "s"), ("1", "i"), ("1", "l"), ("l", "i"), ("i", "l"), ("0", "o"), ("cl", "d"), ("d", "cl"), ("ri", "n"), ("ii", "u"), ("b", "h"), ("h", "b"),
    ("rn", "m"), ("m", "rn"), ("m", "in"), ("m", "ni"), ("6", "b"), ("vv", "w"), ("9", "g"), ("8", "b"), ("h", "li"), ("f", "t"), ("t", "f"), ("u", "n"), ("n", "u"), ("n", "ri"), ("$", "s"), ("|", "l"), ("q", "g"), ("u", "ii"),
)
#: Chinese characters that recognisers take for each other, in groups.
CHINESE_CONFUSIONS = ("人入八", "未末", "日曰目", "天夭", "时吋", "千干于", "己已巳", "土士", "大太犬", "刀力", "午牛", "木本", "王玉", "田由", "问间", "贝见", "今令", "折拆", "侯候", "住往", "治冶", "戊戌", "代伐", "待侍", "名各", "处外")
_GROUP_OF = {c: g for g in CHINESE_CONFUSIONS for c in g}

_ODD = re.compile("[" + "".join(re.escape(chr(c)) for c in sorted(TABLES["text"]) if c < 0x10000) + "̀-ͯ]")
_WORD = re.compile(r"[A-Za-zÀ-ɏ0-9@$|]+")
_IPA = re.compile(r"\[[^\[\]\n]*[^\x00-\x7f\n][^\[\]\n]*\]|\[[a-z]+\]|/[^/\n ]*[ˈːəɪʊɔɜʌæɑʃʒθðŋɡ][^/\n]*/")
_HYPHEN = re.compile(r"([A-Za-zÀ-ɏ0-9@]+)[-¬‐­]\s*$")
_NEXT = re.compile(r"^\s*([A-Za-zÀ-ɏ0-9@]+)")
_HAN = "一-鿿"
_DIGIT = "[0-9lOoISi|]"
_END = re.compile(r"[.!?。！？；;:：…]['\"”’）)]*\s*$")
_ROMAN = re.compile(r"^(?=[clxvi])(?:c{0,3})(?:xc|xl|l?x{0,3})(?:ix|iv|v?i{0,3})$")
_COUNT = re.compile(rf"^(?:[—–·\-\[(]\s*)?({_DIGIT}+)\s*(?:[—–·\-\])]|\.)?$")
_ALL_MISREAD = re.compile(r"^(?:[lI|]{0,3}O[lIO|]{0,3}\.?|[lI|]{2,4}\.)$")
_NO_COUNT = re.compile(r"[^0-9lOoISi|clxviCLXVI\s—–·\-\[\]().pP/]")
_ANY_DIGIT = re.compile(r"\d")
_OF = re.compile(rf"^({_DIGIT}+)\s*/\s*({_DIGIT}+)$")
_PAGE = re.compile(rf"^(\w{{4,5}})\s+({_DIGIT}+)(?:\s+\w{{2}}\s+({_DIGIT}+))?$")
_P = re.compile(rf"^p\s?\.\s*({_DIGIT}+)$", re.I)
_CHINESE_PAGE = re.compile(rf"^第\s*{_DIGIT}+\s*页$")


def tidy(text: str) -> str:
    """``text`` with look-alike characters folded (they are no scanning noise)."""
    if text.isascii() or not (_ODD.search(text) or max(text) > "￿"):
        return text
    return unicodedata.normalize("NFC", text.translate(TABLES["text"]))


_SINGLE = str.maketrans({"0": "o", "1": "i", "l": "i", "|": "i", "5": "s", "$": "s", "9": "g", "q": "g", "6": "h", "8": "h", "b": "h", "@": "a", "e": "c", "f": "t", "u": "n"})


def shapes(word: str) -> tuple[str, str]:
    """Two skeletons of a word: single look-alikes folded, and letter pairs that look like one letter merged first."""
    word = word.lower()
    merged = word
    for pair, one in (("rn", "m"), ("ii", "u"), ("cl", "d"), ("ri", "n"), ("vv", "w"), ("li", "h"), ("in", "m"), ("ni", "m")):
        merged = merged.replace(pair, one)
    return word.translate(_SINGLE), merged.translate(_SINGLE)


def core_key(core: str) -> str:
    """What readings of one title have in common; a digest if it is long."""
    key = " ".join(shapes(core)[1].split())
    return key if len(key) <= 120 else hashlib.sha1(key.encode()).hexdigest()


_PAGE_WORDS = {shapes("page")[1]}
_UNIT_WORDS = {shapes("unit")[1]}
_OF_WORDS = {"ot"}


def is_count(line: str) -> bool:
    """A line that looks like a page number and nothing else, with misread digits too."""
    s = line.strip()
    # without a digit only these characters can make up a page number
    if not s or ("页" not in s and _NO_COUNT.search(s) and not _ANY_DIGIT.search(s)):
        return False
    if _ALL_MISREAD.match(s):
        return True
    m = _COUNT.match(s) or _OF.match(s) or _P.match(s)
    if m and (any(c.isdigit() for c in m.group(0)) or (len(s) > len(m.group(1)) and not s[0].isalpha())):
        return True
    if _CHINESE_PAGE.match(s):
        return True
    m = _PAGE.match(s)
    if m and shapes(m.group(1))[1] in _PAGE_WORDS and (m.group(3) is None or any(c.isdigit() for c in m.group(3))):
        return any(c.isdigit() for c in s)
    roman = s.lower().replace("1", "i")
    return bool(_ROMAN.match(roman) or _ROMAN.match(s.lower().replace("1", "l"))) and (s == s.lower() or s == s.upper())


_ADORNED = (
    re.compile(rf"^{_DIGIT}+\s{{2,}}(.+)$"), re.compile(rf"^(.+?)\s{{2,}}{_DIGIT}+$"),
    re.compile(rf"^(.+?)\s*第\s*{_DIGIT}+\s*单元$"),
)
_GAP = re.compile(r"\s\s")
_WORD_LIST = shapes("word list")[1]
_UNIT = re.compile(rf"^(\w{{3,5}})\s*{_DIGIT}+\s*[·.:\-—]\s*(.+)$")
_BAR = re.compile(r"^(.+?)\s*\|\s*(.+)$")
_NO_TITLE = re.compile(r"[.,;:!?，。；：！？、（）()\[\]*\"“”=]")
_LATIN_TITLE = re.compile(r"^[A-Za-zÀ-ɏ0-9@$|'’\-]+(?: [A-Za-zÀ-ɏ0-9@$|'’\-]+)+$")
_HAN_TITLE = re.compile(rf"^[{_HAN}]{{3,}}$")


def _titled(core: str) -> str | None:
    core = core.strip()
    if not core or _NO_TITLE.search(core):
        return None
    if _HAN_TITLE.match(core):
        return core
    if _LATIN_TITLE.match(core):
        first = [w[0] for w in core.split()]
        if core.upper() == core or sum(c.isupper() or c.isdigit() for c in first) * 2 >= len(first):
            return core_key(core)
    return None


def title_cores(line: str) -> tuple[bool, list[str]]:
    """``(adorned, cores)``: keys of what may be the title in a running header; adorned with a number, unit or bar."""
    s = line.strip()
    if not s or (s[0] in "wWvV" and shapes(s[:9])[1].startswith(_WORD_LIST)):
        return False, []
    if _GAP.search(s) or "单元" in s:
        for pattern in _ADORNED:
            m = pattern.match(s)
            if m and (core := _titled(m.group(1))):
                return True, [core]
    m = _UNIT.match(s)
    if m and shapes(m.group(1))[1] in _UNIT_WORDS and (core := _titled(m.group(2))):
        return True, [core]
    m = _BAR.match(s) if "|" in s else None
    if m:
        both = [_titled(m.group(1)), _titled(m.group(2))]
        if all(both):
            return True, both
    core = _titled(s)
    return False, [core] if core else []


def lines_of(text: str) -> list[str]:
    return re.split(r"\r\n|\r|\n", text)


def line_features(before: str | None, line: str, after: str | None, facts: tuple[bool, bool, list[str]], evidence: tuple[int, int, int]) -> tuple[int, ...]:
    """What a pair of lines tells of the second one: small whole numbers, so that equal cases are judged once.

    ``facts`` are ``(looks like a page number, adorned, cores)``, ``evidence`` how often the core stands in the corpus with
    number, unit or bar, without, and as a whole text. ``before`` and ``after`` are the neighbours that are no blank lines.
    """
    s = line.strip()
    count, adorned, cores = facts
    words = s.split()
    letters = [w[0] for w in words]
    n = max(len(s), 1)
    return (
        count, bool(_ALL_MISREAD.match(s)), adorned, bool(cores), *(x.bit_length() for x in evidence), min(len(words), 16), len(s).bit_length(), 8 * len(_ANY_DIGIT.findall(s)) // n,
        4 * sum(c.isupper() or c.isdigit() for c in letters) // max(len(letters), 1), "一" <= s[:1] <= "鿿", bool(_NO_TITLE.search(s)), bool(_END.search(s)), before is None, after is None,
        before is not None and not _END.search(before), after is not None and (after.lstrip()[:1].islower() or "一" <= after.lstrip()[:1] <= "鿿"), before is not None and bool(_HYPHEN.search(before)),
    )


def facts_of(line: str) -> tuple[bool, bool, list[str]]:
    adorned, cores = title_cores(line)
    return is_count(line), adorned, cores


def neighbours(lines: list[str], i: int) -> tuple[str | None, str | None]:
    """The lines before and after line ``i`` that are not blank."""
    before = next((lines[k] for k in range(i - 1, -1, -1) if lines[k].strip()), None)
    return before, next((lines[k] for k in range(i + 1, len(lines)) if lines[k].strip()), None)


def _fragments(lines: list[str], furniture: set[int]) -> list[tuple[int, int, str, str]]:
    """``(line, next line, left, right)`` where a line ends in a word part with a hyphen; furniture is stepped over."""
    out, following = [], None
    for i in range(len(lines) - 1, -1, -1):
        if i in furniture:
            continue
        m = _HYPHEN.search(lines[i]) if following is not None else None
        n = _NEXT.match(lines[following]) if m else None
        if n:
            out.append((i, following, m.group(1).lower(), n.group(1).lower()))
        following = i
    return out[::-1]


_GROUPED = re.compile("[" + "".join(CHINESE_CONFUSIONS) + "]")


def han_windows(text: str) -> list[tuple[int, str]]:
    """``(position, three characters)`` around each Chinese character that has a look-alike; ``^`` for no neighbour.

    Line breaks do not separate Chinese characters.
    """
    out = []
    beside = lambda c: c if "一" <= c <= "鿿" else "^"
    for m in _GROUPED.finditer(text):
        i, j, k = m.start(), m.start() - 1, m.end()
        while j >= 0 and text[j] in "\r\n":
            j -= 1
        while k < len(text) and text[k] in "\r\n":
            k += 1
        out.append((i, beside(text[j] if j >= 0 else "^") + text[i] + beside(text[k] if k < len(text) else "^")))
    return out


def without_ipa(line: str) -> str:
    if "[" not in line and "/" not in line:
        return line
    return _IPA.sub(lambda m: " " * len(m.group(0)), line)


def observe(text: str) -> Counter:
    """What one text adds to the corpus statistics: ``(kind, key)`` counts.

    ``w`` words, ``j`` word parts over a line end, ``a`` / ``b`` title cores with and without number, unit or bar,
    ``s`` bare cores that are a whole text by themselves, ``h`` Chinese contexts.
    """
    found: Counter = Counter()
    text = tidy(text)
    lines = lines_of(text)
    facts = [facts_of(line) for line in lines]
    cut: dict[int, list] = {}
    for i, j, left, right in _fragments(lines, {i for i, (count, adorned, _) in enumerate(facts) if count or adorned}):
        found["j", f"{left}\t{right}"] += 1
        cut.setdefault(i, []).append("left")
        cut.setdefault(j, []).append("right")
    body = []
    for i, line in enumerate(lines):
        count, adorned, cores = facts[i]
        if count:
            continue
        for core in cores:
            found["a" if adorned else "b", core] += 1
            if not adorned and len(lines) == 1:
                found["s", core] += 1
        if adorned:
            continue
        words = _WORD.findall(without_ipa(line))
        if "left" in cut.get(i, ()) and words:
            words = words[:-1]
        if "right" in cut.get(i, ()) and words:
            words = words[1:]
        for w in words:
            if not w.isdigit():
                found["w", w.lower()] += 1
        body.append(line)
    for _, window in han_windows("\n".join(body)):
        found["h", window] += 1
    return found


def keys_of(text: str, decision) -> set[tuple[str, str]]:
    """The decisions that :func:`repair` asks for, given those that ``decision`` knows; further ones may follow from the answers."""
    asked = set()

    def ask(kind: str, key):
        if kind != "f":
            asked.add((kind, key))
        return decision(kind, key)

    repair(text, ask)
    return asked


def evidence_of(cores: list[str], decision) -> tuple[int, int, int]:
    """The least evidence of all cores; each answer reads ``with,without,alone``."""
    all_ = [tuple(map(int, (decision("t", c) or "0,0,0").split(","))) for c in cores]
    return tuple(map(min, zip(*all_))) if all_ else (0, 0, 0)


def furniture_of(lines: list[str], decision) -> set[int]:
    """The lines that the classifier of line pairs takes for page numbers and running headers."""
    found = set()
    for i, line in enumerate(lines):
        if not line.strip():
            continue
        facts = facts_of(line)
        evidence = evidence_of(facts[2], decision)
        if facts[2] and not any(evidence):  # a title may have misread words
            mended = facts_of(_WORD.sub(lambda m: decision("w", m.group(0).lower()) or m.group(0), line))
            better = evidence_of(mended[2], decision)
            facts, evidence = (mended, better) if any(better) else (facts, evidence)
        before, after = neighbours(lines, i)
        if decision("f", line_features(before, line, after, facts, evidence)):
            found.add(i)
    return found


def repair(text: str, decision) -> tuple[str, int, int, int]:
    """``(repaired, joined words, furniture lines, replaced characters)``.

    ``decision(kind, key)`` gives a word's or context's replacement, whether parts join, the evidence for a title, whether
    features are those of furniture; None for no. Lines of a paragraph are put together with a space, without one between
    Chinese characters.
    """
    plain = tidy(text)
    lines = lines_of(plain)
    furniture = furniture_of(lines, decision)
    joins = {i: j for i, j, left, right in _fragments(lines, furniture) if decision("j", f"{left}\t{right}")}
    kept = [i for i in range(len(lines)) if i not in furniture]
    out, gaps, join_next = "", [], False
    for i in kept:
        line = lines[i]
        if join_next:
            out += line.lstrip()
        elif out and line.strip():
            tight = re.match(rf"[{_HAN}，。；：！？、（）]", out[-1]) and re.match(rf"[{_HAN}，。；：！？、（）]", line.lstrip()[:1] or " ")
            out = out.rstrip() + ("" if tight else " ") + line.lstrip()
        else:
            out += line
        join_next = i in joins
        if join_next:
            out = re.sub(r"[-¬‐­]\s*$", "", out)
    replaced = 0

    def word(m: re.Match) -> str:
        nonlocal replaced
        w = m.group(0)
        if w.isdigit():
            return w
        to = decision("w", w.lower())
        if not to:
            return w
        replaced += 1
        return to.upper() if w.isupper() and len(w) > 1 else to.capitalize() if w[0].isupper() else to

    mask = without_ipa(out)
    pieces, at = [], 0
    for m in _WORD.finditer(mask):
        pieces += [out[at : m.start()], word(m)]
        at = m.end()
    out = "".join([*pieces, out[at:]])
    letters = list(out)
    for i, window in han_windows(out):
        to = decision("h", window)
        if to:
            letters[i] = to
            replaced += 1
    return "".join(letters).strip(), len(joins), len(furniture), replaced
