"""The grammar of a vocabulary book's lines as column expressions; the marks of the book are parameters."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagemill.functions.text import squeezed


@dataclass(frozen=True)
class Grammar:
    """Fixed values of the book: what its lines look like."""

    word_list: str = r"(?i)^Word List (\d+)$"
    head: str = r"^([A-Za-z][A-Za-z'’-]*)(\*)? \[([^\]]+)\]"
    bare_head: str = r"^([A-Za-z][A-Za-z'’-]*)(\*)?$"
    marks: str = "记搭例派同反"
    field_names: tuple[str, ...] = ("MEMORY_NOTE", "COLLOCATION", "EXAMPLE", "DERIVATIVE", "SYNONYM", "ANTONYM")
    page_number: str = r"^\d{1,4}$"
    other_section: str = r"^[一二三四五六七八九十]+ 雅思"
    preview_header: str = "词根/词缀预习表"
    preview_cells: tuple[str, ...] = ("词根/词缀预习表", "词根/词", "缀", "含义", "例词及释义")
    decorations: tuple[str, ...] = ("音频", "影视剧场景")
    parts_of_speech: tuple[str, ...] = ("n", "v", "vt", "vi", "adj", "adv", "prep", "conj", "pron", "num", "art")
    line_parts_of_speech: tuple[str, ...] = ("n", "v", "vt", "vi", "adj", "adv", "prep", "conj", "pron", "det", "excl")

    @property
    def sense(self) -> str:
        token = rf"(?:{'|'.join(self.parts_of_speech)})\."
        return rf"^({token}(?:/{token})*)\s*(.*)$"

    @property
    def one_line(self) -> str:
        token = rf"(?:{'|'.join(self.line_parts_of_speech)})\."
        return rf"^([A-Za-z][A-Za-z'’-]{{1,63}})(?: /([^/]+)/)?(?: ({token}(?:/{token})*))?(?: (.+))?$"


BOOK = Grammar()


def line_class(line: Column, g: Grammar = BOOK) -> Column:
    """The class of a line whatever stands around it; the first rule that holds decides."""
    return class_of(squeezed(F.coalesce(line, F.lit(""))), g)


def class_of(s: Column, g: Grammar = BOOK) -> Column:
    """``line_class`` of a line that is squeezed already."""
    return (
        F.when(s == "", "EMPTY")
        .when(s.rlike(g.word_list), "WORD_LIST_HEADER")
        .when(s == g.preview_header, "PREVIEW_TABLE_HEADER")
        .when(s.rlike(g.other_section) | (F.upper(s) == "INDEX"), "NON_ENTRY_SECTION_HEADER")
        .when(s.rlike(g.head), "ENTRY_HEAD")
        .when(s.isin(*g.preview_cells), "PREVIEW_TABLE")
        .when(s.rlike(f"^[{g.marks}](?: |$)"), "ENTRY_FIELD")
        .when(s.rlike(g.page_number), "PAGE_NUMBER")
        .when(s.isin(*g.decorations), "DECORATION")
        .otherwise("BODY_TEXT")
    )


def confidence_of(kind: Column) -> Column:
    """How sure each class is; fixed values."""
    values = {"EMPTY": 1.0, "WORD_LIST_HEADER": 0.99, "PREVIEW_TABLE_HEADER": 0.99, "NON_ENTRY_SECTION_HEADER": 0.99, "ENTRY_HEAD": 0.98, "PREVIEW_TABLE": 0.95, "ENTRY_FIELD": 0.96, "PAGE_NUMBER": 0.98, "DECORATION": 0.98}
    return F.coalesce(F.create_map(*[x for k, v in values.items() for x in (F.lit(k), F.lit(v))])[kind], F.lit(0.6))


def word_list_number(line: Column, g: Grammar = BOOK) -> Column:
    return F.regexp_extract(squeezed(line), g.word_list, 1).try_cast("int")


def head_parts(line: Column, g: Grammar = BOOK) -> Column:
    """``struct<lemma, starred, ipa>`` of a head with or without transcription; null for another line."""
    return head_of(squeezed(line), g)


def head_of(s: Column, g: Grammar = BOOK) -> Column:
    """``head_parts`` of a line that is squeezed already."""
    full = F.struct(F.regexp_extract(s, g.head, 1).alias("lemma"), (F.regexp_extract(s, g.head, 2) == "*").alias("starred"), F.regexp_extract(s, g.head, 3).alias("ipa"))
    bare = F.struct(F.regexp_extract(s, g.bare_head, 1).alias("lemma"), (F.regexp_extract(s, g.bare_head, 2) == "*").alias("starred"), F.lit(None).cast("string").alias("ipa"))
    return F.when(s.rlike(g.head), full).when(s.rlike(g.bare_head), bare)


def is_bare_head(line: Column, bold_lines: Column, g: Grammar = BOOK) -> Column:
    """A headword alone on a line that is printed bold."""
    s = squeezed(line)
    return s.rlike(g.bare_head) & F.coalesce(F.array_contains(bold_lines, s), F.lit(False))
