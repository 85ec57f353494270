"""Entries to canonical fields: a fold over the lines of each entry inside its row, without any shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.functions import grammar as G
from pagemill.functions.text import joined, let, lines, squeezed

_IPA_LINE = r"^\[([^\]]+)\]\s*(.*)$"


def _seen(line: Column, g: G.Grammar) -> Column:
    """All that can be said of a squeezed line by itself, computed once: the fold only looks at it."""
    names = F.create_map(*[x for mark, name in zip(g.marks, g.field_names) for x in (F.lit(mark), F.lit(name))])
    body = F.regexp_extract(line, _IPA_LINE, 2)
    is_ipa = line.rlike(_IPA_LINE) & ((body == "") | body.rlike(g.sense))
    parts = F.struct(
        line.alias("line"), G.class_of(line, g).alias("kind"), names[F.left(line, F.lit(1))].alias("mark"), F.trim(F.substring(line, 2, 2**31 - 1)).alias("payload"),
        F.when(is_ipa, F.regexp_extract(line, _IPA_LINE, 1)).alias("ipa"), F.when(is_ipa, body).otherwise(line).alias("rest"),
    )
    is_sense = lambda x: x["rest"].rlike(g.sense)
    return let(parts, lambda x: F.struct(
        x["line"].alias("line"), x["kind"].alias("kind"), x["mark"].alias("mark"), x["payload"].alias("payload"), x["ipa"].alias("ipa"), x["rest"].alias("rest"),
        F.when(is_sense(x), F.struct(F.regexp_extract(x["rest"], g.sense, 1).alias("pos"), F.trim(F.regexp_extract(x["rest"], g.sense, 2)).alias("definition"))).alias("sense"),
    ))


def _state(active: Column, ipas: Column, senses: Column, fields: Column, loose: Column) -> Column:
    return F.struct(active.alias("active"), ipas.alias("ipas"), senses.alias("senses"), fields.alias("fields"), loose.alias("loose"))


def _unmarked(state: Column, x: Column) -> Column:
    """After a line outside marked fields: a transcription, a sense, the rest of a sense, or loose text."""
    ipas = F.when(x["ipa"].isNotNull(), F.concat(state["ipas"], F.array(x["ipa"]))).otherwise(state["ipas"])
    n = F.size(state["senses"])
    longer = lambda s: F.struct(s["pos"].alias("pos"), joined(s["definition"], x["rest"]).alias("definition"))
    senses = (
        F.when(x["rest"] == "", state["senses"]).when(x["sense"].isNotNull(), F.concat(state["senses"], F.array(x["sense"])))
        .when(n > 0, F.concat(F.slice(state["senses"], 1, n - 1), F.array(longer(F.element_at(state["senses"], -1))))).otherwise(state["senses"])
    )
    loose = F.when((x["rest"] != "") & x["sense"].isNull() & (n == 0), F.concat(state["loose"], F.array(x["rest"]))).otherwise(state["loose"])
    return _state(state["active"], ipas, senses, state["fields"], loose)


def _step(state: Column, x: Column) -> Column:
    """The state after one line."""
    value = lambda kind, text: F.array(F.struct(kind.alias("type"), text.alias("text")))
    marked = _state(x["mark"], state["ipas"], state["senses"], F.when(x["payload"] != "", F.concat(state["fields"], value(x["mark"], x["payload"]))).otherwise(state["fields"]), state["loose"])
    n = F.size(state["fields"])
    # a field's value goes on in the last one of its type, which a mark alone on its line may have left behind
    last = n - F.array_position(F.reverse(F.transform(state["fields"], lambda f: f["type"])), state["active"])
    more = F.transform(state["fields"], lambda f, i: F.when(i == last, F.struct(f["type"].alias("type"), F.trim(F.concat(f["text"], F.lit(" "), x["line"])).alias("text"))).otherwise(f))
    continues = F.exists(state["fields"], lambda f: f["type"] == state["active"])
    continued = _state(state["active"], state["ipas"], state["senses"], F.when(continues, more).otherwise(F.concat(state["fields"], value(state["active"], x["line"]))), state["loose"])
    skipped = x["kind"].isin("WORD_LIST_HEADER", "PREVIEW_TABLE_HEADER", "PREVIEW_TABLE", "PAGE_NUMBER", "DECORATION")
    return F.when(x["kind"] == "ENTRY_FIELD", marked).when(skipped, state).when(state["active"].isNotNull(), continued).otherwise(_unmarked(state, x))


def parsed(text: Column, g: G.Grammar = G.BOOK) -> Column:
    """``struct<lemma, starred, ipa, ipas, senses, fields, loose>`` of an entry's text; null if it has no headword.

    ``fields`` holds ``struct<type, text>`` in order. A mark alone on its line makes the next line its value; lines after
    a marked one continue it; headings, page numbers and decorations inside an entry are left out.
    """
    return let(F.transform(lines(text), squeezed), lambda ls: let(G.head_of(F.get(ls, F.lit(0)), g), lambda head: F.when(head.isNotNull(), _folded(ls, head, g))))


def _folded(ls: Column, head: Column, g: G.Grammar) -> Column:
    first = F.get(ls, F.lit(0))
    body = F.when(first.rlike(g.head), F.trim(F.regexp_replace(first, g.head, ""))).otherwise("")
    none = lambda t: F.expr(f"cast(array() as {t})")
    ipas = F.when(head["ipa"].isNotNull(), F.array(head["ipa"])).otherwise(none("array<string>"))
    start = _state(F.lit(None).cast("string"), ipas, none("array<struct<pos:string,definition:string>>"), none("array<struct<type:string,text:string>>"), none("array<string>"))
    begun = let(start, lambda s: F.when(body == "", s).otherwise(let(_seen(body, g), lambda x: _unmarked(s, x))))
    rest = F.transform(F.slice(ls, 2, F.greatest(F.size(ls) - 1, F.lit(0))), lambda line: _seen(line, g))
    return let(F.aggregate(rest, begun, _step), lambda f: F.struct(
        head["lemma"].alias("lemma"), head["starred"].alias("starred"), F.get(f["ipas"], F.lit(0)).alias("ipa"), f["ipas"].alias("ipas"), f["senses"].alias("senses"), f["fields"].alias("fields"), f["loose"].alias("loose"),
    ))


def parsed_line(text: Column, g: G.Grammar = G.BOOK) -> Column:
    """``struct<lemma, ipa, pos, definition>`` of an entry written on one line; null if it does not match."""
    s = squeezed(text)
    part = lambda i: F.nullif(F.trim(F.regexp_extract(s, g.one_line, i)), F.lit(""))
    return F.when(s.rlike(g.one_line), F.struct(part(1).alias("lemma"), part(2).alias("ipa"), part(3).alias("pos"), part(4).alias("definition")))


def dispatched(text: Column, g: G.Grammar = G.BOOK) -> Column:
    """``struct<parser, failure, lemma, ipas, senses, fields>`` by the parser that a text's form asks for.

    A transcription in brackets on the first line, or a bare headword with lines below it, is an entry of the book; anything
    else is read as one line. A text that neither parser reads has ``parser`` none and a ``failure``: no row is lost.
    """
    senses_of = "array<struct<pos:string,definition:string>>"

    def choose(ls: Column) -> Column:
        first = F.get(ls, F.lit(0))
        book = (first.contains("[") & first.contains("]")) | ((F.size(ls) > 1) & squeezed(first).rlike(g.bare_head))
        b, o = parsed(text, g), parsed_line(text, g)
        none = F.lit(None).cast("string")
        result = lambda parser, failure, lemma, ipas, senses, fields: F.struct(parser.alias("parser"), failure.alias("failure"), lemma.alias("lemma"), ipas.alias("ipas"), senses.alias("senses"), fields.alias("fields"))
        empty = [F.expr(f"cast(array() as {t})") for t in ("array<string>", senses_of, "array<struct<type:string,text:string>>")]
        sense = F.when(o["pos"].isNotNull() | o["definition"].isNotNull(), F.array(F.struct(o["pos"].alias("pos"), o["definition"].alias("definition")))).otherwise(empty[1])
        return (
            F.when(F.size(ls) == 0, result(none, F.lit("EMPTY_TEXT"), none, *empty))
            .when(book & b.isNotNull(), result(F.lit("book"), none, b["lemma"], b["ipas"], b["senses"], b["fields"]))
            .when(book, result(none, F.lit("NO_HEADWORD"), none, *empty))
            .when(o.isNotNull(), result(F.lit("line"), none, o["lemma"], F.array_compact(F.array(o["ipa"])), sense, empty[2]))
            .otherwise(result(none, F.lit("NO_KNOWN_FORMAT"), none, *empty))
        )

    return let(lines(F.coalesce(text, F.lit(""))), choose)


def fields_table(entries: DataFrame, key: str, text: str) -> DataFrame:
    """``key, field_type, field_order, text, language``: the marked fields of each entry, numbered per type."""
    fields = entries.select(key, parsed(F.col(text))["fields"].alias("fs")).select(key, F.posexplode("fs").alias("i", "f"), "fs")
    order = F.size(F.filter(F.slice(F.col("fs"), 1, F.col("i") + 1), lambda f: f["type"] == F.col("f.type")))
    language = F.when(F.col("f.type") == "MEMORY_NOTE", "zh")
    return fields.select(key, F.col("f.type").alias("field_type"), order.alias("field_order"), F.col("f.text").alias("text"), language.alias("language"))


def senses_table(entries: DataFrame, key: str, text: str) -> DataFrame:
    """``key, sense_order, part_of_speech, definition``."""
    return entries.select(key, F.posexplode(parsed(F.col(text))["senses"]).alias("i", "s")).select(key, (F.col("i") + 1).alias("sense_order"), F.col("s.pos").alias("part_of_speech"), F.col("s.definition").alias("definition"))


def pronunciations_table(entries: DataFrame, key: str, text: str) -> DataFrame:
    """``key, pronunciation_order, ipa``."""
    return entries.select(key, F.posexplode(parsed(F.col(text))["ipas"]).alias("i", "ipa")).select(key, (F.col("i") + 1).alias("pronunciation_order"), "ipa")


def provenance(entries: DataFrame, key: str, blocks: str, text: str) -> DataFrame:
    """``key, field_path, source_block_id``: every canonical field with the first block of its entry."""
    p = entries.select(key, F.get(F.col(blocks), F.lit(0)).alias("source_block_id"), parsed(F.col(text)).alias("p")).where("p IS NOT NULL")
    paths = F.concat(
        F.array(F.lit("lemma")), F.transform("p.ipas", lambda x, i: F.concat(F.lit("pronunciations."), i.cast("string"))), F.transform("p.senses", lambda x, i: F.concat(F.lit("senses."), i.cast("string"))),
        F.transform("p.fields", lambda f, i: F.concat(F.lit("fields."), i.cast("string"))),
    )
    return p.select(key, F.explode(paths).alias("field_path"), "source_block_id")
