"""Readers of debugger and log lines, written from the documented line layouts with splits instead of one long pattern.

A line is split once; tests and fields then look at the bound pieces, so no reader repeats the work of another.

frame      ``#N  [0xADDR in ]NAME (ARGS) [at FILE:LINE | from LIBRARY]``
thread     ``[*] ID  Thread 0xADDR (LWP N) TOP FRAME``
mapping    ``START END SIZE OFFSET [NAME]``
register   ``NAME  0xVALUE  ...``
device     ``BUS-ADDRESS 'DESCRIPTION' KEY=VALUE ...``
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fleetscope.functions.scalars import once

NUMBER = r"^[0-9]+$"
BLANKS = r"\s+"


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(" \t\n\x0b\f\r"))


def rest(items: Column) -> Column:
    """All elements of an array but the first."""
    return F.slice(items, 2, 1 << 30)


def word(text: Column, n: int = 0, parts: int = -1) -> Column:
    """The n-th blank-separated word; with ``parts`` the last one takes the rest of the text. NULL beyond the end."""
    return F.get(F.split(strip(text), BLANKS, parts), F.lit(n))


def frame_parts(line: Column) -> Column:
    """``#N`` and the rest of a line, split once; lines of another kind are told apart by ``is_frame``."""
    return F.split(strip(line), BLANKS, 2)


def is_frame(parts: Column) -> Column:
    mark = F.get(parts, F.lit(0))
    return (F.size(parts) == 2) & mark.startswith("#") & F.substring(mark, 2, 20).rlike(NUMBER)


def frame_number(parts: Column) -> Column:
    return F.substring(F.get(parts, F.lit(0)), 2, 20).try_cast("bigint")


def frame_body(parts: Column) -> Column:
    """A frame line without its number."""
    return F.coalesce(F.get(parts, F.lit(1)), F.lit(""))


def body_parts(body: Column) -> Column:
    """(address, text) of a frame body: ``0xADDR in NAME ...`` gives both; an address that stands alone stays in the text."""
    def split(b: Column, w: Column) -> Column:
        address = F.when(F.get(w, F.lit(0)).startswith("0x"), F.get(w, F.lit(0)))
        return F.struct(address.alias("address"), F.when(address.isNotNull() & (F.get(w, F.lit(1)) == "in"), F.get(w, F.lit(2))).otherwise(b).alias("text"))

    return once(strip(body), lambda b: once(F.split(b, BLANKS, 3), lambda w: split(b, w)))


def place(body: Column) -> Column:
    """FILE:LINE after the last ``at``, NULL without one."""
    return once(F.element_at(F.split(body, BLANKS + "at" + BLANKS), -1), lambda tail: F.when((tail != body) & tail.rlike(":[0-9]+$"), tail))


def place_file(where: Column) -> Column:
    return F.regexp_extract(where, "^(.*):[0-9]+$", 1)


def place_line(where: Column) -> Column:
    return F.substring_index(where, ":", -1)


def before_place(body: Column, where: Column) -> Column:
    return F.when(where.isNull(), body).otherwise(F.regexp_replace(F.substring(body, F.lit(1), F.length(body) - F.length(where)), r"\s+at\s+$", ""))


def first_name(text: Column) -> Column:
    """Text before the first blank or parenthesis, '' if there is none."""
    return F.regexp_extract(text, r"([^\s(]+)", 1)


def without_templates(name: Column) -> Column:
    """A name less its template arguments; ``unknown`` if nothing is left."""
    def outside(pieces: Column) -> Column:
        more = F.transform(rest(pieces), lambda p: F.when(p.contains(">"), F.substring_index(p, ">", -1)).otherwise(""))
        return strip(F.concat(F.get(pieces, F.lit(0)), F.array_join(more, "")))

    return once(once(F.split(name, "<"), outside), lambda x: F.when(x == "", "unknown").otherwise(x))


def bare_name(name: Column) -> Column:
    """A function name without address, template arguments and parameter list; ``unknown`` if nothing is left."""
    return without_templates(F.substring_index(body_parts(name)["text"], "(", 1))


def parsed_frame(line: Column) -> Column:
    """(idx, func, address, source) of a frame line; idx is NULL for other lines."""
    def one(parts: Column, b: Column) -> Column:
        return F.struct(F.when(is_frame(parts), frame_number(parts)).alias("idx"), without_templates(first_name(b["text"])).alias("func"),
                        b["address"].alias("address"), place(frame_body(parts)).alias("source"))

    return once(frame_parts(line), lambda parts: once(body_parts(frame_body(parts)), lambda b: one(parts, b)))


def thread_words(line: Column) -> Column:
    """ID, ``Thread``, address, ``(LWP``, ``N)`` and the top frame."""
    return F.split(strip(F.regexp_replace(line, r"^\s*\*", " ")), BLANKS, 6)


def is_thread(w: Column) -> Column:
    return (F.get(w, F.lit(0)).rlike(NUMBER) & (F.get(w, F.lit(1)) == "Thread") & F.get(w, F.lit(2)).startswith("0x") & (F.get(w, F.lit(3)) == "(LWP")
            & F.coalesce(F.get(w, F.lit(5)) != "", F.lit(False)))


def mapping_words(line: Column) -> Column:
    return F.split(strip(line), BLANKS, 5)


def is_mapping(w: Column) -> Column:
    return (F.size(w) >= 4) & F.forall(F.slice(w, 1, 4), lambda x: x.startswith("0x"))


def after(line: Column, mark: str) -> Column:
    """Text behind the first ``mark``, NULL without one."""
    return F.get(F.split(line, mark, 2), F.lit(1))
