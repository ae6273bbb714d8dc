"""Documents: files by type to text, HTML to text, case files."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from functools import lru_cache
from html.entities import html5

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetscope.functions.scalars import col, once

Reader = Callable[[Column], Column]


def plain_text(content: Column) -> Column:
    """UTF-8 text; bytes that are no UTF-8 are left out, a replacement character that is in the text stays."""
    bad, genuine = F.lit("\ufffd"), F.lit("\U0010ffff\U0010fffe")  # the pair of non-characters cannot be in a text
    marked = F.replace(content.cast("string"), bad, genuine)
    return F.replace(F.replace(F.make_valid_utf8(marked), bad, F.lit("")), genuine, bad)


def html_text(content: Column) -> Column:
    return html_to_text(plain_text(content))


#: File types read by default: extension to column function from bytes to text.
READERS: dict[str, Reader] = {"txt": plain_text, "md": plain_text, "log": plain_text, "csv": plain_text, "html": html_text, "htm": html_text}

# An element whose content is no text ends at its own end tag only; a tag may hold ``>`` inside quotes.
_HIDDEN = r"(?is)<(script|style|noscript)\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*>.*?</\1\s*>|<!--.*?-->|<!doctype[^>]*>"
_TAG = r"(?s)</?[A-Za-z](?:[^>\"']|\"[^\"]*\"|'[^']*')*>"


#: References that most pages use; they are looked for before the table of all names.
_COMMON = ("amp", "lt", "gt", "quot", "apos", "nbsp")


@lru_cache(maxsize=1)
def _named() -> dict[str, dict[str, str]]:
    """Characters by name, the names grouped by their first letter."""
    groups: dict[str, dict[str, str]] = {}
    for k in sorted(html5):
        if k.endswith(";"):
            groups.setdefault(k[:1], {})[k[:-1]] = html5[k]
    return groups


def _by_name(name: Column) -> Column:
    """The character of a name, NULL for an unknown one; a search looks at the groups, then at one group."""
    out = None
    for n in _COMMON:
        out = F.when(name == n, html5[f"{n};"]) if out is None else out.when(name == n, html5[f"{n};"])
    names = F.array(*[F.lit(list(g)) for g in _named().values()])
    values = F.array(*[F.lit(list(g.values())) for g in _named().values()])
    group = F.array_position(F.lit(list(_named())), F.substring(name, 1, 1))
    at = lambda a, i: F.get(a, (i - 1).cast("int"))
    found = once(group, lambda g: once(F.array_position(at(names, g), name), lambda i: at(at(values, g), i)))
    return out.when(name.rlike("^[A-Za-z][A-Za-z0-9]+$"), found)


def decode_entities(c: Column) -> Column:
    """Character references, by name or number, as characters; anything else after an ampersand stays."""
    def char(name: Column) -> Column:
        number = F.when(name.rlike("^#[xX][0-9a-fA-F]{1,6}$"), F.conv(F.substring(name, 3, 6), 16, 10).cast("int")).when(
            name.rlike("^#[0-9]{1,7}$"), F.substring(name, 2, 7).cast("int"))
        legal = lambda n: F.when(n.between(1, 0xD7FF) | n.between(0xE000, 0x10FFFF), n)
        by_number = once(number, lambda n: F.decode(F.unhex(F.lpad(F.hex(legal(n)), 8, "0")), "UTF-32"))
        return F.when(name.startswith("#"), by_number).otherwise(_by_name(name))

    def one(p: Column) -> Column:
        whole = F.concat(F.lit("&"), p)
        read = once(F.substring_index(p, ";", 1), lambda name: once(char(name), lambda k: F.when(k.isNotNull(), F.concat(k, F.substring(p, F.length(name) + 2, F.length(p)))).otherwise(whole)))
        return F.when(p.contains(";"), read).otherwise(whole)

    more = lambda x: F.transform(F.slice(x, 2, 1 << 30), one)
    return once(c, lambda t: F.when(t.contains("&"), once(F.split(t, "&"), lambda x: F.concat(x[0], F.array_join(more(x), "")))).otherwise(t))


def html_to_text(html) -> Column:
    """Drop scripts, styles and comments, cut at tags, decode character references, keep non-blank lines apart by blank lines."""
    x = decode_entities(F.regexp_replace(F.regexp_replace(col(html), _HIDDEN, ""), _TAG, "\n"))
    lines = F.transform(F.split(x, r"[\r\n]+"), lambda s: F.regexp_replace(s, "^[\\s\u00a0]+|[\\s\u00a0]+$", ""))
    return F.array_join(F.filter(lines, lambda s: s != ""), "\n\n")


def parse_files(files: DataFrame, readers: Mapping[str, Reader] = READERS) -> DataFrame:
    """Rows of the binary file source to text by extension; types that ``readers`` lacks give an error row."""
    x = files.withColumn("filetype", F.lower(F.element_at(F.split(F.element_at(F.split("path", "/"), -1), r"\."), -1)))
    text = F.lit(None).cast("string")
    for e, read in readers.items():
        text = F.when(F.col("filetype") == e, read(F.col("content"))).otherwise(text)
    known = F.col("filetype").isin(*readers)
    return x.select(F.col("path").alias("source_key"), "filetype", text.alias("text"),
                    F.when(~known, F.concat(F.lit("no parser for ."), "filetype")).alias("error"))


def load_documents(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    return parse_files(spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path))


CASE_SCHEMA = ("case_id string, signal_name string, crash_type string, crash_function string, description string, "
               "root_cause string, anomaly_flags array<string>, repair_steps array<string>")


def load_cases(spark: SparkSession, path: str, multiline: bool = True) -> DataFrame:
    """Case records from JSON; a record without an id gets a new one."""
    return spark.read.schema(CASE_SCHEMA).json(path, multiLine=multiline).withColumn("case_id", F.coalesce("case_id", F.uuid()))
