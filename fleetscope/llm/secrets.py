"""Secret scans over a trigram inverted index, with DataFrame functions only.

Every rule is a regular expression. From its syntax follows a Boolean query: an OR over alternatives, each an AND of the
trigrams that any match must contain. The index holds the postings (trigram, document) of the trigrams that queries
ask for, over case-folded texts. Postings are intersected per alternative, and the remaining documents verified with
the rule itself. A rule without mandatory trigrams scans every text.
"""

from __future__ import annotations

from dataclasses import dataclass
from re import _constants as op
from re import _parser as syntax

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetscope.llm.common import stage


@dataclass(frozen=True)
class Rule:
    kind: str
    regex: str
    #: A match counts if this group of it has at least so many characters.
    group: int = 0
    least: int = 0


#: The three base rules; their order is that of the results.
BASE = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]{24,}"),
)
#: The body of a private key: up to its END line, or without one its lines of base64 (the last may be short), which may be
#: quoted, escaped or indented. Possessive, so that long bodies need no stack.
_GAP = r"""[\x20\x09-\x0D"'\\>|#*,;]*+"""
_ENDED = r"(?:[^-]|-(?!----))*+-----END [A-Z ]{0,20}PRIVATE KEY(?: BLOCK)?-----"
_CUT_OFF = (
    rf"(?:{_GAP}(?:Proc-Type|DEK-Info|Version|Comment|Hash|Charset):[^\r\n]*+)*+"
    rf"(?:(?:{_GAP}[A-Za-z0-9+/=]{{16,}}+)++(?:{_GAP}[A-Za-z0-9+/]++={{1,2}}|[\r\n]{_GAP}[A-Za-z0-9+/]++(?=[\x20\x09]*+(?![^\r\n])))?)?"
)
#: Rules that the method adds.
MORE = (
    Rule("private_key", rf"-----BEGIN [A-Z ]{{0,20}}PRIVATE KEY(?: BLOCK)?-----(?:{_ENDED}|{_CUT_OFF})"),
    Rule("vcs_token", r"gh[opsur]_[A-Za-z0-9]{36,}|github_pat_[A-Za-z0-9_]{22,}"),
    Rule("chat_token", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("signed_token", r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{5,}"),
    Rule("url_login", r"[a-z][a-z0-9+.-]{1,20}://[A-Za-z0-9._%+-]*+:[^\x20\x09-\x0D/@:]{3,}+@"),
)
RULES = BASE + MORE
#: Alternatives of a query are multiplied out up to this many; beyond it the part counts as unknown text.
WIDEST = 64


def _runs(nodes: list) -> list[tuple[str, ...]]:
    """Alternatives of a parsed regex, each the runs of literal text that a match must contain ('' marks a gap)."""
    alts: list[tuple[str, ...]] = [("",)]

    def gap() -> None:
        alts[:] = [a if a[-1] == "" else (*a, "") for a in alts]

    def times(parts: list[tuple[str, ...]]) -> None:
        if len(alts) * len(parts) > WIDEST:
            gap()
        else:
            alts[:] = [(*a[:-1], a[-1] + p[0], *p[1:]) for a in alts for p in parts]

    for kind, value in nodes:
        if kind is op.LITERAL:
            times([(chr(value).lower(),)])
        elif kind is op.IN and all(k is op.LITERAL for k, _ in value):
            times(sorted({(chr(v).lower(),) for _, v in value}))
        elif kind is op.SUBPATTERN:
            times(_runs(value[-1]))
        elif kind is op.BRANCH:
            times([a for branch in value[1] for a in _runs(branch)])
        elif kind is op.MAX_REPEAT and value[:2] == (0, 1):
            times([("",), *_runs(value[2])])
        elif kind is op.MAX_REPEAT and value[0] >= 1:
            times([(*a, "") for a in _runs(value[2])])
            gap()
        else:
            gap()
    return alts


def trigram_query(regex: str) -> list[set[str]] | None:
    """Alternatives (sets of mandatory, case-folded trigrams) of a regex; None if some match needs no trigram."""
    found = [{run[i : i + 3] for run in alt for i in range(len(run) - 2)} for alt in _runs(list(syntax.parse(regex)))]
    if not all(found):
        return None
    unique = [q for i, q in enumerate(found) if q not in found[:i]]
    return [q for q in unique if not any(o < q for o in unique)]


def _quote(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def postings(docs: DataFrame, grams: list[str]) -> DataFrame:
    """(gram, doc_id): which documents contain which of the trigrams, as numbers into ``grams``."""
    terms = "array(" + ",".join(f"struct({i} as i, {_quote(g)} as g)" for i, g in enumerate(grams)) + ")"
    hits = f"explode(transform(array(lower(text)), t -> transform(filter({terms}, x -> contains(t, x.g)), x -> x.i))[0]) as gram"
    return docs.where("text is not null and doc_id is not null").selectExpr("doc_id", hits)


def candidates(docs: DataFrame, rules: tuple[Rule, ...]) -> DataFrame | None:
    """(doc_id, rules): a bit mask of the indexed rules whose query a document's postings satisfy."""
    queries = [(r, q) for r, rule in enumerate(rules) for q in trigram_query(rule.regex) or []]
    grams = sorted({g for _, q in queries for g in q})
    if not grams:
        return None
    index = stage(postings(docs, grams), "secret-postings")
    terms = [(grams.index(g), b, r, (1 << k)) for b, (r, q) in enumerate(queries) for k, g in enumerate(sorted(q))]
    full = [(b, (1 << len(q)) - 1) for b, (_, q) in enumerate(queries)]
    # Both tables have a row per trigram of a rule: their size is that of the rules.
    spark = docs.sparkSession
    asked = F.broadcast(spark.createDataFrame(terms, "gram int, branch int, rule int, bit long"))
    whole = F.broadcast(spark.createDataFrame(full, "branch int, mask long"))
    met = index.join(asked, "gram").groupBy("doc_id", "branch", "rule").agg(F.bit_or("bit").alias("got")).join(whole, "branch").where("got = mask")
    return stage(met.groupBy("doc_id").agg(F.bit_or(F.expr("shiftleft(1L, rule)")).alias("rules")), "secret-candidates")


def _spans(rule: Rule, rank: int, applies: str) -> str:
    """SQL for the spans of a rule in ``text``: leftmost matches that do not overlap, short ones dropped afterwards."""
    regex = _quote(rule.regex)
    walk = (
        "aggregate(sequence(1, size(x.m)), named_struct('at', 0, 'out', cast(array() as array<struct<start:int,rank:int,end:int,ok:boolean>>)), "
        "(a, i) -> named_struct('at', a.at + length(x.p[i - 1]) + length(x.m[i - 1]), 'out', concat(a.out, array(named_struct("
        f"'start', a.at + length(x.p[i - 1]), 'rank', {rank}, 'end', a.at + length(x.p[i - 1]) + length(x.m[i - 1]), 'ok', length(x.g[i - 1]) >= {rule.least})))), a -> a.out)"
    )
    found = f"array(named_struct('m', regexp_extract_all(text, {regex}, 0), 'g', regexp_extract_all(text, {regex}, {rule.group}), 'p', split(text, {regex}, -1)))"
    none = "cast(array() as array<struct<start:int,rank:int,end:int>>)"
    kept = f"transform(filter(x.s, y -> y.ok), y -> named_struct('start', y.start, 'rank', y.rank, 'end', y.end))"
    return (
        f"if({applies} and text rlike {regex}, transform(transform({found}, x -> named_struct('s', {walk})), x -> {kept})[0], {none})"
    )


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``docs`` plus ``found``: array of (start, kind, end) in code points, end exclusive, by start, then rule order.

    Null and empty texts have none; nulls elsewhere, repeated rows and repeated or null ids pass through, every text
    being scanned for itself. Spans of different rules may overlap, those of one rule do not. An empty table gives an
    empty result. A column named ``found`` is replaced, all others pass through, whatever their names. Texts stay where they lie as
    long as the candidates' ids, which are staged first, are small enough for the planner to send them round; else both
    sides meet by id. Rows without an id have no postings: all rules scan them.
    """
    own = [c for c in docs.columns if c != "found"]
    row = F.struct(*[F.col(f"`{c}`") for c in own]).alias("_row")  # no name can clash inside it
    docs = docs.select(row, "doc_id", "text")
    hits = candidates(docs, rules)
    indexed = [trigram_query(r.regex) is not None for r in rules]
    if hits is None:
        ready = docs.withColumn("_rules", F.lit(0).cast("long"))
    else:
        ready = docs.join(hits.withColumnRenamed("rules", "_rules"), "doc_id", "left")
    parts = [_spans(r, i, f"(coalesce(_rules, if(doc_id is null, -1L, 0L)) & {1 << i}L) <> 0" if indexed[i] else "true") for i, r in enumerate(rules)]
    kinds = "array(" + ",".join(_quote(r.kind) for r in rules) + ")"
    found = f"transform(array_sort(concat({', '.join(parts)})), y -> named_struct('start', y.start, 'kind', {kinds}[y.rank], 'end', y.end))"
    spans = F.coalesce(F.expr(found), F.expr("cast(array() as array<struct<start:int,kind:string,end:int>>)"))
    return ready.select(*[F.col("_row")[c].alias(c) for c in own], spans.alias("found"))


def as_text(spans: str) -> str:
    return f"array_join(transform({spans}, y -> concat_ws(':', y.kind, y.start, y.end)), ',')"


def redact(text: str, found: str, mark: str = "[SECRET]") -> Column:
    """``text`` with every span, overlapping ones as one, replaced by a mark."""
    step = (
        f"aggregate({found}, named_struct('at', 0, 'out', cast('' as string)), (a, y) -> if(y.end <= a.at, a, named_struct('at', y.end, 'out', "
        f"if(y.start < a.at, a.out, concat(a.out, substring({text}, a.at + 1, y.start - a.at), {_quote(mark)})))), a -> concat(a.out, substring({text}, a.at + 1)))"
    )
    return F.expr(f"if(size({found}) = 0, {text}, {step})")
