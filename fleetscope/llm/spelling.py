"""Spelling variants of words one edit apart, by asymmetric chunks.

One edit leaves one of two disjoint chunks of a word untouched. So the shorter word of a pair contributes two chunks, its
halves, and the longer one its positional grams of their lengths; a chunk before the edit is found at its own place, one
behind the edit is moved by the difference of the lengths, zero or one, so the grams one place to the other side need not
be asked. The half that holds the edit is divided again in the same way, because half a word is shared by many: what
must be equal is half a word and one of two chunks of its other half. Pairs that meet are verified with the edit distance.

Chunks that very many words share are salted: their words on the one side are dealt over groups, those on the other side
sent to each group, so no task holds all of them. Only verified pairs leave the join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetscope.llm.common import stage

#: Words of a chunk that one group compares with the others.
GROUP = 500
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A word of running text: letters of Latin-1 and the two signs between them.
RUN = r"[A-Za-zÀ-ÿ]+"


def words_of(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """(*keep, word): every maximal run of letters in the whole texts, A-Z lower-cased. A null text has none."""
    found = F.regexp_extract_all(F.col(f"`{text}`"), F.lit(RUN), F.lit(0))
    return docs.select(*[F.col(f"`{c}`") for c in keep], F.explode(found).alias("_run")).select(
        *[F.col(f"`{c}`") for c in keep], F.translate("_run", UPPER, LOWER).alias("word")
    )


def count_words(words: DataFrame, least_length: int = 5, least: int = 3) -> DataFrame:
    """(word, n) of the words of at least so many code points that occur at least so often; counted before the shuffle."""
    return words.where(F.char_length("word") >= least_length).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)


def _chunks(length: str, shift: int) -> str:
    """SQL for the four (half, part, gram) of ``word`` as a partner of words of this length, ``shift`` code points shorter."""
    h = f"({length} div 2)"
    part = lambda a, b: f"substring(word, {a} + 1, ({b}) - ({a}))"
    moved = lambda a, b: part(f"{a} + {shift}", f"{b} + {shift}")
    q0, q1 = f"({h} div 2)", f"({h} + ({length} - {h}) div 2)"
    rows = [
        (0, 0, part("0", h), part(h, q1)), (0, 1, part("0", h), moved(q1, length)),
        (1, 0, moved(h, length), part("0", q0)), (1, 1, moved(h, length), moved(q0, h)),
    ]
    return "array(" + ", ".join(f"struct({c} as half, {s} as part, concat({a}, ' ', {b}) as gram)" for c, s, a, b in rows) + ")"


def near_pairs(counts: DataFrame) -> DataFrame:
    """(a, na, b, nb): every pair of words (word, n) of two or more code points at edit distance one, once.

    ``word`` must be distinct and not null. The words are of one length, or ``a`` is the shorter one.
    """
    sized = counts.select("word", "n", F.char_length("word").alias("l"))
    cut = lambda df, length, shift, side: df.selectExpr(
        "word", "n", f"{length} as l", f"{side} as side", f"explode({_chunks(f'({length})', shift)}) as c"
    ).selectExpr("l", "c.half", "c.part", "c.gram", "word", "n", "side")
    chunks = cut(sized, "l", 0, 0)
    grams = chunks.unionByName(cut(sized.where("l > 2"), "l - 1", 1, 1))
    key = ["l", "half", "part", "gram"]
    hot = stage(grams.groupBy(*key).count().where(f"count > {GROUP}").selectExpr(*key, f"cast(ceil(count / {GROUP}) as int) as k"), "spelling-hot")
    left = chunks.join(hot, key, "left").selectExpr(*key, "word as a", "n as na", "cast(pmod(xxhash64(word), coalesce(k, 1)) as int) as g")
    right = grams.join(hot, key, "left").selectExpr(*key, "word as b", "n as nb", "side", "explode(sequence(0, coalesce(k, 1) - 1)) as g")
    # A pair that shares more than one of the four is taken at the first of them.
    first_half = "substring(a, 1, l div 2) = substring(b, 1, l div 2)"
    q1 = "(l div 2 + (l - l div 2) div 2)"
    first_part = f"if(half = 0, substring(a, 1, {q1}) = substring(b, 1, {q1}), substring(a, 1, l div 2 div 2) = substring(b, 1, l div 2 div 2))"
    once = f"(half = 0 or not {first_half}) and (part = 0 or not {first_part})"
    met = left.join(right, [*key, "g"]).where(f"(side = 1 or a < b) and {once} and levenshtein(a, b, 1) = 1")
    return met.select("a", "na", "b", "nb")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of every word of ``forms`` (word, form): the last of its chain of forms.

    Chains end, because a form is more frequent than its word. Every round doubles the steps taken and is written.
    """
    at = stage(forms.selectExpr("word", "form as root"), "spelling-roots")
    while True:
        ahead = at.selectExpr("word as root", "root as further")
        moved = stage(at.join(ahead, "root", "left").selectExpr("word", "coalesce(further, root) as root", "further is not null as moved"), "spelling-roots")
        at = moved.select("word", "root")
        if moved.where("moved").isEmpty():
            return at


def spelling_variants(counts: DataFrame, ratio: int = 2) -> DataFrame:
    """word, form, root, n, n_near and form_n of every word of ``counts`` (word, n).

    The form of a word is the most frequent of its near words (ties: the smallest in code-point order) if it is at
    least ``ratio`` (2 or more) times as frequent, else null; the root is the last of the forms, or the word itself.
    Rows with a null word are left out, repeated words are added up, a null n counts as 0. An empty table gives an empty
    result; other columns are ignored.
    """
    counts = stage(counts.where("word is not null").groupBy("word").agg(F.sum(F.coalesce("n", F.lit(0))).cast("long").alias("n")), "spelling-words")
    pairs = stage(near_pairs(counts), "spelling-pairs")
    both = pairs.selectExpr("a as word", "nb as m", "b as other").union(pairs.selectExpr("b", "na", "a"))
    best: Column = F.min(F.struct((-F.col("m")).alias("m"), "other")).alias("best")
    near = both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best)
    found = stage(
        counts.join(near, "word", "left")
        .selectExpr("word", "n", "coalesce(n_near, 0L) as n_near", f"if(-best.m >= {ratio} * n and -best.m > n, best, null) as f")
        .selectExpr("word", "n", "n_near", "f.other as form", "-f.m as form_n"),
        "spelling-forms",
    )
    last = roots(found.where("form is not null").select("word", "form"))
    return found.join(last, "word", "left").selectExpr("word", "form", "coalesce(root, word) as root", "n", "n_near", "form_n")
