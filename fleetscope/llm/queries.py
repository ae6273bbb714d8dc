"""Registered queries of the operators, with production parameters over whole tables, and their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetscope.llm import (
    fingerprint, html_extract, language_id, mixing, near_dup, packing, periodic_runs, quality, secrets, spelling, token_counts, toxicity, warc,
)
from fleetscope.llm.common import WORD, fold, small_batches, stage, table, word_count
from fleetscope.session import scratch_dir


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return html_extract.extract_main_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_sources(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return mixed.selectExpr("doc_id", "size", "source_size", "target", "size * copies as taken", "source", "copies")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op4_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"))


def op5_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = "filter(found, y -> y.kind in ('assign', 'access', 'hex'))"
    return found.selectExpr(
        "doc_id",
        *[f"cast(size(filter(found, y -> y.kind = '{k}')) as bigint) as n_{k}" for k in ("assign", "access", "hex")],
        f"sha2({secrets.as_text(base)}, 256) as base_sha256",
        f"{secrets.as_text('found')} as spans",
    )


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.edit_report(table(spark, sf_dir, "documents"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    docs = table(spark, sf_dir, "documents")
    model = language_id.learn(docs.where(fold(F.col("doc_id")) != 0).select("text", "lang"))
    return language_id.identify_language(docs.select("doc_id", "text"), model)


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return quality.adaptive_filter(table(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return toxicity.toxicity(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))


#: Token definitions of the rollup: word counts, the same revised to leave out words of symbols alone, and a finer one.
REVISED = r"[^\x20\x09-\x0D]*[^\x20\x09-\x0D#*$%&|<>][^\x20\x09-\x0D]*"
FINE = r"[0-9A-Za-z]+|[^0-9A-Za-z\x20\x09-\x0D]"


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five batches and a replay: insert all word counts, delete repeated texts, revise counts, insert the repeats again as
    revised, insert a finer version. The totals cover every row for both tokenizer versions.
    """
    docs = table(spark, sf_dir, "documents")
    found = lambda p: F.coalesce(F.regexp_count("text", F.lit(p)), F.lit(0)).cast("long")
    counts = stage(
        docs.select("doc_id", "source", "lang", F.sha2("text", 256).alias("key"), word_count(F.col("text")).alias("v1"), found(REVISED).alias("v1b"), found(FINE).alias("v2")),
        "token-counts",
    )
    one = F.min_by(F.struct("source", "lang", "v1", "v1b", "v2"), F.struct("doc_id", "source", "lang"))
    unique = stage(counts.groupBy("key").agg(one.alias("d"), F.count(F.lit(1)).alias("n")).select("key", "n", "d.*"), "token-unique")
    change = lambda df, op, tokenizer, old, new: df.selectExpr(f"'{op}' as op", "source", "lang", f"'{tokenizer}' as tokenizer", f"{old} as old_tokens", f"{new} as new_tokens")
    state = scratch_dir(spark, "token-rollup")
    less = lambda v: change(counts, "delete", "words-1", v, "null").unionByName(change(unique, "insert", "words-1", "null", v))
    more = lambda v: change(counts, "insert", "words-1", "null", v).unionByName(change(unique, "delete", "words-1", v, "null"))
    batches = {
        "1-load": change(counts, "insert", "words-1", "null", "v1"),
        "2-repeats": less("v1"),
        "3-revised": change(unique, "revise", "words-1", "v1", "v1b"),
        "4-again": more("v1b"),
        "5-fine": change(counts, "insert", "fine-1", "null", "v2"),
    }
    for name in [*batches, "2-repeats"]:
        token_counts.commit_batch(spark, state, name, batches[name])
    return token_counts.totals(spark, state)


def with_periods(docs: DataFrame) -> DataFrame:
    """(doc_id, text) with every tenth text, by crc32 of its id, made periodic from some word on; a null id counts as ''."""
    g = "(crc32(cast(coalesce(cast(doc_id as string), '') as binary)) div 10)"
    # ``transform(array(x), ...)`` binds x, so the words are looked for once.
    at = f"transform(array(struct(w, cast(pmod({g}, size(w)) as int) as a)), x -> struct(x.w, x.a, 1 + cast((size(x.w) - x.a) div (3 + {g} % 8) as int) as p))"
    turned = "concat(slice(x.w, 1, x.a), transform(sequence(0, size(x.w) - x.a - 1), j -> x.w[x.a + j % x.p]))"
    made = f"flatten(transform(array(regexp_extract_all(text, r'{WORD}', 0)), w -> if(size(w) = 0, array(''), transform({at}, x -> array_join({turned}, ' ')))))[0]"
    return docs.selectExpr("doc_id", f"if(crc32(cast(coalesce(cast(doc_id as string), '') as binary)) % 10 = 0 and text is not null, {made}, text) as text")


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    found = periodic_runs.periodic_runs(with_periods(table(spark, sf_dir, "documents").select("doc_id", "text")))
    best = found.withColumn("best", F.expr("array_min(transform(runs, r -> struct(-r.length as less, r.start as start, r.period as period)))"))
    lines = "array_join(transform(array_sort(transform(runs, r -> struct(r.start, r.period, r.length))), r -> concat(r.start, ',', r.length, ',', r.period, '\n')), '')"
    return best.selectExpr(
        "doc_id", "cast(size(runs) as bigint) as n_runs", "best.start as start", "-best.less as length", "best.period as period",
        "(1000 * -best.less) div best.period as exponent_milli", f"sha2({lines}, 256) as runs_sha256", "sha2(collapsed, 256) as collapsed_sha256",
    )


def with_misspellings(words: DataFrame) -> DataFrame:
    """(doc_id, word) with a code point deleted where 97 divides the crc32 of ``doc_id:word``; a null id counts as ''."""
    h = "crc32(cast(concat(coalesce(cast(doc_id as string), ''), ':', word) as binary))"
    cut = "concat(substring(word, 1, cast(h % char_length(word) as int)), substring(word, cast(h % char_length(word) as int) + 2))"
    return words.selectExpr("doc_id", "word", f"{h} as h").selectExpr("doc_id", f"if(h % 97 = 0, {cut}, word) as word")


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = spelling.words_of(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return spelling.spelling_variants(spelling.count_words(with_misspellings(words)))


def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    path = scratch_dir(spark, "warc")
    warc.write_archive(table(spark, sf_dir, "pages"), path)
    return warc.read_archive(spark, path, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url")


QUERIES = {
    f.__name__: f
    for f in (
        op1_html_extraction, op2_mixing, op3_packing, op4_minhash_dedup, op5_secret_scans, op6_fingerprints, op7_language_id, op8_quality_rules, op9_toxicity,
        op10_token_counts, op11_periodic_runs, op12_spelling_variants, op13_warc,
    )
}

_B32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
#: Five hexadecimal digits are four letters of base32.
_LETTERS = ", ".join(f"substr('{_B32}', 1 + ((cast('0x' || substr(s, {5 * i + 1}, 5) as int) >> {15 - 5 * j}) & 31), 1)" for i in range(8) for j in range(4))

ORACLES = {
    "op10_token_counts": rf"""
        with kept as (
            select source, lang, coalesce(len(regexp_extract_all(text, '{REVISED}')), 0) as revised,
                   coalesce(len(regexp_extract_all(text, '{FINE}')), 0) as fine
            from documents
        )
        select source, lang, 'words-1' as tokenizer, count(*) as n_docs, cast(sum(revised) as bigint) as n_tokens from kept group by source, lang
        union all
        select source, lang, 'fine-1', count(*), cast(sum(fine) as bigint) from kept group by source, lang""",
    "op13_warc": f"""
        with p as (select page_id, url, coalesce(html, '') as payload, sha1(coalesce(html, '')) as s from pages),
        last as (select *, max(page_id) over (partition by payload) as top from p)
        select page_id, cast(strlen(payload) as bigint) as payload_bytes, concat({_LETTERS}) as payload_digest,
               case when page_id = top then 'response' else 'revisit' end as record_type,
               case when page_id = top then null else top end as refers_to, url
        from last""",
}
