"""The registered queries of this subpackage, each over its whole table with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.folders import scratch
from . import decontam, divergence, langid, media, mixing, quality, reversed_search, simhash, spans, toxicity, warc, whitening, wordpiece
from .sql import QUALITY_RULES, SEARCH


#: Sentences of more words are cut further, so that passages that begin inside a sentence are found too.
LONG = 12
#: Wanted shares of the mix, by domain.
SHARES = {"good": 0.85, "poor": 0.1, "toxic": 0.05}


def domain():
    """The domain that a labelled row stands for."""
    return F.when(F.col("toxic") > 0, "toxic").when(F.col("quality") > 0, "good").when(F.col("quality") == 0, "poor")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    # The documents name a source and no URL: the source stands for the host, its part in one language for the path.
    return quality.grade(docs, model, F.col("source"), F.concat_ws("/", "source", "lang"))


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rest = F.crc32(F.col("doc_id").cast("string")) % 4
    model = langid.train(docs.where(rest != 2))
    found = langid.predict(docs.select("doc_id", F.coalesce(rest == 2, F.lit(False)).alias("held_out"), "text"), model)
    return found.select("doc_id", "held_out", "lang_pred", "score", "rejected")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), domain(), SHARES)


def op6_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return media.features(media.stored(docs, f"{scratch(spark, 'media')}/table")).drop("height", "width")


def op7_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return spans.remove_repeats(docs, long=LONG).select("doc_id", "n_sentences", "n_units", "n_removed", "text")


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op9_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wordpiece.token_counts(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op11_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = divergence.quality_rules(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
    return found.select("doc_id", *divergence.RESULT[:7])


def op12_reversed_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reversed_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_decontamination": op2_decontamination,
    "op3_quality": op3_quality,
    "op4_language": op4_language,
    "op5_mixing": op5_mixing,
    "op6_media": op6_media,
    "op7_spans": op7_spans,
    "op8_warc": op8_warc,
    "op9_tokens": op9_tokens,
    "op10_simhash": op10_simhash,
    "op11_quality_rules": op11_quality_rules,
    "op12_reversed_search": op12_reversed_search,
    "op13_whitening": op13_whitening,
}



def _base32_sql(h: str) -> str:
    """Base32 of a hex digest in SQL: five hex digits give four characters."""
    out = []
    for i in range(8):
        value = " + ".join(f"(instr('0123456789abcdef', {h}[{5 * i + k + 1}]) - 1) * {16 ** (4 - k)}" for k in range(5))
        out += [f"'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[((({value}) >> {15 - 5 * k}) & 31) + 1]" for k in range(4)]
    return " || ".join(out)


#: The other operators are trained, hashed in a way that SQL lacks, or iterate; tests hold them against brute force.
ORACLE_SQL: dict[str, str] = {
    "op11_quality_rules": QUALITY_RULES,
    "op12_reversed_search": SEARCH,
    "op8_warc": f"""with p as (select page_id, url, coalesce(html, '') as body, sha1(coalesce(html, '')) as h from pages),
        f as (select *, min(page_id) over (partition by body) as first_id from p)
        select page_id, strlen(body) as payload_bytes, {_base32_sql("h")} as payload_digest,
        case when page_id = first_id then 'response' else 'revisit' end as record_type,
        case when page_id <> first_id then first_id end as refers_to, url as target_uri from f""",
}
