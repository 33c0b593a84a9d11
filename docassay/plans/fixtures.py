"""Views of the given tables that stand for forms, labels, runs, reviews and pages, for the registered queries.

``sql`` texts run unchanged on Spark and on DuckDB.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from ..functions import constants as K

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "benchmark", "pages", "conversations"]

_FROM = "from part join supplier on s_suppkey = p_partkey % (select max(s_suppkey) + 1 from supplier) join nation on n_nationkey = s_nationkey"

FORMS = f"""select p_partkey doc_id,
 case p_partkey % 3 when 0 then 'WINE' when 1 then 'DISTILLED SPIRITS' else 'MALT BEVERAGES' end product_type,
 case when p_partkey % 16 = 15 then null when p_partkey % 4 = 0 then 'Imported' else 'Domestic' end source,
 p_name brand_name, s_name || ', LLC' applicant_name, n_name applicant_city,
 case p_partkey % 4 when 0 then 'KY' when 1 then 'CA' when 2 then 'OR' else 'WV' end applicant_state,
 case p_partkey % 5 when 0 then 'Cabernet Sauvignon' when 1 then 'N/A' when 2 then 'Shiraz' when 3 then 'red wine blend' when 4 then case when p_partkey % 2 = 0 then 'Garnacha Blanca / Grenache Blanc' end end grape_varietals,
 case p_partkey % 4 when 0 then 'Napa Valley' when 1 then 'U.S.A.' when 2 then 'Mosel' else null end wine_appellation {_FROM}"""

#: Forms whose product type is missing, empty, or a class of its own instead of a family.
FREE_FORMS = f"""select doc_id, case doc_id % 13 when 1 then null when 3 then 'IPA' when 5 then 'Bourbon' when 7 then 'India Pale Ale Beer' when 9 then '' when 11 then 'Scotch Whisky' else product_type end product_type,
 source, brand_name, applicant_name, applicant_city, applicant_state, grape_varietals, wine_appellation from ({FORMS}) all_forms"""

_TERSE = K.WARNING.replace("to the Surgeon", "Surgeon").replace("of the risk", "risk").replace("drive a car", "drive car")

LABELS = f"""select p_partkey doc_id,
 case when p_partkey % 17 = 0 then null when p_partkey % 7 = 0 then p_name || ' Premium' else upper(p_name) end brand_name,
 case p_partkey % 6 when 0 then cast(p_size as string) || '% ALC/VOL' when 1 then cast(p_size as string) when 2 then '(80 PROOF)' when 3 then 'forty percent' when 4 then null else cast(p_size as string) || '.5 %' end abv,
 case p_partkey % 11 when 0 then null when 1 then '{K.WARNING_PREFIX} {K.WARNING_SENTENCE_1}' when 2 then '{K.WARNING_SENTENCE_1} {K.WARNING_SENTENCE_2}' when 3 then lower('{K.WARNING}') when 4 then '{_TERSE}' else '{K.WARNING}' end warning_text,
 case p_partkey % 9 when 0 then false when 1 then null else true end appears_bold,
 case when p_partkey % 10 = 0 then false else true end appears_all_caps,
 case p_partkey % 5 when 0 then '750 mL' when 1 then '1.75 L' when 2 then '12 fl. oz' when 3 then '5.17 gal' else null end net_contents,
 case p_partkey % 8 when 0 then 'Cabernet Sauvignon' when 1 then 'Straight Bourbon Whiskey' when 2 then 'India Pale Ale' when 3 then case when p_partkey % 16 = 3 then 'Petite Sirah, Petite Syrah' else 'red wine blend' end when 4 then 'Vodka' when 5 then 'Lager' when 6 then 'Single Malt Scotch Whisky' else null end class_type,
 case when p_partkey % 12 = 0 then null when p_partkey % 12 = 1 then 'Imported by Tropical Spirits LLC, New York, NY' else 'Bottled by ' || s_name || ' LLC, ' || n_name || ', ' || case p_partkey % 4 when 0 then 'Kentucky' when 1 then 'California' when 2 then 'Oregon' else 'West Virginia' end end producer,
 case p_partkey % 6 when 0 then 'Product of France' when 1 then 'United States' when 2 then 'Product of USA' else null end country_of_origin,
 case p_partkey % 5 when 0 then 'Merlot' when 1 then null when 2 then 'Syrah' when 3 then 'Petite Sirah, Petite Syrah' else 'Cabernet Sauvignon, Merlot' end wine_varietal,
 case p_partkey % 3 when 0 then 'Napa Valley' else null end wine_appellation,
 case when p_partkey % 19 = 0 then 'low' else 'high' end extraction_confidence {_FROM}"""


def spread(df: DataFrame) -> DataFrame:
    """A table of fewer partitions than there are cores dealt out over as many, for expensive expressions over few files; others as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def deal(df: DataFrame) -> DataFrame:
    """A table of short rows with expensive expressions, dealt out evenly: files are cut at sizes, but read by row groups, so that few of the cuts may hold all rows."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(4 * (cores if df.isStreaming else max(cores, df.rdd.getNumPartitions())))


DEALT = ("part", "events")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    if name in DEALT:
        return deal(rows)
    return spread(rows) if name == "documents" else rows


def view(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """The rows of a SELECT over the given tables."""
    named = {t: table(spark, sf_dir, t) for t in TABLES if re.search(rf"\b(?:from|join) {t}\b", sql)}
    text = re.sub(r"\b(from|join) (%s)\b" % "|".join(named), r"\1 {\2}", sql.replace("{", "{{").replace("}", "}}"))
    return spark.sql(text, **named)


def forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, FORMS)


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, LABELS)


def free_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, FREE_FORMS)
