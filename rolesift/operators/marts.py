"""Aggregate marts.

Facts are counted by their surrogate key before a dimension is joined, so a key
that covers a third of the facts enters the join as one row per mart group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rolesift.constants import TOP_SKILLS
from rolesift.operators.dedup import top_per_key
from rolesift.operators.joins import null_safe_join
from rolesift.session import written


def _blank(x: str) -> Column:
    return F.coalesce(F.col(x), F.lit("")).alias(x)


def _counted(fact: DataFrame, key: str) -> DataFrame:
    return fact.groupBy(_blank("profile_id"), "search_keyword", key).agg(
        F.count(F.lit(1)).alias("_n")
    )


def jobs_by_country(fact: DataFrame, dim_location: DataFrame) -> DataFrame:
    joined = _counted(fact, "location_key").join(dim_location, "location_key", "left")
    return joined.groupBy("profile_id", _blank("country_code"), "search_keyword").agg(
        F.max("country").alias("country"), F.sum("_n").alias("job_count")
    )


def skills_by_keyword(fact: DataFrame, bridge: DataFrame, dim_skill: DataFrame) -> DataFrame:
    tagged = fact.select("job_id", "profile_id", "search_keyword").join(bridge, "job_id")
    joined = _counted(tagged, "skill_key").join(dim_skill, "skill_key")
    return joined.groupBy(
        "profile_id", "search_keyword", "skill_type", F.col("name").alias("skill_name")
    ).agg(F.sum("_n").alias("demand_count"))


def work_mode_distribution(fact: DataFrame) -> DataFrame:
    return fact.groupBy(_blank("profile_id"), "search_keyword", _blank("work_mode")).agg(
        F.count(F.lit(1)).alias("job_count")
    )


def salary_by_keyword(fact: DataFrame, dim_salary: DataFrame) -> DataFrame:
    """Exact quartiles of minimum and maximum amounts per profile, keyword, currency, period.

    Facts are counted by salary first; these counts are written, as totals and quartiles read them
    several times.
    """
    groups = ["profile_id", "search_keyword", "currency", "period"]
    paid = dim_salary.filter("min_amount is not null or max_amount is not null")
    counted = (
        _counted(fact, "salary_key")
        .join(paid, "salary_key")
        .select(
            "profile_id", "search_keyword", _blank("currency"), _blank("period"),
            "min_amount", "max_amount", "_n",
        )
    )
    counted = written(counted, "pay-counts")
    amounts = counted.select(
        *groups,
        F.inline(
            F.array(
                F.struct(F.lit("min").alias("side"), F.col("min_amount").alias("amount")),
                F.struct(F.lit("max").alias("side"), F.col("max_amount").alias("amount")),
            )
        ),
        "_n",
    ).filter("amount is not null")
    wide = weighted_percentiles(
        amounts, groups, "side", ("min", "max"), "amount", "_n", {"p25": 0.25, "p50": 0.5, "p75": 0.75}
    )
    totals = counted.groupBy(*groups).agg(F.sum("_n").alias("observation_count"))
    return null_safe_join(totals, wide, groups, "left").select(
        *groups, "p25_min", "p50_min", "p75_min", "p25_max", "p50_max", "p75_max",
        "observation_count",
    )


def weighted_percentiles(
    values: DataFrame,
    groups: Sequence[str],
    series: str,
    series_values: Sequence[str],
    value: str,
    weight: str,
    fractions: dict[str, float],
) -> DataFrame:
    """Exact interpolated percentiles without gathering a group in one place.

    Rows hold (groups, series, value, weight); the result has one row per group
    and one column ``<fraction>_<series value>`` each.

    1. Equal values of a group collapse to one weighted row (partial aggregation).
    2. Values fall into ordered buckets of about 1.6 % width; the few bucket counts of
       a group give the bucket that holds each wanted rank.
    3. Only the values of those buckets are ordered, per (group, bucket).
    """
    keys = [*groups, series]
    distinct = (
        values.groupBy(*keys, F.col(value).alias("_x"))
        .agg(F.sum(weight).alias("_w"))
        .withColumn("_bucket", bucket_of(F.col("_x")))
    )
    sizes = distinct.groupBy(*keys, "_bucket").agg(F.sum("_w").alias("_size"))
    upto_bucket = Window.partitionBy(*keys).orderBy("_bucket")
    whole = Window.partitionBy(*keys)
    position = F.array(
        *[
            F.struct(F.lit(name).alias("name"), (F.lit(p) * (F.col("_total") - 1)).alias("pos"))
            for name, p in fractions.items()
        ]
    )
    ranges = sizes.select(
        *keys, "_bucket",
        (F.sum("_size").over(upto_bucket) - F.col("_size")).alias("_start"),
        F.sum("_size").over(upto_bucket).alias("_end"),
        F.sum("_size").over(whole).alias("_total"),
    )
    # the ranks a bucket holds: at most two per fraction
    held = F.filter(
        position,
        lambda w: (F.ceil(w["pos"]) >= F.col("_start")) & (F.floor(w["pos"]) < F.col("_end")),
    )
    targets = ranges.withColumn("_wanted", held).filter(F.size("_wanted") > 0)
    inside = null_safe_join(distinct, targets.drop("_end", "_total"), [*keys, "_bucket"])
    upto_value = Window.partitionBy(*keys, "_bucket").orderBy("_x")
    high = F.col("_start") + F.sum("_w").over(upto_value)
    placed = inside.withColumn("_hi", high)
    hits = placed.select(
        *keys, "_x", (F.col("_hi") - F.col("_w")).alias("_lo"), "_hi", F.inline("_wanted")
    )

    def at(rank: Column, name: str, kind: str) -> Column:
        here = (F.col("_lo") <= rank) & (rank < F.col("_hi"))
        mine = (F.col("name") == name) & (F.col(series) == kind)
        return F.max(F.when(here & mine, F.col("_x")))

    floor, ceil, share = F.floor("pos"), F.ceil("pos"), F.col("pos") - F.floor("pos")
    columns = [(name, kind) for kind in series_values for name in fractions]
    ends = hits.groupBy(*groups).agg(
        *[at(floor, n, k).alias(f"_a_{n}_{k}") for n, k in columns],
        *[at(ceil, n, k).alias(f"_b_{n}_{k}") for n, k in columns],
        *[
            F.max(F.when((F.col("name") == n) & (F.col(series) == k), share)).alias(f"_s_{n}_{k}")
            for n, k in columns
        ],
    )

    def between(name: str) -> Column:
        low, top = F.col(f"_a_{name}"), F.col(f"_b_{name}")
        return (low + (top - low) * F.col(f"_s_{name}")).alias(name)

    return ends.select(*groups, *[between(f"{n}_{k}") for n, k in columns])


def bucket_of(x: Column) -> Column:
    """An order-keeping bucket number: logarithmic steps, mirrored for negative values."""
    return (F.signum(x) * F.floor(F.log1p(F.abs(x)) * 64)).cast("bigint")


# --- readers of marts -----------------------------------------------------------
def salary_bands_long(mart: DataFrame) -> DataFrame:
    """Two rows per mart row: the band of minimum and of maximum amounts."""
    label = F.format_string("%s (%s/%s)", "search_keyword", "currency", "period")
    bands = F.array(
        *[
            F.struct(
                F.lit(side).alias("band"),
                *[F.col(f"{p}_{side}").alias(p) for p in ("p25", "p50", "p75")],
            )
            for side in ("min", "max")
        ]
    )
    return mart.select("profile_id", label.alias("label"), F.inline(bands)).dropna(
        subset=["p25", "p75"]
    )


def top_skills(mart: DataFrame, sizes: dict[str, int] = TOP_SKILLS) -> DataFrame:
    """The most wanted skills of every (profile, keyword, type); list length by type, a type without a length gives no row."""
    order = [F.col("demand_count").desc(), F.col("skill_name")]
    keys = ["profile_id", "search_keyword", "skill_type"]
    ranked = top_per_key(mart, keys, order, max(sizes.values()), rank="position")
    allowed = F.lit(0)
    for kind, n in sizes.items():
        allowed = F.when(F.col("skill_type") == kind, n).otherwise(allowed)
    return ranked.filter(F.col("position") <= allowed)


def country_totals(mart: DataFrame) -> DataFrame:
    return (
        mart.groupBy("country_code", "country")
        .agg(F.sum("job_count").alias("job_count"))
        .orderBy(F.col("job_count").desc(), "country_code", "country")
    )


def country_iso3(totals: DataFrame, codes: DataFrame) -> DataFrame:
    """Totals of the countries whose two-letter code has a three-letter one.

    ``codes`` is the ISO 3166 table (alpha2, alpha3): about 250 rows.
    """
    iso = F.broadcast(codes.select(F.col("alpha2").alias("_a2"), F.col("alpha3").alias("iso3")))
    return totals.join(iso, F.upper("country_code") == F.col("_a2")).drop("_a2")


def iso_codes(spark) -> DataFrame:
    """ISO 3166 codes as the Java runtime knows them (a fixed list of about 250 rows)."""
    locale = spark.sparkContext._jvm.java.util.Locale
    rows = [(code, locale("", code).getISO3Country()) for code in locale.getISOCountries()]
    return spark.createDataFrame([r for r in rows if r[1]], "alpha2 string, alpha3 string")
