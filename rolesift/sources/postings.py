"""Landed posting files and their mapping to staging rows."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rolesift.constants import DEFAULT_SITES
from rolesift.functions.keys import NOT_BLANK, posting_id
from rolesift.operators.dedup import first_per_key
from rolesift.schemas import FEED_SCHEMA, align, schema_of

_CSV = {
    "header": True, "escape": '"',
    "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False,
}
RENAMED = {"location_raw": "location", "salary_raw": "salary_source"}


def read_postings(
    spark: SparkSession, path: str | list[str], fmt: str = "parquet", multi_line: bool = True
) -> DataFrame:
    """Read landed posting files; a column the files do not have comes out as NULL.

    CSV columns are found by their header, and a field may span lines; a board whose fields
    never do is read with ``multi_line=False``, which lets Spark split its files.
    """
    if fmt == "csv":
        raw = spark.read.csv(path, multiLine=multi_line, **_CSV)
        return align(raw, FEED_SCHEMA, lenient=True)
    return spark.read.schema(FEED_SCHEMA).format(fmt).load(path)


def land_sites(
    spark: SparkSession, sources: dict[str, tuple[str, str]], folder: str
) -> tuple[DataFrame, DataFrame]:
    """Copy the files of each site, (path, format), to a folder; returns the rows and a status row per site.

    Each site is its own job: one that cannot be read leaves no row and its error text, and the
    others land. The status has (site, error), error NULL where all went well.
    """
    status: list[tuple[str, str | None]] = []
    landed = [spark.createDataFrame([], FEED_SCHEMA)]
    for number, (site, (path, fmt)) in enumerate(sources.items()):
        target = f"{folder}/site-{number}"
        try:
            read_postings(spark, path, fmt).write.parquet(target)
        except Exception as problem:  # recorded, the landing goes on
            status.append((site, f"{type(problem).__name__}: {str(problem).splitlines()[0]}"))
        else:
            status.append((site, None))
            landed.append(spark.read.schema(FEED_SCHEMA).parquet(target))
    return reduce(DataFrame.unionByName, landed), spark.createDataFrame(status, "site string, error string")


def write_postings(feed: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Land feed rows as files of one of the formats ``read_postings`` reads."""
    writer = feed.write.format(fmt)
    if fmt == "csv":
        writer = writer.options(**_CSV)
    writer.save(path)


def drop_blank_url(raw: DataFrame) -> DataFrame:
    """Rows whose URL is NULL, empty or white space only cannot be identified."""
    return raw.filter(F.col("job_url").rlike(NOT_BLANK))


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN stands for "absent" in feeds written by data-frame tools."""
    doubles = {f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    return df.select(
        [
            F.when(~F.isnan(c), F.col(c)).alias(c) if c in doubles else F.col(c)
            for c in df.columns
        ]
    )


def raw_payload(columns: Sequence[str] = tuple(FEED_SCHEMA.names)) -> Column:
    """The source row as JSON without its description; NULLs stay as explicit nulls."""
    native = (T.StringType, T.DoubleType, T.BooleanType)

    def field(name: str) -> Column:
        kind = FEED_SCHEMA[name].dataType if name in FEED_SCHEMA.names else T.StringType()
        value = F.col(name)
        return (value if isinstance(kind, native) else value.cast("string")).alias(name)

    kept = [field(c) for c in columns if c != "description"]
    return F.to_json(F.struct(*kept), {"ignoreNullFields": "false"})


def to_staging(
    raw: DataFrame,
    *,
    run_id: Column,
    profile_id: Column,
    keyword: Column,
    location: Column,
    scraped_at: Column,
    arrival: Sequence[Column],
    default_site: str = DEFAULT_SITES[0],
    keep: Sequence[str] = (),
    copies_by: Sequence[str] | None = None,
) -> DataFrame:
    """Map feed rows to staging rows: one row per (site, url), the first to arrive wins.

    ``arrival`` orders the copies of a posting; ``keep`` carries extra columns along.
    Copies are dropped first, so the payload text is built for winners only and is
    not part of the exchange. ``copies_by`` names kept columns of which each value stands for one posting
    here; a feed that is dealt by them needs no further exchange.
    """
    site = F.coalesce(F.nullif(F.col("site"), F.lit("")), F.lit(default_site))
    request = {
        "id": posting_id(site, F.col("job_url")),
        "scraped_at": scraped_at,
        "run_id": run_id,
        "profile_id": profile_id,
        "search_keyword": keyword,
        "search_location": location,
    }
    feed = nan_to_null(drop_blank_url(raw))
    kept = list(dict.fromkeys([*(c for c in FEED_SCHEMA.names if c in raw.columns), *keep]))
    keyed = feed.select(
        *kept,
        *[value.alias(f"_{name}") for name, value in request.items()],
        F.struct(*arrival).alias("_arrival"),
    )
    first = first_per_key(keyed, copies_by or ["_id"], [F.col("_arrival")])
    own = {name: F.col(f"_{name}") for name in request}
    own["site"] = site
    own["raw_payload"] = raw_payload([c for c in FEED_SCHEMA.names if c in raw.columns])
    own.update({new: F.col(old) for new, old in RENAMED.items() if old in raw.columns})
    return first.select(
        *[
            own.get(f.name, F.col(f"`{f.name}`") if f.name in kept else F.lit(None))
            .cast(f.dataType)
            .alias(f.name)
            for f in schema_of("staging_job_offers")
        ],
        *[c for c in keep if c not in schema_of("staging_job_offers").names],
    )


def with_missing_columns(frames: Sequence[DataFrame]) -> DataFrame:
    """One feed out of files of several boards whose columns differ."""
    return align(_union(frames), FEED_SCHEMA)


def _union(frames: Sequence[DataFrame]) -> DataFrame:
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame, allowMissingColumns=True)
    return out
