"""The user-level compositions: from tables to exported metadata."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colmeta.functions.vectors import blended, encoded, is_definition
from colmeta.operators import answers, linking, match, merge, profile, select
from colmeta.sources import export, lake, store


def table_metadata(df: DataFrame, table_id: str) -> DataFrame:
    """Metadata template of one table."""
    return profile.template(profile.profile(df, table_id))


def catalogue_metadata(tables: dict[str, DataFrame]) -> DataFrame:
    """Metadata template of many tables."""
    out = None
    for name, df in tables.items():
        one = table_metadata(df, name)
        out = one if out is None else out.unionByName(one)
    return out


def lake_metadata(files: DataFrame) -> DataFrame:
    """Metadata template of a lake's Parquet files (table_id, path), in one plan whatever the number of tables."""
    return profile.template(lake.profile_files(files))


def linked_metadata(observations: DataFrame, sites: DataFrame, on: str, site_key: str, table_id: str) -> DataFrame:
    """Metadata template of observations linked to their sites."""
    return table_metadata(linking.linked(observations, sites, on, site_key), table_id)


def imported(metadata: DataFrame, new: DataFrame) -> DataFrame:
    """Metadata with an import's values, and valid types only."""
    return profile.validated(merge.merged(metadata, new, "yes"))


def described_with_errors(metadata: DataFrame, contexts: DataFrame, cache: DataFrame, provider: Callable[[str, str], str], path: str | None = None, retries: int = 2, wait: float = 0.0) -> tuple[DataFrame, DataFrame, DataFrame]:
    """As described(), and a row for each table without descriptions: table_id, error, attempts.

    error is what the provider's last call raised, or that its answer holds no JSON object. Such tables keep their
    metadata. A failed request is not cached, so the next run asks again. Answers are kept in the folder path + "-calls" as
    they arrive: a task that runs again doesn't call for them again, nor does a run that is given the path of a broken one.
    """
    path = path or store.new_path(metadata.sparkSession)
    asked = answers.requests(contexts)
    missing = answers.looked_up(answers.distinct_requests(asked), cache).where("cached is null").drop("cached")
    fresh = store.written(answers.generated(missing, provider, retries, wait, f"{path}-calls"), path)
    known = cache.select("cache_key", "response", F.lit(None).cast("string").alias("error"), F.lit(0).alias("attempts")).unionByName(fresh.select("cache_key", "response", "error", "attempts"))
    said = asked.select("table_id", "cache_key").join(known, "cache_key")
    got = answers.described(said.where("error is null").select("table_id", "response"))
    new = got.where("not parse_error").select("table_id", "name", "description", F.lit(0).alias("seq"))
    unread = said.join(got.where("parse_error").select("table_id").distinct(), "table_id", "left_semi").select("table_id", F.lit("no JSON object in the answer").alias("error"), "attempts")
    errors = said.where("error is not null").select("table_id", "error", "attempts").unionByName(unread)
    return merge.merged(metadata, new, "yes"), answers.upserted(cache, fresh.where("error is null")), errors


def described(metadata: DataFrame, contexts: DataFrame, cache: DataFrame, provider: Callable[[str, str], str], path: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Metadata with descriptions from contexts (table_id, provider, context, variables), and the new cache.

    Only requests that the cache doesn't hold reach the provider, once for each cache_key, whoever asks. The calls are
    made here and their answers written to path (a new folder of the shared one, if not given); both results read them.
    """
    return described_with_errors(metadata, contexts, cache, provider, path)[:2]


def matched(metadata: DataFrame, vocabulary: DataFrame, encoder: Callable[[pd.Series], list] | Callable[[Column], Column], k: int = match.NEAREST, alpha: float = 0.4, native: bool = False) -> DataFrame:
    """Hits of each column: table_id, ordinal, header, term columns, distance; the k nearest terms, one for each uri.

    encoder takes batches of texts; with native it is an expression of a text column, such as hashed_vector.
    """
    own = metadata.select("table_id", "ordinal", "name", "description")
    both = own.withColumns({"wv": encoder(F.col("name")), "dv": encoder(F.col("description"))}) if native else encoded(encoded(own, "name", encoder, "wv"), "description", encoder, "dv")
    vector = blended(F.col("wv"), F.when(is_definition(F.col("description")), F.col("dv")), alpha).cast("array<float>")
    keyed = both.select("table_id", "ordinal", F.col("name").alias("header"), F.xxhash64("table_id", "ordinal").alias("query"), vector.alias("vector"))
    found = match.with_terms(match.nearest(keyed, vocabulary.select("id", F.col("embedding").alias("vector")), k), vocabulary)
    return match.preferred(found).join(keyed.drop("vector"), "query").drop("query", "rank")


def chosen(metadata: DataFrame, hits: DataFrame) -> DataFrame:
    """Metadata with the terms of the selected hits written back. In tables with a selected hit, headers without one get blanks; other tables stay."""
    by = ("table_id", "header")
    summed = select.summary(hits, by)
    asked = hits.join(hits.where("selected").select("table_id").distinct(), "table_id", "left_semi")
    headers = asked.groupBy(*by).agg(F.min("ordinal").alias("first_at"))
    return select.written_back(metadata, select.with_unmatched(summed, headers, by))


def exported(metadata: DataFrame, form: str) -> DataFrame:
    """Metadata as csv rows, or as a tableschema or csvw document for each table."""
    forms = {"csv": export.to_csv_rows, "tableschema": export.to_table_schema, "csvw": export.to_csvw}
    if form not in forms:
        raise ValueError(f"form {form!r} is none of {sorted(forms)}")
    return forms[form](profile.validated(metadata))
