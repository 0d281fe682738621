"""All queries of the library by name, with the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .views import Tables, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    """Register ``f(tables) -> DataFrame`` under its name, with the SQL of the same rows."""

    def keep(f: Callable[[Tables], DataFrame]):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            ORACLE[f.__name__] = with_views(sql)
        return f

    return keep


from . import queries_audit, queries_contract, queries_events, queries_match, queries_mining, queries_sources, queries_text  # noqa: E402,F401

# queries of earlier rounds that were the whole form of another one, and are now the same
for _twin in ("p7_slug", "p8_company_slug", "f10_fold_label", "f14_close_enough", "p15_clamp01", "s12_page_blocks"):
    ORACLE[f"{_twin}_all"] = ORACLE[_twin]
# whole numbers as they are: a double holds 53 bits of them
ORACLE["p9_lenient_int_all"] = r"SELECT doc_id, TRY_CAST(replace(regexp_extract(text, '(\d[\d,]*)', 1), ',', '') AS BIGINT) AS n FROM documents"
