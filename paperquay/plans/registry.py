"""Registered queries: each has a name, a builder over a ``Lake``, and the SQL it must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from paperquay.plans.fixtures import Lake, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, views: str = "", sql: str | None = None, tail: str = ""):
    """Register ``build(lake) -> DataFrame``.

    ``views`` names the views its SQL reads; ``tail`` holds further common table expressions.
    """

    def add(build: Callable[[Lake], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return build(Lake(spark, sf_dir))

        run.__name__ = name
        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = with_views(views.split(), sql, tail)
        return build

    return add
