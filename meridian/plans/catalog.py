"""Registered queries: name to callable (spark, sf_dir) -> DataFrame, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import cases, corpus, evaluation, flows, modelling, preparation

MODULES = (evaluation, preparation, corpus, cases, flows, modelling)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: f for m in MODULES for k, f in m.QUERIES.items()}
ORACLE_SQL: dict[str, str] = {k: s for m in MODULES for k, s in m.ORACLE_SQL.items()}
