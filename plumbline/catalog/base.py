"""Shared pieces of the query modules."""

from __future__ import annotations

from pyspark.sql import functions as F


def registrar():
    """A query table, a SQL table and the decorator that fills both."""
    q, sql = {}, {}

    def query(name, text=None):
        def put(fn):
            q[name] = fn
            if text is not None:
                sql[name] = text
            return fn
        return put
    return q, sql, query


def r6(c, name=None):
    return F.round(F.col(c) if isinstance(c, str) else c, 6).alias(name or c)


def rows(spark, text, schema):
    """A rule table: literal, of fixed size."""
    return spark.createDataFrame([tuple(x.strip() or None for x in line.split("|")) for line in text.split(";")], schema)
