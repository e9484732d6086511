"""How queries are registered together with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import functions as F

#: Digits to which means are rounded, in the query and in its SQL: sums in another order differ in the last bits only.
DIGITS = 9


def registering(queries: dict, sql: dict[str, str]) -> Callable:
    """A decorator for functions (spark, sf_dir) -> DataFrame. rounded: the columns, parted by blanks, that both sides round."""

    def query(text: str | None = None, rounded: str = "") -> Callable:
        cols = rounded.split()

        def add(f: Callable) -> Callable:
            def run(spark, sf_dir):
                df = f(spark, sf_dir)
                return df.withColumns({c: F.round(c, DIGITS) for c in cols}) if cols else df

            run.__name__, run.__doc__ = f.__name__, f.__doc__
            queries[f.__name__] = run
            if text:
                sql[f.__name__] = f"SELECT * REPLACE ({', '.join(f'round({c}, {DIGITS}) AS {c}' for c in cols)}) FROM ({text})" if cols else text
            return run

        return add

    return query
