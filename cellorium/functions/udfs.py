"""The tails of ``special`` as vectorised column functions; null in, null out."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType, StructField, StructType

from cellorium.functions import special


def _scalar(name: str):
    def tail(*args):
        got = np.asarray(getattr(special, name)(*[a.to_numpy(dtype=float, na_value=np.nan) for a in args]))
        return pd.Series(pd.arrays.FloatingArray(got, np.isnan(got)))

    return tail


def _udf(name: str, n: int):
    f = _scalar(name)
    if n == 1:

        def call(a: pd.Series) -> pd.Series:
            return f(a)
    elif n == 2:

        def call(a: pd.Series, b: pd.Series) -> pd.Series:
            return f(a, b)
    else:

        def call(a: pd.Series, b: pd.Series, c: pd.Series) -> pd.Series:
            return f(a, b, c)

    call.__annotations__ = {k: pd.Series for k in call.__annotations__}
    return pandas_udf(call, DoubleType())


_made: dict = {}


def _get(name: str, n: int):
    if name not in _made:
        _made[name] = _udf(name, n)
    return _made[name]


def norm_sf2(z: Column) -> Column:
    return _get("norm_sf2", 1)(z.cast("double"))


def t_sf2(t: Column, df: Column) -> Column:
    return _get("t_sf2", 2)(t.cast("double"), df.cast("double"))


def f_sf(f: Column, d1: Column, d2: Column) -> Column:
    return _get("f_sf", 3)(f.cast("double"), d1.cast("double"), d2.cast("double"))


def chi2_sf(x: Column, df: Column) -> Column:
    return _get("chi2_sf", 2)(x.cast("double"), df.cast("double"))


def ptukey_sf(q: Column, k: Column, df: Column) -> Column:
    return _get("ptukey_sf", 3)(q.cast("double"), k.cast("double"), df.cast("double"))


def fisher_exact(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Struct (odds_ratio, p_value) of a 2x2 table of counts."""
    if "fisher" not in _made:

        def call(a, b, c, d):
            o, p = special.fisher_exact(*[x.to_numpy(dtype=float, na_value=np.nan) for x in (a, b, c, d)])
            return pd.DataFrame({"odds_ratio": o, "p_value": p})

        call.__annotations__ = {"a": pd.Series, "b": pd.Series, "c": pd.Series, "d": pd.Series, "return": pd.DataFrame}
        _made["fisher"] = pandas_udf(call, StructType([StructField("odds_ratio", DoubleType()), StructField("p_value", DoubleType())]))
    return _made["fisher"](*[x.cast("double") for x in (a, b, c, d)])


def register(spark) -> None:
    """Make the tails callable from SQL under their own names."""
    for name, n in (("norm_sf2", 1), ("t_sf2", 2), ("f_sf", 3), ("chi2_sf", 2), ("ptukey_sf", 3)):
        spark.udf.register(name, _get(name, n))
