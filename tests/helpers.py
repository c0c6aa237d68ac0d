"""Comparison of frames with expected rows."""

import math


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else round(x, 6)
    return tuple(map(plain, x)) if isinstance(x, (list, tuple)) else x


def rows(df, *columns):
    found = df.select(*columns) if columns else df
    return sorted((tuple(plain(x) for x in r) for r in found.collect()), key=lambda r: [(x is None, str(type(x)), x if x is not None else 0) for x in r])
