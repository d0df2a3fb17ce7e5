"""Compare rows without regard to order; floats to nine digits."""

import math


def _plain(x):
    if x is None or isinstance(x, float) and math.isnan(x):
        return "null"
    if isinstance(x, bool):
        return str(x)
    if isinstance(x, (int, float)):
        return f"{float(x):.9g}"
    if hasattr(x, "isoformat"):
        return x.isoformat()
    if isinstance(x, (list, tuple)):
        return str([_plain(y) for y in x])
    if type(x).__name__ == "Decimal":
        return f"{float(x):.9g}"
    return str(x)


def rows(df) -> list[tuple]:
    names = sorted(df.columns)
    return sorted(tuple(_plain(r[n]) for n in names) for r in df.collect())


def same_as_sql(df, con, sql: str) -> None:
    got = con.execute(sql)
    names = [d[0] for d in got.description]
    assert sorted(names) == sorted(df.columns)
    order = sorted(range(len(names)), key=lambda i: names[i])
    want = sorted(tuple(_plain(r[i]) for i in order) for r in got.fetchall())
    have = rows(df)
    assert len(have) == len(want)
    assert have == want
