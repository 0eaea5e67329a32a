"""Unordered comparison of a DataFrame with a DuckDB result."""


def cell(v):
    if v is None:
        return "~"
    return repr(float(v)) if isinstance(v, float) else str(v)


def same_rows(df, result) -> None:
    names = sorted(result.columns)
    assert sorted(df.columns) == names
    at = [result.columns.index(n) for n in names]
    ours = sorted(tuple(cell(r[n]) for n in names) for r in df.collect())
    theirs = sorted(tuple(cell(r[i]) for i in at) for r in result.fetchall())
    assert ours == theirs
