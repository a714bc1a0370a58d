"""Comparison of a Spark result with DuckDB's, as bags of rows."""


def cell(v) -> str:
    if v is None or v != v:
        return "null"
    if isinstance(v, float):
        return f"{v:.9g}"
    return str(v)


def rows_of(names, rows) -> list:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(cell(r[i]) for i in order) for r in rows)


def same(df, relation) -> None:
    assert sorted(df.columns) == sorted(relation.columns)
    assert rows_of(df.columns, df.collect()) == rows_of(relation.columns, relation.fetchall())
