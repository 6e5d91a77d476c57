"""Rows of a frame against those of a DuckDB query."""


def plain(rows):
    """Rows as sorted tuples of texts, floats to nine digits."""
    return sorted(tuple(f"{v:.9g}" if isinstance(v, float) else str(v) for v in r) for r in rows)


def same_rows(df, con, sql):
    names = sorted(df.columns)
    got = plain(df.select(*[f"`{c}`" for c in names]).collect())
    found = con.execute(sql)
    order = [d[0] for d in found.description]
    assert sorted(order) == names
    at = [order.index(c) for c in names]
    assert got == plain([r[i] for i in at] for r in found.fetchall())
