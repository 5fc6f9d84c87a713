"""Comparison of a query with its SQL."""


def canonical(rows, names):
    order = [names.index(c) for c in sorted(names)]
    return sorted(tuple(repr(round(r[k], 9)) if isinstance(r[k], float) else str(r[k]) for k in order) for r in rows)


def compare(df, relation):
    assert sorted(df.columns) == sorted(relation.columns)
    got, want = canonical(df.collect(), df.columns), canonical(relation.fetchall(), relation.columns)
    assert got == want, (got[:2], want[:2])
    return len(got)
