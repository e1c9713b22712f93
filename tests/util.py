import math


def norm(v, digits=9):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, digits))
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return tuple(norm(x, digits) for x in v)
    return repr(v)


def bag(cols, rows, digits=9):
    """Order-insensitive rows with columns sorted by name."""
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(tuple(norm(r[i], digits) for i in order) for r in rows)


def spark_bag(df, digits=9):
    return bag(df.columns, [tuple(r) for r in df.collect()], digits)


def duck_bag(con, sql, digits=9):
    cur = con.execute(sql)
    cols = [d[0] for d in cur.description]
    return bag(cols, cur.fetchall(), digits)
