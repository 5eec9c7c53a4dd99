import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def values(columns, records):
    """Rows as tuples in the order of the column names, with whole numbers of any type alike."""
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = lambda v: repr(v)
    return sorted(tuple(plain(r[i]) for i in order) for r in records)


def oracle(sql, sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    got = con.execute(sql)
    columns = [c[0] for c in got.description]
    return sorted(columns), values(columns, got.fetchall())
