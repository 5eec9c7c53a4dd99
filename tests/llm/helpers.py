import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(df):
    cols = sorted(df.columns)
    return sorted((tuple(repr(r[c]) for c in cols) for r in df.collect()))


def oracle_rows(sql, sf_dir="/root/testdata/sf0.01"):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    got = con.execute(sql)
    cols = [c[0] for c in got.description]
    order = [cols.index(c) for c in sorted(cols)]
    return sorted(tuple(repr(r[i]) for i in order) for r in got.fetchall())
