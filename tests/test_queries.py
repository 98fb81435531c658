"""Every query of the engine against its SQL."""

import duckdb
import pytest
from seqlake import queries


@pytest.fixture(scope="module")
def con(small):
    import glob

    con = duckdb.connect()
    for f in glob.glob(f"{small}/*.parquet"):
        con.execute(f"CREATE VIEW {f.split('/')[-1][:-8]} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, small, con, name):
    got = queries.QUERIES[name](spark, small)
    if name not in queries.SQL:
        assert got.count() > 0
        return
    want = con.execute(queries.SQL[name])
    columns = [d[0] for d in want.description]
    assert sorted(columns) == sorted(got.columns)
    key = lambda r: tuple(round(x, 9) if isinstance(x, float) else x for x in r)
    assert sorted(map(key, want.fetchall()), key=str) == sorted((key(r) for r in got.select(*columns).collect()), key=str)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_columns(spark):
    from pyspark.sql import functions as F
    from seqlake.functions import columns, encoding

    rows = spark.createDataFrame([(0, b""), (127, b"a"), (128, b"abc"), (2**40, b"abd"), (2**62, b"\xff\xffa"), (300, b"\xff"), (5, b"a" * 5000)], "n long, b binary").withColumn("limit", F.lit(b"abz"))
    out = rows.select("n", "b", columns.crc32c("b").alias("c"), columns.hash32("b").alias("h"), columns.encode_varint("n").alias("v"), columns.varint_length(F.col("n")).alias("l"), columns.encode_fixed64(F.col("n")).alias("f"), columns.masked(columns.crc32c("b")).alias("m"),
        columns.unmasked(columns.masked(columns.crc32c("b"))).alias("u"), columns.decode_varint(columns.encode_varint("n")).alias("back"), columns.decode_fixed(columns.encode_fixed(F.col("n"), 4), 4).alias("f4"),
        columns.take_with_length(F.concat(columns.with_length(F.col("b")), F.lit(b"!"))).alias("t"), columns.successor("b").alias("s"), columns.separator("b", "limit").alias("p"),
    ).collect()
    for r in out:
        b = bytes(r["b"])
        assert r["u"] == r["c"] and r["back"] == r["n"] and r["f4"] == r["n"] % 2**32
        assert (bytes(r["t"]["taken"]), bytes(r["t"]["rest"])) == (b, b"!")
        assert bytes(r["s"]) == encoding.successor(b) and bytes(r["p"]) == encoding.separator(b, b"abz")
        assert (r["c"], r["h"], bytes(r["v"]), r["l"], bytes(r["f"]), r["m"]) == (encoding.crc32c(b), encoding.hash32(b, encoding.FILTER_SEED), encoding.encode_varint(r["n"]), encoding.varint_length(r["n"]), encoding.encode_fixed(r["n"], 8), encoding.mask_crc(encoding.crc32c(b)))
    names = spark.createDataFrame([(x,) for x in ("000045.sst", "MANIFEST-000123", "CURRENT", "garbage", "LOG.old", "7.dbtmp")], "name string")
    got = {r["name"]: r["p"] and (r["p"]["type"], int(r["p"]["number"])) for r in names.select("name", columns.parsed_name("name").alias("p")).collect()}
    assert got == {n: encoding.parse_file_name(n) for n in got}
