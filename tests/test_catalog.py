"""Every catalogue query against its SQL on the smallest tables."""

import duckdb
import pytest

from blobsmith.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return round(v, 6)
    return tuple(map(plain, v)) if isinstance(v, list) else v


def key(row):
    return tuple((v is None, str(v)) for v in row)


@pytest.mark.parametrize("name", catalog.ORACLE_SQL)
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=key)
    found = duck.execute(catalog.ORACLE_SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    order = sorted(range(len(names)), key=names.__getitem__)
    assert got == sorted((tuple(plain(r[i]) for i in order) for r in found.fetchall()), key=key)


def test_counts_add_up(spark):
    """Rows shown and rows filtered out are all rows, whatever the order of the filters."""
    from pyspark.sql import functions as F

    from blobsmith.operators import listing

    part = spark.read.parquet(f"{SF}/part.parquet")
    a = listing.visible(part, dead=F.col("p_size") > 40, kind=(F.col("p_type"), "SMALL"), name=F.col("p_name"), text="r*g")
    b = listing.visible(listing.visible(part, name=F.col("p_name"), text="r*g"), dead=F.col("p_size") > 40, kind=(F.col("p_type"), "SMALL"))
    assert a.count() == b.count() > 0
    assert listing.visible(part, name=F.col("p_name"), text="  ").count() == part.count()


def test_ranks_without_one_sort(spark):
    from pyspark.sql import functions as F

    from blobsmith.operators import relations

    rows = spark.range(0, 3000, 3).withColumn("at", (F.col("id") * 7919) % 10007)
    got = relations.ranked(rows, "at", "rank", parts=7).orderBy("at").collect()
    assert [r["rank"] for r in got] == list(range(1, 1001))
    assert relations.ranked(rows.where("id < 0"), "at", "rank").count() == 0


def test_whole_texts(spark, tmp_path):
    """The queries of blobs against plain Python, over long texts and none; what counts stands far into them."""
    import re
    import zlib

    from blobsmith.codecs import bytes as codec

    long = "a" * 700 + " The é the, " + '"q,' + "x" * 60_000 + '\\" ' * 5000 + '" con\nth'
    texts = [long, long[:-1] + "H", "", "the th", None]
    spark.createDataFrame([(i, t, "src") for i, t in enumerate(texts)], "doc_id long, text string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    run = lambda name: {r["doc_id"]: r for r in catalog.QUERIES[name](spark, str(tmp_path)).collect()}
    crc, adler, dump, tokens = (run(n) for n in ("crc32_msb", "adler32", "hex_dump", "value_split"))
    scalars, found, turned = (run(n) for n in ("text_scalars", "find_matches", "byte_scalars"))
    for i, text in enumerate(texts[:4]):
        data = text.encode()
        assert crc[i]["crc"] == codec.crc32_msb(data) and adler[i]["adler"] == zlib.adler32(data) and dump[i]["dump"] == data.hex(" ").upper()
        assert tokens[i]["tokens"] == [m[0].strip(" ") for m in re.finditer(r'"(?:\\.|[^"\\])*"|[^,]+', text.replace("\n", ","))]
        assert scalars[i]["group_name"] == re.sub("[^a-z0-9_]", "", text.lower()) and scalars[i]["key_name"] == re.sub("[^a-z0-9/_: ]", "", text.lower())
        assert scalars[i]["quoted"] == text.replace('"', '\\"') and scalars[i]["replaced"] == re.sub("(?i)the", "#", text)
        places = [k for k in range(len(data) - 1) if data[k : k + 2] == b"th"]
        assert found[i]["places"] == places and found[i]["first_after"] == next((k for k in places if k >= 40), -1)
        assert turned[i]["reversed"] == data[::-1].hex().upper() and turned[i]["printable"] == all(32 <= b < 127 or b in b"\t\n\r" for b in data)
    assert crc[4]["crc"] is None and adler[4]["adler"] is None
    last = len(long.encode()) - 1
    assert [tuple(r) for r in catalog.QUERIES["byte_diff_topn"](spark, str(tmp_path)).collect()] == [(0, last, ord("h"), ord("H"))]
    names = catalog.QUERIES["name_validate"](spark, str(tmp_path)).where("doc_id = 0").collect()
    assert [r["name"] for r in names][: -len(catalog.ODD_NAMES)] == long.split(" ") and names[0]["status"] == "TooLong"
