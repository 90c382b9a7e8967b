"""Queries over the test tables, one for each operator that SQL can check, each beside its SQL.

The tables stand in for listings: part, documents and lineitem for entries, document texts for blobs, conversations for
slots within a group, events.props for JSON.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from blobsmith.functions import binary as B
from blobsmith.functions import blobs
from blobsmith.functions import json as J
from blobsmith.functions import text as X
from blobsmith.functions import validators
from blobsmith.operators import changes, listing, relations
from blobsmith.sources import archive

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None) -> Callable[[Query], Query]:
    """Registers a query under its name, with its SQL."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    blobs.small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


SIZE_SQL = """CASE WHEN n < 1024 THEN format('{:,}', n) || 'B'
 WHEN n < 1048576 THEN format('{:,}', n // 1024) || CASE WHEN (n % 1024) * 10 // 1024 > 0 THEN '.' || CAST((n % 1024) * 10 // 1024 AS VARCHAR) ELSE '' END || 'KB'
 ELSE format('{:,}', n // 1048576) || CASE WHEN (n % 1048576) * 10 // 1048576 > 0 THEN '.' || CAST((n % 1048576) * 10 // 1048576 AS VARCHAR) ELSE '' END || 'MB' END"""


@query(f"""SELECT doc_id, source, n AS size, {SIZE_SQL} AS size_str FROM
 (SELECT doc_id, source, lang, CAST(octet_length(encode(text)) AS BIGINT) AS n FROM documents)
 WHERE lang = 'en' AND contains(upper(source), 'SRC1') ORDER BY (doc_id % 10 = 3) DESC, n DESC, doc_id DESC""")
def listing_filter_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The filtered listing with readable sizes, pinned rows first."""
    rows = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", F.octet_length("text").cast("long").alias("size"))
    rows = listing.visible(rows, kind=(F.col("lang"), "en"), name=F.col("source"), text="src1")
    rows = rows.select("doc_id", "source", "size", X.human_size(F.col("size")).alias("size_str"))
    return listing.ordered(rows, F.col("size"), pinned=F.col("doc_id") % 10 == 3, key=F.col("doc_id"), descending=True)


@query("SELECT p_partkey, p_name FROM part WHERE regexp_matches(p_name, 'S.*R', 'i')")
def wildcard_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listing.visible(table(spark, sf_dir, "part").select("p_partkey", "p_name"), name=F.col("p_name"), text="S*R")


@query(f"SELECT doc_id, {SIZE_SQL} AS size_str, {SIZE_SQL.replace('n ', 'm ').replace('n)', 'm)')} AS big_size_str FROM "
       "(SELECT doc_id, CAST(octet_length(encode(text)) AS BIGINT) AS n, CAST(octet_length(encode(text)) * 1021 AS BIGINT) AS m FROM documents)")
def human_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.octet_length("text").cast("long")
    return table(spark, sf_dir, "documents").select("doc_id", X.human_size(size).alias("size_str"), X.human_size(size * 1021).alias("big_size_str"))


@query("""SELECT doc_id, NOT regexp_matches(substr(hex(encode(text)), 1, 8192), '^(..)*?(0[0-8]|0B|0C|0E|0F|1[0-9]|1[B-F]|81|8D|8F|90|9D)') AS is_text FROM documents""")
def text_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", B.is_text(F.col("text").cast("binary")).alias("is_text"))


MAGIC_DEMO = [("<!DO", "HTML"), ("The ", "THE"), ("Of", "OF"), ("And", "AND"), ("En", "EN"), ("<!", "XML")]


@query("""WITH m(magic, kind) AS (VALUES ('<!DO', 'HTML'), ('The ', 'THE'), ('Of', 'OF'), ('And', 'AND'), ('En', 'EN'), ('<!', 'XML')),
 b AS (SELECT 'page' AS origin, page_id AS id, html AS body FROM pages UNION ALL SELECT 'document', doc_id, text FROM documents)
 SELECT origin, id, coalesce(a.kind, c.kind, d.kind, 'Unknown') AS kind FROM b
 LEFT JOIN m a ON length(a.magic) = 4 AND a.magic = left(body, 4) LEFT JOIN m c ON length(c.magic) = 3 AND c.magic = left(body, 3)
 LEFT JOIN m d ON length(d.magic) = 2 AND d.magic = left(body, 2)""")
def magic_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Type by the longest known prefix: three lookups in a table of six rows."""
    magic = spark.createDataFrame(MAGIC_DEMO, "magic string, kind string")
    rows = table(spark, sf_dir, "pages").select(F.lit("page").alias("origin"), F.col("page_id").alias("id"), F.col("html").alias("body"))
    rows = rows.unionByName(table(spark, sf_dir, "documents").select(F.lit("document").alias("origin"), F.col("doc_id").alias("id"), F.col("text").alias("body")))
    rows = rows.select("origin", "id", *[F.left("body", F.lit(n)).alias(f"m{n}") for n in (4, 3, 2)])
    for n in (4, 3, 2):
        keys = magic.where(F.char_length("magic") == n).select(F.col("magic").alias(f"m{n}"), F.col("kind").alias(f"k{n}"))
        rows = rows.join(F.broadcast(keys), f"m{n}", "left")
    return rows.select("origin", "id", F.coalesce("k4", "k3", "k2", F.lit("Unknown")).alias("kind"))


@query("""SELECT page_id, name, regexp_extract(name, '\\.[^.]*$') AS ext, upper(regexp_extract(name, '\\.[^.]*$')) AS ext_label FROM
 (SELECT page_id, regexp_extract(url, '[^/]*$') AS name FROM pages)""")
def ext_and_stem(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.regexp_extract("url", "[^/]*$", 0)
    return table(spark, sf_dir, "pages").select("page_id", name.alias("name"), X.extension(name).alias("ext"), F.upper(X.extension(name)).alias("ext_label"))


@query("""SELECT count(*) AS n_rows, count(*) FILTER (l_returnflag = 'R') AS n_dead, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS total_size,
 CAST(sum(CAST(l_quantity AS BIGINT)) FILTER (l_returnflag = 'R') AS BIGINT) AS dead_size, max(l_orderkey) + 1 AS next_id FROM lineitem""")
def totals_live_dead(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listing.totals(table(spark, sf_dir, "lineitem"), F.col("l_quantity").cast("long"), F.col("l_returnflag") == "R", F.col("l_orderkey"))


@query("""SELECT count(*) AS n_rows, count(*) FILTER (l_returnflag <> 'R' AND l_linestatus = 'O') AS n_visible,
 count(*) - count(*) FILTER (l_returnflag <> 'R' AND l_linestatus = 'O') AS n_filtered FROM lineitem""")
def filtered_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = (F.col("l_returnflag") != "R") & (F.col("l_linestatus") == "O")
    return table(spark, sf_dir, "lineitem").agg(F.count("*").alias("n_rows"), F.count_if(shown).alias("n_visible"), (F.count("*") - F.count_if(shown)).alias("n_filtered"))


@query("""SELECT kind, pinned FROM (SELECT DISTINCT lang AS kind, lang = 'es' AS pinned FROM documents) ORDER BY pinned DESC, kind""")
def distinct_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The offered types, one pinned, the rest by name."""
    rows = table(spark, sf_dir, "documents").select(F.col("lang").alias("kind")).distinct()
    return rows.withColumn("pinned", F.col("kind") == "es").orderBy(F.col("pinned").desc(), "kind")


@query("""SELECT upper(ext) AS ext_key, arg_min(ext, page_id) AS ext FROM (SELECT page_id, regexp_extract(url, '\\.[^./]*$') AS ext FROM pages) WHERE ext <> '' GROUP BY 1""")
def distinct_exts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listing.distinct_extensions(table(spark, sf_dir, "pages"), F.regexp_extract("url", r"\.[^./]*$", 0), F.col("page_id"))


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE NOT (l_returnflag = 'R' OR l_discount = 0)")
def purge_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changes.purged(table(spark, sf_dir, "lineitem"), F.col("l_returnflag") == "R", F.col("l_discount")).select("l_orderkey", "l_linenumber", "l_quantity")


@query("SELECT c_custkey, c_name FROM customer WHERE upper(c_name) IN (SELECT upper('customer#' || lpad(CAST(o_custkey AS VARCHAR), 9, '0')) FROM orders WHERE o_orderstatus = 'P')")
def import_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    present = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.format_string("customer#%09d", "o_custkey").alias("c_name"))
    return relations.conflicts(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), present, "c_name")


@query("SELECT DISTINCT c_custkey, c_name FROM customer WHERE upper(c_name) NOT IN (SELECT upper('customer#' || lpad(CAST(o_custkey AS VARCHAR), 9, '0')) FROM orders WHERE o_orderstatus = 'P')")
def import_skip(spark: SparkSession, sf_dir: str) -> DataFrame:
    present = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.format_string("customer#%09d", "o_custkey").alias("c_name"))
    return relations.without_conflicts(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), present, "c_name")


@query("""SELECT count(*) AS n_incoming, count(*) FILTER (h) AS n_conflicts, count(*) FILTER (NOT h) AS n_added FROM
 (SELECT c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P') AS h FROM customer)""")
def import_tallies(spark: SparkSession, sf_dir: str) -> DataFrame:
    present = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").cast("string").alias("name"))
    rows = relations.flagged(table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("name")), present, "name", "hit")
    return rows.agg(F.count("*").alias("n_incoming"), F.count_if("hit").alias("n_conflicts"), F.count_if(~F.col("hit")).alias("n_added"))


@query("SELECT n_nationkey FROM nation EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal < 2000")
def set_except(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select("n_nationkey").subtract(table(spark, sf_dir, "supplier").where("s_acctbal < 2000").select("s_nationkey"))


@query("""SELECT min(name) AS name FROM (SELECT source AS name FROM documents UNION ALL SELECT upper(source) FROM documents UNION ALL SELECT lang FROM documents) GROUP BY upper(name)""")
def union_changed(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    more = docs.select(F.upper("source").alias("name")).unionAll(docs.select(F.col("lang").alias("name")))
    return relations.union_ignoring_case(docs.select(F.col("source").alias("name")), more, "name")


@query("SELECT n_name AS name, n_nationkey AS id FROM nation UNION ALL SELECT r_name, r_regionkey FROM region")
def append_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation").select(F.col("n_name").alias("name"), F.col("n_nationkey").alias("id"))
    return nation.unionAll(table(spark, sf_dir, "region").select("r_name", "r_regionkey"))


@query("""WITH inc AS (SELECT p_name AS name, CAST(p_size + 1 AS BIGINT) AS size, row_number() OVER (PARTITION BY upper(p_name) ORDER BY p_partkey DESC) AS back FROM part WHERE p_partkey % 7 = 0),
 e AS (SELECT p_partkey AS id, p_name AS name, CAST(p_size AS BIGINT) AS size FROM part),
 hit AS (SELECT DISTINCT upper(name) AS k FROM inc)
 SELECT CASE WHEN upper(name) IN (SELECT k FROM hit) THEN '<DEAD SPACE>' ELSE name END AS name, size,
  CASE WHEN upper(name) IN (SELECT k FROM hit) THEN 1 ELSE 0 END AS flags, id <= (SELECT max(id) FROM e) AS old FROM e
 UNION ALL SELECT CASE WHEN back = 1 THEN name ELSE '<DEAD SPACE>' END, size, CASE WHEN back = 1 THEN 0 ELSE 1 END, false FROM inc""")
def overwrite_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Old rows of the names that come in become dead, the new ones are appended."""
    part = table(spark, sf_dir, "part")
    rows = part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_size").cast("long").alias("size"), F.lit(0).alias("dead_space_flags"))
    new = part.where("p_partkey % 7 = 0").select(F.col("p_name").alias("name"), (F.col("p_size") + 1).cast("long").alias("size"), F.lit(0).alias("dead_space_flags"), F.col("p_partkey").alias("seq"))
    last = part.agg(F.max("p_partkey").alias("last"))
    return changes.overwritten(rows, new, order="seq").crossJoin(F.broadcast(last)).select("name", "size", F.col("dead_space_flags").alias("flags"), (F.col("id") <= F.col("last")).alias("old"))


@query("""SELECT p_partkey AS came_from, (SELECT max(p_partkey) FROM part) + row_number() OVER (ORDER BY p_partkey DESC) AS id FROM part WHERE p_partkey % 7 = 0""")
def append_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Appended rows get the ids after the highest, in the order of their list."""
    part = table(spark, sf_dir, "part").withColumn("flags", F.lit(0))
    rows = part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), "flags", F.lit(None).cast("long").alias("came_from"))
    new = part.where("p_partkey % 7 = 0").select(F.col("p_name").alias("name"), "flags", F.col("p_partkey").alias("came_from"), (-F.col("p_partkey")).alias("seq"))
    return changes.overwritten(rows, new, flags="flags", order="seq").where("came_from is not null").select("came_from", "id")


@query("""SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN '<DEAD SPACE>' ELSE p_name END AS name, CASE WHEN p_partkey % 5 = 0 THEN 1 ELSE 0 END AS flags FROM part""")
def soft_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("name"), F.lit(0).alias("flags"))
    return changes.soft_deleted(part, part.where("p_partkey % 5 = 0"), "p_partkey", "flags")


TRIM_SQL = "regexp_replace({}, '^[\\x09-\\x0d\\x{{85}}\\p{{Z}}]+|[\\x09-\\x0d\\x{{85}}\\p{{Z}}]+$', '', 'g')"
STATUS_SQL = """CASE WHEN t IS NULL OR t = '' THEN 'NullOrWhiteSpace' WHEN t IN ('.', '..') THEN 'ContainsInvalidString'
 WHEN regexp_matches(t, '[\\x00-\\x1f"<>|:*?\\\\/]') THEN 'ContainsInvalidFileSystemChar' WHEN contains(t, '!') THEN 'ContainsInvalidChar'
 WHEN regexp_matches(regexp_replace(t, '\\.[^.]*$', ''), '^(?i)(CON|PRN|AUX|NUL|(COM|LPT)[1-9])$') THEN 'WindowsReservedName'
 WHEN length(t) < 2 THEN 'TooShort' WHEN length(t) > 15 THEN 'TooLong' WHEN contains(upper(t), 'ANTI') THEN 'ContainsInvalidString'
 WHEN regexp_matches(t, '[^\\x20-\\x7e]') THEN 'ContainsNonAscii' ELSE 'Ok' END"""
ODD_NAMES = ["con", "Lpt1.txt", "a?b", "..", " ", "com0", "nul.a.b", "\t", " tab\t", "hey!", "\u3000x"]


@query(f"""SELECT doc_id, n AS name, {STATUS_SQL} AS status FROM (SELECT doc_id, n, {TRIM_SQL.format('n')} AS t FROM (SELECT doc_id, unnest(string_split(text, ' ')) AS n FROM documents
 UNION ALL SELECT 0, unnest([{', '.join(f"'{x}'" for x in ODD_NAMES)}])))""")
def name_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first rule each name breaks; names are the words of the texts and some odd ones."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", " ")).alias("name"))
    more = spark.createDataFrame([(0, x) for x in ODD_NAMES], "doc_id long, name string")
    return rows.unionAll(more).withColumn("status", X.name_status(F.col("name"), shortest=2, banned=("anti",), banned_chars="!"))


@query("""SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 AND length('n' || p_partkey || repeat('x', CAST(p_partkey % 20 AS INT))) <= 15
 THEN 'n' || p_partkey || repeat('x', CAST(p_partkey % 20 AS INT)) ELSE p_name END AS name FROM part""")
def rename_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("name"))
    new = part.where("p_partkey % 3 = 0").select("p_partkey", F.concat(F.lit("n"), F.col("p_partkey").cast("string"), F.expr("repeat('x', cast(p_partkey % 20 as int))")).alias("new_name"))
    return changes.renamed(part, new, "p_partkey", X.name_status(F.col("new_name")))


@query("""SELECT c_custkey, c_nationkey, CASE WHEN row_number() OVER w = 1 THEN 'kept'
 WHEN c_mktsegment IS NOT DISTINCT FROM first_value(c_mktsegment) OVER w THEN 'same' ELSE 'different' END AS verdict
 FROM customer WINDOW w AS (PARTITION BY c_nationkey, c_custkey % 97 ORDER BY c_custkey)""")
def first_wins_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = relations.first_wins(table(spark, sf_dir, "customer"), F.struct("c_nationkey", F.col("c_custkey") % 97), ["c_custkey"], "c_mktsegment")
    return rows.select("c_custkey", "c_nationkey", "verdict")


@query("""WITH f AS (SELECT p_type, min(p_partkey) AS met FROM part GROUP BY 1), d AS (SELECT p_type, row_number() OVER (ORDER BY met) AS id FROM f)
 SELECT p_partkey, p_type, id FROM part JOIN d USING (p_type)""")
def dictionary_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select("p_partkey", "p_type")
    return part.join(relations.dictionary(part, "p_type", "p_partkey"), "p_type")


@query("""SELECT p_partkey, coalesce(r_name, '') AS r_name FROM part LEFT JOIN region ON p_size % 8 = r_regionkey""")
def dictionary_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A value by number, the empty string where there is none."""
    rows = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") % 8).alias("key"))
    return relations.looked_up(rows, "key", table(spark, sf_dir, "region"), "r_regionkey", "r_name").select("p_partkey", "r_name")


@query("""SELECT conv_id, turn, CAST(20 + coalesce(sum(octet_length(encode(text))) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset" FROM conversations""")
def blob_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").withColumn("size", F.octet_length("text"))
    return relations.offsets(rows, ["conv_id"], ["turn"], "size", start=20).select("conv_id", "turn", "offset")


@query("""WITH o AS (SELECT conv_id, turn, CAST(coalesce(sum(octet_length(encode(text)) + 1) OVER w, 0) AS BIGINT) AS off,
  CAST(sum(octet_length(encode(text)) + 1) OVER (PARTITION BY conv_id) AS BIGINT) AS fin FROM conversations
  WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
 SELECT conv_id, turn, greatest(lead(off, 1, fin) OVER (PARTITION BY conv_id ORDER BY turn) - off - 1, 0) AS extent FROM o""")
def value_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A value ends where the next begins."""
    rows = table(spark, sf_dir, "conversations").withColumn("size", X.stored_length(F.col("text")).cast("long"))
    rows = relations.offsets(rows, ["conv_id"], ["turn"], "size").withColumn("fin", F.sum("size").over(Window.partitionBy("conv_id")))
    return relations.extents(rows, ["conv_id"], ["turn"], "offset", F.col("fin"), gap=1).select("conv_id", "turn", "extent")


@query("""WITH a AS (SELECT conv_id, turn AS u_turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS slot FROM conversations WHERE role = 'user'),
 b AS (SELECT conv_id, turn AS a_turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS slot FROM conversations WHERE role <> 'user')
 SELECT conv_id, slot, u_turn, a_turn FROM a FULL JOIN b USING (conv_id, slot)""")
def slot_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    left = rows.where("role = 'user'").select("conv_id", F.col("turn").alias("u_turn"))
    right = rows.where("role <> 'user'").select("conv_id", F.col("turn").alias("a_turn"))
    return relations.paired_by_position(left, right, ["conv_id"], ["u_turn"], ["a_turn"])


@query("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM documents)
 SELECT doc_id, CAST(line_no AS BIGINT) AS line_no, last_value(CASE WHEN regexp_matches(line, '^[A-E]') THEN left(line, 12) END IGNORE NULLS)
 OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS section FROM l""")
def carry_section(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = document_lines(table(spark, sf_dir, "documents"))
    rows = rows.withColumn("head", F.when(F.col("line").rlike("^[A-E]"), F.left("line", F.lit(12))))
    return relations.carried(rows, ["doc_id"], ["line_no"], "head").select("doc_id", "line_no", "section")


def document_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, line_no, line), numbered from 1."""
    return docs.select("doc_id", F.posexplode(X.lines(F.col("text"))).alias("pos", "line")).select("doc_id", (F.col("pos") + 1).cast("long").alias("line_no"), "line")


@query("""SELECT doc_id, pos, CAST(CASE WHEN pos > 0 THEN length(left(text, pos - 1)) - length(replace(left(text, pos - 1), chr(10), '')) + 1 ELSE 0 END AS BIGINT) AS line_no
 FROM (SELECT doc_id, text, CAST(strpos(lower(text), 'the ') AS BIGINT) AS pos FROM documents)""")
def line_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").withColumn("pos", F.locate("the ", F.lower("text")))
    line = F.when(F.col("pos") > 0, X.line_of(F.col("text"), F.col("pos"))).otherwise(0)
    return rows.select("doc_id", F.col("pos").cast("long").alias("pos"), line.cast("long").alias("line_no"))


@query("""WITH l AS (SELECT doc_id // 2 AS pair, doc_id % 2 AS side, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM documents),
 a AS (SELECT * FROM l WHERE side = 0), b AS (SELECT * FROM l WHERE side = 1)
 SELECT coalesce(a.pair, b.pair) AS pair, CAST(coalesce(a.line_no, b.line_no) AS BIGINT) AS line_no, a.line AS left_line, b.line AS right_line
 FROM a FULL JOIN b ON a.pair = b.pair AND a.line_no = b.line_no WHERE a.line IS DISTINCT FROM b.line""")
def line_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = document_lines(table(spark, sf_dir, "documents")).withColumn("pair", F.floor(F.col("doc_id") / 2))
    sides = [rows.where(F.col("doc_id") % 2 == i).select("pair", "line_no", "line") for i in (0, 1)]
    return relations.line_differences(*sides, ["pair"])


@query("""WITH p AS (SELECT a.doc_id // 2 AS pair, regexp_extract_all(hex(encode(a.text)), '..') AS x, regexp_extract_all(hex(encode(b.text)), '..') AS y FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 1 WHERE a.doc_id % 2 = 0),
 d AS (SELECT pair, list_slice(list_filter(range(least(len(x), len(y))), lambda i: x[i + 1] <> y[i + 1]), 1, 10) AS places, x, y FROM p),
 e AS (SELECT pair, x, y, unnest(places) AS pos FROM d)
 SELECT pair, CAST(pos AS INTEGER) AS pos, CAST('0x' || x[pos + 1] AS BIGINT) AS left_byte, CAST('0x' || y[pos + 1] AS BIGINT) AS right_byte FROM e""")
def byte_diff_topn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first ten differing bytes of pairs of blobs."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.floor(F.col("doc_id") / 2).alias("pair"), F.col("text").cast("binary").alias("data"))
    left, right = (docs.where(F.col("doc_id") % 2 == i).select("pair", F.col("data").alias(c)) for i, c in enumerate("ab"))
    return relations.byte_differences(left.join(right, "pair"), ["pair"], "a", "b", limit=10)


@query("""WITH h AS (SELECT doc_id, hex(encode(text)) AS x FROM documents),
 b AS (SELECT doc_id, list_transform(regexp_extract_all(x, '..'), lambda y: CAST('0x' || y AS BIGINT)) AS bytes FROM h),
 t AS (SELECT list(v ORDER BY k) AS crcs FROM (SELECT k, list_reduce([k * 16777216, 1, 2, 3, 4, 5, 6, 7, 8], lambda v, i: CASE WHEN v >= 2147483648 THEN xor((v * 2) % 4294967296, 79764919) ELSE v * 2 END) AS v FROM (SELECT unnest(range(256)) AS k)))
 SELECT doc_id, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), bytes), lambda c, y: xor((c * 256) % 4294967296, crcs[xor(c // 16777216, y) + 1])), 4294967295) AS crc FROM b, t""")
def crc32_msb(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The archive checksum of each text's bytes."""
    return table(spark, sf_dir, "documents").select("doc_id", blobs.crc32_msb_fast(F.col("text").cast("binary")).alias("crc"))


@query("""WITH b AS (SELECT doc_id, list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda y: CAST('0x' || y AS BIGINT)) AS bytes FROM documents),
 n AS (SELECT doc_id, bytes, len(bytes) AS n FROM b)
 SELECT doc_id, CAST((((n + coalesce(list_sum(list_transform(bytes, lambda y, i: y * (n - i + 1))), 0)) % 65521) * 65536 + (1 + coalesce(list_sum(bytes), 0)) % 65521) AS BIGINT) AS adler FROM n""")
def adler32(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Adler-32 of each text's bytes."""
    return table(spark, sf_dir, "documents").select("doc_id", blobs.adler32_fast(F.col("text").cast("binary")).alias("adler"))


@query("""WITH e AS (SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'f' || (page_id // 3) || '.pak' WHEN 1 THEN 'F' || (page_id // 3 + page_id % 2) || '.PAL' ELSE 'x.txt' END AS name FROM pages),
 s AS (SELECT regexp_replace(upper(name), '\\.[^.]*$', '') AS stem, page_id AS side_page_id FROM e WHERE ends_with(upper(name), '.PAL'))
 SELECT page_id, name, side_page_id FROM e LEFT JOIN s ON stem = regexp_replace(upper(name), '\\.[^.]*$', '') WHERE ends_with(upper(name), '.PAK')""")
def sidecar_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The palette beside each pack."""
    third = F.floor(F.col("page_id") / 3)
    name = (
        F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("f"), third.cast("string"), F.lit(".pak")))
        .when(F.col("page_id") % 3 == 1, F.concat(F.lit("F"), (third + F.col("page_id") % 2).cast("string"), F.lit(".PAL"))).otherwise("x.txt")
    )
    return relations.sidecars(table(spark, sf_dir, "pages").select("page_id", name.alias("name")), "name", ".pak", ".pal", ["page_id"])


@query("""SELECT doc_id, CAST(CASE WHEN strpos(substr(lower(text), 501), 'the') > 0 THEN strpos(substr(lower(text), 501), 'the') + 500 ELSE strpos(lower(text), 'the') END AS BIGINT) AS at FROM documents WHERE lang = 'en'""")
def text_find_wrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").where("lang = 'en'").select("doc_id", X.find_wrapped(F.col("text"), "The", F.lit(501)).cast("long").alias("at"))


TOKEN_SQL = """CASE WHEN regexp_full_match(t, '".*"') THEN 'string' WHEN starts_with(t, '//') THEN 'comment'
 WHEN regexp_full_match(t, '[+-]?([0-9]+\\.[0-9]*|\\.[0-9]+|[0-9]+)([eE][+-]?[0-9]+)?') AND regexp_matches(t, '[.eE]') THEN 'float'
 WHEN regexp_full_match(t, 'NaN|-?Infinity') THEN 'float' WHEN regexp_full_match(t, '[+-]?[0-9]+') THEN 'int' ELSE 'error' END"""


@query(f"""SELECT event_id, t AS token, {TOKEN_SQL} AS kind FROM (SELECT event_id, trim(unnest(regexp_extract_all(trim(props, '{{}}'), '("[^"]*"|[^,:]+)'))) AS t FROM events
 UNION ALL SELECT event_id, CAST(value AS DECIMAL(18, 3)) :: VARCHAR FROM events)""")
def tokenise_kv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The values in event properties and their kinds."""
    events = table(spark, sf_dir, "events")
    tokens = F.regexp_extract_all(F.btrim("props", F.lit("{}")), F.lit('("[^"]*"|[^,:]+)'), F.lit(1))
    rows = events.select("event_id", F.explode(tokens).alias("token")).select("event_id", F.trim("token").alias("token"))
    rows = rows.unionAll(events.select("event_id", F.col("value").cast("decimal(18,3)").cast("string")))
    return rows.withColumn("kind", X.token_kind(F.col("token")))


@query("""SELECT doc_id, list_transform(regexp_extract_all(replace(text, chr(10), ','), '("(\\\\.|[^"\\\\])*"|[^,]+)'), lambda v: trim(v)) AS tokens FROM documents""")
def value_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", X.value_tokens(F.replace("text", F.lit("\n"), F.lit(","))).alias("tokens"))


@query("""SELECT o_orderkey, '{"key":' || o_orderkey || ',"status":"' || o_orderstatus || '","priority":"' || o_orderpriority || '"}' AS json, o_orderpriority AS parsed FROM orders""")
def json_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects written with their properties in a fixed order, and read back."""
    doc = F.to_json(F.struct(F.col("o_orderkey").alias("key"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority")))
    return table(spark, sf_dir, "orders").select("o_orderkey", doc.alias("json"), F.from_json(doc, "key long, status string, priority string")["priority"].alias("parsed"))


@query("""SELECT event_id, '{' || CASE WHEN value > 50 THEN '"value":' || event_id || ',' ELSE '' END || '"kind":"' || event_type || '"}' AS json FROM events""")
def json_exclude(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A property left out where a rule excludes it."""
    return table(spark, sf_dir, "events").select("event_id", F.to_json(F.struct(
        F.when(F.col("value") > 50, F.col("event_id")).alias("value"), F.col("event_type").alias("kind"))).alias("json"))


@query("""SELECT doc_id, rtrim(regexp_replace(hex(encode(text)), '(..)', '\\1 ', 'g')) AS dump FROM documents""")
def hex_dump(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", B.hex_dump(F.col("text").cast("binary")).alias("dump"))


LE_SQL = "(CAST('0x' || substr(h, 1, 2) AS BIGINT) + CAST('0x' || substr(h, 3, 2) AS BIGINT) * 256 + CAST('0x' || substr(h, 5, 2) AS BIGINT) * 65536 + CAST('0x' || substr(h, 7, 2) AS BIGINT) * 16777216)"


@query(f"""SELECT doc_id, {LE_SQL} AS u32, CASE WHEN {LE_SQL} >= 2147483648 THEN {LE_SQL} - 4294967296 ELSE {LE_SQL} END AS i32, CAST('0x' || h AS BIGINT) AS swapped,
 ({LE_SQL} * 2048) % 4294967296 + {LE_SQL} // 2097152 AS rotated FROM (SELECT doc_id, hex(encode(text))[1:8] AS h FROM documents WHERE octet_length(encode(text)) >= 4)""")
def le_u32(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = F.col("text").cast("binary")
    raw = B.unsigned_le(data, 0, 4)
    return table(spark, sf_dir, "documents").where(F.octet_length("text") >= 4).select(
        "doc_id", raw.alias("u32"), B.signed_le(data, 0, 4).alias("i32"), B.swap32(raw).alias("swapped"), B.rotate_left(raw, 11).alias("rotated"))


@query("""SELECT o_orderkey, (o_orderkey & 4) <> 0 AS is_set, o_orderkey | 8 AS with_bit, xor(o_orderkey, 2) AS toggled, (o_orderkey + 15) // 16 * 16 AS aligned FROM orders""")
def bit_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select("o_orderkey", B.bit_is_set(key, 2).alias("is_set"), B.with_bit(key, 3).alias("with_bit"), B.toggled(key, 1).alias("toggled"), B.aligned(key, 16).alias("aligned"))


@query("SELECT p_partkey, p_size * 5 * 0.299 + (p_partkey % 256) * 0.587 + 90 * 0.114 > 128 AS light FROM part")
def light_colour(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", B.is_light(F.col("p_size") * 5, F.col("p_partkey") % 256, F.lit(90)).alias("light"))


@query("""SELECT o_orderkey, greatest(0, least(CAST(epoch(o_orderdate) AS BIGINT) - 820454400, 4294967295)) AS stamp, make_timestamp(greatest(0, least(CAST(epoch(o_orderdate) AS BIGINT), 4294967295)) * 1000000) AS utc,
 strftime(o_orderdate, '%Y/%m/%d %I:%M %p') AS shown FROM orders""")
def epoch_clamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seconds since 1970 within 32 bits, back as a time, and as shown."""
    seconds = F.unix_seconds(F.col("o_orderdate").cast("timestamp"))

    def clamp(c):  # noqa: ANN001, ANN202
        return F.greatest(F.lit(0).cast("long"), F.least(c, F.lit(0xFFFFFFFF)))

    return table(spark, sf_dir, "orders").select(
        "o_orderkey", clamp(seconds - 820454400).alias("stamp"), F.timestamp_seconds(clamp(seconds)).cast("timestamp_ntz").alias("utc"), F.date_format("o_orderdate", "yyyy/MM/dd hh:mm a").alias("shown"))


@query("""WITH f AS (SELECT doc_id, n_chars * 1000 AS size FROM documents), c AS (SELECT doc_id, size, h, w, size - h * w * 256 * 4 AS prefix FROM f, (SELECT unnest([768, 512, 256]) AS h) x, (SELECT unnest(range(1, 17)) AS w) y),
 g AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY prefix, h DESC, w) AS r FROM c WHERE prefix >= 8)
 SELECT doc_id, CAST(h AS INTEGER) AS height, CAST(w AS INTEGER) AS pages, prefix FROM g WHERE r = 1""")
def atlas_argmin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The font atlas that leaves the shortest prefix, of 48 shapes; ties to the highest, then the fewest pages."""
    size = F.col("n_chars") * 1000
    shapes = [F.struct((size - h * w * 1024).alias("prefix"), F.lit(-h).alias("low"), F.lit(w).alias("pages")) for h in (768, 512, 256) for w in range(1, 17)]
    best = F.array_min(F.filter(F.array(*shapes), lambda s: s["prefix"] >= 8))
    rows = table(spark, sf_dir, "documents").select("doc_id", best.alias("b")).where("b is not null")
    return rows.select("doc_id", (-F.col("b.low")).alias("height"), "b.pages", "b.prefix")


@query("""SELECT doc_id, CASE WHEN lang = 'en' THEN 'text' WHEN lang = 'fr' THEN 'image' WHEN lang = 'de' THEN 'audio' WHEN doc_id % 2 = 0 THEN 'image' ELSE 'archive' END AS class FROM documents""")
def content_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.create_map(*[F.lit(x) for x in ("en", "SCR", "fr", "PCX", "de", "WAV", "es", "BFC")])[F.col("lang")]
    return table(spark, sf_dir, "documents").select("doc_id", listing.content_class(kind, F.when(F.col("doc_id") % 2 == 0, ".dds").otherwise(".xyz")).alias("class"))


@query("""SELECT source, CAST(count(*) AS BIGINT) AS n_values, CAST(sum(octet_length(encode(text)) + 1) AS BIGINT) AS n_bytes FROM documents GROUP BY ROLLUP (source)""")
def nested_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values and bytes of each group and of all."""
    return table(spark, sf_dir, "documents").rollup("source").agg(F.count("*").alias("n_values"), F.sum(X.stored_length(F.col("text")).cast("long")).alias("n_bytes"))


@query("""SELECT count(*) AS n_groups, count(*) FILTER (n > 0) AS n_with_keys, bool_or(n = 0) AS any_empty FROM
 (SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1)""")
def groups_with_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "orders"), F.col("o_custkey") == F.col("c_custkey"), "left")
    return rows.groupBy("c_custkey").agg(F.count("o_orderkey").alias("n")).agg(
        F.count("*").alias("n_groups"), F.count_if(F.col("n") > 0).alias("n_with_keys"), F.max(F.col("n") == 0).alias("any_empty"))


@query("""SELECT o_orderkey, a IS NULL OR b IS NULL OR a = b AS matches, CASE WHEN a IS NULL AND b IS NULL THEN 'N/A' WHEN a IS NULL OR b IS NULL OR a = b THEN printf('%08X', coalesce(b, a)) ELSE printf('%08X', b) || '*' END AS crc_str
 FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 4 <> 0 THEN o_orderkey * 7 END AS a, CASE WHEN o_orderkey % 6 <> 0 THEN o_orderkey * (7 + o_orderkey % 2) END AS b FROM orders)""")
def crc_display(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checksums compared, a missing one matching anything, and shown with a star where they differ."""
    key = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.when(key % 4 != 0, key * 7).alias("a"), F.when(key % 6 != 0, key * (7 + key % 2)).alias("b"))
    return rows.select("o_orderkey", X.checksums_match(F.col("a"), F.col("b")).alias("matches"), X.checksum_text(F.col("a"), F.col("b")).alias("crc_str"))


@query("SELECT p_partkey, p_name FROM part WHERE upper(p_name) = (SELECT upper(p_name) FROM part WHERE p_partkey = 77) ORDER BY p_partkey LIMIT 1")
def point_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first row of a name, without case."""
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    return listing.looked_for(part, "p_name", part.where("p_partkey = 77"), "p_partkey")


@query("""SELECT doc_id, CAST(row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS BIGINT) AS slot, source FROM documents WHERE lang IN ('fr', 'de')""")
def ordinal_among_survivors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place of each row among those a filter leaves."""
    rows = table(spark, sf_dir, "documents").where(F.col("lang").isin("fr", "de")).select("doc_id", "source")
    return relations.numbered(rows, ["source"], ["doc_id"])


@query("""SELECT conv_id, turn, CAST(octet_length(encode(text)) AS BIGINT) AS size FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn) <= 3""")
def first_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first three slots of each group."""
    rows = relations.numbered(table(spark, sf_dir, "conversations"), ["conv_id"], ["turn"])
    return rows.where("slot < 3").select("conv_id", "turn", F.octet_length("text").cast("long").alias("size"))


@query("""SELECT doc_id, regexp_replace(lower(text), '[^a-z0-9_]', '', 'g') AS group_name, regexp_replace(lower(text), '[^a-z0-9/_: ]', '', 'g') AS key_name,
 replace(text, '"', '\\"') AS quoted, rpad(left(source, 3), 8, '.') AS padded, regexp_replace(text, 'the', '#', 'gi') AS replaced FROM documents""")
def text_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    return table(spark, sf_dir, "documents").select(
        "doc_id", X.group_name(text).alias("group_name"), X.key_name(text).alias("key_name"), X.escape_quotes(text).alias("quoted"),
        F.rpad(F.left("source", F.lit(3)), 8, ".").alias("padded"), X.replace_ignoring_case(text, "the", "#").alias("replaced"))


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'R' THEN '<DEAD SPACE>' ELSE l_returnflag END = '<DEAD SPACE>' OR (l_linenumber & 1) <> 0 AS dead FROM lineitem""")
def dead_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.when(F.col("l_returnflag") == "R", F.lit("<dead space> ")).otherwise(F.col("l_returnflag"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", listing.is_dead(F.col("l_linenumber"), name).alias("dead"))


@query("""SELECT p_partkey, CASE WHEN length(c) <= 15 THEN c WHEN length(e) > 0 AND length(e) < 15 THEN left(c, 15 - length(e)) || e ELSE left(c, 15) END AS name FROM
 (SELECT p_partkey, c, regexp_extract(c, '\\.[^.]*$') AS e FROM (SELECT p_partkey, trim(regexp_replace(p_name || '/' || p_brand || '.pcx', '[^\\x20-\\x7e]|["<>|:*?\\\\/]', '_', 'g')) AS c FROM part))""")
def sanitize_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat("p_name", F.lit("/"), "p_brand", F.lit(".pcx"))
    return table(spark, sf_dir, "part").select("p_partkey", X.sanitize_name(name).alias("name"))


@query("""SELECT id, name, CASE WHEN hit THEN length(fresh) ELSE 4 END AS data_size, CASE WHEN hit THEN 'TXT' ELSE 'old' END AS file_type, CASE WHEN hit THEN 0 ELSE 77 END AS data_offset,
 CASE WHEN hit THEN 500 ELSE 1 END AS timestamp_s, CASE WHEN hit THEN fresh ELSE 'gone' END AS content FROM
 (SELECT s_suppkey AS id, s_name AS name, s_suppkey % 9 = 0 AS hit, 'new ' || s_suppkey AS fresh FROM supplier)""")
def replace_blob(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New bytes, and what follows from them: size, type, offset and time."""
    rows = table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.lit(4).cast("long").alias("data_size"), F.lit("old").alias("file_type"),
        F.lit(77).cast("long").alias("data_offset"), F.lit(1).cast("long").alias("timestamp_s"), F.lit("gone").cast("binary").alias("content"))
    new = rows.where("id % 9 = 0").select("id", F.concat(F.lit("new "), F.col("id").cast("string")).cast("binary").alias("content"), F.lit(500).alias("timestamp_s"))
    return changes.replaced(rows, new, "id").withColumn("content", F.col("content").cast("string"))


@query("""SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'n' || p_partkey ELSE p_name END AS name FROM part""")
def rename_trim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New names lose the white space at their ends."""
    part = table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("name"))
    new = part.where("p_partkey % 3 = 0").select("p_partkey", F.concat(F.lit(" \t n"), F.col("p_partkey").cast("string"), F.lit(" \u3000\r\n")).alias("new_name"))
    return changes.renamed(part, new, "p_partkey", X.name_status(F.col("new_name")))


@query("""WITH f AS (SELECT p_partkey AS seq, 'f' || (p_partkey % 50) || '.txt' AS name, repeat('x', CAST(p_size AS INT)) AS body FROM part WHERE p_partkey <= 120),
 n AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY seq DESC) AS back FROM f)
 SELECT 1 AS id, '<DEAD SPACE>' AS name, 1 AS dead_space_flags, 3 AS data_size, 7 AS timestamp_s UNION ALL SELECT 2, 'keep.txt', 0, 3, 7
 UNION ALL SELECT 2 + row_number() OVER (ORDER BY seq), CASE WHEN back = 1 THEN name ELSE '<DEAD SPACE>' END, CASE WHEN back = 1 THEN 0 ELSE 1 END, length(body), seq FROM n""")
def import_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files taken into a listing in their order; of one name the last stays alive."""
    entries = spark.createDataFrame([(1, "F7.TXT", 0, 3, 7, b"old"), (2, "keep.txt", 0, 3, 7, b"old")], "id long, name string, dead_space_flags long, data_size long, timestamp_s long, content binary")
    body = F.expr("repeat('x', p_size)").cast("binary")
    files = table(spark, sf_dir, "part").where("p_partkey <= 120").select(
        F.col("p_partkey").alias("seq"), F.concat(F.lit("f"), (F.col("p_partkey") % 50).cast("string"), F.lit(".txt")).alias("name"),
        F.octet_length(body).cast("long").alias("data_size"), F.col("p_partkey").alias("timestamp_s"), body.alias("content"))
    return changes.imported(entries, files, overwrite=True, order="seq").drop("content")


@query("""WITH f AS (SELECT p_partkey AS seq, lower(p_brand) || '.' || (p_partkey % 3) AS name, CAST(CASE WHEN p_partkey % 11 = 0 THEN 0 WHEN p_partkey % 13 = 0 THEN 3000000000 ELSE 10 END AS BIGINT) AS data_size FROM part),
 c AS (SELECT *, CASE WHEN data_size = 0 THEN 'Empty' WHEN data_size > 2147483647 THEN 'TooLarge' WHEN length(name) > 15 THEN 'TooLong' END AS bad FROM f)
 SELECT seq, name, data_size, coalesce(bad, CASE WHEN row_number() OVER (PARTITION BY name, bad IS NULL ORDER BY seq) > 1 THEN 'Exists' ELSE 'Ok' END) AS status FROM c""")
def import_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of files of one name the first that can come in does."""
    size = F.when(F.col("p_partkey") % 11 == 0, 0).when(F.col("p_partkey") % 13 == 0, F.lit(3_000_000_000)).otherwise(10).cast("long")
    files = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("seq"), F.concat(F.lower("p_brand"), F.lit("."), (F.col("p_partkey") % 3).cast("string")).alias("name"), size.alias("data_size"))
    return changes.import_status(files, files.where("seq < 0"), overwrite=False, order="seq")


@query("""SELECT conv_id, string_agg('"' || replace(role, '"', '\\"') || '"', ',' ORDER BY turn) AS line FROM conversations GROUP BY conv_id""")
def rows_to_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The slots of a group written as one line of quoted values, in order."""
    quoted = F.concat(F.lit('"'), X.escape_quotes(F.col("role")), F.lit('"'))
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", quoted.alias("v")))).alias("vs"))
    return rows.select("conv_id", F.array_join(F.transform("vs", lambda s: s["v"]), ",").alias("line"))


@query("""WITH b AS (SELECT doc_id, regexp_extract_all(hex(encode(text)), '..') AS b FROM documents),
 p AS (SELECT doc_id, list_filter(range(0, len(b) - 1), lambda i: b[i + 1] = '74' AND b[i + 2] = '68') AS places FROM b)
 SELECT doc_id, places, coalesce(list_min(list_filter(places, lambda i: i >= 40)), -1) AS first_after FROM p""")
def find_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where two bytes stand."""
    rows = table(spark, sf_dir, "documents").select("doc_id", blobs.places_of(F.col("text").cast("binary"), F.lit(b"th")).alias("places"))
    first = F.coalesce(F.array_min(F.filter("places", lambda i: i >= 40)), F.lit(-1))
    return rows.select("doc_id", F.col("places").cast("array<bigint>").alias("places"), first.cast("long").alias("first_after"))


@query("""SELECT doc_id, array_to_string(list_reverse(regexp_extract_all(hex(encode(text)), '..')), '') AS reversed, right(hex(encode(text)), 64) AS tail,
 regexp_full_match(hex(encode(text)), '([2-6].|7[0-9A-E]|09|0A|0D)*') AS printable, starts_with(text, 'The') AS starts,
 left(hex(encode(text)) || repeat('00', 24), 48) AS padded FROM documents""")
def byte_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes turned round, the last ones, printable, compared, and padded or cut to a size."""
    data = F.col("text").cast("binary")
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.hex(B.reversed_bytes(data)).alias("reversed"), F.hex(B.tail(data, 32)).alias("tail"),
        B.is_printable(data).alias("printable"), B.starts_with(data, b"The").alias("starts"), F.hex(B.padded_or_cut(data, 24)).alias("padded"))


@query("""SELECT event_id, event_type AS key, regexp_replace(trim(user_id || ' '), '^$', '') AS value, user_id % 50 AS x, -(user_id % 7) AS y, event_type AS rest,
 CASE WHEN user_id % 2 = 0 THEN 'bad value' ELSE 'bad value ' || user_id END AS message, CAST(CASE WHEN user_id % 2 = 0 THEN user_id ELSE -1 END AS INTEGER) AS line FROM events""")
def line_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys and values, positions before texts, and line numbers in messages."""
    user, kind = F.col("user_id").cast("string"), F.col("event_type")
    line = F.concat(F.lit("  "), kind, F.lit("  = "), user, F.lit(" "))
    placed = F.concat(F.lit("[x="), (F.col("user_id") % 50).cast("string"), F.lit(",y="), (-(F.col("user_id") % 7)).cast("string"), F.lit("]"), kind)
    message = F.when(F.col("user_id") % 2 == 0, F.concat(F.lit("bad value ("), user, F.lit("): x"))).otherwise(F.concat(F.lit("bad value "), user))
    rows = table(spark, sf_dir, "events").select("event_id", X.key_value(line).alias("kv"), X.place(placed).alias("p"), X.json_error(message).alias("e"))
    return rows.select("event_id", "kv.key", "kv.value", F.col("p.x").cast("long").alias("x"), F.col("p.y").cast("long").alias("y"), F.col("p.text").alias("rest"), "e.message", "e.line")


@query("SELECT p_partkey, n_name, n_regionkey FROM part JOIN nation ON p_size % 25 = n_nationkey")
def registry_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A register that must hold every key."""
    rows = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") % 25).alias("key"))
    return relations.registered(rows, "key", table(spark, sf_dir, "nation"), "n_nationkey", ["n_name", "n_regionkey"]).drop("key")


@query("""WITH k AS (SELECT conv_id, turn, unnest(range(0, turn % 3 + 1)) AS value_no FROM conversations WHERE role = 'user'),
 s AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, value_no) - 1 AS slot FROM k),
 v AS (SELECT conv_id, turn AS value_turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS slot FROM conversations WHERE role <> 'user')
 SELECT conv_id, turn, CAST(value_no AS BIGINT) AS value_no, value_turn FROM s LEFT JOIN v USING (conv_id, slot)""")
def slot_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys with several places each, filled in order."""
    rows = table(spark, sf_dir, "conversations")
    keys = rows.where("role = 'user'").select("conv_id", "turn", (F.col("turn") % 3 + 1).cast("int").alias("n"))
    values = rows.where("role <> 'user'").select("conv_id", F.col("turn").alias("value_turn"))
    out = relations.expanded_slots(keys, values, ["conv_id"], ["turn"], "n", ["value_turn"])
    return out.select("conv_id", "turn", F.col("value_no").cast("long").alias("value_no"), "value_turn")


@query("""WITH f AS (SELECT p_partkey, p_name AS name, CASE WHEN p_size <= 5 THEN 'Empty' WHEN length(trim(p_name)) > 15 THEN 'TooLong'
 WHEN upper(p_name) IN (SELECT upper(p_name) FROM part WHERE p_partkey % 3 = 0) THEN 'Exists' END AS bad FROM part)
 SELECT p_partkey, name, coalesce(bad, CASE WHEN row_number() OVER (PARTITION BY upper(name), bad IS NULL ORDER BY p_partkey) > 1 THEN 'Exists' ELSE 'Ok' END) AS status FROM f""")
def import_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why each file cannot come in; a file of a name that came in before cannot."""
    part = table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("name"), (F.col("p_size") - 5).cast("long").alias("data_size"))
    small = part.where("p_partkey % 3 = 0").withColumn("data_size", F.lit(1).cast("long"))
    return changes.import_status(part, small, overwrite=False, order="p_partkey").select("p_partkey", "name", "status")


@query("""SELECT o_orderkey, '{' || chr(13) || chr(10) || '  "key": ' || o_orderkey || ',' || chr(13) || chr(10) || '  "text": "it''s & [' || o_orderpriority || ']"' || chr(13) || chr(10) || '}' AS shown FROM orders""")
def json_pretty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored JSON laid out over lines."""
    stored = F.concat(F.lit('{"key":'), F.col("o_orderkey").cast("string"), F.lit(r',"text":"it\u0027s \u0026 ['), F.col("o_orderpriority"), F.lit(']"}'))
    return table(spark, sf_dir, "orders").select("o_orderkey", J.pretty(stored).alias("shown"))


@query("""SELECT o_orderkey, '{' || CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE '"b":' || (o_orderkey % 3) || ',' END || CASE WHEN o_orderstatus = 'O' THEN '' ELSE '"a":"' || o_orderstatus || '",' END || '"z":1}' AS json FROM orders""")
def json_unless(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Zero and empty values left out, one property first."""
    rows = table(spark, sf_dir, "orders").select(
        "o_orderkey", J.unless(F.col("o_orderkey") % 3, zero=True).alias("b"), J.unless(F.when(F.col("o_orderstatus") == "O", "").otherwise(F.col("o_orderstatus")), empty=True).alias("a"),
        F.lit(1).alias("z"), J.unless(F.lit("never"), always=True).alias("y"))
    return rows.select("o_orderkey", F.to_json(J.ordered_object(["z", "y", "a", "b"], first=("b", "a"))).alias("json"))


@query("""SELECT doc_id, CASE WHEN regexp_matches(substr(hex(encode(text)), 1, 8192), '^(..)*?(0[0-8]|0B|0C|0E|0F|1[0-9]|1[B-F]|81|8D|8F|90|9D)') THEN [] ELSE ['TXT'] END AS types FROM documents""")
def valid_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every format whose check a blob passes; texts pass that of texts only."""
    return table(spark, sf_dir, "documents").select("doc_id", validators.valid_types(F.col("text").cast("binary")).alias("types"))


@query("""SELECT conv_id, turn, CASE WHEN turn % 4 = 1 THEN NULL ELSE text END AS body FROM conversations ORDER BY body NULLS FIRST, conv_id, turn""")
def nulls_first_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sort by one column, nulls as the least."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.when(F.col("turn") % 4 != 1, F.col("text")).alias("body"))
    return listing.ordered(rows, F.col("body"), key=F.struct("conv_id", "turn"))


@query("""SELECT c_custkey, 'PFF' || (c_nationkey % 4) || '-' || (32 + c_nationkey % 2 * 4) AS label, timezone('America/New_York', make_timestamptz(c_custkey * 86400000000)) AS local FROM customer""")
def version_and_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Layout labels, and seconds as local times."""
    return table(spark, sf_dir, "customer").select(
        "c_custkey", X.version_label(F.col("c_nationkey") % 4, 32 + F.col("c_nationkey") % 2 * 4).alias("label"),
        X.local_time(F.col("c_custkey") * 86400, "America/New_York").cast("timestamp_ntz").alias("local"))


# Archives and what is in them: made of the tables in the query itself, so that SQL knows what must come out.


def part_archives(spark: SparkSession, sf_dir: str, version: int = 3, record: int = 36) -> DataFrame:
    """(archive, content): an archive for each brand of part, an entry for each part, its name as content, some dead, some empty."""
    key = F.col("p_partkey")
    rows = table(spark, sf_dir, "part").select(
        F.col("p_brand").alias("archive"), key.alias("id"), F.when(key % 10 == 0, listing.DEAD_NAME).otherwise(F.concat(F.lit("p"), key.cast("string"), F.lit(".txt"))).alias("name"),
        F.when(key % 10 == 0, 1).otherwise(0).cast("long").alias("dead_space_flags"), (key * 100).alias("timestamp_s"),
        F.when(key % 7 == 0, F.lit("")).otherwise(F.col("p_name")).cast("binary").alias("content"))
    return archive.pack_archives(rows, version, record)


ENTRY_SQL = """WITH e AS (SELECT p_brand AS archive, p_partkey AS k, CASE WHEN p_partkey % 10 = 0 THEN '<DEAD SPACE>' ELSE 'p' || p_partkey || '.txt' END AS name,
 CASE WHEN p_partkey % 10 = 0 THEN 1 ELSE 0 END AS flags, CASE WHEN p_partkey % 7 = 0 THEN '' ELSE p_name END AS body FROM part),
 o AS (SELECT archive, CAST(row_number() OVER w - 1 AS BIGINT) AS id, name, flags, CAST(20 + sum(length(body)) OVER w - length(body) AS BIGINT) AS data_offset, length(body) AS data_size, k * 100 AS timestamp_s, body
 FROM e WINDOW w AS (PARTITION BY archive ORDER BY k))"""


@query(ENTRY_SQL + """ SELECT archive, id, name, flags AS dead_space_flags, data_offset, data_size, timestamp_s, true AS crc_fits, body AS content FROM o""")
def archive_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archives written and read again, entry by entry."""
    rows = archive.entries_of(part_archives(spark, sf_dir))
    return rows.select(
        "archive", "id", "name", "dead_space_flags", "data_offset", "data_size", "timestamp_s", X.checksums_match(F.col("crc_read"), F.col("crc_computed")).alias("crc_fits"),
        F.col("content").cast("string").alias("content"))


@query(ENTRY_SQL + """ SELECT archive, 4 AS version, 'PFF4' AS mark, count(*) AS entry_count, 32 AS record_length, CAST(20 + sum(data_size) AS BIGINT) AS table_offset, '00000000' AS ip, 'BSMT' AS signature FROM o GROUP BY archive""")
def archive_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headers and footers of archives of another layout."""
    rows = archive.headers_of(part_archives(spark, sf_dir, 4, 32))
    return rows.select(
        "archive", "version", F.col("version_bytes").cast("string").alias("mark"), "entry_count", "record_length", "table_offset", F.hex("ip").alias("ip"), F.col("signature").cast("string").alias("signature"))


@query(ENTRY_SQL + """ SELECT archive, CAST(row_number() OVER (PARTITION BY archive ORDER BY id) - 1 AS BIGINT) AS id, name, body AS content FROM o WHERE flags = 0 AND data_size > 0""")
def archive_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Saved again without dead and empty entries."""
    again = archive.pack_archives(archive.entries_of(part_archives(spark, sf_dir)), 2, 32, keep_dead=False)
    return archive.entries_of(again).select("archive", "id", "name", F.col("content").cast("string").alias("content"))


@query(ENTRY_SQL + f""" SELECT id, dead, name, {SIZE_SQL} AS size, strftime(make_timestamp(timestamp_s * 1000000), '%Y/%m/%d %I:%M %p') AS time, data_offset, n AS bytes FROM
 (SELECT id, flags = 1 AS dead, name, data_size AS n, timestamp_s, data_offset FROM o WHERE archive = 'Brand#11')""")
def listing_shown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The grid of an archive in its two forms."""
    rows = archive.entries_of(part_archives(spark, sf_dir).where("archive = 'Brand#11'"))
    plain = listing.shown(rows, size_in_bytes=True, epoch_times=True).select("id", F.col("size").alias("bytes"))
    return listing.shown(rows).drop("crc").join(plain, "id")


@query(ENTRY_SQL + """ SELECT archive, name FROM o WHERE flags = 0 AND data_size > 0 AND timestamp_s % 300 = 0""")
def export_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an export of chosen live rows writes, names that are there left out."""
    rows = archive.entries_of(part_archives(spark, sf_dir))
    chosen = listing.targets(rows.withColumn("key", F.concat("archive", F.lit("/"), "id")), listing.is_dead(F.col("dead_space_flags"), F.col("name")))
    there = chosen.where("timestamp_s % 300 <> 0").select(F.upper("name").alias("name"))
    planned = archive.export_plan(chosen, there)
    return planned.join(chosen.select("archive", "name", "timestamp_s"), ["name", "timestamp_s"]).select("archive", "name")


@query("""SELECT 'new/' || i AS archive, v AS version, r AS record_length, 0 AS entry_count FROM (VALUES (1, 3, 32), (2, 3, 36), (3, 4, 36), (4, 0, 32)) t(i, v, r)""")
def new_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archives without entries in the layouts of some games."""
    wanted = [("new/1", "Delta Force"), ("new/2", "Comanche 4"), ("new/3", "Delta Force: Xtreme 2"), ("new/4", "F-22 Raptor")]
    rows = archive.headers_of(archive.new_archives(spark.createDataFrame(wanted, "archive string, game string")))
    return rows.select("archive", "version", F.col("record_length").cast("int").alias("record_length"), F.col("entry_count").cast("int").alias("entry_count"))


@query("""SELECT n_brand AS doc, g AS group_no, section, CAST(key_no AS INT) AS key_no, key, value_no, value_type, value FROM (
 SELECT p_brand AS n_brand, CAST(dense_rank() OVER (PARTITION BY p_brand ORDER BY p_size) - 1 AS INT) AS g, 's' || p_size AS section,
  dense_rank() OVER (PARTITION BY p_brand, p_size ORDER BY p_partkey) - 1 AS key_no, 'k' || p_partkey AS key, v.value_no, v.value_type,
  CASE v.value_no WHEN 0 THEN CAST(-p_partkey AS VARCHAR) WHEN 1 THEN p_name ELSE (p_partkey % 8) || '.5' END AS value
 FROM part, (VALUES (0, 1), (1, 4), (2, 2)) v(value_no, value_type))""")
def cbin_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Settings packed from rows, encrypted, and read as rows again."""
    return settings_files(spark, sf_dir).lateralJoin(blobs.CbinRows(F.col("content").outer())).drop("content", "doc_key")


def settings_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc, content): a settings file for each brand, a section for each size, a key for each part."""
    part = table(spark, sf_dir, "part")
    rank = F.dense_rank().over(Window.partitionBy("p_brand").orderBy("p_size")) - 1
    rows = relations.numbered(part.withColumn("group_no", rank), ["p_brand", "p_size"], ["p_partkey"], "key_no")
    values = F.array(
        F.struct(F.lit(0).alias("value_no"), F.lit(1).alias("value_type"), (-F.col("p_partkey")).cast("string").alias("value")),
        F.struct(F.lit(1).alias("value_no"), F.lit(4).alias("value_type"), F.col("p_name").alias("value")),
        F.struct(F.lit(2).alias("value_no"), F.lit(2).alias("value_type"), F.concat((F.col("p_partkey") % 8).cast("string"), F.lit(".5")).alias("value")))
    rows = rows.select(
        F.col("p_brand").alias("doc"), "group_no", F.concat(F.lit("s"), F.col("p_size").cast("string")).alias("section"), F.col("key_no").cast("int").alias("key_no"),
        F.concat(F.lit("k"), F.col("p_partkey").cast("string")).alias("key"), F.lit(0x01E177CE).cast("long").alias("doc_key"), F.explode(values).alias("v"))
    return blobs.pack_cbin(rows.select("*", "v.*").drop("v"))


@query("""SELECT p_brand AS doc, '// KEY:0x01E177CE' || chr(13) || chr(10) || string_agg(block, '' ORDER BY p_size) AS text FROM (
 SELECT p_brand, p_size, chr(13) || chr(10) || '[s' || p_size || ']' || chr(13) || chr(10) || string_agg('k' || p_partkey || ' = ' || -p_partkey || ',"' || p_name || '",' || (p_partkey % 8) || '.5' || chr(13) || chr(10), '' ORDER BY p_partkey) AS block
 FROM part GROUP BY 1, 2) GROUP BY 1""")
def cbin_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Settings as text, put back into bytes, and as text once more."""
    kind, form = F.lit("CBIN"), F.lit("INI")
    once = settings_files(spark, sf_dir).select("doc", blobs.to_text("content", kind, form)["text"].alias("text"))
    return once.select("doc", blobs.to_text(blobs.from_text("text", kind, form)["content"], kind, form)["text"].alias("text"))


@query("""SELECT conv_id AS doc, 0 AS group_no, 'talk' AS section, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INT) AS entry_no, role || turn AS key,
 CASE WHEN turn % 5 = 0 THEN '' ELSE role END AS value, CAST(turn AS INT) AS x, CAST(-turn AS INT) AS y FROM conversations""")
def rtxt_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text tables packed from rows and read as rows again."""
    rows = relations.numbered(table(spark, sf_dir, "conversations"), ["conv_id"], ["turn"], "entry_no").select(
        F.col("conv_id").alias("doc"), F.lit(0).alias("group_no"), F.lit("talk").alias("section"), F.col("entry_no").cast("int").alias("entry_no"),
        F.concat("role", F.col("turn").cast("string")).alias("key"), F.when(F.col("turn") % 5 == 0, "").otherwise(F.col("role")).alias("value"),
        F.col("turn").cast("int").alias("x"), (-F.col("turn")).cast("int").alias("y"))
    return blobs.pack_rtxt(rows).lateralJoin(blobs.RtxtRows(F.col("content").outer())).drop("content")


@query("""SELECT doc_id, left(hex(b), 8) = '53435201' AS is_script, t AS text FROM (SELECT doc_id, encode('SCR' || chr(1)) AS b, regexp_replace(text, '[^\x09\x0a\x0d\x20-\x7e]', '?', 'g') AS t FROM documents WHERE text <> '')""")
def scr_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts encrypted as scripts and read again."""
    plain = F.regexp_replace("text", r"[^\x09\x0a\x0d\x20-\x7e]", "?")
    kind, form = F.lit("SCR"), F.lit("TXT")
    made = table(spark, sf_dir, "documents").where("text <> ''").select("doc_id", plain.alias("text"), blobs.from_text(X.with_key_comment(plain, F.lit(0x2A5A8EAD)), kind, form)["content"].alias("b"))
    # a script names its key in a comment on top, which is no part of the text
    shown = X.strip_key_comment(blobs.to_text("b", kind, form)["text"])
    return made.select("doc_id", blobs.has_magic(F.col("b"), "SCR").alias("is_script"), shown.alias("text"))


@query("""SELECT doc_id, 'TXT' AS kind, 'BFC' AS container, text FROM documents WHERE length(text) > 20
 AND NOT regexp_matches(substr(hex(encode(text)), 1, 8192), '^(..)*?(0[0-8]|0B|0C|0E|0F|1[0-9]|1[B-F]|81|8D|8F|90|9D)')""")
def bfc_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blobs packed, told as packed, and unpacked with the type of what is inside."""
    docs = table(spark, sf_dir, "documents").where("length(text) > 20").select("doc_id", blobs.bfc_pack(F.col("text").cast("binary")).alias("packed"))
    return blobs.unpacked(docs, "packed").where("kind = 'TXT'").select("doc_id", "kind", "container", F.col("packed").cast("string").alias("text"))


@query("""SELECT p_partkey, 1 AS channels, 8000 + p_size AS rate, hex(encode(p_name)) AS pcm, 'fmt ,data' AS chunks FROM (SELECT * FROM part WHERE length(p_name) % 2 = 0)""")
def wav_pcm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sounds of 16-bit samples, as chunks and as samples."""
    body = F.col("p_name").cast("binary")
    def le(value, size):  # noqa: ANN001, ANN202
        return F.concat(*(F.unhex(F.lpad(F.hex(F.shiftright(value.cast("long"), 8 * i).bitwiseAND(F.lit(255))), 2, "0")) for i in range(size)))

    n, rate = F.octet_length(body), F.col("p_size") + 8000
    data = F.concat(
        F.lit(b"RIFF"), le(n + 36, 4), F.lit(b"WAVEfmt "), le(F.lit(16), 4), le(F.lit(1), 2), le(F.lit(1), 2), le(rate, 4), le(rate * 2, 4), le(F.lit(2), 2), le(F.lit(16), 2), F.lit(b"data"), le(n, 4), body)
    files = table(spark, sf_dir, "part").where("length(p_name) % 2 = 0").select("p_partkey", data.alias("data"))
    names = files.lateralJoin(blobs.WavChunks(F.col("data").outer())).groupBy("p_partkey").agg(F.sort_array(F.collect_list(F.struct("chunk_no", "name"))).alias("c"))
    sound = files.select("p_partkey", blobs.to_pcm16("data").alias("s")).join(names, "p_partkey")
    return sound.select("p_partkey", "s.channels", "s.rate", F.hex("s.pcm").alias("pcm"), F.array_join(F.transform("c", lambda x: x["name"]), ",").alias("chunks"))


PIXEL_SQL = "repeat(printf('%02X%02X%02XFF', p_size, p_partkey % 256, (p_size * 3) % 256), 4)"


@query(f"""SELECT p_partkey, k AS kind, 2 AS width, 2 AS height, {PIXEL_SQL} AS bgra FROM part, (VALUES ('TGA'), ('PCX')) t(k)""")
def image_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pictures of one colour, read as pixels, written in another format, and read again."""
    def byte(value):  # noqa: ANN001, ANN202
        return F.unhex(F.lpad(F.hex(value.cast("long")), 2, "0"))

    pixel = F.concat(byte(F.col("p_size")), byte(F.col("p_partkey") % 256), byte(F.col("p_size") * 3 % 256), F.lit(b"\xff"))
    head = bytes([0, 0, 2, 0, 0, 0, 0, 0, 0, 0, 0, 0, 2, 0, 2, 0, 32, 8])
    part = blobs.spread(table(spark, sf_dir, "part").select("p_partkey", "p_size"), "p_partkey")
    files = part.select("p_partkey", F.concat(F.lit(head), pixel, pixel, pixel, pixel).alias("data"))
    first = files.select("p_partkey", blobs.detect_type(F.col("data")).alias("kind"), blobs.decode_image("data", F.lit("TGA")).alias("i"))
    again = first.withColumn("data", blobs.to_pcx("i.width", "i.height", "i.bgra"))
    again = again.withColumn("kind2", blobs.detect_type(F.col("data"))).withColumn("i2", blobs.decode_image("data", F.lit("PCX")))
    # both in one row, so that the first picture is decoded once
    both = again.select("p_partkey", F.explode(F.array(F.struct("kind", "i"), F.struct(F.col("kind2").alias("kind"), F.col("i2").alias("i")))).alias("p"))
    return both.select("p_partkey", "p.kind", "p.i.width", "p.i.height", F.hex("p.i.bgra").alias("bgra"))


@query("""SELECT * FROM (VALUES ('123456789', 'FC891918', '7DD1E6FD', '091E01DE'), ('Wikipedia', NULL, NULL, '11E60398')) t(data, crc, crc4, adler)""")
def crc_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Known answers of the three checksums."""
    rows = spark.createDataFrame([("123456789", True), ("Wikipedia", False)], "data string, known boolean")
    data, hexed = F.col("data").cast("binary"), lambda c: F.when(F.col("known"), F.format_string("%08X", c))
    return rows.select(
        "data", hexed(blobs.crc32_msb_fast(data)).alias("crc"), hexed(blobs.crc32_quarter(data)).alias("crc4"), F.format_string("%08X", blobs.adler32_fast(data)).alias("adler"))


TYPE_CASES = [
    ("BFC1....", None, "BFC"), ("3DPK....", "x.pak", "PAK"), ("RTXT....", "a.bin", "RTXT"), ("plain text", None, "TXT"), ("plain text", "x.raw", "Unknown"), ("3DI....", "x.3di", "Unknown"),
    ("3DI....", "x.dat", "TDI"), ("abc", "x.txt", "Unknown"), ("BMS ....", None, "BMS"), ("BM but only text", "b.bmp", "TXT"), ("none", "ITEMS.DEF", "SCR"), ("none", "items.def", "TXT"),
]


@query("SELECT * FROM (VALUES " + ", ".join(f"('{d}', {'NULL' if n is None else repr(n)}, '{k}')" for d, n, k in TYPE_CASES) + ") t(data, name, kind)")
def detect_type_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Types of blobs with and without a name."""
    rows = spark.createDataFrame([x[:2] for x in TYPE_CASES], "data string, name string")
    return rows.withColumn("kind", blobs.detect_type(F.col("data").cast("binary"), F.col("name")))


@query("""WITH l AS (SELECT doc_id // 2 AS pair, doc_id % 2 AS side, string_split(text, chr(10)) AS lines FROM documents),
 p AS (SELECT a.pair, a.lines AS a, b.lines AS b, len(a.lines) AS na, len(b.lines) AS nb FROM l a JOIN l b ON a.pair = b.pair AND a.side = 0 AND b.side = 1),
 d AS (SELECT *, list_slice(list_filter(range(1, least(na, nb) + 1), lambda i: a[i] <> b[i]), 1, 5) AS places FROM p)
 SELECT pair, 'line' AS kind, i AS line_no, a[i] AS left_line, b[i] AS right_line FROM (SELECT pair, a, b, unnest(places) AS i FROM d)
 UNION ALL SELECT pair, 'count', 0, CAST(na AS VARCHAR), CAST(nb AS VARCHAR) FROM d WHERE na <> nb
 UNION ALL SELECT pair, 'missing', least(na, nb) + 1, NULL, NULL FROM d WHERE na <> nb AND len(places) < 5
 UNION ALL SELECT pair, 'stopped', places[5], NULL, NULL FROM d WHERE len(places) = 5 AND places[5] < greatest(na, nb)""")
def line_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a report on the lines of pairs of texts says."""
    rows = document_lines(table(spark, sf_dir, "documents")).withColumn("pair", F.floor(F.col("doc_id") / 2))
    return relations.line_report(*(rows.where(F.col("doc_id") % 2 == i).select("pair", "line_no", "line") for i in (0, 1)), ["pair"])


@query("""WITH p AS (SELECT a.doc_id // 2 AS pair, regexp_extract_all(hex(encode(a.text)), '..') AS x, regexp_extract_all(hex(encode(b.text)), '..') AS y FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 1 WHERE a.doc_id % 2 = 0),
 d AS (SELECT pair, x, y, list_slice(list_filter(range(least(len(x), len(y))), lambda i: x[i + 1] <> y[i + 1]), 1, 10) AS places FROM p)
 SELECT pair, 'byte' AS kind, CAST(i AS INTEGER) AS pos, CAST('0x' || x[i + 1] AS BIGINT) AS left_value, CAST('0x' || y[i + 1] AS BIGINT) AS right_value FROM (SELECT pair, x, y, unnest(places) AS i FROM d)
 UNION ALL SELECT pair, 'size', -1, len(x), len(y) FROM d WHERE len(x) <> len(y) UNION ALL SELECT pair, 'stopped', places[10], NULL, NULL FROM d WHERE len(places) = 10""")
def byte_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a report on the bytes of pairs of texts says."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.floor(F.col("doc_id") / 2).alias("pair"), F.col("text").cast("binary").alias("data"))
    left, right = (docs.where(F.col("doc_id") % 2 == i).select("pair", F.col("data").alias(c)) for i, c in enumerate("ab"))
    return relations.byte_report(left.join(right, "pair"), ["pair"], "a", "b")


@query(f"""WITH h AS (SELECT doc_id, hex(encode(text))[1:16] AS g FROM documents WHERE octet_length(encode(text)) >= 8),
 w AS (SELECT doc_id, {LE_SQL.replace('h,', 'g[1:8],')} AS lo, {LE_SQL.replace('h,', 'g[9:16],')} AS hi FROM h)
 SELECT doc_id, CAST(CAST(hi AS HUGEINT) * 4294967296 + lo AS DECIMAL(20, 0)) AS u64,
 CAST(CAST(hi AS HUGEINT) * 4294967296 + lo - CASE WHEN hi >= 2147483648 THEN CAST(18446744073709551616 AS HUGEINT) ELSE 0 END AS BIGINT) AS i64,
 (CASE WHEN lo >= 2147483648 THEN -1.0 ELSE 1.0 END) * (1 + (lo % 8388608) / 8388608.0 :: DOUBLE) * pow(2.0, (lo // 8388608) % 256 - 127) AS f32 FROM w
 WHERE (lo // 8388608) % 256 BETWEEN 1 AND 254""")
def le_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Little-endian numbers of 64 bits, and floats that are neither tiny nor infinite."""
    data = F.col("text").cast("binary")
    exponent = F.shiftright(B.unsigned_le(data, 0, 4), 23).bitwiseAND(F.lit(0xFF))
    rows = table(spark, sf_dir, "documents").where(F.octet_length("text") >= 8).where(exponent.between(1, 254))
    return rows.select("doc_id", B.unsigned_le64(data, 0).alias("u64"), B.signed_le64(data, 0).alias("i64"), B.float_le(data, 0).alias("f32"))


@query("""SELECT conv_id, n >= 3 AS has_third, third FROM (SELECT conv_id, count(*) AS n, list(role ORDER BY turn)[3] AS third FROM conversations GROUP BY conv_id)""")
def array_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The third of each list, where there is one."""
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role"))).alias("l"))
    return rows.select("conv_id", X.at_index(F.transform("l", lambda x: x["role"]), F.lit(2)).alias("t")).select("conv_id", F.col("t.found").alias("has_third"), F.col("t.value").alias("third"))
