"""Registered queries of the library and their SQL.

The driver's tables make a star: parts are markers, orders papers, nations cell
types, market segments of a nation its subtypes, suppliers with a positive
balance tissues, priorities but the unspecified one diseases, line items
entries.  So tissue and disease may be missing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import documents as texts
from .functions import names
from .operators import compare, entries, genes, hierarchy
from .operators.load import load
from .plans import views
from .plans.listing import Listing, NameIndex
from .plans.star import Filters, Star, best_first, dealt
from .schema import LISTED
from .session import scratch

KEY = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice")
_ASKED = Filters(cell_type=("NATION_0", "NATION_1", "NATION_2", "NATION_3", "NATION_7"), marker="a%1")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def driver_star(spark: SparkSession, sf_dir: str, cited: bool = False) -> Star:
    """The star over the driver's tables; where a question needs citation counts they are counted from its entries."""
    t = {n: _table(spark, sf_dir, n) for n in ("lineitem", "orders", "customer", "part", "supplier", "nation")}
    buyers = t["customer"].select(F.col("c_custkey").alias("o_custkey"), "c_nationkey", "c_mktsegment")
    bought = t["orders"].select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey", "o_orderpriority").join(buyers, "o_custkey")
    size = t["lineitem"].count()
    sold = dealt(t["lineitem"], size, "l_orderkey").join(bought, "l_orderkey")
    rows = sold.select(
        *KEY,
        F.col("c_nationkey").alias("cell_type_id"),
        F.struct("c_nationkey", "c_mktsegment").alias("cell_subtype_id"),
        F.col("l_partkey").alias("marker_id"),
        F.col("l_suppkey").alias("tissue_id"),
        F.col("o_orderpriority").alias("disease_id"),
        F.col("l_orderkey").alias("paper_id"),
        F.col("l_returnflag").alias("marker_status"),
    )
    star = Star(
        entries=rows,
        markers=t["part"].select(F.col("p_partkey").alias("id"), F.concat_ws(" ", "p_name", "p_partkey").alias("symbol"), F.lit(0).cast("long").alias("citation_count")),
        cell_types=t["nation"].select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name")),
        cell_subtypes=F.broadcast(t["customer"].select(F.struct("c_nationkey", "c_mktsegment").alias("id"), F.col("c_mktsegment").alias("name"), F.col("c_nationkey").alias("cell_type_id")).distinct()),  # a few for each nation
        tissues=t["supplier"].where("s_acctbal > 0").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name")),
        diseases=F.broadcast(t["orders"].where("o_orderpriority != '4-NOT SPECIFIED'").select(F.col("o_orderpriority").alias("id"), F.col("o_orderpriority").alias("name")).distinct()),  # a few priorities
        papers=t["orders"].select(F.col("o_orderkey").alias("id"), F.col("o_custkey").cast("string").alias("pmid"), F.concat(F.lit("PMC"), "o_orderkey").alias("pmcid")),
        order=KEY,
    )
    return Star(**{**star.__dict__, "markers": star.refreshed_markers(), "size": size}) if cited else star


def _flat(df: DataFrame) -> DataFrame:
    """Lists as texts, for comparison with SQL."""
    return df.select([F.array_join(c, "|").alias(c) if t.startswith("array") else F.col(c) for c, t in df.dtypes])


def _entry_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as entries of documents: ``pmcid``, ``pos`` and five fields with nulls and repeats."""
    t = {n: _table(spark, sf_dir, n) for n in ("lineitem", "orders", "customer", "part", "nation")}
    buyers = t["customer"].join(t["nation"], F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "c_mktsegment", "n_name")
    bought = t["orders"].join(buyers, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_mktsegment", "n_name")  # before line items, which are the most rows
    sold = t["lineitem"].join(t["part"], F.col("l_partkey") == F.col("p_partkey")).join(bought, F.col("l_orderkey") == F.col("o_orderkey"))
    pos = F.concat_ws("-", *[F.lpad(F.col(c).cast("string"), 9, "0") for c in KEY[1:4]])
    return sold.select(F.col("c_mktsegment").alias("pmcid"), F.concat_ws("-", F.lpad(F.col("l_orderkey").cast("string"), 9, "0"), pos).alias("pos"), F.col("n_name").alias("cell_type"), F.when(F.col("p_size") % 3 != 0, F.substring("p_type", 1, 8)).alias("cell_subtype"), F.col("p_brand").alias("marker"), F.when(F.col("l_returnflag") != "N", F.col("l_returnflag")).alias("tissue"), F.col("l_linestatus").alias("disease"), "l_shipdate")


Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def _query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


_STAR = """WITH markers AS (SELECT p_partkey AS id, p_name || ' ' || p_partkey AS symbol,
    coalesce((SELECT count(DISTINCT l_orderkey) FROM lineitem WHERE l_partkey = p_partkey), 0) AS citation_count FROM part),
entries AS (
  SELECT l.*, n_name AS cell_type, c_mktsegment AS cell_subtype, m.symbol AS marker, m.citation_count, s_name AS tissue,
    nullif(o_orderpriority, '4-NOT SPECIFIED') AS disease, o_custkey::VARCHAR AS pmid, 'PMC' || o_orderkey AS pmcid, l_returnflag AS marker_status
  FROM lineitem l JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey
  JOIN markers m ON m.id = l_partkey LEFT JOIN (SELECT * FROM supplier WHERE s_acctbal > 0) ON s_suppkey = l_suppkey)
"""
_LISTED = "marker, cell_type, cell_subtype, tissue, disease, pmid, pmcid, marker_status"
_KEY = ", ".join(KEY)
_WHERE = "cell_type IN ('NATION_0', 'NATION_1', 'NATION_2', 'NATION_3', 'NATION_7') AND marker ILIKE '%a%1%'"
_BUBBLE = "(SELECT cell_type, marker, count(DISTINCT l_orderkey) AS count FROM entries GROUP BY 1, 2 ORDER BY count DESC, cell_type, marker LIMIT {n})"


@_query("search_page", f"{_STAR} SELECT {_LISTED} FROM entries WHERE {_WHERE} ORDER BY citation_count DESC, marker, cell_type, {_KEY} LIMIT 20 OFFSET 20")
def search_page(spark, sf_dir):
    return driver_star(spark, sf_dir, cited=True).search(_ASKED, page=2)


@_query("search_total", f"{_STAR} SELECT count(*) AS total FROM entries WHERE {_WHERE}")
def search_total(spark, sf_dir):
    return driver_star(spark, sf_dir).total(_ASKED)


@_query("search_unfiltered", f"{_STAR} SELECT {_LISTED} FROM entries ORDER BY citation_count DESC, marker, cell_type, {_KEY} LIMIT 200")
def search_unfiltered(spark, sf_dir):
    return driver_star(spark, sf_dir, cited=True).search(page_size=200)


@_query(
    "marker_ranking",
    f"""{_STAR}, top AS (SELECT marker, count(DISTINCT l_orderkey) AS citation_count, count(DISTINCT cell_type) AS cell_type_count
  FROM entries WHERE cell_type ILIKE '%a%' AND tissue ILIKE '%1%' GROUP BY marker ORDER BY 2 DESC, 1 LIMIT 50)
SELECT t.*, string_agg(DISTINCT cell_type, '|' ORDER BY cell_type) AS cell_types, coalesce(string_agg(DISTINCT tissue, '|' ORDER BY tissue), '') AS tissues,
  coalesce(string_agg(DISTINCT disease, '|' ORDER BY disease), '') AS diseases FROM top t JOIN entries e USING (marker) GROUP BY ALL""",
)
def marker_ranking(spark, sf_dir):
    return _flat(driver_star(spark, sf_dir).ranking(50, cell_type="a", tissue="1"))


@_query("listed_page", f"{_STAR} SELECT {_LISTED} FROM entries ORDER BY citation_count DESC, marker, cell_type, {_KEY} LIMIT 20 OFFSET (SELECT count(*) // 40 * 20 FROM lineitem)")
def listed_page(spark, sf_dir):
    """The page in the middle of all entries, from a listing; it reads the file where it lies."""
    listing = Listing.write(driver_star(spark, sf_dir, cited=True), scratch(spark))
    return listing.page(listing.total // 40 + 1)


@_query("listed_after", f"{_STAR} SELECT {_LISTED} FROM entries WHERE {_WHERE} ORDER BY citation_count DESC, marker, cell_type, {_KEY} LIMIT 40 OFFSET 100")
def listed_after(spark, sf_dir):
    """Pages one after the other, each after the last row of the one before."""
    listing = Listing.write(driver_star(spark, sf_dir, cited=True), scratch(spark))
    key = listing.after(None, _ASKED, 100).collect()[-1]
    return listing.after(key, _ASKED, 40).select(LISTED)


@_query("search_by_name_index", f"{_STAR} SELECT {_LISTED} FROM entries WHERE marker ILIKE '%olt%31%' AND cell_type IN ('NATION_0', 'NATION_1', 'NATION_2', 'NATION_3') ORDER BY citation_count DESC, marker, cell_type, {_KEY} LIMIT 200")
def search_by_name_index(spark, sf_dir):
    star = driver_star(spark, sf_dir, cited=True)
    asked = Filters(cell_type=("NATION_0", "NATION_1", "NATION_2", "NATION_3"), marker="Olt%31")
    return NameIndex.write(star, scratch(spark), ["marker"]).narrowed(star, {"marker": asked.marker}).search(asked, page_size=200)


def _symbol(spark: SparkSession, sf_dir: str) -> str:
    return _table(spark, sf_dir, "part").where("p_partkey = 7").select(F.concat_ws(" ", "p_name", "p_partkey")).first()[0]


@_query(
    "marker_detail",
    f"""{_STAR} SELECT marker, citation_count, count(*) AS total, string_agg(DISTINCT cell_type, '|' ORDER BY cell_type) AS cell_types,
  string_agg(DISTINCT cell_subtype, '|' ORDER BY cell_subtype) AS cell_subtypes, coalesce(string_agg(DISTINCT tissue, '|' ORDER BY tissue), '') AS tissues,
  coalesce(string_agg(DISTINCT disease, '|' ORDER BY disease), '') AS diseases FROM entries WHERE l_partkey = 7 GROUP BY 1, 2""",
)
def marker_detail(spark, sf_dir):
    return _flat(driver_star(spark, sf_dir, cited=True).detail(_symbol(spark, sf_dir)))


@_query("marker_detail_entries", f"{_STAR} SELECT {_LISTED} FROM entries WHERE l_partkey = 7 ORDER BY cell_type, pmcid, {_KEY} LIMIT 10 OFFSET 10")
def marker_detail_entries(spark, sf_dir):
    return driver_star(spark, sf_dir).detail_entries(_symbol(spark, sf_dir), page=2, page_size=10)


@_query(
    "cell_type_list",
    """SELECT n_name AS name, count(DISTINCT l_partkey) AS marker_count, count(l_partkey) AS entry_count,
  coalesce(string_agg(DISTINCT c_mktsegment, '|' ORDER BY c_mktsegment), '') AS subtypes
FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey LEFT JOIN orders ON o_custkey = c_custkey LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1""",
)
def cell_type_list(spark, sf_dir):
    return _flat(driver_star(spark, sf_dir).types())


@_query(
    "overview_counts",
    """SELECT (SELECT count(*) FROM orders) AS total_papers, (SELECT count(*) FROM part) AS total_markers, (SELECT count(*) FROM nation) AS total_cell_types,
  (SELECT count(DISTINCT o_orderpriority) FROM orders WHERE o_orderpriority <> '4-NOT SPECIFIED') AS total_diseases,
  (SELECT count(*) FROM supplier WHERE s_acctbal > 0) AS total_tissues, (SELECT count(*) FROM lineitem) AS total_entries""",
)
def overview_counts(spark, sf_dir):
    return driver_star(spark, sf_dir).overview()


def _distribution(field: str, limit: int) -> None:
    sql = f"{_STAR} SELECT {field} AS name, count(*) AS count FROM entries WHERE {field} IS NOT NULL AND {field} <> 'Not specified' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT {limit}"
    _query(f"top_{field}s", sql)(lambda spark, sf_dir: driver_star(spark, sf_dir).distribution(field))


for _field, _limit in (("cell_type", 15), ("disease", 30), ("tissue", 15)):
    _distribution(_field, _limit)


@_query(
    "facet_options",
    f"""{_STAR} SELECT 'cell_type' AS field, cell_type AS value FROM entries WHERE cell_subtype IN ('BUILDING') AND disease IN ('1-URGENT', '2-HIGH')
UNION SELECT 'cell_subtype', cell_subtype FROM entries WHERE cell_type IN ('NATION_4', 'NATION_5', 'NATION_1', 'NATION_2') AND disease IN ('1-URGENT', '2-HIGH')
UNION SELECT 'tissue', tissue FROM entries WHERE tissue IS NOT NULL AND cell_type IN ('NATION_4', 'NATION_5', 'NATION_1', 'NATION_2') AND cell_subtype IN ('BUILDING') AND disease IN ('1-URGENT', '2-HIGH')
UNION SELECT 'disease', disease FROM entries WHERE disease IS NOT NULL AND cell_type IN ('NATION_4', 'NATION_5', 'NATION_1', 'NATION_2') AND cell_subtype IN ('BUILDING')""",
)
def facet_options(spark, sf_dir):
    return driver_star(spark, sf_dir).facets(Filters(cell_type=("NATION_4", "NATION_5", "NATION_1", "NATION_2"), cell_subtype=("BUILDING",), disease=("1-URGENT", "2-HIGH")))


@_query(
    "facet_no_filter",
    """SELECT 'cell_type' AS field, n_name AS value FROM nation
UNION ALL SELECT 'cell_subtype', c_mktsegment FROM (SELECT DISTINCT c_nationkey, c_mktsegment FROM customer)
UNION ALL SELECT 'tissue', s_name FROM supplier WHERE s_acctbal > 0
UNION ALL SELECT DISTINCT 'disease', o_orderpriority FROM orders WHERE o_orderpriority <> '4-NOT SPECIFIED'""",
)
def facet_no_filter(spark, sf_dir):
    return driver_star(spark, sf_dir).facets()


@_query("bubble", f"{_STAR} SELECT * FROM {_BUBBLE.format(n=200)}")
def bubble(spark, sf_dir):
    return driver_star(spark, sf_dir).bubble()


@_query("bubble_filtered", f"{_STAR} SELECT cell_type, marker, count(DISTINCT l_orderkey) AS count FROM entries WHERE disease IN ('1-URGENT') AND tissue IS NOT NULL AND tissue IN (SELECT s_name FROM supplier WHERE s_suppkey < 20) GROUP BY 1, 2 ORDER BY count DESC, cell_type, marker LIMIT 500")
def bubble_filtered(spark, sf_dir):
    some = [r[0] for r in _table(spark, sf_dir, "supplier").where("s_suppkey < 20").select("s_name").collect()]
    return driver_star(spark, sf_dir).bubble(Filters(disease=("1-URGENT",), tissue=some), limit=500)


@_query("ranking_groups", f"{_STAR} SELECT cell_type, marker, count, row_number() OVER (PARTITION BY cell_type ORDER BY count DESC, marker) AS rank, count(*) OVER (PARTITION BY cell_type) AS group_size FROM {_BUBBLE.format(n=2000)}")
def ranking_groups(spark, sf_dir):
    return views.ranking_groups(driver_star(spark, sf_dir).bubble(limit=2000))


@_query(
    "ranking_page",
    f"""{_STAR}, grouped AS (SELECT cell_type, marker, count, row_number() OVER (PARTITION BY cell_type ORDER BY count DESC, marker) AS rank,
    count(*) OVER (PARTITION BY cell_type) AS group_size, row_number() OVER (ORDER BY count DESC, cell_type, marker) <= 200 AS in_bubble FROM {_BUBBLE.format(n=2000)})
SELECT cell_type, marker, count, rank, group_size, in_bubble FROM (
  SELECT *, sum(CASE WHEN in_bubble THEN 0 ELSE 1 END) OVER (ORDER BY group_size DESC, cell_type, rank ROWS UNBOUNDED PRECEDING) AS others FROM grouped)
WHERE in_bubble OR others <= 500""",
)
def ranking_page(spark, sf_dir):
    return views.ranking_page(driver_star(spark, sf_dir).bubble(limit=2000))


@_query("ranking_share", f"{_STAR} SELECT cell_type, marker, count, round(count * 100.0 / greatest(max(count) OVER (), 1), 6)::DOUBLE AS share FROM {_BUBBLE.format(n=200)}")
def ranking_share(spark, sf_dir):
    return views.shares(driver_star(spark, sf_dir).bubble()).withColumn("share", F.round("share", 6))


@_query(
    "bubble_points",
    f"""{_STAR}, b AS (SELECT *, row_number() OVER (PARTITION BY cell_type, count ORDER BY marker) - 1 AS i, count(*) OVER (PARTITION BY cell_type, count) AS n,
    greatest(0.06 * count, 0.4)::DOUBLE AS spread FROM {_BUBBLE.format(n=200)})
SELECT cell_type, marker, count, round((i - (n - 1) / 2.0) * (2 * spread / greatest(n - 1, 1)), 6)::DOUBLE AS offset_y,
  dense_rank() OVER (ORDER BY cell_type) - 1 AS x, round(greatest(6, sqrt(count / greatest(max(count) OVER (), 1)) * 45), 6)::DOUBLE AS size FROM b""",
)
def bubble_points(spark, sf_dir):
    points = views.sizes(views.jitter(driver_star(spark, sf_dir).bubble()))
    return points.select("cell_type", "marker", "count", F.round("offset", 6).alias("offset_y"), F.col("x").cast("long").alias("x"), F.round("size", 6).alias("size"))


@_query("pie_shares", f"{_STAR}, d AS (SELECT disease AS name, count(*) AS count FROM entries WHERE disease IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 30) SELECT name, count, round(count * 100.0 / sum(count) OVER (), 6)::DOUBLE AS percent, CASE WHEN length(name) > 20 THEN substr(name, 1, 18) || '…' ELSE name END AS label FROM d")
def pie_shares(spark, sf_dir):
    return views.pie_shares(driver_star(spark, sf_dir).distribution("disease")).withColumn("percent", F.round("percent", 6))


@_query("tissue_bars", f"{_STAR}, d AS (SELECT tissue AS name, count(*) AS count FROM entries WHERE tissue IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 15) SELECT name, count, (row_number() OVER (ORDER BY count, name DESC) - 1) % 15 AS colour FROM d")
def tissue_bars(spark, sf_dir):
    return views.bars(driver_star(spark, sf_dir).distribution("tissue")).withColumn("colour", F.col("colour").cast("long"))


@_query("group_counters", f"{_STAR} SELECT count(*) AS rows, count(DISTINCT cell_type) AS groups, greatest(max(count), 1) AS max_count FROM {_BUBBLE.format(n=2000)}")
def group_counters(spark, sf_dir):
    return views.group_counters(driver_star(spark, sf_dir).bubble(limit=2000))


@_query("export_rows", f"{_STAR} SELECT marker, cell_type, cell_subtype, coalesce(tissue, '') AS tissue, coalesce(disease, '') AS disease, pmid, pmcid, marker_status FROM entries WHERE {_WHERE} ORDER BY marker, {_KEY} LIMIT 50000")
def export_rows(spark, sf_dir):
    return driver_star(spark, sf_dir).export(_ASKED)


@_query("citation_refresh", f"{_STAR} SELECT id, symbol, citation_count FROM markers")
def citation_refresh(spark, sf_dir):
    return driver_star(spark, sf_dir, cited=True).markers.select("id", "symbol", "citation_count")


@_query("cited_markers", f"{_STAR} SELECT count(*) AS n FROM markers WHERE citation_count > 0")
def cited_markers(spark, sf_dir):
    return driver_star(spark, sf_dir, cited=True).markers.where("citation_count > 0").agg(F.count(F.lit(1)).alias("n"))


_ENTRIES = """WITH e AS (SELECT c_mktsegment AS pmcid, lpad(l_orderkey::VARCHAR, 9, '0') || '-' || lpad(l_partkey::VARCHAR, 9, '0') || '-' || lpad(l_suppkey::VARCHAR, 9, '0') || '-' || lpad(l_linenumber::VARCHAR, 9, '0') AS pos,
  n_name AS cell_type, CASE WHEN p_size % 3 <> 0 THEN substr(p_type, 1, 8) END AS cell_subtype, p_brand AS marker, nullif(l_returnflag, 'N') AS tissue, l_linestatus AS disease, l_shipdate
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey JOIN part ON p_partkey = l_partkey)
"""


@_query("dedup_first_wins", f"{_ENTRIES} SELECT pmcid, cell_type, cell_subtype, marker, tissue, disease, min(pos) AS pos FROM e GROUP BY ALL")
def dedup_first_wins(spark, sf_dir):
    return entries.first_entries(_entry_rows(spark, sf_dir)).drop("l_shipdate")


@_query("null_safe_dedup", f"{_ENTRIES}, old AS (SELECT DISTINCT pmcid, cell_type, cell_subtype, marker, tissue, disease FROM e WHERE l_shipdate < TIMESTAMP '1998-07-01'), new AS (SELECT DISTINCT pmcid, cell_type, cell_subtype, marker, tissue, disease FROM e WHERE l_shipdate >= TIMESTAMP '1998-07-01') SELECT n.cell_type, n.cell_subtype, n.tissue, count(*) AS added FROM new n LEFT JOIN old o ON n.pmcid = o.pmcid AND n.cell_type = o.cell_type AND n.cell_subtype IS NOT DISTINCT FROM o.cell_subtype AND n.marker = o.marker AND n.tissue IS NOT DISTINCT FROM o.tissue AND n.disease IS NOT DISTINCT FROM o.disease WHERE o.pmcid IS NULL GROUP BY ALL")
def null_safe_dedup(spark, sf_dir):
    """What a second load adds to the star of a first; nulls are equal in the six keys."""
    old, new = _halves(spark, sf_dir)
    papers = old.union(new).select("pmcid", F.lit(None).cast("string").alias("pmid"), F.lit("t").alias("title")).distinct()
    first = load(old, papers)
    second = load(new, papers, first)
    added = second.entries.join(first.entries.select("id"), "id", "left_anti")
    named = Star(**{**second.__dict__, "entries": added}).joined(["cell_type", "cell_subtype", "tissue"])
    return named.groupBy("cell_type", "cell_subtype", "tissue").agg(F.count(F.lit(1)).alias("added"))


def _halves(spark, sf_dir):
    """All entries, before a date and from it on."""
    rows = _entry_rows(spark, sf_dir)
    return rows.where("l_shipdate < timestamp'1998-07-01'"), rows.where("l_shipdate >= timestamp'1998-07-01'")


_PAIRS = f"""{_ENTRIES}, pairs AS (SELECT cell_type, cell_subtype, count(*) AS n, min((pmcid, pos)) AS first FROM e WHERE cell_subtype IS NOT NULL AND cell_type <> cell_subtype GROUP BY 1, 2)"""


@_query("parent_child_mode", f"{_PAIRS} SELECT cell_subtype AS child, cell_type AS parent, n AS count FROM pairs QUALIFY row_number() OVER (PARTITION BY cell_subtype ORDER BY n DESC, first) = 1")
def parent_child_mode(spark, sf_dir):
    return hierarchy.main_parents(_entry_rows(spark, sf_dir))


@_query("hierarchy_fixed", f"{_PAIRS}, s AS (SELECT * REPLACE (CASE WHEN marker < 'Brand#3' AND cell_subtype IS NOT NULL THEN cell_subtype ELSE cell_type END AS cell_type) FROM e), sp AS (SELECT cell_type, cell_subtype, count(*) AS n, min((pmcid, pos)) AS first FROM s WHERE cell_type <> cell_subtype GROUP BY 1, 2), best AS (SELECT cell_subtype AS child, cell_type AS parent FROM sp QUALIFY row_number() OVER (PARTITION BY cell_subtype ORDER BY n DESC, first) = 1), fixed AS (SELECT CASE WHEN cell_type = cell_subtype AND cell_type NOT IN (SELECT cell_type FROM sp) AND parent IS NOT NULL THEN parent ELSE cell_type END AS t, CASE WHEN cell_type = cell_subtype AND NOT (cell_type NOT IN (SELECT cell_type FROM sp) AND parent IS NOT NULL) THEN NULL ELSE cell_subtype END AS u FROM s LEFT JOIN best ON child = cell_type) SELECT t AS cell_type, u AS cell_subtype, count(*) AS n FROM fixed GROUP BY 1, 2")
def hierarchy_fixed(spark, sf_dir):
    rows = _entry_rows(spark, sf_dir).withColumn("cell_type", F.when((F.col("marker") < "Brand#3") & F.col("cell_subtype").isNotNull(), F.col("cell_subtype")).otherwise(F.col("cell_type")))
    return hierarchy.resolved(rows).groupBy("cell_type", "cell_subtype").agg(F.count(F.lit(1)).alias("n"))


_SIDES = f"""{_ENTRIES}, k AS (SELECT *, lower(cell_type) AS ct, upper(marker) AS g FROM e),
o AS (SELECT * FROM k WHERE l_shipdate < TIMESTAMP '1998-07-01' QUALIFY row_number() OVER (PARTITION BY pmcid, ct, g ORDER BY pos) = 1),
r AS (SELECT * FROM k WHERE l_shipdate >= TIMESTAMP '1998-07-01' QUALIFY row_number() OVER (PARTITION BY pmcid, ct, g ORDER BY pos) = 1),
b AS (SELECT coalesce(o.pmcid, r.pmcid) AS pmcid, o.g AS og, r.g AS rg, coalesce(o.tissue, '') = coalesce(r.tissue, '') AS ts, o.disease = r.disease AS ds, coalesce(lower(o.cell_subtype), '') = coalesce(lower(r.cell_subtype), '') AS ss FROM o FULL JOIN r ON o.pmcid = r.pmcid AND o.ct = r.ct AND o.g = r.g),
s AS (SELECT pmcid, count(og) AS original, count(rg) AS reference, count(*) FILTER (og IS NOT NULL AND rg IS NOT NULL) AS matched, count(*) FILTER (og IS NOT NULL AND rg IS NOT NULL AND ts) AS t, count(*) FILTER (og IS NOT NULL AND rg IS NOT NULL AND ds) AS d, count(*) FILTER (og IS NOT NULL AND rg IS NOT NULL AND ss) AS u, count(DISTINCT og) AS go, count(DISTINCT rg) AS gr FROM b GROUP BY 1),
j AS (SELECT pmcid, count(*) AS shared FROM (SELECT pmcid, og FROM b WHERE og IS NOT NULL INTERSECT SELECT pmcid, rg FROM b WHERE rg IS NOT NULL) GROUP BY 1)"""


@_query(
    "key_overlap",
    f"""{_SIDES} SELECT pmcid, original, reference, matched, round_even(matched / greatest(original, 1), 4) AS precision, round_even(matched / greatest(reference, 1), 4) AS recall,
  round_even(CASE WHEN matched = 0 THEN 0.0::DOUBLE ELSE 2 * (matched / original) * (matched / reference) / (matched / original + matched / reference) END, 4) AS f1,
  round_even(coalesce(shared, 0) / greatest(go, 1), 4) AS gene_precision, round_even(coalesce(shared, 0) / greatest(gr, 1), 4) AS gene_recall,
  round_even(t / greatest(matched, 1), 4) AS tissue_agreement, round_even(d / greatest(matched, 1), 4) AS disease_agreement, round_even(u / greatest(matched, 1), 4) AS cell_subtype_agreement
FROM s LEFT JOIN j USING (pmcid)""",
)
def key_overlap(spark, sf_dir):
    return compare.compared(*_halves(spark, sf_dir)).drop("only_in_original", "only_in_reference")


@_query("key_difference", f"{_SIDES} SELECT DISTINCT pmcid, ct, g FROM o EXCEPT SELECT DISTINCT pmcid, ct, g FROM r")
def key_difference(spark, sf_dir):
    """Keys of all entries before a date that none from it on has, by the operator's own comparison of keys."""
    old, new = (compare.keyed(df).select("pmcid", F.col("key.cell_type").alias("ct"), F.col("key.marker").alias("g")) for df in _halves(spark, sf_dir))
    return old.join(new, ["pmcid", "ct", "g"], "left_anti")


@_query(
    "gene_standard",
    """WITH a AS (SELECT DISTINCT p_brand AS symbol, upper(p_brand) AS key FROM part WHERE p_size > 25), x AS (SELECT DISTINCT p_brand AS symbol, upper(unnest(string_split(p_type || '|' || p_name, '|'))) AS key FROM part WHERE p_size > 25),
y AS (SELECT key, count(DISTINCT symbol) AS owners, min(symbol) AS owner FROM x GROUP BY 1), e AS (SELECT p_brand AS marker FROM part UNION ALL SELECT lower(p_type) FROM part UNION ALL SELECT p_name FROM part)
SELECT CASE WHEN symbol IS NOT NULL THEN 'approved' WHEN owners = 1 THEN 'corrected' WHEN owners > 1 THEN 'ambiguous' ELSE 'unknown' END AS marker_status, coalesce(symbol, CASE WHEN owners = 1 THEN owner END, marker) AS marker, count(*) AS n
FROM e LEFT JOIN a ON a.key = upper(marker) LEFT JOIN y ON y.key = upper(marker) GROUP BY 1, 2""",
)
def gene_standard(spark, sf_dir):
    part = _table(spark, sf_dir, "part")
    table = part.select(F.col("p_brand").alias("symbol"), F.when(F.col("p_size") > 25, "Approved").otherwise("Withdrawn").alias("status"), F.col("p_type").alias("alias_symbol"), F.col("p_name").alias("prev_symbol"))
    marks = part.select(F.col("p_brand").alias("marker")).union(part.select(F.lower("p_type"))).union(part.select("p_name"))
    return genes.standardized(marks, table).groupBy("marker_status", "marker").agg(F.count(F.lit(1)).alias("n"))


@_query("unmapped_symbols", "SELECT p_name AS symbol, count(*) AS count FROM part WHERE upper(p_name) NOT IN (SELECT upper(p_brand) FROM part) GROUP BY 1")
def unmapped_symbols(spark, sf_dir):
    part = _table(spark, sf_dir, "part")
    table = part.select(F.col("p_brand").alias("symbol"), F.lit("Approved").alias("status"), F.lit("").alias("alias_symbol"), F.lit(None).cast("string").alias("prev_symbol"))
    return genes.unmapped(genes.standardized(part.select(F.col("p_name").alias("marker")), table))


@_query(
    "normalized_tissues",
    """WITH t AS (SELECT DISTINCT trim(regexp_replace(regexp_replace(replace(p_name, '_', ' '), '[\\x00-\\x1f]+', ' ', 'g'), '  +', ' ', 'g')) AS s, p_name FROM part)
SELECT p_name AS raw, upper(substr(s, 1, 1)) || substr(s, 2) AS tissue FROM t""",
)
def normalized_tissues(spark, sf_dir):
    return _table(spark, sf_dir, "part").select(F.col("p_name").alias("raw")).distinct().withColumn("tissue", names.tissue(F.col("raw")))


@_query("normalized_entries", f"{_ENTRIES} SELECT replace(cell_type, '_', ' ') AS cell_type, count(*) AS n, count(cell_subtype) AS with_subtype, count(*) FILTER (tissue IS NULL) AS nowhere FROM e GROUP BY 1")
def normalized_entries(spark, sf_dir):
    done = names.normalized(_entry_rows(spark, sf_dir).select("cell_type", "cell_subtype", "marker", "tissue", "disease"))
    return done.groupBy("cell_type").agg(F.count(F.lit(1)).alias("n"), F.count("cell_subtype").alias("with_subtype"), F.count_if(F.col("tissue") == names.NOWHERE).alias("nowhere"))


@_query("sample_exact", "SELECT o_orderkey FROM orders ORDER BY md5('7|' || o_orderkey::VARCHAR), o_orderkey LIMIT (SELECT greatest(1, (count(*) * 0.05)::INT) FROM orders)")
def sample_exact(spark, sf_dir):
    return entries.sampled(_table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", 0.05, seed=7)


@_query("resume_left", "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R') ORDER BY 1 LIMIT 300")
def resume_left(spark, sf_dir):
    done = _table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return entries.unprocessed(_table(spark, sf_dir, "orders").select("o_orderkey"), done, "o_orderkey", 300)


@_query("id_batches", "SELECT o_orderkey, (row_number() OVER (ORDER BY o_orderkey) - 1) // 50 AS batch FROM orders")
def id_batches(spark, sf_dir):
    return entries.batches(_table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", 50)


@_query("token_estimates", "SELECT doc_id, length(text) // 4 AS estimated_tokens FROM documents")
def token_estimates(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", texts.estimated_tokens(F.col("text")).cast("long").alias("estimated_tokens"))


@_query("one_line_texts", "SELECT doc_id, md5(trim(regexp_replace(text, '[ \\t\\n\\r\\f\\v]+', ' ', 'g'))) AS digest FROM documents")
def one_line_texts(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", F.md5(texts.one_line(F.col("text")).cast("binary")).alias("digest"))


@_query(
    "assembled_texts",
    """WITH p AS (SELECT doc_id, CASE WHEN lang <> '' THEN '[Abstract]' || chr(10) || lang END AS a, CASE WHEN text <> '' THEN '[Results]' || chr(10) || text END AS r, CASE WHEN source <> '' THEN '[Methods]' || chr(10) || source END AS m FROM documents),
c AS (SELECT *, 40000 - coalesce(length(a), 0) AS l1 FROM p), d AS (SELECT *, CASE WHEN r IS NULL THEN l1 WHEN length(r) <= l1 THEN l1 - length(r) ELSE 0 END AS l2, CASE WHEN length(r) <= l1 THEN r ELSE substr(r, 1, l1) || ' ...' END AS r2 FROM c)
SELECT doc_id, md5(trim(concat_ws(chr(10) || chr(10), a, r2, CASE WHEN l2 > 200 THEN CASE WHEN length(m) <= l2 THEN m ELSE substr(m, 1, l2) || ' ...' END END), ' ' || chr(10) || chr(9))) AS digest FROM d""",
)
def assembled_texts(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", F.md5(texts.assembled(F.col("lang"), F.lit(""), F.col("text"), F.col("source")).cast("binary")).alias("digest"))


@_query("props_json", "SELECT event_type, count(*) AS n, sum((props::JSON ->> '$.k')::BIGINT)::BIGINT AS total FROM events GROUP BY 1")
def props_json(spark, sf_dir):
    k = F.from_json("props", "k long")["k"]
    return _table(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum(k).alias("total"))


@_query("gene_counts_by_paper", f"{_ENTRIES} SELECT pmcid, count(*) FILTER (tissue = 'A') AS a, count(*) FILTER (tissue = 'R') AS r, count(*) FILTER (tissue IS NULL) AS none FROM e GROUP BY 1")
def gene_counts_by_paper(spark, sf_dir):
    status = F.when(F.col("tissue") == "A", genes.CORRECTED).when(F.col("tissue") == "R", genes.AMBIGUOUS).when(F.col("tissue").isNull(), genes.UNKNOWN)
    counts = genes.validation_counts(_entry_rows(spark, sf_dir).withColumn("marker_status", status))
    return counts.withColumnsRenamed({genes.CORRECTED: "a", genes.AMBIGUOUS: "r", genes.UNKNOWN: "none"})


@_query("best_per_group", "SELECT o_custkey, o_orderkey, round(o_totalprice, 2) AS price FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) <= 2")
def best_per_group(spark, sf_dir):
    return best_first(["o_custkey"], [F.desc("o_totalprice"), "o_orderkey"], _table(spark, sf_dir, "orders"), 2).select("o_custkey", "o_orderkey", F.round("o_totalprice", 2).alias("price"))


@_query("parsed_pages")
def parsed_pages(spark, sf_dir):
    """Web pages through the tolerant article parser; no SQL form."""
    from .sources.jats import parse_articles

    return parse_articles(_table(spark, sf_dir, "pages").select(F.col("html").alias("xml")))


from . import catalog_rules  # noqa: E402, F401 - registers its queries
