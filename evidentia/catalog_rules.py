"""Registered queries of the rules on names, symbols, articles, replies, loads and answers, with their SQL.

The driver's tables hold no such names, so keys are mapped onto names that
reach every rule; the SQL has what must come out of each.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .catalog import _ENTRIES, _STAR, _entry_rows, _flat, _query, _table, driver_star
from .functions import documents as texts
from .functions import names
from .functions.vocabulary import PARENTS
from .operators import compare, entries, extraction, genes
from .operators.load import load, unfit
from .plans import responses, store
from .plans.star import PART_ROWS, Star
from .session import scratch
from .sources import remote
from .sources.jats import parse_articles
from .sources.sinks import write_stage
from .streaming.ingest import stream_into_star

# Names as papers write them, and what must come out.
CELL_TYPES = [
    ("T cells", "T cell"),
    ("CD8-positive T cell", "CD8+ T cell"),
    ("CD4-negative T cell", "CD4+ T cell"),
    ("T/NK cell", "T cell"),
    ("stem/progenitor cell", "Stem cell"),
    ("Alveolar type 2 cell", "Alveolar type II cell"),
    ("Pre–adipocyte", "Preadipocyte"),
    ("epithelial", "Epithelial cell"),
    ("MAIT", "MAIT cell"),
    ("Natural Killer T cell", "NK cell"),
    ("Tumor cells", None),
    ("Malignant cells", "Malignant cell"),
    ("Mesenchymal stem cells", "Mesenchymal stem cells"),
    ("Osteocytes", "Osteocytes"),
    ("Cell", None),
    ("  ", None),
    (None, None),
    (" B_lymphocytes\t", "B cell"),
    ("Mac­rophages", "Macrophage"),
    ("NK  T  cell", "NKT cell"),
]
SUBTYPES = [("Treg", "Regulatory T cell"), ("M2", "M2 macrophage"), ("Th17 cells", "Th17"), ("T cell (general)", None), ("n/a", "N"), ("none", None), ("Natural killer", None), (None, None), ("", None), ("CD8 T cell", "CD8+ T cell")]
TISSUES = [("PBMC", "Blood"), ("Lung tissue", "Lung"), ("Nasal tissues", "Nasal"), ("Gastric tissue", "Gastric"), ("Serum", "Blood"), ("Tumor", None), ("melanoma", None), (None, None), ("CSF", "Cerebrospinal fluid"), ("left_atrium", "Left atrium")]
DISEASES = [
    ("CRC", "Colorectal cancer"),
    ("Oesophageal adenocarcinoma", "Esophageal adenocarcinoma"),
    ("Acute myeloid leukaemia", "Acute myeloid leukemia"),
    ("Tumour of brain", "Tumor of brain"),
    ("Gliomas", "Glioma"),
    ("n/a", "Normal"),
    (None, None),
    ("Crohn’s disease", "Crohn's disease"),
]
MARKERS = [("CD3D", "CD3D"), (" CD4 ", "CD4"), ("T cell genes", None), ("NA", None), ("A" * 30, "A" * 30), ("A" * 31, None), (None, None), (" CD8A", "CD8A")]
PAIRS = [
    ("CD8+ T cell", None, "T cell", "CD8+ T cell"),
    ("M2 macrophage", "Foo", "Macrophage", "Foo"),
    ("NKT cell", None, "NKT cell", None),
    ("Interneuron", None, "Interneuron", None),
    ("Cancer-associated fibroblast", None, "Fibroblast", "Cancer-associated fibroblast"),
    ("T cell", "Naive T cell", "T cell", "Naive T cell"),
]


def _pick(values: list, key: Column) -> Column:
    """The value of a list whose place is the key modulo its length."""
    return F.element_at(F.array(*[F.lit(v).cast("string") for v in values]), (key % len(values) + 1).cast("int"))


def _sql(value: str | None) -> str:
    return "NULL::VARCHAR" if value is None else "'" + value.replace("'", "''") + "'"


def _sql_pick(values: list, key: str) -> str:
    return f"([{', '.join(map(_sql, values))}])[({key}) % {len(values)} + 1]"


def _rule(name: str, pairs: list[tuple], rule) -> None:
    sql = f"SELECT p_partkey, {_sql_pick([x[1] for x in pairs], 'p_partkey')} AS standard FROM part"
    _query(name, sql)(lambda spark, sf_dir: _table(spark, sf_dir, "part").select("p_partkey", rule(_pick([x[0] for x in pairs], F.col("p_partkey"))).alias("standard")))


for _name, _pairs, _f in (("rule_cell_types", CELL_TYPES, names.cell_type), ("rule_subtypes", SUBTYPES, names.subtype), ("rule_tissues", TISSUES, names.tissue), ("rule_diseases", DISEASES, names.disease), ("rule_markers", MARKERS, names.marker)):
    _rule(_name, _pairs, _f)


@_query("rule_demotion", f"SELECT p_partkey, {_sql_pick([x[2] for x in PAIRS], 'p_partkey')} AS cell_type, {_sql_pick([x[3] for x in PAIRS], 'p_partkey')} AS cell_subtype FROM part")
def rule_demotion(spark, sf_dir):
    kind, sub = (_pick([x[k] for x in PAIRS], F.col("p_partkey")) for k in (0, 1))
    return _table(spark, sf_dir, "part").select("p_partkey", names.demoted(kind, sub).alias("x")).select("p_partkey", "x.*")


_NAMED_KEYS = {"cell_type": ("l_orderkey", CELL_TYPES), "cell_subtype": ("l_partkey", SUBTYPES), "marker": ("l_suppkey", MARKERS), "tissue": ("l_orderkey + l_linenumber", TISSUES), "disease": ("l_partkey + l_linenumber", DISEASES)}
_BROADER = " ".join(f"WHEN lower(t) LIKE '% {suffix}' AND lower(t) <> '{parent.lower()}' THEN '{parent}'" for suffix, parent in PARENTS.items())


@_query(
    "normalized_names",
    f"""WITH s AS (SELECT {', '.join(f"{_sql_pick([x[1] for x in pairs], key)} AS {c}" for c, (key, pairs) in zip(('t', 'u', 'marker', 'tissue', 'disease'), _NAMED_KEYS.values(), strict=True))} FROM lineitem),
d AS (SELECT *, CASE {_BROADER} END AS p FROM s WHERE t IS NOT NULL AND marker IS NOT NULL)
SELECT coalesce(p, t) AS cell_type, CASE WHEN p IS NULL THEN u ELSE coalesce(u, t) END AS cell_subtype, marker, coalesce(tissue, 'Not specified') AS tissue, coalesce(disease, 'Normal') AS disease, count(*) AS n FROM d GROUP BY ALL""",
)
def normalized_names(spark, sf_dir):
    """Entries with names of every kind through all rules at once."""
    raw = _table(spark, sf_dir, "lineitem").select(*[_pick([x[0] for x in pairs], F.expr(key)).alias(c) for c, (key, pairs) in _NAMED_KEYS.items()])
    fields = list(_NAMED_KEYS)
    return names.normalized(raw).groupBy(fields).agg(F.count(F.lit(1)).alias("n"))


# Symbols as papers write them, with symbol, status and what is kept of the original.
SYMBOLS = [
    ("cd3d", "CD3D", "approved", None),
    ("T3D", "CD3D", "corrected", "T3D"),
    ("DUP", "DUP", "ambiguous", "DUP"),
    ("XYZ9", "XYZ9", "unknown", None),
    (None, "", "unknown", None),
    ("  ", "  ", "unknown", None),
    ("old1", "BBB1", "corrected", "old1"),
    ("WAS", "WAS", "unknown", None),
]
NOMENCLATURE = [("CD3D", "Approved", "T3D", None), ("AAA1", "Approved", "DUP", ""), ("BBB1", "Approved", "x|dup ", "OLD1"), ("ZZZ", "Withdrawn", "WAS", None)]


def _symbols(spark, sf_dir) -> DataFrame:
    table = spark.createDataFrame(NOMENCLATURE, "symbol string, status string, alias_symbol string, prev_symbol string")
    given = _table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("pmcid"), _pick([x[0] for x in SYMBOLS], F.col("p_partkey")).alias("marker"))
    return genes.standardized(given, table)


@_query("gene_originals", f"SELECT p_partkey, {_sql_pick([x[1] for x in SYMBOLS], 'p_partkey')} AS marker, {_sql_pick([x[2] for x in SYMBOLS], 'p_partkey')} AS marker_status, {_sql_pick([x[3] for x in SYMBOLS], 'p_partkey')} AS marker_original FROM part")
def gene_originals(spark, sf_dir):
    return _symbols(spark, sf_dir).select("p_partkey", "marker", "marker_status", "marker_original")


@_query("gene_validation_counts", f"WITH s AS (SELECT p_brand AS pmcid, {_sql_pick([x[2] for x in SYMBOLS], 'p_partkey')} AS s FROM part) SELECT pmcid, count(*) FILTER (s = 'corrected') AS corrected, count(*) FILTER (s = 'ambiguous') AS ambiguous, count(*) FILTER (s = 'unknown') AS unknown FROM s GROUP BY 1")
def gene_validation_counts(spark, sf_dir):
    return genes.validation_counts(_symbols(spark, sf_dir))


_PLAIN = "[^A-Za-z0-9 .,\\n]"
_WORDS = "trim(regexp_replace({}, '[ \\n]+', ' ', 'g'))"


@_query(
    "parsed_articles",
    f"""WITH p AS (SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_replace(coalesce(text, ''), '[^A-Za-z0-9 .,' || chr(10) || ']', ' ', 'g') AS t FROM documents),
d AS (SELECT (1000 + doc_id)::VARCHAR AS pmcid, doc_id::VARCHAR AS pmid, trim('T ' || lang) AS title, CASE WHEN source = '' THEN 'Unknown' ELSE source END AS journal, (2001 + doc_id % 20)::INT AS year,
  trim(regexp_replace(substr(t, 1, 300), '[ ' || chr(10) || ']+', ' ', 'g')) AS abstract, trim('Results ' || trim(regexp_replace(t, '[ ' || chr(10) || ']+', ' ', 'g'))) AS results, 'Methods m' || doc_id AS methods,
  '**Table 1' || CASE WHEN lang = '' THEN '' ELSE ': ' || lang END || '**' || chr(10) || '| a/b | c |' || chr(10) || '| --- | --- |' || chr(10) || '| ' || doc_id || ' |  |' AS tables_md FROM p),
c AS (SELECT *, CASE WHEN abstract <> '' THEN '[Abstract]' || chr(10) || abstract END AS a, '[Tables]' || chr(10) || tables_md AS t, '[Results]' || chr(10) || results AS r, '[Methods]' || chr(10) || methods AS m FROM d),
l AS (SELECT *, 40000 - coalesce(length(a), 0) - length(t) AS l2 FROM c), e AS (SELECT *, greatest(l2 - length(r), 0) AS l3 FROM l),
w AS (SELECT *, trim(concat_ws(chr(10) || chr(10), a, t, CASE WHEN length(r) <= l2 THEN r ELSE substr(r, 1, l2) || ' ...' END, CASE WHEN l3 > 200 THEN m END), ' ' || chr(10)) AS clean FROM e)
SELECT pmcid, pmid, title, journal, year, md5(abstract) AS abstract, md5(results) AS results, methods, tables_md, md5(clean) AS clean_text, length(clean)::INT AS char_count, (length(clean) // 4)::INT AS estimated_tokens FROM w""",
)
def parsed_articles(spark, sf_dir):
    """Documents wrapped into articles with ids, mark-up, citations, sections and a table, and parsed."""
    plain = F.regexp_replace(F.coalesce("text", F.lit("")), _PLAIN, " ")
    none = lambda c: F.coalesce(F.col(c), F.lit(""))
    xml = F.concat(
        F.lit('<article xmlns:x="urn:x"><front><article-meta><article-id pub-id-type="pmid">'), F.col("doc_id"), F.lit('</article-id><article-id pub-id-type="pmcid">PMC'), F.col("doc_id") + 1000, F.lit("</article-id><title-group><article-title>T <i>"), none("lang"),
        F.lit("</i></article-title></title-group><journal-title>"), none("source"), F.lit('</journal-title><pub-date pub-type="ppub"><year>1990</year></pub-date><pub-date pub-type="epub"><year> '), F.col("doc_id") % 20 + 2001,
        F.lit("</year></pub-date><abstract><p>"), F.substring(plain, 1, 300), F.lit('<xref ref-type="bibr">9</xref></p><fig><p>hidden</p></fig></abstract></article-meta></front><body><sec sec-type="results"><title>Results</title><p>'), plain,
        F.lit("</p></sec><sec><title>Methods</title><p>m"), F.col("doc_id"), F.lit("</p></sec><sec><title>Other</title><p>not this</p></sec><table-wrap><label>Table 1</label><caption><p>"), none("lang"),
        F.lit("</p></caption><table><thead><tr><th>a|b</th><th>c</th></tr></thead><tbody><tr><td>"), F.col("doc_id"), F.lit("</td></tr></tbody></table></table-wrap></body></article>"),
    )
    done = parse_articles(_table(spark, sf_dir, "documents").select(xml.alias("xml")))
    return done.withColumns({c: F.md5(F.col(c).cast("binary")) for c in ("abstract", "results", "clean_text")}).withColumn("year", F.col("year").cast("int"))


@_query(
    "parsed_damaged_articles",
    """WITH p AS (SELECT doc_id, coalesce(lang, '') AS lang, regexp_replace(coalesce(text, ''), '[^A-Za-z0-9 .,' || chr(10) || ']', ' ', 'g') AS t FROM documents)
SELECT (1000 + doc_id)::VARCHAR AS pmcid, trim('T ' || CASE WHEN doc_id % 3 = 2 THEN '& ' ELSE '' END || lang) AS title, (2001 + doc_id % 20)::INT AS year,
  md5(trim(regexp_replace(t, '[ ' || chr(10) || ']+', ' ', 'g'))) AS abstract, trim('Results r' || doc_id || CASE WHEN doc_id % 3 = 1 THEN ' and more' ELSE '' END) AS results FROM p""",
)
def parsed_damaged_articles(spark, sf_dir):
    """Documents as articles whose names have a prefix, whose elements are not closed, or with signs that XML doesn't allow."""
    kind = F.col("doc_id") % 3
    plain = F.regexp_replace(F.coalesce("text", F.lit("")), _PLAIN, " ")
    prefix = F.when(kind == 0, "j:").otherwise("")
    parts = [
        '<{p}article xmlns:j="urn:j"><{p}front><{p}article-meta><{p}article-id pub-id-type="pmcid">PMC', F.col("doc_id") + 1000, "</{p}article-id><{p}article-title>T ", F.when(kind == 2, "& ").otherwise(""), F.coalesce("lang", F.lit("")),
        '</{p}article-title><{p}pub-date pub-type="epub"><{p}year>', F.col("doc_id") % 20 + 2001, "</{p}year></{p}pub-date><{p}abstract><{p}p>", plain, F.when(kind == 1, "").otherwise(F.concat(F.lit("</"), prefix, F.lit("p>"))),
        '</{p}abstract></{p}article-meta></{p}front><{p}body><{p}sec sec-type="results"><{p}title>Results</{p}title><{p}p>r', F.col("doc_id"), F.when(kind == 1, "<italic> and more").otherwise(""), "</{p}p></{p}sec></{p}body></{p}article>",
    ]
    xml = F.concat(*[F.replace(F.lit(x), F.lit("{p}"), prefix) if isinstance(x, str) else x.cast("string") for x in parts])
    return parse_articles(_table(spark, sf_dir, "documents").select(xml.alias("xml"))).select("pmcid", "title", "year", F.md5(F.col("abstract").cast("binary")).alias("abstract"), "results")


# Replies of a model, and the entries (place, cell type, subtype, marker, tissue, disease) that they hold; no list: the reply can't be read.
REPLIES = [
    ('{"markers": [{"cell_type": " T cell ", "marker": "CD3D", "tissue": 5, "disease": ""}, "text", {"cell_type": "B cell"}, {"cell_type": "B cell", "marker": "  "}, {"cell_type": "NK", "marker": 7}, null, {"cell_type": null, "marker": "X"}]}', [(0, "T cell", None, "CD3D", None, None), (3, "B cell", None, None, None, None), (4, "NK", None, None, None, None)]),
    ("not json", None),
    ('{"markers": []}', []),
    ('{"other": 1}', None),
    ('{"markers": [{"cell_type": "B cell", "cell_subtype": "naive", "marker": "MS4A1", "tissue": "Blood", "disease": "CRC", "more": [1]}]}', [(0, "B cell", "naive", "MS4A1", "Blood", "CRC")]),
]
_HELD = [(k, *x) for k, (_, held) in enumerate(REPLIES) for x in held or []]
_HELD_SQL = ", ".join(f"({k}, {pos}, {', '.join(map(_sql, x))})" for k, pos, *x in _HELD)


def _replies(spark, sf_dir) -> DataFrame:
    return _table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("pmcid"), _pick([x[0] for x in REPLIES], F.col("o_orderkey")).alias("reply"))


@_query("parsed_replies", f"SELECT o_orderkey::VARCHAR AS pmcid, pos::INT AS pos, cell_type, cell_subtype, marker, tissue, disease FROM orders JOIN (VALUES {_HELD_SQL}) v(k, pos, cell_type, cell_subtype, marker, tissue, disease) ON k = o_orderkey % {len(REPLIES)}")
def parsed_replies(spark, sf_dir):
    return entries.parsed(_replies(spark, sf_dir))


@_query("unreadable_replies", f"SELECT o_orderkey::VARCHAR AS pmcid FROM orders WHERE o_orderkey % {len(REPLIES)} IN ({', '.join(str(k) for k, x in enumerate(REPLIES) if x[1] is None)})")
def unreadable_replies(spark, sf_dir):
    return entries.unreadable(_replies(spark, sf_dir)).select("pmcid")


@_query("gathered_entries", f"WITH v AS (SELECT * FROM (VALUES {_HELD_SQL}) v(k, pos, cell_type, cell_subtype, marker, tissue, disease)) SELECT o_orderkey::VARCHAR AS pmcid, count(*) AS n, string_agg(coalesce(marker, '-'), '|' ORDER BY pos) AS markers FROM orders JOIN v ON k = o_orderkey % {len(REPLIES)} GROUP BY 1")
def gathered_entries(spark, sf_dir):
    """Entries of a paper gathered in their order, and exploded again."""
    again = entries.exploded(entries.gathered(entries.parsed(_replies(spark, sf_dir))))
    item = F.struct("pos", F.coalesce("marker", F.lit("-")).alias("m"))
    return again.groupBy("pmcid").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["m"]), "|").alias("markers"))


_LOADED = f"{_ENTRIES}, d AS (SELECT DISTINCT pmcid, cell_type, cell_subtype, marker, tissue, disease FROM e WHERE marker <> 'Brand#11')"


def _unmarked(spark, sf_dir) -> DataFrame:
    """All entries with what a load reads and their date; some have no marker."""
    rows = _entry_rows(spark, sf_dir).withColumn("marker", F.when(F.col("marker") != "Brand#11", F.col("marker")))
    return rows.select("pmcid", *entries.FIELDS, "l_shipdate")


def _two_parts(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame]:
    """All entries in two overlapping parts, and their papers; the entries are written first, so that the tables are joined once for all loads."""
    rows = write_stage(_unmarked(spark, sf_dir), scratch(spark), "arrived")
    papers = rows.select("pmcid", F.lit(None).cast("string").alias("pmid"), F.lit("t").alias("title")).distinct()
    return rows.where("l_shipdate < timestamp'1998-07-01'"), rows.where("l_shipdate >= timestamp'1996-01-01'"), papers


def _loaded(spark, sf_dir) -> Star:
    """All entries, loaded in two overlapping parts; some have no marker."""
    first, second, papers = _two_parts(spark, sf_dir)
    return load(second, papers, load(first, papers))


@_query("loaded_twice", f"{_LOADED} SELECT marker, count(*) AS entries, count(DISTINCT pmcid) AS citation_count, count(DISTINCT cell_type) AS cell_types, count(DISTINCT (cell_type, cell_subtype)) FILTER (cell_subtype IS NOT NULL) AS cell_subtypes, count(DISTINCT tissue) AS tissues FROM d GROUP BY 1")
def loaded_twice(spark, sf_dir):
    star = _loaded(spark, sf_dir)
    cited = star.markers.select(F.col("id").alias("marker_id"), F.col("symbol").alias("marker"), "citation_count")
    n = star.entries.groupBy("marker_id").agg(F.count(F.lit(1)).alias("entries"), F.count_distinct("cell_type_id").alias("cell_types"), F.count_distinct("cell_subtype_id").alias("cell_subtypes"), F.count_distinct("tissue_id").alias("tissues"))
    return n.join(cited, "marker_id").drop("marker_id")


def _by_marker(star: Star) -> DataFrame:
    """Entries and citations of each marker, as the star counts them."""
    n = star.entries.groupBy(F.col("marker_id").alias("id")).agg(F.count(F.lit(1)).alias("entries"), F.count_distinct("cell_type_id").alias("cell_types"))
    return star.markers.join(n, "id", "left").select(F.col("symbol").alias("marker"), "citation_count", "entries", "cell_types")


_BY_MARKER = "SELECT marker, count(DISTINCT pmcid) AS citation_count, count(*) AS entries, count(DISTINCT cell_type) AS cell_types FROM d GROUP BY 1"


@_query("loaded_concurrently", f"{_LOADED} {_BY_MARKER}")
def loaded_concurrently(spark, sf_dir):
    """Two overlapping parts of all entries, loaded into one folder by two threads at the same time; counts of citations are raised, not counted anew."""
    folder = f"{scratch(spark)}/star"
    *parts, papers = _two_parts(spark, sf_dir)
    with ThreadPoolExecutor(2) as pool:
        list(pool.map(lambda part: store.add_to_star(part, papers, folder), parts))
    return _by_marker(store.read_star(spark, folder))


@_query("loaded_from_stream", f"{_LOADED} {_BY_MARKER}")
def loaded_from_stream(spark, sf_dir):
    """All entries as a stream into a star, in three batches, twice: the batches of the second run have the numbers of the first and add nothing.

    A batch has as many files as its rows need, so that no task writes a third of the entries.
    """
    base = scratch(spark)
    rows = _unmarked(spark, sf_dir).select("pmcid", F.lit(None).cast("string").alias("pmid"), F.lit("t").alias("title"), *entries.FIELDS)
    files = max(1, -(-_table(spark, sf_dir, "lineitem").count() // (3 * PART_ROWS)))
    rows.repartition(3 * files).write.parquet(f"{base}/in")
    arriving = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files).parquet(f"{base}/in")
    for checkpoint in ("first", "again"):
        stream_into_star(arriving, f"{base}/star", f"{base}/{checkpoint}").awaitTermination()
    return _by_marker(store.read_star(spark, f"{base}/star"))


@_query("loaded_dimensions", f"{_LOADED} SELECT (SELECT count(DISTINCT pmcid) FROM d) AS total_papers, (SELECT count(DISTINCT marker) FROM d) AS total_markers, (SELECT count(DISTINCT cell_type) FROM d) AS total_cell_types, (SELECT count(DISTINCT disease) FROM d) AS total_diseases, (SELECT count(DISTINCT tissue) FROM d) AS total_tissues, (SELECT count(*) FROM d) AS total_entries")
def loaded_dimensions(spark, sf_dir):
    return _loaded(spark, sf_dir).overview()


@_query("unfit_entries", f"{_ENTRIES} SELECT 'no marker' AS reason, pmcid, count(*) AS n FROM e WHERE marker = 'Brand#11' GROUP BY pmcid")
def unfit_entries(spark, sf_dir):
    rows = _entry_rows(spark, sf_dir).withColumn("marker", F.when(F.col("marker") != "Brand#11", F.col("marker")))
    return unfit(rows).groupBy("reason", "pmcid").agg(F.count(F.lit(1)).alias("n"))


_COMPARED = f"""{_ENTRIES}, k AS (SELECT pmcid || '/' || cell_subtype AS pmcid, lower(cell_type) AS ct, upper(marker) AS g, l_shipdate FROM e WHERE cell_subtype IS NOT NULL),
o AS (SELECT DISTINCT pmcid, ct, g FROM k WHERE l_shipdate < TIMESTAMP '1993-01-01'), r AS (SELECT DISTINCT pmcid, ct, g FROM k WHERE l_shipdate >= TIMESTAMP '1993-01-01'),
s AS (SELECT pmcid, (SELECT count(*) FROM o WHERE o.pmcid = p.pmcid)::DOUBLE AS n, (SELECT count(*) FROM r WHERE r.pmcid = p.pmcid)::DOUBLE AS m, (SELECT count(*) FROM o JOIN r USING (pmcid, ct, g) WHERE o.pmcid = p.pmcid)::DOUBLE AS b FROM (SELECT pmcid FROM o UNION SELECT pmcid FROM r) p),
f AS (SELECT pmcid, round_even(CASE WHEN b = 0 THEN 0.0::DOUBLE ELSE 2 * (b / n) * (b / m) / (b / n + b / m) END, 4) AS f1, round_even(CASE WHEN n = 0 THEN 0.0::DOUBLE ELSE b / n END, 4) AS p, round_even(CASE WHEN m = 0 THEN 0.0::DOUBLE ELSE b / m END, 4) AS q FROM s)"""


def _reports(spark, sf_dir) -> DataFrame:
    """A comparison of all entries before a date with all from it on."""
    rows = _entry_rows(spark, sf_dir).where("cell_subtype is not null").withColumn("pmcid", F.concat_ws("/", "pmcid", "cell_subtype"))
    return compare.compared(rows.where("l_shipdate < timestamp'1993-01-01'"), rows.where("l_shipdate >= timestamp'1993-01-01'"))


@_query(
    "compared_lists",
    f"""{_COMPARED}, x AS (SELECT pmcid, ct || '+' || g AS k, row_number() OVER (PARTITION BY pmcid ORDER BY ct, g) AS i FROM (SELECT * FROM o EXCEPT SELECT * FROM r)), y AS (SELECT pmcid, ct || '+' || g AS k, row_number() OVER (PARTITION BY pmcid ORDER BY ct, g) AS i FROM (SELECT * FROM r EXCEPT SELECT * FROM o))
SELECT pmcid, coalesce((SELECT string_agg(k, '|' ORDER BY i) FROM x WHERE x.pmcid = f.pmcid AND i <= 10), '') AS only_in_original, coalesce((SELECT string_agg(k, '|' ORDER BY i) FROM y WHERE y.pmcid = f.pmcid AND i <= 10), '') AS only_in_reference FROM f""",
)
def compared_lists(spark, sf_dir):
    said = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws("+", x["cell_type"], x["marker"])), "|").alias(c)
    return _reports(spark, sf_dir).select("pmcid", said("only_in_original"), said("only_in_reference"))


@_query("low_quality_papers", f"{_COMPARED} SELECT pmcid, f1 FROM f WHERE f1 < 0.5")
def low_quality_papers(spark, sf_dir):
    return compare.low_quality_papers(_reports(spark, sf_dir))


@_query("comparison_summary", f"{_COMPARED} SELECT count(*) AS papers, round_even(avg(p), 4) AS avg_precision, round_even(avg(q), 4) AS avg_recall, round_even(avg(f1), 4) AS avg_f1, count(*) FILTER (f1 < 0.5) AS low_quality FROM f")
def comparison_summary(spark, sf_dir):
    return compare.summary(_reports(spark, sf_dir)).drop("avg_gene_precision", "avg_gene_recall")


_DOCS = "SELECT c_mktsegment AS pmcid, count(*)::INT AS n, sum(o_shippriority + 7)::INT AS tokens FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1"


def _documents(spark, sf_dir, model: str, where: str) -> DataFrame:
    """Documents with a marker for each of some orders."""
    t = _table(spark, sf_dir, "orders").where(where).join(_table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment"), "o_custkey")
    item = F.struct(F.lit("T cell").alias("cell_type"), F.lit(None).cast("string").alias("cell_subtype"), F.concat(F.lit("M"), "o_orderkey").alias("marker"), F.lit(None).cast("string").alias("tissue"), F.lit(None).cast("string").alias("disease"))
    docs = t.groupBy(F.col("c_mktsegment").alias("pmcid")).agg(F.collect_list(item).alias("markers"), F.count(F.lit(1)).cast("int").alias("n"))
    return docs.select("pmcid", "markers", F.col("n").alias("valid_marker_count"), F.lit(model).alias("model"), F.struct((F.col("n") * 7).alias("total_tokens")).alias("usage"))


@_query("run_totals", "SELECT count(DISTINCT c_mktsegment) AS papers, count(*) AS markers, count(*) * 7 AS tokens, count(*) / count(DISTINCT c_mktsegment) AS markers_per_paper FROM orders JOIN customer ON c_custkey = o_custkey")
def run_totals(spark, sf_dir):
    return entries.run_totals(_documents(spark, sf_dir, "a", "true"))


@_query("replaced_documents", "WITH d AS (SELECT c_mktsegment AS pmcid, count(*) AS n, count(*) FILTER (o_orderpriority = '1-URGENT' AND c_mktsegment < 'F') AS m FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1) SELECT pmcid, m > 0 AS validated, CASE WHEN m > 0 THEN 'b' ELSE 'a' END AS model, CASE WHEN m > 0 THEN 'a' END AS original_model, (CASE WHEN m > 0 THEN m ELSE n END)::INT AS valid_marker_count, (CASE WHEN m > 0 THEN n END)::INT AS had FROM d")
def replaced_documents(spark, sf_dir):
    docs = _documents(spark, sf_dir, "a", "true")
    better = _documents(spark, sf_dir, "b", "o_orderpriority = '1-URGENT'").where("pmcid < 'F'")
    done = compare.replaced(docs, better)
    return done.select("pmcid", "validated", "model", "original_model", "valid_marker_count", F.when(F.col("validated"), F.size("original_markers")).alias("had"))


@_query("step_accounting", f"{_ENTRIES} SELECT count(*) AS total, count(*) FILTER (tissue IS NOT NULL) AS kept, count(*) FILTER (tissue IS NULL) AS dropped FROM e")
def step_accounting(spark, sf_dir):
    rows = _entry_rows(spark, sf_dir)
    return entries.accounting(rows, rows.where("tissue is not null"))


@_query(
    "small_texts",
    """SELECT p_partkey, format('{:,}', (p_partkey * 12345)::BIGINT) AS shown, CASE p_partkey % 5 WHEN 0 THEN 'success' WHEN 1 THEN 'warning' WHEN 2 THEN 'danger' ELSE 'info' END AS class,
  'https://www.ncbi.nlm.nih.gov/pmc/articles/PMC' || p_partkey || '/' AS link, trim(replace(p_name, '|', '/')) || '/x' AS cell, 'PMID: ' || p_partkey || chr(10) || 'Title: ' || chr(10) || chr(10) || p_name AS prompt,
  lower(p_type) || '+' || upper(p_name) AS key, CASE WHEN length(p_type) > 20 THEN substr(p_type, 1, 18) || '…' ELSE p_type END AS label FROM part""",
)
def small_texts(spark, sf_dir):
    key = texts.strict_key(F.concat(F.lit(" "), "p_type"), F.concat("p_name", F.lit("\t")))
    return _table(spark, sf_dir, "part").select(
        "p_partkey",
        texts.shown_number((F.col("p_partkey") * 12345).cast("long")).alias("shown"),
        texts.status_class(_pick(["approved", "corrected", "ambiguous", "unknown", "other"], F.col("p_partkey"))).alias("class"),
        texts.link(F.concat(F.lit("PMC"), "p_partkey")).alias("link"),
        texts.cell(F.concat(F.lit(" \n"), "p_name", F.lit("|x "))).alias("cell"),
        texts.prompt(F.col("p_partkey").cast("string"), F.lit(None).cast("string"), F.col("p_name")).alias("prompt"),
        F.concat_ws("+", key["cell_type"], key["marker"]).alias("key"),
        texts.short_label(F.col("p_type")).alias("label"),
    )


_UNNAMED = "CASE WHEN l_suppkey % 3 = 0 THEN 'Not specified' ELSE tissue END"


@_query("specified_tissues", f"{_STAR} SELECT tissue AS name, count(*) AS count FROM (SELECT {_UNNAMED} AS tissue FROM entries WHERE tissue IS NOT NULL) WHERE tissue <> 'Not specified' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 15")
def specified_tissues(spark, sf_dir):
    """Top tissues of a star in which a third are not specified."""
    star = driver_star(spark, sf_dir)
    some = star.tissues.withColumn("name", F.when(F.col("id") % 3 == 0, "Not specified").otherwise(F.col("name")))
    return Star(**{**star.__dict__, "tissues": some}).distribution("tissue")


@_query("capped_export", f"{_STAR} SELECT marker, cell_type, cell_subtype, coalesce(tissue, '') AS tissue, coalesce(disease, '') AS disease, pmid, pmcid, marker_status FROM entries ORDER BY marker, l_orderkey, l_partkey, l_suppkey, l_linenumber, l_extendedprice LIMIT 500")
def capped_export(spark, sf_dir):
    return driver_star(spark, sf_dir).export(cap=500)


@_query(
    "dashboard_answer",
    f"""{_STAR}, c AS (SELECT cell_type AS name, count(*) AS count FROM entries GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 15), d AS (SELECT disease AS name, count(*) AS count FROM entries WHERE disease IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 30), t AS (SELECT tissue AS name, count(*) AS count FROM entries WHERE tissue IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 15)
SELECT 'cell_types' AS list, name, count FROM c UNION ALL SELECT 'diseases', name, count FROM d UNION ALL SELECT 'tissues', name, count FROM t
UNION ALL SELECT 'overview', 'total_papers', (SELECT count(*) FROM orders) UNION ALL SELECT 'overview', 'total_entries', (SELECT count(*) FROM lineitem)""",
)
def dashboard_answer(spark, sf_dir):
    """The dashboard's JSON, read back."""
    item = "array<struct<name: string, count: bigint>>"
    read = F.from_json("json", f"overview map<string, bigint>, distribution struct<cell_types: {item}, diseases: {item}, tissues: {item}>")
    done = responses.dashboard_response(driver_star(spark, sf_dir)).select(read.alias("x"))
    lists = [done.select(F.lit(n).alias("list"), F.inline(F.col(f"x.distribution.{n}"))) for n in ("cell_types", "diseases", "tissues")]
    counts = done.select(F.lit("overview").alias("list"), F.explode("x.overview").alias("name", "count")).where(F.col("name").isin("total_papers", "total_entries"))
    return lists[0].union(lists[1]).union(lists[2]).union(counts)


@_query(
    "search_answer",
    f"""{_STAR} SELECT (SELECT count(*) FROM entries) AS total, 2 AS page, 20 AS page_size, row_number() OVER (ORDER BY citation_count DESC, marker, cell_type, l_orderkey, l_partkey, l_suppkey, l_linenumber, l_extendedprice) - 21 AS place, marker, cell_type, tissue, pmcid
FROM entries QUALIFY place BETWEEN 0 AND 19""",
)
def search_answer(spark, sf_dir):
    """A page's JSON, read back."""
    fields = ", ".join(f"{c}: string" for c in ("marker", "cell_type", "cell_subtype", "tissue", "disease", "pmid", "pmcid", "marker_status"))
    read = F.from_json("json", f"total bigint, page int, page_size int, results array<struct<{fields}>>")
    done = responses.search_response(driver_star(spark, sf_dir, cited=True), page=2).select(read.alias("x")).select("x.total", "x.page", "x.page_size", F.posexplode("x.results").alias("place", "r"))
    return done.select("total", "page", "page_size", F.col("place").cast("long").alias("place"), "r.marker", "r.cell_type", "r.tissue", "r.pmcid")


@_query("detail_lists", f"{_STAR} SELECT marker AS symbol, string_agg(DISTINCT cell_type, '|' ORDER BY cell_type) AS cell_types, count(*) AS total_entries FROM entries WHERE l_partkey = 7 GROUP BY 1")
def detail_lists(spark, sf_dir):
    """A marker's JSON, read back."""
    symbol = _table(spark, sf_dir, "part").where("p_partkey = 7").select(F.concat_ws(" ", "p_name", "p_partkey")).first()[0]
    read = F.from_json("json", "symbol string, cell_types array<string>, total_entries bigint")
    return _flat(responses.detail_response(driver_star(spark, sf_dir), symbol).select(read.alias("x")).select("x.*"))


def _some_articles(wanted: list[str]) -> str:
    """A transport that has no article for every seventh id."""
    article = '<article><front><article-meta><article-id pub-id-type="pmid">1</article-id><article-id pub-id-type="pmcid">PMC{0}</article-id></article-meta></front></article>'
    return "<set>" + "".join(article.format(i) for i in wanted if int(i) % 7 != 3) + "</set>"


def _page_of_ids(start: int, size: int) -> list[str]:
    """Ids of a search that has any number of hits, the third page of which is never answered."""
    if start == 2 * size:
        raise ConnectionError(start)
    return [str(i) for i in range(start, start + size)]


def _ids(spark, sf_dir) -> DataFrame:
    return _table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("pmcid"))


@_query("fetched_articles", "SELECT doc_id::VARCHAR AS pmcid FROM documents WHERE doc_id % 7 <> 3")
def fetched_articles(spark, sf_dir):
    return remote.fetch_articles(_ids(spark, sf_dir), _some_articles, rate=1e6, wait=0.0).select("pmcid")


@_query("missing_articles", "SELECT doc_id::VARCHAR AS pmcid FROM documents WHERE doc_id % 7 = 3")
def missing_articles(spark, sf_dir):
    ids = _ids(spark, sf_dir)
    return remote.missing(ids, remote.fetch_articles(ids, _some_articles, rate=1e6, wait=0.0))


@_query("searched_ids", "SELECT n::VARCHAR AS pmcid FROM (SELECT row_number() OVER () - 1 AS n FROM orders) WHERE n < (SELECT count(*) FROM orders) // 10 * 10 AND n NOT BETWEEN 20 AND 29 UNION ALL SELECT n::VARCHAR FROM range((SELECT count(*) // 10 * 10 FROM orders), (SELECT ceil(count(*) / 10)::BIGINT * 10 FROM orders)) r(n)")
def searched_ids(spark, sf_dir):
    """A search with as many hits as there are orders, in pages of ten."""
    return remote.search(spark, _table(spark, sf_dir, "orders").count, _page_of_ids, page=10, rate=1e6, wait=0.0)


@_query("pending_papers", "SELECT DISTINCT o_orderkey::VARCHAR AS pmcid FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'A')")
def pending_papers(spark, sf_dir):
    papers = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("pmcid"))
    return extraction.pending(papers, _table(spark, sf_dir, "lineitem").where("l_returnflag = 'A'").select(F.col("l_orderkey").cast("string").alias("pmcid")))


@_query("cache_keys", """SELECT p_partkey, md5('[{"key":"cell_type","value":["' || p_type || '"]},{"key":"tissue","value":["' || p_brand || '","x"]}]') AS key FROM part""")
def cache_keys(spark, sf_dir):
    """Filters in any order of their fields have one key."""
    asked = F.when(F.col("p_partkey") % 2 == 0, F.create_map(F.lit("tissue"), F.array("p_brand", F.lit("x")), F.lit("cell_type"), F.array("p_type")))
    return _table(spark, sf_dir, "part").select("p_partkey", texts.cache_key(asked.otherwise(F.create_map(F.lit("cell_type"), F.array("p_type"), F.lit("tissue"), F.array("p_brand", F.lit("x"))))).alias("key"))


@_query(
    "initial_answer",
    f"""{_STAR} SELECT (SELECT string_agg(n_name, '|' ORDER BY n_name) FROM nation) AS cell_types, (SELECT string_agg(s_name, '|' ORDER BY s_name) FROM supplier WHERE s_acctbal > 0) AS tissues, (SELECT count(*) FROM entries) AS total,
  (SELECT string_agg(cell_type || '+' || marker || '+' || count, '|' ORDER BY count DESC, cell_type, marker) FROM (SELECT cell_type, marker, count(DISTINCT l_orderkey) AS count FROM entries GROUP BY 1, 2 ORDER BY count DESC, cell_type, marker LIMIT 2000)) AS bubble""",
)
def initial_answer(spark, sf_dir):
    """What a search view starts with, read back from its JSON."""
    read = F.from_json("json", "filters struct<cell_types: array<string>, tissues: array<string>>, search struct<total: bigint>, bubble array<struct<cell_type: string, marker: string, count: bigint>>")
    x = responses.initial_response(driver_star(spark, sf_dir, cited=True)).select(read.alias("x"))
    points = F.array_join(F.transform("x.bubble", lambda p: F.concat_ws("+", p["cell_type"], p["marker"], p["count"])), "|")
    return x.select(F.array_join("x.filters.cell_types", "|").alias("cell_types"), F.array_join("x.filters.tissues", "|").alias("tissues"), F.col("x.search.total").alias("total"), points.alias("bubble"))
