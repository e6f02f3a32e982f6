"""Discovery of files, states of the catalog and shapes of results."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.operators.audit import attributed, coverage, publishable
from lectern.plans.registry import query
from lectern.plans.views import PASSAGES, SECTIONS, passages, sections, table
from lectern.sources.catalog import reconciled


@query("SELECT unnest(['benchmark', 'conversations', 'customer', 'documents', 'embeddings', 'events', 'labels', 'lineitem', 'nation', 'orders', 'pages', 'part', 'region', 'supplier']) || '.parquet' AS name")
def S01_discover_files(spark, sf):
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", True).load(sf).select("path")
    # a table may be a file or a folder of files
    return found.select(F.regexp_extract("path", r"([a-z]+\.parquet)(?:/[^/]*)?$", 1).alias("name")).distinct()


@query(f"""WITH {SECTIONS}, f AS (SELECT file_id, min(first_row) AS fr FROM sections GROUP BY 1), c AS (SELECT book_id, count(*) FILTER (WHERE fr IS NULL OR row_no < fr) / count(*) AS bare FROM passages LEFT JOIN f USING (file_id) GROUP BY 1),
v AS (SELECT source AS book_id, count(DISTINCT doc_id % 40) AS n FROM documents GROUP BY 1), k AS (SELECT book_id, CAST(substr(book_id, 4) AS INT) % 2 = 0 AS ok FROM v WHERE book_id <> 'src1' UNION ALL SELECT 'src_new', true)
SELECT coalesce(k.book_id, c.book_id) AS book_id, CASE WHEN c.book_id IS NULL THEN 'planned' WHEN bare = 1 THEN 'failed' WHEN bare > 0.1 AND bare < 1 AND n % 3 = 0 THEN 'warning' WHEN n < 35 THEN 'partial' WHEN ok THEN 'verified' ELSE 'imported' END AS status,
k.book_id IS NULL AS catalog_gap FROM k FULL JOIN c ON k.book_id = c.book_id LEFT JOIN v ON v.book_id = c.book_id""")
def D06_catalog_states(spark, sf):
    """Books are the sources; every third number of volumes has its coverage looked at, so that all states occur."""
    volumes = table(spark, sf, "documents").groupBy(F.col("source").alias("book_id")).agg(F.countDistinct(F.col("doc_id") % 40).alias("n"))
    cover = coverage(passages(spark, sf), sections(spark, sf), "book_id", "file_id", "row_no", "first_row").select("book_id", "status")
    seen = F.when((F.col("status") == "WARN") & (F.col("n") % 3 != 0), "OK").otherwise(F.col("status"))
    held = volumes.join(cover, "book_id").select("book_id", seen.alias("coverage"), F.lit(True).alias("indexed"), F.when(F.col("n") < 35, "partial").otherwise("complete").alias("volumes"))
    listed = volumes.where("book_id <> 'src1'").select("book_id", (F.substring("book_id", 4, 9).cast("int") % 2 == 0).alias("recall_verified"))
    return reconciled(listed.unionByName(spark.createDataFrame([("src_new", True)], "book_id string, recall_verified boolean")), held)


TERMS = ["rein", "Éau", "er, ", "zzqz", "n the"]
BARE = "lower(regexp_replace({}, '[^\\p{{L}}\\p{{N}}]', '', 'g'))"


@query(f"""WITH {PASSAGES}, t AS (SELECT unnest(['rein', 'Éau', 'er, ', 'zzqz', 'n the']) AS term, unnest(['rein', 'éau', 'er', 'zzqz', 'nthe']) AS bare), b AS (SELECT DISTINCT source AS book_id, source <> 'src2' AS listed FROM documents UNION ALL SELECT 'src_new', true),
x AS (SELECT book_id, {BARE.format('text_orig')} AS o, {BARE.format('normalized_text')} AS n, normalized_text AS s, kind FROM passages WHERE book_id <> 'src3'),
c AS (SELECT book_id, term, count(*) FILTER (WHERE contains(o, bare)) AS a1, count(*) FILTER (WHERE contains(n, bare)) AS a2, count(*) FILTER (WHERE contains(s, term)) AS a3, count(*) FILTER (WHERE contains(s, term) AND kind = 'passage') AS a4 FROM x, t GROUP BY ALL)
SELECT b.book_id, t.term, CASE WHEN NOT listed THEN 'none' WHEN c.a1 IS NULL THEN 'listed' WHEN a1 = 0 THEN 'imported' WHEN a2 = 0 THEN 'in_text' WHEN a3 = 0 THEN 'in_index' WHEN a4 = 0 THEN 'found' ELSE 'assembled' END AS reached,
CASE WHEN NOT listed OR c.a1 IS NULL THEN 'coverage' WHEN a1 = 0 THEN 'absent' WHEN a2 = 0 THEN 'normalization' WHEN a3 = 0 THEN 'search' WHEN a4 = 0 THEN 'assembly' ELSE 'hit' END AS reason FROM b CROSS JOIN t LEFT JOIN c ON c.book_id = b.book_id AND c.term = t.term""")
def D01_lost_layers(spark, sf):
    books = table(spark, sf, "documents").select(F.col("source").alias("book_id")).distinct().withColumn("listed", F.col("book_id") != "src2")
    books = books.unionByName(spark.createDataFrame([("src_new", True)], "book_id string, listed boolean"))
    return attributed(books, passages(spark, sf).where("book_id <> 'src3'"), TERMS, "book_id", "text_orig", "normalized_text", F.col("kind") == "passage")


@query("SELECT source, doc_id - min(doc_id) OVER (PARTITION BY source) >= 0 AS placed, doc_id, lang, n_chars FROM documents")
def S13_packed_export(spark, sf):
    """Packed by source and unpacked again."""
    from lectern.sources import storage

    d = table(spark, sf, "documents").select("source", "doc_id", "lang", "n_chars")
    whole, codes = storage.packed(d, "source", "doc_id", ["doc_id", "lang", "n_chars"], ["lang"])
    back = storage.unpacked(storage.stored(whole), codes, "source", ["doc_id", "lang", "n_chars"], ["lang"])
    return back.select("source", (F.col("place") >= 0).alias("placed"), "doc_id", "lang", "n_chars")


@query("""WITH f AS (SELECT item_id, 'data/' || item_id || CASE WHEN item_id % 5 = 0 THEN '.txt' ELSE '.json' END AS path, CASE WHEN item_id % 7 = 0 THEN 'draft ' || item_id ELSE 'book ' || item_id END AS title, text FROM benchmark)
SELECT path, 'file not allowed' AS problem FROM f WHERE item_id % 5 = 0 UNION ALL SELECT path, 'forbidden title' FROM f WHERE item_id % 7 = 0
UNION ALL SELECT path, 'quotation without source' FROM f WHERE NOT EXISTS (SELECT 1 FROM documents d WHERE contains(d.text, f.text))""")
def S17_publish_gate(spark, sf):
    i = F.col("item_id")
    files = table(spark, sf, "benchmark").select(F.concat(F.lit("data/"), i, F.when(i % 5 == 0, ".txt").otherwise(".json")).alias("path"), F.concat(F.when(i % 7 == 0, "draft ").otherwise("book "), i).alias("title"), "text")
    return publishable(files, [r"^data/[0-9]+\.json$"], ["draft"], table(spark, sf, "documents").select("text"))


@query("SELECT doc_id, '{\"id\":' || doc_id || ',\"lang\":\"' || lang || '\",\"label\":' || CASE WHEN quality IS NULL THEN 'null' ELSE CAST(quality AS VARCHAR) END || '}' AS shaped FROM documents LEFT JOIN labels USING (doc_id)")
def N15_shaped_results(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "lang").join(table(spark, sf, "labels").select("doc_id", "quality"), "doc_id", "left")
    return d.select("doc_id", F.to_json(F.struct(F.col("doc_id").alias("id"), "lang", F.col("quality").alias("label")), {"ignoreNullFields": "false"}).alias("shaped"))
