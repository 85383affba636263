"""Volume ids, paths and page numbers from metadata."""

from __future__ import annotations

from pyspark.sql import functions as F

from quirelens.functions.ids import volume_path
from quirelens.operators import quality, volumes as vo
from quirelens.plans import jobs
from registry import query
from registry.inputs import table

IDS = "ids AS (SELECT CASE WHEN page_id % 10 = 0 THEN replace(url, '.', '') ELSE 'lib.' || url END AS volid FROM pages)"
ENCODED = r"""enc AS (SELECT volid, array_to_string(list_transform(string_split(substr(volid, instr(volid, '.') + 1), ''), lambda c:
    CASE WHEN regexp_full_match(c, '["*+,<=>?\\^|]|[^\x21-\x7e]')
         THEN regexp_replace(lower(hex(encode(c))), '(..)', '^\1', 'g') ELSE c END), '') AS e
  FROM ids WHERE contains(volid, '.')),
path AS (SELECT volid, translate(e, '/:.', '=+,') AS p, split_part(volid, '.', 1) AS lib FROM enc)"""


def ids(spark, sf):
    """URLs as awkward ids; every tenth has no library prefix."""
    return table(spark, sf, "pages").select(
        F.when(F.col("page_id") % 10 == 0, F.replace("url", F.lit("."), F.lit("")))
        .otherwise(F.concat(F.lit("lib."), F.col("url"))).alias("volid"))


@query("volume_path", rf"""WITH {IDS}, {ENCODED}
    SELECT ids.volid, lib || '/pairtree_root/' || array_to_string(regexp_extract_all(p, '.{{1,2}}'), '/')
           || '/' || p || '/' || p || '.mets.xml' AS path
    FROM (SELECT DISTINCT volid FROM ids) ids LEFT JOIN (SELECT DISTINCT * FROM path) path ON ids.volid = path.volid""")
def paths(spark, sf):
    return ids(spark, sf).distinct().select("volid", volume_path(F.col("volid")).alias("path"))


@query("quarantine_volume_ids", f"""WITH {IDS}
    SELECT volid, CAST(NULL AS VARCHAR) AS seq, 'load' AS stage, 'volume id does not parse' AS error
    FROM ids WHERE NOT regexp_full_match(volid, '[^.\\s]+\\..+')
    UNION ALL
    SELECT volid, NULL, 'load', 'volume not found' FROM ids
    WHERE regexp_full_match(volid, '[^.\\s]+\\..+') AND substr(volid, 5) NOT IN (SELECT url FROM pages WHERE length(html) > 1000)""")
def quarantine_volume_ids(spark, sf):
    loaded = table(spark, sf, "pages").where(F.length("html") > 1000).select(
        F.concat(F.lit("lib."), F.col("url")).alias("volid"))
    return quality.split_volume_ids(ids(spark, sf), loaded)[1]


def mets(spark, sf):
    """A metadata document per conversation; those with few pages are cut off."""
    files = F.concat(
        F.lit('<METS:file MIMETYPE="text/plain" SEQ="'),
        F.lpad(F.col("turn").cast("string"), 8, "0"), F.lit('"/>'))
    per = table(spark, sf, "conversations").groupBy("conv_id").agg(
        F.array_join(F.array_sort(F.collect_list(files)), "").alias("f"), F.max("turn").alias("m"))
    xml = F.concat(
        F.lit('<METS:mets xmlns:METS="http://www.loc.gov/METS/"><METS:fileSec>'
              '<METS:fileGrp USE="image"><METS:file MIMETYPE="image/jp2" SEQ="00000099"/></METS:fileGrp>'
              '<METS:fileGrp USE="ocr">'), F.col("f"),
        F.when(F.col("m") % 2 == 0, '<METS:file MIMETYPE="text/xml" SEQ="00000098"/>').otherwise(""),
        F.lit("</METS:fileGrp></METS:fileSec></METS:mets>"))
    return per.withColumn("x", xml).select(
        F.concat(F.lit("lib."), F.col("conv_id").cast("string")).alias("id"),
        F.when(F.col("m") <= 2, F.expr("left(x, 60)")).otherwise(F.col("x")).alias("xml"))


LAST = """SELECT 'lib.' || CAST(conv_id AS VARCHAR) AS id, CAST(max(turn) AS INTEGER) AS last_seq
  FROM conversations GROUP BY conv_id HAVING max(turn) > 2"""


@query("volume_last_seq", LAST)
def volume_last_seq(spark, sf):
    return vo.volume_last_seq(mets(spark, sf))


@query("volume_last_seq_strict", LAST + " AND max(turn) % 2 = 1")
def volume_last_seq_strict(spark, sf):
    return vo.volume_last_seq(mets(spark, sf), strict=True)


@query("volume_info", """SELECT id, last_seq FROM (""" + LAST + """)
    WHERE id IN (SELECT 'lib.' || CAST(doc_id AS VARCHAR) FROM labels)""")
def volume_info(spark, sf):
    """Listed ids, their storage path, and the metadata file found there."""
    files = mets(spark, sf).select(volume_path(F.col("id")).alias("path"), "xml")
    wanted = table(spark, sf, "labels").select(
        F.concat(F.lit("lib."), F.col("doc_id").cast("string")).alias("volid"))
    return jobs.volume_info(wanted, files)
