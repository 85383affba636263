from pyspark.sql import functions as F

from quirelens.operators import volumes


def group(use, files, inner=""):
    rows = "".join(f'<file MIMETYPE="{m}" SEQ="{s}"/>' for m, s in files)
    return f'<METS:fileGrp USE="{use}">{rows}{inner}</METS:fileGrp>'.replace("<file", "<METS:file").replace("METS:METS", "METS").replace("<METS:fileGrp", "<METS:fileGrp")


def mets(groups, tail=""):
    return f'<?xml version="1.0"?><METS:mets xmlns:METS="urn:m"><METS:fileSec>{groups}</METS:fileSec></METS:mets>{tail}'


def test_any_depth_and_damage(spark):
    ocr = group("ocr", [("text/plain", "00000006"), ("text/plain", "00000007")])
    deep = group("a", [], group("b", [], group("c", [("image/jp2", "1")], ocr)))
    rows = {
        "flat": (mets(ocr), 7),
        "deep": (mets(deep), 7),
        "comment": (mets(ocr, "\n<!-- end --> <?pi x?>\n"), 7),
        "text after": (mets(ocr, "junk"), None),
        "element after": (mets(ocr, "<x></x>"), None),
        "second root": (mets(ocr, "</METS:mets>"), None),
        "cut": (mets(ocr)[:-20], None),
        "none": (mets(group("image", [("text/plain", "3")])), None),
        "null": (None, None),
        "empty": ("", None),
    }
    df = spark.createDataFrame([(k, x) for k, (x, _) in rows.items()], "id string, xml string")
    got = {r.id: r.n for r in df.select("id", volumes.mets_last_seq(F.col("xml")).alias("n")).collect()}
    assert got == {k: n for k, (_, n) in rows.items()}
