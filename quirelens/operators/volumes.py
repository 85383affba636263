"""Volume-level facts from structural metadata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirelens.functions.ids import volume_path

_FILE = "array<struct<_MIMETYPE: string, _SEQ: string>>"
# Levels of file groups that are read at least; deeper documents ask for more.
DEPTH = 8
_GROUP_TAG = r"</?(?:[\w.-]+:)?fileGrp(?=[\s/>])[^>]*>"
# What may follow the root element: white space, comments, processing instructions.
_AFTER = r"(?:\s|<!--(?:(?!-->)[\s\S])*-->|<\?(?:(?!\?>)[\s\S])*\?>)*"


def _group(depth: int) -> str:
    inner = f", fileGrp: array<{_group(depth - 1)}>" if depth > 1 else ""
    return f"struct<_USE: string, file: {_FILE}{inner}>"


def _all_groups(groups: Column, depth: int) -> Column:
    """File groups of every level as ``(use, file)``, in document order."""
    flat = f"array<struct<use: string, file: {_FILE}>>"

    def one(g: Column) -> Column:
        own = F.array(F.struct(g["_USE"].alias("use"), g["file"].alias("file")))
        if depth == 1:
            return own
        return F.concat(own, F.coalesce(_all_groups(g["fileGrp"], depth - 1), F.array().cast(flat)))

    return F.flatten(F.transform(groups, one))


def well_ended(xml: Column) -> Column:
    """Whether nothing but white space, comments and instructions follows the root element."""
    root = F.regexp_extract(xml, r"<([A-Za-z_][\w:.-]*)[\s/>]", 1)
    quoted = F.concat(F.lit("\\Q"), root, F.lit("\\E"))
    # up to the first end of the root where it stands once, else up to the last
    once = F.regexp_count(xml, F.concat(F.lit("<"), quoted, F.lit(r"[\s/>]"))) == 1
    tail = F.when(
        once, F.regexp_replace(xml, F.concat(F.lit(r"^[\s\S]*?</"), quoted, F.lit(r"\s*>")), F.lit(""))
    ).otherwise(F.regexp_replace(xml, F.concat(F.lit(r"^[\s\S]*</"), quoted, F.lit(r"\s*>")), F.lit("")))
    return tail.rlike(f"^{_AFTER}$")


def group_levels(xml: Column) -> Column:
    """How deep the tags of file groups are nested; never less than the document's levels."""
    start = F.struct(F.lit(0).alias("open"), F.lit(0).alias("most"))

    def walk(state: Column, tag: Column) -> Column:
        closing = F.startswith(tag, F.lit("</"))
        inside = F.when(closing, state["open"] - 1).otherwise(state["open"] + 1)
        after = F.when(F.endswith(tag, F.lit("/>")), state["open"]).otherwise(inside)
        return F.struct(after.alias("open"), F.greatest(state["most"], inside).alias("most"))

    tags = F.regexp_extract_all(xml, F.lit(_GROUP_TAG), F.lit(0))
    return F.aggregate(tags, start, walk, lambda state: state["most"])


def mets_last_seq(xml: Column, strict: bool = False, depth: int = DEPTH) -> Column:
    """SEQ of the last plain-text file in the OCR file group, on whatever level it is.

    Null when the document does not parse, goes on after its root element or has no such
    file.  ``strict`` accepts the file only if it is the last of any type in its group.
    ``depth`` levels of groups are read.
    """
    schema = f"fileSec struct<fileGrp: array<{_group(depth)}>>"
    whole = F.when(well_ended(xml), xml)
    parsed = F.from_xml(whole, F.lit(schema), {"ignoreNamespace": "true", "mode": "PERMISSIVE"})
    nested = _all_groups(parsed["fileSec"]["fileGrp"], depth)
    ocr = F.filter(nested, lambda g: (g["use"] == "ocr") & g["file"].isNotNull())

    def plain(files: Column) -> Column:
        return F.filter(files, lambda f: f["_MIMETYPE"] == "text/plain")

    if strict:
        picked = F.transform(ocr, lambda g: plain(F.slice(g["file"], -1, 1)))
        # the first group whose last file is plain text
        hits = F.flatten(picked)
        seq = F.get(hits, F.lit(0))["_SEQ"]
    else:
        filled = F.filter(F.transform(ocr, lambda g: plain(g["file"])), lambda f: F.size(f) > 0)
        seq = F.try_element_at(F.get(filled, F.lit(0)), F.lit(-1))["_SEQ"]
    return seq.try_cast("int")


def volume_last_seq(mets: DataFrame, strict: bool = False) -> DataFrame:
    """``(id, last_seq)`` for every volume whose metadata gives a page number.

    Groups of any depth are read: the deepest document says how many levels there are.
    """
    levels = mets.agg(F.max(group_levels(F.col("xml")))).first()[0] or 0
    seq = mets_last_seq(F.col("xml"), strict, max(DEPTH, levels))
    parsed = mets.select("id", F.explode(F.array(seq)).alias("last_seq"))
    return parsed.where(F.col("last_seq").isNotNull())


def locate_mets(ids: DataFrame, files: DataFrame) -> DataFrame:
    """``(id, xml)``: the metadata file of each id, null when it is missing.

    ``ids(volid)``; ``files(path, xml)`` with paths relative to the tree root.
    """
    wanted = ids.select(F.col("volid").alias("id"), volume_path(F.col("volid")).alias("path"))
    known = F.col("path").isNotNull()
    without = wanted.where(~known).select("id", F.lit(None).cast("string").alias("xml"))
    return (
        wanted.where(known).join(files, "path", "left").select("id", "xml").unionByName(without)
    )
