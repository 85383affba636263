"""Volume identifiers and their storage paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value (published Pairtree note): characters written as ^hh per UTF-8 byte.
_RESERVED = r"""["*+,<=>?\\^|]|[^\x21-\x7e]"""


def encode_id(pid: Column) -> Column:
    """Pairtree encoding: reserved characters as ``^hh``, then ``/:.`` as ``=+,``."""
    chars = F.regexp_extract_all(pid, F.lit("(?s)."), F.lit(0))
    escaped = F.transform(
        chars,
        lambda c: F.when(
            c.rlike(f"^(?:{_RESERVED})$"),
            F.regexp_replace(F.lower(F.hex(c)), "(..)", "^$1"),
        ).otherwise(c),
    )
    return F.translate(F.array_join(escaped, ""), "/:.", "=+,")


def volume_path(volid: Column) -> Column:
    """``lib.pid`` -> ``lib/pairtree_root/ab/cd/abcd/abcd.mets.xml``; null when there is no dot."""
    parts = F.split(volid, r"\.", 2)
    lib, pid = F.get(parts, F.lit(0)), F.get(parts, F.lit(1))
    enc = encode_id(pid)
    shards = F.array_join(F.regexp_extract_all(enc, F.lit(".{1,2}"), F.lit(0)), "/")
    return F.when(
        valid_volume_id(volid),
        F.concat_ws(
            "/", lib, F.lit("pairtree_root"), shards, enc, F.concat(enc, F.lit(".mets.xml"))
        ),
    )


def valid_volume_id(volid: Column) -> Column:
    """A library prefix, a dot and a non-empty local part."""
    return F.coalesce(volid.rlike(r"(?s)^[^.\s]+\..+$"), F.lit(False))


# Folders of a page store are named by this and their number.
BUCKET = "bucket_of_"


def page_bucket(volid: Column, buckets: int) -> Column:
    """Folder of a page store that holds a volume."""
    return F.pmod(F.xxhash64(volid), F.lit(buckets)).cast("int")
