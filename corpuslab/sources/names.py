"""Names of files and of the folders they lie in."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def source_name(named_by: str = "file") -> Column:
    """The name of the file a row comes from, or of its folder.

    Of a folder written by partition (``run=a``) the name is what follows the
    equals sign.
    """
    if named_by == "file":
        return F.col("_metadata.file_name")
    if named_by != "folder":
        raise ValueError("named_by is 'file' or 'folder'")
    folder = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2)
    return F.url_decode(F.regexp_replace(folder, "^[^=]*=", ""))
