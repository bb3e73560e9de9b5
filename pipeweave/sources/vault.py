"""A folder of Markdown documents as cards, and the links among them as edges.

A card is one file: its name (the file's stem), title (of the header, else the first heading, else
the name), path below the folder, format (the file's extension), header (the fields between two
``---`` lines at the top) and body. Links are ``[[name]]``, ``[[name|shown]]`` and ``[[name#part]]``.
Everything is a Column expression over whole files; cards come in the order of a sorted walk.
Spark's file sources pass over files of no bytes, so these are no cards.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pipeweave.operators.rel import Rel

_HEADER = r"(?s)\A---[ \t]*\r?\n(.*?)(?:\r?\n)?---[ \t]*(?:\r?\n|\z)"
_FIELD = r"(?m)^([A-Za-z_][\w .-]*?)[ \t]*:[ \t]*(.*?)[ \t]*\r?$"
_LINK = r"\[\[([^\[\]|#]+)[^\[\]]*\]\]"


def cards(spark: SparkSession, folder: str, pattern: str = "*.{md,hmd}") -> Rel:
    """``name``, ``title``, ``path``, ``format``, ``header`` (map of texts) and ``body`` of every document."""
    files = spark.read.text(folder, wholetext=True, recursiveFileLookup=True, pathGlobFilter=pattern)
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    root = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(root).toUri().getPath().rstrip("/")
    # file names come as a URI: percent-encoded, with a scheme
    place = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    path = F.substring_index(place, f"{root}/", -1)
    raw = files.select(path.alias("path"), F.coalesce("value", F.lit("")).alias("t"))
    head = F.regexp_extract("t", _HEADER, 1)
    pairs = F.arrays_zip(F.regexp_extract_all(head, F.lit(_FIELD), F.lit(1)).alias("k"), F.regexp_extract_all(head, F.lit(_FIELD), F.lit(2)).alias("v"))
    # of a field given twice, the first holds
    firsts = F.filter(pairs, lambda p, i: F.array_position(F.transform(pairs, lambda q: q["k"]), p["k"]) == i + 1)
    unquoted = F.transform(firsts, lambda p: F.struct(p["k"].alias("key"), F.regexp_replace(p["v"], r"""^(["'])(.*)\1$""", "$2").alias("value")))
    file = F.substring_index("path", "/", -1)
    out = raw.select("path", F.regexp_replace(file, r"\.[^.]*$", "").alias("name"), F.substring_index(file, ".", -1).alias("format"), F.map_from_entries(unquoted).alias("header"), F.regexp_replace("t", _HEADER, "").alias("body"))
    heading = F.nullif(F.trim(F.regexp_extract("body", r"(?m)^#{1,6}[ \t]+(.+?)[ \t]*#*[ \t]*\r?$", 1)), F.lit(""))
    title = F.coalesce(F.nullif(F.try_element_at("header", F.lit("title")), F.lit("")), heading, F.col("name"))
    return Rel.of(out.select("name", title.alias("title"), "path", "format", "header", "body"), F.split("path", "/"))


def links(found: DataFrame) -> DataFrame:
    """An edge for each distinct link: ``source``, ``target`` and ``state``.

    A target is the name of a card, or its path without extension where names repeat. ``state`` is
    ``card``, ``forward`` (no such card yet) or ``ambiguous`` (several cards; the target stays as written).
    """
    whole = F.regexp_replace("path", r"\.[^.]*$", "")
    written = found.select(F.col("name").alias("source"), F.explode(F.regexp_extract_all("body", F.lit(_LINK), F.lit(1))).alias("target"))
    written = written.select("source", F.trim(F.regexp_replace("target", r"\.h?md\s*$", "")).alias("target")).where("target <> ''").distinct()
    spelled = found.select(F.explode(F.array_distinct(F.array("name", whole))).alias("written"), "name", "path")
    known = spelled.groupBy("written").agg(F.count(F.lit(1)).alias("n"), F.min("name").alias("card"))
    out = written.join(known, F.col("target") == F.col("written"), "left")
    state = F.when(F.col("n").isNull(), "forward").when(F.col("n") > 1, "ambiguous").otherwise("card")
    return out.select("source", F.when(state == "card", F.col("card")).otherwise(F.col("target")).alias("target"), state.alias("state")).distinct()
