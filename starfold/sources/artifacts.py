"""Definition files: folder scans, and what kind of definition each file holds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# Suffixes of candidate files.
SUFFIXES = ["xml", "json", "module", "dashboard", "exploration", "spec", "cpf"]

# Kind by suffix, where the content does not tell.
KIND_BY_SUFFIX = {
    "json": "module", "module": "module", "dashboard": "dashboard", "exploration": "dashboard",
    "cpf": "model", "fm": "model", "xml": "report", "spec": "report", "txt": "report",
}

# What may stand before the root element of an XML document, and the start tag of the root.
_XML_PROLOG = r"(?s)<!--.*?-->|<\?.*?\?>"
_XML_ROOT = r"<([A-Za-z_][^>]*)"


def suffix_of(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./\\]+)$", 1))


def candidates(artifacts: DataFrame) -> DataFrame:
    """Artifacts with a known suffix."""
    return artifacts.filter(suffix_of(F.col("path")).isin(SUFFIXES))


def scan_folder(spark: SparkSession, folder: str, recursive: bool = True) -> DataFrame:
    """Candidate files of a folder as (path, content), one row per file.

    The suffix is part of the file listing, so other files are never opened. Names that start with a dot
    or an underscore are skipped, as Spark's listing does; ``skipped_files`` names them. Bytes that are not UTF-8 are replaced.
    """
    any_case = lambda word: "".join(f"[{c.lower()}{c.upper()}]" for c in word)
    files = (spark.read.format("binaryFile")
             .option("recursiveFileLookup", str(recursive).lower())
             .option("pathGlobFilter", "*.{" + ",".join(any_case(s) for s in SUFFIXES) + "}")
             .load(folder))
    return files.select("path", F.make_valid_utf8(F.col("content").cast("string")).alias("content"))


def skipped_files(spark: SparkSession, folder: str, recursive: bool = True) -> DataFrame:
    """Candidate files that ``scan_folder`` does not read, as findings: their names or folders are hidden.

    The store lists names, a page at a time; only hidden candidates are kept. Unfinished writes are no files yet.
    """
    place = spark._jvm.org.apache.hadoop.fs.Path(folder)
    store = place.getFileSystem(spark._jsc.hadoopConfiguration())
    base = store.makeQualified(place).toString()
    files, found = store.listFiles(place, recursive), []
    while files.hasNext():
        path = files.next().getPath().toString()
        names = path[len(base):].strip("/").split("/")
        hidden = any(n.startswith(".") or n.startswith("_") and "=" not in n for n in names)
        if hidden and "." in names[-1] and names[-1].rpartition(".")[2].lower() in SUFFIXES and "_temporary" not in names:
            found.append((path, "file-skipped", "warning", names[-1]))
    return spark.createDataFrame(sorted(found), "path string, code string, severity string, source_ref string")


def artifact_kind(path: Column, content: Column) -> Column:
    """report, model, module, dashboard or unknown: from the content first, then from the suffix.

    XML is known by its root element, whatever comments and declarations stand before it.
    """
    text = F.regexp_replace(content, r"^\s+", "")
    first = F.substring(text, 1, 1)
    keys = F.transform(F.json_object_keys(text), F.lower)
    has_key = lambda *names: F.coalesce(F.arrays_overlap(keys, F.array(*[F.lit(n) for n in names])), F.lit(False))
    lowered = F.lower(text)
    quoted = lambda name: lowered.contains(f'"{name}"')
    by_json = (F.when(has_key("widgets", "layout"), "dashboard")
               .when(has_key("querysubject", "relationship"), "module")
               .when(quoted("widgets") | quoted("layout"), "dashboard")
               .when(quoted("querysubject"), "module"))
    body = F.lower(F.regexp_replace(text, _XML_PROLOG, ""))
    root = F.regexp_extract(body, _XML_ROOT, 1)
    by_xml = F.when(root.rlike(r"^([a-z0-9_.\-]+:)?project\b") | root.contains("/bmt/") | body.contains("<querysubject"),
                    "model").otherwise("report")
    by_suffix = F.lit("unknown")
    for suffix, kind in KIND_BY_SUFFIX.items():
        by_suffix = F.when(suffix_of(path) == suffix, kind).otherwise(by_suffix)
    by_content = F.when(first.isin("{", "["), by_json).when(first == "<", by_xml)
    return F.coalesce(by_content, by_suffix)


def with_status(artifacts: DataFrame) -> DataFrame:
    """Add ``kind``, ``status`` and ``error``. A file that cannot be read is a row, not an abort."""
    kind = F.col("kind")
    is_json = kind.isin("module", "dashboard")
    no_object = F.json_object_keys("content").isNull()
    no_element = ~F.col("content").rlike(r"<[A-Za-z_]")
    error = (F.when(kind == "unknown", "the kind of definition could not be determined")
             .when(is_json & F.try_parse_json("content").isNull(), "not valid JSON")
             .when(is_json & no_object, "the JSON is not an object")
             .when(~is_json & no_element, "not an XML document"))
    kinds = artifacts.withColumn("kind", artifact_kind(F.col("path"), F.col("content")))
    return kinds.withColumn("error", error).withColumn(
        "status", F.when(F.col("error").isNull(), "ok").otherwise("failed"))
