"""Package files as DataFrames: inventory, delimited tables, texts, JSON, and gaps for formats that can't be read here."""

from __future__ import annotations

import csv
import importlib.util
import io

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Formats that need a library; without it a file gives a coverage gap instead of rows.
NEEDS = {"xlsx": "openpyxl", "pdf": "pypdf", "png": "PIL", "jpg": "PIL", "jpeg": "PIL", "tif": "PIL", "tiff": "PIL", "bmp": "PIL", "webp": "PIL"}
SNIFF_BYTES, DELIMITERS = 8192, ",;\t"


def _binary(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root)


def inventory(spark: SparkSession, root: str) -> DataFrame:
    """(path, extension, size_bytes, sha256) of every file below ``root``, hidden ones left out. Spark's source skips files without content, so they are missing."""
    path = F.regexp_replace("path", "^[a-z]+:/*", "/")
    rel = F.regexp_replace(path, F.lit("^" + root.rstrip("/").removeprefix("file://") + "/"), F.lit(""))
    files = _binary(spark, root).select(rel.alias("path"), F.col("length").alias("size_bytes"), F.sha2("content", 256).alias("sha256"))
    return files.where(~F.col("path").rlike(r"(^|/)\.")).select("path", F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).alias("extension"), "size_bytes", "sha256")


def sniff(text: str) -> str:
    """The delimiter of a table among ``, ; tab`` from its first lines; a comma if none parts them evenly."""
    lines = [x for x in text[:SNIFF_BYTES].splitlines() if x.strip()][:20]
    best, most = ",", 0
    for d in DELIMITERS:
        counts = {len(next(csv.reader([line], delimiter=d))) for line in lines}
        if len(counts) == 1 and (n := counts.pop()) > max(1, most):
            best, most = d, n
    return best


def delimited(spark: SparkSession, root: str, sniffed: bool = True) -> DataFrame:
    """(file, row_idx, col, col_pos, raw) of all .csv and .tsv files below ``root``, as text.

    A .tsv is split at tabs; a .csv at the sniffed delimiter, or at commas if not ``sniffed``. Rows are numbered from 2, after
    the header; header names are trimmed and lower-cased with blanks and hyphens as underscores; a byte order mark is
    dropped; an empty file gives no rows; cells beyond the header are left out.
    """

    def run(batches):
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                text = content.decode("utf-8-sig", "replace")
                d = "\t" if path.lower().endswith(".tsv") else sniff(text) if sniffed else ","
                rows = csv.reader(io.StringIO(text), delimiter=d)
                head = [h.strip().lower().replace(" ", "_").replace("-", "_") for h in next(rows, [])]
                cells = [(path, i, h, k, v) for i, row in enumerate(rows, 2) for k, (h, v) in enumerate(zip(head, row, strict=False))]
                if cells:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*cells, strict=True), (pa.string(), pa.int64(), pa.string(), pa.int32(), pa.string()), strict=True)], ["file", "row_idx", "col", "col_pos", "raw"])

    tables = _binary(spark, root, "*.{csv,tsv,CSV,TSV}").select("path", "content")
    return tables.mapInArrow(run, "file string, row_idx bigint, col string, col_pos int, raw string")


def texts(spark: SparkSession, root: str) -> DataFrame:
    """(path, text) of .txt and .md files, and of .pdf files that are plain text in truth; bad bytes are left out."""
    f = _binary(spark, root, "*.{txt,md,pdf}")
    plain = ~F.lower("path").endswith(".pdf") | (F.substring("content", 1, 5) != F.lit(b"%PDF-"))

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array([c.decode("utf-8", "ignore") for c in batch.column("content").to_pylist()])], ["path", "text"])

    return f.where(plain).select("path", "content").mapInArrow(run, "path string, text string")


def gaps(files: DataFrame) -> DataFrame:
    """(path, reason) of an inventory()'s files whose format can't be read with the libraries at hand."""
    lacking = [e for e, lib in NEEDS.items() if importlib.util.find_spec(lib) is None]
    return files.where(F.col("extension").isin(*lacking)).select("path", F.concat(F.lit("no reader for ."), "extension").alias("reason"))


def json_records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Records of JSON or JSON-lines files; ``_corrupt_record`` of the schema, if it is there, takes what doesn't parse."""
    return spark.read.schema(schema).option("multiLine", not path.endswith(".jsonl")).json(path)


def eight_bit(pixels: np.ndarray) -> np.ndarray:
    """A matrix of any number type stretched to 0..255 between the 1st and 99th percentile of its finite values; black if it is flat."""
    x = np.asarray(pixels, float)
    finite = x[np.isfinite(x)]
    if not finite.size:
        return np.zeros(x.shape, np.uint8)
    lo, hi = np.percentile(finite, (1, 99))
    if hi <= lo:
        lo, hi = finite.min(), finite.max()
    if hi <= lo:
        return np.zeros(x.shape, np.uint8)
    return (np.clip((np.nan_to_num(x, nan=lo, posinf=hi, neginf=lo) - lo) / (hi - lo), 0, 1) * 255).round().astype(np.uint8)


def phrase_results(phrases: DataFrame, fixture: DataFrame) -> DataFrame:
    """(phrase, key) of a phrase search over a fixture of (pos, key): the equal key, else the first of which one contains the other.

    The fixture is a test stand-in for an online service; it is joined by containment, so keep it small.
    """
    near = phrases.join(fixture, F.col("key").contains(F.col("phrase")) | F.col("phrase").contains(F.col("key")))
    return near.groupBy("phrase").agg(F.min_by("key", F.struct((F.col("key") != F.col("phrase")).cast("int"), "pos")).alias("key"))
