"""Reading labelled corpora and raw documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from veriscope.functions import text as tx
from veriscope.session import staged

RECORD = StructType([
    StructField("text", StringType()), StructField("label", IntegerType()), *(StructField(n, StringType()) for n in "source doc_id version collected_at published_at report_date file company_id split".split()),
])


def read_jsonl(spark: SparkSession, path: str, schema: StructType = RECORD) -> DataFrame:
    """Rows of JSON lines; a line that isn't JSON is an error."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def _require_content(spark: SparkSession, path: str) -> None:
    """Raises for a file without bytes, which Spark would pass over."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for f in fs.globStatus(p) or []:
        for g in fs.listStatus(f.getPath()) if f.isDirectory() else [f]:
            if g.isFile() and g.getLen() == 0 and not g.getPath().getName().startswith(("_", ".")):
                raise ValueError(f"{g.getPath()} is empty")


def read_json(spark: SparkSession, path: str, schema: StructType = RECORD, row: str | None = None) -> DataFrame:
    """Records of files that hold one JSON value each: an array of records, ``{"records": [...]}``, or parallel arrays
    ``{"texts": [...], "labels": [...]}``; otherwise JSON lines. Files are read whole, so each must fit a task.

    An empty file raises at once, a blank one and arrays of different length when the rows are read. ``row`` names a column
    for each record's place, file and number, which orders the records alike however the files are split over tasks.
    """
    _require_content(spark, path)
    whole = spark.read.format("binaryFile").load(path).select("path", tx.strip(F.col("content").cast("string")).alias("v"))
    kind = schema.simpleString()
    wide = f"struct<records:array<{kind}>,texts:array<string>,labels:array<int>>"
    first = F.left("v", F.lit(1))
    parsed = whole.withColumn("_o", F.when(first == "{", F.from_json("v", wide))).withColumn("_a", F.when(first == "[", F.from_json("v", f"array<{kind}>")))
    columns = F.transform(F.arrays_zip(F.col("_o.texts").alias("t"), F.col("_o.labels").alias("l")), lambda x: F.struct(*((x["t"] if f.name == "text" else x["l"] if f.name == "label" else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema)))
    lines = F.transform(F.filter(F.split("v", "[\r\n]+"), lambda s: F.trim(s) != ""), lambda s: F.from_json(s, kind, {"mode": "FAILFAST"}))
    rows = (
        F.when(F.col("v") == "", F.raise_error(F.lit("the file is empty")).cast(f"array<{kind}>"))
        .when(F.col("_a").isNotNull(), F.col("_a"))
        .when(F.col("_o.records").isNotNull(), F.col("_o.records"))
        .when(F.col("_o.texts").isNotNull() & (F.size("_o.texts") != F.size("_o.labels")), F.raise_error(F.lit("texts and labels differ in length")).cast(f"array<{kind}>"))
        .when(F.col("_o.texts").isNotNull(), columns)
        .when((first == "{") & ~F.col("v").rlike("[\r\n]") & ~F.array_contains(F.coalesce(F.json_object_keys("v"), F.array().cast("array<string>")), "text"), F.raise_error(F.lit("an object without text, texts or records")).cast(f"array<{kind}>"))
        .otherwise(lines)
    )
    made = parsed.select("path", F.posexplode(rows).alias("i", "r"))
    place = F.concat_ws(":", "path", F.lpad(F.col("i").cast("string"), 12, "0"))
    return made.select("r.*", place.alias(row)) if row else made.select("r.*")


def require_labelled(df: DataFrame, index: str | None = None) -> DataFrame:
    """The rows; one without text or label raises when it is read, naming its ``index`` column if there is one."""
    which = F.concat(F.lit("record "), F.coalesce(F.col(index).cast("string"), F.lit("?"))) if index else F.lit("a record")
    return df.where(F.when(F.col("text").isNull() | F.col("label").isNull(), F.raise_error(F.concat(which, F.lit(" lacks text or label"))).cast("boolean")).otherwise(True))


def read_documents(spark: SparkSession, path: str, names: str = "*.{txt,pdf,docx,TXT,PDF,DOCX}", docx: bool = False) -> DataFrame:
    """(path, text, source_type, extraction_method, ocr_used, error) of the files below a folder whose names fit ``names``.

    Other files aren't opened. Bytes that aren't UTF-8 are dropped. With ``docx`` such files give their paragraphs and, row
    by row, their tables; without, as screening has it, they are an unsupported type.
    PDF text needs the optional ``fitz`` library; without it, as for an empty text or a broken file, ``text`` is null and
    ``error`` says why.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", names).load(path)
    name = F.lower("path")
    raw = F.replace(F.make_valid_utf8(F.col("content").cast("string")), F.lit("�"), F.lit(""))
    text = F.nullif(tx.strip(raw), F.lit(""))
    pdf = _pdf_text(F.when(name.endswith(".pdf"), F.col("content")))
    word = _docx_text(F.when(name.endswith(".docx"), F.col("content"))) if docx else F.lit(None)
    made = F.when(name.endswith(".txt"), text).when(name.endswith(".pdf"), pdf).when(name.endswith(".docx") & F.lit(docx), word)
    error = F.when(made.isNotNull(), F.lit(None)).when(name.endswith(".txt"), "the file is empty").when(name.endswith(".pdf"), "no text layer, or fitz isn't installed").when(name.endswith(".docx") & F.lit(docx), "no text, or not a document").otherwise("unsupported file type")
    return files.select("path", made.alias("text"), F.when(name.endswith(".pdf"), "pdf").when(name.endswith(".txt"), "txt").when(name.endswith(".docx") & F.lit(docx), "docx").otherwise("other").alias("source_type"), F.when(name.endswith(".pdf"), "text_layer").when(name.endswith(".txt"), "utf-8").when(name.endswith(".docx") & F.lit(docx), "xml").alias("extraction_method"), F.lit(False).alias("ocr_used"), error.cast("string").alias("error"))


def docx_text(content: bytes) -> str | None:
    """Paragraphs and tables of a document in order; a table's row is a line, its cells are parted by bars."""
    import io
    import zipfile
    from xml.etree import ElementTree

    w = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{w}body")
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError):
        return None
    words = lambda e: "".join("\t" if x.tag == f"{w}tab" else "\n" if x.tag == f"{w}br" else x.text or "" for x in e.iter() if x.tag in (f"{w}t", f"{w}tab", f"{w}br"))
    lines = []
    for e in body if body is not None else ():
        if e.tag == f"{w}p":
            lines.append(words(e))
        elif e.tag == f"{w}tbl":
            lines += [" | ".join(" ".join(words(p) for p in cell.iter(f"{w}p")).strip() for cell in row.iter(f"{w}tc")) for row in e.iter(f"{w}tr")]
    return "\n".join(lines).strip() or None


@F.pandas_udf(StringType())
def _docx_text(content):  # noqa: ANN001, ANN202
    import pandas as pd

    return pd.Series([docx_text(c) if c is not None else None for c in content], dtype=object)


def ingest(spark: SparkSession, path: str, out: str, done: DataFrame | None = None) -> DataFrame:
    """Parses the new files of a folder into ``out``/parsed and those that failed into ``out``/errors, both appended.

    ``done``: (path) of files processed before. Returns (source_type, suggested_review, files) of this run; null review: failed.
    """
    from veriscope.functions import parse

    found = read_documents(spark, path, docx=True)
    rows = staged(found if done is None else new_files(found, done, "path"), "ingest")
    rows.where("text is null").select("path", "source_type", "error").write.mode("append").json(f"{out}/errors")
    parsed = staged(parse.parse_documents(rows.where("text is not null").drop("error")), "parsed")
    parsed.write.mode("append").parquet(f"{out}/parsed")
    every = parsed.select("source_type", "suggested_review").unionByName(rows.where("text is null").select("source_type", F.lit(None).cast("boolean").alias("suggested_review")))
    return every.groupBy("source_type", "suggested_review").agg(F.count("*").alias("files"))


@F.pandas_udf(StringType())
def _pdf_text(content):  # noqa: ANN001, ANN202
    import pandas as pd

    try:
        import fitz
    except ImportError:
        return pd.Series([None] * len(content), dtype=object)
    out = []
    for c in content:
        text = "\n\n".join(p.get_text() for p in fitz.open(stream=c, filetype="pdf")).strip() if c is not None else ""
        out.append(text if len(text) >= 20 else None)  # shorter is a scan without a text layer
    return pd.Series(out, dtype=object)


def read_eval_csv(spark: SparkSession, path: str) -> DataFrame:
    """(id, source, label, text) by position; rows that can't be read are skipped, a byte order mark is ignored."""
    schema = "id string, source string, label string, text string"
    rows = spark.read.schema(schema).csv(path, header=True, multiLine=True, quote='"', escape='"', mode="DROPMALFORMED", enforceSchema=True)
    return rows.select(F.replace("id", F.lit("﻿"), F.lit("")).alias("id"), "source", F.col("label").try_cast("int").alias("label"), "text").where("label is not null and text is not null")


def new_files(found: DataFrame, done: DataFrame, key: str = "file") -> DataFrame:
    """Rows of files that weren't processed before."""
    return found.join(done.select(key).distinct(), key, "left_anti")
