"""Files, directories and archives as rows."""

from __future__ import annotations

import io
import zipfile

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# fixed values: extensions by how their content is read
TEXT_EXTENSIONS = (
    ".java .groovy .cpp .c .h .hpp .cs .py .pl .pm .ksh .sh .bat .cmd .js .css .jsp .jspf .pcpp .pc .esql .idl .cc .tcl .awk .cgi .bsh .cbl "
    ".sql .ctl .csv .dat .xml .html .htm .xsl .xsd .dtd .xhtml .tld .properties .conf .cfg .ini .pro .mf .classpath .project .prefs .launch "
    ".component .jsf .policy .config .profile .stb .txt .rtf .md .tex .log .mak .mk .make .in .dsp .dsw .sln .mki .defs .apt .tst .txtjet .rdr "
    ".udr .drr .inc .rc .def .dep .err .out .msg .cat .ext .apl .qrp"
).split()
BINARY_EXTENSIONS = (
    ".class .o .obj .dll .so .exe .jar .war .ear .a .lib .pch .idb .pdb .ncb .ilk .sbr .exp .gif .jpg .jpeg .png .bmp .ico .svg .ttf .wav .swf "
    ".au .zip .gz .tar .bz2 .rar"
).split()
DOCUMENT_EXTENSIONS = ".doc .docx .pdf .xls .xlsx .ppt .pptx .xlsm .vsd .odp".split()
MAX_TEXT_BYTES = 1 << 20


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(file_name(path), r"(\.[^.]+)$", 1))


def dir_scan(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """All files below a directory: ``path, file_name, extension, size_bytes, content``.

    A directory without files gives no rows; a directory that is not there is an error.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    p = F.col("path")
    return raw.select("path", file_name(p).alias("file_name"), extension(p).alias("extension"), F.col("length").alias("size_bytes"), "content")


ENTRY_SCHEMA = "archive string, file_path string, file_name string, extension string, size_bytes long, content binary, problem string"
_NAMES = [x.split()[0] for x in ENTRY_SCHEMA.split(", ")]


def archive_entries(files: DataFrame, max_entry_bytes: int = 64 << 20) -> DataFrame:
    """Entries of ZIP archives, one row each; damaged archives, too large entries and archive
    kinds that cannot be read here (RAR, 7z) give a row that names the problem.

    An archive is unpacked in memory by one task, entry after entry.
    """

    def one(path: str, data: bytes):
        if path.lower().endswith((".rar", ".7z")):
            yield path, None, None, None, None, None, "unsupported archive kind"
            return
        try:
            with zipfile.ZipFile(io.BytesIO(data)) as z:
                for e in z.infolist():
                    if e.is_dir():
                        continue
                    name = e.filename.rsplit("/", 1)[-1]
                    ext = "." + name.rsplit(".", 1)[-1].lower() if "." in name else ""
                    if e.file_size > max_entry_bytes:
                        yield path, e.filename, name, ext, e.file_size, None, "entry too large"
                        continue
                    try:
                        yield path, e.filename, name, ext, e.file_size, z.read(e), None
                    except (zipfile.BadZipFile, NotImplementedError, RuntimeError, OSError) as x:
                        yield path, e.filename, name, ext, e.file_size, None, f"{type(x).__name__}: {x}"
        except zipfile.BadZipFile as x:
            yield path, None, None, None, None, None, f"BadZipFile: {x}"

    def run(frames):
        for f in frames:
            for p, c in zip(f["path"], f["content"], strict=True):
                yield pd.DataFrame(list(one(p, bytes(c))), columns=_NAMES)

    return files.select("path", "content").mapInPandas(run, ENTRY_SCHEMA)


def is_binary(content: Column) -> Column:
    """A NUL byte among the first 512 bytes."""
    head = F.hex(F.substring(content, 1, 512))
    return F.coalesce(head.rlike(r"^(?:..)*00"), F.lit(False))


def decode(content: Column, limit: int = MAX_TEXT_BYTES) -> Column:
    """UTF-8 text of the first ``limit`` bytes, ISO-8859-1 if they are no UTF-8.

    A character that the limit cuts in two is dropped.
    """
    cut = F.substring(content, 1, limit)
    trimmed = lambda n: F.substring(content, 1, limit - n)
    out = F.decode(cut, "ISO-8859-1")
    for n in (3, 2, 1):
        out = F.when((F.octet_length(content) > limit) & F.is_valid_utf8(trimmed(n).cast("string")), trimmed(n).cast("string")).otherwise(out)
    return F.when(F.is_valid_utf8(cut.cast("string")), cut.cast("string")).otherwise(out)


def strategy(ext: Column, content: Column) -> Column:
    """TEXT, DOCUMENT, BINARY or, for unknown extensions, what the bytes look like."""
    return (
        F.when(ext.isin(*TEXT_EXTENSIONS), "TEXT")
        .when(ext.isin(*DOCUMENT_EXTENSIONS), "DOCUMENT")
        .when(ext.isin(*BINARY_EXTENSIONS), "BINARY")
        .when(is_binary(content), "BINARY")
        .otherwise("TEXT")
    )


def extract_text(files: DataFrame) -> DataFrame:
    """Adds ``strategy`` and ``text``; office documents get a placeholder, PDF and binaries NULL."""
    s = strategy(F.col("extension"), F.col("content"))
    placeholder = F.concat(F.lit("[document "), F.col("file_name"), F.lit(", "), F.col("size_bytes").cast("string"), F.lit(" bytes]"))
    text = F.when(F.col("strategy") == "TEXT", decode(F.col("content"))).when((F.col("strategy") == "DOCUMENT") & (F.col("extension") != ".pdf"), placeholder)
    return files.withColumn("strategy", s).withColumn("text", text)


def gold_queries(spark: SparkSession, path: str) -> DataFrame:
    """Labelled queries in JSON lines, with a declared schema; broken lines are kept apart."""
    schema = "qid string, class string, lang string, query string, ticket string, synthetic boolean, known_gap boolean, labels array<struct<doc:string,rel:int>>, split string, _corrupt_record string"
    return spark.read.schema(schema).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").json(path)


def gold_labels(queries: DataFrame) -> DataFrame:
    return queries.select("qid", F.explode("labels").alias("l")).select("qid", F.col("l.doc").alias("doc"), F.col("l.rel").alias("grade"))


def gold_problems(queries: DataFrame) -> DataFrame:
    """What is wrong with a gold set: ``qid, problem``."""
    twice = queries.groupBy("qid").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("qid", F.lit("qid occurs twice").alias("problem"))
    checks = F.array(
        F.when(F.col("qid").isNull() | (F.trim("qid") == ""), F.lit("no qid")),
        F.when(F.coalesce(F.trim("query"), F.lit("")) == "", F.lit("no query")),
        F.when(~F.coalesce(F.col("class").isin("K", "Q", "P", "T", "X"), F.lit(False)), F.lit("unknown class")),
        F.when(~F.coalesce(F.col("split").isin("dev", "test"), F.lit(False)), F.lit("unknown split")),
        F.when(~F.coalesce(F.col("lang").isin("en", "pl", "pl-ascii", "mix"), F.lit(False)), F.lit("unknown language")),
        F.when(F.exists(F.coalesce("labels", F.array()), lambda l: F.coalesce(F.trim(l["doc"]), F.lit("")) == ""), F.lit("label without document")),
        F.when(F.exists(F.coalesce("labels", F.array()), lambda l: ~l["rel"].between(0, 3)), F.lit("grade out of range")),
    )
    return queries.select("qid", F.explode(F.filter(checks, lambda p: p.isNotNull())).alias("problem")).unionByName(twice)
