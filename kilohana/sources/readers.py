"""Readers: pages of a table, word lists, name lists, overrides, whole texts, catalogues of links, aliases, JDBC stores."""

from __future__ import annotations

import io
import uuid
import zipfile
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kilohana.functions import text as T
from kilohana.session import shared_dir


def work_dir(spark: SparkSession) -> str:
    """Where intermediate files go: a folder of the run in the shared one."""
    return f"{shared_dir(spark)}/kilohana-{uuid.uuid4().hex}"


def keyset_page(df: DataFrame, key: str, after, size: int) -> DataFrame:
    return df.where(F.col(key) > after).orderBy(key).limit(size)


def offset_page(df: DataFrame, order: list, skip: int, size: int) -> DataFrame:
    return df.orderBy(*order).offset(skip).limit(size)


def word_list(lines: DataFrame) -> DataFrame:
    """(word) from (line): split at lines, commas and spaces, normalised, distinct, without a and i."""
    w = lines.select(F.explode(F.split("line", r"[\n, ]+")).alias("w"))
    return w.select(F.trim(T.ascii_lower(T.fold(F.col("w")))).alias("word")).where(~F.col("word").isin("", "a", "i")).distinct()


def name_counts(names: DataFrame) -> DataFrame:
    """(name, n) summed by the normalised name."""
    return names.groupBy(T.normalize_word_marks(F.col("name")).alias("name")).agg(F.sum("n").alias("n"))


def zipped_csv(spark: SparkSession, path: str) -> DataFrame:
    """(name, n) from zip files of ``name,kind,number`` lines; files that are no zips give nothing."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for raw in b.column(0).to_pylist():
                names, counts = [], []
                if zipfile.is_zipfile(io.BytesIO(raw)):
                    with zipfile.ZipFile(io.BytesIO(raw)) as z:
                        for member in z.namelist():
                            for line in z.read(member).decode("utf-8", "replace").splitlines():
                                part = line.rsplit(",", 2)
                                if len(part) == 3 and part[2].strip().isdigit():
                                    names.append(part[0])
                                    counts.append(int(part[2]))
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(counts, pa.int64())], ["name", "n"])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, "name string, n long")


def wikitext_names(lines: DataFrame) -> DataFrame:
    """(name, n) from (value): the linked names of table rows."""
    name = F.regexp_extract("value", r"^\|\|\s*\[\[([^\]|]+)", 1)
    return lines.select(F.trim(name).alias("name"), F.lit(1).cast("long").alias("n")).where("name <> ''")


def zip_texts(spark: SparkSession, plain: str, out: str) -> None:
    """Every text file of a folder as a zip file of one member. Files pass the driver one at a time."""
    fs = spark.sparkContext._jvm.org.apache.hadoop.fs
    to = fs.Path(out)
    files = to.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.mkdirs(to)
    for r in spark.read.format("binaryFile").load(plain).where("length > 0").select("path", "content").toLocalIterator():
        buf = io.BytesIO()
        with zipfile.ZipFile(buf, "w", zipfile.ZIP_DEFLATED) as z:
            z.writestr("names.txt", bytes(r["content"]))
        s = files.create(fs.Path(f"{out}/{r['path'].rsplit('/', 1)[1]}.zip"))
        s.write(bytearray(buf.getvalue()))
        s.close()


def feature_names(spark: SparkSession, path: str, multi: bool = True) -> DataFrame:
    """(name, n) from JSON documents of features with attributes: one a file, or one a line."""
    d = spark.read.json(path, schema="features array<struct<attributes:struct<NAME:string,FEATURE_CLASS:string>>>", multiLine=multi)
    return d.select(F.explode("features.attributes").alias("a")).select(F.trim("a.NAME").alias("name"), F.lit(1).cast("long").alias("n")).where("name <> ''")


def listed_words(lines: DataFrame) -> DataFrame:
    """(name, n) from (value): one word a line, more than two letters."""
    return lines.select(F.lower(F.trim("value")).alias("name"), F.lit(1).cast("long").alias("n")).where(F.length("name") > 2)


OVERRIDE_FILE = "entries array<string>, stopwords array<string>, recategorized map<string,string>"


def override_files(spark: SparkSession, path: str) -> DataFrame:
    """(word, action, category, file, at) from JSON files of three shapes: entries (objects, or bare words), or stop words and recategorised words."""
    d = spark.read.json(path, schema=OVERRIDE_FILE, multiLine=True).withColumn("file", F.col("_metadata.file_name"))
    e = d.where("entries IS NOT NULL").select("file", F.posexplode("entries").alias("at", "e"))
    o = F.from_json("e", "word string, action string, category string")
    e = e.select("file", "at", F.when(F.col("e").startswith("{"), o).otherwise(F.struct(F.col("e").alias("word"), F.lit("stopword").alias("action"), F.lit("").alias("category"))).alias("o"))
    e = e.select("o.word", F.coalesce(F.nullif(F.lower(F.trim("o.action")), F.lit("")), F.lit("review")).alias("action"), F.coalesce(F.trim("o.category"), F.lit("")).alias("category"), "file", "at")
    old = d.where("entries IS NULL")
    s = old.where("stopwords IS NOT NULL").select("file", F.posexplode("stopwords").alias("at", "word")).select("word", F.lit("stopword").alias("action"), F.lit("").alias("category"), "file", "at")
    r = old.where("recategorized IS NOT NULL").select("file", F.posexplode("recategorized").alias("at", "word", "category")).select("word", F.lit("include").alias("action"), "category", "file", (F.col("at") + 10**6).alias("at"))
    return e.unionByName(s).unionByName(r)


def overrides(rows: DataFrame) -> DataFrame:
    """(word, action, category) by the normalised word; the entry of the latest file and place wins."""
    key = T.normalize_word_marks(F.col("word"))
    last = F.max(F.struct("file", "at", "action", "category")).alias("l")
    return rows.where("trim(word) <> ''").groupBy(key.alias("word")).agg(last).where("word <> ''").select("word", "l.action", "l.category")


RECORD, FIELD = "\x1e", "\x1f"


def write_texts(rows: DataFrame, path: str) -> None:
    """(id, text) as whole texts, line breaks and all, in files that split between records."""
    rows.select(F.concat(F.col(rows.columns[0]).cast("string"), F.lit(FIELD), F.col(rows.columns[1])).alias("value")).write.mode("overwrite").option("lineSep", RECORD).text(path)


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """(id, text) of whole texts."""
    v = spark.read.option("lineSep", RECORD).text(path)
    return v.select(F.substring_index("value", FIELD, 1).alias("id"), F.expr(f"substring(value, instr(value, '{FIELD}') + 1)").alias("text"))


LINK = r'(?i)<a\b[^>]*\bhref\s*=\s*"([^"#]+)"[^>]*>([^<]*)'


def catalogue(pages: DataFrame) -> DataFrame:
    """(base, url, title, date) from (base, html): the links of catalogue pages, absolute, each url of a page once with its least title.

    Labels before a title go; the date is that of the address, where it has one.
    """
    hits = F.transform(F.regexp_extract_all("html", F.lit(LINK), F.lit(0)), lambda x: F.struct(F.regexp_extract(x, LINK, 1).alias("href"), F.regexp_extract(x, LINK, 2).alias("title")))
    x = pages.where("html IS NOT NULL").select("base", F.explode(hits).alias("l"))
    host = F.regexp_extract("base", r"^(https?://[^/]+)", 1)
    url = F.when(F.col("l.href").rlike("^https?://"), F.col("l.href")).when(F.col("l.href").startswith("/"), F.concat(host, "l.href")).otherwise(F.concat(host, F.lit("/"), "l.href"))
    title = F.regexp_replace(F.trim("l.title"), r"^(?:Column:\s*|By na |By |Na )", "")
    x = x.select("base", url.alias("url"), title.alias("title")).groupBy("base", "url").agg(F.min("title").alias("title"))
    day = F.regexp_extract("url", r"/(\d{4}/\d{2}/\d{2})/", 1)
    return x.select("base", "url", "title", F.when(day != "", F.try_to_date(F.nullif(day, F.lit("")), "yyyy/MM/dd")).alias("date"))


#: Ids in one part of a text that is put together from rows.
PART = 4096


def in_parts(rows: DataFrame, owner: str, key: str, text: str, between: str) -> DataFrame:
    """(owner, part, text): each owner's texts joined in order of the key, in parts of ``PART`` keys, so no row grows with the owner."""
    x = F.array_sort(F.collect_list(F.struct(key, text)))
    g = rows.groupBy(owner, F.floor(F.col(key) / PART).alias("part")).agg(x.alias("_x"))
    return g.select(owner, "part", F.array_join(F.transform("_x", lambda r: r[text]), between).alias("text"))


def merged_pages(pages: DataFrame, work: str, part: str, order: str) -> DataFrame:
    """(work, part, pages, html): the first page's head, or one with the character set, and all bodies in order."""
    head = F.regexp_extract("html", r"(?is)<head\b[^>]*>.*?</head\s*>", 0)
    body = F.regexp_extract("html", r"(?is)<body\b[^>]*>(.*?)(?:</body\s*>|\z)", 1)
    g = pages.groupBy(work, part).agg(F.count("*").alias("pages"), F.min(F.struct(order, "html", head.alias("h"))).alias("_f"), F.array_sort(F.collect_list(F.struct(order, "html", body.alias("b")))).alias("_x"))
    first = F.coalesce(F.nullif(F.col("_f.h"), F.lit("")), F.lit('<head><meta charset="UTF-8"></head>'))
    return g.select(work, part, "pages", F.concat(F.lit("<html>"), first, F.lit("<body>"), F.array_join(F.transform("_x", lambda r: r["b"]), ""), F.lit("</body></html>")).alias("html"))


class Aliases:
    """Named tables with aliases: versions are temporary views, an alias is one that is moved from version to version."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.of = spark, {}

    def create(self, name: str, df: DataFrame) -> None:
        if self.exists(name):
            raise ValueError(f"{name} is there")
        df.createTempView(name)

    def exists(self, name: str) -> bool:
        return name in self.of or self.spark.catalog.tableExists(name)

    def resolve(self, name: str) -> str | None:
        """The version behind a name: an alias' own, or the name itself; None where there is none."""
        return self.of.get(name) or (name if self.spark.catalog.tableExists(name) else None)

    def point(self, alias: str, name: str) -> None:
        if self.resolve(name) is None:
            raise KeyError(name)
        self.spark.table(name).createOrReplaceTempView(alias)
        self.of[alias] = name

    def remove(self, name: str) -> bool:
        """Drop a version or an alias; a version an alias stands for stays."""
        if name in self.of.values():
            raise ValueError(f"{name} is in use")
        self.of.pop(name, None)
        return self.spark.catalog.dropTempView(name)


def jdbc(spark: SparkSession, url: str, name: str, key: str | None = None, parts: int = 1, low: int = 0, high: int = 0, **options: str) -> DataFrame:
    """A table of a relational store; with ``key`` it is read in ``parts`` ranges at once. The store's driver must be on the class path."""
    r = spark.read.format("jdbc").option("url", url).option("dbtable", name).options(**options)
    if key:
        r = r.option("partitionColumn", key).option("numPartitions", parts).option("lowerBound", low).option("upperBound", high)
    return r.load()
