"""Archives and reference tables: catalogues of packed files, texts with references to each other, CSV tables with overrides."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Names of catalogues, the folder of extensions and the beginning of official ones, references and their greatest depth.
CATALOGUE, EXTENSIONS, OFFICIAL = r"^(ext_)?[0-9]+\.cat$", "extensions", "ego_dlc_"
REFERENCE, DEPTH = r"\{\s*(\d+)\s*,\s*(\d+)\s*\}", 9
#: Stand-ins for brackets that are escaped, and for one that closes nothing.
OPEN, CLOSE, STRAY = "\x01", "\x02", "\x03"


def index(spark: SparkSession, folder: str, extensions: Sequence[str] | None = None) -> DataFrame:
    """(path, size, offset, dat, source): the packed files of a folder and its extensions, of equal paths the one loaded last.

    A catalogue's lines are path, size, time and digest; the files lie one after the
    other in the .dat file beside it. Base catalogues load first, then extensions in
    the order given, or the official ones by name; within these by catalogue name.
    Catalogues without a .dat file and lines of another form are left out.
    """
    read = spark.read.option("recursiveFileLookup", "true")
    dats = read.format("binaryFile").option("pathGlobFilter", "*.dat").load(folder).select(F.col("path").alias("dat"))
    cats = read.option("pathGlobFilter", "*.cat").text(folder, wholetext=True).select(F.col("_metadata.file_path").alias("cat"), "value")
    steps = F.split("cat", "/")
    name, inside = F.element_at(steps, -1), F.get(steps, F.size(steps) - 3) == EXTENSIONS
    cats = cats.withColumns({"name": name, "source": F.when(inside, F.element_at(steps, -2)).otherwise("")}).filter(F.col("name").rlike(CATALOGUE) & ((F.col("source") == "") | F.col("name").startswith("ext_")))
    if extensions is None:
        cats = cats.filter((F.col("source") == "") | F.col("source").startswith(OFFICIAL)).withColumn("turn", F.col("source"))
    else:
        cats = cats.withColumn("turn", F.array_position(F.array(F.lit(""), *map(F.lit, extensions)), F.col("source"))).filter("turn > 0")
    own = lambda c, end: F.regexp_replace(F.regexp_replace(F.col(c), "^file:/+", "/"), rf"\.{end}$", "")
    cats = cats.withColumn("stem", own("cat", "cat")).join(dats.withColumn("stem", own("dat", "dat")), "stem")
    lines = cats.select("dat", "source", "turn", "name", F.posexplode(F.split("value", "\r?\n")).alias("line", "entry"))
    parts = [F.regexp_extract("entry", r"^(.*) (\d+) (\S*) (\S*)$", k) for k in (1, 2)]
    lines = lines.withColumns({"path": parts[0], "size": parts[1].try_cast("long")}).filter("size IS NOT NULL")
    lines = lines.withColumn("offset", F.sum("size").over(Window.partitionBy("dat").orderBy("line")) - F.col("size"))
    full = F.when(F.col("source") == "", F.col("path")).otherwise(F.concat(F.lit(f"{EXTENSIONS}/"), "source", F.lit("/"), "path"))
    last = lines.groupBy(full.alias("path")).agg(F.max_by(F.struct("size", "offset", "dat", "source"), F.struct("turn", "name", "line")).alias("e"))
    return last.select("path", "e.*")


def glob(found: DataFrame, pattern: str) -> DataFrame:
    """Files whose path matches a pattern from its start on, in order."""
    return found.filter(F.col("path").rlike(f"^(?:{pattern})")).orderBy("path")


def payloads(spark: SparkSession, folder: str, found: DataFrame) -> DataFrame:
    """(path, data) of indexed files; a loose file of the path goes before the packed one. A .dat file is read whole, so it is at most 2 GB."""
    read = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    packed = found.join(read.option("pathGlobFilter", "*.dat").load(folder).select(F.col("path").alias("dat"), "content"), "dat")
    packed = packed.select("path", F.expr("substring(content, CAST(offset + 1 AS INT), CAST(size AS INT))").alias("data"))
    base = "/" + folder.split(":", 1)[-1].strip("/") + "/"
    loose = read.option("pathGlobFilter", "*").load(folder).select(F.substring_index("path", base, -1).alias("path"), F.col("content").alias("loose")).join(found.select("path"), "path", "left_semi")
    return packed.join(loose, "path", "left").select("path", F.coalesce("loose", "data").alias("data"))


def texts(elems: DataFrame, order: Column | None = None) -> DataFrame:
    """(page, id, text) of text documents read as elements (tags page and t), of equal keys the last: by file, or by `order`."""
    key = lambda name: F.try_element_at("attrs", F.lit(name)).try_cast("long")
    pages = elems.filter("tag = 'page'").select("file", F.col("ord").alias("parent"), key("id").alias("page"))
    found = elems.filter("tag = 't'").select("file", "ord", "parent", key("id").alias("id"), F.coalesce("text", F.lit("")).alias("text")).join(pages, ["file", "parent"]).filter("page IS NOT NULL AND id IS NOT NULL")
    return found.groupBy("page", "id").agg(F.max_by("text", F.struct(F.col("file") if order is None else order, "ord")).alias("text"))


def uncommented(text: Column) -> Column:
    """A text without (comments), and with escaped brackets as they are: what lies between the first closing bracket and the opening one nearest before it goes, as often as there are closing ones."""
    held = F.replace(F.replace(text, F.lit("\\("), F.lit(OPEN)), F.lit("\\)"), F.lit(CLOSE))

    def shorter(t: Column, _: Column) -> Column:
        close = F.instr(t, ")")
        before, after = F.substr(t, F.lit(1), close - 1), F.substr(t, close + 1)
        back = F.instr(F.reverse(before), "(")
        return F.when(close == 0, t).when(back == 0, F.concat(before, F.lit(STRAY), after)).otherwise(F.concat(F.substr(before, F.lit(1), close - 1 - back), after))

    n = F.length(held) - F.length(F.replace(held, F.lit(")"), F.lit("")))
    return F.translate(F.aggregate(F.sequence(F.lit(0), n), held, shorter), OPEN + CLOSE + STRAY, "())")


def resolved(df: DataFrame, key: str, text: str, known: DataFrame) -> DataFrame:
    """df (unique key) with the references {page,id} in a text replaced by what known (page, id, text) has, nine levels deep; unknown ones stay.

    Each level is a join of the references that are left. Needs a checkpoint folder.
    """
    done, open_ = None, df.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    known = known.select(F.col("page").alias("_page"), F.col("id").alias("_id"), F.col("text").alias("_with"))
    for _ in range(DEPTH):
        rest = open_.filter(~F.coalesce(F.col("_text").rlike(REFERENCE), F.lit(False)))
        done = rest if done is None else done.unionByName(rest)
        left = open_.filter(F.col("_text").rlike(REFERENCE))
        refs = F.expr(f"regexp_extract_all(_text, r'{REFERENCE}', 0)")
        parts = left.select("_key", F.posexplode(F.arrays_zip(F.split("_text", REFERENCE, -1).alias("a"), refs.alias("b"))).alias("_n", "_p")).select("_key", "_n", "_p.a", "_p.b")
        parts = parts.withColumns({"_page": F.regexp_extract("b", REFERENCE, 1).try_cast("long"), "_id": F.regexp_extract("b", REFERENCE, 2).try_cast("long")}).join(known, ["_page", "_id"], "left")
        piece = F.struct("_n", F.concat(F.coalesce("a", F.lit("")), F.coalesce("_with", "b", F.lit(""))).alias("s"))
        open_ = parts.groupBy("_key").agg(F.array_join(F.transform(F.array_sort(F.collect_list(piece)), lambda x: x["s"]), "").alias("_text")).checkpoint()  # the pieces of one text
        if open_.isEmpty():
            break
    out = done.unionByName(open_).withColumn("_text", uncommented(F.col("_text")))
    return df.join(out.withColumnRenamed("_key", key), key, "left").withColumn(text, F.col("_text")).drop("_text")


def header(spark: SparkSession, path: str) -> list[str]:
    return spark.read.option("header", "true").csv(path).columns


def overlaid(spark: SparkSession, name: str, own: str, packaged: str, schema: str, defaults: dict | None = None) -> tuple[DataFrame, list[str]]:
    """(table, columns that own lacks): the CSV of a name from folder own, but from packaged if there is none in own or one that lacks columns.

    Absent from both, the table is empty. Columns of the schema that the file lacks are null or as in defaults.
    """
    from pyspark.errors import AnalysisException

    def columns(folder: str) -> list[str] | None:
        try:
            return header(spark, f"{folder}/{name}")
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return None

    mine, theirs = columns(own), columns(packaged)
    missing = [c for c in theirs or [] if c not in mine] if mine is not None else []
    folder = own if mine is not None and not missing else packaged if theirs is not None else None
    wanted = spark.createDataFrame([], schema).schema
    if folder is None:
        return spark.createDataFrame([], wanted), missing
    raw = spark.read.option("header", "true").csv(f"{folder}/{name}")
    return raw.select(*[(F.col(f.name) if f.name in raw.columns else F.lit((defaults or {}).get(f.name))).cast(f.dataType).alias(f.name) for f in wanted]), missing


def dump(found: DataFrame, folder: str) -> None:
    """Write texts (page, id, text) in order, as packed CSV with a header."""
    found.select("page", "id", "text").sort("page", "id").write.mode("overwrite").option("header", "true").option("escape", '"').option("multiLine", "true").option("emptyValue", "").csv(folder, compression="gzip")
