"""Readers: bulk reports with a preamble, opportunity JSON, snapshots, feeds. The paged connector is in `paged`."""

from __future__ import annotations

import csv

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bidsmith import schemas
from bidsmith.config import IDIQ_NOTICE, PRESS_WIRES, SOLE_NOTICE
from bidsmith.functions import cleaning as C
from bidsmith.sources.lines import byte_lines
from bidsmith.sources.sinks import published, settled

HEADER = "CAGE Code"


def report_csv(spark: SparkSession, path: str, encoding: str | None = None, split: int = 64 << 20) -> DataFrame:
    """Records of a bulk report: whatever stands before the line that names the cage column is skipped.

    Files are read as lines, in splits, however large they are. A line starts a record where the quotes before it
    in its file are even in number: counted within each split, then carried from split to split. Records
    of one line stay where they are; only the lines of longer ones are brought together. A file without
    such a header gives no rows, a missing one an error. Without an encoding files are UTF-8 in whatever store Spark reads; with
    one, they are read by byte ranges of about `split` (`lines.byte_lines`).
    """
    if encoding:
        # read once: several steps below go through the lines, and a task a range is dear; ranges are read in turn by a few tasks a core
        lines = settled(byte_lines(spark, path, encoding, split).coalesce(4 * spark.sparkContext.defaultParallelism), "lines")
    else:
        lines = spark.read.text(path).select(F.regexp_replace("value", "^\ufeff", "").alias("line"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("at"))
    place = F.struct("split", "at")
    heads = lines.where(F.contains("line", F.lit(HEADER))).groupBy("file").agg(F.min_by(F.struct(place.alias("place"), "line"), place).alias("head"))  # a row a file
    found = lines.join(heads, "file").where(place > F.col("head.place"))
    quotes = F.length("line") - F.length(F.replace("line", F.lit('"'), F.lit("")))
    inside = Window.partitionBy("file", "split").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    found = found.withColumns({"quotes": quotes, "before": F.coalesce(F.sum(quotes).over(inside), F.lit(0))})
    # one row a split
    splits = found.groupBy("file", "split").agg(F.sum("quotes").alias("n"))
    carried = splits.select("file", "split", F.coalesce(F.sum("n").over(Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("carried"))
    marked = found.join(carried, ["file", "split"]).withColumn("open", (F.col("before") + F.col("carried")) % 2 == 1)
    whole = ~F.col("open") & (F.col("quotes") % 2 == 0)
    # the lines of a longer record lie between an odd count of quotes and the next: pairs of such lines are numbered
    odd = F.when(F.col("quotes") % 2 == 1, 1).otherwise(0)
    long = marked.where(~whole).withColumn("odd", odd).withColumn("seen", F.coalesce(F.sum("odd").over(Window.partitionBy("file", "split").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    odds = long.groupBy("file", "split").agg(F.sum("odd").alias("n"))
    earlier = odds.select("file", "split", F.coalesce(F.sum("n").over(Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("earlier"))
    numbered = long.join(earlier, ["file", "split"]).withColumn("record", F.floor((F.col("seen") + F.col("earlier")) / 2))
    joined = numbered.groupBy("file", "record", F.col("head.line").alias("h")).agg(F.sort_array(F.collect_list(F.struct("split", "at", "line"))).alias("x")).select(F.array_join(F.col("x.line"), "\n").alias("line"), "h")
    records = marked.where(whole).select("line", F.col("head.line").alias("h")).unionByName(joined).where(F.trim("line") != "")
    out = spark.createDataFrame([], _record_schema())
    for head in [r["h"] for r in heads.select(F.col("head.line").alias("h")).distinct().orderBy("h").collect()]:  # a line a file layout
        out = out.unionByName(_parsed(records.where(F.col("h") == head).select("line"), next(iter(csv.reader([head])))))
    return out


def _parsed(lines: DataFrame, names: list[str]) -> DataFrame:
    parsed = lines.select(F.from_csv("line", ", ".join(f"`_c{i}` string" for i in range(len(names))), {"multiLine": "true", "quote": '"', "escape": '"'}).alias("r"))
    at = {n.strip(): F.col(f"r._c{i}") for i, n in enumerate(names)}
    field = lambda h: F.trim(F.coalesce(at[h], F.lit("")), F.lit(" \t\r\n")) if h in at else F.lit("")
    columns = [F.substring(field(h), 1, 10).alias(n) if n == "posted_date" else C.money_or_null(field(h)).alias(n) if n == "award_amount" else field(h).alias(n) for h, n in schemas.REPORT_FIELDS.items()]
    flags = [C.yes(field(f"Is Vendor Business Type - {h}")).alias(n) for h, n in schemas.REPORT_FLAGS.items()]
    return parsed.select(*columns, *flags)


def _record_schema() -> str:
    return ", ".join([f"{n} {'double' if n == 'award_amount' else 'string'}" for n in schemas.REPORT_FIELDS.values()] + [f"{n} boolean" for n in schemas.REPORT_FLAGS.values()])


def newest_report(spark: SparkSession, folder: str) -> str:
    """The path of the last-modified report file right in the folder; an error where there is none."""
    found = []
    for pattern in ("*Report*.csv", "*SAM*.csv"):
        glob = spark._jvm.org.apache.hadoop.fs.Path(f"{folder.rstrip('/')}/{pattern}")
        found += [(f.getModificationTime(), f.getPath().toString()) for f in glob.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(glob) or [] if f.isFile()]
    if not found:
        raise FileNotFoundError(f"no report in {folder}")
    return max(found)[1]


def plain_csv(spark: SparkSession, path: str) -> DataFrame:
    """A CSV by its header, all strings."""
    return spark.read.csv(path, header=True, inferSchema=False, multiLine=True, escape='"')


def opportunities(raw: DataFrame, column: str = "value") -> DataFrame:
    """Awards from opportunity JSON, one text a row; rows without a name or a positive amount are left out."""
    o = raw.select(F.from_json(column, schemas.OPPORTUNITY).alias("o")).select("o.*")
    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    name = C.clean_name("award.awardee.name")
    df = o.select(
        blank("title").alias("title"), blank("solicitationNumber").alias("solicitation_number"), blank("postedDate").alias("posted_date"), name.alias("awardee_name"), blank("award.awardee.name").alias("awardee_name_raw"), blank("award.awardee.ueiSAM").alias("awardee_duns"),
        C.money("award.amount").alias("award_amount"), blank("fullParentPathName").alias("agency"), F.lit("").alias("office"), blank("naicsCode").alias("naics"), blank("typeOfSetAsideDescription").alias("set_aside"),
        C.any_phrase(C.joined_lower("typeOfSetAsideDescription", "solicitationNumber", "title", "description"), SOLE_NOTICE).alias("sole_source"), C.any_phrase(C.joined_lower("title", "description", "archiveType"), IDIQ_NOTICE).alias("is_idiq"), blank("description").alias("description"), blank("uiLink").alias("sam_url"),
    )
    return df.where((F.col("awardee_name") != "") & (F.col("award_amount") > 0))


def snapshot(spark: SparkSession, root: str, start: str, end: str, schema: str = schemas.AWARD) -> DataFrame:
    """The cached awards of a date range; an empty table where the range isn't cached."""
    return published(spark, f"{root}/awards_{start.replace('-', '')}_{end.replace('-', '')}", schema)


def filings(companies: DataFrame, since: str, forms: tuple[str, ...] | None = None) -> DataFrame:
    """Filings from parallel arrays (form, filed, description): on or after a date, of some forms."""
    rows = companies.select("cik", F.inline(F.arrays_zip("form", "filed", "description"))).where(F.to_date("filed") >= F.to_date(F.lit(since)))
    rows = rows.where(F.col("form").isin(*forms)) if forms else rows
    return rows.withColumn("description", F.coalesce("description", F.lit("")))


def feed_items(feeds: DataFrame, column: str, ident: str) -> DataFrame:
    """(ident, title, published, text) of each item of an RSS text, items read as XML: entities, CDATA and attributes count for what they
    say. An item that isn't well formed has a null title and date; text is the item as it stands."""
    items = feeds.select(ident, F.explode(F.regexp_extract_all(column, F.lit(r"(?s)(<item\b.*?</item>)"), F.lit(1))).alias("text"))
    read = F.from_xml("text", "title string, pubDate string", {"mode": "PERMISSIVE", "ignoreNamespace": "true"})
    return items.withColumn("_x", read).select(ident, F.col("_x.title").alias("title"), C.mail_date(F.col("_x.pubDate")).alias("published"), "text")


def first_press(items: DataFrame, ident: str, at: str, window: int) -> DataFrame:
    """(ident, first_pr): the day of the earliest item that names a press wire and lies from the day before `at` to `window` days after it.

    items: as `feed_items` gives them, with `at`, a date.
    """
    day = F.to_timestamp(at)
    named = C.any_phrase(F.lower("text"), PRESS_WIRES) & F.col("published").between(day - F.expr("interval 1 day"), day + F.make_interval(days=F.lit(window)))
    return items.groupBy(ident).agg(F.min(F.when(named, F.to_date("published"))).alias("first_pr"))


def company_hits(primary: DataFrame, fallback: DataFrame, failed: DataFrame, ident: str, limit: int = 10) -> DataFrame:
    """Search hits: the primary's, or the list's where the primary failed (an empty answer isn't a failure)."""
    own = primary.join(failed, ident, "left_anti").select("*", F.lit("search").alias("origin")).unionByName(fallback.join(failed, ident, "left_semi").select("*", F.lit("list").alias("origin")))
    w = Window.partitionBy(ident).orderBy("ordinal")
    return own.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= limit).drop("_r")


def company_list(raw: DataFrame, column: str = "value") -> DataFrame:
    """ordinal, company, ticker and cik of a list kept as a JSON map: its values, in any key order."""
    entries = F.from_json(column, "map<string, struct<cik_str: bigint, ticker: string, title: string>>")
    listed = raw.select(F.posexplode(F.map_entries(entries)).alias("ordinal", "e"))
    return listed.select("ordinal", F.col("e.value.title").alias("company"), F.col("e.value.ticker").alias("ticker"), F.col("e.value.cik_str").alias("cik"))


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON record a line; lines that aren't one are left out."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def line_stream(spark: SparkSession, folder: str, files: int = 1) -> DataFrame:
    """Lines as they arrive in a folder: column value."""
    return spark.readStream.option("maxFilesPerTrigger", files).text(folder)


def search_url(base: str, **parameters: Column | str) -> Column:
    """A URL of base and percent-encoded parameters; null values are left out."""
    pairs = [F.concat(F.lit(f"{k}="), F.url_encode(v if isinstance(v, Column) else F.lit(v))) for k, v in parameters.items()]
    return F.concat(F.lit(f"{base}?"), F.array_join(F.array_compact(F.array(*pairs)), "&"))
