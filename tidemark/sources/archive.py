"""Instrument archives: finding, sniffing, listing, matching and parsing text members; CSV, JSON and Parquet sinks.

Archives are folders or zip files; zip files are listed on the driver (their directory is small) and members are read
by the executors as binary files.
"""

from __future__ import annotations

import csv
import json
import re
import zipfile
from hashlib import sha256
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.tickers import extension, normalize_ticker, ticker_from_member
from ..session import tabled

#: Text suffixes, encodings in the order they are tried, delimiters, and the ten columns by position.
TEXT_SUFFIXES = (".txt", ".csv", ".dat")
ENCODINGS = ("utf-8-sig", "utf-8", "cp1252", "latin1")
DELIMITERS = (",", ";", "\t", "|")
COLUMNS = ("ticker", "period", "date", "time", "open", "high", "low", "close", "volume", "open_interest")
#: Header spellings, without their angle brackets and in lower case.
HEADERS = {"per": "period", "vol": "volume", "openint": "open_interest", "symbol": "ticker", "datetime": "date", "adj close": "close"}


def find_archive(root: str, archive: str | None = None) -> Path:
    """The given path, or the first zip file of ``root`` by lower-case name."""
    if archive:
        p = Path(archive)
        if not p.exists():
            raise FileNotFoundError(archive)
        return p
    found = sorted(Path(root).glob("*.zip"), key=lambda p: p.name.lower())
    if not found:
        raise FileNotFoundError(f"no archive in {root}")
    return found[0]


def list_members(spark: SparkSession, archive: str) -> DataFrame:
    """source_member, member_size of a zip file."""
    with zipfile.ZipFile(archive) as z:
        rows = [(i.filename, i.file_size) for i in z.infolist() if not i.is_dir()]
    return spark.createDataFrame(rows, "source_member string, member_size long")


def decode_sample(raw: bytes) -> tuple[str, str]:
    """(text, encoding): the first encoding that reads the bytes."""
    for e in ENCODINGS:
        try:
            return raw.decode(e), e
        except UnicodeDecodeError:
            continue
    return raw.decode("utf-8", "replace"), "utf-8-replace"


def sniff(raw: bytes) -> dict:
    """encoding, delimiter, header and date format of a sample."""
    text, encoding = decode_sample(raw)
    lines = [x for x in text.splitlines() if x.strip()]
    try:
        delimiter = csv.Sniffer().sniff(text, "".join(DELIMITERS)).delimiter
    except csv.Error:
        delimiter = max(DELIMITERS, key=text.count)
    first = lines[0] if lines else ""
    header = bool(re.search(r"<?(ticker|date|close)>?", first, re.I)) and not re.search(r"\b\d{8}\b", first)
    return {"encoding": encoding, "delimiter": delimiter, "has_header": header, "date_format": "yyyyMMdd" if re.search(r"\b\d{8}\b", text) else None}


def member_index(members: DataFrame, suffixes: tuple[str, ...] = TEXT_SUFFIXES) -> DataFrame:
    """Text members with the ticker of their file name."""
    m = members.where(extension(F.col("source_member")).isin(*suffixes))
    return m.withColumn("filename_ticker", ticker_from_member(F.col("source_member")))


def extension_histogram(members: DataFrame, path: str = "source_member") -> DataFrame:
    return members.groupBy(extension(F.col(path)).alias("extension")).agg(F.count("*").alias("n"))


def depth_histogram(members: DataFrame, path: str = "source_member") -> DataFrame:
    return members.groupBy(F.size(F.split(path, "/")).cast("bigint").alias("depth")).agg(F.count("*").alias("n"))


def directory_histogram(members: DataFrame, path: str = "source_member", most: int = 30, levels: int = 3) -> DataFrame:
    """The most common directory prefixes of one to ``levels`` levels, ties by name."""
    parts = F.split(path, "/")
    dirs = F.slice(parts, F.lit(1), F.size(parts) - 1)
    upto = F.least(F.size(dirs), F.lit(levels))
    prefixes = F.when(upto > 0, F.transform(F.sequence(F.lit(1), F.greatest(upto, F.lit(1))), lambda n: F.array_join(F.slice(dirs, F.lit(1), n), "/"))).otherwise(F.array().cast("array<string>"))
    return members.select(F.explode(prefixes).alias("directory")).groupBy("directory").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "directory").limit(most)


def inspect(members: DataFrame) -> DataFrame:
    """One row: members, bytes, text members, deepest path."""
    return members.agg(
        F.count("*").alias("members"),
        F.coalesce(F.sum("member_size"), F.lit(0)).cast("bigint").alias("total_bytes"),
        F.count_if(extension(F.col("source_member")).isin(*TEXT_SUFFIXES)).alias("text_members"),
        F.max(F.size(F.split("source_member", "/"))).cast("bigint").alias("max_depth"),
    )


def match_members(requested: DataFrame, index: DataFrame) -> DataFrame:
    """project_ticker, source_member, matched, reason: the best member of each requested ticker.

    requested: ticker, aliases (array). Of the members of any alias, one under "stocks" comes first, then by path.
    """
    r = requested.select(F.col("ticker").alias("project_ticker"), F.explode("aliases").alias("alias")).select("project_ticker", normalize_ticker(F.col("alias")).alias("filename_ticker")).distinct()
    j = r.join(index, "filename_ticker", "left")
    best = W.partitionBy("project_ticker").orderBy(F.col("source_member").isNull(), (~F.contains(F.lower("source_member"), F.lit("stocks"))), "source_member")
    b = j.withColumn("_r", F.row_number().over(best)).where("_r = 1")
    found = F.col("source_member").isNotNull()
    return b.select("project_ticker", "source_member", found.alias("matched"), F.when(found, "matched").otherwise("no_member").alias("reason"))


def header_places(lines: DataFrame, delimiter: str = ",") -> DataFrame:
    """member, first_line, has_header, and the places of ticker, date and close in its lines (null where it has none).

    A member has a header if its first line names a known column and holds no date of eight digits; its columns are then
    found by their names and spellings, otherwise by position.
    """
    first = lines.groupBy("member").agg(F.min("line_no").alias("first_line"), F.min_by("value", "line_no").alias("head"))
    spelt = F.create_map(*(F.lit(x) for pair in HEADERS.items() for x in pair))
    bare = F.transform(F.split("head", re.escape(delimiter)), lambda c: F.regexp_replace(F.lower(F.trim(c)), "^<|>$", ""))
    named = first.withColumn("names", F.transform(bare, lambda c: F.coalesce(spelt[c], c)))
    known = F.arrays_overlap("names", F.array(*map(F.lit, COLUMNS))) & ~F.col("head").rlike(r"\b[0-9]{8}\b")
    named = named.withColumn("has_header", known)
    place = lambda c: F.when(F.col("has_header"), F.nullif(F.array_position("names", F.lit(c)), F.lit(0)) - 1).otherwise(COLUMNS.index(c)).cast("int")
    return named.select("member", "first_line", "has_header", *(place(c).alias(f"{c}_at") for c in ("ticker", "date", "close")))


def parse_lines(lines: DataFrame, delimiter: str = ",") -> DataFrame:
    """Rows of (member, line_no, value): member, line_no, ticker, date, close, with null where unreadable; header lines go.

    A line is split once; members whose header names no date or no close have no readable rows.
    """
    j = lines.join(header_places(lines, delimiter), "member").where(~(F.col("has_header") & (F.col("line_no") == F.col("first_line"))))

    def fields(f: Column) -> Column:
        text = lambda c: F.nullif(F.trim(F.get(f, F.col(f"{c}_at"))), F.lit(""))
        return F.struct(text("ticker").alias("ticker"), text("date").alias("date"), text("close").alias("close"))

    cut = j.select("member", "line_no", F.element_at(F.transform(F.array(F.split("value", re.escape(delimiter))), fields), 1).alias("f"))
    day = F.when(F.col("f.date").rlike("^[0-9]{8}$"), F.to_date(F.try_to_timestamp("f.date", F.lit("yyyyMMdd"))))
    return cut.select("member", "line_no", normalize_ticker(F.col("f.ticker")).alias("ticker"), day.alias("date"), F.col("f.close").try_cast("double").alias("close"))


def parse_members(lines: DataFrame, delimiter: str = ",") -> tuple[DataFrame, DataFrame]:
    """(rows, stats): valid rows, the last of each date kept, and counts per member."""
    # the parsed lines are a table: rows and counts read it, nothing is parsed twice
    p = tabled(parse_lines(lines, delimiter), "lines")
    ok = F.col("date").isNotNull() & F.coalesce((F.col("close") > 0) & (F.col("close") < float("inf")), F.lit(False))
    good = p.where(ok)
    last = W.partitionBy("member", "date").orderBy(F.col("line_no").desc())
    rows = good.withColumn("_r", F.row_number().over(last)).where("_r = 1").drop("_r")
    kept = good.groupBy("member").agg((F.count("*") - F.countDistinct("date")).alias("duplicate_count"))
    stats = p.groupBy("member").agg(F.count_if(F.col("date").isNull()).alias("invalid_date_count"), F.count_if(F.col("date").isNotNull() & ~ok).alias("invalid_price_count"))
    return rows, stats.join(kept, "member", "left").withColumn("duplicate_count", F.coalesce("duplicate_count", F.lit(0).cast("bigint")))


def normalize_vendor(wide: DataFrame, fields: dict[str, list[str]]) -> DataFrame:
    """A wide frame (date and one column per field and ticker) as date, ticker, close and further fields.

    fields: column names by field, all of the form ``field_ticker``; of Close and Adj Close the first that exists.
    """
    price = "Close" if "Close" in fields else "Adj Close"
    out = None
    for field, cols in fields.items():
        if field in ("Close", "Adj Close") and field != price:
            continue
        name = "close" if field == price else field.lower()
        part = wide.unpivot(["date"], cols, "_c", name).withColumn("ticker", F.substring_index("_c", "_", -1)).drop("_c")
        out = part if out is None else out.join(part, ["date", "ticker"], "full")
    return out.where("close is not null")


def complete_series(panel: DataFrame) -> DataFrame:
    """Only tickers with a finite positive close on every date."""
    n = panel.agg(F.countDistinct("date").alias("_n"))
    ok = panel.where("close > 0 and close < double('infinity') and not isnan(close)").groupBy("ticker").agg(F.countDistinct("date").alias("_c")).crossJoin(F.broadcast(n)).where("_c = _n")
    return panel.join(ok.select("ticker"), "ticker", "left_semi")


def first_valid(df: DataFrame, key: str, values: list[str], order: str) -> DataFrame:
    """Trimmed, upper-case keys; rows with any value missing or not finite go; of the rest the first row of each key."""
    d = df.withColumn(key, F.upper(F.trim(key)))
    for v in values:
        d = d.withColumn(v, F.expr(f"try_cast({v} as double)"))
    ok = F.col(key) != ""
    for v in values:
        ok = ok & F.col(v).isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    return d.where(ok).withColumn("_r", F.row_number().over(W.partitionBy(key).orderBy(order))).where("_r = 1").drop("_r")


def dashboard_csv(spark: SparkSession, path: str, numbers: list[str]) -> DataFrame:
    """A CSV with a header; blank lines are skipped, blank or unreadable numbers are null."""
    d = spark.read.csv(path, header=True, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
    for c in numbers:
        d = d.withColumn(c, F.nullif(F.trim(c), F.lit("")).try_cast("double"))
    return d


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def cached(spark: SparkSession, folder: str, params: dict, build) -> DataFrame:
    """A Parquet table keyed by its parameters: built once, recomputed when any of them changes."""
    path = f"{folder}/{sha256(json.dumps(params, sort_keys=True, default=str).encode()).hexdigest()[:24]}"
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def inspection_report(members: DataFrame, folder: str) -> dict:
    """Write the inspection as JSON and Markdown; report-sized."""
    one = inspect(members).first().asDict()
    one["extensions"] = {r["extension"]: r["n"] for r in extension_histogram(members).collect()}
    one["directories"] = {r["directory"]: r["n"] for r in directory_histogram(members).collect()}
    Path(folder).mkdir(parents=True, exist_ok=True)
    Path(folder, "inspection.json").write_text(json.dumps(one, indent=2))
    Path(folder, "inspection.md").write_text("\n".join(["# Archive", "", *(f"- {k}: {v}" for k, v in one.items() if not isinstance(v, dict))]) + "\n")
    return one
