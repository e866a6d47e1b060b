"""Text sources: exports, logs, pages and grids as DataFrames of lines or whole texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dustloom.functions.columns import date_order_verdict, detect_date_order, is_number_like, parse_12h_timestamp, parse_export_timestamp, parse_locale_number, pm_fraction

#: The 22 channels of a numeric weather line, in order.
CHANNELS = ("R", "Seq", "Wifi", "Dn", "Dm", "Dx", "Sn", "Sm", "Sx", "Ta", "Ua", "Pa", "Rc", "Rd", "Ri", "Hc", "Hd", "Hi", "Th", "Vh", "Vs", "Vr")
#: What Windows Latin has in place of Latin-1's second control block.
WINDOWS_LATIN = tuple("".join(x) for x in zip(*((chr(i), bytes([i]).decode("cp1252")) for i in range(0x80, 0xA0) if i not in (0x81, 0x8D, 0x8F, 0x90, 0x9D)), strict=True))
STOP_TEXT = "Precipitable water [mm] for entire sounding"
#: Particle sizes and their columns.
PM = {"PM1": "pm1", "PM2.5": "pm25", "PM4": "pm4", "PM10": "pm10"}


def file_lines(spark: SparkSession, paths: list[str], encoding: str | None = None) -> DataFrame:
    """path, line_no, line of whole files; without an encoding UTF-8, UTF-16 and Windows Latin are tried by their marks."""
    files = spark.read.format("binaryFile").load(paths)
    raw = F.col("content")
    if encoding:
        text = F.decode(raw, encoding)
    else:
        two = F.hex(F.substring(raw, 1, 2))
        text = F.when(two.isin("FFFE", "FEFF"), F.decode(raw, "UTF-16")).when(F.is_valid_utf8(raw.cast("string")), raw.cast("string")).otherwise(F.translate(F.decode(raw, "ISO-8859-1"), *WINDOWS_LATIN))
    lines = F.split(F.regexp_replace(text, "^﻿", ""), r"\r?\n", -1)
    return files.select("path", F.posexplode(lines).alias("line_no", "line"))


#: Up to so many files their headers and facts are broadcast; beyond, the joins on path shuffle.
FEW_FILES = 20_000


def read_pm_exports(lines: DataFrame) -> DataFrame:
    """lines: path, line_no, line. path, line_no, interval_start, interval_end, ts and the four sizes.

    The header is a file's first line with both begin columns; only lines that hold both names are cut to find it, and
    it becomes the places of the columns wanted. Facts of a file (header, order of day and month, AM or PM
    anywhere in a column) are one row each and, when counted to be few, broadcast, so that lines stay where they were
    read, however large a file is. Rows longer than the header are left out.
    """
    low = F.lower("line")
    may_be = lines.where(low.contains("date beginning") & low.contains("time beginning"))
    names = F.transform(F.split(F.regexp_replace(low, "\ufeff", ""), "\t", -1), lambda c: F.trim(c))
    headers = may_be.select("path", "line_no", names.alias("names")).where(F.array_contains("names", "date beginning") & F.array_contains("names", "time beginning"))
    headers = headers.groupBy("path").agg(F.min_by(F.struct(F.col("line_no").alias("at"), "names"), "line_no").alias("h"))
    headers = headers.withColumn("kinds", F.transform("h.names", lambda c: pm_fraction(c)))
    at = lambda array, name: F.array_position(array, F.lit(name)).cast("int")
    wanted = [f"{a}_{b}" for a in ("date", "time") for b in ("beginning", "end")]
    places = {n: at(F.col("h.names"), n.replace("_", " ")) for n in wanted} | {c: at(F.col("kinds"), k) for k, c in PM.items()}
    headers = headers.select("path", F.col("h.at").alias("header_at"), F.size("h.names").alias("width"), *(F.coalesce(x, F.lit(0)).alias(f"at_{n}") for n, x in places.items()))
    few = F.broadcast if headers.limit(FEW_FILES + 1).count() <= FEW_FILES else lambda df: df
    cells = lines.select("path", "line_no", "line", F.split("line", "\t", -1).alias("cells")).join(few(headers), "path")
    rows = cells.where((F.col("line_no") > F.col("header_at")) & (F.size("cells") <= F.col("width")) & (F.trim("line") != ""))
    cell = lambda n: F.when(F.col(f"at_{n}") > 0, F.trim(F.get("cells", F.col(f"at_{n}") - 1)))
    rows = rows.select("path", "line_no", *(cell(n).alias(n) for n in wanted), *(parse_locale_number(cell(c)).alias(c) for c in PM.values()))
    half = lambda c: F.bool_or(F.coalesce(F.lower(c).rlike("[0-9] *[ap]m"), F.lit(False)))
    facts = rows.withColumn("v", date_order_verdict(F.col("date_beginning"))).groupBy("path").agg(detect_date_order(F.col("v"), F.col("line_no")).alias("day_first"), half("time_beginning").alias("half_a"), half("time_end").alias("half_b"))
    rows = rows.join(few(facts), "path")
    start = parse_export_timestamp(F.col("date_beginning"), F.col("time_beginning"), F.col("day_first"), F.col("half_a"))
    end = parse_export_timestamp(F.col("date_end"), F.col("time_end"), F.col("day_first"), F.col("half_b"))
    out = rows.withColumns({"interval_start": start, "interval_end": end})
    return out.withColumn("ts", F.coalesce("interval_end", "interval_start")).where(F.col("ts").isNotNull()).select("path", "line_no", "interval_start", "interval_end", "ts", *PM.values())


def read_monitor_tsv(lines: DataFrame, station: Column) -> DataFrame:
    """Fields 0, 1, 4 and 6 of tab-separated lines; lines that don't parse are left out. Works on streams."""
    f = F.split("line", "\t", -1)
    at = lambda i: F.get(f, F.lit(i))
    out = lines.where(F.size(f) >= 7).select(station.alias("station"), parse_12h_timestamp(at(0), at(1)).alias("time"), F.trim(at(4)).try_cast("double").alias("pm25"), F.trim(at(6)).try_cast("double").alias("pm10"))
    return out.dropna("any", subset=["time", "pm25", "pm10"])


def read_m0_log(lines: DataFrame, line: str = "line") -> DataFrame:
    """Lines with the token M0 and ten numbers after it."""
    t = F.split(F.trim(F.col(line)), r"\s+")
    nums = F.transform(F.slice(t, F.array_position(t, F.lit("M0")).cast("int") + 1, 10), lambda x: x.try_cast("double"))
    ok = lines.where(F.array_contains(t, "M0")).withColumn("_n", nums).where((F.size("_n") == 10) & F.forall("_n", lambda x: x.isNotNull()))
    names = ((0, "temp_c"), (3, "rh_percent"), (4, "pressure_hpa"), (5, "wind_speed_ms"), (6, "wind_dir_deg"))
    return ok.select("*", *(F.col("_n")[i].alias(n) for i, n in names)).drop("_n")


def read_m22_log(lines: DataFrame, line: str = "line", layout: str = "seq") -> DataFrame:
    """channels: map of the 22 named fields after M22. Layout 'seq': R, Seq, Wifi, ..., then an optional unix time and
    date; layout 'flag': a flag, R, Wifi, ... without Seq, then unix time and date."""
    # one array of one row, so that a line is cut once and not again in each condition and field
    cut = lines.where(F.col(line).contains("M22")).select("*", F.explode(F.array(F.split(F.trim(F.col(line)), r"\s+"))).alias("_t"))
    t = F.col("_t")
    cut = cut.withColumns({"_at": F.array_position(t, F.lit("M22")).cast("int"), "_timed": (F.size(t) >= 2) & is_number_like(F.try_element_at(t, F.lit(-2)))})
    at, timed = F.col("_at"), F.col("_timed")
    end = F.size(t) - F.when(timed, 2).otherwise(0)
    names = CHANNELS if layout == "seq" else tuple(c for c in CHANNELS if c != "Seq")
    skip = 0 if layout == "seq" else 1
    fields = F.slice(t, at + 1 + skip, len(names))
    ok = cut.where((at > 0) & (F.size(t) >= 8) & (end - at - skip >= len(names)))
    return ok.select("*", F.map_from_arrays(F.array(*map(F.lit, names)), fields).alias("channels"), F.when(timed, F.element_at(t, -2)).alias("unixtime"), F.when(timed, F.element_at(t, -1)).alias("datetime")).drop("_t", "_at", "_timed")


def read_kv_log(lines: DataFrame, line: str = "line") -> DataFrame:
    """pairs: map of key=value parts; parts that begin 0R go, of a repeated key the last value stays."""
    c = F.col(line)
    kept = lines.where((c.contains("Dn=") & c.contains("Ta=") & c.contains("Ua=") & c.contains("Pa=")) | c.contains("Rc="))
    payload = F.replace(F.regexp_extract(line, r"((?:0R1|Dn=|Rc=).*)$", 1), F.lit(" "), F.lit(""))
    parts = F.filter(F.split(payload, ","), lambda p: ~F.upper(F.left(p, F.lit(2))).startswith("0R") & (F.instr(p, "=") > 1))
    # arrays of one row: the parts are cut once, and their names found once, for all that follows
    cut = kept.select("*", F.explode(F.array(F.reverse(parts))).alias("_parts"))
    named = cut.select("*", F.explode(F.array(F.transform("_parts", lambda p: F.substring_index(p, "=", 1)))).alias("_names"))
    first = F.filter("_parts", lambda p, i: F.array_position("_names", F.substring_index(p, "=", 1)) == i + 1)
    pairs = F.transform(F.reverse(first), lambda p: F.struct(F.substring_index(p, "=", 1).alias("k"), F.substr(p, F.instr(p, "=") + 1).alias("v")))
    return named.withColumn("pairs", F.map_from_entries(pairs)).drop("_parts", "_names")


def read_marker_log(lines: DataFrame, line: str = "line", stations=("NIT1", "WS500")) -> DataFrame:
    t = F.split(F.trim(F.col(line)), r"\s+")
    first = lambda test: F.get(F.filter(t, test), F.lit(0))
    r = first(lambda x: x.startswith("R") & is_number_like(F.substring(x, 2, 100)))
    ok = lines.where(F.size(t) >= 6)
    return ok.select("*", t[0].alias("msg_type"), first(lambda x: x.isin(*stations)).alias("station"), F.substring(r, 2, 100).alias("r"), first(lambda x: x.rlike("^M[0-9]{2}$")).alias("m"))


def read_station_day_pages(pages: DataFrame, text: str = "text", date: str = "date") -> DataFrame:
    """Observations of the page's own date: hour, temperature, humidity, pressure (the second number), wind.

    The text is cut before each day.month. line first, so that an observation can't run into the next; a missing
    direction is 0 with wind_calm set.
    """
    clean = F.regexp_replace(F.replace(F.col(text), F.lit("\u00a0"), F.lit(" ")), "[ \t]+", " ")
    records = pages.select(F.col(date).cast("date").alias("date"), F.posexplode(F.split(clean, r"(?=\b\d{2}\.\d{2}\.\s*\n\d{4}\s)")).alias("ordinal", "rec"))
    number, num = "(-?[0-9]+(?:[.,][0-9]+)?)", lambda c: F.replace(c, F.lit(","), F.lit(".")).try_cast("double")
    head, body = F.trim(F.substring_index("rec", "\n", 1)), F.ltrim(F.expr("substring(rec, instr(rec, '\n') + 1)"))
    # what stands before and after the humidity, and after the wind
    before, after = F.substring_index(body, "%|", 1), F.expr("substring(body, instr(body, '%|') + 2)")
    air = F.expr("substring(after, instr(after, 'м/с') + 3)")
    cut = records.where(head.rlike("^[0-9]{2}[.][0-9]{2}[.]$")).withColumns({"head": head, "body": body}).withColumns({"before": before, "after": after}).withColumn("air", air)
    wind = F.replace(F.substring_index("after", "м/с", 1), F.lit("--"), F.lit(" "))
    own = (F.substring("head", 1, 2).cast("int") == F.dayofmonth("date")) & (F.substring("head", 4, 2).cast("int") == F.month("date"))
    found = cut.where(own & F.col("body").contains("%|") & F.col("after").contains("м/с")).select(
        "date",
        "ordinal",
        F.substring("body", 1, 2).try_cast("int").alias("hour"),
        num(F.regexp_extract("before", number + " ?[º°]C", 1)).alias("temp_c"),
        num(F.substring_index("before", "|", -1)).alias("rh_percent"),
        num(F.regexp_extract(F.get(F.split("air", "/"), F.lit(1)), "^ ?([0-9]{3,4}(?:[.,][0-9]+)?)", 1)).alias("pressure_hpa"),
        num(F.regexp_extract(wind, number + " ?$", 1)).alias("wind_speed_ms"),
        F.regexp_extract(wind, r"[(]([0-9]+) ?º", 1).try_cast("double").alias("direction"),
        F.substring_index("after", "м/с", 1).contains("--").alias("calm"),
    )
    whole = found.dropna("any", subset=["hour", "temp_c", "rh_percent", "pressure_hpa", "wind_speed_ms"]).where(F.col("direction").isNotNull() | F.col("calm"))
    return whole.select("date", "ordinal", "hour", "temp_c", "rh_percent", "pressure_hpa", "wind_speed_ms", F.coalesce("direction", F.lit(0.0)).alias("wind_dir_deg"), F.col("direction").isNull().alias("wind_calm"))


def read_sounding_pages(pages: DataFrame, html: str = "html", stop: str = STOP_TEXT) -> DataFrame:
    """pages with lines: the text's lines that aren't blank up to the stop text. Pages without it are left out."""
    lines = F.filter(F.transform(F.split(F.regexp_replace(html, "<[^>]+>", ""), "\n"), lambda x: F.trim(x)), lambda x: x != "")
    marked = pages.withColumn("_lines", lines)
    stops = F.transform("_lines", lambda x: x.contains(stop))
    place = F.array_position(stops, F.lit(True)).cast("int")
    return marked.where(place > 0).withColumn("lines", F.slice("_lines", 1, place)).drop("_lines")


def read_grid_ascii(lines: DataFrame, keys: list[str], missing_as_zero: bool = False) -> DataFrame:
    """keys, line_no, line to keys, block, t, l, i, j, value. A block begins with a name and [ and ends with a blank line."""
    w = Window.partitionBy(*keys).orderBy("line_no")
    head = F.regexp_extract("line", r"^\s*([A-Za-z_][\w.]*)\[", 1)
    mark = F.when(head != "", head).when(F.trim("line") == "", "")
    named = lines.withColumn("block", F.last(mark, ignorenulls=True).over(w)).where((F.coalesce("block", F.lit("")) != "") & (head == ""))
    index = F.transform(F.regexp_extract_all("line", F.lit(r"\[(\d+)\]"), 1), lambda x: x.try_cast("int"))
    values = F.regexp_extract_all(F.regexp_replace("line", r"^\s*(\[\d+\])*,?", ""), F.lit(r"([-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?)"), 1)
    cells = named.withColumns({"ix": index, "vs": values}).select(*keys, "block", "ix", F.posexplode("vs").alias("j", "v"))
    n = F.size("ix")
    value = F.col("v").try_cast("double")
    return cells.select(*keys, "block", F.get("ix", F.lit(0)).alias("t"), F.when(n == 3, F.col("ix")[1]).alias("l"), F.when(n >= 2, F.get("ix", n - 1)).alias("i"), "j", (F.coalesce(value, F.lit(0.0)) if missing_as_zero else value).alias("value"))


def load_report(files: DataFrame, rows: DataFrame, path: str = "path", errors: DataFrame | None = None) -> DataFrame:
    """A row for each file: rows loaded and a status; a file without rows says why. errors: path, error of files that couldn't be read."""
    counts = rows.groupBy(path).agg(F.count(F.lit(1)).alias("rows"))
    out, reason = files.select(path).distinct().join(counts, path, "left"), F.lit("no rows")
    if errors is not None:
        out = out.join(errors.groupBy(path).agg(F.min("error").alias("error")), path, "left")
        reason = F.coalesce("error", reason)
    status = F.when(F.col("rows") > 0, F.lit("Loaded")).otherwise(F.concat(F.lit("Skipped: "), reason))
    return out.select(path, F.coalesce("rows", F.lit(0)).alias("rows"), status.alias("status"))


def require_loaded(report: DataFrame) -> DataFrame:
    """The report's skipped files; fails only if there are files and each of them was skipped."""
    loaded = report.agg(F.count(F.lit(1)).alias("files"), F.count_if(F.col("rows") > 0).alias("loaded")).first()
    if loaded["files"] and not loaded["loaded"]:
        reasons = [r["status"] for r in report.select("status").distinct().orderBy("status").limit(5).collect()]
        raise ValueError(f"none of {loaded['files']} files could be loaded: {'; '.join(reasons)}")
    return report.where(F.col("rows") == 0)


def select_source_files(paths: DataFrame, product: str, path: str = "path") -> DataFrame:
    """File-name rules of the photometer products."""
    name = F.lower(F.element_at(F.split(path, "/"), -1))
    rules = {
        "aod": name.rlike(r"\.xlsx$") & name.rlike("aod|lev15|level.?1.?5") & ~name.rlike("no data|lunar"),
        "ssa": name.endswith(".ssa.xlsx"),
        "sda": name.contains("sda") & ~name.contains("aod") & name.endswith(".xlsx"),
        **{k: name.endswith(f".{k}.xlsx") for k in ("asy", "lid", "rin")},
    }
    return paths.where(rules[product])
