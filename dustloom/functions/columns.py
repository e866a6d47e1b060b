"""Scalar rules as column expressions. Text that doesn't parse becomes NULL, never an error."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values.
SEASONS = ("Winter", "Spring", "Summer", "Autumn")
CLASSES = ("Dust", "Biomass burning", "Urban", "Continental", "Mixed")
DIRECTIONS = ("N", "NE", "E", "SE", "S", "SW", "W", "NW")
MONTH_NAMES = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
#: Month words besides full names and their first three letters.
MORE_MONTHS = {"mart": 3, "sept": 9}
#: Fixed values: (substrings of a variable's name, its unit); the first that fits holds.
UNITS = (
    (("latitude", "longitude"), "degrees"),
    (("zenith", "azimuth", "angle"), "degrees"),
    (("scan_start_time", "time$"), "seconds"),
    (("mass_concentration",), "ug/m3"),
    (("effective_radius",), "um"),
    (("topographic_altitude",), "km"),
    (("wind_speed",), "m/s"),
    (("distance",), "km"),
    (("optical_depth", "aod", "angstrom", "reflectance", "fraction", "ratio", "asymmetry"), "unitless"),
    (("quality", "flag", "mask", "type", "index"), "unitless"),
    (("number_pixels_used",), "count"),
)
EARTH_KM = 6371.0
MEAN_EARTH_KM = 6371.0088
MISSING_AT = -900.0


def parse_locale_number(text: Column) -> Column:
    """A comma makes dots thousands marks and itself the decimal mark; no-break spaces go."""
    t = F.trim(F.replace(text, F.lit(" "), F.lit("")))
    plain = F.when(F.contains(t, F.lit(",")), F.replace(F.replace(t, F.lit("."), F.lit("")), F.lit(","), F.lit("."))).otherwise(t)
    return plain.try_cast("double")


def clean_value(x: Column) -> Column:
    """NULL for NaN, infinities and the sentinel range at or below -900; accepts text or numbers."""
    v = F.trim(x.cast("string")).try_cast("double")
    return F.when(~F.isnan(v) & (F.abs(v) != float("inf")) & (v > MISSING_AT), v)


def parse_date_multi(text: Column) -> Column:
    """dd:MM:yyyy, dd/MM/yyyy, yyyy-MM-dd, MM/dd/yyyy, then a spreadsheet's serial day."""
    t = F.trim(text)
    tried = [F.try_to_timestamp(t, F.lit(f)).cast("date") for f in ("dd:MM:yyyy", "dd/MM/yyyy", "yyyy-MM-dd", "MM/dd/yyyy")]
    serial = t.try_cast("double")
    days = F.when((serial >= 0) & (serial < 2_958_466), F.floor(serial)).cast("int")
    return F.coalesce(*tried, F.date_add(F.lit("1899-12-30").cast("date"), days))


def date_order_verdict(date: Column) -> Column:
    """Day first (true) or month first (false), told by dots or by a number above twelve; NULL where a date doesn't tell."""
    parts = F.split(F.trim(date), "[./-]")
    first, second = F.get(parts, F.lit(0)).try_cast("int"), F.get(parts, F.lit(1)).try_cast("int")
    dots = F.length(date) - F.length(F.replace(date, F.lit("."), F.lit("")))
    return F.when((F.size(parts) >= 3) & (dots >= 2), True).when((first > 12) & (second <= 12), True).when((second > 12) & (first <= 12), False)


def detect_date_order(verdict: Column, line_no: Column) -> Column:
    """Aggregate: the verdict of the first line that tells; month first where none does."""
    return F.coalesce(F.min_by(verdict, F.when(verdict.isNotNull(), line_no)), F.lit(False))


def _first_triple(text: Column, cut: str, fits) -> Column:
    """Of text cut to parts, the first result of fits(part, next, next but one) that isn't NULL; the first three parts are tried before others are looked at."""
    parts = F.split(text, cut)
    at = lambda i: fits(F.get(parts, i), F.get(parts, i + 1), F.get(parts, i + 2))
    later = F.filter(F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 3, F.lit(1))), at), lambda x: x.isNotNull())
    return F.coalesce(at(F.lit(0)), F.when(F.size(parts) > 3, F.get(later, F.lit(0))))


def _last_digits(part: Column) -> Column:
    """The last one or two digits that a part ends with."""
    last, two = F.right(part, F.lit(1)), F.right(part, F.lit(2))
    return F.when(two.rlike("^[0-9][0-9]$"), two).when(last.rlike("^[0-9]$"), last)


def parse_export_timestamp(date: Column, time: Column, day_first: Column, twelve_hours: Column) -> Column:
    """date: three numbers apart by dot, slash or dash; time: h:mm:ss with AM or PM where the file's column has any.

    Texts are cut at their separators; the first three parts in a row that can be a date or a clock count, whatever stands
    around them. The order and the clock choose the format.
    """
    ymd = lambda a, b, c: F.when(b.rlike("^[0-9]{1,2}$") & c.rlike("^[0-9]{4}"), F.concat(_last_digits(a), F.lit("/"), b, F.lit("/"), F.left(c, F.lit(4))))

    def hms(a: Column, b: Column, c: Column) -> Column:
        half = F.upper(F.left(F.ltrim(F.substring(c, 3, 100)), F.lit(2)))
        clock = F.concat(_last_digits(a), F.lit(":"), b, F.lit(":"), F.left(c, F.lit(2)), F.when(half.isin("AM", "PM"), F.concat(F.lit(" "), half)).otherwise(""))
        return F.when(b.rlike("^[0-9]{2}$") & c.rlike("^[0-9]{2}"), clock)

    text = F.concat(_first_triple(date, "[./-]", ymd), F.lit(" "), _first_triple(time, ":", hms))
    parsed = lambda pattern: F.try_to_timestamp(text, F.lit(pattern))
    by_order = lambda hours: F.when(day_first, parsed(f"d/M/yyyy {hours}")).otherwise(parsed(f"M/d/yyyy {hours}"))
    return F.when(twelve_hours, by_order("h:mm:ss a")).otherwise(by_order("H:mm:ss")).cast("timestamp_ntz")


def parse_12h_timestamp(date: Column, time: Column) -> Column:
    return F.try_to_timestamp(F.concat_ws(" ", F.trim(date), F.trim(time)), F.lit("M/d/yyyy h:mm:ss a"))


def parse_time_multi(text: Column) -> Column:
    """HH:mm:ss, HH:mm, or a fraction of a day rounded to seconds; otherwise the text itself."""
    t = F.trim(text)
    fraction = t.try_cast("double")
    seconds = F.pmod(F.round((fraction - F.floor(fraction)) * 86400).cast("long"), F.lit(86400))
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    as_clock = F.concat_ws(":", two(F.floor(seconds / 3600)), two(F.pmod(F.floor(seconds / 60), F.lit(60))), two(F.pmod(seconds, F.lit(60))))
    full = F.try_to_timestamp(t, F.lit("H:mm:ss"))
    short = F.try_to_timestamp(t, F.lit("H:mm"))
    return F.coalesce(F.date_format(full, "HH:mm:ss"), F.date_format(short, "HH:mm:ss"), F.when(fraction.isNotNull(), as_clock), t)


def year_month_from_path(path: Column) -> Column:
    """struct(year, month): first word 20xx and first month word, by the file's name before its folders; NULL unless both."""
    words = F.concat_ws(" ", F.element_at(F.split(path, "/"), -1), F.replace(path, F.lit("/"), F.lit(" ")))
    year = F.regexp_extract(words, r"\b(20\d{2})\b", 1)
    names = {n: i + 1 for i, n in enumerate(MONTH_NAMES)} | {n[:3]: i + 1 for i, n in enumerate(MONTH_NAMES)} | MORE_MONTHS
    table = F.create_map(*(F.lit(x) for pair in names.items() for x in pair))
    hits = F.filter(F.transform(F.regexp_extract_all(F.lower(words), F.lit("([a-z]+)"), 1), lambda w: F.try_element_at(table, w)), lambda m: m.isNotNull())
    month = F.get(hits, F.lit(0))
    return F.when((year != "") & month.isNotNull(), F.struct(year.try_cast("int").alias("year"), month.alias("month")))


def season(month: Column) -> Column:
    """December to February is winter, and so on."""
    return F.element_at(F.array(*map(F.lit, SEASONS)), (F.floor(F.pmod(month, F.lit(12)) / 3) + 1).cast("int"))


def season_order(name: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, SEASONS)), name).cast("int")


def season_year(date: Column) -> Column:
    """December belongs to the next year's winter."""
    return F.year(date) + (F.month(date) == 12).cast("int")


def calendar_fields(df: DataFrame, ts: str) -> DataFrame:
    t = F.col(ts)
    return df.withColumns({
        "year": F.year(t),
        "month": F.month(t),
        "month_name": F.date_format(t, "MMMM"),
        "month_key": F.date_format(t, "yyyy-MM"),
        "season": season(F.month(t)),
        "season_year": season_year(t),
        "hour": F.hour(t),
        "weekday": F.date_format(t, "EEEE"),
    })


def interval_timestamp(start: Column, end: Column) -> Column:
    return F.coalesce(end, start)


def pm_fraction(header: Column) -> Column:
    """The particle size that a column's name tells: PM10, PM4, PM2.5 or PM1, tested in this order.

    First a word that is a size: between dashes, underscores and the name's ends, and up to a space. Then, in the name without
    spaces and without a device's number, a size after pm and a p or pm of its own, if an underscore, a dot, a dash,
    "ambient" or the end follows.
    """
    end = F.lit("\u0001")
    sizes = {"PM10": ("10",), "PM4": ("4",), "PM2.5": ("25", "2.5", "2_5"), "PM1": ("1",)}
    low = F.lower(header)
    words = F.transform(F.split(F.replace(F.trim(low), F.lit("pm2_5"), F.lit("pm2.5")), "[-_]"), lambda w: F.substring_index(w, " ", 1))
    bare = F.regexp_replace(F.replace(low, F.lit(" "), F.lit("")), "pm_enviro_[0-9]+-", "pm")
    rests = F.transform(F.filter(F.split(F.concat(bare, end), "(?=pmp)"), lambda x: x.startswith("pmp")), lambda x: F.substring(x, 4, 200))
    rests = F.transform(rests, lambda x: F.when(x.startswith("m"), F.substring(x, 2, 200)).otherwise(x))

    def follows(rest: Column, digits: str) -> Column:
        n = len(digits) + 1
        return rest.startswith(digits) & (F.substring(rest, n, 1).isin("_", ".", "-", "\u0001") | (F.substring(rest, n, 7) == "ambient"))

    def told(found) -> Column:
        out = F
        for label, forms in sizes.items():
            hit = found(forms[0])
            for form in forms[1:]:
                hit = hit | found(form)
            out = out.when(hit, label)
        return out

    by_words = told(lambda form: F.array_contains(words, f"pm{form}"))
    by_rests = told(lambda form: F.exists(rests, lambda r: follows(r, form)))
    return F.coalesce(by_words, by_rests)


def metric_family(metric: Column) -> Column:
    return F.when(metric.startswith("AOD_"), "AOD").otherwise("AE")


def metric_label(metric: Column) -> Column:
    aod, ae = r"AOD_(\d+)nm", r"(\d+)-(\d+)_Angstrom_Exponent"
    as_ae = F.format_string("AE %s-%s nm", F.regexp_extract(metric, ae, 1), F.regexp_extract(metric, ae, 2))
    return F.when(metric.startswith("AOD_"), F.when(metric.rlike(aod), F.format_string("AOD %s nm", F.regexp_extract(metric, aod, 1))).otherwise(metric)).otherwise(F.when(metric.rlike(ae), as_ae).otherwise(metric))


def metric_order(metric: Column) -> Column:
    """Wavelengths to sort by; names without any come last."""
    aod = F.regexp_extract(metric, r"AOD_(\d+)nm", 1).try_cast("int")
    ae = [F.regexp_extract(metric, r"(\d+)-(\d+)_Angstrom_Exponent", i).try_cast("int") for i in (1, 2)]
    return F.struct((metric_family(metric) == "AE").cast("int").alias("family"), F.coalesce(aod, ae[0], F.lit(9999)).alias("first"), F.coalesce(ae[1], F.lit(9999)).alias("second"))


def infer_unit(name: Column) -> Column:
    low, out = F.lower(name), F.lit("unknown")
    for parts, unit in reversed(UNITS):
        out = F.when(low.rlike("|".join(parts)), unit).otherwise(out)
    return out


def great_circle_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column, radius: float = MEAN_EARTH_KM) -> Column:
    a, b = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((b - a) / 2), 2) + F.cos(a) * F.cos(b) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return F.when(h.isNotNull(), 2 * radius * F.asin(F.least(F.lit(1.0), F.sqrt(h))))


def compass8(degrees: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, DIRECTIONS)), (F.pmod(F.floor(F.pmod(degrees, F.lit(360.0)) / 45 + 0.5), F.lit(8)) + 1).cast("int"))


def duration_text(seconds: Column) -> Column:
    """1h 2m 3s; hours and minutes only from the first that isn't zero."""
    s = F.floor(seconds).cast("long")
    h, m, r = F.floor(s / 3600), F.pmod(F.floor(s / 60), F.lit(60)), F.pmod(s, F.lit(60))
    return F.when(h > 0, F.format_string("%dh %dm %ds", h, m, r)).when(m > 0, F.format_string("%dm %ds", m, r)).otherwise(F.format_string("%ds", r))


def aerosol_class(aod: Column, ae: Column) -> Column:
    dust, burning, urban, continental, mixed = CLASSES
    named = F.when(ae < 0.8, dust).when((aod >= 0.35) & (ae > 1), burning).when((aod > 0.2) & (aod < 0.35) & (ae > 1), urban).when((aod <= 0.2) & (ae >= 0.8), continental).otherwise(mixed)
    return F.when(aod.isNotNull() & ae.isNotNull(), named)


def mean_std_text(mean: Column, std: Column) -> Column:
    """Two decimals; a deviation between 0 and 0.01 has three."""
    return F.when(F.abs(std).between(1e-300, 0.0099999999999), F.format_string("%.2f ± %.3f", mean, std)).otherwise(F.format_string("%.2f ± %.2f", mean, std))


def range_text(low: Column, high: Column, decimals: int = 2) -> Column:
    a, b = F.format_string(f"%.{decimals}f", low), F.format_string(f"%.{decimals}f", high)
    return F.when(a == b, a).otherwise(F.concat(a, F.lit("–"), b))


def strip_html(html: Column) -> Column:
    """Tags become spaces, the usual entities their characters, white space single spaces."""
    out = F.regexp_replace(html, "<[^>]*>", " ")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        out = F.replace(out, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def is_number_like(text: Column) -> Column:
    """Sign, digits, at most one dot, at least one digit; no exponent."""
    return text.rlike(r"^[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)$")


def grid_index(x: Column, first: float, step: float, size: int) -> Column:
    """The nearest of size evenly spaced grid places, held at the ends."""
    return F.greatest(F.lit(0), F.least(F.lit(size - 1), F.floor((x - first) / step + 0.5).cast("int")))


def scale(x: Column, factor: float) -> Column:
    return x * factor


def element_freshness(age_hours: Column, fallback: Column) -> Column:
    return F.when((age_hours < -1) | (age_hours > 120), "stale").when(fallback, "fallback").when(age_hours <= 48, "current").otherwise("aging")


def extrapolated(start: Column, end: Column, epoch: Column) -> Column:
    """Whether either edge of a period lies over 120 hours from the elements' epoch."""
    hours = lambda t: F.abs(F.unix_seconds(t.cast("timestamp")) - F.unix_seconds(epoch.cast("timestamp"))) / 3600
    return F.greatest(hours(start), hours(end)) > 120


def round6(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*(F.round(f.name, digits).alias(f.name) if f.dataType.typeName() in ("double", "float") else F.col(f.name) for f in df.schema))


def month_day_text(date: Column) -> Column:
    return F.date_format(date, "d MMMM yyyy")
