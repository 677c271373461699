"""Column functions of the ledger: text, amounts, dates. All built-in expressions; nulls and blanks are missing values."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from dossier import rules


def blank(c: Column) -> Column:
    """null for a missing text: null, blank or the word nan."""
    t = F.trim(c)
    return F.when((t != "") & (t != "nan"), c)


def filled(c: Column) -> Column:
    """null for a missing number: null, NaN or 0."""
    return F.when(~F.isnan(c.cast("double")) & (c != 0), c)


def has_any(text: Column, words: list[str], lower: bool = False) -> Column:
    return reduce(lambda a, b: a | b, [text.contains(w.lower() if lower else w) for w in words])


def starts_any(text: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [text.startswith(w) for w in words])


def first_of(cases: list[tuple[Column, object]], otherwise=None) -> Column:
    """The value of the first condition that holds."""
    out = F.lit(otherwise) if not isinstance(otherwise, Column) else otherwise
    for condition, value in reversed(cases):
        out = F.when(condition, value if isinstance(value, Column) else F.lit(value)).otherwise(out)
    return out


def group(text: Column, pattern: str, n: int = 1) -> Column:
    """A capture group of the first match, null without one."""
    return F.nullif(F.regexp_extract(text, pattern, n), F.lit(""))


# -- names ------------------------------------------------------------------------------------------------------------


def strip_city(name: Column, cities: list[str] = rules.CITIES) -> Column:
    """Without cities in brackets, and without one leading city if four characters stay."""
    either = "|".join(cities)
    inner = F.regexp_replace(name, f"[(（](?:{either})[)）]", "")
    rest = F.regexp_replace(inner, f"^(?:{either})", "")
    return F.when(F.length(rest) >= 4, rest).otherwise(inner)


def normalize_company(name: Column) -> Column:
    return F.trim(F.regexp_replace(strip_city(F.translate(name, "（）", "()")), r"\s+", " "))


def is_clean_company(name: Column) -> Column:
    """Whether a text looks like a firm's name: a known ending with two characters before it, no phrase start or clause, 4 to 50 long."""
    v = F.trim(name)
    low = F.lower(v)
    ending = first_of([(low.endswith(e), len(e)) for e in rules.COMPANY_ENDINGS])
    good = ending.isNotNull() & (F.length(v) - ending >= 2) & ~starts_any(v, rules.COMPANY_STARTS) & ~has_any(v, rules.CLAUSES) & F.length(v).between(4, 50)
    return F.coalesce(good, F.lit(False))


def company_problem(name: Column, vendors: list[str] = rules.VENDORS) -> Column:
    """Why a name is refused, empty if it isn't."""
    v = F.trim(name)
    return first_of(
        [
            (name.isNull() | (F.length(v) < 4), "too short"),
            *[(F.lower(v).contains(x.lower()), f"vendor: {x}") for x in vendors],
            ((F.length(v) > 60) & v.contains("注意"), "template text"),
            (starts_any(v, rules.COMPANY_STARTS), "phrase start"),
            (has_any(v, rules.CLAUSES), "clause"),
        ],
        "",
    )


def mostly_english(text: Column, share: float = 0.7, least: int = 3) -> Column:
    t = F.trim(text)
    return (F.length(t) >= least) & (F.length(F.regexp_replace(t, "[^A-Za-z0-9]", "")) / F.greatest(F.length(t), F.lit(1)) > share)


def char_similarity(a: Column, b: Column) -> Column:
    """1 if alike but for brackets, otherwise the Jaccard similarity of the characters; 0 if either is empty."""
    a, b = (F.translate(F.coalesce(x, F.lit("")), "（）", "()") for x in (a, b))
    letters = lambda x: F.array_distinct(F.filter(F.split(x, ""), lambda c: c != ""))
    both = F.size(F.array_union(letters(a), letters(b)))
    return F.when((a == "") | (b == ""), 0.0).when(a == b, 1.0).otherwise(F.size(F.array_intersect(letters(a), letters(b))) / both)


def safe_name(name: Column, otherwise: str = "未命名") -> Column:
    return F.coalesce(F.nullif(F.trim(F.regexp_replace(F.coalesce(name, F.lit("")), rules.ILLEGAL_IN_NAMES, "_")), F.lit("")), F.lit(otherwise))


def version_of(file_name: Column) -> Column:
    """A software version named in a file name, as digits."""
    short = group(file_name, rf"(?i)(?:^|[^0-9A-Za-z_一-龥]){rules.PRODUCT_CODE}([0-9]{{2}})(?:$|[^0-9A-Za-z_一-龥])")
    return F.coalesce(group(file_name, rf"(?i)(?:{rules.PRODUCT}|{rules.PRODUCT_CODE})\s*([0-9]+\.[0-9]+)"), F.when(short.isNotNull(), F.concat(F.substring(short, 1, 1), F.lit("."), F.substring(short, 2, 1))), group(file_name, r"([0-9]+\.[0-9]+)(?:升级|版本)"))


# -- amounts ----------------------------------------------------------------------------------------------------------


def ocr_digits(text: Column) -> Column:
    """Letters misread for digits: O always, I and l beside a digit but not first, S and B after one. Neighbours are those before any change."""
    t = F.regexp_replace(text, "(?<=[0-9])S", "\ue005")  # stand-ins that are no digits yet
    t = F.regexp_replace(t, "(?<=[0-9])B", "\ue008")
    t = F.regexp_replace(t, "(?<=[0-9])[Il]|(?<=.)[Il](?=[0-9])", "\ue001")
    return F.translate(t, "Oo\ue001\ue005\ue008", "00158")


CHINESE_DIGITS = {"零": 0, "一": 1, "二": 2, "三": 3, "四": 4, "五": 5, "六": 6, "七": 7, "八": 8, "九": 9, "两": 2}
CHINESE_UNITS = {"十": 10, "百": 100, "千": 1000, "万": 10000, "亿": 100000000}


def chinese_number(text: Column) -> Column:
    """The value of Chinese numerals: units below 万 gather in a section, which 万 and 亿 multiply. null without numerals."""
    chars = F.filter(F.split(text, ""), lambda c: c.isin([*CHINESE_DIGITS, *CHINESE_UNITS]))
    value = lambda c, table: first_of([(c == k, float(v)) for k, v in table.items()])
    zero = F.lit(0.0)
    start = F.struct(zero.alias("total"), zero.alias("section"), zero.alias("digit"))

    def step(acc, c):
        digit, unit = value(c, CHINESE_DIGITS), value(c, CHINESE_UNITS)
        ten = F.when((unit == 10) & (acc["digit"] == 0), 1.0).otherwise(acc["digit"])
        section = acc["section"] + acc["digit"]
        big = F.struct(F.when(unit == 1e8, (acc["total"] + section) * unit).otherwise(acc["total"] + section * unit).alias("total"), zero.alias("section"), zero.alias("digit"))
        small = F.struct(acc["total"].alias("total"), (acc["section"] + ten * unit).alias("section"), zero.alias("digit"))
        kept = F.struct(acc["total"].alias("total"), acc["section"].alias("section"), digit.alias("digit"))
        return F.when(digit.isNotNull(), kept).when(unit >= 10000, big).otherwise(small)

    total = F.aggregate(chars, start, step, lambda acc: acc["total"] + acc["section"] + acc["digit"])
    return F.when((F.size(chars) > 0) & (total > 0), total)


def normalize_amount(text: Column) -> Column:
    """A written amount as a number: currency signs, 万, numerals, misread digits, thousands commas and dots."""
    s = F.trim(F.regexp_replace(F.trim(text), "[¥￥$€£]", ""))
    wan = group(s, r"^([0-9,，.]+)\s*万$")
    fixed = F.trim(F.translate(ocr_digits(s), ",，", ""))
    dotted = F.concat(F.regexp_extract(fixed, r"^([0-9]{1,3})\.([0-9]{3})$", 1), F.regexp_extract(fixed, r"^([0-9]{1,3})\.([0-9]{3})$", 2))
    dotted = F.nullif(dotted, F.lit("")).try_cast("double")  # an empty text isn't cast, as each failed cast throws and catches an exception
    plain = group(fixed, r"([0-9]+(?:\.[0-9]+)?)").try_cast("double")
    digits = s.rlike(r"^[0-9]+(?:\.[0-9]{1,2})?$")  # most are, and have nothing to be read otherwise
    return F.when(digits, s.try_cast("double")).otherwise(F.coalesce(F.translate(wan, ",，", "").try_cast("double") * 10000, F.when(s.rlike("[" + "".join([*CHINESE_DIGITS, *CHINESE_UNITS]) + "]"), chinese_number(s)), F.when(dotted >= 500, dotted), plain))


def amount_problem(value: Column, field: Column, ranges: dict = rules.AMOUNT_RANGES) -> Column:
    low = first_of([(field == k, float(v[0])) for k, v in ranges.items()], float(rules.DEFAULT_RANGE[0]))
    high = first_of([(field == k, float(v[1])) for k, v in ranges.items()], float(rules.DEFAULT_RANGE[1]))
    return first_of([(value.isNull(), "missing"), (value <= 0, "not positive"), ((value == F.floor(value)) & value.between(1990, 2035), "looks like a year"), (~value.between(low, high), "out of range")], "")


def tax_rate_ok(text: Column) -> Column:
    rate = group(F.trim(text), r"^([0-9]{1,2}(?:\.[0-9]+)?)\s*%?$").try_cast("double")
    return F.coalesce(rate.isin([float(x) for x in rules.TAX_RATES]) | ((rate != F.floor(rate)) & (rate > 0) & (rate <= 17)), F.lit(False))


def normalize_tax_rate(text: Column) -> Column:
    """13, .13 and 13% as 13%, without trailing zeros; other texts unchanged."""
    number = group(F.trim(text), r"^([0-9]*\.?[0-9]+)\s*%?$").try_cast("double")
    scaled = F.when(number < 1, number * 100).otherwise(number)
    shown = F.regexp_replace(F.regexp_replace(F.round(scaled, 4).cast("decimal(12,4)").cast("string"), r"0+$", ""), r"\.$", "")
    return F.when(number.isNotNull(), F.concat(shown, F.lit("%"))).otherwise(text)


# -- dates ------------------------------------------------------------------------------------------------------------


def make_date(y: Column, m: Column, d: Column) -> Column:
    """A date from texts, null if there is none such."""
    parts = [F.lpad(F.nullif(x, F.lit("")), n, "0") for x, n in ((y, 4), (m, 2), (d, 2))]
    return F.try_to_timestamp(F.concat(parts[0], F.lit("-"), parts[1], F.lit("-"), parts[2]), F.lit("yyyy-MM-dd")).cast("date")


def two_digit_year(y: Column) -> Column:
    return F.concat(F.when(y.try_cast("int") <= 30, "20").otherwise("19"), y)


def parse_date(text: Column) -> Column:
    s = F.trim(text)
    by = lambda pattern, *order: [F.regexp_extract(s, pattern, i) for i in order]
    iso = make_date(*by(r"^([0-9]{4})[-/.]([0-9]{1,2})[-/.]([0-9]{1,2})$", 1, 2, 3))
    chinese = make_date(*by(r"^([0-9]{4})\s*年\s*([0-9]{1,2})\s*月\s*([0-9]{1,2})\s*日?$", 1, 2, 3))
    month = make_date(*by(r"^([0-9]{4})\s*年\s*([0-9]{1,2})\s*月$", 1, 2), F.lit("01"))
    y, m, d = by(r"^([0-9]{2})[.-]([0-9]{1,2})[.-]([0-9]{1,2})$", 1, 2, 3)
    short = make_date(two_digit_year(F.nullif(y, F.lit(""))), m, d)
    m, d, y = by(r"^([0-9]{1,2})/([0-9]{2})/([0-9]{2})$", 1, 2, 3)
    american = make_date(two_digit_year(F.nullif(y, F.lit(""))), m, d)
    compact = make_date(*by(r"^([0-9]{4})([0-9]{2})([0-9]{2})$", 1, 2, 3))
    return F.coalesce(iso, chinese, month, short, american, compact)


def repair_date(text: Column) -> Column:
    s = F.regexp_replace(text, r"\s*([-/.])\s*", "$1")
    s = F.regexp_replace(s, r"(?<=[0-9])[Oo](?=[0-9])", "0")
    return F.regexp_replace(s, r"(?<=[0-9]{3})[/|lI](?=[.\-])", "1")


def report_year(sign: Column, effective: Column, start: Column, file_name: Column) -> Column:
    """Year of signing, else of effect, else of the service's start, else in the file name; the start's if over 2 years after signing."""
    named = group(file_name, "(20[0-9]{2}|19[0-9]{2})").try_cast("int")
    parsed = F.transform(F.array(sign, effective, start), lambda x: F.year(parse_date(x)))
    years = F.transform(F.concat(parsed, F.array(named)), lambda y: F.when(y.between(1990, 2040), y))
    # a list of one, so that each date is parsed once
    return F.transform(F.array(years), lambda y: F.when(y[2] - y[0] > 2, y[2]).otherwise(F.coalesce(y[0], y[1], y[2], y[3])))[0]


def period_of(file_name: Column) -> Column:
    """Struct of start and end of a period written in a file name; the first of three forms with two real dates."""
    forms = [r"(20[0-9]{2})([0-9]{2})([0-9]{2})[至\-~](20[0-9]{2})([0-9]{2})([0-9]{2})", r"(20[0-9]{2})年([0-9]{1,2})月([0-9]{1,2})日?[至\-~到](20[0-9]{2})年([0-9]{1,2})月([0-9]{1,2})日?", r"(20[0-9]{2})[._]([0-9]{1,2})[._]([0-9]{1,2})[至\-~_](20[0-9]{2})[._]([0-9]{1,2})[._]([0-9]{1,2})"]
    found = []
    for form in forms:
        x = [F.regexp_extract(file_name, form, i) for i in range(1, 7)]
        start, end = make_date(*x[:3]), make_date(*x[3:])
        found.append(F.when(start.isNotNull() & end.isNotNull(), F.struct(start.alias("start"), end.alias("end"))))
    return F.coalesce(*found)


def period_label(start: Column, end: Column) -> Column:
    days = F.datediff(end, start)
    return F.when(days >= 700, F.concat(F.bround(days / 365, 0).cast("int").cast("string"), F.lit("年"))).when(days >= 335, "一年").otherwise(F.concat(F.bround(days / 30, 0).cast("int").cast("string"), F.lit("个月")))
