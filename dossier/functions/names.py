"""Column functions on texts and organisation names: widths, spacing, legacy forms, checks, and candidates from free text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from dossier import rules
from dossier.functions import columns as C

# Words that decide which texts count as names. Names of firms are stand-ins that users replace.
MARKERS = ["有限公司", "有限责任公司", "集团有限公司", "集团", "公司", "co.,ltd", "co., ltd", "limited", "inc.", "llc"]
NO_NAMES = ["有限公司", "有限责任公司", "集团", "公司", "工业技术有限公司", "上海有限公司", "苏州有限公司", "深圳有限公司", "客户", "甲方", "乙方", "供方", "需方", "双方"]
FORM_WORDS = ["服务需求表", "软件购买及服务合同", "合同双方", "一般条款", "地址", "联系人", "联系电话", "电话", "传真", "电子邮件", "softwarelicenceandserviceagreement", "servicesrequestform"]
PROMPT_PARTS = ["不能填入", "乙方，不能"]
LEGACY_CITIES = ["上海", "北京", "广州", "深圳", "天津", "重庆", "沈阳", "青岛", "无锡", "苏州", "成都", "武汉", "杭州", "南京", "西安", "大连", "宁波", "厦门", "常州", "潍坊", "长沙", "郑州", "济南", "合肥"]
PLACEHOLDERS = "新增公司|新增[0-9]家|xx|XX|某某"
CHINESE_ENDINGS = ["有限公司", "有限责任公司", "集团有限公司", "集团", "公司"]
ENGLISH_ENDING = r"Co\.,?\s*Ltd\.?|Limited|Inc\.?|LLC"
EDGE_MARKS = ",:：;；，。[]【】<>《》\"' "

#: The 94 wide forms of ASCII and the wide space, by rule.
WIDE = "".join(chr(0xFF01 + i) for i in range(94)) + "　"
NARROW = "".join(chr(0x21 + i) for i in range(94)) + " "


def stripped(text: Column) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def composed(text: Column) -> Column:
    """Unicode's composed form (NFC). There is no built-in function for it, so this one runs in Arrow batches."""
    import pandas as pd

    def nfc(s):
        return s.str.normalize("NFC")

    nfc.__annotations__ = dict.fromkeys(("s", "return"), pd.Series)
    return F.pandas_udf(nfc, "string")(text)


def normal_text(text: Column) -> Column:
    """Composed, wide characters narrow, blanks as one, quotes straight, no white space at the ends; missing texts are empty."""
    t = F.translate(composed(F.coalesce(text, F.lit(""))), WIDE, NARROW)
    return stripped(F.translate(F.regexp_replace(t, r"[ \t]+", " "), "‘’“”", "''\"\""))


def legacy_text(text: Column) -> Column:
    """The older form: brackets of one kind, none around titles, blanks and newlines as one."""
    t = F.translate(F.coalesce(text, F.lit("")), "　（）【】〈〉《》", " ()[]()")
    return stripped(F.regexp_replace(F.regexp_replace(t, r"[ \t]+", " "), r"\n+", "\n"))


def compact_cjk(text: Column) -> Column:
    """Without white space between Chinese characters, or between one and a bracket."""
    t = F.translate(F.coalesce(text, F.lit("")), "（）〈〉", "()()")
    return F.regexp_replace(t, r"(?<=[一-龥])\s+(?=[一-龥()])|(?<=[()])\s+(?=[一-龥])", "")


def legacy_company(name: Column) -> Column:
    """The older form of a name: no white space, nothing after a dash, no counts or business words at its end, no marks at its ends."""
    t = F.regexp_replace(compact_cjk(legacy_text(name)), r"\s+", "")
    t = F.regexp_replace(t, "[-_－—].*$", "")
    for tail in (r"\([0-9]+家\)$", r"\([0-9]+\)$", "(?i)(?:维护|项目|外包|升级|SRF|报价单|合同)$"):
        t = F.regexp_replace(t, tail, "")
    return F.btrim(F.btrim(t, F.lit(EDGE_MARKS)), F.lit("()"))


def legacy_key(name: Column) -> Column:
    """A name without white space and titles' brackets, in lower case."""
    return F.lower(F.regexp_replace(F.translate(F.coalesce(name, F.lit("")), "（）【】〈〉《》　", "()[]() "), r"\s+", ""))


def legacy_city(name: Column) -> Column:
    """Without each of the older list's cities, in brackets or at the start, one after another, whatever stays."""
    for city in LEGACY_CITIES:
        name = F.regexp_replace(F.regexp_replace(name, rf"\({city}\)|（{city}）", ""), f"^{city}", "")
    return stripped(name)


def without_code(name: Column) -> Column:
    """Without an accounting code at the end: a dash and letters, perhaps with a number in brackets, or three digits or more in brackets."""
    return stripped(F.regexp_replace(name, r"(?:[-_][A-Za-z]+(?:\([0-9]+\))?|\([0-9]{3,}\))$", ""))


def without_vendors(text: Column, vendors: list[str] = rules.VENDORS) -> Column:
    for v in vendors:
        text = F.replace(text, F.lit(v), F.lit(""))
    return stripped(text)


def without_tail(name: Column) -> Column:
    """Without dates, periods and language marks at the end, three times."""
    for _ in range(3):
        name = F.btrim(F.regexp_replace(name, r"(?i)(?:[0-9]{4}[.\-_]?[0-9]{1,2}[.\-_]?[0-9]{1,2}.*|维护期.*|有效期.*|[0-9]{4}[年.\-_].*|_cn|_en|\.pdf)$", ""), F.lit(" _-&."))
    return name


def cleaned_ocr(text: Column) -> Column:
    """Lines without page numbers, blank lines, and lines that came before."""
    page = r"(?i)^\s*(?:第\s*[0-9]+\s*页\s*(?:共\s*[0-9]+\s*页)?|-\s*[0-9]+\s*-|page\s+[0-9]+\s*(?:of\s+[0-9]+)?|[0-9]+\s*/\s*[0-9]+)?\s*$"
    lines = F.transform(F.split(F.coalesce(text, F.lit("")), r"\r?\n"), lambda x, i: F.struct(x.alias("line"), stripped(x).alias("key"), i.alias("i")))
    real = F.filter(lines, lambda x: ~x["key"].rlike(page))
    first = F.transform(F.array(F.transform(real, lambda x: x["key"])), lambda keys: F.filter(F.transform(real, lambda x, i: F.struct(x["line"].alias("line"), (F.array_position(keys, x["key"]) == i + 1).alias("first"))), lambda x: x["first"]))[0]
    return F.array_join(F.transform(first, lambda x: x["line"]), "\n")


def software_version(text: Column, file_name: Column) -> Column:
    """Product and version in a file name or a text's first 1,500 characters; else any word and version; a version alone; what follows 版本."""
    both = F.concat(F.coalesce(file_name, F.lit("")), F.lit("\n"), F.substring(F.coalesce(text, F.lit("")), 1, 1500))
    number = r"V[0-9]+\.[0-9]+(?:\.[0-9]+)?"
    two = lambda word: F.concat(C.group(both, rf"(?i)({word})\s*({number})", 1), F.lit(" "), C.group(both, rf"(?i)({word})\s*({number})", 2))
    alone = C.group(both, rf"(?i)(?:^|[^0-9A-Za-z_一-龥])({number})(?:$|[^0-9A-Za-z_一-龥])")
    return F.coalesce(two(f"{rules.PRODUCT}[一-龥A-Za-z]*"), two("[一-龥A-Za-z]{2,20}"), alone, stripped(C.group(text, r"版本[：:]\s*([^\n，,]{1,20})")), F.lit(""))


# -- checks -----------------------------------------------------------------------------------------------------------


def has_chinese(text: Column) -> Column:
    return F.coalesce(text, F.lit("")).rlike("[一-龥]")


def has_marker(name: Column) -> Column:
    return C.has_any(F.lower(name), MARKERS)


def is_vendor(key: Column, vendors: list[str] = rules.VENDORS) -> Column:
    """Whether a lower-cased name holds a vendor's, blanks aside."""
    if not vendors:
        return F.lit(False)
    return C.has_any(F.replace(key, F.lit(" "), F.lit("")), [v.lower().replace(" ", "") for v in vendors])


def is_bad_form(form: Column, vendors: list[str] = rules.VENDORS) -> Column:
    """Of a name's legacy_company() form: too short, no name, an ending only, a vendor, or words of a form."""
    low = F.replace(F.lower(form), F.lit(" "), F.lit(""))
    return (F.length(form) < 4) | form.isin(NO_NAMES) | form.rlike("^[()（）一-龥]{0,3}(?:有限公司|有限责任公司|集团|公司)$") | is_vendor(low, vendors) | C.has_any(low, FORM_WORDS)


def is_bad_candidate(name: Column) -> Column:
    return F.coalesce(name, F.lit("")).eqNullSafe("") | is_bad_form(legacy_company(name))


def is_model_company(name: Column) -> Column:
    """Whether a firm's name that a model gave can be trusted: no words of its prompt, no bad candidate."""
    return ~C.has_any(F.coalesce(name, F.lit("")), PROMPT_PARTS) & ~is_bad_candidate(name)


def is_vendor_shaped(name: Column, cities=("上海", "Shanghai"), marks: str = "升维纬禾茵开达", trades=("信息", "软件", "科技", "技术", "咨询", "Information", "Software")) -> Column:
    """A vendor's name as misreadings leave it: its city, one of its characters soon after, then its trade."""
    return name.rlike(rf"(?i)^(?:{'|'.join(cities)})[^，,。]{{1,6}}[{marks}][^，,。]{{0,10}}(?:{'|'.join(trades)})")


def is_chinese_company(name: Column, vendors: list[str] = rules.VENDORS) -> Column:
    """Six characters or more, Chinese first, a firm's ending last, no vendor, no placeholder."""
    good = (F.length(name) >= 6) & name.rlike("^[一-龥]") & name.rlike("(?:有限公司|股份公司)$") & ~C.has_any(F.lower(name), vendors, lower=True) & ~name.rlike(PLACEHOLDERS)
    return F.coalesce(good, F.lit(False))


def date_problem(text: Column) -> Column:
    """Why a written date is refused, empty if it isn't."""
    year = F.year(C.parse_date(text))
    return C.first_of([(F.coalesce(text, F.lit("")) == "", "empty"), (year.isNull(), "no date"), (~year.between(1990, 2040), "year out of range")], "")


def file_year(file_name: Column, low: int = 1995, high: int = 2026) -> Column:
    """The year in a file name: of a date, by five ways of writing it in turn, else the first year within bounds."""
    within = lambda y: F.when(y.between(low, high), y)
    dated = [within(C.group(file_name, f"(20[0-9]{{2}}){rest}").try_cast("int")) for rest in ("年[0-9]{1,2}月", r"\.[0-9]{1,2}\.[0-9]{1,2}", r"\.[0-9]{1,2}月", "_[0-9]{1,2}_[0-9]{1,2}", "年")]
    every = F.filter(F.transform(F.regexp_extract_all(file_name, F.lit("(?:19|20)[0-9]{2}"), 0), lambda y: y.cast("int")), lambda y: y.between(low, high))
    return F.coalesce(*dated, F.get(every, F.lit(0)))


def bounded_year(file_name: Column, low: int = 2000, high: int = 2030) -> Column:
    """The first year of this century in a file name that lies within bounds."""
    return F.get(F.filter(F.transform(F.regexp_extract_all(file_name, F.lit("20[0-9]{2}"), 0), lambda y: y.cast("int")), lambda y: y.between(low, high)), F.lit(0))


# -- candidates -------------------------------------------------------------------------------------------------------

SPAN = r"[A-Za-z0-9一-龥()·&,\-. ]"
FILE_SPAN = r"[A-Za-z0-9一-龥()&,.\- ]"


def names_in(text: Column, span: str = SPAN, endings: tuple[str, ...] = (*CHINESE_ENDINGS, ENGLISH_ENDING), before: str = "") -> Column:
    """Normalised names of a text: for each ending in turn, the shortest spans of 4 characters or more before it; no bad ones, each once whatever its case."""
    each = [F.regexp_extract_all(text, F.lit(f"(?i){before}({span}{{4,{180 if e == ENGLISH_ENDING else 160}}}?(?:{e}))"), 1) for e in endings]
    return good_names(F.concat(*each) if len(each) > 1 else each[0])


def good_names(found: Column) -> Column:
    forms = F.transform(found, lambda x: legacy_company(x))
    both = F.filter(F.transform(forms, lambda c: F.struct(c.alias("name"), legacy_company(c).alias("form"))), lambda x: has_marker(x["name"]) & ~is_bad_form(x["form"]))
    names = F.transform(both, lambda x: x["name"])
    return F.transform(F.array(names), lambda all_names: F.transform(F.array(F.transform(all_names, lambda x: F.lower(x))), lambda low: F.transform(F.filter(F.transform(all_names, lambda x, i: F.struct(x.alias("n"), (F.array_position(low, F.lower(x)) == i + 1).alias("first"))), lambda x: x["first"]), lambda x: x["n"]))[0])[0]


def names_in_file(file_name: Column) -> Column:
    return names_in(compact_cjk(legacy_text(F.regexp_replace(file_name, r"(?<=.)\.[^.]*$", ""))), FILE_SPAN)


_ANY_CHINESE = ("|".join(["有限公司", "有限责任公司", "集团有限公司", "集团", "公司"]),)


def names_bilingual(text: Column) -> Column:
    """Names in the 1,200 characters after BY AND BETWEEN: English ones, then Chinese ones."""
    block = C.group(text, r"(?is)BY AND BETWEEN[:：\s]*(.{0,1200})")
    found = F.concat(F.regexp_extract_all(block, F.lit(f"(?i)({FILE_SPAN}{{4,180}}?(?:{ENGLISH_ENDING}))"), 1), F.regexp_extract_all(block, F.lit(f"({SPAN}{{4,160}}?(?:{_ANY_CHINESE[0]}))"), 1))
    return F.when(block.isNotNull(), good_names(found)).otherwise(F.array().cast("array<string>"))


def names_by_context(text: Column, parties: bool = True) -> Column:
    """Names after 客户, 甲方 and Client; with parties, also those in the 400 characters after 合同双方."""
    text = F.coalesce(text, F.lit(""))
    each = [F.regexp_extract_all(text, F.lit(rf"(?i){word}[：:\s]*({SPAN}{{4,180}}?(?:{ending}))"), 1) for word, ending in (("客户", _ANY_CHINESE[0]), ("甲方", _ANY_CHINESE[0]), ("Client", ENGLISH_ENDING))]
    if parties:
        block = F.coalesce(C.group(text, r"(?s)合同双方[：:\s]*(.{0,400})"), F.lit(""))
        each.append(F.regexp_extract_all(block, F.lit(f"({SPAN}{{4,160}}?(?:{_ANY_CHINESE[0]}))"), 1))
    return good_names(F.concat(*each))
