"""Scalar functions on text, as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names, patterns, word lists and limits that results depend on.
CITIES = ["北京市", "上海市", "天津市", "重庆市"]
REGIONS = {"内蒙古": "内蒙古自治区", "广西": "广西壮族自治区", "西藏": "西藏自治区", "宁夏": "宁夏回族自治区", "新疆": "新疆维吾尔自治区"}
FUNCTIONS = [
    ("新媒体运营", ["新媒体", "小红书", "公众号", "自媒体", "账号运营", "抖音", "视频运营"]),
    ("短视频/直播运营", ["短视频", "直播"]),
    ("电商运营", ["电商", "跨境", "tiktok", "京东", "淘宝", "店铺", "独立站", "亚马逊"]),
    ("内容/文案策划", ["内容", "文案", "编辑", "编导", "脚本", "撰稿"]),
    ("市场营销/推广", ["市场", "营销", "推广", "获客", "销售", "业务"]),
    ("品牌", ["品牌"]),
    ("活动策划", ["活动"]),
    ("商务/渠道/媒介", ["商务", "渠道", "媒介", "公关", "客户"]),
    ("用户/社群/增长", ["用户运营", "社群", "增长", "拉新", "留存", "促活"]),
    ("通用运营", ["运营"]),
]
AGENT_CATEGORY, AGENT_FUNCTION, OTHER_FUNCTION = "agent_dev", "Agent/AI 开发", "其他"
TREND = "最新进展|最新动态|发展趋势|行业趋势|技术趋势|趋势"
SECRETS = [
    r"(?i)\bsk-[A-Za-z0-9_-]{8,}",
    r"(?i)\bghp_[A-Za-z0-9]{8,}",
    r"(?i)\bgithub_pat_[A-Za-z0-9_]{8,}",
    r"(?i)\bxoxb-[A-Za-z0-9-]{8,}",
    r"(?i)\btvly-[A-Za-z0-9_-]{8,}",
    r"(?i)\b(?:authorization\s*:\s*)?bearer\s+[A-Za-z0-9._~+/=-]{8,}",
    r"\beyJ[A-Za-z0-9_-]{4,}\.[A-Za-z0-9_-]{4,}\.[A-Za-z0-9_-]{4,}\b",
    r"(?i)\b(?:api[_-]?key|access[_-]?token|token|password|passwd|pwd)\s*[:=]\s*[\"']?[^\s\"'&;]{4,}",
]
WRITE_VERBS = ["add", "approve", "assign", "close", "create", "delete", "dismiss", "edit", "fork", "lock", "merge", "push", "remove", "rename", "reopen", "restore", "revert", "star", "subscribe", "transfer", "unassign", "unlock", "unstar", "unsubscribe", "update"]
DESCRIBED_VERBS = ["create", "delete", "merge", "push"]
ASSIGNED_KEYS = "authorization|proxy-authorization|x-api-key|api[-_]?key|access[-_]?token|auth[-_]?token|password|passwd|secret"
REDACTED_ERROR = "remote call failed (details redacted)"
SECRET_KEYS = "password|token|api_key|authorization|secret"


def collapse(text: Column) -> Column:
    """Every run of white space as one blank, none at the ends."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def strip(text: Column) -> Column:
    """Without white space of any kind at the ends."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def shorten(text: Column, most: int, mark: str = "...") -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit(mark))).otherwise(text)


def title(text: Column, most: int = 30) -> Column:
    return shorten(collapse(text), most)


def excerpt(text: Column, most: int = 140) -> Column:
    return shorten(strip(text), most)


def normalise(text: Column) -> Column:
    """Collapsed, and no blank before punctuation, ASCII or CJK."""
    return F.regexp_replace(collapse(text), r" +([,.;:!?，。；：！？、])", "$1")


def table_cell(text: Column) -> Column:
    return F.replace(collapse(text), F.lit("|"), F.lit("\\|"))


def without_fences(text: Column) -> Column:
    return F.regexp_replace(text, r"(?m)^\s*```.*$\n?", "")


def clean_lines(text: Column) -> Column:
    """CRLF to LF, no blanks at line ends, at most one empty line in a row."""
    lf = F.regexp_replace(text, r"\r\n?", "\n")
    return strip(F.regexp_replace(F.regexp_replace(lf, r"(?m)[ \t]+$", ""), r"\n{3,}", "\n\n"))


def clean_list(items: Column) -> Column:
    return F.filter(F.transform(items, strip), lambda x: x.isNotNull() & (x != ""))


def keywords(text: Column) -> Column:
    return clean_list(F.split(text, r"[,，、/|]+"))


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def name_tokens(name: Column) -> Column:
    """Lower-case words of a name, cut at camel case and at what is no letter or digit."""
    cut = F.regexp_replace(F.coalesce(name, F.lit("")), "(?<=[a-z0-9])(?=[A-Z])", " ")
    return F.filter(F.split(F.lower(cut), "[^a-z0-9]+"), lambda t: t != "")


def is_write_tool(name: Column, description: Column) -> Column:
    verbs, said = F.array(*[F.lit(v) for v in WRITE_VERBS]), F.array(*[F.lit(v) for v in DESCRIBED_VERBS])
    return F.arrays_overlap(name_tokens(name), verbs) | F.arrays_overlap(name_tokens(description), said)


def is_sensitive(text: Column) -> Column:
    return F.coalesce(F.rlike(text, F.lit("|".join(f"(?:{p})" for p in SECRETS))), F.lit(False))


def masked_values(text: Column) -> Column:
    """Values after a key that names a credential replaced by [REDACTED], in JSON or in plain text."""
    pattern = rf"(?i)([\"']?[^\s\"']*(?:{SECRET_KEYS.replace('_', '[_-]?')})[^\s\"']*[\"']?\s*[:=]\s*)(\"[^\"]*\"|'[^']*'|[^,}}\s]+)"
    return F.regexp_replace(text, pattern, "$1[REDACTED]")


def redact_error(text: Column) -> Column:
    """Bearer values and assignments to credential names masked; where such a name is still there, a generic text."""
    masked = F.regexp_replace(text, r"""(?i)(bearer)\s+[^\s,;"'<>]+""", "$1 <redacted>")
    masked = F.regexp_replace(masked, rf"""(?i)\b({ASSIGNED_KEYS})\b(\s*[:=]\s*)[^\s,;"'\)]+""", "$1$2<redacted>")
    return F.when(F.rlike(masked, F.lit(rf"(?i)\b({ASSIGNED_KEYS}|bearer)\b")), REDACTED_ERROR).otherwise(masked)


def safe_url(url: Column) -> Column:
    """The URL with a lower-case host, without fragment and default port; null unless it is https with a host, and has no user, blank or control."""
    parts = r"^[hH][tT][tT][pP][sS]://([^/?#@\s]+?)(?::(\d{1,5}))?((?:[/?][^#\s]*)?)(?:#\S*)?$"
    host, port, rest = (F.regexp_extract(url, parts, i) for i in (1, 2, 3))
    shown = F.when((port == "") | (port == "443"), "").otherwise(F.concat(F.lit(":"), port))
    return F.when(F.rlike(url, F.lit(parts)), F.concat(F.lit("https://"), F.lower(host), shown, rest))


def salary(text: Column) -> Column:
    """``a k - b k`` as (min_k, max_k), in either order; null if the whole text is nothing of the kind."""
    pattern = r"(?i)^\s*([\d.]+)\s*k\s*[-–~至]\s*([\d.]+)\s*k\s*$"
    a, b = (F.regexp_extract(text, pattern, i).try_cast("double") for i in (1, 2))
    return F.when(a.isNotNull() & b.isNotNull(), F.struct(F.least(a, b).alias("min_k"), F.greatest(a, b).alias("max_k")))


def province(place: Column) -> Column:
    """The province of the first of several places; the whole country if the text says so anywhere."""
    text = strip(F.coalesce(place, F.lit("")))
    head = strip(F.split(text, "、")[0])
    out = F.when(F.contains(text, F.lit("全国")), "全国")
    for city in CITIES:
        out = out.when(F.startswith(head, F.lit(city)), city[:-1])
    for prefix, name in REGIONS.items():
        out = out.when(F.startswith(head, F.lit(prefix)), name)
    return out.when(F.rlike(head, F.lit("^.+?省")), F.regexp_extract(head, "^(.+?省)", 1)).when(head == "", "未知").otherwise(F.substring(head, 1, 3))


def job_function(category: Column, title_text: Column) -> Column:
    return F.when(category == AGENT_CATEGORY, AGENT_FUNCTION).otherwise(first_match(title_text, FUNCTIONS, OTHER_FUNCTION))


def first_match(text: Column, rules: list[tuple[str, list[str]]], other: str = OTHER_FUNCTION) -> Column:
    """The first rule's name one of whose terms occurs in the lower-cased text."""
    low, out = F.lower(text), None
    for name, terms in rules:
        hit = reduce(lambda a, b: a | b, [F.contains(low, F.lit(t.lower())) for t in terms])
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise(other)


def first_int(text: Column) -> Column:
    return F.coalesce(F.regexp_extract(text, r"-?\d+", 0).try_cast("int"), F.lit(0))


def year_tags(text: Column) -> Column:
    """Distinct years 1900 to 2099, ascending, as whole numbers in the text."""
    found = F.regexp_extract_all(F.concat(F.lit(" "), F.regexp_replace(text, r"\d+", " $0 "), F.lit(" ")), F.lit(r" ((?:19|20)\d{2}) "), F.lit(1))
    return F.array_sort(F.array_distinct(F.transform(found, lambda y: y.cast("int"))))


def is_question(text: Column) -> Column:
    return F.rlike(text, F.lit(r"^\s*[Qq]\s*\d+\b|[?？]\s*$"))


def unit_kind(title_text: Column, body: Column) -> Column:
    """qa before trend (by word, or by two distinct years in title or body) before topic (a titled text) before article."""
    both = F.concat_ws("\n", title_text, body)
    trend = F.rlike(both, F.lit(TREND)) | (F.size(year_tags(both)) >= 2)
    return F.when(is_question(title_text), "qa").when(trend, "trend").when(F.length(F.trim(title_text)) > 0, "topic").otherwise("article")


def cjk_count(text: Column) -> Column:
    return F.length(F.regexp_replace(text, "[^\\u4e00-\\u9fff]", ""))


def token_estimate(text: Column) -> Column:
    cjk = cjk_count(text)
    return F.floor(cjk * 1.4 + (F.length(text) - cjk) / 4).cast("int")


def visible_chars(text: Column) -> Column:
    return F.length(F.regexp_replace(text, r"\s", ""))


def answer(reply: Column) -> Column:
    """The ``answer`` of a JSON reply; null if it is blank, no string or no JSON."""
    found = F.get_json_object(reply, "$.answer")
    return F.when(F.rlike(reply, F.lit(r'"answer"\s*:\s*"')) & (F.length(strip(found)) > 0), found)


def unfenced(reply: Column) -> Column:
    """A JSON reply without the code fence around it."""
    return strip(F.regexp_replace(F.regexp_replace(strip(reply), r"^```(?:json)?\s*\n?", ""), r"\n?```$", ""))


def parsed_reply(reply: Column) -> Column:
    """The answer of a possibly fenced JSON reply, or the text itself where there is none."""
    return F.coalesce(answer(unfenced(reply)), strip(reply))


def json_list(text: Column) -> Column:
    """A JSON array's strings; anything else gives an empty list, and other elements are dropped."""
    raw = F.from_json(text, "array<string>")
    strings = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r'(?:^\[|,)\s*"((?:[^"\\]|\\.)*)"\s*(?=[,\]])'), F.lit(1))
    return F.when(raw.isNull(), F.array().cast("array<string>")).otherwise(F.filter(raw, lambda x: x.isNotNull() & F.array_contains(F.transform(strings, lambda s: F.replace(F.replace(s, F.lit('\\"'), F.lit('"')), F.lit("\\\\"), F.lit("\\"))), x)))


def utc_instant(text: Column) -> Column:
    """An ISO time with an offset as an instant; null without offset or if it is none."""
    return F.when(F.rlike(text, F.lit(r"(?:Z|[+-]\d{2}:?\d{2})$")), F.try_to_timestamp(text))


def freshness_start(days: int) -> Column:
    return F.date_sub(F.current_date(), days)


def expires(now: Column, hours: int = 24) -> Column:
    return now + F.make_dt_interval(hours=F.lit(hours))


def clamp_int(value: Column, low: int, high: int, default: int) -> Column:
    return F.coalesce(F.least(F.lit(high), F.greatest(F.lit(low), value.cast("string").try_cast("int"))), F.lit(default))


def clamp01(value: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), value))


def ratio(part: Column, whole: Column) -> Column:
    return F.when(whole == 0, F.lit(0.0)).otherwise(part / whole)


def rounded(value: Column, places: int) -> Column:
    """A double rounded as Python's ``round``: to the nearest decimal of its exact binary value, ties to even.

    value * 10**places is split into the rounded product and its error (Dekker's product), so that whether it lies above, below or on a tie is known
    exactly. Values too large to have such decimals (2**52 over 10**places) stay as they are; at most 15 places."""
    scale = float(10**places)
    split = lambda x: (x * 134217729.0) - ((x * 134217729.0) - x)  # noqa: E731  the upper half of the bits
    x = value.cast("double")
    high, s_high = split(x), split(F.lit(scale))
    p = x * scale
    error = ((high * s_high - p) + high * (scale - s_high) + (x - high) * s_high) + (x - high) * (scale - s_high)
    low = F.floor(p).cast("double")
    side = (p - low) - 0.5
    up = (side > 0) | ((side == 0) & ((error > 0) | ((error == 0) & (F.pmod(low, F.lit(2.0)) == 1))))
    whole = (low + F.when(up, 1.0).otherwise(0.0)) / scale
    return F.when(F.abs(p) < 2.0**52, F.when((whole == 0) & (x < 0), F.lit(-0.0)).otherwise(whole)).otherwise(x)


def merged(*maps: Column) -> Column:
    """Maps laid over one another, later values winning."""
    out = maps[0]
    for m in maps[1:]:
        later = F.map_keys(m)
        out = F.map_concat(_unkeyed(out, later), m)
    return out


def _unkeyed(m: Column, keys: Column) -> Column:
    return F.map_filter(m, lambda k, v: ~F.array_contains(keys, k))


def canonical_sha(**fields: Column) -> Column:
    """SHA-256 of the fields as compact JSON with sorted keys, nulls included."""
    return F.sha2(F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]), {"ignoreNullFields": "false"}), 256)


def query_hash(text: Column, keep: int = 12) -> Column:
    """What a log may hold of a query: the beginning of its hash, and its length."""
    return F.struct(F.substring(F.sha2(text, 256), 1, keep).alias("query_sha256"), F.length(text).alias("query_length"))


def preview(value: Column, most: int = 500) -> Column:
    """JSON of at most ``most`` characters, longer ones in an envelope that says so."""
    cut = F.to_json(F.struct(F.lit(True).alias("truncated"), F.substring(value, 1, most).alias("preview"), F.length(value).alias("length")))
    return F.when(F.length(value) > most, cut).otherwise(value)


def citations(text: Column) -> Column:
    """Distinct evidence ids in square brackets, in order of first mention."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"\[((?:web|attachment|note|jd)_\d+)\]"), F.lit(1)))


def cited_only(text: Column, ledger: Column) -> Column:
    """The text without citations that the ledger lacks, and with raw URLs masked."""
    unknown = F.array_except(citations(text), ledger)
    kept = F.aggregate(unknown, text, lambda t, x: F.replace(t, F.concat(F.lit("["), x, F.lit("]")), F.lit("")))
    return F.regexp_replace(kept, r"https?://[^\s)\]]+", "[link]")
