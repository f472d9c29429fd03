"""Scalar text functions as Spark columns. All stay in the JVM; nothing here calls Python for a row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space in the Unicode sense, as a Java pattern.
WS = r"(?U)[\s\x1c-\x1f]+"

# Words and patterns whose meaning results depend on.
EVENT_VERBS = ("发布", "签约", "启动", "开幕", "召开", "完成", "保障", "成立", "上线", "投产", "获批", "中标", "揭牌", "交付", "发射", "入轨", "合作", "举行", "举办", "闭幕")
THEMES = {
    "emergency_service": ("抗震", "救灾", "防汛", "抢险", "应急通信", "台风"),
    "corporate_governance": ("业绩", "董事会", "股东", "任命", "党组", "党建"),
    "international_business": ("国际", "海外", "全球", "一带一路"),
    "customer_service": ("客户", "服务", "资费", "权益", "消费"),
    "green_development": ("绿色", "低碳", "节能", "碳达峰", "碳中和"),
    "industry_cooperation": ("签约", "合作", "联盟", "伙伴", "生态"),
    "technology_innovation": ("5g", "6g", "人工智能", "ai", "算力", "云", "大数据", "创新", "研发", "卫星"),
}
DEFAULT_THEME = "corporate_strategy"
FACT_TYPES = (("cooperation", "签署|合作|携手|联合"), ("plan", "未来|计划|将|拟"), ("event", "发布|启动|召开|举行|开展|建设"), ("result", "实现|完成|提升|增长|达到|获得"))
NUMBER = r"(?<![A-Za-z])[0-9]+(?:\.[0-9]+)?(?:%|％)?"
NUMBER_UNIT = r"(?i)[0-9]+(?:\.[0-9]+)?(?:%|％|万|亿|兆|个|项|家|次|年|月|日|天|小时|分钟|秒|公里|米|元|G|GB|TB|P|bps)?"
DATES = (r"[0-9]{4}年[0-9]{1,2}月[0-9]{1,2}日", r"[0-9]{4}年[0-9]{1,2}月", r"[0-9]{4}年", r"[0-9]{1,2}月[0-9]{1,2}日")
METRIC_TOKEN = r"[㐀-䶿一-鿿]|[A-Za-z0-9]+"


def collapse_spaces(x: Column) -> Column:
    """Runs of white space to one space, trimmed."""
    return F.trim(F.regexp_replace(x, WS, " "))


def delete_spaces(x: Column) -> Column:
    return F.regexp_replace(x, WS, "")


def compact(x: Column) -> Column:
    """Lower-case letters a-z, digits and Han characters only."""
    return F.regexp_replace(F.lower(x), r"[^0-9a-z一-鿿]+", "")


def bare_words(x: Column) -> Column:
    """Lower-case without anything that is not a letter, digit or underscore."""
    return F.regexp_replace(F.lower(x), r"[^\p{L}\p{N}_]", "")


def join_evidence(paragraphs: Column) -> Column:
    return F.array_join(F.transform(paragraphs, collapse_spaces), "\n")


def paragraphs(x: Column) -> Column:
    """Trimmed lines that are not blank."""
    return F.filter(F.transform(F.split(x, "\n"), lambda p: F.trim(p)), lambda p: p != "")


def title(x: Column, width: int = 80) -> Column:
    """The first line that is not blank, cut to a width; empty if there is none."""
    return F.coalesce(F.substring(F.get(paragraphs(x), F.lit(0)), 1, width), F.lit(""))


def length_bucket_le(n: Column) -> Column:
    return F.when(n <= 600, "short").when(n <= 1200, "medium").when(n <= 2000, "long").otherwise("very_long")


def length_bucket_lt(n: Column) -> Column:
    return F.when(n < 500, "short").when(n < 1000, "medium").when(n < 2000, "long").otherwise("very_long")


def char_ngrams(x: Column, n: int) -> Column:
    """All character n-grams in order, none where the text is shorter."""
    chars = F.split(x, "")
    grams = lambda c: F.when(F.size(c) >= n, F.transform(F.sequence(F.lit(1), F.size(c) - n + 1), lambda i: F.array_join(F.slice(c, i, n), ""))).otherwise(F.array().cast("array<string>"))
    return F.element_at(F.transform(F.array(F.when(x == "", F.array().cast("array<string>")).otherwise(chars)), grams), 1)


def char_ngram_set(x: Column, n: int) -> Column:
    return F.array_distinct(char_ngrams(x, n))


def whole_or_ngram_set(x: Column, n: int) -> Column:
    """n-grams, or the whole text where it is not longer than n; none for an empty text."""
    return F.when(F.length(x) == 0, F.array().cast("array<string>")).when(F.length(x) <= n, F.array(x)).otherwise(char_ngram_set(x, n))


def char_ngram_range(x: Column, least: int, most: int) -> Column:
    return F.concat(*[char_ngrams(x, n) for n in range(least, most + 1)])


def metric_tokens(x: Column) -> Column:
    """Each Han character, and runs of ASCII letters and digits in lower case."""
    return F.transform(F.regexp_extract_all(x, F.lit(METRIC_TOKEN), F.lit(0)), F.lower)


def mixed_tokens(x: Column) -> Column:
    """ASCII words and bigrams of Han characters."""
    return F.concat(F.regexp_extract_all(F.lower(x), F.lit("[a-z0-9]+"), F.lit(0)), F.flatten(F.transform(F.regexp_extract_all(x, F.lit(r"[一-鿿]+"), F.lit(0)), lambda r: char_ngrams(r, 2))))


def number_tokens(x: Column) -> Column:
    return F.array_sort(F.array_distinct(F.regexp_extract_all(x, F.lit(NUMBER), F.lit(0))))


def number_unit_tokens(x: Column) -> Column:
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(F.lower(x), F.lit(NUMBER_UNIT), F.lit(0)), F.lower)))


def date_tokens(x: Column) -> Column:
    return F.array_sort(F.array_distinct(F.concat(*[F.regexp_extract_all(x, F.lit(p), F.lit(0)) for p in DATES])))


def event_verbs(x: Column) -> Column:
    return F.filter(F.array(*map(F.lit, EVENT_VERBS)), lambda v: F.contains(x, v))


def occurrences(x: Column, word: str) -> Column:
    """Non-overlapping occurrences of a fixed word."""
    return F.size(F.split(x, F.lit(r"\Q" + word + r"\E"), -1)) - 1


def theme(x: Column) -> Column:
    """The theme whose words occur most often; of equals the last by name; a default where none occurs."""
    low = F.lower(x)
    best = F.array_max(F.array(*[F.struct(sum((occurrences(low, w) for w in words), F.lit(0)).alias("n"), F.lit(name).alias("name")) for name, words in THEMES.items()]))
    return F.when(best["n"] > 0, best["name"]).otherwise(DEFAULT_THEME)


def fact_type(x: Column) -> Column:
    out = F
    for name, pattern in FACT_TYPES:
        out = out.when(x.rlike(pattern), name)
    return out.when(F.size(number_tokens(x)) > 0, "number").otherwise("other")


def repeat_ratio(values: Column) -> Column:
    """Share of values that repeat another; 1 where there is none."""
    return F.when(F.size(values) == 0, F.lit(1.0)).otherwise(1.0 - F.size(F.array_distinct(values)) / F.size(values))


def jaccard(a: Column, b: Column, empty: float = 0.0) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(empty)).otherwise(F.size(F.array_intersect(a, b)) / union)


def overlap_coefficient(a: Column, b: Column) -> Column:
    least = F.least(F.size(F.array_distinct(a)), F.size(F.array_distinct(b)))
    return F.when(least == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / least)


def target_text(title_: Column, body: Column) -> Column:
    return F.concat(F.lit("标题："), title_, F.lit("\n\n正文："), body)


def numbered(items: Column) -> Column:
    return F.array_join(F.transform(items, lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x)), "\n")


def sha_rank(seed: str, sep: str, key: Column) -> Column:
    """The key of a seeded order that does not depend on partitions."""
    return F.sha2(F.concat(F.lit(seed + sep), key.cast("string")), 256)


def anomaly_flags(x: Column) -> list[Column]:
    return [
        x.rlike("[０-９]").alias("fullwidth_digit"),
        x.rlike("[�-]").alias("replacement_or_private"),
        x.rlike(r"[\x00-\x08\x0B\x0C\x0E-\x1F]").alias("control_character"),
        x.rlike("[一-鿿] [一-鿿]").alias("ocr_spacing"),
    ]


def risk_features(title_: Column, body: Column) -> dict[str, Column]:
    """Counts behind the structure and policy scores of a candidate."""
    count = lambda p: F.size(F.regexp_extract_all(body, F.lit(p), F.lit(0)))
    numbers = F.size(number_tokens(body)) + F.size(date_tokens(body))
    longest = F.coalesce(F.array_max(F.transform(paragraphs(body), F.length)), F.lit(0))
    entities = count(r"[一-鿿A-Za-z0-9（）()·-]{2,}(?:公司|集团|中心|平台|实验室|大学|研究院|委员会|联盟)")
    relations, stages = count("联合|合作|携手|签署|发布|启动|建设|实现|推动|计划|将"), count("首先|随后|同时|此外|下一步|未来|目前|截至")
    quote = body.rlike(r'[“"](?:我们|我方|本人|我)[，。！？、\s]')
    gap = F.size(F.array_except(F.concat(number_tokens(title_), date_tokens(title_)), F.concat(number_tokens(body), date_tokens(body)))) > 0
    return {
        "max_paragraph_length": longest, "entity_signals": entities, "number_date_signals": numbers, "relation_signals": relations, "stage_signals": stages, "direct_quote": quote, "title_gap": gap,
        "structure_score": longest + 30 * entities + 20 * numbers + 15 * relations + 20 * stages,
        "policy_score": 800 * quote.cast("int") + 300 * gap.cast("int") + 2 * F.length(title_),
    }


#: Phrases of players that stand in for a video; fixed values.
MEDIA_FALLBACK = r"(?i)(?:your browser does not support (?:the )?(?:html5 )?(?:video|audio)(?: tag)?\.?|您的浏览器不支持(?:HTML5)?(?:视频|音频)(?:播放|标签)?。?)"


def media_fallbacks(x: Column) -> tuple[Column, Column]:
    """(text without the phrases, how many there were)."""
    return F.regexp_replace(x, MEDIA_FALLBACK, ""), F.regexp_count(x, F.lit(MEDIA_FALLBACK))


def complete_paragraphs(body: Column, own: Column, fallback: Column) -> Column:
    """(paragraphs, source): a page's paragraphs where they hold its whole body, else the fallback, else the body itself."""
    same = lambda ps: delete_spaces(F.array_join(ps, "")) == delete_spaces(body)
    pick = lambda ps, name: F.struct(ps.alias("paragraphs"), F.lit(name).alias("source"))
    return F.when(same(own), pick(own, "own")).when(same(fallback), pick(fallback, "fallback")).otherwise(pick(F.array(body), "body"))


def yaml_scalar(x: Column) -> Column:
    """A YAML scalar: quoted where it would read as something else."""
    plain = x.rlike(r"^[A-Za-z_./][A-Za-z0-9_./-]*$") & ~F.lower(x).isin("true", "false", "null", "yes", "no", "on", "off")
    return F.when(x.isNull(), "null").when(plain, x).otherwise(F.concat(F.lit("'"), F.replace(x, F.lit("'"), F.lit("''")), F.lit("'")))
