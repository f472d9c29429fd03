"""Rule verdicts and record contracts as columns: each gives the codes of what fails."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def codes(rules: dict[str, Column]) -> Column:
    """Sorted codes of the rules that hold."""
    return F.array_sort(F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in rules.items()])))


def deterministic_review(articles: DataFrame) -> DataFrame:
    """doc_id, status, reject_codes, warning_codes."""
    title, body = F.col("title"), F.trim("body")
    bare, name = T.delete_spaces(F.col("body")), T.delete_spaces(title)
    ps = T.paragraphs(F.col("body"))
    a = articles.select("doc_id", title.alias("t"), body.alias("b"), F.length(bare).alias("n"), (bare == name).alias("same"), ps.alias("ps"), F.col("publish_date"))
    n, b, count = F.col("n"), F.col("b"), F.size("ps")
    reject = codes({
        "missing_title": F.col("t") == "", "missing_body": b == "", "invalid_publish_date": F.col("publish_date").isNull(),
        "encoding_replacement_character": F.contains(F.concat("t", "b"), F.lit("�")), "title_only_no_news_body": F.col("same") & (n <= 80),
        "video_only_page": F.regexp_replace(b, T.WS, "").rlike(r"^[（(]?点击播放视频[^）)]*[）)]?$"),
    })
    a = a.withColumn("reject_codes", reject)
    short = (n <= 40) & (count <= 1) & (F.size("reject_codes") == 0)
    warn = codes({
        "extremely_short_single_block": short, "short_body_requires_semantic_review": ~short & (n < 180), "attachment_dependent_body": F.contains(b, F.lit("详见附件")) & (n < 220),
        "notice_like_title": F.col("t").rlike("(?:公告|通知|公示|招聘|采购|招标|征集|报名|名单|启事)$"), "abnormal_repeated_paragraphs": (T.repeat_ratio(F.col("ps")) >= 0.5) & (count >= 4),
        "html_or_script_residue": b.rlike(r"(?i)<(?:div|p|span|script|style)\b|&nbsp;|javascript:"),
    })
    a = a.withColumn("warning_codes", warn)
    status = F.when(F.size("reject_codes") > 0, "deterministic_reject").when(F.size("warning_codes") > 0, "deterministic_warning").otherwise("deterministic_pass")
    return a.select("doc_id", status.alias("status"), "reject_codes", "warning_codes")


def message_contract(conversations: DataFrame) -> DataFrame:
    """conv_id, n_turns, roles, failed contract codes: exactly system, user, assistant, none of them empty."""
    turns = conversations.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("m"))
    role = lambda i: F.get("m", F.lit(i))["role"]
    bad = codes({
        "message_count": F.size("m") != 3, "roles": ~(role(0).eqNullSafe(F.lit("system")) & role(1).eqNullSafe(F.lit("user")) & role(2).eqNullSafe(F.lit("assistant"))),
        "empty_content": F.exists("m", lambda x: F.trim(F.coalesce(x["text"], F.lit(""))) == ""),
    })
    return turns.select("conv_id", F.size("m").cast("long").alias("n_turns"), F.array_join(F.transform("m", lambda x: x["role"]), ",").alias("roles"), F.array_join(bad, "|").alias("errors"))


def score_range(value: Column, top: int) -> Column:
    """A judge's score outside its range, or missing."""
    return value.isNull() | ~value.between(0, top)


def failure_class(message: Column) -> Column:
    """The class of a provider's failure; the first that matches counts."""
    order = (
        ("timeout", "timeout|timed out"), ("explicit_rate_limit", "explicit_rate_limit|rate limit|rate_limit|429"), ("quota", "quota|credits? exhausted"), ("explicit_capacity", "explicit_capacity|capacity|overloaded"),
        ("authentication", "authentication|unauthorized|login required"), ("parse", "invalid|structured output|parse"), ("child_process_error", "exit code|child|tool"),
    )
    low, out = F.lower(message), F
    for name, pattern in order:
        out = out.when(low.rlike(pattern), name)
    return out.otherwise("unknown_provider_error")


def target_policy(total: Column, hard: int, preferred: int) -> Column:
    return F.when(total >= preferred, "preferred_target_met").when(total >= hard, "hard_min_met_preferred_not_met").otherwise("hard_min_not_met")


#: Uses that a row of each split may have; fixed values.
USES = ("gradient_usage", "training_usage", "training_eligible", "model_selection_usage", "hyperparameter_selection_usage", "checkpoint_selection_usage", "final_evaluation_usage")
ALLOWED_USES = {"train": USES[:3], "validation": USES[3:6], "test": USES[6:]}


def usage_errors(rows: DataFrame) -> Column:
    """Uses of a row (boolean columns named as USES) that differ from what its split allows; a null never equals."""
    wanted = lambda u: F.col("split").isin(*[s for s, us in ALLOWED_USES.items() if u in us])
    return codes({u: ~F.col(u).eqNullSafe(wanted(u)) for u in USES})


def review_contract(passed: Column, n_issues: Column) -> Column:
    """A review passes without issues or fails with some; anything else is invalid."""
    return passed.isNull() | (passed == (n_issues > 0))


def leak_terms(text: Column, terms: tuple[str, ...], words: tuple[str, ...] = ()) -> Column:
    """Forbidden terms that a text holds, in any case; `words` count only between non-letters."""
    low = F.lower(text)
    found = [F.when(F.contains(low, F.lit(t.lower())), F.lit(t)) for t in terms] + [F.when(low.rlike(rf"(?:^|[^a-z0-9]){w.lower()}(?:[^a-z0-9]|$)"), F.lit(w)) for w in words]
    return F.array_sort(F.array_compact(F.array(*found)))


def generated_flags(text: Column) -> dict[str, Column]:
    """Health of a generated text."""
    lines = T.paragraphs(text)
    zh, letters = (F.length(F.regexp_replace(text, p, "")) for p in (r"[^一-鿿]", r"[^A-Za-z一-鿿]"))
    rest = F.array_join(F.slice(lines, F.lit(2), F.greatest(F.size(lines), F.lit(1))), "")
    return {
        "chinese_characters": zh.cast("long"), "chinese_ratio": F.round(zh / F.greatest(F.lit(1), letters), 6), "normal_title_body": (F.size(lines) >= 2) & (F.length(F.get(lines, F.lit(0))) <= 120) & (F.length(rest) >= 40),
        "empty": F.trim(F.regexp_replace(text, T.WS, "")) == "", "garbled": text.rlike("�|[\\x00-\\x08]"), "non_task": (zh < 20) | (F.size(lines) < 2),
    }


def normalized_date(raw: Column) -> Column:
    """An ISO date, or the date of an ISO timestamp; null (with a warning to be raised) for anything else."""
    x = F.trim(raw)
    return F.coalesce(F.when(x.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(x)), F.to_date(F.when(x.rlike(r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}"), F.try_to_timestamp(x))))


def unsupported_years(fact: Column, source: Column) -> Column:
    """Years that a fact names and its source does not."""
    return F.filter(F.array_distinct(F.regexp_extract_all(fact, F.lit(r"((?:19|20)[0-9]{2})年"), F.lit(1))), lambda y: ~F.contains(source, y))


def stability_codes(severe: Column, consecutive: Column, hits: Column, bleu: Column, rouge: Column, base_bleu: float, base_rouge: float) -> Column:
    return codes({"severe": severe > 1, "consecutive": consecutive > 1, "token_limit": hits > 1, "bleu": bleu < 0.85 * base_bleu, "rouge_l": rouge < 0.90 * base_rouge})
