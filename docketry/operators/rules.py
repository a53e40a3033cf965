"""Rule scan and evidence matching: patterns are literals of one projection, so a page is read once and no
join with the pattern table is needed."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docketry.functions.text import compact, squeezed
from docketry.operators import boxes
from docketry.operators.termscan import term_hits

#: Fixed values: (label, category, pattern) of the procurement lexicon.
PROCUREMENT = (
    ("资格条件", "QUALIFICATION", r"资格条件|资格要求|投标人资格|供应商资格"),
    ("废标/否决", "FATAL", r"废标|否决投标|无效投标|不得参与|一票否决"),
    ("评分项", "SCORING", r"评分标准|评分办法|评审因素|技术评分|商务评分"),
    ("关键日期", "DEADLINE", r"投标截止|开标时间|递交截止|提交截止|响应文件递交"),
    ("签章要求", "SIGNATURE", r"签字盖章|签章|电子签章|法定代表人"),
    ("保证金", "BOND", r"投标保证金|履约保证金|保函"),
    ("证书/业绩", "CREDENTIAL", r"资质证书|认证证书|类似业绩|项目经验|人员证书"),
    ("医疗器械资质", "CREDENTIAL", r"医疗器械经营许可证|医疗器械注册证|医疗器械备案|第二类医疗器械|第三类医疗器械|医疗器械生产许可证|生产企业许可证|ISO\s*13485|产品注册证"),
    ("授权配送", "QUALIFICATION", r"授权委托书|销售授权|区域授权|两票制|配送授权|经销授权"),
    ("医院业绩/售后", "CREDENTIAL", r"三级甲等|三甲医院|医院业绩|同类项目业绩|售后服务承诺|质保期|冷链"),
)
#: Terms that stand for a category.
CATEGORY_TERMS = {
    "QUALIFICATION": ("营业执照", "资格", "供应商", "授权", "两票制", "配送"),
    "FATAL": ("废标", "否决", "无效"),
    "SCORING": ("评分", "业绩"),
    "DEADLINE": ("截止", "开标", "递交"),
    "SIGNATURE": ("签章", "盖章", "法定代表人"),
    "BOND": ("保证金", "保函"),
    "CREDENTIAL": ("证书", "资质", "业绩", "医疗器械", "注册证", "经营许可证", "iso13485", "三甲"),
}
EVIDENCE_CATEGORIES = ("QUALIFICATION", "SIGNATURE", "BOND", "CREDENTIAL")
#: A Latin lexicon for prose without Chinese.
LATIN = (("license", "CREDENTIAL", r"licen[sc]e"), ("mail", "SIGNATURE", r"[a-z0-9._]+@[a-z0-9.]+"), ("address", "QUALIFICATION", r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+"), ("number", "BOND", r"[0-9][0-9][0-9][0-9][0-9]+"))


def occurrences(text: Column, pattern: str) -> Column:
    """array<struct<at, hit>>: each match and its offset from 0. The pattern must not match the empty string."""
    hits = F.regexp_extract_all(text, F.lit(f"(?i){pattern}"), F.lit(0))
    gaps = F.split(text, f"(?i){pattern}", -1)
    before = lambda xs, n: F.aggregate(F.slice(xs, 1, n), F.lit(0), lambda a, x: a + F.length(x))
    return F.transform(hits, lambda h, i: F.struct((before(gaps, i + 1) + before(hits, i)).alias("at"), h.alias("hit")))


def snippet(text: Column, at: Column, hit: Column, radius: int = 110) -> Column:
    left = F.greatest(F.lit(0), at - radius)
    return squeezed(F.substring(text, left + 1, at + F.length(hit) + radius - left))


def polarity(text: Column) -> Column:
    return F.when(text.rlike("不得|禁止|无效|否决|不符合|未提供|缺少"), "NEGATIVE_OR_EXCLUSION").when(text.rlike("必须|须|应当|要求|提供"), "OBLIGATION").otherwise("NEUTRAL")


def scan(pages: DataFrame, doc: str, page: str, text: str, patterns: Sequence[tuple[str, str, str]] = PROCUREMENT) -> DataFrame:
    """(doc, page, seq, label, category, at, hit, quote): one row per match, in page, pattern and text order."""
    each = [F.struct(F.lit(i).alias("rule"), F.lit(label).alias("label"), F.lit(cat).alias("category"), occurrences(F.col(text), p).alias("found")) for i, (label, cat, p) in enumerate(patterns)]
    some = F.col(text).rlike("(?i)" + "|".join(f"(?:{p})" for _, _, p in patterns))  # most lines hold none; null is none
    rows = pages.filter(some).select(doc, page, text, F.explode(F.array(*each)).alias("r"))
    rows = rows.select(doc, page, text, "r.rule", "r.label", "r.category", F.posexplode("r.found").alias("n", "f"))
    rows = rows.select(doc, page, "rule", "n", "label", "category", F.col("f.at").alias("at"), F.col("f.hit").alias("hit"), snippet(F.col(text), F.col("f.at"), F.col("f.hit")).alias("quote"))
    return rows.withColumn("seq", F.row_number().over(Window.partitionBy(doc).orderBy(page, "rule", "n")))


def first_wins(found: DataFrame, doc: str, page: str) -> DataFrame:
    """Of equal (category, label, quote, page) the lowest seq stays; ids keep their gaps."""
    keep = found.groupBy(doc, page, "category", "label", "quote").agg(F.min("seq").alias("seq"))
    return keep.withColumn("requirement_id", F.format_string("REQ-%04d", "seq")).withColumn("severity", F.when(F.col("category").isin("FATAL", "QUALIFICATION"), "HIGH").otherwise("MEDIUM")).withColumn("criticality", F.when(F.col("category") == "SCORING", "SOFT").otherwise("HARD"))


def terms(title: Column, category: Column) -> Column:
    own = F.transform(F.regexp_extract_all(title, F.lit(r"[一-鿿]{2,8}|[A-Za-z]{3,}"), F.lit(0)), F.lower)
    lexicon = F.array().cast("array<string>")
    for name, words in CATEGORY_TERMS.items():
        lexicon = F.when(category == name, F.array(*map(F.lit, words))).otherwise(lexicon)
    return F.array_distinct(F.concat(own, lexicon))


def match_evidence(requirements: DataFrame, evidence: DataFrame) -> DataFrame:
    """requirements (doc, requirement_id, title, category) and evidence (doc, page, text, ocr_status) -> status,
    matched_terms and the first page that holds a term by itself.

    Terms are looked for in all pages joined without white space, so a term may run over a page break; pages
    whose recognition failed are left out. A match is NEEDS_REVIEW, never PASS. The text is read once, by
    `termscan.term_hits`, and does not stand beside the requirements."""
    good = evidence.filter(~F.coalesce(F.col("ocr_status") == "FAILED", F.lit(False))).select("doc", "page", compact(F.col("text")).alias("text"))
    key = ["doc", "title", "category"]
    asked = requirements.select(*key).distinct().select(*key, F.posexplode(terms(F.col("title"), F.col("category"))).alias("at", "term"))
    hits = term_hits(asked.select("doc", "term"), good)
    found = asked.join(hits, ["doc", "term"]).groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("at", "term"))).alias("found"), F.min("page").alias("evidence_page"))
    found = found.select(*(F.col(k).alias(f"__{k}") for k in key), F.col("found.term").alias("__terms"), "evidence_page")
    same = F.lit(True)
    for k in key:
        same = same & requirements[k].eqNullSafe(F.col(f"__{k}"))
    rows = requirements.join(found, same, "left").withColumn("matched_terms", F.coalesce("__terms", F.array().cast("array<string>"))).drop("__terms", *(f"__{k}" for k in key))
    hit = (F.size("matched_terms") > 0) & F.col("evidence_page").isNotNull()
    status = F.when(~F.col("category").isin(*EVIDENCE_CATEGORIES), F.lit(None)).when(hit, "NEEDS_REVIEW").otherwise("UNKNOWN")
    return rows.withColumn("status", status).withColumn("suggested_status", F.when(F.col("status") == "NEEDS_REVIEW", "PASS"))


#: Terms that make a candidate of a category strong, and patterns with their bonus.
STRONG_TERMS = {
    "QUALIFICATION": ("申请人的资格要求", "资格审查要求", "须提供", "满足《中华人民共和国政府采购法》"),
    "FATAL": ("废标", "无效投标", "否决投标", "不得参与", "不得参加"),
    "DEADLINE": ("投标截止时间", "递交截止时间", "开标时间", "提交投标文件截止时间"),
    "SIGNATURE": ("签字盖章", "电子签章", "电子签名", "加盖投标人公章"),
    "BOND": ("保证金金额", "不收取保证金", "不缴纳", "按时到账"),
    "CREDENTIAL": ("证书扫描件", "资质证书", "有效期内", "原件扫描件", "每提供"),
    "SCORING": ("分值", "得分", "每提供", "评分标准", "类似项目业绩"),
}
BONUSES = {
    "DEADLINE": (r"20\d{2}\s*年\s*\d{1,2}\s*月\s*\d{1,2}\s*日", 10),
    "BOND": (r"\d+(?:\.\d+)?\s*万?元", 8),
    "SCORING": (r"\d+(?:\.\d+)?\s*分", 8),
    "CREDENTIAL": (r"证书|资质|认证", 6),
}


def candidate_score(category: Column, quote: Column, strong: dict[str, tuple[str, ...]] = STRONG_TERMS, bonuses: dict[str, tuple[str, int]] = BONUSES) -> Column:
    """Four points a strong term, the category's bonus, and a penalty for lines of leaders."""
    points = [F.when((category == c) & F.contains(quote, F.lit(w)), 4).otherwise(0) for c, words in strong.items() for w in words]
    points += [F.when((category == c) & quote.rlike(pattern), n).otherwise(0) for c, (pattern, n) in bonuses.items()]
    held = lambda c: F.length(quote) - F.length(F.replace(quote, F.lit(c), F.lit("")))
    points.append(F.when((held(".") > 20) | (held("…") > 10), -100).otherwise(0))
    return sum(points[1:], points[0])


def overlaps(items: DataFrame, others: DataFrame, page: str, item: str) -> DataFrame:
    """(page, item, touching, overlap): how many other intervals [lo, hi) of the same page each one meets, and
    the summed length of what they share."""
    pairs = boxes.met(items, others, page, [("lo", "hi")]).filter(F.col(f"a.{item}") != F.col(f"b.{item}"))
    shared = F.least("a.hi", "b.hi") - F.greatest("a.lo", "b.lo")
    found = pairs.groupBy(F.col(f"a.{page}").alias(page), F.col(f"a.{item}").alias(item)).agg(F.count("*").alias("touching"), F.sum(shared).alias("overlap"))
    every = items.select(page, item).distinct().join(found, [page, item], "left")
    return every.select(page, item, F.coalesce("touching", F.lit(0)).alias("touching"), F.round(F.coalesce("overlap", F.lit(0.0)), 6).alias("overlap"))


def locator_or_page(block_label: Column, page_label: Column, page: Column) -> Column:
    return F.coalesce(block_label, page_label, F.concat(F.lit("第 "), page.cast("string"), F.lit(" 页")))


def located(found: DataFrame, pages: DataFrame, doc: str, page: str) -> DataFrame:
    """Add title and locator to the rows of `scan`: the label of the page's first block that holds the hit, else the
    page's own. pages: (doc, page, label, blocks array<struct<text, label>>)."""
    both = found.join(pages.select(doc, page, "label", "blocks").withColumnRenamed("label", "page_label"), [doc, page], "left")
    block = F.get(F.filter(F.coalesce("blocks", F.array().cast("array<struct<text:string,label:string>>")), lambda b: F.contains(b["text"], F.col("hit")) & b["label"].isNotNull()), 0)
    return both.withColumns({"title": F.left("quote", F.lit(160)), "locator": locator_or_page(block["label"], F.col("page_label"), F.col(page))}).drop("page_label", "blocks")


def with_citation(matched: DataFrame, pages: DataFrame) -> DataFrame:
    """Add to the rows of `match_evidence` the citation: of the evidence page the first block that holds a term, its
    place, its quote, the score and the state of its review. pages: (doc, page, text, label, filename, blocks)."""
    cited = pages.select("doc", F.col("page").alias("evidence_page"), F.col("text").alias("page_text"), F.col("label").alias("page_label"), "filename", "blocks")
    rows = matched.join(cited, ["doc", "evidence_page"], "left").withColumn("asked", terms(F.col("title"), F.col("category")))
    block = F.get(F.filter("blocks", lambda b: F.exists("asked", lambda t: F.contains(compact(b["text"]), t))), 0)
    rows = rows.withColumn("block", block)
    found = F.col("status") == "NEEDS_REVIEW"
    quote = F.left(squeezed(F.coalesce("block.text", "page_text")), F.lit(240))
    return rows.withColumns({"locator": F.when(found, locator_or_page(F.col("block.label"), F.col("page_label"), F.col("evidence_page"))), "evidence_quote": F.when(found, quote), "rule_score": F.when(found, F.size("matched_terms")), "match_review_status": F.when(found, "PENDING")}).drop("asked", "block", "blocks", "page_text", "page_label")
