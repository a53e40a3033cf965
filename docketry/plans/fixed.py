"""Registered queries in which the fixed patterns and fields act, on notices made of the order lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from docketry.functions import text
from docketry.operators import rules
from docketry.plans.catalog import query

PHRASES = ("资格条件见下", "废标条款：不得参与", "评分标准与技术评分", "投标截止及开标时间", "签字盖章，电子签章", "投标保证金与保函", "类似业绩、人员证书", "医疗器械经营许可证 ISO  13485 iso13485", "授权委托书；两票制", "三甲医院 质保期 冷链", "无关内容", "")
_PHRASE = "[" + ", ".join(f"'{p}'" for p in PHRASES) + "]"


@query(
    "SELECT label, category, count(*) AS matches, sum(length(hit))::BIGINT AS characters, count(DISTINCT l_orderkey) AS documents FROM ("
    + " UNION ALL ".join(f"SELECT l_orderkey, '{label}' AS label, '{category}' AS category, unnest(regexp_extract_all({_PHRASE}[l_partkey % 12 + 1] || ' ' || {_PHRASE}[l_suppkey % 12 + 1], '(?i){pattern}')) AS hit FROM lineitem" for label, category, pattern in rules.PROCUREMENT)
    + ") GROUP BY ALL"
)
def procurement_scan(t):
    """The ten fixed patterns over lines of two clauses each."""
    phrase = lambda c: F.element_at(F.array(*map(F.lit, PHRASES)), (F.col(c) % 12 + 1).cast("int"))
    lines = t("lineitem").select("l_orderkey", "l_linenumber", F.concat_ws(" ", phrase("l_partkey"), phrase("l_suppkey")).alias("text"))
    found = rules.scan(lines, "l_orderkey", "l_linenumber", "text")
    return found.groupBy("label", "category").agg(F.count("*").alias("matches"), F.sum(F.length("hit").cast("long")).alias("characters"), F.count_distinct("l_orderkey").alias("documents"))


_NOTICE = (
    ("project_code", "'PRJ-' || l_orderkey::VARCHAR"),
    ("project_name", "'part ' || l_partkey::VARCHAR || ' supply'"),
    ("budget", "CASE WHEN l_partkey % 7 <> 0 THEN l_suppkey::VARCHAR || ' 万元' END"),
    ("ceiling", "CASE WHEN l_suppkey % 3 <> 0 THEN l_suppkey::VARCHAR || '元；' END"),
    ("procurement_method", "'公开招标'"),
    ("purchaser", "'第' || l_suppkey::VARCHAR || '医院'"),
    ("agent", "'代理' || l_suppkey::VARCHAR"),
    ("deadline", "'2024年' || l_linenumber::VARCHAR || '月'"),
    ("contract_end", "repeat('长', least(80, (l_partkey % 90)::INT + 4))"),
    ("bid_bond", "CASE WHEN l_linenumber % 2 <> 0 THEN l_suppkey::VARCHAR || '元' END"),
    ("qualification_ref", "CASE WHEN l_linenumber % 3 = 0 THEN '政府采购法》第二十二条' END"),
    ("device_license", "'医疗器械经营备案凭证'"),
    ("device_registration", "CASE WHEN l_suppkey % 2 = 0 THEN '医疗器械注册证' END"),
)


@query("SELECT name, count(*) AS n, count(DISTINCT value) AS kinds, min(value) AS least, max(length(value))::INT AS longest FROM (" + " UNION ALL ".join(f"SELECT '{name}' AS name, {value} AS value FROM lineitem" for name, value in _NOTICE) + ") WHERE value IS NOT NULL GROUP BY name")
def notice_fields(t):
    """The thirteen fixed fields of notices with empty, stock, personal and long values."""
    c = F.col
    s = lambda x: c(x).cast("string")
    lines = {
        "project_code": F.concat(F.lit("项目编号：PRJ-"), s("l_orderkey")),
        "project_name": F.concat(F.lit("项目名称: part  "), s("l_partkey"), F.lit(" supply")),
        "budget": F.concat(F.lit("预算总金额（元）："), F.when(c("l_partkey") % 7 == 0, "138 1234 5678").otherwise(F.concat(s("l_suppkey"), F.lit(" 万元")))),
        "ceiling": F.concat(F.lit("最高限价："), F.when(c("l_suppkey") % 3 == 0, "详见 ").otherwise(F.concat(s("l_suppkey"), F.lit("元；")))),
        "procurement_method": F.lit("采购方式：公开招标 等"),
        "purchaser": F.concat(F.lit("采购人：第"), s("l_suppkey"), F.lit("医院")),
        "agent": F.concat(F.lit("采购代理机构：：代理"), s("l_suppkey")),
        "deadline": F.concat(F.lit("开标时间：2024年"), s("l_linenumber"), F.lit("月")),
        "contract_end": F.concat(F.lit("合同履约期限："), F.repeat(F.lit("长"), (c("l_partkey") % 90).cast("int") + 4)),
        "bid_bond": F.concat(F.lit("谈判保证金："), F.when(c("l_linenumber") % 2 == 0, "无").otherwise(F.concat(s("l_suppkey"), F.lit("元")))),
        "qualification_ref": F.when(c("l_linenumber") % 3 == 0, "依据《政府采购法》第二十二条").otherwise("依据第二十二条"),
        "device_license": F.lit("医疗器械经营备案凭证"),
        "device_registration": F.when(c("l_suppkey") % 2 == 0, "医疗器械注册证").otherwise("注册证"),
    }
    found = t("lineitem").select(F.explode(text.key_fields(F.concat_ws("\n", *lines.values()))).alias("f")).select("f.*")
    kinds = found.groupBy("name", "value").agg(F.count("*").alias("n"))  # a count alone is hashed, where least values would be sorted
    return kinds.groupBy("name").agg(F.sum("n").alias("n"), F.count("value").alias("kinds"), F.min("value").alias("least"), F.max(F.length("value")).alias("longest"))
