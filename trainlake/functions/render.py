"""Rows rendered as text for a reader: evidence with its source, the state of the data, a coach's context."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words of the rendered blocks.
NO_EVIDENCE, SUMMARY, POINTS, UNKNOWN = "（知识库暂无相关条目）", "    摘要：", "    要点：", "未知来源"
HEADS = {"profile": "【用户档案】", "metrics": "【聚合指标】", "recent": "【最近运动】", "nutrition": "【营养目标】", "diet": "【最新饮食计划】", "quality": "【数据质量】"}
EVIDENCE_HEAD = "\n\n【循证依据·来自训练知识库】\n"
QUALITY = ["近 28 天 ", " 的运动没有心率数据", " 的训练负荷是按配速估算的（原始文件不含心率，如华为 GPX/TCX 导出）", "。基于负荷的判断（受伤风险、是否需要减量）请留有余地，别当成精确实测值。"]
DIET_PARTS = ["principles", "training_day_example", "rest_day_example"]


def evidence_block(found: DataFrame, most_points: int = 3) -> DataFrame:
    """query_id and evidence: the found articles of each query numbered by place, with organisation (else domain) and year, summary
    and up to three points. found: query_id, nth, title, organization, domain, published_at, summary, key_points; a row with a
    null title says that the query found nothing. At most `top` articles of a query come together."""
    some = lambda c: F.nullif(F.coalesce(F.col(c), F.lit("")), F.lit(""))
    head = F.concat(F.lit("["), F.col("nth").cast("string"), F.lit("] "), "title", F.lit("  —— "), F.coalesce(some("organization"), some("domain"), F.lit(UNKNOWN)), F.coalesce(F.concat(F.lit(" "), F.year("published_at").cast("string")), F.lit("")))
    points = F.slice(F.coalesce("key_points", F.array().cast("array<string>")), 1, most_points)
    line = F.concat_ws("\n", head, F.concat(F.lit(SUMMARY), some("summary")), F.when(F.size(points) > 0, F.concat(F.lit(POINTS), F.array_join(points, "；"))))
    rows = found.groupBy("query_id").agg(F.array_sort(F.collect_list(F.when(F.col("title").isNotNull(), F.struct("nth", line.alias("x"))))).alias("rows"))
    return rows.select("query_id", F.when(F.size("rows") > 0, F.array_join(F.col("rows.x"), "\n")).otherwise(NO_EVIDENCE).alias("evidence"))


def data_quality(hr_missing: Column, estimated: Column) -> Column:
    """A sentence on the shares of activities without heart rate and of estimated load; null where neither is over 0."""
    share = lambda x: F.concat(F.bround(x * 100).cast("int").cast("string"), F.lit("%"))
    missing = F.when(hr_missing > 0, F.concat(F.lit(QUALITY[0]), share(hr_missing), F.lit(QUALITY[1])))
    guessed = F.when(estimated > 0, F.concat(share(estimated), F.lit(QUALITY[2])))
    return F.when(F.coalesce(missing, guessed).isNotNull(), F.concat(F.concat_ws("，", missing, guessed), F.lit(QUALITY[3])))


def context(profile: Column, metrics: Column, recent: Column, evidence: Column, nutrition: Column | None = None, diet: Column | None = None, quality: Column | None = None) -> Column:
    """The blocks of a coach's context in their order; structs as JSON, missing blocks left out, of the diet its principles and
    examples only."""
    part = lambda name, x: F.concat(F.lit(HEADS[name]), x)
    blocks = [part("profile", F.to_json(profile)), part("metrics", F.to_json(metrics)), part("recent", F.to_json(recent))]
    if nutrition is not None:
        blocks.append(part("nutrition", nutrition))
    if diet is not None:
        slim = F.map_filter(diet, lambda k, v: k.isin(*DIET_PARTS))
        blocks.append(F.when(F.size(slim) > 0, part("diet", F.to_json(slim))))
    if quality is not None:
        blocks.append(part("quality", quality))
    return F.concat(F.concat_ws("\n", *blocks), F.lit(EVIDENCE_HEAD), evidence)


def with_targets(plan: Column, target: Column) -> Column:
    """A plan's nutrition (map of numbers) with the computed targets (struct of physio.nutrition_targets()) over it, where they are
    available, so that numbers a model made up don't stay."""
    own = F.coalesce(plan, F.create_map().cast("map<string,bigint>"))
    names = ("target_kcal", "protein_g", "fat_g", "carb_g", "deficit_kcal")
    new = F.create_map(*[x for k in names for x in (F.lit(k), F.coalesce(target[k], F.lit(0).cast("long")))])
    return F.when(F.coalesce(target["available"], F.lit(False)), F.map_concat(F.map_filter(own, lambda k, v: ~k.isin(*names)), new)).otherwise(own)
