"""Prompt packs: texts of example blocks, cut back into rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# --- fixed values -------------------------------------------------------------
#: Header of a block in a scored pack, and in a raw sample pack.
SCORED_HEADER = r"^\s*\[([BC]\d+)\] \((?:total|peak) -?[0-9.]+\)\s*$"
RAW_HEADER = r"^\s*\[(\d+)\]\s*$"
#: Lines that end the example section.
SENTINELS = ("CLEAN CONTROL", "Based on what you see", "Return ONLY")
ANNOTATION = r"(?s)<<(.*?)\|[0-9.]+>>"
TURN_END = "<|eot_id|>"
# ------------------------------------------------------------------------------


def parse_pack(packs: DataFrame, *, raw: bool = False) -> DataFrame:
    """(pack_id, block_id, place, prompt, response) of packs(pack_id, text).

    Lines are numbered; headers start blocks (a running count), PROMPT and RESPONSE lines
    start fields (another), what follows continues them.  Nothing behind a sentinel line
    counts.  Token annotations and turn ends are taken out of responses.
    """
    lines = packs.select("pack_id", F.posexplode(F.split("text", "\n")).alias("at", "line"))
    w = Window.partitionBy("pack_id").orderBy("at")
    stop = F.lit(False)
    for s in SENTINELS:
        stop = stop | F.startswith("line", F.lit(s))
    lines = lines.withColumn("over", F.sum(stop.cast("int")).over(w)).where("over = 0")
    header = F.regexp_extract("line", RAW_HEADER if raw else SCORED_HEADER, 1)
    lines = lines.withColumn("header", header).withColumn("block", F.sum((F.col("header") != "").cast("int")).over(w)).where("block > 0")
    kind = F.when(F.col("header") != "", "header").when(F.startswith("line", F.lit("PROMPT: ")), "prompt").when(F.startswith("line", F.lit("RESPONSE: ")), "response")
    inner = Window.partitionBy("pack_id", "block").orderBy("at")
    lines = lines.withColumn("field", F.last(kind, ignorenulls=True).over(inner)).withColumn("text", F.when(F.startswith("line", F.lit("PROMPT: ")), F.substring("line", 9, 2**31 - 1)).when(F.startswith("line", F.lit("RESPONSE: ")), F.substring("line", 11, 2**31 - 1)).otherwise(F.col("line")))
    # a later PROMPT or RESPONSE line starts its field anew
    lines = lines.withColumn("start", F.max(F.when(kind.isin("prompt", "response"), F.col("at"))).over(Window.partitionBy("pack_id", "block", "field")))
    body = lambda name: F.array_join(F.transform(F.array_sort(F.collect_list(F.when((F.col("field") == name) & (F.col("at") >= F.col("start")), F.struct("at", "text")))), lambda x: x["text"]), "\n")
    out = lines.groupBy("pack_id", "block").agg(F.max("header").alias("block_id"), body("prompt").alias("prompt"), body("response").alias("response"))
    clean = F.regexp_replace(F.replace(F.regexp_replace("response", ANNOTATION, "$1"), F.lit(TURN_END), F.lit("")), r"\s+$", "")
    return out.select("pack_id", "block_id", F.col("block").alias("place"), "prompt", clean.alias("response"))


def parse_any_pack(packs: DataFrame) -> DataFrame:
    """Scored headers where a pack has any, raw ones otherwise."""
    scored = parse_pack(packs)
    rest = packs.join(scored.select("pack_id").distinct(), "pack_id", "left_anti")
    return scored.unionByName(parse_pack(rest, raw=True))
