"""Character tables and dictionary lookups.

Long word lists (surnames, domain terms, variant forms) are parameters: a table with one word or
pair per row. Only short fixed tables live here.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkframe.functions.text import CJK_CLASS, is_cjk, translate_pairs

# groups of glyphs that are easily taken for one another (fixed values)
CONFUSION_GROUPS = (
    "倪倮倩", "遷遞邁遴", "為爲", "子孓孑", "銘銭銅", "宗崇", "庭延", "譜溥", "己已巳", "土士",
    "戌戍戊", "未末", "王玉", "日曰", "人入", "大太天", "干千于", "申甲由",
)

# traditional to simplified (fixed values; each pair is written traditional first)
T2S_PAIRS = tuple(
    (p[0], p[1])
    for p in (
        "張张 劉刘 陳陈 趙赵 黃黄 楊杨 鄭郑 吳吴 許许 馮冯 蔣蒋 盧卢 蘇苏 韓韩 蕭萧 閻阎 鍾钟 範范 餘余 龍龙 "
        "葉叶 譚谭 賴赖 龔龚 駱骆 鄒邹 萬万 羅罗 畢毕 華华 顧顾 龐庞 藍蓝 閔闵 賈贾 婁娄 顏颜 諸诸 鈕钮 陸陆 "
        "榮荣 於于 麴曲 儲储 烏乌 車车 宮宫 甯宁 欒栾 鈄钭 厲厉 薊蓟 懷怀 從从 藺蔺 喬乔 陰阴 鬱郁 蒼苍 雙双 "
        "聞闻 黨党 貢贡 勞劳 酈郦 卻却 壽寿 邊边 農农 溫温 別别 莊庄 連连 習习 魚鱼 終终 滿满 國国 廣广 祿禄 "
        "闕阙 東东 歐欧 聶聂 簡简 饒饶 養养 須须 豐丰 關关 後后 荊荆 紅红 遊游 鞏巩 譜谱 諱讳 號号 遷迁 孫孙 "
        "繼继 過过 義义 舉举 進进 隱隐 贈赠 誥诰 選选 補补 縣县 檢检 訓训 導导 諭谕 學学 職职 議议 憲宪 資资 "
        "顯显 監监 塟葬 塋茔 塚冢 緒绪 統统 慶庆 順顺 歲岁 爲为 為为 逺远 囯国 俻备 尓尔 卍万"
    ).split()
)


def to_simplified(c: Column) -> Column:
    return translate_pairs(c, T2S_PAIRS)


def to_traditional(c: Column) -> Column:
    """Reverse of the table; where several forms share a simplified one, the first listed wins."""
    return translate_pairs(c, [(s, t) for t, s in T2S_PAIRS])


def normalize_variants(df: DataFrame, char: str, variants: DataFrame) -> DataFrame:
    """Keep the character and add ``normalized``, its standard form if it is a listed variant.

    Whether ``variants(variant, standard)`` is broadcast is left to Spark's size check.
    """
    v = variants.groupBy("variant").agg(F.min("standard").alias("normalized"))
    return df.join(v, F.col(char) == F.col("variant"), "left").drop("variant")


def term_chars(terms: DataFrame, col: str = "word") -> DataFrame:
    """Distinct characters of the listed words; bounded by the script's character set."""
    chars = terms.select(F.explode(F.split(F.col(col), "")).alias("dict_char"))
    return chars.where("dict_char <> ''").distinct()


def dict_hits(df: DataFrame, col: str, terms: DataFrame, flag: str = "in_dict") -> DataFrame:
    """Flag rows whose value is listed in ``terms(word)``; the join side is left to the optimizer."""
    t = terms.select(F.col("word").alias("__word")).distinct().withColumn("__hit", F.lit(True))
    out = df.join(t, F.col(col) == F.col("__word"), "left")
    return out.withColumn(flag, F.coalesce("__hit", F.lit(False))).drop("__word", "__hit")


def confusion_table(spark: SparkSession) -> DataFrame:
    """char -> peers in group order (fewer than a hundred rows)."""
    return spark.createDataFrame(_peer_rows(), "confused string, peers string")


def expand_candidates(df: DataFrame, primary: str, extras: str, limit: int = 8, out: str = "expanded") -> DataFrame:
    """Primary, then extras, then the confusion peers of each in turn; single ideographs, unique, at most ``limit``."""
    # peers are split and looked through here, once, instead of for each row
    table = _peer_rows()
    ideograph = re.compile("[" + re.sub(r"\\x\{(\w+)\}", lambda m: chr(int(m[1], 16)), CJK_CLASS) + "]")
    listed = F.array(*[F.array(*[F.lit(p) for p in peers if ideograph.fullmatch(p)]).cast("array<string>") for _, peers in table])
    known = F.lit("".join(c for c, _ in table))
    first = F.array_distinct(
        F.filter(F.concat(F.array(F.col(primary)), F.coalesce(F.col(extras), F.array().cast("array<string>"))), lambda c: is_cjk(c))
    )
    peers = F.flatten(F.transform(first, lambda c: F.coalesce(F.get(listed, F.instr(known, c) - 1), F.array().cast("array<string>"))))
    return df.withColumn(out, F.slice(F.array_distinct(F.concat(first, peers)), 1, limit))


def _peer_rows() -> list[tuple[str, str]]:
    peers: dict[str, str] = {}
    for group in CONFUSION_GROUPS:
        for ch in group:
            peers[ch] = peers.get(ch, "") + "".join(p for p in group if p != ch and p not in peers.get(ch, ""))
    return sorted(peers.items())
