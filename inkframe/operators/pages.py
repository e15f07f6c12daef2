"""Page and project tables: status filters, worklists, progress, signatures, retention."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkframe.constants import AUDIT_RETENTION_DAYS, STATUS_ORDER
from inkframe.functions.geometry import round_to

PENDING = STATUS_ORDER[:3]
FINISHED = STATUS_ORDER[3:]


def status_rank(c: Column) -> Column:
    return F.array_position(F.array(*[F.lit(s) for s in STATUS_ORDER]), c) - 1


def list_projects(projects: DataFrame, search: str = "", sort: str = "updated_at") -> DataFrame:
    """Projects whose name contains ``search`` (case ignored), newest first, or by name."""
    found = projects.where(F.lower("name").contains(search.strip().lower())) if search.strip() else projects
    return found.orderBy(F.asc("name")) if sort == "name" else found.orderBy(F.desc(sort), F.asc("project_id"))


def list_pages(pages: DataFrame, project_id) -> DataFrame:
    return pages.where(F.col("project_id") == project_id).orderBy("idx")


def delete_projects(tables: dict[str, DataFrame], ids: DataFrame) -> dict[str, DataFrame]:
    """Projects, their pages and what hangs off those pages, without the deleted projects.

    ``tables`` holds 'project', 'page' and any tables keyed by page_id.
    """
    gone = ids.select("project_id").distinct()
    pages = tables["page"].join(gone, "project_id", "left_semi").select("page_id")
    out = {"project": tables["project"].join(gone, "project_id", "left_anti"), "page": tables["page"].join(gone, "project_id", "left_anti")}
    for name, df in tables.items():
        if name not in out:
            out[name] = df.join(pages, "page_id", "left_anti")
    return out


def select_pages(pages: DataFrame, ranges: DataFrame, keys: Sequence[str], number: str = "page_no") -> DataFrame:
    """Pages named by "1-3,5" per key, clipped to the pages there are; broken parts are ignored, nothing valid means all.

    Ranges are compared, not exploded, so "1-1000000000" costs one row.
    """
    part = ranges.select(*keys, F.explode(F.split("ranges", ",")).alias("p"))
    m = r"^\s*(\d+)(?:-(\d+))?\s*$"
    lo = F.regexp_extract("p", m, 1).try_cast("long")
    hi = F.coalesce(F.regexp_extract("p", m, 2).try_cast("long"), lo)
    total = pages.groupBy(*keys).agg(F.max(number).alias("__total"))
    spans = part.select(*keys, lo.alias("__lo"), hi.alias("__hi")).where("__lo is not null")
    spans = spans.join(total, list(keys)).select(*keys, F.greatest("__lo", F.lit(1)).alias("__lo"), F.least("__hi", "__total").alias("__hi"))
    spans = spans.where("__lo <= __hi")
    named = pages.alias("p").join(spans.alias("s"), [F.col(f"p.{k}") == F.col(f"s.{k}") for k in keys] + [F.col(number).between(F.col("__lo"), F.col("__hi"))], "left_semi")
    return named.unionByName(pages.join(spans.select(*keys).distinct(), list(keys), "left_anti"))


def exportable_pages(pages: DataFrame, glyphs: DataFrame) -> DataFrame:
    return pages.join(glyphs.select("page_id"), "page_id", "left_semi")


def pending_pages(pages: DataFrame) -> DataFrame:
    return pages.where(F.col("status").isin(*PENDING))


def glyph_fill(glyphs: DataFrame) -> DataFrame:
    """Per page: glyph count and how many hold no text."""
    blank = F.length(F.trim(F.coalesce("text", F.lit("")))) == 0
    return glyphs.groupBy("page_id").agg(F.count(F.lit(1)).alias("glyphs"), F.count_if(blank).alias("blank"))


def _poor() -> Column:
    return (F.col("glyphs") >= 8) & F.col("status").isin(*FINISHED) & (F.col("blank") / F.col("glyphs") >= 0.25)


def poor_pages(pages: DataFrame, glyphs: DataFrame) -> DataFrame:
    return pages.join(glyph_fill(glyphs), "page_id").where(_poor())


def settings_key() -> Column:
    """The stored settings signature, derived from the recognition fields where absent."""
    derived = F.when(F.col("rec_provider") == "local", "A:local-engine:local-tesseract").otherwise(
        F.concat_ws(":", F.col("rec_mode"), F.col("rec_provider"), F.col("rec_model"))
    )
    return F.when(F.col("rec_mode").isNotNull(), F.coalesce("settings_key", derived))


def stale_pages(pages: DataFrame, glyphs: DataFrame, current_key: str) -> DataFrame:
    """Finished pages with glyphs that are poor or were made under other settings."""
    key = settings_key()
    other = key.isNotNull() & (key != current_key)
    return pages.join(glyph_fill(glyphs), "page_id").where(F.col("status").isin(*FINISHED) & (_poor() | other))


def worklist(pages: DataFrame, glyphs: DataFrame, current_key: str) -> DataFrame:
    """Pending and stale pages, each once. The two sets are disjoint by status, so no distinct is needed."""
    j = pages.join(glyph_fill(glyphs), "page_id", "left")
    key = settings_key()
    other = F.coalesce(key.isNotNull() & (key != current_key), F.lit(False))
    stale = F.col("glyphs").isNotNull() & F.col("status").isin(*FINISHED) & (F.coalesce(_poor(), F.lit(False)) | other)
    return j.where(F.col("status").isin(*PENDING) | stale).drop("glyphs", "blank")


def project_progress(pages: DataFrame, done_from: str = "proofread") -> DataFrame:
    done = status_rank(F.col("status")) >= STATUS_ORDER.index(done_from)
    p = pages.groupBy("project_id").agg(F.count(F.lit(1)).alias("pages"), F.count_if(done).alias("done"))
    return p.withColumn("pct", F.floor(F.col("done") * 100 / F.col("pages") + 0.5).cast("long"))


def id_signature(df: DataFrame, keys: Sequence[str], id_col: str, buckets: int = 64) -> DataFrame:
    """Order-free signature of the ids of a key: their count and two sums of hashes.

    It replaces the sorted, joined id list (which would gather a whole key in one row) and changes
    exactly when the set changes, up to 64-bit hash collisions. ``df`` holds each id once.
    """
    h = F.xxhash64(F.col(id_col))
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.sum(h.cast("decimal(38,0)")).alias("__s"), F.bit_xor(h).alias("__x")
    ).select(*keys, "n", F.concat_ws(":", F.col("n").cast("string"), F.col("__s").cast("string"), F.hex("__x")).alias("signature"))


def id_list_signature(df: DataFrame, keys: Sequence[str], id_col: str) -> DataFrame:
    """The readable form: sorted distinct ids joined by commas. For keys known to be small."""
    return df.groupBy(*keys).agg(F.array_join(F.sort_array(F.collect_set(F.col(id_col).cast("string"))), ",").alias("signature"))


def group_counts(glyphs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Glyphs per font group and the rank of the group within its page (most glyphs first, then fixed order)."""
    from pyspark.sql import Window

    fixed = F.array_position(F.array(*[F.lit(g) for g in ("rank", "body", "title", "pageno")]), F.col("grp"))
    c = glyphs.groupBy(*keys, "grp").agg(F.count(F.lit(1)).alias("n"))
    return c.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("n"), fixed)))


def median_pt(glyphs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Median of the positive sizes, one decimal, 0 where there is none."""
    pos = F.when(F.col("pt") > 0, F.col("pt"))
    return glyphs.groupBy(*keys).agg(F.coalesce(round_to(F.median(pos), 1), F.lit(0.0)).alias("pt"))


def set_pt(glyphs: DataFrame, pt: float, grp: str | None = None) -> DataFrame:
    hit = F.lit(True) if grp is None else F.col("grp") == grp
    return glyphs.withColumns({"pt": F.when(hit, F.lit(pt)).otherwise(F.col("pt")), "edited": F.col("edited") | hit})


def emitted_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows per page and section, from any set of tables keyed by page_id; glyphs are split by kind."""
    parts = []
    for section, df in tables.items():
        if section == "glyphs":
            kind = F.when(F.col("kind") == "side", "side_chars").otherwise("text_chars")
            parts.append(df.select("page_id", kind.alias("section")))
        else:
            parts.append(df.select("page_id", F.lit(section).alias("section")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("page_id", "section").agg(F.count(F.lit(1)).alias("n"))


def recent(audit: DataFrame, n: int = 500) -> DataFrame:
    return audit.orderBy(F.desc("ts"), F.desc("id")).limit(n)


def retain(audit: DataFrame, days: int = AUDIT_RETENTION_DAYS, now: Column | None = None) -> DataFrame:
    """Rows younger than the cut-off; without ``now`` the newest row sets it."""
    cutoff = F.expr(f"make_dt_interval({days})")
    if now is not None:
        return audit.where(F.col("ts") > now - cutoff)
    return audit.where(F.col("ts") > audit.agg(F.max("ts")).scalar() - cutoff)


def audit_lines(audit: DataFrame) -> DataFrame:
    """One tab-separated text line per entry."""
    line = F.concat_ws(
        "\t", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"), F.concat(F.lit("模式"), "mode"), F.col("provider"), F.col("domain"),
        F.concat(F.lit("字符数="), F.col("char_count").cast("string")), F.concat(F.lit("批次="), F.col("batches").cast("string")),
    )
    return audit.select("id", line.alias("line"))


def audit_export(audit: DataFrame, path: str) -> None:
    audit_lines(audit).orderBy("id").select(F.col("line").alias("value")).write.mode("overwrite").text(path)
