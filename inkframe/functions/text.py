"""Column builders for glyph text, JSON in free text, hashes and names."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# ideograph blocks a glyph box may hold (fixed values)
CJK_CLASS = (
    r"\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}\x{20000}-\x{323AF}\x{3007}\x{3021}-\x{3029}\x{3038}-\x{303B}"
)


def is_cjk(c: Column, char_class: str = CJK_CLASS) -> Column:
    return F.coalesce(c.rlike(rf"\A[{char_class}]\z"), F.lit(False))


def sanitize_char(text: Column, note: Column, char_class: str = CJK_CLASS) -> tuple[Column, Column]:
    """Keep script characters only: none left -> null and 'empty', two or more -> first two and 'multi'."""
    kept = F.regexp_replace(text, f"[^{char_class}]", "")
    n = F.length(kept)
    char = F.when(n == 0, F.lit(None)).when(n == 1, kept).otherwise(F.substring(kept, 1, 2))
    tag = F.when(text.isNull(), note).when(n == 0, "empty").when(n == 1, note).otherwise("multi")
    return F.when(text.isNotNull(), char), tag


def is_valid_char(text: Column, note: Column, char_class: str = CJK_CLASS) -> Column:
    one = text.rlike(rf"\A[{char_class}]\z")
    two = text.rlike(rf"\A[{char_class}]{{0,2}}\z")
    return F.when(text.isNull(), True).when(note.eqNullSafe(F.lit("multi")), two).otherwise(one)


def _named(value: Column, then) -> Column:
    """``then`` over a value that is worked out once, however often ``then`` reads it."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def extract_json(c: Column) -> Column:
    """The JSON object inside free text: a fenced block if there is one, then first { to last }."""

    def unfenced(trimmed: Column) -> Column:
        fenced = F.regexp_extract(trimmed, r"```(?:json)?\s*([\s\S]*?)```", 1)
        return F.when(trimmed.rlike(r"```(?:json)?\s*[\s\S]*?```"), F.trim(fenced)).otherwise(trimmed)

    def braces(body: Column) -> Column:
        start = F.locate("{", body)
        end = F.length(body) - F.locate("}", F.reverse(body)) + 1
        found = (start > 0) & body.contains("}") & (end > start)
        return F.when(found, F.substring(body, start, end - start + 1))

    return _named(_named(F.trim(c), unfenced), braces)


def translate_pairs(c: Column, pairs: Sequence[tuple[str, str]]) -> Column:
    """Character-for-character replacement; the first pair of a character wins."""
    table: dict[str, str] = {}
    for a, b in pairs:
        table.setdefault(a, b)
    return F.translate(c, "".join(table), "".join(table.values()))


def fnv1a(c: Column) -> Column:
    """32-bit FNV-1a over UTF-16 code units, lower hex without padding."""
    # cut into code units in one pass: picking them by position would rescan the text every time
    units = F.regexp_extract_all(F.hex(F.encode(c, "UTF-16BE")), F.lit("(.{4})"), F.lit(1))
    h = F.aggregate(
        units,
        F.lit(2166136261).cast("long"),
        lambda acc, u: (acc.bitwiseXOR(F.conv(u, 16, 10).cast("long")) * 16777619).bitwiseAND(F.lit(4294967295)),
    )
    return F.lower(F.hex(h))


def batch_hash(df: DataFrame, keys: Sequence[str], order: Sequence[str], box=("x0", "y0", "x1", "y1")) -> DataFrame:
    """Content signature of a batch: index:count:boxes, hashed. A batch is bounded (64 items)."""
    boxes = F.concat_ws(",", *[F.format_string("%s", _num(F.col(b))) for b in box])
    ordered = F.array_sort(F.collect_list(F.struct(*order, boxes.alias("__b"))))
    out = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), ordered.alias("__l"))
    sig = F.concat_ws(
        ":", F.col(keys[-1]).cast("string"), F.col("n").cast("string"), F.array_join(F.transform("__l", lambda x: x["__b"]), "|")
    )
    return out.withColumn("hash", fnv1a(sig)).drop("__l")


def _num(c: Column) -> Column:
    """A number as text, without a trailing .0 when whole."""
    return F.when(c == F.floor(c), F.floor(c).cast("string")).otherwise(c.cast("string"))


def cache_key(*parts: Column) -> Column:
    """version:provider:model:content hash:ids hash:prompt hash"""
    return F.concat_ws(":", *parts)


def natural_key(c: Column) -> Column:
    """Sort key under which 'p2' comes before 'p10': digit runs, without leading zeros, stand behind their
    length in five digits; case ignored."""
    tokens = F.regexp_extract_all(F.lower(c), F.lit(r"(\d+|\D+)"), F.lit(1))
    padded = F.transform(tokens, lambda x: F.when(x.rlike(r"^\d"), _with_length(F.regexp_replace(x, r"^0+(?=\d)", ""))).otherwise(x))
    return F.array_join(padded, "")


def _with_length(digits: Column) -> Column:
    return F.concat(F.lpad(F.length(digits).cast("string"), 5, "0"), digits)


def url_domain(c: Column) -> Column:
    """Host of a URL (scheme optional), 'unknown' when there is none."""
    full = F.when(c.contains("://"), c).otherwise(F.concat(F.lit("https://"), c))
    host = F.try_parse_url(full, F.lit("HOST"))
    return F.coalesce(F.lower(host), F.lit("unknown"))


def title_hint(c: Column, char_class: str = CJK_CLASS) -> Column:
    kept = F.regexp_replace(F.coalesce(c, F.lit("")), f"[^{char_class}]", "")
    return F.when(F.length(kept) >= 2, kept)


def safe_name(c: Column, default: str) -> Column:
    clean = F.trim(F.regexp_replace(c, r'[\\/:*?"<>|]', "_"))
    return F.when(F.length(clean) > 0, clean).otherwise(default)


# brackets, quoted strings and comments of script text
_TOKENS = (
    r"(\"\"\"[\s\S]*?(?:\"\"\"|\z)|'''[\s\S]*?(?:'''|\z)"
    r"|\"[^\"\\]*(?:\\[\s\S][^\"\\]*)*(?:\"|\z)|'[^'\\]*(?:\\[\s\S][^'\\]*)*(?:'|\z)"
    r"|#[^\n]*|[()\[\]{}]|\n)"
)


def lint_text(df: DataFrame, key: str, text: str, anchors: Sequence[str] = (), name_counts: dict[str, str] | None = None) -> DataFrame:
    """Issues of script text: one row (key, rule, line, detail) per issue.

    Bracket matching runs on nesting levels: depth is the running balance lifted by its running
    minimum, and on one level an opener is followed by its closer. Windows are per text, so a
    group is never larger than the one input row it comes from. ``name_counts`` maps a quoted-name
    prefix to the column holding its expected count.
    """
    base = df.select(key, F.col(text).alias("__t"), *(name_counts or {}).values())

    def issue(rows: DataFrame, rule: str, line: Column, detail: Column) -> DataFrame:
        return rows.select(key, F.lit(rule).alias("rule"), line.cast("long").alias("line"), detail.cast("string").alias("detail"))

    none = F.lit(None)
    t = F.col("__t")
    bad = r"[\x00-\x08\x0b-\x1f\x7f]"
    first_bad = F.regexp_instr(t, F.lit(bad))
    upto = F.substring(t, F.lit(1), first_bad)
    whole = [
        issue(base.where(t.startswith("\ufeff")), "bom", none, none),
        issue(base.where(t.contains("\r")), "carriage_return", none, none),
        issue(
            base.where(first_bad > 0),
            "control_char",
            F.length(upto) - F.length(F.regexp_replace(upto, "\n", "")) + 1,
            F.lower(F.hex(F.ascii(F.substring(t, first_bad, F.lit(1))))),
        ),
    ]
    whole += [issue(base.where(~t.contains(a)), "missing_anchor", none, F.lit(a)) for a in anchors]
    for prefix, expected in (name_counts or {}).items():
        seen = F.size(F.regexp_extract_all(t, F.lit(f'("{prefix}\\d+")'), F.lit(1)))
        whole.append(issue(base.where(seen != F.col(expected)), "count", none, F.concat(F.lit(f"{prefix}:"), seen)))

    rows = base.select(key, F.posexplode(F.split("__t", "\n")).alias("i", "row"))
    tab_hits = rows.where(F.col("row").rlike("^ *\t"))
    whole.append(issue(tab_hits, "tab_indent", F.col("i") + 1, none))

    tok = base.select(key, F.posexplode(F.regexp_extract_all("__t", F.lit(_TOKENS), F.lit(1))).alias("pos", "tok"))
    by_pos = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    newlines = F.length("tok") - F.length(F.regexp_replace("tok", "\n", ""))
    sign = F.when(F.col("tok").isin("(", "[", "{"), 1).when(F.col("tok").isin(")", "]", "}"), -1).otherwise(0)
    tok = tok.withColumns({"sign": sign, "line": F.sum(newlines).over(by_pos) + 1})
    tok = tok.withColumn("bal", F.sum("sign").over(by_pos))
    tok = tok.withColumn("depth", F.col("bal") - F.least(F.lit(0), F.min("bal").over(by_pos)))

    quote = F.substring("tok", 1, 1)
    closed = (
        F.when(F.col("tok").startswith('"""') | F.col("tok").startswith("'''"), (F.length("tok") >= 6) & (F.substring("tok", -3, 3) == F.substring("tok", 1, 3)))
        .when(quote == '"', F.col("tok").rlike(r'\A"[^"\\]*(?:\\[\s\S][^"\\]*)*"\z'))
        .when(quote == "'", F.col("tok").rlike(r"\A'[^'\\]*(?:\\[\s\S][^'\\]*)*'\z"))
        .otherwise(True)
    )
    whole.append(issue(tok.where(~closed), "open_string", F.col("line"), quote))

    brackets = tok.where("sign <> 0").withColumn("level", F.col("depth") + F.when(F.col("sign") < 0, 1).otherwise(0))
    # a closer that finds nothing open: the balance fell, so depth stayed 0 without a partner
    prev_depth = F.coalesce(F.lag("depth").over(Window.partitionBy(key).orderBy("pos")), F.lit(0))
    brackets = brackets.withColumn("orphan", (F.col("sign") < 0) & (prev_depth == 0))
    whole.append(issue(brackets.where("orphan"), "unmatched", F.col("line"), F.col("tok")))
    on_level = Window.partitionBy(key, "level").orderBy("pos")
    paired = brackets.where("not orphan").withColumns(
        {"__before": F.lag("tok").over(on_level), "__after": F.lead("pos").over(on_level)}
    )
    want = F.translate(F.col("tok"), ")]}", "([{")
    whole.append(issue(paired.where((F.col("sign") < 0) & (F.col("__before") != want)), "unmatched", F.col("line"), F.col("tok")))
    whole.append(issue(paired.where((F.col("sign") > 0) & F.col("__after").isNull()), "unclosed", F.col("line"), F.col("tok")))
    out = whole[0]
    for part in whole[1:]:
        out = out.unionByName(part)
    return out
