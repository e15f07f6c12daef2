"""Glyph fingerprints, evidence memory, look-alike clusters and label propagation.

A signature is an array of 64-bit words. Equal signatures are collapsed before any comparison, so
copies never multiply pairs.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkframe.constants import CONFIDENCE_THRESHOLD, DICT_CANDIDATE_CONF, DICT_LOW_CONF_MAX, LEGACY_MIN_SIMILARITY, STRUCTURAL_CHARS
from inkframe.functions.text import CJK_CLASS, fnv1a, is_cjk
from inkframe.operators.review import user_locked
from inkframe.session import cut


def hamming(a: Column, b: Column) -> Column:
    """Differing bits of two signatures (arrays of words)."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, n: s + n)


def _segments(sig: Column, bits: int, max_distance: int) -> Column:
    """Values of max_distance + 1 disjoint pieces of the used bits: signatures that close agree in one.

    Piece s holds every (max_distance + 1)-th bit from s on, so a blank border does not make a piece
    the same everywhere.
    """
    pieces = max_distance + 1
    if bits < pieces:
        raise ValueError(f"{bits} bits cannot be cut into {pieces} pieces")
    bit = lambda i, j: F.shiftleft(F.getbit(sig[i // 64], F.lit(i % 64)).cast("long"), j)
    values = []
    for s in range(pieces):
        value = F.lit(0).cast("long")
        for j, i in enumerate(range(s, bits, pieces)):
            value = value.bitwiseOR(bit(i, j % 64))
        values.append(value)
    return F.array(*values)


def near_signatures(left: DataFrame, right: DataFrame, bits: int, max_distance: int) -> DataFrame:
    """Pairs of distinct (aspect, sig) with aspect within one and at most max_distance differing bits.

    Both sides hold each (aspect, sig) once. The join runs on (aspect, piece, value); a pair that
    shares several pieces is kept at its first one only, so nothing is deduplicated afterwards.
    """
    a = left.select(F.col("aspect").alias("a_aspect"), F.col("sig").alias("a_sig"), _segments(F.col("sig"), bits, max_distance).alias("a_parts"))
    a = a.select("*", F.posexplode("a_parts").alias("seg", "val"))
    a = a.withColumn("aspect", F.explode(F.array(*[F.col("a_aspect") + d for d in (-1, 0, 1)])))
    b = right.select("aspect", F.col("sig").alias("b_sig"), _segments(F.col("sig"), bits, max_distance).alias("b_parts"))
    b = b.select("*", F.posexplode("b_parts").alias("seg", "val"))
    first = F.array_position(F.zip_with("a_parts", "b_parts", lambda x, y: x == y), True) - 1
    pairs = a.join(b, ["aspect", "seg", "val"]).withColumn("distance", hamming(F.col("a_sig"), F.col("b_sig")))
    pairs = pairs.where((F.col("distance") <= max_distance) & (first == F.col("seg")))
    return pairs.select("a_aspect", "a_sig", F.col("aspect").alias("b_aspect"), "b_sig", "distance")


def memory_candidates(glyphs: DataFrame, memory: DataFrame, bits: int, max_distance: int) -> DataFrame:
    """Remembered records for each glyph: those with the same fingerprint if any, else the near ones.

    ``glyphs``: glyph_id, project_id, aspect, sig; ``memory``: memory_id, project_id, aspect, sig, char, counts.
    """
    q, m = glyphs.select("aspect", "sig").distinct(), memory.select("aspect", "sig").distinct()
    exact = q.join(m, ["aspect", "sig"], "left_semi")
    exact = exact.select(F.col("aspect").alias("a_aspect"), F.col("sig").alias("a_sig"), F.col("aspect").alias("b_aspect"), F.col("sig").alias("b_sig"), F.lit(0).alias("distance"))
    near = near_signatures(q.join(m, ["aspect", "sig"], "left_anti"), m, bits, max_distance)
    pairs = exact.unionByName(near)
    g = glyphs.select("glyph_id", F.col("project_id").alias("g_project"), F.col("aspect").alias("a_aspect"), F.col("sig").alias("a_sig"))
    r = memory.withColumnsRenamed({"aspect": "b_aspect", "sig": "b_sig"})
    out = g.join(pairs, ["a_aspect", "a_sig"]).join(r, ["b_aspect", "b_sig"])
    return out.withColumn("similarity", 1 - F.col("distance") / float(bits)).drop("a_aspect", "a_sig", "b_aspect", "b_sig")


def visible_memory(glyph_project="g_project", record_project="project_id", manual="manual", similarity="similarity") -> Column:
    """Records of the own project; records without one only inside a project, with two manual confirmations and similarity >= .97."""
    legacy = F.col(glyph_project).isNotNull() & (F.col(manual) >= 2) & (F.col(similarity) >= LEGACY_MIN_SIMILARITY)
    return F.when(F.col(record_project).isNull(), legacy).otherwise(F.col(record_project).eqNullSafe(F.col(glyph_project)))


def recall(candidates: DataFrame, char_class: str = CJK_CLASS) -> DataFrame:
    """The remembered character of each glyph, where the evidence is decisive and trusted."""
    weight = F.col("manual") * 4 + F.col("model") * 2 + F.col("local") * 0.5
    mean = F.col("confidence_sum") / F.greatest(F.lit(1), F.col("total"))
    per_char = candidates.where(visible_memory()).groupBy("glyph_id", "char").agg(
        F.sum(F.pow("similarity", F.lit(4)) * weight * mean).alias("score"),
        F.max("similarity").alias("similarity"),
        F.sum("total").alias("total"),
        F.sum("manual").alias("manual"),
        F.sum("confidence_sum").alias("confidence_sum"),
    )
    w = Window.partitionBy("glyph_id").orderBy(F.desc("score"), "char")
    top2 = per_char.withColumn("__r", F.row_number().over(w)).where("__r <= 2")
    fields = ["char", "score", "similarity", "total", "manual", "confidence_sum"]
    best = top2.groupBy("glyph_id").agg(
        F.max(F.when(F.col("__r") == 1, F.struct(*fields))).alias("b"), F.max(F.when(F.col("__r") == 2, F.col("score"))).alias("second")
    ).select("glyph_id", "b.*", "second")
    avg = F.col("confidence_sum") / F.greatest(F.lit(1), F.col("total"))
    decisive = F.col("second").isNull() | (F.col("score") >= F.col("second") * 1.6)
    conf = (
        F.when((F.col("manual") >= 2) & (F.col("similarity") >= 0.93), 0.97)
        .when((F.col("manual") >= 1) & (F.col("total") >= 3) & (F.col("similarity") >= 0.95) & (avg >= 0.9), 0.94)
        .when((F.col("total") >= 6) & (F.col("similarity") >= 0.97) & (avg >= 0.92), 0.9)
    )
    out = best.withColumn("confidence", conf).where(F.col("confidence").isNotNull() & decisive & is_cjk(F.col("char"), char_class))
    return out.select("glyph_id", "char", "confidence", "similarity", "total", "manual")


MEMORY_KEY = ("project_id", "aspect", "sig", "char")


def learn(memory: DataFrame, evidence: DataFrame, char_class: str = CJK_CLASS, kept: int | None = None) -> DataFrame:
    """Memory after the evidence: counts by source, summed confidence, newest sighting, last evidence keys.

    ``evidence``: MEMORY_KEY, source ('manual'|'model'|'local'), confidence, evidence_key, seen_at.
    Evidence with a key that is already stored counts no more; of a key that comes twice in the batch the
    earliest sighting counts (then source and confidence decide). With
    ``kept`` a record remembers its newest keys only (ranked, cut before the shuffle); older evidence
    would then count again.
    """
    key = list(MEMORY_KEY)
    # of evidence under one key the earliest counts; all its columns decide, so row order never does
    facts = F.struct("seen_at", "source", "confidence")
    e = evidence.where(is_cjk(F.col("char"), char_class)).groupBy(*key, "evidence_key").agg(F.min(facts).alias("__e")).select(*key, "evidence_key", "__e.*")
    known = memory.select(*key, F.explode("evidence_keys").alias("evidence_key"))
    on = [e[k].eqNullSafe(known[k]) for k in key] + [e["evidence_key"] == known["evidence_key"]]
    e = e.join(known, on, "left_anti")
    src = F.col("source")
    fresh = e.groupBy(*key).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(src == "manual").alias("manual"),
        F.count_if(src == "model").alias("model"),
        F.count_if(src == "local").alias("local"),
        F.sum(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("confidence")))).alias("confidence_sum"),
        F.max("seen_at").alias("last_seen"),
    )
    w = Window.partitionBy(*key).orderBy(F.desc("seen_at"), F.desc("evidence_key"))
    newest = e.withColumn("__r", F.row_number().over(w))
    if kept is not None:
        newest = newest.where(F.col("__r") <= kept)
    keys = newest.groupBy(*key).agg(F.reverse(F.transform(F.array_sort(F.collect_list(F.struct("__r", "evidence_key"))), lambda x: x["evidence_key"])).alias("evidence_keys"))
    sums = ["total", "manual", "model", "local", "confidence_sum"]
    add = fresh.withColumnsRenamed({c: f"f_{c}" for c in fresh.columns}).join(
        keys.withColumnsRenamed({c: f"k_{c}" for c in keys.columns}), [F.col(f"f_{k}").eqNullSafe(F.col(f"k_{k}")) for k in key]
    )
    j = memory.join(add, [F.col(k).eqNullSafe(F.col(f"f_{k}")) for k in key], "full_outer")
    empty = F.array().cast("array<string>")
    all_keys = F.concat(F.coalesce("evidence_keys", empty), F.coalesce("k_evidence_keys", empty))
    is_new = F.col("total").isNull()
    return j.select(
        *[F.when(is_new, F.col(f"f_{k}")).otherwise(F.col(k)).alias(k) for k in key],
        *[(F.coalesce(c, F.lit(0)) + F.coalesce(f"f_{c}", F.lit(0))).alias(c) for c in sums],
        F.greatest("last_seen", "f_last_seen").alias("last_seen"),
        (all_keys if kept is None else F.slice(all_keys, F.greatest(F.lit(1), F.size(all_keys) - kept + 1), kept)).alias("evidence_keys"),
    )


def fingerprint(aspect: Column, bits: Column) -> Column:
    """Key of a signature: hash of 'aspect:bits' with bits as a 0/1 string."""
    return fnv1a(F.concat_ws(":", aspect.cast("string"), bits))


def leader_cluster(fps: DataFrame, keys: Sequence[str], order: str, max_distance: int, batch: int = 64) -> DataFrame:
    """Sequential leader clustering per page: each signature joins the first leader within reach, else leads.

    ``fps``: keys, ``order``, sig. Signatures without ink are left out and copies follow their first
    one. Each round takes the first ``batch`` open signatures of a page, finds the leaders among
    them (all earlier ones are settled, so this is exact) and settles every open row by its first
    leader in reach. A page's rows meet at most ``batch`` leaders per round; pairs are never listed.
    """
    keys = list(keys)
    ink = fps.where(F.exists("sig", lambda w: w != 0))
    distinct = ink.groupBy(*keys, "sig").agg(F.min(order).alias("__o"))
    open_ = cut(distinct)
    settled = None
    near = lambda a, b: hamming(a, b) <= max_distance
    while not open_.isEmpty():
        w = Window.partitionBy(*keys).orderBy("__o")
        head = open_.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= batch)
        entry = F.struct(F.col("__o").alias("o"), F.col("sig").alias("s"))
        head = head.groupBy(*keys).agg(F.array_sort(F.collect_list(entry)).alias("h"))
        none = F.expr("filter(h, x -> false)")
        leaders = F.aggregate(
            "h", none, lambda acc, x: F.when(F.exists(acc, lambda l: near(l["s"], x["s"])), acc).otherwise(F.concat(acc, F.array(x)))
        )
        leaders = head.select(*keys, leaders.alias("__leaders"))
        hit = F.get(F.filter("__leaders", lambda l: near(l["s"], F.col("sig")) & (l["o"] <= F.col("__o"))), F.lit(0))
        judged = cut(open_.join(leaders, keys).withColumn("leader", hit["o"]).drop("__leaders"))
        done = judged.where("leader is not null")
        settled = done if settled is None else settled.unionByName(done)
        open_ = judged.where("leader is null").drop("leader")
    if settled is None:
        return ink.select(*keys, order, F.col(order).alias("leader"))
    return ink.join(settled.drop("__o"), [*keys, "sig"]).select(*keys, order, "leader")


def propagate(glyphs: DataFrame, cluster: Sequence[str], char_class: str = CJK_CLASS) -> DataFrame:
    """Spread a cluster's agreed character to its empty and doubtful members.

    ``glyphs``: cluster, glyph_id, text, conf, edited, source, in_dict, is_target. Evidence tiers:
    1 confirmed by a person or confidence >= .85; 2 read twice at >= .5; 3 a dictionary character
    at >= .5. Clusters whose best tier holds two characters, and single members, are left alone.
    A cluster is sorted in one task, with spilling.
    """
    cluster = list(cluster)
    locked = user_locked()
    has = F.coalesce(F.length("text"), F.lit(0)) > 0
    strong = (locked & is_cjk(F.col("text"), char_class)) | (~locked & has & (F.col("conf") >= CONFIDENCE_THRESHOLD))
    mid = ~locked & has & (F.col("conf") >= DICT_LOW_CONF_MAX)
    weak = mid & (F.col("conf") < CONFIDENCE_THRESHOLD) & F.col("in_dict")
    # a cluster moves once; what its texts and all of it show are windows in its partition
    whole, same = Window.partitionBy(*cluster), Window.partitionBy(*cluster, "text")
    g = glyphs.repartition(*cluster).withColumns({f"__n{k}": F.count_if(x).over(same) for k, x in ((1, strong), (2, mid), (3, weak))})
    tier = F.when(F.col("__n1") > 0, 1).when(F.col("__n2") >= 2, 2).when(F.col("__n3") > 0, 3)
    # one glyph speaks for each text
    g = g.withColumns({"__t": tier, "__first": F.row_number().over(same.orderBy("glyph_id")) == 1})
    g = g.withColumns({
        "__members": F.count(F.lit(1)).over(whole), "__tier": F.min("__t").over(whole), "__best": F.min(F.when(F.col("__t").isNotNull(), F.struct("__t", "text"))).over(whole),
        **{f"__c{k}": F.count_if(F.col("__first") & (F.col("__t") == k)).over(whole) for k in (1, 2, 3)},
    })
    rivals = F.element_at(F.array("__c1", "__c2", "__c3"), F.col("__tier"))
    agreed = (F.col("__members") >= 2) & (rivals == 1)
    for k in cluster:
        agreed = agreed & F.col(k).isNotNull()
    j = g.withColumn("__seed", F.when(agreed, F.col("__best.text"))).withColumn("__tier", F.when(agreed, F.col("__tier")))
    seed, t, c = F.col("__seed"), F.col("__tier"), F.col("conf")
    target = seed.isNotNull() & F.col("is_target") & ~locked & (c < CONFIDENCE_THRESHOLD)
    fill = target & F.col("text").isNull()
    same = target & (F.col("text") == seed)
    swap = target & (F.col("text") != seed) & (c < DICT_LOW_CONF_MAX) & (t <= 2) & ~seed.isin(*STRUCTURAL_CHARS)
    fill, same, swap = (F.coalesce(x, F.lit(False)) for x in (fill, same, swap))
    new_conf = (
        F.when(fill, F.when(t == 1, 0.88).when(t == 2, 0.86).otherwise(DICT_CANDIDATE_CONF))
        .when(same, F.least(F.lit(0.95), F.greatest(F.lit(0.88), c + 0.35)))
        .when(swap, 0.85)
        .otherwise(c)
    )
    return j.withColumns({"text": F.when(fill | swap, seed).otherwise(F.col("text")), "conf": new_conf, "improved": fill | same | swap}).select(*glyphs.columns, "improved")
