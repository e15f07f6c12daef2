"""Page status, worklists, progress, audit and listing queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkframe import bindings as B
from inkframe.catalog import query
from inkframe.catalog.sql import with_
from inkframe.operators import pages as P
from inkframe.operators import review as R

KEY = "B:gemini:m1"
_FILL = """SELECT page_id, count(*) AS glyphs, count(*) FILTER (WHERE trim(coalesce(text, '')) = '') AS blank FROM pglyph GROUP BY 1"""
_POOR = "(glyphs >= 6 AND status IN ('recognized','proofread','exported') AND blank / glyphs >= 0.25)"
_SKEY = "CASE WHEN rec_mode IS NOT NULL THEN coalesce(settings_key, CASE WHEN rec_provider = 'local' THEN 'A:local-engine:local-tesseract' ELSE rec_mode || ':' || rec_provider || ':' || rec_model END) END"


def data(t):
    return B.project_pages(t), B.page_glyphs(t)


@query("f3_exportable_pages", with_("page", "SELECT project_id, page_id, idx FROM page WHERE page_id IN (SELECT l_orderkey FROM lineitem)"))
def f3(t):
    p, g = data(t)
    return P.exportable_pages(p, g).select("project_id", "page_id", "idx")


@query("f4_pending_pages", with_("page", "SELECT page_id, status FROM page WHERE status IN ('imported','preprocessed','analyzed')"))
def f4(t):
    return P.pending_pages(B.project_pages(t)).select("page_id", "status")


_POOR8 = _POOR.replace(">= 6", ">= 8")


@query("f5_poor_pages", with_("page glyph", f"SELECT page_id, glyphs, blank FROM st JOIN f USING (page_id) WHERE {_POOR8}",
       f="SELECT page_id, count(*) AS glyphs, count(*) FILTER (WHERE trim(coalesce(text, '')) = '') AS blank FROM glyph GROUP BY 1",
       st="SELECT doc_id AS page_id, CASE WHEN n_chars % 2 = 0 THEN 'recognized' ELSE 'analyzed' END AS status FROM documents"))
def f5(t):
    st = t.documents.selectExpr("doc_id AS page_id", "CASE WHEN n_chars % 2 = 0 THEN 'recognized' ELSE 'analyzed' END AS status")
    # a third of the sizes leave the text blank: blank share is 1/7 on average, above 1/4 on some pages
    return P.poor_pages(st, B.glyphs(t)).select("page_id", "glyphs", "blank")


@query("f6_stale_pages", with_("page pglyph", f"SELECT page_id, {_SKEY} AS settings FROM page JOIN f USING (page_id) WHERE status IN ('recognized','proofread','exported') AND ({_POOR8} OR coalesce({_SKEY} <> '{KEY}', false))", f=_FILL))
def f6(t):
    p, g = data(t)
    return P.stale_pages(p, g, KEY).select("page_id", P.settings_key().alias("settings"))


@query("u1_worklist", with_("page pglyph", f"SELECT project_id, page_id, idx FROM page LEFT JOIN f USING (page_id) WHERE status IN ('imported','preprocessed','analyzed') OR (glyphs IS NOT NULL AND status IN ('recognized','proofread','exported') AND ({_POOR8} OR coalesce({_SKEY} <> '{KEY}', false)))", f=_FILL))
def u1(t):
    p, g = data(t)
    return P.worklist(p, g, KEY).select("project_id", "page_id", "idx")


@query("a14_project_progress", with_("page", "SELECT project_id, count(*) AS pages, count(*) FILTER (WHERE status IN ('proofread','exported')) AS done, CAST(floor(count(*) FILTER (WHERE status IN ('proofread','exported')) * 100 / count(*) + 0.5) AS BIGINT) AS pct FROM page GROUP BY 1"))
def a14(t):
    return P.project_progress(B.project_pages(t))


@query("a17_id_signature", with_("page", "SELECT project_id, string_agg(id, ',' ORDER BY id) AS signature FROM (SELECT project_id, CAST(page_id AS VARCHAR) AS id FROM page WHERE status IN ('imported','preprocessed','analyzed')) GROUP BY 1"))
def a17(t):
    return P.id_list_signature(P.pending_pages(B.project_pages(t)), ["project_id"], "page_id")


@query("a9_group_counts", with_("glyph", """SELECT page_id, grp, n, row_number() OVER (PARTITION BY page_id ORDER BY n DESC, list_position(['rank','body','title','pageno'], grp)) AS place, pt, page_pt
   FROM (SELECT page_id, grp, count(*) AS n, floor(median(pt) * 10 + 0.5) / 10 AS pt FROM glyph GROUP BY 1, 2) JOIN (SELECT page_id, floor(median(pt) * 10 + 0.5) / 10 AS page_pt FROM glyph GROUP BY 1) USING (page_id)"""))
def a9(t):
    g = B.glyphs(t)
    c = P.group_counts(g, ["page_id"]).join(P.median_pt(g, ["page_id", "grp"]), ["page_id", "grp"])
    return c.join(P.median_pt(g, ["page_id"]).withColumnRenamed("pt", "page_pt"), "page_id")


@query("q17_set_pt", with_("glyph", "SELECT glyph_id, CASE WHEN grp = 'rank' THEN CAST(11.5 AS DOUBLE) ELSE pt END AS pt, edited OR grp = 'rank' AS edited FROM glyph"))
def q17(t):
    return P.set_pt(B.glyphs(t), 11.5, "rank").select("glyph_id", "pt", "edited")


@query("s7_emitted_counts", with_("glyph rect line node", """SELECT page_id, section, count(*) AS n FROM (SELECT page_id, CASE WHEN kind = 'side' THEN 'side_chars' ELSE 'text_chars' END AS section FROM glyph
   UNION ALL SELECT page_id, CASE WHEN kind = 'border' THEN 'border_rects' ELSE 'tag_rects' END FROM rect UNION ALL SELECT page_id, 'lines' FROM line UNION ALL SELECT page_id, 'nodes' FROM node) GROUP BY 1, 2"""))
def s7(t):
    r = B.rects(t)
    return P.emitted_counts({"glyphs": B.glyphs(t), "border_rects": r.where("kind = 'border'"), "tag_rects": r.where("kind = 'tag'"), "lines": B.lines(t), "nodes": B.nodes(t)})


@query("s9_list_projects", "SELECT c_custkey AS project_id, c_name AS name, (SELECT count(*) FROM orders o WHERE o.o_custkey = c_custkey) AS pages FROM customer WHERE contains(lower(c_name), '#00000001') OR true")
def s9(t):
    """Customers as projects with their pages in order; the search term matches all names here."""
    prj = t.customer.select(F.col("c_custkey").alias("project_id"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("updated_at"))
    pages = B.project_pages(t).groupBy("project_id").agg(F.count(F.lit(1)).alias("pages"))
    return P.list_projects(prj, "CUSTOMER").join(pages, "project_id", "left").select("project_id", "name", F.coalesce("pages", F.lit(0)).alias("pages"))


@query("s10_delete_projects", with_("page", """SELECT 'project' AS tbl, count(*) AS n FROM customer WHERE c_nationkey <> 7 UNION ALL
   SELECT 'page', count(*) FROM page WHERE project_id NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey = 7) UNION ALL
   SELECT 'undo', count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT page_id FROM page WHERE project_id IN (SELECT c_custkey FROM customer WHERE c_nationkey = 7))"""))
def s10(t):
    prj = t.customer.select(F.col("c_custkey").alias("project_id"), "c_nationkey")
    left = P.delete_projects(
        {"project": prj, "page": B.project_pages(t), "undo": t.lineitem.select(F.col("l_orderkey").alias("page_id"))},
        prj.where("c_nationkey = 7"),
    )
    out = None
    for name, df in left.items():
        part = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("tbl"), "n")
        out = part if out is None else out.unionByName(part)
    return out


@query("s11_audit_lines", with_("audit", "SELECT id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%g') || 'Z' || chr(9) || '模式' || mode || chr(9) || provider || chr(9) || domain || chr(9) || '字符数=' || char_count || chr(9) || '批次=' || batches AS line FROM audit"))
def s11(t):
    return P.audit_lines(B.audit(t))


@query("s12_select_pages", with_("page", """SELECT p.project_id, p.page_id FROM page p JOIN (SELECT project_id, max(idx) + 1 AS total FROM page GROUP BY 1) USING (project_id) WHERE
   CASE project_id % 3 WHEN 0 THEN idx + 1 BETWEEN 2 AND 4 OR idx + 1 = 7 OR total < 2 WHEN 1 THEN idx + 1 = 5 OR total < 5 ELSE true END"""))
def s12(t):
    p = B.project_pages(t).withColumn("page_no", F.col("idx") + 1)
    r = p.select("project_id").distinct().withColumn("ranges", F.expr("CASE project_id % 3 WHEN 0 THEN '2-4, 7,x' WHEN 1 THEN '5' ELSE 'all' END"))
    return P.select_pages(p, r, ["project_id"]).select("project_id", "page_id")


@query("k2_recent_audit", with_("audit", "SELECT id, mode, char_count FROM audit ORDER BY ts DESC, id DESC LIMIT 500"))
def k2(t):
    """The newest 500 entries: the report's own limit."""
    return P.recent(B.audit(t)).select("id", "mode", "char_count")


@query("k5_cap_per_key", with_("page", "SELECT project_id, page_id FROM (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY idx) AS k FROM page) WHERE k <= 60"))
def k5(t):
    """First sixty pages of a project, as the title scan takes them."""
    return R.cap_per_key(B.project_pages(t), ["project_id"], [F.col("idx")], 60).select("project_id", "page_id")


@query("m1_audit_retention", with_("audit", "SELECT id FROM audit WHERE ts > (SELECT max(ts) FROM audit) - INTERVAL 20 DAY"))
def m1(t):
    """Twenty days here, since the events span one month."""
    return P.retain(B.audit(t), 20).select("id")


@query("m6_page_status", with_("", "SELECT user_id AS page_id, CAST(max(list_position(['signup','view','click','purchase','error'], event_type)) AS BIGINT) AS status_rank, count(*) AS updates FROM events GROUP BY 1"))
def m6(t):
    from inkframe.streaming.logs import page_progress

    e = t.events.selectExpr("user_id AS page_id", "CAST(array_position(array('signup','view','click','purchase','error'), event_type) AS BIGINT) AS status_rank", "ts")
    return page_progress(e)


@query("m7_new_work", with_("page", "SELECT project_id, count(*) AS n FROM page WHERE status IN ('imported','preprocessed','analyzed') AND project_id IN (SELECT o_custkey FROM orders WHERE o_orderkey % 10 = 0 AND substring(o_orderpriority, 1, 1) IN ('1', '2', '3') AND NOT (o_orderstatus = 'P' AND substring(o_orderpriority, 1, 1) = '3')) GROUP BY 1"))
def m7(t):
    """Projects whose pending set differs from the one stored before every tenth page arrived."""
    from inkframe.streaming.logs import new_work

    pending = P.pending_pages(B.project_pages(t)).select("project_id", "page_id")
    stored = P.id_signature(pending.where("page_id % 10 <> 0"), ["project_id"], "page_id").select("project_id", "signature")
    return new_work(pending, stored, ["project_id"], "page_id").select("project_id", "n")
