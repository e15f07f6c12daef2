"""The derivations of bindings.py as SQL, for the DuckDB side of the comparison."""

from __future__ import annotations

from inkframe.bindings import ALPHABET, INK_LEVEL

_PLACE = "((p - vec_id * 5 % 64 + 64) * 57 % 64)"


def _bits(flips: str) -> str:
    # bit 63 is the sign: build the value from two halves to stay in range
    bit = f"CAST((embedding[p + 1] > 0) <> ({_PLACE} < {flips}) AS BIGINT)"
    low = f"list_sum([({bit}) << p for p in range(0, 63)])"
    sign = bit.replace(" p ", " 63 ").replace("(p ", "(63 ").replace("[p + 1]", "[64]")
    return f"(CAST({low} AS BIGINT) - ({sign}) * 4611686018427387904 - ({sign}) * 4611686018427387904)"


CTES: dict[str, tuple[tuple[str, ...], str]] = {
    "vote": ((), """
SELECT user_id, day, (rn - 1) // 3 AS item, (rn - 1) % 3 + 1 AS round,
       CASE WHEN event_type <> 'error' THEN event_type END AS char, value / 500 AS confidence
FROM (SELECT *, strftime(ts, '%Y-%m-%d') AS day,
             row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id) AS rn FROM events)"""),
    "pass": ((), """
SELECT user_id, week, pass, CASE WHEN event_id % 2 = 0 THEN 'normal' ELSE 'vertical' END AS engine,
       CASE WHEN user_id % 2 = 0 THEN 'horizontal' ELSE 'vertical' END AS orientation,
       CASE WHEN event_type <> 'error' THEN event_type END AS char, value / 500 AS confidence
FROM (SELECT *, row_number() OVER (PARTITION BY user_id, week ORDER BY ts, event_id) AS pass
      FROM (SELECT *, (day(ts) - 1) // 7 AS week FROM events))"""),
    "word": ((), """
SELECT doc_id, l, w - 1 AS w, word, length(word) AS n FROM (
  SELECT doc_id, l, unnest(string_split(line, ' ')) AS word, generate_subscripts(string_split(line, ' '), 1) AS w
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
               generate_subscripts(string_split(text, chr(10)), 1) - 1 AS l FROM documents))"""),
    "glyph": (("word",), f"""
SELECT page_id, glyph_id, l, w, n, text, x0 + bw / 2 AS cx, y0 + bh / 2 AS cy, x0, y0, x0 + bw AS x1, y0 + bh AS y1,
       pt, conf, note, source, edited, grp, kind
FROM (SELECT doc_id AS page_id, doc_id * 1000000000 + l * 100000 + w AS glyph_id, l, w, n,
       CAST(w * 24 + (doc_id * 7 + l * 3 + w * 5) % 9 AS DOUBLE) AS x0,
       CAST(l * 26 + (doc_id * 5 + l * 11 + w * 7) % 11 AS DOUBLE) AS y0,
       CAST(14 + n % 9 AS DOUBLE) AS bw, CAST(14 + (n * 3) % 11 AS DOUBLE) AS bh,
       CASE WHEN n % 7 = 0 THEN NULL ELSE substring('{ALPHABET}', 1 + (n * 17 + l * 5 + w * 3) % {len(ALPHABET)}, 1) END AS text,
       ((doc_id * 31 + l * 7 + w * 13) % 100) / CAST(100 AS DOUBLE) AS conf,
       8 + (n % 7) * CAST(0.5 AS DOUBLE) AS pt,
       CASE (doc_id * 3 + l + w) % 29 WHEN 0 THEN 'split' WHEN 1 THEN 'merge' WHEN 2 THEN 'spacing'
            WHEN 3 THEN 'blurry' WHEN 4 THEN 'empty' ELSE 'ok' END AS note,
       CASE (l + w) % 3 WHEN 0 THEN 'manual' WHEN 1 THEN 'llm' ELSE 'local' END AS source,
       (doc_id + l + w) % 17 = 0 AS edited,
       CASE WHEN l = 0 THEN 'title' WHEN l % 13 = 12 THEN 'pageno' WHEN w % 5 >= 3 THEN 'rank' ELSE 'body' END AS grp,
       CASE WHEN w = 0 THEN 'side' ELSE 'text' END AS kind
      FROM word)"""),
    "pixel": ((), """
SELECT page_id, y, x - 1 AS x, CAST(least(255, greatest(0, floor((v + 1) * 128))) AS BIGINT) AS gray
FROM (SELECT page_id, y, unnest(embedding::DOUBLE[]) AS v, generate_subscripts(embedding, 1) AS x
      FROM (SELECT CAST(label AS BIGINT) AS page_id, embedding,
                   row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS y FROM embeddings))"""),
    "page_size": ((), """
SELECT CAST(label AS BIGINT) AS page_id, CAST(max(len(embedding)) AS BIGINT) AS width, count(*) AS height
FROM embeddings GROUP BY 1"""),
    "ink": (("pixel",), f"SELECT page_id, y, x FROM pixel WHERE gray < {INK_LEVEL}"),
    "run": (("ink",), """
SELECT page_id, y, min(x) AS x0, max(x) + 1 AS x1
FROM (SELECT *, x - row_number() OVER (PARTITION BY page_id, y ORDER BY x) AS g FROM ink) GROUP BY page_id, y, g"""),
    "rect": ((), """
SELECT p_partkey // 40 AS page_id, p_partkey AS rect_id, CAST(p_partkey * 37 % 150 AS DOUBLE) AS x,
       CAST(p_partkey * 91 % 150 AS DOUBLE) AS y, CAST(20 + p_partkey % 30 AS DOUBLE) AS w,
       CAST(20 + p_partkey % 17 AS DOUBLE) AS h, CASE WHEN p_partkey % 2 = 0 THEN 'border' ELSE 'tag' END AS kind FROM part"""),
    "line": ((), """
SELECT page_id, line_id, x1, y1, CASE WHEN orientation = 'h' THEN x1 + len ELSE x1 END AS x2,
       CASE WHEN orientation = 'v' THEN y1 + len ELSE y1 END AS y2, width_px, orientation
FROM (SELECT c_custkey // 60 AS page_id, c_custkey AS line_id, CAST(c_custkey * 53 % 300 AS DOUBLE) AS x1,
             CAST(c_custkey * 29 % 300 AS DOUBLE) AS y1, CAST(40 + c_custkey % 100 AS DOUBLE) AS len,
             CAST(1 + c_custkey % 4 AS DOUBLE) AS width_px,
             CASE WHEN c_custkey % 2 = 0 THEN 'h' ELSE 'v' END AS orientation FROM customer)"""),
    "node": ((), """
SELECT s_suppkey % 25 AS page_id, s_suppkey AS node_id, CAST(s_suppkey * 53 % 300 AS DOUBLE) AS cx,
       CAST(s_suppkey * 29 % 300 AS DOUBLE) AS cy, CAST(6 + s_suppkey % 8 AS DOUBLE) AS r FROM supplier"""),
    "memory": ((), f"""
SELECT vec_id AS memory_id, CASE WHEN vec_id % 4 = 0 THEN NULL ELSE vec_id % 3 END AS project_id, {_bits('0')} AS sig,
       CAST(label AS BIGINT) AS aspect, substring('{ALPHABET}', 1 + label, 1) AS char, vec_id % 5 AS manual, vec_id % 3 AS model,
       CAST(1 AS BIGINT) AS local, vec_id % 5 + vec_id % 3 + 1 AS total,
       (vec_id % 5 + vec_id % 3 + 1) * CAST(0.95 AS DOUBLE) AS confidence_sum FROM embeddings"""),
    "fp": ((), f"""
SELECT vec_id AS glyph_id, vec_id % 3 AS project_id, {_bits('(vec_id % 8)')} AS sig, CAST(label AS BIGINT) AS aspect FROM embeddings"""),
    "page": ((), """
SELECT o_custkey AS project_id, o_orderkey AS page_id,
       row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS idx,
       (['imported','preprocessed','analyzed','recognized','proofread','exported'])[CAST(substring(o_orderpriority, 1, 1) AS INTEGER)
         + CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END] AS status,
       CASE o_orderstatus WHEN 'F' THEN NULL WHEN 'O' THEN 'B' ELSE 'A' END AS rec_mode,
       CASE o_orderstatus WHEN 'F' THEN NULL WHEN 'O' THEN 'gemini' ELSE 'local' END AS rec_provider,
       CASE o_orderstatus WHEN 'F' THEN NULL ELSE 'm' || (o_orderkey % 3) END AS rec_model,
       CASE WHEN o_orderstatus = 'O' AND o_orderkey % 4 = 0 THEN 'B:gemini:m1' END AS settings_key,
       o_totalprice, o_orderdate FROM orders"""),
    "pglyph": ((), """
SELECT l_orderkey AS page_id, l_orderkey * 10 + l_linenumber AS glyph_id,
       CASE WHEN l_returnflag = 'N' THEN '' WHEN l_linestatus = 'F' THEN l_returnflag END AS text,
       l_quantity AS pt, 1 - l_discount * 5 AS conf,
       CASE l_returnflag WHEN 'A' THEN 'rank' WHEN 'N' THEN 'body' ELSE 'title' END AS grp, l_linenumber = 7 AS edited,
       CASE l_linenumber % 3 WHEN 0 THEN 'manual' WHEN 1 THEN 'llm' ELSE 'local' END AS source FROM lineitem"""),
    "audit": ((), """
SELECT event_id AS id, ts, event_type AS mode, 'provider' || (user_id % 5) AS provider,
       'host' || user_id || '.example.com' AS domain, CAST(floor(value) AS BIGINT) AS char_count, 1 + event_id % 7 AS batches FROM events"""),
    "edit": ((), """
SELECT user_id AS page_id, event_id AS seq, ts,
       CASE event_type WHEN 'view' THEN 'move' WHEN 'click' THEN 'update' WHEN 'signup' THEN 'add'
            WHEN 'purchase' THEN 'resize' ELSE 'remove' END AS op, event_id % 20 AS target, CAST(floor(value) AS BIGINT) AS amount FROM events"""),
    "dict": ((), """
SELECT DISTINCT word FROM (SELECT unnest(regexp_split_to_array(lower(text), '[^a-z]+')) AS word FROM benchmark) WHERE length(word) >= 4"""),
}


def with_(names: str, body: str, **extra: str) -> str:
    """Prefix body with the named derivations (and their own); ``extra`` adds query-local ones in order."""
    order: list[str] = []

    def add(name: str) -> None:
        for dep in CTES[name][0]:
            add(dep)
        if name not in order:
            order.append(name)

    for name in names.split():
        add(name)
    parts = [f"{n} AS MATERIALIZED ({CTES[n][1]})" for n in order] + [f"{n} AS ({q})" for n, q in extra.items()]
    return f"WITH {', '.join(parts)} {body}" if parts else body
