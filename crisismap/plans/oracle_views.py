"""DuckDB twins of ``crisismap.plans.fixtures`` as CTEs for the oracle SQL.

``with_views(body, 'posts', ...)`` prefixes ``body`` with the CTEs it needs
(dependencies first). The driver pre-registers the raw tables as views.
"""

from __future__ import annotations

import re

from crisismap.plans.fixtures import EMOTION_FACTORS, HOT_SPOT, KEYWORDS, N_TOPICS, STOPWORDS

_ARROW = re.compile(r"\b([A-Za-z_]\w*)\s*->\s*")


def duck_lambdas(sql: str) -> str:
    """DuckDB 2 spells lambdas ``lambda x: ...``; the views are written with arrows."""
    return _ARROW.sub(lambda m: f"lambda {m.group(1)}: ", sql)


def _p(a: int, b: int) -> str:
    return f"((doc_id * {a}) % 100) / 200 + ((doc_id * {b}) % 100) / 400"


_M = "((doc_id * 37) % 76320)"

_TOPONYMS = f"""
CASE WHEN doc_id % 4 = 0 THEN [] ELSE list_transform(range(1, doc_id % 4 + 1), k -> struct_pack(
  text := 'place' || k,
  start_char := CAST(k * 10 AS INTEGER),
  end_char := CAST(k * 10 + 6 AS INTEGER),
  loc_name := 'Place ' || k,
  country_name := 'Country',
  latitude := CASE WHEN (doc_id + k) % 23 = 0 THEN CAST(NULL AS DOUBLE)
                   WHEN doc_id % 5 = 0 AND k = 1 THEN CAST({HOT_SPOT[1]} AS DOUBLE)
                   ELSE 36 + ((doc_id * 7 + k * 11) % 176) / 8 END,
  longitude := CASE WHEN doc_id % 5 = 0 AND k = 1 THEN CAST({HOT_SPOT[0]} AS DOUBLE)
                    ELSE 2 + ((doc_id * 13 + k * 29) % 248) / 8 END,
  score := CAST(k AS DOUBLE) / 4)) END
"""


def _box(cx: str, cy: str, h: str) -> str:
    c = "struct_pack(lon := {x}, lat := {y})"
    a = c.format(x=f"{cx} - {h}", y=f"{cy} - {h}")
    b = c.format(x=f"{cx} + {h}", y=f"{cy} - {h}")
    d = c.format(x=f"{cx} + {h}", y=f"{cy} + {h}")
    e = c.format(x=f"{cx} - {h}", y=f"{cy} + {h}")
    return f"[{a}, {b}, {d}, {e}, {a}]"


_emotions = ",\n    ".join(f"{_p(a, b)} AS p_{n}" for n, (a, b) in EMOTION_FACTORS.items())

VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "posts": ((), f"""
  SELECT 'c' || doc_id AS cid, 'at://post/' || doc_id AS uri, doc_id, crawl_seq,
    CASE WHEN doc_id % 97 = 0 THEN '' WHEN doc_id % 89 = 0 THEN CAST(NULL AS VARCHAR) ELSE text END AS text,
    ts, lang,
    CASE WHEN doc_id % 10 = 0 THEN CAST([] AS VARCHAR[]) WHEN doc_id % 10 = 1 THEN [lang || '-XX', 'en']
         ELSE [lang] END AS langs,
    CASE WHEN doc_id % 3 = 0 THEN [url] WHEN doc_id % 3 = 1 THEN ['at://x'] ELSE CAST([] AS VARCHAR[]) END AS urls,
    CASE WHEN doc_id % 4 = 0 THEN ['t'] ELSE CAST([] AS VARCHAR[]) END AS image_thumbnails,
    CAST(crawl_seq % 47 AS BIGINT) AS likeCount,
    disaster_related,
    {_emotions},
    {_TOPONYMS} AS toponyms,
    CASE WHEN doc_id % 10 = 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%SZ')
         WHEN doc_id % 10 = 1 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S+00:00')
         ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S') || '.000Z' END AS createdAt
  FROM (
    SELECT r.*, p.url,
      TIMESTAMP '2024-12-24 00:00:00' + to_minutes(CAST({_M} + CASE WHEN ({_M} // 1440) % 9 = 4 THEN 1440 ELSE 0 END
                                                        AS INTEGER)) AS ts
    FROM (
      SELECT d.doc_id, d.text, d.lang, CAST(l.quality AS INTEGER) AS disaster_related, d.doc_id AS crawl_seq
      FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
      UNION ALL
      SELECT d.doc_id, d.text, d.lang, CAST(l.quality AS INTEGER), d.doc_id + 1000000
      FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE d.doc_id % 7 = 0
    ) r
    CROSS JOIN (SELECT count(*) AS n_pages FROM pages) np
    LEFT JOIN pages p ON p.page_id = CASE WHEN r.doc_id % 3 = 0 THEN r.doc_id % np.n_pages END
  ) q"""),
    "grid": ((), """
  SELECT cell_id, level, x0, y0, shape,
    CASE shape WHEN 'sq' THEN [p00, p10, p11, p01, p00] WHEN 'a' THEN [p00, p10, p11, p00]
               ELSE [p00, p11, p01, p00] END AS ring
  FROM (
    SELECT *, struct_pack(lon := x0, lat := y0) AS p00, struct_pack(lon := x0 + 2.0, lat := y0) AS p10,
      struct_pack(lon := x0 + 2.0, lat := y0 + 2.0) AS p11, struct_pack(lon := x0, lat := y0 + 2.0) AS p01
    FROM (
      SELECT '4-' || i || '-' || j AS cell_id, 4 AS level, x0, y0, 'sq' AS shape FROM (
        SELECT id // 14 AS i, id % 14 AS j, 2.0::DOUBLE + 2.0 * (id // 14) AS x0, 36.0::DOUBLE + 2.0 * (id % 14) AS y0
        FROM range(280) t(id))
      UNION ALL
      SELECT '5-' || i || '-' || j || '-' || h AS cell_id, 5 AS level, x0, y0, h AS shape FROM (
        SELECT id // 14 AS i, id % 14 AS j, 2.0::DOUBLE + 2.0 * (id // 14) AS x0, 36.0::DOUBLE + 2.0 * (id % 14) AS y0
        FROM range(280) t(id)) CROSS JOIN (VALUES ('a'), ('b')) v(h)))"""),
    "floods": ((), f"""
  SELECT s_suppkey AS flood_id,
    2 + ((s_suppkey * 37) % 248) / 8 AS cx, 36 + ((s_suppkey * 19) % 176) / 8 AS cy, 0.25::DOUBLE AS half,
    {_box("(2 + ((s_suppkey * 37) % 248) / 8)", "(36 + ((s_suppkey * 19) % 176) / 8)", "0.25")} AS ring,
    'EU' AS equi7grid_cont, 'E' || (s_suppkey % 6) AS equi7grid_tile_id,
    CAST(DATE '2024-09-12' + CAST(s_suppkey % 3 AS INTEGER) AS DATE) AS file_date
  FROM supplier"""),
    "footprints": ((), f"""
  SELECT 2 + ((n_nationkey * 37) % 248) / 8 AS fcx, 36 + ((n_nationkey * 19) % 176) / 8 AS fcy, 3.0::DOUBLE AS fhalf,
    {_box("(2 + ((n_nationkey * 37) % 248) / 8)", "(36 + ((n_nationkey * 19) % 176) / 8)", "3.0")} AS footprint_ring,
    'EU' AS equi7grid_cont, 'E' || (n_nationkey % 6) AS equi7grid_tile_id,
    CAST(DATE '2024-09-12' + CAST(n_nationkey % 3 AS INTEGER) AS DATE) AS file_date,
    'fp' || n_nationkey AS unique_id
  FROM nation"""),
    "fires": ((), """
  SELECT event_id AS fire_id, 2 + ((user_id * 37) % 248) / 8 AS lon, 36 + ((user_id * 19) % 176) / 8 AS lat,
    CAST(ts AS DATE) AS ACQ_DATE, CAST(hour(ts) * 100 + minute(ts) AS INTEGER) AS ACQ_TIME
  FROM events WHERE event_type = 'error'"""),
    "corpus": ((), f"SELECT doc_id, text, CAST(doc_id % {N_TOPICS} AS INTEGER) AS topic_id FROM documents"),
    "stopwords": ((), "SELECT * FROM (VALUES " + ", ".join(f"('{w}')" for w in STOPWORDS) + ") t(word)"),
    "keywords": ((), "SELECT * FROM (VALUES " + ", ".join(f"('{w}')" for w in KEYWORDS) + ") t(keyword)"),
    "ctfidf": (("corpus", "stopwords"), r"""
  SELECT topic_id, word, rank, score FROM (
    SELECT *, CAST(row_number() OVER (PARTITION BY topic_id ORDER BY score DESC, word) AS INTEGER) AS rank FROM (
      SELECT tc.topic_id, tc.word, tc.tf, (tc.tf / sz.class_total) * ln(a.A / f.f + 1) AS score
      FROM (SELECT topic_id, word, count(*) AS tf FROM (
              SELECT topic_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}')) AS word
              FROM corpus WHERE text IS NOT NULL) WHERE word NOT IN (SELECT word FROM stopwords) GROUP BY ALL) tc
      JOIN (SELECT word, sum(tf) AS f FROM (SELECT topic_id, word, count(*) AS tf FROM (
              SELECT topic_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}')) AS word
              FROM corpus WHERE text IS NOT NULL) WHERE word NOT IN (SELECT word FROM stopwords) GROUP BY ALL)
            GROUP BY word) f USING (word)
      JOIN (SELECT topic_id, sum(tf) AS class_total FROM (SELECT topic_id, word, count(*) AS tf FROM (
              SELECT topic_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}')) AS word
              FROM corpus WHERE text IS NOT NULL) WHERE word NOT IN (SELECT word FROM stopwords) GROUP BY ALL)
            GROUP BY topic_id) sz USING (topic_id)
      CROSS JOIN (SELECT floor(avg(class_total)) AS A FROM (SELECT topic_id, count(*) AS class_total FROM (
              SELECT topic_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}')) AS word
              FROM corpus WHERE text IS NOT NULL) WHERE word NOT IN (SELECT word FROM stopwords) GROUP BY topic_id)) a))
  WHERE rank <= 10"""),
    "topics": (("ctfidf",), """
  SELECT topic_id, list(word ORDER BY rank) AS words FROM ctfidf GROUP BY topic_id
  UNION ALL SELECT 100, list(word ORDER BY rank) || ['zzzunknownzzz'] FROM ctfidf WHERE topic_id = 0
  UNION ALL SELECT 101, [w[1], w[1], w[2]] FROM (SELECT list(word ORDER BY rank) AS w FROM ctfidf WHERE topic_id = 1)
  UNION ALL SELECT 102, [w[1]] FROM (SELECT list(word ORDER BY rank) AS w FROM ctfidf WHERE topic_id = 2)"""),
    "runs": ((), r"""
  SELECT doc_id, pos, run,
    coalesce(sum(length(run)) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
      AS start,
    lead(run, 1) OVER w AS r1, lead(run, 2) OVER w AS r2, lead(run, 3) OVER w AS r3, lead(run, 4) OVER w AS r4
  FROM (SELECT doc_id, unnest(range(len(rs))) AS pos, unnest(rs) AS run FROM (
          SELECT doc_id, regexp_extract_all(text, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_]+') AS rs FROM documents
          WHERE text IS NOT NULL))
  WINDOW w AS (PARTITION BY doc_id ORDER BY pos)"""),
    "names": (("runs",), r"""
  SELECT name, count(*) AS n FROM (
    SELECT unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]{9,}')) AS name FROM documents WHERE text IS NOT NULL
    UNION ALL
    SELECT lower(run || ' ' || r2) FROM runs
    WHERE regexp_matches(run, '^[\p{L}\p{N}_]') AND r1 = ' ' AND length(run) >= 6 AND length(r2) >= 6)
  GROUP BY name"""),
    "gazetteer": (("names",), """
  SELECT name, 'C' || (length(name) % 5) AS country_name, 36 + ((length(name) * 7) % 176) / 8 AS latitude,
    2 + ((length(name) * 13) % 248) / 8 AS longitude, CAST(n * 1000 AS BIGINT) AS population FROM names
  UNION ALL
  SELECT name, 'CX', 37.5, 3.5, CAST(1 AS BIGINT) FROM names WHERE length(name) % 4 = 0"""),
    "prototypes": ((), """
  SELECT label AS query_id, label, list(x ORDER BY d) AS embedding FROM (
    SELECT label, d, avg(CAST(embedding[d] AS DOUBLE)) AS x
    FROM (SELECT label, embedding, unnest(range(1, len(embedding) + 1)) AS d FROM embeddings)
    GROUP BY label, d) GROUP BY label"""),
}


def with_views(body: str, *names: str) -> str:
    """Prefix ``body`` with the CTEs for ``names`` and their dependencies."""
    order: list[str] = []

    def visit(n: str) -> None:
        if n in order:
            return
        for dep in VIEWS[n][0]:
            visit(dep)
        order.append(n)

    for n in names:
        visit(n)
    if not order:
        return duck_lambdas(body)
    ctes = ",\n".join(f"{n} AS ({VIEWS[n][1]}\n)" for n in order)
    body = body.strip()
    if body.upper().startswith("WITH "):
        return duck_lambdas(f"WITH {ctes},\n{body[5:]}")
    return duck_lambdas(f"WITH {ctes}\n{body}")
