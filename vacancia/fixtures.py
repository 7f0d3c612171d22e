"""Fixture views over the given tables. The same text runs in Spark SQL and DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

VIEWS = {
    "postings": """SELECT
  ((l.l_orderkey * 10 + l.l_linenumber) * 100000 + l.l_partkey) * 10000 + l.l_suppkey AS row_id,
  CASE WHEN l.l_partkey % 29 = 0 THEN '' ELSE concat(CASE WHEN l.l_orderkey % 3 = 0 THEN ' ' ELSE '' END, CASE WHEN l.l_orderkey % 2 = 0 THEN upper(p.p_name) ELSE p.p_name END) END AS title,
  CASE WHEN l.l_suppkey % 31 = 0 THEN NULL ELSE s.s_name END AS company,
  concat('https://', CASE l.l_linenumber % 4 WHEN 0 THEN 'boards.greenhouse.io' WHEN 1 THEN 'jobs.lever.co' WHEN 2 THEN 'jobs.ashbyhq.com' ELSE 'www.example.com' END,
         '/co-', CAST(l.l_suppkey AS VARCHAR(20)), '/jobs/', CAST(l.l_partkey % 40 AS VARCHAR(20))) AS url,
  CASE l.l_linenumber % 6 WHEN 0 THEN 'linkedin' WHEN 1 THEN 'indeed' WHEN 2 THEN 'ats' WHEN 3 THEN 'jobright' WHEN 4 THEN 'yc' ELSE 'career_page' END AS source,
  CASE WHEN l.l_returnflag = 'R' THEN 'easy_apply' WHEN l.l_returnflag = 'A' THEN 'external' ELSE 'unknown' END AS apply_type,
  l.l_shipdate AS found_at,
  CASE WHEN o.o_orderpriority LIKE '1%' THEN NULL ELSE o.o_orderpriority END AS search_role,
  CASE WHEN l.l_orderkey % 2 = 0 THEN lower(n.n_name) ELSE n.n_name END AS location,
  CASE WHEN l.l_orderkey % 4 = 0 THEN '' ELSE CAST(CAST(o.o_orderdate AS DATE) AS VARCHAR(20)) END AS posted_time,
  CASE WHEN l.l_partkey % 3 = 0 THEN p.p_type ELSE '' END AS job_description,
  CASE WHEN l.l_linenumber = 1 THEN 'Fresh' ELSE '' END AS freshness,
  CASE WHEN l.l_quantity > 40 THEN CAST(CAST(l.l_quantity AS INT) AS VARCHAR(20)) ELSE NULL END AS salary,
  CASE WHEN l.l_tax > 0.05 THEN 'Full-time' ELSE NULL END AS employment_type
FROM lineitem l
JOIN orders o ON o.o_orderkey = l.l_orderkey
JOIN part p ON p.p_partkey = l.l_partkey
JOIN supplier s ON s.s_suppkey = l.l_suppkey
JOIN customer c ON c.c_custkey = o.o_custkey
JOIN nation n ON n.n_nationkey = c.c_nationkey""",
    "runs": """SELECT event_id AS id, ts AS started_at,
  CASE WHEN event_id % 10 = 0 THEN NULL ELSE ts + CAST(floor(value * 10) AS INT) * INTERVAL '1' SECOND END AS finished_at,
  CASE event_type WHEN 'error' THEN 'failed' WHEN 'signup' THEN 'cancelled' WHEN 'view' THEN 'running' ELSE 'completed' END AS status,
  CAST(user_id % 50 AS INT) AS jobs_found,
  CASE WHEN event_id % 4 = 0 THEN NULL ELSE value END AS duration_sec
FROM events""",
    "run_events": """SELECT user_id AS run_id, event_id AS ord, ts,
  CASE event_type WHEN 'error' THEN 'failed' WHEN 'purchase' THEN 'completed' ELSE NULL END AS status,
  CASE WHEN event_id % 3 = 0 THEN CAST(user_id % 50 AS INT) ELSE NULL END AS jobs_found,
  CASE WHEN event_id % 4 = 0 THEN value ELSE NULL END AS duration_sec
FROM events""",
    "crawl_hits": """SELECT CAST(l_suppkey % 20 AS INT) AS search_id, CAST(floor(l_orderkey / 50) AS INT) % 30 AS page_no, l_linenumber AS rank,
  concat('https://jobs.lever.co/co-', CAST(l_suppkey AS VARCHAR(20)), '/p-', CAST(l_partkey % 60 AS VARCHAR(20))) AS url,
  l_extendedprice > 20000 AS title_ok
FROM lineitem""",
    "board_payloads": """SELECT lower(replace(p_brand, '#', '-')) AS token, p_partkey AS payload_id,
  concat('{"jobs":[{"id":', CAST(p_partkey AS VARCHAR(20)), ',"title":"', p_name, '","location":{"name":"', p_type, '"},"isListed":', CASE WHEN p_size % 5 = 0 THEN 'false' ELSE 'true' END,
   ',"updated_at":"', CASE WHEN p_size % 7 = 0 THEN 'soon' ELSE concat('2024-01-', lpad(CAST(1 + p_size % 28 AS VARCHAR(20)), 2, '0'), 'T08:30:00Z') END,
   '"},{"id":', CAST(p_partkey + 1000000 AS VARCHAR(20)), ',"title":"senior ', p_name, '","location":{"name":""},"updated_at":null}]}') AS payload
FROM part""",
    "job_pages": """SELECT o_orderkey AS page_id,
  concat('https://', CASE o_orderkey % 4 WHEN 0 THEN 'boards.greenhouse.io' WHEN 1 THEN 'jobs.lever.co' WHEN 2 THEN 'jobs.ashbyhq.com' ELSE 'careers.example.com' END, '/co-', CAST(o_custkey % 100 AS VARCHAR(20)), '/jobs/', CAST(o_orderkey AS VARCHAR(20))) AS url,
  concat('<html><head><title>T</title>',
   CASE o_orderkey % 7
    WHEN 0 THEN concat('<script type="application/ld+json">{"@type":"JobPosting","title":"', o_orderpriority, '","datePosted":"', CAST(CAST(o_orderdate AS DATE) AS VARCHAR(20)), '","hiringOrganization":{"name":"C', CAST(o_custkey AS VARCHAR(20)), '"}}</script>')
    WHEN 1 THEN concat('<script>window.__remixContext = {"state":{"loaderData":{"jobs_x":{"jobPost":{"published_at":"', CAST(CAST(o_orderdate AS DATE) AS VARCHAR(20)), 'T09:00:00-04:00","title":"X"}}}}};</script>')
    WHEN 2 THEN concat('<script>window.__appData = {"posting":{"title":"X","publishedDate":"', CAST(CAST(o_orderdate AS DATE) AS VARCHAR(20)), '"}};</script>')
    WHEN 3 THEN concat('<script>{"createdAt":"', CAST(CAST(o_orderdate AS DATE) AS VARCHAR(20)), 'T00:00:00Z"}</script>')
    WHEN 4 THEN concat('<meta property="article:published_time" content="', CAST(CAST(o_orderdate AS DATE) AS VARCHAR(20)), '">')
    WHEN 5 THEN '' ELSE '<meta name="description" content="A job page without any date, long enough to be kept as the description text.">' END,
   '</head><body><main><h1>Role</h1><p>', CASE WHEN o_orderkey % 7 = 5 THEN concat('Posted ', CAST(1 + o_custkey % 20 AS VARCHAR(20)), ' days ago') ELSE 'Apply &amp; join' END, '</p></main></body></html>') AS html
FROM orders""",
    "model_replies": """SELECT conv_id AS batch_id, turn AS reply_no,
  concat('1 YES', chr(10), '2: no', chr(10), '3) Yes please', chr(10), '# note', chr(10), CAST(4 + conv_id % 5 AS VARCHAR(20)), '. NO', chr(10), 'x') AS reply
FROM conversations WHERE role = 'assistant'""",
}

TABLES = {
    "postings": ("lineitem", "orders", "part", "supplier", "customer", "nation"), "runs": ("events",), "run_events": ("events",), "crawl_hits": ("lineitem",), "board_payloads": ("part",), "job_pages": ("orders",), "model_replies": ("conversations",),
}


#: The joins of postings as Spark runs them: an order finds its nation before its items come to
#: it, so items are dealt by order and by part only, and not by customer with all columns in tow.
POSTINGS_JOINS = """FROM lineitem l
JOIN (SELECT * FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey) o ON o.o_orderkey = l.l_orderkey
JOIN part p ON p.p_partkey = l.l_partkey
JOIN supplier s ON s.s_suppkey = l.l_suppkey"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: For queries that take few columns of an order: its items meet a hash map of a partition's orders
#: (one row an order, so no key is hot), and neither side is sorted.
ORDERS_BY_HASH = "SHUFFLE_HASH(o)"

#: As ORDERS_BY_HASH, and items meet a hash map of a partition's parts (one row a part) too, so that
#: items are never sorted, which spills to disk.
ALL_BY_HASH = "SHUFFLE_HASH(o, p)"


def view(spark: SparkSession, sf_dir: str, name: str, hint: str = "") -> DataFrame:
    """A fixture view, or the given table of that name; a hint is one for its joins."""
    if name not in VIEWS:
        return table(spark, sf_dir, name)
    for t in TABLES[name]:
        df = table(spark, sf_dir, t)
        if name == "job_pages":  # wide pages made from a narrow file of one split
            df = df.repartition(spark.sparkContext.defaultParallelism)
        df.createOrReplaceTempView(t)
    sql = VIEWS[name]
    if name == "postings":
        sql = sql[: sql.index("FROM lineitem l")].replace("n.n_name", "o.n_name") + POSTINGS_JOINS
    return spark.sql(sql.replace("SELECT", f"SELECT /*+ {hint} */", 1) if hint else sql)


def with_views(sql: str, *names: str) -> str:
    """Oracle SQL with the views it uses in front."""
    parts = ", ".join(f"{n} AS ({VIEWS[n]})" for n in names)
    body = sql.lstrip()
    return f"WITH RECURSIVE {parts}, {body[15:].lstrip()}" if body.upper().startswith("WITH RECURSIVE ") else f"WITH {parts}, {body[5:]}" if body.upper().startswith("WITH ") else f"WITH {parts} {body}"
