"""Archive-shaped views of the sample tables, as SQL for Spark and for the engine that checks it.

Ids are hex strings here; the operators take strings and bytes alike. Where the two dialects differ, a view has
two texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.plans import paging

_CHANGED = "(s_suppkey % 7 = 0 or s_suppkey % 5 = 0 or s_suppkey % 11 = 0 or s_suppkey % 13 = 0)"
_TREE_1 = """select 'root' as directory_id, r_name as name, 'dir' as type, 'r' || r_regionkey as target, 16384 as perms from {region}
union all select 'r' || n_regionkey, n_name, 'dir', 'n' || n_nationkey, 16384 from {nation}
union all select 'n' || s_nationkey, s_name, 'file', sha1(s_name), 33188 from {supplier}"""
_TREE_2 = f"""select 'root2' as directory_id, r_name as name, 'dir' as type, 'q' || r_regionkey as target, 16384 as perms from {{region}}
union all select 'q' || n_regionkey, n_name, 'dir', case when c.k is null then 'n' else 'm' end || n_nationkey, 16384 from {{nation}}
    left join (select distinct s_nationkey as k from {{supplier}} where {_CHANGED}) c on c.k = n_nationkey
union all select 'm' || s_nationkey, case when s_suppkey % 7 = 0 then s_name || '.mv' else s_name end, 'file',
    case when s_suppkey % 5 = 0 then sha1(s_name || 'x') else sha1(s_name) end, case when s_suppkey % 11 = 0 then 33261 else 33188 end
    from {{supplier}} where s_suppkey % 13 <> 0 and s_nationkey in (select s_nationkey from {{supplier}} where {_CHANGED})"""
_BRANCH = """select o_orderkey as snapshot_id, p_name || '/' || l_linenumber || '/' || l_suppkey as name,
    min(case l_returnflag when 'A' then 'alias' when 'R' then 'revision' end) as target_type
    from {orders} join {lineitem} on l_orderkey = o_orderkey join {part} on p_partkey = l_partkey group by 1, 2"""

VIEWS: dict[str, str | tuple[str, str]] = {
    "content": (
        "select doc_id, sha1(text) as sha1, sha1(concat(cast(concat('blob ', octet_length(text)) as binary), X'00', cast(text as binary))) as sha1_git, sha2(text, 256) as sha256, cast(octet_length(text) as bigint) as length, 'visible' as status from {documents}",
        "select doc_id, sha1(text) as sha1, sha1('blob ' || octet_length(encode(text)) || chr(0) || text) as sha1_git, sha256(text) as sha256, cast(octet_length(encode(text)) as bigint) as length, 'visible' as status from {documents}",
    ),
    "skipped": "select cast(null as varchar(40)) as sha1, sha1_git, case when doc_id % 2 = 0 then sha256 end as sha256, length, 'absent' as status, 'too long' as reason from {content} where length > 8000",
    "origin": "select distinct url, sha1(url) as sha1 from (select url from {pages} union all select 'https://archive.example/u' || user_id as url from {events}) x",
    "status": (
        "select 'https://archive.example/u' || user_id as origin, cast(dense_rank() over (partition by user_id order by date_trunc('day', ts)) as bigint) as visit, cast(ts as timestamp) as date, case when user_id % 3 = 0 then 'hg' else 'git' end as type, case event_type when 'signup' then 'created' when 'view' then 'ongoing' when 'click' then 'partial' when 'purchase' then 'full' else 'failed' end as status, case when event_type = 'purchase' then sha1(cast(event_id % 50 as string)) end as snapshot from {events}",
        "select 'https://archive.example/u' || user_id as origin, dense_rank() over (partition by user_id order by date_trunc('day', ts)) as visit, ts as date, case when user_id % 3 = 0 then 'hg' else 'git' end as type, case event_type when 'signup' then 'created' when 'view' then 'ongoing' when 'click' then 'partial' when 'purchase' then 'full' else 'failed' end as status, case when event_type = 'purchase' then sha1(cast(event_id % 50 as varchar)) end as snapshot from {events}",
    ),
    "visit": "select origin, visit, min(date) as date, min(type) as type from {status} group by origin, visit",
    "revision": "select sha1(conv_id || ':' || turn) as id, min(conv_id) as conv_id, min(turn) as turn, min(1000 * turn + conv_id % 7) as seconds, min(case when conv_id % 2 = 0 then 'root' else 'root2' end) as directory from {conversations} group by conv_id, turn",
    "parent": "select sha1(conv_id || ':' || turn) as id, 0 as parent_rank, sha1(conv_id || ':' || (turn - 1)) as parent_id from {conversations} where turn > 0 union all select sha1(a.conv_id || ':' || a.turn), 1, sha1(b.conv_id || ':' || b.turn) from {conversations} a join {conversations} b on b.conv_id = a.conv_id - 1 and b.turn = a.turn - 1 where a.conv_id % 3 = 0",
    "tree1": _TREE_1,
    "tree2": _TREE_2,
    "entry": "select * from {tree1} union all select * from {tree2}",
    "branch": f"select snapshot_id, name, target_type, case target_type when 'revision' then sha1(cast(snapshot_id % 97 as varchar(20))) when 'alias' then max(name) over (partition by snapshot_id) end as target from ({_BRANCH}) x",
    "snapshot": "select o_orderkey as id from {orders}",
    "release": "select sha1('rel' || p_partkey) as id, p_name as name, sha1(p_brand) as target, 'revision' as target_type from {part}",
    "extid": "select 'url' as extid_type, url as extid, page_id % 3 as extid_version, 'content' as target_type, sha1(html) as target from {pages}",
    "metadata": (
        "select sha1(l.doc_id || '/' || d.source) as id, sha1(d.text) as target, d.source as authority, d.lang as fetcher, timestamp '2024-01-01 00:00:00' + make_dt_interval(cast(l.doc_id % 30 as int)) as discovery_date, l.quality * 2 + l.toxic as payload from {labels} l join {documents} d on d.doc_id = l.doc_id",
        "select sha1(l.doc_id || '/' || d.source) as id, sha1(d.text) as target, d.source as authority, d.lang as fetcher, timestamp '2024-01-01 00:00:00' + l.doc_id % 30 * interval '1 day' as discovery_date, l.quality * 2 + l.toxic as payload from {labels} l join {documents} d on d.doc_id = l.doc_id",
    ),
    "mask": "select doc_id as object_id, 'content' as object_type, 'req' || doc_id % 4 as request, case doc_id % 3 when 0 then 'visible' when 1 then 'decision_pending' else 'restricted' end as state from {documents} where doc_id % 17 = 0",
    "rule": "select 'http://' || h as url_match, n as request, case n % 3 when 0 then 'non_blocked' when 1 then 'decision_pending' else 'blocked' end as state from (select split_part(url, '/', 3) as h, min(page_id) as n from {pages} group by 1) x where n % 2 = 0 union all select url, page_id, case page_id % 3 when 0 then 'non_blocked' when 1 then 'decision_pending' else 'blocked' end from {pages} where page_id % 10 = 0",
    "person": "select c_custkey as id, c_name || ' <c' || c_nationkey || '@example.org>' as fullname from {customer}",
    "display": "select 'c' || n_nationkey || '@example.org' as original_email, n_name as display_name from {nation} where n_nationkey % 2 = 0",
}
BASE = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def _needs(text: str) -> list[str]:
    return [n for n in (*VIEWS, *BASE) if f"{{{n}}}" in text]


def branches(orders: DataFrame, lineitem: DataFrame, part: DataFrame) -> DataFrame:
    """The view ``branch``, dealt by snapshot over as many tasks as its lines ask for: one shuffle for join, grouping and window.

    Parts are joined where the lines lie while one task could hold them all, else both sides are dealt by part.
    """
    n = paging.tasks_for(lineitem)
    lines, parts = lineitem.select("l_orderkey", "l_partkey", "l_linenumber", "l_suppkey", "l_returnflag"), part.select("p_partkey", "p_name")
    if part.count() > paging.ROWS_OF_A_TASK:
        lines, parts = lines.repartition(n, "l_partkey"), parts.repartition(n, "p_partkey").hint("merge")
    name = F.concat("p_name", F.lit("/"), F.col("l_linenumber").cast("string"), F.lit("/"), F.col("l_suppkey").cast("string"))
    # numbers in the order of the types' names: least numbers are kept in a hash table, least strings would be sorted
    kind = F.when(F.col("l_returnflag") == "A", 1).when(F.col("l_returnflag") == "R", 2)
    named = lines.join(parts, F.col("l_partkey") == F.col("p_partkey")).select("l_orderkey", name.alias("name"), kind.alias("kind"))
    known = orders.select("o_orderkey").repartition(n, "o_orderkey")
    rows = named.repartition(n, "l_orderkey").join(known, F.col("l_orderkey") == F.col("o_orderkey"))
    rows = rows.groupBy(F.col("l_orderkey").alias("snapshot_id"), "name").agg(F.min("kind").alias("kind"))
    last = F.max("name").over(Window.partitionBy("snapshot_id"))
    target = F.when(F.col("kind") == 2, F.sha1((F.col("snapshot_id") % 97).cast("string").cast("binary"))).when(F.col("kind") == 1, last)
    return rows.select("snapshot_id", "name", F.when(F.col("kind") == 1, "alias").when(F.col("kind") == 2, "revision").alias("target_type"), target.alias("target"))


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view, or a sample table, as a DataFrame."""
    if name in BASE:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    if name == "branch":
        return branches(*[view(spark, sf_dir, n) for n in ("orders", "lineitem", "part")])
    text = VIEWS[name] if isinstance(VIEWS[name], str) else VIEWS[name][0]
    return spark.sql(text, **{n: view(spark, sf_dir, n) for n in _needs(text)})


def checking_sql(body: str, *names: str, recursive: str = "") -> str:
    """``body`` under a WITH that defines the views it names, and what they need, in the checking engine's dialect."""
    order: list[str] = []

    def add(name: str) -> None:
        text = VIEWS[name] if isinstance(VIEWS[name], str) else VIEWS[name][1]
        for n in _needs(text):
            if n in VIEWS and n not in order:
                add(n)
        if name not in order:
            order.append(name)

    for n in names:
        add(n)
    parts = []
    for n in order:
        text = VIEWS[n] if isinstance(VIEWS[n], str) else VIEWS[n][1]
        for need in _needs(text):
            text = text.replace(f"{{{need}}}", f"v_{need}" if need in VIEWS else need)
        parts.append(f"v_{n} as ({text})")
    if recursive:
        parts.append(recursive)
    if not parts:
        return body
    return f"with {'recursive ' if recursive else ''}{', '.join(parts)} {body}"
