"""Engine-neutral views over the driver's tables, used by queries and oracles.

Each view is plain SQL that Spark and DuckDB read alike, except for the names
of two functions, which :func:`duckdb_text` maps.  Faults are seeded by
arithmetic on keys.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import cut_lineage

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)

VIEWS: dict[str, str] = {}
# views that Spark builds by an operator instead of by their SQL text; they are
# written once per session and folder, as a stored graph would be
BUILDERS: dict[str, Callable[["Fixtures"], DataFrame]] = {}
# views that Spark derives by an operator each time they are read, so that a query computes and moves only what it reads
DERIVED: dict[str, Callable[["Fixtures"], DataFrame]] = {}
_STORED: dict[tuple[str, str, str], DataFrame] = {}

_SOURCE = re.compile(r"\b(from|join)(\s+)([a-z_]+)\b")


def view(name: str, sql: str, stored: bool = False) -> None:
    """Define a view; a stored one is written once in Spark, as an input table would be."""
    VIEWS[name] = sql.strip()
    if stored:
        BUILDERS[name] = lambda fixtures: fixtures.sql(VIEWS[name])


class Fixtures:
    """Tables and views of one data folder, each built once and lazily."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self._folder = folder
        self._frames: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        if name not in self._frames:
            if name in BUILDERS:
                frame = self._stored(name)
            elif name in DERIVED:
                frame = DERIVED[name](self)
            elif name in TABLES:
                frame = self.spark.read.parquet(f"{self._folder}/{name}.parquet")
            else:
                frame = self.sql(VIEWS[name])
            self._frames[name] = frame
        return self._frames[name]

    def _stored(self, name: str) -> DataFrame:
        key = (self.spark.sparkContext.applicationId, self._folder, name)
        if key not in _STORED:
            _STORED[key] = cut_lineage(BUILDERS[name](self))
        return _STORED[key]

    def sql(self, text: str) -> DataFrame:
        known = [name for _, _, name in _SOURCE.findall(text) if name in TABLES or name in VIEWS]
        escaped = text.replace("{", "{{").replace("}", "}}")
        marked = _SOURCE.sub(
            lambda m: f"{m[1]}{m[2]}{{{m[3]}}}" if m[3] in known else m[0], escaped
        )
        return self.spark.sql(marked, **{name: getattr(self, name) for name in set(known)})


def duckdb_text(sql: str) -> str:
    """Make the query self-contained: views become leading common table expressions."""
    order: list[str] = []

    def visit(text: str) -> None:
        for _, _, name in _SOURCE.findall(text):
            if name in VIEWS and name not in order:
                visit(VIEWS[name])
                order.append(name)

    visit(sql)
    parts = [f"{name} as (\n{VIEWS[name]}\n)" for name in order]
    text = f"with {', '.join(parts)}\nselect * from (\n{sql.strip()}\n) q" if parts else sql.strip()
    return text.replace("sha2(", "sha256(").replace(", 256)", ")").replace("octet_length(", "strlen(")


view("payload", """
select source as bundle_id, doc_id, 'artifacts/' || lang || '/' || doc_id || '.txt' as path,
       text as content, octet_length(text) as size, sha2(text, 256) as sha256
from documents
""")

# %17 unlisted (extra file), %19 wrong digest, %23 wrong size
view("manifest", """
select source as bundle_id, 'artifacts/' || lang || '/' || doc_id || '.txt' as path,
       case when doc_id % 19 = 0 then sha2('x' || text, 256) else sha2(text, 256) end as sha256,
       cast(octet_length(text) + case when doc_id % 23 = 0 then 1 else 0 end as string) as size
from documents where doc_id % 17 <> 0
""")

# %29 missing file; an unlisted directory in half of the bundles
view("listing", """
select source as bundle_id, 'artifacts/' || lang || '/' || doc_id || '.txt' as path, 'file' as object_type
from documents where doc_id % 29 <> 0
union all select distinct source, 'artifacts', 'directory' from documents
union all select distinct source, 'artifacts/' || lang, 'directory' from documents
union all select distinct source, 'empty', 'directory' from documents where doc_id % 4 = 0
""")

view("checksum", """
select source as bundle_id, sha2(text, 256) as sha256, 'artifacts/' || lang || '/' || doc_id || '.txt' as path,
       row_number() over (partition by source order by doc_id) as pos
from documents where doc_id % 37 <> 0
""")

# raw pages, one site
view("html", """
select 'site' as bundle_id, 'p' || page_id || '.html' as path, html from pages
""")

# pages with anchors; duplicate names, missing targets and fragments
view("html_talk", """
select 'talk' as bundle_id, 'c' || conv_id || '.html' as path, conv_id, turn,
       '<h2 id="t' || turn || '"></h2><a name="' || role || '"></a><a href="c' || (conv_id + 1) || '.html#t' || turn || '">n</a>' as html_part
from conversations
""")

# two captures a and b with added, removed, mode and byte changes, symbolic links
view("snapshot_file", """
select 'a' as snapshot_id, lang || '/' || doc_id || '.txt' as path,
       case when doc_id % 31 = 0 then 'symlink' else 'file' end as kind,
       case when doc_id % 31 = 0 then '120000' else '100644' end as mode,
       sha2(text, 256) as sha256,
       case when doc_id % 31 = 0 then (doc_id + 1) || '.txt' end as target
from documents where doc_id % 11 <> 0
union all
select 'b', lang || '/' || doc_id || '.txt',
       case when doc_id % 31 = 0 then 'symlink' else 'file' end,
       case when doc_id % 31 = 0 then '120000' when doc_id % 5 = 0 then '100755' else '100644' end,
       case when doc_id % 7 = 0 then sha2(text || 'x', 256) else sha2(text, 256) end,
       case when doc_id % 31 = 0 then (doc_id + 1) || '.txt' end
from documents where doc_id % 13 <> 0
""", stored=True)

# line 7 gives a bare basename (ambiguous or missing source)
view("relation", """
select l_orderkey % 100 as scope, 'r/' || l_orderkey || '.html' as report_path,
       case when l_linenumber = 7 then replace(p_name, ' ', '_') || '.c'
            else 'src/' || p_partkey || '/' || replace(p_name, ' ', '_') || '.c' end as source_path,
       case when l_linenumber = 1 then null else cast(l_quantity as int) end as line,
       case when l_returnflag = 'R' then p_name end as symbol
from lineitem join part on l_partkey = p_partkey
""")

# selected sources with their line count
view("relation_source", """
select 'src/' || p_partkey || '/' || replace(p_name, ' ', '_') || '.c' as path,
       replace(p_name, ' ', '_') || '.c' as basename, p_size as line_count
from part
""")

# some report targets absent
view("coverage_artifact", """
select o_orderkey % 100 as scope, 'r/' || o_orderkey || '.html' as path, sha2('o' || o_orderkey, 256) as sha256
from orders where o_orderkey % 9 <> 0
""")

# tree, snapshot and configuration mismatches
view("attestation", """
select c_custkey as scope, sha2(c_name, 256) as tree_sha256,
       case when c_custkey % 13 = 0 then sha2('x', 256) else sha2(c_name, 256) end as bound_tree_sha256,
       's' || c_nationkey as snapshot_id,
       case when c_custkey % 5 = 0 then 's?' else 's' || c_nationkey end as bound_snapshot_id,
       c_mktsegment as configuration, case when c_custkey % 7 = 0 then 'OTHER' else c_mktsegment end as bound_configuration
from customer where c_custkey % 3 <> 0
""")

view("symbol_entity", """
select 'p' || p_partkey as refid, p_brand as compound_name, p_name as member_name, p_type as kind,
       '(' || p_size || ',  int)' as args, 'src/' || p_partkey || '.c' as source_path
from part
""")

# %10 missing, %12 doubled (ambiguous)
view("symbol_target", """
select p_brand as compound_name, p_name as member_name, p_type as kind, '(' || p_size || ', int)' as args,
       'html/' || p_partkey || '.html' as html_path, 'a' || p_partkey as anchor
from part where p_partkey % 10 <> 0
union all
select p_brand, p_name, p_type, '(' || p_size || ', int)', 'html/' || p_partkey || '.html', 'b' || p_partkey
from part where p_partkey % 12 = 0
""")

# ids with a detail record (index side: every part); every 9th part has lost its own
view("detail_ref", """
select distinct 'p' || l_partkey as refid from lineitem where l_partkey % 9 <> 0
union all select 'q' || s_suppkey from supplier where s_suppkey % 10 = 0
""")

view("graph_node", """
select r_regionkey as graph_id, 'snapshot' as kind, 'r' || r_regionkey as node_key, r_name as label from region
union all select n_regionkey, 'stage-result', 'n' || n_nationkey, n_name from nation
union all select n_regionkey, 'stage-output', 's' || s_suppkey, s_name from supplier join nation on s_nationkey = n_nationkey
union all select n_regionkey, 'producer-log', 'c' || c_custkey, c_name from customer join nation on c_nationkey = n_nationkey
union all select n_regionkey, 'coverage-page', 'o' || o_orderkey, o_orderpriority
  from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey
union all select cast(p_partkey % 5 as int), 'source-file', 'p' || p_partkey, p_name from part
""")

# wrong-way has-log edges; coverage edges that leave their graph
view("graph_edge", """
select n_regionkey as graph_id, 'describes-snapshot' as kind, 'n' || n_nationkey as source, 'r' || n_regionkey as target, cast(null as int) as line from nation
union all select n_regionkey, 'generated-by-stage', 's' || s_suppkey, 'n' || n_nationkey, null
  from supplier join nation on s_nationkey = n_nationkey
union all select n_regionkey, 'has-log',
  case when c_acctbal < 0 then 'c' || c_custkey else 'n' || n_nationkey end,
  case when c_acctbal < 0 then 'n' || n_nationkey else 'c' || c_custkey end, null
  from customer join nation on c_nationkey = n_nationkey
union all select n_regionkey, 'covers-source', 'o' || o_orderkey, 'p' || l_partkey, l_linenumber
  from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey
""")

# every event is a stage of a run: the latest of its type on a day belongs to the day's run, the one before it to
# the second run of that day, and so on
view("event_run", """
select user_id, event_id, ts, event_type, value,
       user_id || '-' || cast(ts as date) || case when rn = 1 then '' else '-' || rn end as run_id
from (select *, row_number() over (partition by user_id, cast(ts as date), event_type order by ts desc, event_id desc) as rn from events) t
""", stored=True)
view("stage", """
select run_id, event_type as stage,
       case event_id % 10 when 0 then 'failed' when 1 then 'blocked' when 2 then 'skipped' when 3 then 'degraded' else 'succeeded' end as status,
       case when event_type in ('purchase', 'signup') then 'required' else 'optional' end as policy,
       case when event_id % 10 = 0 or event_id % 77 = 0 then 1 else 0 end as exit_code,
       value as wall_seconds, case when event_id % 9 = 0 then value * 2 else value end as duration_seconds, event_id
from event_run
""", stored=True)

# unknown dependencies where a stage did not run; cycles for %25 users
view("stage_dep", """
select distinct run_id, event_type as stage,
       case event_type when 'purchase' then 'click' when 'click' then 'view' when 'signup' then 'view' when 'error' then 'purchase'
            when 'view' then case when user_id % 25 = 0 then 'purchase' else 'snapshot' end end as dependency
from event_run
""")

# observed outputs (declared: 'out/' || stage || '.json' for every stage row)
view("stage_output", """
select distinct run_id, event_type as stage,
       'out/' || event_type || case when event_id % 10 = 0 then '.tmp' else '.json' end as path, 'json' as kind
from event_run where event_id % 6 <> 0
""")

# layer 0 defaults, 1 controlled, 2 overrides (a whole-object override hides the leaves below it)
view("config_leaf", """
select c_custkey as project_id, 0 as layer, '/project/segment' as pointer, '"' || c_mktsegment || '"' as value_json from customer
union all select c_custkey, 0, '/project/nation', cast(c_nationkey as string) from customer
union all select o_custkey, 1, '/project/segment', '"' || max(o_orderpriority) || '"' from orders group by o_custkey
union all select o_custkey, 2, case when max(o_orderkey) % 4 = 0 then '/project' else '/project/nation' end, cast(max(o_orderkey) as string)
  from orders where o_orderkey % 3 = 0 group by o_custkey
""")

view("publication", """
select o_orderkey as run_id,
       case o_orderkey % 7 when 0 then 'not-attempted' when 1 then 'definite-pre-commit-failure' when 2 then 'commit-indeterminate'
            when 3 then 'durable-success' when 4 then 'recovered-durable-success' when 5 then 'recovered-no-commit' else 'recovery-blocked' end as state,
       case when o_orderkey % 11 = 0 then 99 when o_orderkey % 7 in (3, 4) then 0 when o_orderkey % 7 = 0 then 10 when o_orderkey % 7 = 1 then 11
            when o_orderkey % 7 = 2 then 12 when o_orderkey % 7 = 5 then 13 else 14 end as exit_code,
       case when o_orderkey % 7 in (1, 2, 3, 4) and o_orderkey % 13 <> 0 then 'bundle:sha256:' || sha2('b' || o_orderkey, 256) end as bundle_id,
       case when o_orderkey % 7 in (2, 3) then 'releases/bundle:sha256:' || sha2('b' || o_orderkey, 256) end as intended_current_target
from orders
""")

# pointers per root, some absent, malformed or unknown
view("release", """
select s_suppkey as root, 'bundle:sha256:' || sha2(s_name, 256) as bundle_id, sha2('r' || s_suppkey, 256) as run_report_sha256,
       case s_suppkey % 6 when 0 then null when 1 then 'releases/other' when 2 then 'releases/bundle:sha256:' || sha2('z', 256)
            else 'releases/bundle:sha256:' || sha2(s_name, 256) end as pointer_target
from supplier
""")

view("signature", """
select c_custkey as bundle_key, sha2(c_name, 256) as manifest_sha256,
       '{"algorithm":"' || case when c_custkey % 11 = 0 then 'rsa' else 'ed25519' end
       || '","binding":{"manifest_sha256":"' || case when c_custkey % 7 = 0 then sha2('x', 256) else sha2(c_name, 256) end
       || '"},"key_id":"n' || c_nationkey || '","schema":"' || case when c_custkey % 13 = 0 then 'v0' else 'v1' end || '"}' as envelope_json
from customer
""")

# revisions per project in date order
view("policy", """
select o_custkey as project, o_orderkey as revision_order, o_orderpriority as version,
       cast(o_orderkey % 3 as int) as fixture_revision, o_orderstatus as contract_digest
from orders
""")

view("logs", """
select conv_id as run_id, turn as seq, text from conversations
""")

# ordered protected literals of each run: first words and whole texts
view("secret", """
select r.run_id, b.ord, b.literal
from (select distinct conv_id as run_id from conversations) r
join (select item_id as ord, item_id % 10 as part, split_part(text, ' ', 1) as literal from benchmark
      union all select 100000 + item_id, item_id % 10, text from benchmark
      union all select 200000 + item_id, item_id % 10, '' from benchmark) b on r.run_id % 10 = b.part
""")
