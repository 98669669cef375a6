"""Links and anchors: raw pages, dialogue pages and a table of special references."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import links
from ..plans.fixtures import BUILDERS, Fixtures, view
from . import query

# every form of reference in turn
view("link_case", """
select source as bundle_id, 'docs/' || lang || '/p' || doc_id || '.html' as path, doc_id as pos, case doc_id % 20
    when 0 then 'https://example.com/' || doc_id when 1 then '//host/p' when 2 then 'mailto:a@b.c'
    when 3 then 'a%zz' || doc_id when 4 then 'a%FF' || doc_id when 5 then '../x' || doc_id || '.html'
    when 6 then '../../../x' || doc_id when 7 then '/dir' || doc_id || '/' when 8 then '' when 9 then '#t' || doc_id
    when 10 then '?q=1#f%20x' when 11 then 'sub/./q' || doc_id || '.html' when 12 then './'
    when 13 then 'caf%C3%A9' || doc_id || '.html#s' when 14 then 'a+b' || doc_id || '.html'
    when 15 then '/' when 16 then 'p.html?x=%FF' when 17 then 'p.html#%FF'
    when 18 then 'a%5Cb' || doc_id when 19 then 'http://[' || doc_id end as reference
from documents
""")

# how each of them resolves, written out by hand
view("link_answer", """
select bundle_id, path, pos, reference, case pos % 20
    when 5 then 'docs/x' || pos || '.html' when 6 then '../x' || pos when 7 then 'dir' || pos || '/index.html'
    when 8 then path when 9 then path when 10 then path when 12 then regexp_replace(path, '/[^/]*$', '') || '/index.html'
    when 11 then regexp_replace(path, '/[^/]*$', '') || '/sub/q' || pos || '.html'
    when 13 then regexp_replace(path, '/[^/]*$', '') || '/café' || pos || '.html'
    when 14 then regexp_replace(path, '/[^/]*$', '') || '/a+b' || pos || '.html'
    when 15 then 'index.html' when 17 then regexp_replace(path, '/[^/]*$', '') || '/p.html'
    when 18 then regexp_replace(path, '/[^/]*$', '') || '/a' || chr(92) || 'b' || pos end as target,
  case pos % 20 when 3 then null when 4 then null when 16 then null when 17 then null when 19 then null when 9 then 't' || pos when 10 then 'f x' when 13 then 's' else '' end as fragment,
  pos % 20 = 17 as bad_fragment,
  case pos % 20 when 3 then 'link.malformed_percent' when 4 then 'link.invalid_percent_utf8' when 6 then 'link.root_escape'
    when 16 then 'link.invalid_percent_utf8' when 18 then 'path.invalid' when 19 then 'link.invalid_reference' end as code
from link_case where pos % 20 not in (0, 1, 2)
""")

view("talk_link", """
select 'talk' as bundle_id, 'c' || conv_id || '.html' as path, 'c' || (conv_id + 1) || '.html' as target, 't' || turn as fragment
from conversations
""")

view("talk_anchor", """
select 'talk' as bundle_id, 'c' || conv_id || '.html' as path, 't' || turn as name from conversations
union all select 'talk', 'c' || conv_id || '.html', role from conversations
""")


# pages are parsed once and their parts stored, as several checks read them
BUILDERS["talk_part"] = lambda v: links.page_parts(v.html_talk.withColumnRenamed("html_part", "html"))
BUILDERS["talk_resolved"] = lambda v: links.resolve_links(links.links(v.talk_part))


def _talk_payload(v: Fixtures):
    return v.html_talk.select("bundle_id", "path").distinct()


@query("extract_links", """
select bundle_id, path, kind, pos, value from (
  select bundle_id, path, 'reference' as kind, n - 1 as pos, found[n] as value
  from (select bundle_id, path, regexp_extract_all(html, ' (?:href|src)="([^"]*)"', 1) as found,
               unnest(range(1, len(regexp_extract_all(html, ' (?:href|src)="([^"]*)"', 1)) + 1)) as n from html) r
  union all
  select bundle_id, path, 'anchor', n - 1, found[n]
  from (select bundle_id, path, regexp_extract_all(html, ' id="([^"]*)"', 1) as found,
               unnest(range(1, len(regexp_extract_all(html, ' id="([^"]*)"', 1)) + 1)) as n from html) a) t
""")
def _(v: Fixtures):
    return links.page_parts(v.html)


@query("resolve_links", "select bundle_id, path, pos, reference, target, fragment, bad_fragment, code from link_answer")
def _(v: Fixtures):
    return links.resolve_links(v.link_case)


@query("link_target_check", """
select l.bundle_id as scope_id, 90 as check_rank, 'link.missing_target' as code, l.target as path, l.path as detail
from talk_link l where not exists (select 1 from talk_link p where p.path = l.target)
""")
def _(v: Fixtures):
    return links.link_target_check(v.talk_resolved, _talk_payload(v))


@query("link_fragment_check", """
select l.bundle_id as scope_id, 90 as check_rank, 'link.missing_fragment' as code, l.target as path, l.path || '#' || l.fragment as detail
from talk_link l where exists (select 1 from talk_link p where p.path = l.target)
  and not exists (select 1 from talk_anchor a where a.path = l.target and a.name = l.fragment)
""")
def _(v: Fixtures):
    return links.link_fragment_check(v.talk_resolved, _talk_payload(v), links.anchors(v.talk_part))


@query("duplicate_anchors", """
select bundle_id as scope_id, 80 as check_rank, 'link.ambiguous_fragment' as code, path, name as detail
from talk_anchor group by bundle_id, path, name having count(*) > 1
""")
def _(v: Fixtures):
    return links.duplicate_anchors(links.anchors(v.talk_part))


@query("fragment_resolves_once", """
with need as (
  select distinct bundle_id, target as path, fragment from talk_link
  union select distinct bundle_id, path, 'user' from talk_link),
n as (select need.bundle_id, need.path, need.fragment, count(a.name) as times from need
      left join talk_anchor a on a.path = need.path and a.name = need.fragment group by need.bundle_id, need.path, need.fragment)
select bundle_id as scope_id, 0 as check_rank,
       case when times = 0 then 'navigation.fragment_missing' else 'navigation.fragment_ambiguous' end as code,
       path || '#' || fragment as path, cast(times as varchar) as detail
from n where times <> 1
""")
def _(v: Fixtures):
    wanted = v.talk_link.select("bundle_id", F.col("target").alias("path"), "fragment").unionByName(
        v.talk_link.select("bundle_id", "path", F.lit("user").alias("fragment"))
    )
    return links.fragment_resolves_once(wanted, links.anchors(v.talk_part), "bundle_id")
