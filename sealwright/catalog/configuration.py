"""Layered configuration."""

from __future__ import annotations

from .. import contract as c
from ..operators import configuration
from ..plans.fixtures import Fixtures, view
from . import query

CONFIG_SCHEMA = c.schema_id("config.v1")

# deeper layers: an object over a scalar, a scalar over an object, empty objects
view("config_deep", """
select project_id, layer, pointer, value_json from config_leaf
union all select c_custkey, 0, '/stages/doc', 'true' from customer
union all select c_custkey, 1, '/stages/doc/enabled', 'false' from customer where c_custkey % 3 = 0
union all select c_custkey, 1, '/stages', '[]' from customer where c_custkey % 5 = 0
union all select c_custkey, 0, '/ext/a.b/x', '1' from customer
union all select c_custkey, 0, '/ext/a.b/y', '2' from customer
union all select c_custkey, 1, '/ext', '{}' from customer where c_custkey % 7 = 0
union all select c_custkey, 2, '/ext/a.b', '{}' from customer where c_custkey % 11 = 0
""")
view("config_override", """
select c_custkey as project_id, '/project/segment' as pointer from customer
union all select c_custkey, '/project' from customer where c_custkey % 4 = 0
union all select c_custkey, '/project/segment' from customer where c_custkey % 6 = 0
union all select c_custkey, '/a~2b' from customer where c_custkey % 9 = 0
union all select c_custkey, '/none/deep' from customer where c_custkey % 10 = 0
union all select c_custkey, '/project/nation/x' from customer where c_custkey % 14 = 0
""")
view("identity_text", f"""
select c_custkey as project_id, '{{"controlled_input":{{"path":"' || case when c_custkey % 10 = 1 then '/etc/x' else 'inspector.json' end || '","sha256":"' || case when c_custkey % 10 = 2 then upper(sha2(c_name, 256)) else sha2(c_name, 256) end
  || '","size":"' || case when c_custkey % 10 = 3 then '01' else '12' end || '"}},"defaults":{{"id":"' || case when c_custkey % 10 = 4 then '' else 'builtin-v1' end || '","sha256":"' || sha2('d', 256)
  || '"}},"overrides":[' || case c_custkey % 10 when 5 then '{{"pointer":"/b","value":1}},{{"pointer":"/a","value":2}}' when 6 then '{{"pointer":"/a","value":1}},{{"pointer":"/a-b","value":1}},{{"pointer":"/a/b","value":2}}'
     when 7 then '{{"pointer":"a","value":2}}' when 8 then '{{"pointer":"/a","value":1}},{{"pointer":"/a","value":2}}' else '{{"pointer":"/a","value":{{"z":1}}}}' end
  || '],"resolved":{{"sha256":"' || sha2('r', 256) || '"}},"schema":{{"id":"{CONFIG_SCHEMA}","sha256":"' || sha2('s', 256) || '"}}' || case when c_custkey % 10 = 9 then ',"extra":1' else '' end || '}}' as identity_json
from customer
""")


@query("config_layer_resolve", """
with t as (select project_id, pointer, layer, value_json from (
  select *, row_number() over (partition by project_id, pointer order by layer desc, value_json desc) as rn from config_deep) x where rn = 1)
select t.project_id, t.pointer, t.value_json, t.layer from t
where not exists (select 1 from config_deep h where h.project_id = t.project_id and h.layer > t.layer and starts_with(t.pointer, h.pointer || '/')
                  and not (h.layer < 2 and h.value_json = '{}'))
  and not exists (select 1 from config_deep h where h.project_id = t.project_id and h.layer > t.layer and starts_with(h.pointer, t.pointer || '/'))
  and not (t.layer < 2 and t.value_json = '{}' and exists (select 1 from config_deep h where h.project_id = t.project_id and starts_with(h.pointer, t.pointer || '/')))
""")
def _(v: Fixtures):
    return configuration.config_layer_resolve(v.config_deep)


@query("override_overlap_audit", """
with o as (select * from config_override where not regexp_matches(pointer, '~([^01]|$)')),
d as (select project_id, pointer, count(*) as n from o group by project_id, pointer),
b as (select distinct project_id, pointer from config_leaf where layer < 2)
select cast(project_id as varchar) as scope_id, 0 as check_rank, 'configuration.invalid_pointer' as code, pointer as path, cast(null as varchar) as detail
from config_override where regexp_matches(pointer, '~([^01]|$)')
union all select cast(project_id as varchar), 0, 'configuration.duplicate_pointer', pointer, cast(n as varchar) from d where n > 1
union all select cast(x.project_id as varchar), 0, 'configuration.overlapping_pointer', x.pointer, y.pointer from d x join d y on x.project_id = y.project_id and starts_with(x.pointer, y.pointer || '/')
union all select cast(project_id as varchar), 0, 'configuration.invalid_pointer_target', pointer, null from d
where (pointer = '/none/deep') or (pointer = '/project/nation/x')
   or (pointer like '/project/%' and not exists (select 1 from b where b.project_id = d.project_id and starts_with(b.pointer, '/project/')))
""")
def _(v: Fixtures):
    return configuration.override_overlap_audit(v.config_override, v.config_leaf.filter("layer < 2"))


@query("configuration_identity_audit", """
select cast(c_custkey as varchar) as scope_id, 70 as check_rank, case when c_custkey % 10 = 1 then 'path.invalid' else 'run_report.invalid_shape' end as code,
       case when c_custkey % 10 = 1 then cast(null as varchar) end as path,
       case c_custkey % 10 when 1 then '/etc/x' when 2 then 'digest' when 3 then 'size' when 4 then 'defaults' when 5 then 'pointer order' when 6 then 'pointer overlap'
            when 7 then 'pointer' when 8 then 'pointer order' else 'members' end as detail
from customer where c_custkey % 10 <> 0
""")
def _(v: Fixtures):
    return configuration.configuration_identity_audit(v.identity_text, "project_id", "identity_json")
