"""DuckDB SQL of the graph views, as common table expressions."""

BASE = """
with recursive pos as (select vec_id, embedding[1]::double * 1000 x, embedding[2]::double * 1000 y, embedding[3]::double * 1000 z,
  embedding[4]::double * 1000 x2, embedding[5]::double * 1000 y2, embedding[6]::double * 1000 z2, label region from embeddings),
b as (select 'S' || s_suppkey body, 'S' kind, s_suppkey key, 'S' || s_nationkey cell_type, 'sensory' superclass, 'none' role, n_regionkey world
    from supplier join nation on s_nationkey = n_nationkey
  union all select 'P' || p_partkey, 'P', p_partkey, 'P' || regexp_extract(p_brand, '(\\d+)', 1), p_type,
    case regexp_extract(p_brand, '(\\d+)', 1)::int % 10 when 1 then 'descending' when 3 then 'ascending' else 'none' end, null from part
  union all select 'C' || c_custkey, 'C', c_custkey, 'C' || c_nationkey, 'motor', case c_nationkey % 5 when 1 then 'descending' when 3 then 'ascending' else 'none' end, n_regionkey from customer join nation on c_nationkey = n_nationkey),
own as (select body, kind, key, case when world in (0, 1) then 'brain' when world in (3, 4) then 'vnc' when key % 2 = 0 then 'brain' else 'vnc' end compartment from b where kind <> 'P'),
lean as (select l_partkey, sum(case when compartment = 'brain' then 1 else -1 end * l_quantity::bigint) v from lineitem join own on own.kind = 'S' and own.key = l_suppkey group by 1),
comp as (select body, compartment from own union all select 'P' || l_partkey, case when v > 0 then 'brain' when v < 0 then 'vnc' end from lean),
nodes as (select b.body node, b.kind, b.key, cell_type, case when b.key % 2 = 0 then 'L' else 'R' end side, superclass, role, comp.compartment, x, y, z, x2, y2, z2, region
  from b left join pos on vec_id = b.key % (select count(*) from embeddings) left join comp on comp.body = b.body),
lo as (select 'S' || l_suppkey s, 'P' || l_partkey p, 'C' || o_custkey c, l_returnflag f, l_quantity::bigint w from lineitem join orders on l_orderkey = o_orderkey),
conn as (select s pre, p post, w from lo union all select p, c, w from lo union all select c, s, w from lo where f = 'R' union all select c, p, w from lo where f = 'R' union all select p, s, w from lo where f = 'R' union all select s, s, w from lo where f = 'N'),
fraw as (select pre src, post dst, sum(w)::bigint weight, count(*) n_connections from conn group by 1, 2),
ffrac as (select *, weight / sum(weight) over (partition by dst) input_fraction from fraw),
edges as (select * from ffrac where src <> dst and input_fraction >= 0.01),
label as (select node body, cell_type || '|' || side node from nodes),
craw as (select a.node src, c.node dst, sum(w)::bigint weight, count(*) n_connections from conn join label a on a.body = pre join label c on c.body = post group by 1, 2),
cfrac as (select *, weight / sum(weight) over (partition by dst) input_fraction from craw),
cedges as (select * from cfrac where src <> dst and input_fraction >= 0.01),
cb as (select node body, cell_type || '|' || side node, cell_type, side, superclass, role, compartment, case when kind <> 'P' then x end x, case when kind <> 'P' then y end y, case when kind <> 'P' then z end z, x2, y2, z2, kind, key from nodes),
me as (select e.*, s.x src_x, s.y src_y, s.z src_z, s.compartment src_compartment, s.role src_role, s.superclass src_superclass, s.region src_region, s.side src_side, s.cell_type src_cell_type,
  d.compartment dst_compartment, d.role dst_role, d.superclass dst_superclass, d.region dst_region, d.side dst_side, d.cell_type dst_cell_type,
  sqrt((s.x - d.x) * (s.x - d.x) + (s.y - d.y) * (s.y - d.y) + (s.z - d.z) * (s.z - d.z)) length
  from edges e join nodes s on s.node = src join nodes d on d.node = dst),
mm as (select *, round(length * 1000000)::bigint micro from me),
crossed as (select *, coalesce((src_role = 'descending' and dst_role = 'none' and dst_compartment = 'vnc') or (dst_role = 'descending' and src_role = 'none' and src_compartment = 'vnc')
  or (src_role = 'ascending' and dst_role = 'none' and dst_compartment = 'brain') or (dst_role = 'ascending' and src_role = 'none' and src_compartment = 'brain'), false) crossing from mm),
grouped as (select *, 'all' edge_group from crossed union all select *, 'brain' from crossed where src_compartment = 'brain' and dst_compartment = 'brain'
  union all select *, 'vnc' from crossed where src_compartment = 'vnc' and dst_compartment = 'vnc'
  union all select *, 'between' from crossed where (src_compartment = 'brain' and dst_compartment = 'vnc') or (src_compartment = 'vnc' and dst_compartment = 'brain')
  union all select *, 'crossing' from crossed where crossing),
en as (select src node, dst other, micro, length from mm union all select dst, src, micro, length from mm),
deg as (select n.node, coalesce(o, 0) out_degree, coalesce(i, 0) in_degree, coalesce(o, 0) + coalesce(i, 0) degree from nodes n
  left join (select src node, count(*) o from edges group by 1) a on a.node = n.node left join (select dst node, count(*) i from edges group by 1) c on c.node = n.node),
rich0 as (select n.node, n.role = 'none' and n.compartment is not null member, n.compartment side, coalesce(r, 0) richness from nodes n left join
  (select node, count(*) r from (select src node from me where src_role = 'none' and dst_role = 'none' union all select dst from me where src_role = 'none' and dst_role = 'none') group by 1) q on q.node = n.node),
rich as (select node, coalesce(member and richness >= cut, false) rich, richness, member, r.side from rich0 r left join (select side, quantile_cont(richness, 0.9) cut from rich0 where member group by 1) q on q.side = r.side),
lay0 as (select *, case when src_role = 'none' and src_compartment = 'brain' and dst_role = 'descending' then 'brain-descending' when src_role = 'descending' and dst_role = 'none' and dst_compartment = 'vnc' then 'descending-vnc'
  when src_role = 'none' and src_compartment = 'vnc' and dst_role = 'ascending' then 'vnc-ascending' when src_role = 'ascending' and dst_role = 'none' and dst_compartment = 'brain' then 'ascending-brain' end layer from mm),
lay as (select layer, micro, case when layer in ('brain-descending', 'vnc-ascending') then dst else src end hub, case when layer in ('brain-descending', 'vnc-ascending') then src else dst end partner from lay0 where layer is not null)
"""


def draw(*keys: str) -> str:
    """SQL of the uniform number of keys (SQL expressions)."""
    text = " || ':' || ".join(f"({k})::varchar" for k in keys)
    return f"(('0x' || substr(md5({text}), 1, 8))::bigint / 4294967296.0::double)"
