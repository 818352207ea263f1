"""The SQL that each query must agree with; ``oplog``, ``rlog`` and ``live`` are the fixture views."""

from __future__ import annotations

OPLOG = """select event_id as lsn, 'user:' || lpad(cast(user_id as varchar(20)), 6, '0') as key,
  case when event_type = 'error' then null else props end as value, event_type = 'error' as is_tombstone,
  cast(floor(event_id / 10) as bigint) as batch_id, cast(event_id % 10 as int) as op_idx,
  cast(floor(event_id * 10 / n) as int) as file_id
from events cross join (select count(*) as n from events) c"""

RLOG = """select o_orderkey as idx, cast(1 + floor(o_orderkey * 4 / n) as bigint) as term,
  case o_orderstatus when 'O' then 'PUT' when 'F' then 'DELETE' else 'BLANK' end as kind,
  'cust:' || lpad(cast(o_custkey as varchar(20)), 8, '0') as key,
  case when o_orderstatus = 'O' then o_orderpriority end as value
from orders cross join (select count(*) as n from orders) c"""

LIVE = """select key, value, lsn from (select *, row_number() over (partition by key order by lsn desc) rn from oplog) t where rn=1 and not is_tombstone"""

BODIES = {
    "live_view": """
select key, value, lsn from (select *, row_number() over (partition by key order by lsn desc) rn from oplog) t where rn=1 and not
is_tombstone
""",
    "range_scan": """
select key, value from (select *, row_number() over (partition by key order by lsn desc) rn from oplog where key>='user:000010'
and key<='user:000020') t where rn=1 and not is_tombstone
""",
    "snapshot_at": """
select key, value from (select *, row_number() over (partition by key order by lsn desc) rn from oplog where lsn < 5000) t where
rn=1 and not is_tombstone
""",
    "point_get": """
select p.key, case when v.is_tombstone then null else v.value end as value from (select 'user:000003' as key union all select
'user:000007' union all select 'user:999999') p left join (select * from (select *, row_number() over (partition by key order by
lsn desc) rn from oplog) t where rn=1) v on p.key=v.key
""",
    "flush": """
select file_id, key, value, is_tombstone, lsn from (select *, row_number() over (partition by file_id,key order by lsn desc) rn
from oplog) t where rn=1
""",
    "compact": """
select key, value, lsn from (select *, row_number() over (partition by key order by lsn desc) rn from oplog where file_id<8) t
where rn=1 and not is_tombstone
""",
    "tomb_gc": """
select count(*) as purged from (select *, row_number() over (partition by key order by lsn desc) rn from oplog where file_id<8) t
where rn=1 and is_tombstone
""",
    "table_stats": """
select file_id, min(key) as min_key, max(key) as max_key, min(lsn) as first_seq, max(lsn) as last_seq, count(distinct key) as
entries, cast(sum(4+length(key)+8+1+4+coalesce(length(value),0)) as bigint) as raw_bytes from oplog group by file_id
""",
    "wal_bytes": """
select file_id, cast(sum(4+8+4+length(key)+1+4+coalesce(length(value),0)) as bigint) as wal_bytes, count(*) as ops, max(lsn)+1 as
next_lsn from oplog group by file_id
""",
    "batch_lww": """
select batch_id, key, value, is_tombstone from (select *, row_number() over (partition by batch_id,key order by op_idx desc) rn
from oplog) t where rn=1
""",
    "raft_apply": """
select 'data:' || key as key, value from (select *, row_number() over (partition by key order by idx desc) rn from rlog where
kind<>'BLANK') t where rn=1 and kind='PUT'
""",
    "raft_last": """
select term, idx from rlog order by idx desc limit 1
""",
    "raft_truncate": """
select idx,term,kind from rlog where idx < 12000
""",
    "raft_purge": """
select idx,term,kind from rlog where idx > 3000
""",
    "read_amp": """
select key, count(distinct file_id) as tables_holding from oplog group by key
""",
    "version_count": """
select key, count(*) as versions, cast(sum(case when is_tombstone then 1 else 0 end) as bigint) as tombstones from oplog group by
key
""",
    "scan_flat": """
select pos, item from (select 2*(row_number() over (order by key))-2 as pos, key as item from live union all select
2*(row_number() over (order by key))-1, value from live) t
""",
    "raft_range": """
select idx, 'log:' || lpad(cast(idx as varchar(20)),20,'0') as log_key, term, kind from rlog where idx between 100 and 199
""",
    "raft_snapshot": """
select v.key, v.value, c.cnt from (select 'data:'||key as key, value from (select * from (select *, row_number() over (partition
by key order by idx desc) rn from (select * from rlog where kind<>'BLANK' and idx<=10000) r) z where rn=1) w where kind='PUT') v
cross join (select count(*) as cnt from (select * from (select *, row_number() over (partition by key order by idx desc) rn from
(select * from rlog where kind<>'BLANK' and idx<=10000) r) z where rn=1) w where kind='PUT') c
""",
    "level_get": """
select key, value, lsn from (select * from (select *, row_number() over (partition by key order by file_id desc, lsn desc) rn from
oplog) z where rn=1) w where not is_tombstone
""",
    "manifest_replay": """
select level,id from (select level,id from (select *, row_number() over (partition by level,id order by seq desc) rn from (select
3*file_id as seq, 'ADD' as event, 0 as level, file_id as id from (select distinct file_id from oplog) f union all select
100+3*file_id, 'RM', 0, file_id from (select distinct file_id from oplog where file_id<4) f union all select 101+3*file_id, 'ADD',
1, 100+file_id from (select distinct file_id from oplog where file_id<4) f) m) x where rn=1 and event='ADD') a
""",
    "startup_gc": """
select d.id from (select distinct file_id as id from oplog union all select 100+file_id from (select distinct file_id from oplog)
f union all select 999) d left join (select level,id from (select *, row_number() over (partition by level,id order by seq desc)
rn from (select 3*file_id as seq, 'ADD' as event, 0 as level, file_id as id from (select distinct file_id from oplog) f union all
select 100+3*file_id, 'RM', 0, file_id from (select distinct file_id from oplog where file_id<4) f union all select 101+3*file_id,
'ADD', 1, 100+file_id from (select distinct file_id from oplog where file_id<4) f) m) x where rn=1 and event='ADD') a on d.id=a.id
where a.id is null
""",
    "wal_replay": """
select key, value, lsn from (select * from (select *, row_number() over (partition by key order by lsn desc) rn from (select
key,value,is_tombstone,lsn from oplog where file_id>=8 union all select key,value,is_tombstone,lsn from (select * from (select *,
row_number() over (partition by file_id,key order by lsn desc) rn from oplog) z where rn=1) g where file_id<8) u) z where rn=1) w
where not is_tombstone
""",
    "wal_torn": """
select lsn,key,file_id from (select *, max(case when lsn%1000=700 then 1 else 0 end) over (partition by file_id order by lsn rows
between unbounded preceding and current row) as bad from oplog) t where bad=0
""",
    "bloom_probe": """
select p.key from (select 'user:' || lpad(cast(c_custkey as varchar(20)),6,'0') as key from customer) p left join (select distinct
key from oplog) k on p.key=k.key where k.key is null
""",
    "saturation": """
select file_id, l0, case when l0>=4 then true else false end as saturated from (select file_id, count(*) over (order by file_id
rows between unbounded preceding and current row) as l0 from (select distinct file_id from oplog) f) t
""",
    "convergence": """
select key from (select r, key, value from (select *, row_number() over (partition by r, key order by lsn desc) rn from oplog join
(select 1 as r, 9000 as upto union all select 2, 9500 union all select 3, 1000000000000) p on lsn < upto) t where rn=1 and not
is_tombstone) v group by key having count(*) < 3 or count(distinct value) > 1
""",
    "commit_index": """
select term, m as committed from (select term, m, row_number() over (partition by term order by m desc) rn from (select term,
max(idx) as m from rlog group by term union all select term, max(idx)-3 from rlog group by term union all select term, max(idx)-50
from rlog group by term) t) z where rn=2
""",
    "metrics": """
select count(*) as total_ops, cast(sum(case when is_tombstone then 0 else 1 end) as bigint) as puts, cast(sum(case when
is_tombstone then 1 else 0 end) as bigint) as deletes, cast(sum(21+length(key)+coalesce(length(value),0)) as bigint) as wal_bytes
from oplog
""",
    "resp_encode": """
select lsn, '*3' || chr(13)||chr(10) || '$3' || chr(13)||chr(10)||'SET'||chr(13)||chr(10)||'$'||cast(octet_length(encode(key)) as
varchar(20))||chr(13)||chr(10)||key||chr(13)||chr(10)||'$'||cast(octet_length(encode(value)) as
varchar(20))||chr(13)||chr(10)||value||chr(13)||chr(10) as wire from oplog where not is_tombstone
""",
    "raft_install": """
select * from (select distinct 'meta:' || kind as key, cast(null as varchar) as value from rlog) m union all select key, value
from (select v.key, v.value, c.cnt from (select 'data:'||key as key, value from (select * from (select *, row_number() over
(partition by key order by idx desc) rn from (select * from rlog where kind<>'BLANK' and idx<=10000) r) z where rn=1) w where
kind='PUT') v cross join (select count(*) as cnt from (select * from (select *, row_number() over (partition by key order by idx
desc) rn from (select * from rlog where kind<>'BLANK' and idx<=10000) r) z where rn=1) w where kind='PUT') c) s
""",
    "raft_wiped": """
select 'data:' || o.key as key from (select * from (select *, row_number() over (partition by key order by idx desc) rn from rlog
where kind<>'BLANK') z where rn=1 and kind='PUT') o left join (select * from (select *, row_number() over (partition by key order
by idx desc) rn from rlog where kind<>'BLANK' and idx<=10000) z where rn=1 and kind='PUT') s on o.key=s.key where s.key is null
""",
    "raft_responses": """
select idx, case when kind='BLANK' then '' when value is null then kind || ' ' || key else kind || ' ' || key || ' ' || value end
as reply from rlog
""",
    "keys_only_scan": """
select key from live
""",
    "resp_dispatch": """
select lsn, case lsn % 70 when 6 then '+PONG' when 13 then '-ERR unknown command or invalid format'
when 20 then '-ERR wrong number of arguments for ''set'' command' when 27 then '-ERR unknown command ''NOPE'''
when 34 then '-ERR wrong number of arguments for ''del'' command' when 41 then '-ERR invalid value'
when 48 then '-ERR usage: SCAN start_key end_key' when 55 then '-ERR unknown command or invalid format' when 62 then '+PONG'
else case when is_tombstone then ':1' else '+OK' end end as reply from oplog
""",
    "resp_roundtrip": """
select lsn, key, value from oplog where not is_tombstone
""",
    "stream_lww": """
select key, value, lsn from (select *, row_number() over (partition by key order by lsn desc) rn from oplog) t where rn=1 and not
is_tombstone
""",
    "stream_stateful_lww": """
select key, value, lsn from (select *, row_number() over (partition by key order by lsn desc) rn from oplog) t where rn=1 and not
is_tombstone
""",
    "store_live": """
select key, value, lsn from (select *, row_number() over (partition by key order by lsn desc) rn from oplog) t where rn=1 and not
is_tombstone
""",
    "wal_crc": """
select count(*) as records, 0 as bad from oplog
""",
    "manifest_watermark": """
select cast(8 as bigint) as wal_id, cast(max(104) as bigint) as next_id from (select 1) z
""",
    "compaction_pick": """
select level, id from (select 0 as level, cast(file_id as bigint) as id from (select distinct file_id from oplog where file_id>=4)
f union all select 1, cast(100+file_id as bigint) from (select distinct file_id from oplog where file_id<4) g) x
""",
    "leader_count": """
select term, count(distinct n) as leaders from (select term, case when term = 3 and idx % 1000 = 7 then 5 else term % 3 end as n,
idx % 2 = 1 as l from rlog) z where l group by term
""",
    "fault_actions": """
select m.seq, coalesce(bool_or(kind = 'partition' or kind = 'drop' and u < p), false) as dropped,
coalesce(bool_or(kind = 'duplicate' and u < p), false) as duplicated, arg_max(case kind when 'delay' then lo when 'random_delay' then lo +
cast(floor(u * (hi - lo)) as bigint) end, case when kind in ('delay', 'random_delay') then rule end) as delay_ms
from (select lsn as seq, lsn % 5 as src, (lsn // 5) % 5 as dst from oplog) m left join (values (1, 'partition', 0, 1, null, null, null),
(2, 'delay', 1, 2, null, 40, null), (3, 'random_delay', 1, 2, null, 10, 30), (4, 'drop', 2, 3, 0.25, null, null), (5, 'duplicate', 2, 3,
0.5, null, null), (6, 'delay', 3, 4, null, 7, null)) r(rule, kind, a, b, p, lo, hi) on src = a and dst = b or kind = 'partition' and
src = b and dst = a cross join lateral (select ((m.seq * 1103515245 + rule * 12345 + 11) % 2147483648) / 2147483648.0 as u) d group by m.seq
""",
    "block_index": """
recursive e as (select file_id, key, 17 + length(key) + coalesce(length(value), 0) as size, row_number() over (partition by file_id order
by key) as i from (select *, row_number() over (partition by file_id, key order by lsn desc) rn from oplog) t where rn=1),
p as (select file_id, i, key, size, 0 as block, size as used from e where i=1 union all select e.file_id, e.i, e.key, e.size, case when
p.used + e.size > 4096 then p.block + 1 else p.block end, case when p.used + e.size > 4096 then e.size else p.used + e.size end from p join
e on e.file_id=p.file_id and e.i=p.i+1)
select file_id, cast(block as int) as block, min(key) as first_key, count(*) as entries, cast(sum(size) as bigint) as raw_bytes from p
group by file_id, block
""",
}


def _sql(body: str) -> str:
    views = f"oplog as ({OPLOG}), rlog as ({RLOG}), live as ({LIVE})"
    body = body.strip()
    if body.startswith("recursive "):  # more views
        return f"with recursive {views}, {body.removeprefix('recursive ')}"
    return f"with {views}\n{body}"


ORACLES = {name: _sql(body) for name, body in BODIES.items()}
