"""Independent SQL for the catalogue's queries, as DuckDB runs it over the same tables."""

from __future__ import annotations

# relations --------------------------------------------------------------------
LOG = """log as (
  select event_id + 1 as pos, 'user:' || cast(user_id as varchar) as key,
         case when event_type = 'error' then 'DELETE' else 'PUT' end as op,
         case when event_type = 'error' then '' else props end as value from events),
prevs as (select *, lag(op) over (partition by key order by pos) as prev from log),
eff as (select pos, key, op, value, row_number() over (order by pos) as seq from prevs where op = 'PUT' or prev = 'PUT'),
ent as (select pos, key, value, seq, op = 'DELETE' as deleted, cast(floor((seq - 1) / 500.0) as bigint) as generation from eff),
latest as (select key, value, seq, deleted from (select *, row_number() over (partition by key order by seq desc) as r from ent) where r = 1)"""
L0 = (
    LOG
    + """,
l0 as (select generation, key, value, seq, deleted from (select *, row_number() over (partition by generation, key order by seq desc) as r from ent) where r = 1),
cat as (select *, 'sstable-L0-f' || lpad(cast(generation + 1 as varchar), 20, '0') || '-g' || lpad(cast(generation as varchar), 20, '0') || '-s' || lpad(cast(max_seq as varchar), 20, '0') || '.sst' as path
  from (select generation, count(*) as entry_count, cast(count(*) filter (deleted) as bigint) as tombstones, min(seq) as min_seq, max(seq) as max_seq,
               min(key) as smallest_key, max(key) as largest_key from l0 group by generation)),
probes as (select 'user:' || cast(c_custkey as varchar) as key from customer)"""
)
LEVEL1 = """,
l1 as (select cast(floor(cast(substr(key, 6, 1) as bigint) / 2.0) as bigint) as generation, key, value, seq, deleted
  from (select *, row_number() over (partition by key order by seq desc) as r from l0 where generation <= (select max(generation) from l0) - 4) where r = 1 and not deleted),
cat1 as (select generation, count(*) as n, min(key) as smallest_key, max(key) as largest_key from l1 group by generation)"""
def asked(p: float) -> str:
    """Filters of a false-positive rate and their answers for the keys of the table before."""
    return f""",
sized as (select generation, cast(ceil(m / 64.0) * 64 as bigint) as bits, cast(least(greatest(round(m / entry_count * ln(2)), 1), 32) as bigint) as hashes
  from (select *, greatest(ceil(-entry_count * ln({p}) / (ln(2) * ln(2))), 64) as m from cat)),
h as (select generation, key, cast('0x' || substr(md5(key), 1, 13) as bigint) as h1, cast('0x' || substr(md5(key), 14, 13) as bigint) as h2 from l0),
bit as (select distinct sized.generation, (h1 + i * h2) % bits as b from h join sized using (generation), range(32) as r(i) where i < hashes),
need as (select distinct sized.generation, key, (h1 + i * h2) % bits as b from h join sized on sized.generation = h.generation + 1, range(32) as r(i) where i < hashes),
answer as (select need.generation, need.key, bool_and(bit.b is not null) as may_contain from need left join bit on bit.generation = need.generation and bit.b = need.b group by need.generation, need.key)"""


PICK = """,
pick as (select generation, path from cat order by max_seq, generation limit 4)"""


def merged(selected: str) -> str:
    return f""",
m as (select key, value, seq, deleted from (select *, row_number() over (partition by key order by seq desc, generation) as r
  from l0 where generation in (select generation from {selected})) where r = 1),
outside as (select key, min(seq) as oldest from l0 where not deleted and generation not in (select generation from {selected}) group by key),
judged as (select m.key, m.seq, not (oldest is not null and oldest <= m.seq) as droppable from m left join outside using (key) where m.deleted),
out as (select m.key, value, m.seq, deleted from m left join judged using (key) where not coalesce(droppable, false))"""


def at(n: int) -> str:
    return f"event_id % {n} = {n - 1}"


RAW = f"""raw as (select *, 16 + key_size + value_size + 4 as needed,
    case when event_id % 877 = 876 then 10 when event_id % 1009 = 1008 then 16 + key_size + value_size + 1 else 16 + key_size + value_size + 4 end as available
  from (select event_id, event_id + 1 as pos, 'user:' || cast(user_id as varchar) as key,
    case when event_type = 'error' then '' else coalesce(props, '') end as value,
    not ({at(9973)}) as readable, not ({at(1213)}) as magic_ok,
    case when {at(1301)} then 2 else 1 end as version,
    case when {at(1409)} then 7 when event_type = 'error' then 2 else 1 end as operation,
    case when {at(1511)} then 1 else 0 end as reserved,
    cast(case when {at(1607)} then 0 else strlen('user:' || cast(user_id as varchar)) end as bigint) as key_size,
    cast(case when event_type = 'error' and event_id % 331 = 7 then 5 when event_type = 'error' then 0 else strlen(coalesce(props, '')) end as bigint) as value_size,
    not ({at(1709)}) as checksum_ok from events)),
coded as (select *, case when not readable then 'IO_ERROR' when available < 16 then 'INCOMPLETE_RECORD' when not magic_ok then 'INVALID_MAGIC'
    when version <> 1 then 'UNSUPPORTED_VERSION' when operation not in (1, 2) then 'INVALID_OPERATION'
    when reserved <> 0 or key_size = 0 or key_size > 1024 or value_size > 1048576 then 'INVALID_LENGTH'
    when operation = 2 and value_size > 0 then 'DELETE_WITH_VALUE' when available < needed then 'INCOMPLETE_RECORD'
    when not checksum_ok then 'CHECKSUM_MISMATCH' else 'NONE' end as code from raw),
good as (select * from coded where pos < coalesce((select min(pos) from coded where code <> 'NONE'), 9223372036854775807))"""
BATCHES = """b as (select l_orderkey as batch_id, l_linenumber as ordinal, case when l_partkey % 50 = 0 then '' else 'part:' || cast(l_partkey as varchar) end as key,
  l_returnflag || '|' || l_linestatus || '|' || cast(l_suppkey as varchar) as value from lineitem),
checked as (select batch_id, count(*) as entries, cast(sum(strlen(key) + strlen(value)) as bigint) as bytes, count(*) filter (key = '') as invalid from b group by batch_id),
judged as (select batch_id, entries, bytes, case when entries > 6 then 'BATCH_TOO_MANY' when bytes > 80 then 'BATCH_TOO_LARGE' when invalid > 0 then 'INVALID_ENTRY' else 'OK' end as status from checked)"""
RAFT = """lead_log as (select event_id + 1 as index, 1 + cast(floor(event_id / 1000.0) as bigint) as term,
  case when event_id % 1000 = 0 then 'NOOP' when event_type = 'error' then 'DELETE' else 'PUT' end as type,
  'user:' || cast(user_id as varchar) as key, case when event_type = 'error' then '' else props end as value from events),
n as (select count(*) as n from events),
follow as (select index, term + case when index > n * 6 // 10 then 1 else 0 end as term, type, key,
  case when index > n * 6 // 10 then 'lost:' || value else value end as value from lead_log, n where index <= n * 9 // 10)"""
POSITIONS = """p as (select l_orderkey as cell, l_partkey % 100 + 1 as match_index, cast(floor((l_partkey % 100 + 1) / 25.0) as bigint) as entry_term,
  l_orderkey % 4 as current_term, l_orderkey % 30 as committed from lineitem)"""
VOTES = """v as (select o_orderkey as voter, o_custkey % 5 + 1 as term, 'node-' || cast(o_orderkey % 3 as varchar) as candidate, o_custkey % 4 as last_term, o_orderkey % 100 as last_index,
  o_orderkey % 5 + 1 as own_term, case when o_orderkey % 4 > 0 then 'node-' || cast(o_orderkey % 4 - 1 as varchar) end as voted_for, o_orderkey % 4 as own_last_term, o_custkey % 100 as own_last_index from orders),
g as (select voter, term, candidate, term >= own_term and (term > own_term or voted_for is null or voted_for = candidate)
  and (last_term > own_last_term or (last_term = own_last_term and last_index >= own_last_index)) as granted from v)"""
HIST = """h as (select event_type as name, count(*) as count, cast(sum(cast(value as decimal(20,6))) as double) as sum,
  quantile_cont(value, 0.5) as p50, quantile_cont(value, 0.95) as p95, quantile_cont(value, 0.99) as p99 from events group by event_type)"""


def state_sql(upto: str) -> str:
    return f"(select key, value, index, type from (select *, row_number() over (partition by key order by index desc) as r from lead_log where type <> 'NOOP' and index <= {upto}) where r = 1 and type <> 'DELETE')"


WITH = lambda *parts: "with " + ",\n".join(parts) + "\n"

SQL: dict[str, str] = {
    "latest_state": WITH(LOG) + "select key, value, seq from latest where not deleted",
    "point_get": WITH(LOG) + "select 'user:7' as key, count(*) > 0 as found, max(value) as value from latest where key = 'user:7' and not deleted",
    "multi_get": WITH(L0) + "select key, case when seq is null then 'MISSING' when deleted then 'TOMBSTONE' else 'VALUE' end as state, case when not deleted then value end as value, seq from probes left join latest using (key)",
    "exists_keys": WITH(L0) + "select key from probes where key in (select key from latest where not deleted)",
    "tombstones": WITH(LOG) + "select key, seq from latest where deleted",
    "live_count": WITH(LOG) + "select count(*) filter (not deleted) as live_keys, count(*) filter (deleted) as deleted_keys, count(*) as all_keys from latest",
    "version_history": WITH(LOG) + "select key, seq, lead(seq) over (partition by key order by seq) as valid_to, deleted from ent",
    "state_as_of": WITH(LOG) + "select key, value, seq from (select *, row_number() over (partition by key order by seq desc) as r from ent where seq <= 700) where r = 1 and not deleted",
    "key_ordered_snapshot": WITH(LOG) + "select key, value, seq, deleted from latest order by key",
    "orders_state": """with log as (select row_number() over (order by o_orderdate, o_orderkey) as pos, 'cust:' || cast(o_custkey as varchar) as key,
  case when o_orderstatus = 'F' then 'DELETE' else 'PUT' end as op, case when o_orderstatus = 'F' then '' else cast(o_orderkey as varchar) || '|' || o_orderpriority end as value from orders),
prevs as (select *, lag(op) over (partition by key order by pos) as prev from log),
eff as (select *, row_number() over (order by pos) as seq from prevs where op = 'PUT' or prev = 'PUT')
select key, value, seq from (select *, row_number() over (partition by key order by seq desc) as r from eff) where r = 1 and op = 'PUT'""",
    "memory_put_remove": WITH(L0) + """select key, value from (select key, 'put' as value from probes union all select key, value from latest where not deleted and key not in (select key from probes))
where key not in (select 'user:' || cast(c_custkey as varchar) from customer where c_custkey % 2 = 0)""",
    "effective_mutations": WITH(LOG) + "select pos, key, op, value, seq from eff",
    "sequence_assign": WITH(LOG) + "select pos, seq from eff",
    "noop_deletes": WITH(LOG) + "select pos, key from prevs where op = 'DELETE' and coalesce(prev, '') <> 'PUT'",
    "cluster_deletes": WITH(LOG) + "select pos, key, coalesce(prev, '') = 'PUT' as existed from prevs where op = 'DELETE'",
    "live_timeline": WITH(LOG) + """select pos, delta, cast(sum(delta) over (order by pos) as bigint) as live from (select pos, cast(case when op = 'PUT' and coalesce(prev, 'DELETE') <> 'PUT' then 1
  when op = 'DELETE' and prev = 'PUT' then -1 else 0 end as bigint) as delta from prevs)""",
    "sequence_violations": """select pos, key, seq from (select event_id + 1 as pos, event_type as key, user_id as seq,
  lag(user_id) over (partition by event_type order by event_id) as before from events) where seq <= coalesce(before, 0)""",
    "wal_issue_classify": WITH(RAW) + "select pos, code from coded",
    "wal_valid_prefix": WITH(RAW) + "select pos, key, operation, needed from good",
    "recovery_report": WITH(RAW) + """select count(*) as records_applied, count(*) filter (operation = 1) as puts_applied, count(*) filter (operation = 2) as deletes_applied,
  cast(coalesce(sum(needed), 0) as bigint) as valid_bytes, (select count(*) > 0 from coded where code <> 'NONE') as tail_truncated,
  coalesce((select code from coded where code <> 'NONE' order by pos limit 1), 'NONE') as issue from good""",
    "recovery_replay": WITH(RAW) + """select pos, key, op, value, 1000 + row_number() over (order by pos) as seq from (select *, lag(op) over (partition by key order by pos) as prev
  from (select pos, key, value, case when operation = 1 then 'PUT' else 'DELETE' end as op from good)) where op = 'PUT' or prev = 'PUT'""",
    "validate_keys_values": """select doc_id, k as key_code, case when strlen(text) > 4096 then 'VALUE_TOO_LONG' else 'OK' end as value_code,
  case when k = 'OK' then 'OK' else 'INVALID_ARGUMENT' end as error from (select *, case when coalesce(strlen(text), 0) = 0 then 'EMPTY_KEY' when strlen(text) > 1024 then 'KEY_TOO_LONG' else 'OK' end as k from documents)""",
    "command_validity": WITH(RAFT) + """select index, type, case when type = 'NOOP' or type = 'PUT' or coalesce(strlen(value), 0) = 0 then 'OK' else 'INVALID_COMMAND' end as code
from (select index, type, case when index % 7 = 0 then 'x' else value end as value from lead_log)""",
    "batch_validation": WITH(BATCHES) + "select * from judged",
    "batch_accepted": WITH(BATCHES) + "select b.* from b join judged using (batch_id) where status = 'OK'",
    "batch_applied_prefix": WITH(BATCHES) + "select batch_id, ordinal, key from b where not exists (select 1 from b as f where f.batch_id = b.batch_id and f.key = '' and f.ordinal <= b.ordinal)",
    "memtable_stats": WITH(L0) + "select generation, count(*) as entries, count(*) filter (not deleted) as live_entries, cast(sum(104 + strlen(key) + case when deleted then 0 else strlen(value) end) as bigint) as approximate_bytes from l0 group by generation",
    "flush_catalog": WITH(L0) + "select * from cat",
    "table_order": WITH(L0) + "select row_number() over (order by max_seq desc, generation desc, path desc) as rank, generation, max_seq from cat",
    "global_counters": WITH(L0) + "select coalesce(max(max_seq), 0) as max_seq, coalesce(max(generation), -1) + 1 as next_generation, count(*) as tables from cat",
    "block_index": """with recursive """ + L0 + """,
r as (select generation, key, 20 + strlen(key) + case when deleted then 0 else strlen(value) end as size, row_number() over (partition by generation order by key) as i from l0),
fold as (select generation, i, key, cast(0 as bigint) as block, cast(16 + size as bigint) as used from r where i = 1
  union all select r.generation, r.i, r.key, case when f.used + size > 1024 then f.block + 1 else f.block end, case when f.used + size > 1024 then 16 + size else f.used + size end
  from fold f join r on r.generation = f.generation and r.i = f.i + 1),
blocks as (select generation, block, min(key) as first_key, max(key) as last_key, max(used) as block_size, count(*) as entries from fold group by generation, block)
select generation, block, first_key, last_key, cast(coalesce(sum(block_size) over (partition by generation order by block rows between unbounded preceding and 1 preceding), 0) as bigint) as block_offset, block_size, entries from blocks""",
    "unsorted_rows": WITH(LOG) + "select generation, seq, key from (select *, lag(key) over (partition by generation order by seq) as before from ent) where before is not null and key <= before",
    "read_merge": WITH(LOG) + "select key, value, seq, case when seq > 500 * (select max(generation) from ent) then 'memory' else 'table' end as source from latest where not deleted",
    "range_prune_counts": WITH(L0) + "select key, cast(count(generation) as bigint) as covering, cast((select count(*) from cat) - count(generation) as bigint) as pruned from probes left join cat on key between smallest_key and largest_key group by key",
    "bloom_sizing": WITH(L0) + """select generation, entry_count, cast(ceil(m / 64.0) * 64 as bigint) as bits, cast(least(greatest(round(m / entry_count * ln(2)), 1), 32) as bigint) as hashes
from (select *, greatest(ceil(-entry_count * ln(0.01) / (ln(2) * ln(2))), 64) as m from cat)""",
    "bloom_negatives_exact": WITH(L0) + """select cat.generation, cast(count(probes.key) as bigint) as checks, cast(count(probes.key) filter (not exists (select 1 from l0 where l0.generation = cat.generation and l0.key = probes.key)) as bigint) as negatives
from cat left join probes on probes.key between smallest_key and largest_key group by cat.generation""",
    "bloom_totals": WITH(L0) + """select count(*) as filters, cast(sum(entry_count) as bigint) as keys, cast(sum(ceil(greatest(ceil(-entry_count * ln(0.01) / (ln(2) * ln(2))), 64) / 64.0) * 8) as bigint) as bytes,
  cast((select count(*) from cat c join probes p on p.key between c.smallest_key and c.largest_key) as bigint) as checks,
  cast((select count(*) from cat c join probes p on p.key between c.smallest_key and c.largest_key where not exists (select 1 from l0 where l0.generation = c.generation and l0.key = p.key)) as bigint) as negatives from cat""",
    "bloom_may_contain": WITH(L0 + asked(0.01)) + "select * from answer",
    "bloom_false_positives": WITH(L0 + asked(0.3)) + """select generation, count(*) as checks, count(*) filter (not may_contain) as negatives,
  count(*) filter (may_contain and not exists (select 1 from l0 where l0.generation = answer.generation and l0.key = answer.key)) as false_positives from answer group by generation""",
    "table_write_faults": WITH(LOG) + """select key, case when min(seq) - 1 < 1 then 'BAD_SEQUENCE' else 'DUPLICATE' end as fault from ent group by key having count(*) > 1 or min(seq) < 2
union all select null, 'EMPTY' where not exists (select 1 from ent)""",
    "cache_ratio": """select user_id, hits, misses, case when hits + misses = 0 then 0.0 else cast(hits as double) / (hits + misses) end as ratio
from (select user_id, count(*) filter (event_type = 'view') as hits, count(*) filter (event_type = 'click') as misses from events group by user_id)""",
    "l0_select": WITH(L0) + "select generation, max_seq from cat order by max_seq, generation limit 4",
    "l1_overlap": "with recursive " + L0 + LEVEL1 + """,
reach as (select min(smallest_key) as low, max(largest_key) as high from cat where generation > (select max(generation) from cat) - 4
  union select least(r.low, c.smallest_key), greatest(r.high, c.largest_key) from reach r join cat1 c on c.smallest_key <= r.high and c.largest_key >= r.low)
select distinct generation, smallest_key, largest_key from cat1 join reach on smallest_key <= high and largest_key >= low""",
    "l1_violations": WITH(L0) + "select generation, smallest_key, previous_largest from (select *, lag(largest_key) over (order by smallest_key, generation) as previous_largest from cat) where previous_largest >= smallest_key",
    "level_counts": WITH(L0 + LEVEL1) + "select cast(0 as bigint) as level, count(*) as tables, count(*) >= 4 as due from cat having count(*) > 0 union all select 1, count(*), false from cat1 having count(*) > 0",
    "compact_l0": WITH(L0 + PICK + merged("pick")) + "select * from out",
    "compaction_counters": WITH(L0 + PICK + merged("pick")) + """select (select count(*) from pick) as input_tables, cast((select count(*) > 0 from out) as bigint) as output_tables,
  (select count(*) from l0 where generation in (select generation from pick)) as input_entries, (select count(*) from out) as output_entries, (select count(*) from judged where droppable) as tombstones_dropped""",
    "tombstone_drop": WITH(L0 + ",\nchosen as (select generation from cat where generation % 2 = 1)" + merged("chosen")) + "select key, seq, droppable from judged",
    "flush_live_delta": WITH(L0) + """select generation, cast(sum(case when not deleted and coalesce(before, true) then 1 when deleted and not before then -1 else 0 end) as bigint) as live_delta
from (select *, lag(deleted) over (partition by key order by generation) as before from l0) group by generation""",
    "manifest_diff": WITH(L0 + PICK + merged("pick")) + """select path, case when path in (select path from pick) then 'REMOVED' else 'KEPT' end as status from cat
union all select 'sstable-L1-f' || lpad('4', 20, '0') || '-g' || lpad('3', 20, '0') || '-s' || lpad(cast(max(seq) as varchar), 20, '0') || '.sst', 'ADDED' from out having count(*) > 0""",
    "orphan_files": WITH(L0) + "select path from cat where generation % 3 = 0",
    "metadata_mismatch": WITH(L0) + "select path from cat where generation = 2 or generation % 5 = 0",
    "stale_compaction_inputs": WITH(L0 + PICK) + "select path from pick where generation = 1",
    "vote_grant": WITH(VOTES) + "select * from g",
    "vote_tally": WITH(VOTES) + "select term, candidate, cast(count(*) filter (granted) + 1 as bigint) as votes, count(*) filter (granted) + 1 >= 51 as won from g group by term, candidate",
    "commit_index": WITH(POSITIONS) + """select cell, case when m.match_index > committed and m.entry_term = current_term then m.match_index else committed end as commit_index
from (select cell, list_sort(list({'match_index': match_index, 'entry_term': entry_term}))[count(*) - (count(*) // 2 + 1) + 1] as m, max(current_term) as current_term, max(committed) as committed from p group by cell)""",
    "read_barrier": WITH(POSITIONS) + "select cell, count(*) filter (match_index % 3 <> 0) >= count(*) // 2 + 1 and max(entry_term) = max(current_term) as readable from p group by cell",
    "replication_lag": WITH(POSITIONS) + "select cell as node, max(match_index) - min(match_index) as lag from p group by cell",
    "log_conflict_repair": WITH(RAFT) + """, c as (select min(f.index) as c from follow f join lead_log l on f.index = l.index where f.term <> l.term),
kept as (select follow.* from follow, c where c is null or index < c)
select index, term, type, value from kept union all select index, term, type, value from lead_log where index not in (select index from kept)""",
    "conflict_backoff": WITH(RAFT) + """, h as (select term as conflict_term, index as i from follow, n where index = n * 8 // 10)
select conflict_term, cast(greatest(coalesce((select max(index) + 1 from follow where index < i and term <> conflict_term), (select min(index) from follow where index > 100)), 101) as bigint) as conflict_index from h""",
    "append_batch": WITH(RAFT) + "select index, term, type, key from lead_log where index >= 900 order by index limit 128",
    "log_gaps": WITH(RAFT) + "select 'node-1' as node, index, before from (select index, lag(index, 1, 0) over (order by index) as before from lead_log where index % 97 <> 0) where index <> before + 1",
    "term_lookup": WITH(RAFT) + """, i as (select unnest([0, 50, 100, 101]) as index union all select n from n union all select n + 1 from n)
select cast(i.index as bigint) as index, case when i.index = 0 then 0 when i.index = 100 then 1 when i.index > 100 then l.term end as term from i left join lead_log l on i.index = l.index""",
    "apply_committed": WITH(RAFT) + "select key, value from " + state_sql("(select n * 3 // 4 from n)"),
    "snapshot_create": WITH(RAFT) + "select (select n // 2 from n) as last_included_index, (select term from lead_log, n where index = n // 2) as last_included_term, key, value from " + state_sql("(select n // 2 from n)"),
    "submit_status": WITH(RAFT) + """select follow.index, follow.type, case when follow.index % 17 = 0 then 'TIMEOUT' when follow.index % 11 = 0 and follow.type <> 'NOOP' then 'INVALID_COMMAND'
  when follow.type = 'DELETE' and follow.value <> '' then 'INVALID_COMMAND' when follow.index % 13 = 0 then 'NOT_LEADER' when follow.index <= n * 4 // 5 then 'COMMITTED'
  when follow.term <> lead_log.term then 'NOT_LEADER' else 'TIMEOUT' end as status from follow join lead_log using (index), n""",
    "replica_log": WITH(RAFT) + """, c as (select min(f.index) as c from follow f join lead_log l on f.index = l.index where f.term <> l.term),
kept as (select follow.* from follow, c where c is null or index < c)
select index, term, type, key, value from kept union all select index, term, type, key, value from lead_log where index not in (select index from kept)""",
    "replica_snapshot": WITH(RAFT) + "select (select n // 2 from n) as last_included_index, (select term from lead_log, n where index = n // 2) as last_included_term, key, value from " + state_sql("(select n // 2 from n)"),
    "recover_from_snapshot": WITH(RAFT) + "select key, value from " + state_sql("(select n * 3 // 4 from n)"),
    "snapshot_install": WITH(RAFT) + "select index, term from lead_log, n where index > n // 2",
    "counters": "select event_type as name, cast(sum(cast(value as decimal(20,6))) as double) as value from events group by event_type",
    "gauges": "select event_type as name, arg_max(value, event_id) as value from events group by event_type",
    "latency_quantiles": WITH(HIST) + "select * from h",
    "histogram_ring": """with s as (select event_id + 1 as i, value from events),
k as (select arg_max(value, i) as value from s group by case when i <= 700 then i - 1 else i % 700 end)
select (select count(*) from s) as count, (select cast(sum(cast(value as decimal(20,6))) as double) from s) as sum, quantile_cont(value, 0.5) as p50, quantile_cont(value, 0.95) as p95, quantile_cont(value, 0.99) as p99 from k""",
    "workload_report": """select count(*) as operations, count(*) filter (event_type in ('view', 'click')) as reads, count(*) filter (event_type not in ('view', 'click')) as writes,
  count(*) / 30.0::double as operations_per_second, count(*) filter (event_type = 'error') / count(*)::double as error_rate,
  quantile_cont(value, 0.5) as p50, quantile_cont(value, 0.95) as p95, quantile_cont(value, 0.99) as p99, max(value) as max from events""",
    "prometheus_text": WITH(HIST) + """, num as (select name, count, cast(cast(sum as decimal(20,6)) as varchar) as sum, cast(cast(p50 as decimal(20,6)) as varchar) as p50, cast(cast(p95 as decimal(20,6)) as varchar) as p95, cast(cast(p99 as decimal(20,6)) as varchar) as p99 from h)
select 0 as section, 'total_' || name as name, 0 as line_no, 'total_' || name || ' ' || sum as line from num
union all select 1, 'last_' || event_type, 0, 'last_' || event_type || ' ' || cast(cast(arg_max(value, event_id) as decimal(20,6)) as varchar) from events group by event_type
union all select 2, name, 0, name || '_count ' || cast(count as varchar) from num union all select 2, name, 1, name || '_sum ' || sum from num
union all select 2, name, 2, name || '{quantile="0.5"} ' || p50 from num union all select 2, name, 3, name || '{quantile="0.95"} ' || p95 from num union all select 2, name, 4, name || '{quantile="0.99"} ' || p99 from num""",
    "json_log": """select '{"timestamp":"' || strftime(ts, '%Y-%m-%dT%H:%M:%SZ') || '","level":"INFO","event":"' || event_type || '","note":"a \\"quoted\\"\\nline of ' || user_id || '","user":"' || user_id || '"}' as line from events""",
    "status_row": WITH(L0) + """select (select count(*) from latest where not deleted) as live_keys, (select coalesce(max(seq), 0) from ent) as last_sequence, count(*) as tables,
  cast(coalesce(sum(entry_count), 0) as bigint) as stored_entries, cast(coalesce(sum(tombstones), 0) as bigint) as stored_tombstones from cat""",
    "stream_state": WITH(LOG) + "select key, value, pos as seq from (select *, row_number() over (partition by key order by pos desc) as r from log) where r = 1 and op = 'PUT'",
    "rotate_by_bytes": """with recursive """ + LOG + """,
w as (select cast(substr(key, 6) as bigint) % 4 as store, key, seq, 104 + strlen(key) + case when deleted then 0 else strlen(value) end as size,
  lag(seq) over (partition by key order by seq) as prev_seq, lag(104 + strlen(key) + case when deleted then 0 else strlen(value) end) over (partition by key order by seq) as prev_size from ent),
fold as (select store, cast(-1 as bigint) as generation, cast(0 as bigint) as first_seq, cast(0 as bigint) as last_seq, cast(0 as bigint) as entries, cast(0 as bigint) as bytes from w group by store
  union all select store, generation, first_seq, last_seq, entries, bytes from (
    select store, generation, min(seq) over (partition by store) as first_seq, seq as last_seq, bytes, entries, row_number() over (partition by store order by case when bytes >= 16384 then 0 else 1 end, case when bytes >= 16384 then seq else -seq end) as pick
    from (select w.store, f.generation + 1 as generation, w.seq,
        cast(sum(w.size - case when w.prev_seq > f.last_seq then w.prev_size else 0 end) over (partition by w.store order by w.seq) as bigint) as bytes,
        cast(sum(case when w.prev_seq > f.last_seq then 0 else 1 end) over (partition by w.store order by w.seq) as bigint) as entries
      from w join fold f on w.store = f.store and w.seq > f.last_seq)) where pick = 1)
select store, generation, first_seq, last_seq, entries, bytes from fold where generation >= 0""",
}


SQL["block_contiguity"] = f"""select generation, block, block_offset, expected from (select *, cast(lag(block_offset + block_size, 1, 0) over (partition by generation order by block) as bigint) as expected
from ({SQL["block_index"]}) where block <> 1) where block_offset <> expected"""
SIZE = lambda n: f"printf('%02x%02x%02x00', {n} % 256, {n} // 256 % 256, {n} // 65536)"
SQL["wal_encode"] = WITH(LOG) + f"""select pos, 20 + k + v as bytes, '57414c310100' || case when op = 'PUT' then '01' else '02' end || '00' || {SIZE("k")} || {SIZE("v")} as header
from (select pos, op, cast(strlen(key) as bigint) as k, cast(strlen(value) as bigint) as v from log)"""


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
