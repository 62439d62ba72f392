"""DuckDB SQL that checks the graph queries."""

from __future__ import annotations

import re

from otflow import constants as C
from otflow.plans.oracles import _BRUTE, _MQ, FLOWS, ORIENTED, P, _GROUP, _GUID, _HOST, _MATCH, _MODBUS, _OBS, _STAGE_EDGES, _STAGES, _UA, _orient, _to_port, policy, svc
from otflow.sources.host_view import MANAGED

_SERVICE = "case when port <= 0 then 'Ephemeral Service' " + " ".join(f"when port = {p} then '{n}'" for p, n in C.SERVICE_NAMES.items()) + " else 'Port ' || port end"
_SIGNAL_GUID = r"'{' || regexp_replace(md5(concat_ws('|', 'ICSSignal', 'modbus', lower(host), '502', unit::varchar, kind, register::varchar)), '^(.{8})(.{4})(.{4})(.{4})(.{12})$', '\1-\2-\3-\4-\5') || '}'"
_SERVICE_GUID = _GUID("'NetworkService'", "host", "greatest(port, 0)")
_MODBUS_GUID = _GUID("'NetworkService'", "host", "502")
_COUNTS = ", ".join(f"count(*) filter (where stage = '{n}') {n}_edges" for n in ("modbus", "http_monitor", "mqtt", "opcua", "collapsed", "individual"))
_FLAGS = " || ".join(f"case when b & {1 << k} <> 0 then '{c}' else '' end" for k, c in enumerate("FSRPAUEC"))

_set = lambda c: f"coalesce(array_to_string(list_sort(list(distinct {c}) filter (where {c} is not null)), ','), '')"

_UNMANAGED = ", ".join(f"'{h}'" for h in sorted(set(C.HOST_NAMES.values()) - set(MANAGED)))
_PROC = """co as (select ori.*, client_ip || '>' || server_ip || ':' || server_port || '/' || protocol edge, confidence, method, guid process_guid from ori join mt using (canonical_id) join an on an.seq = mt.anchor_seq where client_ip is not null and guid is not null),
bq as (select edge, process_guid, count(*) matches, min(client_port) port from co group by 1, 2),
bp as (select edge, process_guid, matches, port from (select *, row_number() over (partition by edge order by matches desc, port, process_guid) r from bq) where r = 1)"""

GRAPH_SQL = {
    "guid_node": f"""with {FLOWS}, n as (select {_HOST('ip')} host, ip, first_us from (select src_ip ip, first_us from fl union all select dst_ip, first_us from fl))
        select host, string_agg(distinct ip, ',' order by ip) addresses, min(first_us) first_us, {_GUID("'NetworkEndpoint'", 'host')} guid from n group by host""",
    "node_dedupe": f"""with {ORIENTED}, s as (select * from ori where client_port > 0 and server_port > 0), c as ({_GROUP.format(source='s')} having count(distinct client_port) >= 2),
        m as (select s.canonical_id from s join c using (client_ip, server_ip, server_port, protocol)),
        ed as (select client_ip, server_ip, server_port, protocol, first_us from c where {policy('0', 'server_port', 'client_ip', 'server_ip')} union all
          select coalesce(client_ip, src_ip), coalesce(server_ip, dst_ip), coalesce(server_port, dst_port), protocol, first_us from ori where canonical_id not in (select canonical_id from m) and {policy()}),
        r as (select {_HOST('server_ip')} host, server_port port, upper(protocol) protocol, server_ip ip, first_us, client_ip from ed)
        select {_SERVICE_GUID} guid, host, port, protocol, {_SERVICE} service_name, ip from (select *, row_number() over (partition by host, port order by first_us, ip, client_ip) r from r) where r = 1""",
    "guid_signal": f"""with {_OBS}, h as (select *, {_HOST('server_ip')} host from obs)
        select {_SIGNAL_GUID} guid, concat_ws('|', 'modbus', lower(host), '502', unit::varchar, kind, register::varchar) signal_key, count(*) samples from h group by 1, 2""",
    "read_write_edges": f"""with {_OBS}, h as (select *, {_HOST('server_ip')} host, {_HOST('client_ip')} source from obs)
        select source, {_SIGNAL_GUID} target, case when access = 'read' then 'READ_SIGNAL' else 'WRITE_SIGNAL' end as type, count(*) n, max(ts_us) last_us from h group by 1, 2, 3""",
    "edge_staging_merge": f"""with {_MATCH}, st as (select {_HOST('client_ip')} src, {_HOST('server_ip')} host, server_port port, packets, bytes, first_us, last_us, canonical_id in (select canonical_id from mt) correlated, first_index, client_port, protocol
          from ori where client_ip is not null),
        g as (select src, host, port, sum(packets)::bigint packets, sum(bytes)::bigint bytes, count(*) flows, min(first_us) first_us, max(last_us) last_us, bool_or(correlated) correlated, count(distinct client_port) unique_ports,
          min(client_port) port_min, max(client_port) port_max, array_to_string(list_sort(list(distinct client_port)), ',') listed, any_value(protocol) protocol from st group by 1, 2, 3)
        select src, {_SERVICE_GUID} dst, 'CONNECT_TO' rel, packets, bytes, flows, first_us, last_us, correlated, {_SERVICE} stage, unique_ports, port_min, port_max,
          case when unique_ports = 1 then port_min::varchar else 'aggregated' end source_port, case when unique_ports between 2 and 8 then listed end port_set, protocol, round(bytes / flows, 2) mean_bytes from g""",
    "summary_before_after": f"""with {_STAGES}, a as ({_STAGE_EDGES}), s as (select count(*) edges, count(distinct (server_ip, server_port)) services, {_COUNTS} from a),
        r as (select count(*) raw_edges, count(distinct (dst_ip, dst_port)) raw_services from fl), q as (select count(distinct ip) raw_endpoints from (select src_ip ip from fl union all select dst_ip from fl))
        select *, raw_edges - edges edges_saved, raw_services - services services_saved from q, r, s""",
    "cypher_text": f"""with {FLOWS}, s as ({_to_port(502, _MODBUS)}), g as ({_GROUP.format(source='s')}),
        r as (select {_HOST('server_ip')} host, server_ip ip, protocol, row_number() over (partition by {_HOST('server_ip')} order by first_us, server_ip, client_ip) r from g)
        select 1 as section, {_MODBUS_GUID} as key, concat('MERGE (n:NetworkService {{guid: ', chr(39), {_MODBUS_GUID}, chr(39), '}})', chr(10), 'ON CREATE SET n += {{host: ', chr(39), host, chr(39), ', port: 502, protocol: ', chr(39), upper(protocol), chr(39),
          ', serviceName: ', chr(39), 'Modbus', chr(39), ', ipAddress: ', chr(39), ip, chr(39), '}}', chr(10), 'SET n.pcapAugmented = true;') as text from r where r = 1""",
    "value_encoding": f"""with {_OBS} select short series, case when sum(value) % 4 = 0 then (sum(value) // 4)::bigint::varchar else printf('%.3f', sum(value)::double / 4) end quarter_text, max(value)::varchar max_text from obs group by 1""",
    "best_process": f"""with {P}, q as (select dst_ip group_id, src_mac process_guid, count(*) matches, min(dst_port) port from p where src_mac <> '' group by 1, 2)
        select group_id, process_guid, matches, port from (select *, row_number() over (partition by group_id order by matches desc, port, process_guid) r from q) where r = 1""",
    "tcp_flag_text": f"""with {P}, b as (select packet_index % 64 b from p) select {_FLAGS} flags, count(*) packets from b group by 1""",
    "flow_stats": f"""with {P}, q as (select *, canonical_id = src_ip || ':' || src_port || '->' || dst_ip || ':' || dst_port || ':' || protocol ahead, case when {svc('dst_port')} then src_port when {svc('src_port')} then dst_port end client_port from p),
        s as (select canonical_id, count(*) packet_count, sum(size)::bigint total_bytes, min(ts_us) first_us, max(ts_us) last_us, arg_min(ahead, o) oa, count(*) filter (where ahead) na,
          {_set('high_level_protocol')} protocols_seen, count(*) filter (where tcp_flags like '%S%') syn_packets, count(*) filter (where tcp_flags like '%F%') fin_packets, count(*) filter (where tcp_flags like '%R%') rst_packets,
          count(*) filter (where payload_len > 0) with_payload, sum(payload_len)::bigint payload_bytes, {_set('modbus_function')} modbus_functions, {_set('modbus_unit_id')} modbus_units,
          {_set('modbus_registers[1]')} modbus_registers, {_set('http_method')} http_methods, {_set('http_host')} http_hosts, {_set('tls_sni')} tls_snis, count(distinct client_port) client_ports, count(distinct pcap_file) files from q group by 1)
        select * exclude (oa, na), case when oa then na else packet_count - na end forward_packets, packet_count - case when oa then na else packet_count - na end reverse_packets,
          round(case when oa then na else packet_count - na end / packet_count, 6) directionality_ratio, round(payload_bytes / nullif(with_payload, 0), 2) mean_payload, (last_us - first_us) / 1e6 duration_s from s""",
    "edge_processes": f"""with {_MATCH}, {_PROC} select edge, process_guid, matches, port from bp""",
    "client_identity": f"""with {_MATCH}, {_PROC}, ed as (select distinct client_ip || '>' || server_ip || ':' || server_port || '/' || protocol edge, client_ip ip from ori where client_ip is not null),
        q as (select edge, {_HOST('ip')} client_host, process_guid, {_HOST('ip')} in ({_UNMANAGED}) loose from ed left join bp using (edge))
        select edge, client_host, coalesce(process_guid, case when loose then {_GUID("'Process'", 'client_host', "'placeholder'")} end) guid, case when process_guid is not null then 1.0::double else 0.5::double end confidence,
          case when process_guid is not null then 'telemetry' else 'placeholder' end kind from q where process_guid is not null or loose""",
    "telemetry_rollup": f"""with {_MATCH}, {_PROC}, k as (select *, {_HOST('server_ip')} host, server_port port from co), g as (select *, {_SERVICE_GUID} service from k),
        m as (select process_guid, service, client_port majority_port from (select process_guid, service, client_port, row_number() over (partition by process_guid, service order by count(*) desc, min(first_index)) r from g group by 1, 2, 3) where r = 1)
        select process_guid, service, count(*) flows, sum(packets)::bigint packets, sum(bytes)::bigint bytes, min(first_us) first_us, max(last_us) last_us, max(confidence) confidence,
          first(method order by confidence desc, first_index) as method, any_value(majority_port) majority_port from g join m using (process_guid, service) group by 1, 2""",
    "ownership_edges": f"""with {FLOWS}, s as ({_to_port(502, _MODBUS)}), n as (select distinct {_HOST('dst_ip')} host from (select case when src_port = 502 and dst_port <> 502 then src_ip else dst_ip end dst_ip from s))
        select {_MODBUS_GUID} src, {_GUID("'NetworkEndpoint'", 'host')} dst, 'LISTENS_ON' rel from n union all select {_GUID("'Process'", 'host', "'placeholder'")}, {_MODBUS_GUID}, 'BINDS' from n where host in ({_UNMANAGED})
        union all select {_GUID("'Process'", 'host', "'placeholder'")}, {_GUID("'NetworkEndpoint'", 'host')}, 'RUN_ON' from n where host in ({_UNMANAGED})""",
    "signal_containers": f"""with {_OBS}, r as (select 'client' as role, client_ip ip, register, unit, access, value, ts_us from obs union all select 'server', server_ip, register, unit, access, value, ts_us from obs), h as (select *, {_HOST('ip')} host from r)
        select role, ip, register, unit, count(*) filter (where access = 'read') reads, count(*) filter (where access = 'write') writes, min(value) min_value, max(value) max_value, min(ts_us) first_us, max(ts_us) last_us,
          {_GUID("'SignalContainer'", 'any_value(host)', 'register', 'unit')} guid from h group by role, ip, register, unit""",
    "completeness": f"""with {_BRUTE}, d as (select case when mt.anchor_seq is null then 'missed' else 'false_positive' end || ':' || coalesce(bf.reason, 'no anchor') as counter from mt full join bf using (canonical_id) where mt.anchor_seq is null or bf.anchor_seq is null)
        select 'flows' as counter, count(*) n from fl union all select 'logged_hosts', count(*) from fl where src_ip in {C.LOGGED_HOSTS} or dst_ip in {C.LOGGED_HOSTS}
        union all select 'service_ports', count(*) from fl where src_port in {C.VERIFIED_PORTS} or dst_port in {C.VERIFIED_PORTS} union all select 'method:' || method, count(*) from mt group by method union all select counter, count(*) from d group by counter""",
    "packet_sample": f"""with {P} select * from (select canonical_id, row_number() over (partition by canonical_id order by o) place, packet_index, ts_us from p) where place <= 3""",
    "asset_scope": f"""with {FLOWS} select canonical_id, src_ip, dst_ip from fl where {_HOST('src_ip')} in ({_UNMANAGED}) or {_HOST('dst_ip')} in ({_UNMANAGED})""",
    "group_incremental": f"""with {FLOWS}, ok as (select * from fl where packets >= 3), s as ({_orient('ok', False)}) {_GROUP.format(source='s')}""",
    "signal_attribution": f"""with {_MATCH}, {_PROC}, {_OBS[_OBS.index('mp as'):]}, q as (select *, client_ip || '>' || server_ip || ':502/tcp' edge, {_HOST('server_ip')} host from obs)
        select process_guid, {_SIGNAL_GUID} signal_guid, access, count(*) n, max(ts_us) last_us from q join bp using (edge) group by 1, 2, 3""",
    "encoded_decode": f"""with {_OBS} select series, value::bigint as value, n from (select series, value, n, row_number() over (partition by series order by o) r from (select short series, value, count(*) n, min(o) o from obs group by 1, 2)) where r <= 4""",
    "traffic_windows": f"""with {P} select ts_us // 3600000000 * 3600000000 start_us, least(src_port, dst_port) port, count(*) packets, sum(size)::bigint bytes from p group by 1, 2""",
    "service_port_inferred": f"with {P} select case when 502 in (src_port, dst_port) then 502 when dst_port < 1024 then dst_port when src_port < 1024 then src_port end port, count(*) packets from p group by 1",
    "guid_running": rf"""with {P}, n as (select distinct unnest([src_ip, dst_ip]) ip from p)
        select ip, regexp_replace(md5('NetworkEndpoint:' || {_HOST('ip')}), '^(.{{8}})(.{{4}})(.{{4}})(.{{4}})(.{{12}})$', '\1-\2-\3-\4-\5') guid from n""",
    "signal_mqtt_encoded": f"""with {_MQ}, q as (select series, round_even(value, 0)::bigint as value, o from sg),
        r as (select series, run, count(*) n from (select *, sum(case when value is distinct from prev then 1 else 0 end) over (partition by series order by o) run from
          (select series, value, o, lag(value) over (partition by series order by o) prev from q)) group by 1, 2),
        b as (select series, bit_count(bit_or(1::ubigint << (case when value = -1 then -2 else value end & 63)::ubigint))::int buckets from q group by 1),
        t as (select series, string_agg(value || ':' || n, ',' order by n desc, value) top_values from (select series, value, n, row_number() over (partition by series order by first) k from
          (select series, value, count(*) n, min(o) first from q group by 1, 2)) where k <= 4 group by 1)
        select series, count(*) runs, round(sum(n) / count(*), 2) ratio, count(*) > 200 truncated, any_value(buckets) buckets, any_value(top_values) top_values from r join b using (series) join t using (series) group by 1""",
}


def _inner(name: str) -> str:
    """The part of a query that builds on matches and processes."""
    return "with " + GRAPH_SQL[name].removeprefix(f"with {_MATCH}, {_PROC}, ")


#: The stages' steps over flows that telemetry doesn't name.
_LEFT_STAGES = re.sub(r"\bfl\b", "flx", _STAGES.removeprefix(FLOWS))

GRAPH_SQL["existing_edges"] = f"""with {_MATCH}, {_PROC}, flx as (select * from fl where canonical_id not in (select canonical_id from mt)){_LEFT_STAGES}, ci as ({_inner('client_identity')}), ru as ({_inner('telemetry_rollup')}),
    ed as (select *, {_HOST('server_ip')} host, server_port port, client_ip || '>' || server_ip || ':' || server_port || '/' || protocol edge from ({_STAGE_EDGES})), st as (select distinct guid src, {_SERVICE_GUID} dst from ed join ci using (edge))
    select process_guid src, service dst, 'CONNECT_TO' rel, flows, packets, bytes, confidence, method, majority_port::varchar source_port from ru where not exists (select 1 from st where st.src = process_guid and st.dst = service)"""

#: Guids of float signals, of their protocol, host, port and name.
_FLOAT_GUID = r"'{' || regexp_replace(md5(concat_ws('|', 'ICSSignal', proto, lower(host), port::varchar, series)), '^(.{8})(.{4})(.{4})(.{4})(.{12})$', '\1-\2-\3-\4-\5') || '}'"
_ENDS = lambda port: f"case when dst_port = {port} then src_ip else dst_ip end client_ip, case when dst_port = {port} then dst_ip else src_ip end server_ip"
GRAPH_SQL["access_by_process"] = f"""with {_MATCH}, {_PROC}, {_OBS[_OBS.index('mp as'):]}, ci as ({_inner('client_identity')}),
    mq as (select 'mqtt' proto, 1883 port, mqtt_topic || '.' || mqtt_payload_values[1].name series, case when dst_port = 1883 then 'write' else 'read' end as access, ts_us, {_ENDS(1883)} from p where mqtt_packet_type = 'PUBLISH'),
    {_UA[_UA.index('ua as'):].replace('access, value, o', 'access, value, o, ts_us, src_ip, dst_ip, dst_port').replace('value, o from up', 'value, o, ts_us, src_ip, dst_ip, dst_port from up')},
    al as (select {_SIGNAL_GUID} dst, client_ip || '>' || server_ip || ':502/tcp' edge, access, ts_us from (select *, {_HOST('server_ip')} host from obs) union all
      select {_FLOAT_GUID}, client_ip || '>' || server_ip || ':' || port || '/tcp', access, ts_us from (select *, {_HOST('server_ip')} host from
        (select proto, port, series, access, ts_us, client_ip, server_ip from mq union all select 'opcua', 4840, series, access, ts_us, {_ENDS(4840)} from sg)))
    select guid src, dst, case when access = 'read' then 'READ_SIGNAL' else 'WRITE_SIGNAL' end rel, count(*) n, max(ts_us) last_us from al join ci using (edge) group by 1, 2, 3"""
