"""DuckDB SQL that checks the registered queries; written apart from the operators."""

from __future__ import annotations

from otflow import constants as C
from otflow.sources.packet_view import _VIEW

_IN = lambda ports: ", ".join(map(str, ports))


def _duck_view() -> str:
    """The packet view in DuckDB's spelling."""
    text = _VIEW.format(events="events")
    for a, b in (
        ("get_json_object(props, '$.k')", "json_extract_string(props, '$.k')"),
        ("unix_micros(from_utc_timestamp(cast(ts as timestamp), current_timezone()))", "epoch_us(ts)"),
        ("element_at(array(", "list_extract(list_value("),
        ("array(named_struct('name', 'value', 'value', cast(v as double) / 4))", "list_value({'name': 'value', 'value': v::double / 4})"),
        ("array(", "list_value("),
        ("as int) mqtt_qos", "as int) mqtt_qos"),
    ):
        text = text.replace(a, b)
    return text


def svc(c: str) -> str:
    return f"({c} < 1024 or ({c} < 32768 and {c} in ({_IN(C.SERVICE_PORTS)})))"


P = f"""pk as ({_duck_view()}),
p as (select *, row_number() over (order by ts_us, pcap_file, packet_index) o,
    least(src_ip || ':' || src_port || '->' || dst_ip || ':' || dst_port || ':' || protocol, dst_ip || ':' || dst_port || '->' || src_ip || ':' || src_port || ':' || protocol) canonical_id
  from pk)"""

_ENDS = ("src_ip", "src_port", "dst_ip", "dst_port")


def _ends(prefix: str, where: str) -> str:
    return ", ".join(f"arg_min({c}, o) filter (where {where}) {prefix}_{c}" for c in _ENDS)


FLOWS = f"""{P},
fl as (select canonical_id, {', '.join(f'arg_min({c}, o) {c}' for c in (*_ENDS, 'protocol'))}, min(ts_us) first_us, max(ts_us) last_us, count(*) packets, sum(size)::bigint bytes,
    max(ip_layer_index) layer, min(packet_index) first_index,
    {_ends('syn', "tcp_flags like '%S%' and tcp_flags not like '%A%'")}, {_ends('con', "mqtt_packet_type = 'CONNECT'")},
    {_ends('hel', "opcua_message_type = 'HEL' and opcua_endpoint_url is not null")}, {_ends('opn', "opcua_message_type = 'OPN' and opcua_security_policy_uri is not null")},
    bool_or(lower(high_level_protocol) = 'modbus') modbus_label,
    bool_or(lower(high_level_protocol) = 'http' and (coalesce(lower(http_path), '') like '%monitor%' or coalesce(lower(http_host), '') like '%monitor%')) monitor
  from p group by canonical_id)"""


def _pick(name: str, a: str, b: str) -> str:
    """client/server columns: a where forward holds, b where backward holds."""
    return name.format(a=a, b=b)


def _side(col: str, syn: str, forward: str, back: str, fwd_col: str, back_col: str) -> str:
    return f"case {syn} when {forward} then {fwd_col} when {back} then {back_col} end {col}"


def _orient(source: str, syn: bool = True) -> str:
    a, b = svc("src_port"), svc("dst_port")
    f, k = f"not {a} and {b}", f"{a} and not {b}"
    w = lambda c: f"when syn_src_ip is not null then syn_{c}" if syn else ""
    return (
        f"select *, {_side('client_ip', w('src_ip'), f, k, 'src_ip', 'dst_ip')}, {_side('client_port', w('src_port'), f, k, 'src_port', 'dst_port')}, "
        f"{_side('server_ip', w('dst_ip'), f, k, 'dst_ip', 'src_ip')}, {_side('server_port', w('dst_port'), f, k, 'dst_port', 'src_port')} from {source}"
    )


ORIENTED = f"{FLOWS}, ori as ({_orient('fl')})"

_PRIVATE = lambda c: f"({c} like '10.%' or {c} like '192.168.%' or {c} like '127.%' or {c} like '169.254.%' or regexp_matches({c}, '^172\\.(1[6-9]|2[0-9]|3[01])\\.'))"
_EPH = lambda c: f"({c} between 32768 and 60999 or {c} between 49152 and 65535)"
_CAST = lambda c: f"({c} like '%.255' or regexp_matches({c}, '^(22[4-9]|23[0-9])\\.') or {c} = '0.0.0.0')"


def policy(sp: str = "src_port", dp: str = "dst_port", s: str = "src_ip", d: str = "dst_ip") -> str:
    return f"""case when packets = 0 then false when {_CAST(s)} or {_CAST(d)} then false when layer >= 1 then true
      when {s} like '172.16.%' and {d} like '172.16.%' then false when packets < 3 then false when {_EPH(sp)} and {_EPH(dp)} then false
      when {sp} in ({_IN(C.IGNORED_PORTS)}) or {dp} in ({_IN(C.IGNORED_PORTS)}) then false
      when {sp} in ({_IN(C.INTERESTING_PORTS)}) or {dp} in ({_IN(C.INTERESTING_PORTS)}) then true else {_PRIVATE(s)} or {_PRIVATE(d)} end"""


_GROUP = """select client_ip, server_ip, server_port, protocol, count(*) flows, count(distinct client_port) client_ports, min(client_port) port_min, max(client_port) port_max,
    sum(packets)::bigint packets, sum(bytes)::bigint bytes, max(layer) layer, min(first_us) first_us, max(last_us) last_us from {source} where client_ip is not null group by 1, 2, 3, 4"""


def _to_port(port: int, where: str, source: str = "fl") -> str:
    back = f"src_port = {port} and dst_port <> {port}"
    cols = (("client_ip", "src_ip", "dst_ip"), ("client_port", "src_port", "dst_port"), ("server_ip", "dst_ip", "src_ip"), ("server_port", "dst_port", "src_port"))
    return f"select *, {', '.join(f'case when {back} then {b} else {a} end {n}' for n, a, b in cols)} from {source} where ({where}) and (src_port = {port} or dst_port = {port})"


def _ported(ports: str, opened: str, source: str) -> str:
    """MQTT and OPC UA orientation: the port's side, else who opened."""
    to, back = f"dst_port in ({ports})", f"src_port in ({ports})"
    cols = (("client_ip", "src_ip", "dst_ip"), ("client_port", "src_port", "dst_port"), ("server_ip", "dst_ip", "src_ip"), ("server_port", "dst_port", "src_port"))
    return f"select *, {', '.join(f'case when {to} and not {back} then {a} when {back} and not {to} then {b} else {opened.format(c=a)} end {n}' for n, a, b in cols)} from {source}"


_MQTT = "(src_port in (1883, 8883) or dst_port in (1883, 8883) or con_src_ip is not null)"
_OPCUA = "(src_port = 4840 or dst_port = 4840 or hel_src_ip is not null or opn_src_ip is not null)"
_MONITOR = "(src_port = 8080 or dst_port = 8080) and monitor"
_MODBUS = "(src_port = 502 or dst_port = 502 or modbus_label)"
_MQTT_SIDES = lambda source: _ported("1883, 8883", "con_{c}", source)
_OPCUA_SIDES = lambda source: _ported("4840", "coalesce(hel_{c}, opn_{c})", source)

EDGES = f"""{ORIENTED},
e as (select p.*, client_ip, server_ip, server_port, client_ip || '>' || server_ip || ':' || server_port || '/' || p.protocol edge,
    case when p.src_ip = client_ip and p.dst_ip = server_ip then 'out' when p.src_ip = server_ip and p.dst_ip = client_ip then 'in' end side
  from p join ori using (canonical_id) where client_ip is not null)"""


def _listed(value: str, name: str, limit: int = 1000) -> str:
    return f"(select edge, string_agg(v, ',' order by o) {name} from (select edge, v, o, row_number() over (partition by edge order by o) r from (select edge, {value} v, min(o) o from e where {value} <> '' group by 1, 2)) where r <= {limit} group by 1)"


_FIRST = lambda c: f"arg_min({c}, o) filter (where {c} is not null)"
_GUID = lambda *parts: f"'{{' || regexp_replace(md5(lower(concat_ws('|', {', '.join(f'nullif(({x})::varchar, {chr(39) * 2})' for x in parts)}))), '^(.{{8}})(.{{4}})(.{{4}})(.{{4}})(.{{12}})$', '\\1-\\2-\\3-\\4-\\5') || '}}'"

_RTT = """t as (select *, tcp_seq + greatest(coalesce(payload_len, 0), 0) + case when tcp_flags like '%S%' or tcp_flags like '%F%' then 1 else 0 end tgt from e where side is not null and protocol = 'tcp'),
ev as (select edge, side d, tgt v, ts_us, o, 1 st from t where tgt > tcp_seq union all
  select edge, case side when 'out' then 'in' else 'out' end, tcp_ack, ts_us, o, 0 from t where tcp_ack is not null),
isl as (select *, coalesce(sum(1 - st) over (partition by edge, d, v order by o, st desc rows between unbounded preceding and 1 preceding), 0) i from ev),
m as (select edge, d, v, i, min(case when st = 1 then ts_us end) s0, max(case when st = 0 then ts_us end) a0 from isl group by 1, 2, 3, 4),
rtt as (select edge, sum(a0 - s0)::bigint total_us, count(a0 - s0) samples, round(sum(a0 - s0) / count(a0 - s0) / 1000, 3) rtt_ms from m group by 1 having count(a0 - s0) > 0)"""

_TOTALS = """select edge, count(*) packets, sum(size)::bigint bytes, round(avg(size), 2) mean_size, min(ts_us) first_us, max(ts_us) last_us, (max(ts_us) - min(ts_us)) / 1e6 duration_s,
  case when count(*) > 1 then ((2 * (max(ts_us) - min(ts_us)) + count(*) - 1) // (2 * (count(*) - 1))) / 1e6 else 0.0 end mean_gap_s from e group by 1"""
_DIRECTIONAL = """select *, round(case when bytes_out = 0 and bytes_in = 0 then 0.0 when bytes_in = 0 then null else bytes_out::double / bytes_in end, 6) directionality from
  (select edge, coalesce(sum(size) filter (where side = 'out'), 0)::bigint bytes_out, coalesce(sum(size) filter (where side = 'in'), 0)::bigint bytes_in,
     count(*) filter (where side = 'out') packets_out, count(*) filter (where side = 'in') packets_in from e group by 1)"""
_DOMINANT = """select edge, high_level_protocol protocol_label from (select edge, high_level_protocol, row_number() over (partition by edge order by count(*) desc, min(o)) r from e group by 1, 2) where r = 1"""
_RETRANS = """select edge, (count(*) filter (where payload_len > 0) - count(distinct (src_ip, dst_ip, tcp_seq, payload_len)) filter (where payload_len > 0))::bigint retransmits from e group by 1"""
_MACS = """select edge, coalesce(arg_min(src_mac, o) filter (where side = 'out' and src_mac <> '' and dst_mac <> ''), arg_min(src_mac, o) filter (where src_mac <> '')) src_mac,
  coalesce(arg_min(dst_mac, o) filter (where side = 'out' and src_mac <> '' and dst_mac <> ''), arg_min(dst_mac, o) filter (where dst_mac <> '')) dst_mac from e group by 1"""
_HTTP = f"""select edge, http_method, http_status, coalesce(nullif(coalesce(h, '') || coalesce(x, ''), ''), ct) http_content, tls_sni from
  (select edge, {_FIRST('http_method')} http_method, {_FIRST('http_status')} http_status, {_FIRST('http_host')} h, {_FIRST('http_path')} x, {_FIRST('http_content_type')} ct, {_FIRST('tls_sni')} tls_sni from e group by 1)"""

_ANCHORS = f"""{ORIENTED},
an as (select first_index seq, client_ip sip, case when first_index % 2 = 0 then client_port else 0 end sport, server_ip dip, server_port dport, protocol proto,
    case when first_index % 15 <> 0 then client_port end ses_port, first_us + case when first_index % 4 = 0 then 120000000 else 0 end ses_us,
    case when first_index % 5 < 3 then first_us + (first_index % 7 - 3) * 50000000 end win_first, case when first_index % 5 < 2 then (first_index % 4) * 40000000 else 0 end win_size,
    case when first_index % 5 <> 0 then 'g' || (first_index % 7) end guid, case when first_index % 5 <> 0 then 'image' || (first_index % 7) end image
  from ori where client_ip is not null and first_index % 3 = 0)"""
_CAND = f"""{_ANCHORS},
cand as (select canonical_id, seq, min(tier) tier from (
    select canonical_id, seq, 0 tier from fl join an on src_ip = sip and src_port = sport and dst_ip = dip and dst_port = dport and protocol = proto union all
    select canonical_id, seq, 1 from fl join an on dst_ip = sip and dst_port = sport and src_ip = dip and src_port = dport and protocol = proto union all
    select canonical_id, seq, 2 from fl join an on protocol = proto and ((src_ip = sip and dst_ip = dip and dst_port = dport) or (sport > 0 and src_ip = dip and dst_ip = sip and dst_port = sport)) union all
    select canonical_id, seq, 3 from fl join an on protocol = proto and ((dst_ip = sip and src_ip = dip and src_port = dport) or (sport > 0 and dst_ip = dip and src_ip = sip and src_port = sport))) group by 1, 2)"""
_MATCH = f"""{_CAND},
mt as (select canonical_id, seq anchor_seq, tier, case when near then 1.0::double else 0.9::double end confidence, case when near then 'session_port_exact' else 'session_port_match' end as method from
  (select canonical_id, seq, tier, abs(first_us - ses_us) <= 60000000 near, row_number() over (partition by canonical_id order by tier, seq) r
   from cand join an using (seq) join fl using (canonical_id) where ses_port is not null and (ses_port = src_port or ses_port = dst_port)) where r = 1)"""
_BRUTE = f"""{_MATCH},
bf as (select canonical_id, arg_min(case when byport then 'session_port' else 'temporal' end, seq) reason, min(seq) anchor_seq from
  (select canonical_id, seq, coalesce(ses_port = src_port or ses_port = dst_port, false) byport, coalesce(win_first - 60000000 <= last_us and win_first + win_size + 60000000 >= first_us, false) near
   from fl join an on protocol = proto and ((src_ip = sip and dst_ip = dip) or (src_ip = dip and dst_ip = sip))
     and dport = case when {svc('dst_port')} then dst_port when {svc('src_port')} then src_port else dst_port end) where byport or near group by 1)"""

_HOST = lambda c: "case " + " ".join(f"when {c} = '{ip}' then '{h}'" for ip, h in C.HOST_NAMES.items()) + f" else {c} end"

_OBS = f"""{P},
mp as (select *, dst_port = 502 request, case when dst_port = 502 then src_ip else dst_ip end kc, case when dst_port = 502 then src_port else dst_port end kp, case when dst_port = 502 then dst_ip else src_ip end ks,
    coalesce(modbus_unit_id, -1) ku from p where modbus_function is not null),
pr as (select *, lag(request) over w prev_request, lag(modbus_registers[1]) over w prev_register, lag(ts_us) over w prev_us from mp window w as (partition by kc, kp, ks, ku, modbus_transaction_id order by o)),
ob as (select kc client_ip, ks server_ip, modbus_unit_id unit, case when not request and prev_request then prev_register else modbus_registers[1] end register,
    case when modbus_function in (1, 5, 15) then 'coil' when modbus_function = 2 then 'discreteInput' when modbus_function in (3, 6, 16, 23) then 'holdingRegister' else 'inputRegister' end kind,
    case when request then 'write' when modbus_function in (1, 2, 3, 4, 23) and prev_request then 'read' else 'write' end as access, modbus_register_values[1] as value, modbus_function as function, modbus_transaction_id, ts_us, packet_index, o,
    request is_request, case when not request and prev_request then prev_us end request_us
  from pr where modbus_register_values is not null),
obs as (select *, client_ip || '|' || server_ip || '|' || coalesce(unit::varchar, 'none') || '|' || register || '|' || kind series, server_ip || '|' || register || '|' || kind short from ob)"""

_UA = f"""{P},
ua as (select *, dst_port = 4840 to_server, case when dst_port = 4840 then src_ip else dst_ip end kc, coalesce(opcua_secure_channel_id, -1) ch from p where opcua_request_id is not null),
up as (select *, last_value(case when to_server then {{'n': opcua_node_ids[1], 'op': opcua_operation}} end ignore nulls) over (partition by kc, ch, opcua_request_id order by o rows between unbounded preceding and 1 preceding) asked from ua),
us as (select case when to_server then opcua_node_ids[1] when asked.op = opcua_operation then asked.n end node, opcua_operation as access, opcua_values[1] as value, o from up where opcua_values is not null),
sg as (select replace(split_part(node, ';s=', 2), '"', '') series, access, value, o from us where node is not null and node not like 'ns=0;%' and node not like 'ns=1;%' and replace(split_part(node, ';s=', 2), '"', '') not like 'TD#_%' escape '#')"""
_MQ = f"""{P}, sg as (select mqtt_topic || '.' || mqtt_payload_values[1].name series, case when dst_port in (1883, 8883) then 'write' else 'read' end as access, mqtt_payload_values[1].value as value, o from p where mqtt_packet_type = 'PUBLISH')"""
_SIGNAL = """select series, count(*) filter (where access = 'read') reads, count(*) filter (where access = 'write') writes, round(avg(value), 3) mean_value, min(value) min_value, max(value) max_value, arg_max(value, o) last_value from sg group by 1"""

_STAGES = f"""{FLOWS},
s1 as ({_to_port(502, _MODBUS)}), s2 as ({_to_port(8080, _MONITOR)}),
l2 as (select * from fl where canonical_id not in (select canonical_id from s1) and canonical_id not in (select canonical_id from s2)),
s3 as (select * from ({_MQTT_SIDES('l2')}) where {_MQTT} and ({policy()})), s3c as (select * from s3 where client_ip is not null),
l3 as (select * from l2 where canonical_id not in (select canonical_id from s3c)),
s4 as (select * from ({_OPCUA_SIDES('l3')}) where {_OPCUA} and ({policy()})), s4c as (select * from s4 where client_ip is not null),
l4 as (select * from l3 where canonical_id not in (select canonical_id from s4c)),
o4 as ({_orient('l4')}), o4c as (select * from o4 where client_port > 0 and server_port > 0),
g4 as ({_GROUP.format(source='o4c')} having count(distinct client_port) >= 2),
s5 as (select o4c.* from o4c join g4 using (client_ip, server_ip, server_port, protocol)),
l5 as (select * from o4 where canonical_id not in (select canonical_id from s5) and ({policy()}))"""
_STAGE_EDGES = " union all ".join(
    [f"select *, '{name}' stage from ({_GROUP.format(source=source)}) where {policy('0', 'server_port', 'client_ip', 'server_ip')}" for name, source in (("modbus", "s1"), ("http_monitor", "s2"))]
    + [f"select *, '{name}' stage from ({_GROUP.format(source=source)})" for name, source in (("mqtt", "s3"), ("opcua", "s4"))]
    + [f"select *, 'collapsed' stage from g4 where {policy('0', 'server_port', 'client_ip', 'server_ip')}"]
    + ["""select coalesce(client_ip, src_ip), coalesce(server_ip, dst_ip), coalesce(server_port, dst_port), protocol, 1, 1, case when client_ip is null then src_port else 0 end, case when client_ip is null then src_port else 0 end,
      packets, bytes, layer, first_us, last_us, 'individual' from l5"""]
)

_MQTT_ROW = f"""with c as (select edge, coalesce(string_agg(distinct mqtt_qos::varchar, ',' order by mqtt_qos::varchar), '') mqtt_qos_levels, count(*) filter (where mqtt_packet_type = 'PUBLISH') mqtt_publish_count,
      count(*) filter (where mqtt_packet_type in ('SUBSCRIBE', 'UNSUBSCRIBE')) mqtt_subscribe_count, coalesce(bool_or(mqtt_retain), false) mqtt_retain_seen from e where mqtt_packet_type is not null group by 1)
    select * from c left join {_listed('mqtt_packet_type', 'mqtt_packet_types', 8)} using (edge) left join {_listed('mqtt_topic', 'mqtt_topics', 8)} using (edge) left join {_listed('mqtt_client_id', 'mqtt_client_ids', 4)} using (edge)"""
_OPCUA_ROW = f"""with c as (select edge, coalesce(string_agg(distinct opcua_secure_channel_id::varchar, ',' order by opcua_secure_channel_id::varchar), '') opcua_secure_channel_ids,
      count(*) filter (where opcua_message_type = 'OPN') opcua_open_count, count(*) filter (where opcua_message_type = 'MSG') opcua_msg_count, count(*) filter (where opcua_message_type = 'CLO') opcua_close_count from e where opcua_message_type is not null group by 1)
    select * from c left join {_listed('opcua_message_type', 'opcua_message_types', 8)} using (edge) left join {_listed('opcua_chunk_type', 'opcua_chunk_types', 3)} using (edge)
      left join {_listed('opcua_endpoint_url', 'opcua_endpoint_urls', 4)} using (edge) left join {_listed('opcua_security_policy_uri', 'opcua_security_policies', 4)} using (edge)"""

ORACLE_SQL = {
    "flow_assembly": f"with {FLOWS} select canonical_id, src_ip, src_port, dst_ip, dst_port, protocol, first_us, last_us, packets, bytes from fl",
    "flow_normalized": f"with {P} select case when (src_ip, src_port) <= (dst_ip, dst_port) then src_ip else dst_ip end ip_a, case when (src_ip, src_port) <= (dst_ip, dst_port) then src_port else dst_port end port_a, count(*) packets from p group by 1, 2",
    "orient_client_server": f"with {ORIENTED} select canonical_id, client_ip, client_port, server_ip, server_port from ori",
    "orient_incremental": f"with {FLOWS}, ori as ({_orient('fl', False)}) select canonical_id, client_ip, client_port, server_ip, server_port from ori",
    "service_port_flag": f"with {P} select dst_port port, {svc('dst_port')} is_service, {_EPH('dst_port')} is_ephemeral, count(*) packets from p group by all",
    "policy_interesting": f"with {FLOWS} select canonical_id, {policy()} interesting, packets >= 3 and not (src_ip like '%.255' or dst_ip like '%.255') incremental from fl",
    "group_modbus": f"with {FLOWS}, s as ({_to_port(502, _MODBUS)}) {_GROUP.format(source='s')}",
    "group_http_monitor": f"with {FLOWS}, s as ({_to_port(8080, _MONITOR)}) {_GROUP.format(source='s')}",
    "group_mqtt": f"with {FLOWS}, s as (select * from ({_MQTT_SIDES('fl')}) where {_MQTT} and ({policy()})) {_GROUP.format(source='s')}",
    "group_opcua": f"with {FLOWS}, s as (select * from ({_OPCUA_SIDES('fl')}) where {_OPCUA} and ({policy()})) {_GROUP.format(source='s')}",
    "group_collapsed": f"with {ORIENTED}, s as (select * from ori where client_port > 0 and server_port > 0) {_GROUP.format(source='s')} having count(distinct client_port) >= 2",
    "individual_flows": f"with {ORIENTED} select coalesce(client_ip, src_ip) client_ip, coalesce(server_ip, dst_ip) server_ip, coalesce(server_port, dst_port) server_port, protocol, case when client_ip is null then src_port else 0 end port_min, packets, bytes from ori where {policy()}",
    "stage_edges": f"with {_STAGES} {_STAGE_EDGES}",
    "stage_consumed": f"with {_STAGES} select stage, count(*) flows from (select 'modbus' stage from s1 union all select 'http_monitor' from s2 union all select 'mqtt' from s3c union all select 'opcua' from s4c union all select 'collapsed' from s5) group by 1",
    "feat_totals": f"with {EDGES} {_TOTALS}",
    "feat_directional": f"with {EDGES} {_DIRECTIONAL}",
    "feat_dominant_protocol": f"with {EDGES} {_DOMINANT}",
    "feat_tcp_flags": f"with {EDGES} select * from {_listed('tcp_flags', 'tcp_flags')}",
    "feat_retransmits": f"with {EDGES} {_RETRANS}",
    "feat_mac": f"with {EDGES} {_MACS}",
    "feat_http_first": f"with {EDGES} {_HTTP}",
    "feat_mqtt": f"""with {EDGES}, c as (select edge, count(*) filter (where mqtt_packet_type = 'PUBLISH') publishes, count(*) filter (where mqtt_packet_type in ('SUBSCRIBE', 'UNSUBSCRIBE')) subscribes,
        coalesce(bool_or(mqtt_retain), false) retain, coalesce(string_agg(distinct mqtt_qos::varchar, ',' order by mqtt_qos::varchar), '') qos from e where mqtt_packet_type is not null group by 1)
        select * from c left join {_listed('mqtt_packet_type', 'types', 8)} using (edge) left join {_listed('mqtt_topic', 'topics', 8)} using (edge) left join {_listed('mqtt_client_id', 'clients', 4)} using (edge)""",
    "feat_opcua": f"""with {EDGES}, c as (select edge, count(*) filter (where opcua_message_type = 'OPN') opens, count(*) filter (where opcua_message_type = 'MSG') messages, count(*) filter (where opcua_message_type = 'CLO') closes,
        coalesce(string_agg(distinct opcua_secure_channel_id::varchar, ',' order by opcua_secure_channel_id::varchar), '') channels from e where opcua_message_type is not null group by 1)
        select * from c left join {_listed('opcua_message_type', 'types', 8)} using (edge) left join {_listed('opcua_chunk_type', 'chunks', 3)} using (edge) left join {_listed('opcua_endpoint_url', 'urls', 4)} using (edge) left join {_listed('opcua_security_policy_uri', 'policies', 4)} using (edge)""",
    "rtt_mean": f"with {EDGES}, {_RTT} select * from rtt",
    "client_ports": f"""with {EDGES}, q as (select distinct edge, case side when 'out' then src_port else dst_port end port from e where side is not null)
        select edge, count(*) n_ports, string_agg(port::varchar, ',' order by port) filter (where r <= 8) port_set from (select *, row_number() over (partition by edge order by port) r from q) group by 1""",
    "majority_port": f"""with {EDGES} select edge, port from (select edge, port, row_number() over (partition by edge order by count(*) desc, min(o)) r from (select edge, o, case side when 'out' then src_port else dst_port end port from e where side is not null) group by 1, 2) where r = 1""",
    "edge_features": f"""with {EDGES}, {_RTT} select t.*, d.* exclude (edge), protocol_label, f.tcp_flags, retransmits, src_mac, dst_mac, http_method, http_status, http_content, tls_sni, rtt_ms, m.* exclude (edge), u.* exclude (edge) from ({_TOTALS}) t
        left join ({_DIRECTIONAL}) d using (edge) left join ({_DOMINANT}) using (edge) left join {_listed('tcp_flags', 'tcp_flags')} f using (edge) left join ({_RETRANS}) using (edge) left join ({_MACS}) using (edge) left join ({_HTTP}) using (edge) left join rtt using (edge)
        left join ({_MQTT_ROW}) m using (edge) left join ({_OPCUA_ROW}) u using (edge)""",
    "corr_candidates": f"with {_CAND} select canonical_id, seq anchor_seq, tier from cand",
    "corr_exact": f"with {_CAND} select canonical_id, seq anchor_seq from cand where tier < 2",
    "corr_service_endpoint": f"with {_CAND} select canonical_id, seq anchor_seq from cand where tier >= 2",
    "corr_session_port": f"with {_MATCH} select * from mt",
    "corr_stats": f"with {_MATCH} select (select count(*) from fl) attempts, (select count(*) from mt) correlated, (select count(*) from fl where canonical_id not in (select canonical_id from cand)) no_candidates, (select count(*) from mt where confidence = 1) exact",
    "session_coverage": f"with {_ANCHORS} select count(*) anchors, count(ses_port) with_sessions, count(ses_port) session_ports, round(count(ses_port) / count(*), 4) coverage from an",
    "process_lookup": f"""with {_ANCHORS}, ok as (select *, {_HOST('sip')} sh, {_HOST('dip')} dh from an where guid is not null), hx as (select *, {_HOST('src_ip')} fh, {_HOST('dst_ip')} th from fl),
        pairs as (select hx.*, ok.* from hx join ok on protocol = proto), hit as (
          select *, 0 stage from pairs where (src_ip = sip and dst_ip = dip and dst_port = dport) or (sport > 0 and src_ip = dip and dst_ip = sip and dst_port = sport) union all
          select *, 1 from pairs where (dst_ip = sip and src_ip = dip and src_port = dport) or (sport > 0 and dst_ip = dip and src_ip = sip and src_port = sport) union all
          select *, 2 from pairs where (fh <> src_ip or th <> dst_ip) and ((fh = sh and th = dh and dst_port = dport) or (sport > 0 and fh = dh and th = sh and dst_port = sport)) union all
          select *, 3 from pairs where (fh <> src_ip or th <> dst_ip) and ((th = sh and fh = dh and src_port = dport) or (sport > 0 and th = dh and fh = sh and src_port = sport)))
        select canonical_id conn_id, stage, seq anchor_seq, guid process_guid, image process_image from
          (select *, row_number() over (partition by canonical_id order by stage, case when stage in (0, 2) and src_port > 0 and coalesce(sport = src_port or ses_port = src_port, false) then 0 else 1 end, seq) r from hit) where r = 1""",
    "verify_bruteforce": f"with {_BRUTE} select canonical_id, reason, anchor_seq from bf",
    "verify_diff": f"""with {_BRUTE} select canonical_id, case when mt.anchor_seq is null then 'missed' else 'false_positive' end verdict, coalesce(bf.reason, 'no anchor') reason from mt full join bf using (canonical_id) where mt.anchor_seq is null or bf.anchor_seq is null""",
    "asof_request": f"with {_OBS} select client_ip, server_ip, register, access, ts_us, request_us from obs where not is_request",
    "register_stats": f"""with {_OBS} select series, count(*) filter (where access = 'read') reads, count(*) filter (where access = 'write') writes, count(*) samples, round(avg(value), 3) mean_value, min(value) min_value, max(value) max_value,
        arg_max(value, o) last_value, max(ts_us) last_us, max(ts_us) filter (where access = 'write') last_write_us, arg_max(function, o) last_function,
        array_to_string(list_sort(list(distinct function)), ',') functions from obs group by 1""",
    "register_state_changes": f"with {_OBS} select series, count(*) filter (where value <> prev) changes from (select short series, value, lag(value) over (partition by short order by o) prev from obs where kind = 'coil') group by 1",
    "register_bucket_distinct": f"with {_OBS} select short series, bit_count(bit_or(1::ubigint << (value & 63)::ubigint))::int buckets from obs group by 1",
    "register_top_values": f"""with {_OBS} select series, string_agg(value || ':' || n, ',' order by n desc, value) top_values from
        (select series, value, n, row_number() over (partition by series order by o) r from (select short series, value, count(*) n, min(o) o from obs group by 1, 2)) where r <= 4 group by 1""",
    "register_rle": f"""with {_OBS}, r as (select series, run, any_value(value) as value, count(*) n from (select *, sum(case when value is distinct from prev then 1 else 0 end) over (partition by series order by o) run from
          (select short series, value, o, lag(value) over (partition by short order by o) prev from obs)) group by 1, 2), t as (select series, count(*) runs, sum(n) samples from r group by 1)
        select series, string_agg(value || ':' || n, ',' order by run) filter (where run > runs - 200) rle, any_value(runs) runs, round(any_value(samples) / any_value(runs), 2) ratio, any_value(runs) > 200 truncated from r join t using (series) group by 1""",
    "obs_table": f"with {_OBS} select series, access, value, function, ts_us, packet_index from obs",
    "obs_stats": f"with {_OBS} select access, kind, count(*) n, count(distinct series) series_n, count(distinct (server_ip, register)) registers from obs group by 1, 2",
    "write_ack": f"""with {_OBS}, q as (select *, min(case when not is_request then ts_us end) over (partition by client_ip, server_ip, modbus_transaction_id order by o rows between 1 following and unbounded following) response_us from obs)
        select series, modbus_transaction_id, ts_us, packet_index, value, response_us, response_us is not null acknowledged from q where is_request and access = 'write'""",
    "signal_opcua": f"with {_UA} {_SIGNAL}",
    "signal_mqtt": f"with {_MQ} {_SIGNAL}",
}
