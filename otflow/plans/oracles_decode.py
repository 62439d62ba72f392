"""DuckDB SQL of what the decoders have to read from the frames of sources.frame_view."""

_FRAMES = """with b as (select event_id e, cast(json_extract_string(props, '$.k') as bigint) k, abs(floor(value))::bigint v, epoch_us(ts) ts_us from events),
  n as (select *, k % 6 kind, e % 2 back, '10.' || (k % 7) || '.' || (e % 200) || '.' || k ci, '192.168.43.' || (k % 5 + 1) si, 40000 + k cp,
    [502, 80, 1883, 1883, 4840, 443][k % 6 + 1] sp, e // 2 % 3 pick from b)
"""

DECODE_SQL = {
    "decode_headers": _FRAMES
    + """select e tcp_seq, v tcp_ack, ts_us, if(back = 0, ci, si) src_ip, if(back = 0, si, ci) dst_ip, if(back = 0, cp, sp)::int src_port, if(back = 0, sp, cp)::int dst_port, 'tcp' protocol,
      ['Modbus', 'HTTP', 'MQTT', 'MQTT', 'OPCUA', 'HTTPS'][kind + 1] high_level_protocol, ['S', 'SA', 'PA', 'FA'][e % 4 + 1] tcp_flags,
      if(e % 5 in (1, 2), 1, 0)::int ip_layer_index, if(e % 5 in (1, 2), 2, 1)::int ip_layer_count,
      printf('02:00:00:00:%02x:%02x', e % 256, k) src_mac, '00:00:00:00:00:00' dst_mac from n""",
    "decode_modbus": _FRAMES
    + """, m as (select *, [3, 6, 16][pick + 1] f from n where kind = 0)
      select e tcp_seq, f::int "function", (e % 7)::int unit, (e % 65536)::int transaction,
      case when f = 3 then if(back = 0, array_to_string(range(k, k + 1 + k % 4), ','), '') when f = 6 then k::varchar else k || ',' || (k + 1) end registers,
      case when f = 3 then if(back = 0, '', (v % 65536)::varchar) when f = 6 then (v % 65536)::varchar else if(back = 0, (v % 65536) || ',' || ((v + 1) % 65536), '') end "values" from m""",
    "decode_http": _FRAMES
    + """select e tcp_seq, if(back = 0, ['GET', 'POST', 'PUT'][pick + 1], null) http_method, if(back = 0, '/p/' || k || '/' || v, null) http_path, if(back = 0, 'host' || k || '.example', null) http_host,
      if(back = 1, 200 + k, null)::int http_status, if(back = 1, 'text/html', null) http_content_type from n where kind = 1""",
    "decode_mqtt": _FRAMES
    + """select e tcp_seq, if(kind = 2, 'PUBLISH', 'CONNECT') mqtt_packet_type, if(kind = 2, 't/' || k || '/' || (e % 9), null) mqtt_topic, if(kind = 2, pick, null)::int mqtt_qos,
      if(kind = 2, e // 6 % 2 = 1, null) mqtt_retain, if(kind = 2 and pick > 0, 1 + e % 65535, null)::int mqtt_packet_id, if(kind = 3, 'c-' || (e % 50), null) mqtt_client_id, if(kind = 3, k, null)::int mqtt_keepalive,
      if(kind = 2, v / 4, null) "value" from n where kind in (2, 3)""",
    "decode_opcua": _FRAMES
    + """select e tcp_seq, if(back = 0, 'HEL', 'OPN') opcua_message_type, 'F' opcua_chunk_type, if(back = 0, 'opc.tcp://host' || k || ':4840', null) opcua_endpoint_url,
      if(back = 1, e, null) opcua_secure_channel_id, if(back = 1, 'policy-' || (k % 4), null) opcua_security_policy_uri from n where kind = 4""",
    "decode_tls": _FRAMES + "select e tcp_seq, if(back = 0, 's' || k || '.example.net', null) tls_sni from n where kind = 5",
    "decode_names": """select event_id, ['UDP', 'NetBIOS', 'SMB', 'Modbus', 'DNS'][k % 5 + 1] plain, ['DNS', 'SMB', 'NetBIOS', 'SSH', 'DNS'][k % 5 + 1] "full"
      from (select event_id, cast(json_extract_string(props, '$.k') as bigint) k from events)""",
    "decode_opcua_services": """select event_id, 'MSG' opcua_message_type, 7 + k % 2 opcua_secure_channel_id, ['ReadRequest', 'WriteRequest', 'ReadResponse'][k % 3 + 1] opcua_service_type,
        ['read', 'write', null][k % 3 + 1] opcua_operation, case k % 3 when 0 then 'ns=3;s=tag' || (k % 4) || ',ns=3;s=tag' || ((k + 1) % 4) when 1 then 'ns=3;s=tag' || (k % 4) else '' end nodes,
        [0, 1, 2][k % 3 + 1]::int n_values, case k % 3 when 1 then v / 2 when 2 then v / 4 end first_value, null::double second_value
      from (select event_id, cast(json_extract_string(props, '$.k') as bigint) k, abs(floor(value))::bigint v from events)""",
}
