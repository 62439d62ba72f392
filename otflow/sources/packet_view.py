"""A packet table derived from the events table, in the columns of decoded captures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_VIEW = """
with b as (
  select event_id e, user_id % 20 c, cast(get_json_object(props, '$.k') as bigint) k, cast(event_id % 2 as int) d,
    cast(case event_type when 'click' then 502 when 'view' then 80 when 'purchase' then 1883 when 'signup' then 4840 else 8080 end as int) sp,
    cast(floor(value) as bigint) v, unix_micros(from_utc_timestamp(cast(ts as timestamp), current_timezone())) ts_us
  from {events}),
n as (select *, concat('192.168.42.', 10 + c) ci, concat('192.168.43.', 9 + k % 3) si, cast(40000 + k % 4 as int) cp from b)
select e packet_index, concat('cap', e % 3, '.pcap') pcap_file, ts_us, cast(60 + v as int) size,
  if(d = 0, ci, si) src_ip, if(d = 0, si, ci) dst_ip, if(d = 0, cp, sp) src_port, if(d = 0, sp, cp) dst_port, 'tcp' protocol,
  case when e % 10 = 0 then 'TCP' when sp = 502 then 'Modbus' when sp = 1883 then 'MQTT' when sp = 4840 then 'OPCUA' else 'HTTP' end high_level_protocol,
  cast(if(e % 50 = 0, 1, 0) as int) ip_layer_index, cast(if(e % 50 = 0, 2, 1) as int) ip_layer_count,
  if(e % 9 = 0, '', concat('mac-', if(d = 0, ci, si))) src_mac, if(e % 13 = 0, '', concat('mac-', if(d = 0, si, ci))) dst_mac,
  case when e % 11 = 0 then 'S' when e % 7 = 0 then 'SA' when e % 5 = 0 then 'FA' else 'PA' end tcp_flags,
  (e % 97) * 100 tcp_seq, if(e % 3 = 0, null, ((e * 7) % 97) * 100 + k % 5) tcp_ack, cast(v % 5 as int) payload_len,
  case when sp in (80, 8080) and d = 0 then case when k % 3 = 0 then 'GET' when k % 3 = 1 then 'POST' end end http_method,
  case when sp in (80, 8080) and d = 0 then concat('h', k % 3) end http_host,
  case when sp in (80, 8080) and d = 0 then if(k % 5 = 0, '/monitor/x', concat('/p/', k)) end http_path,
  cast(case when sp in (80, 8080) and d = 1 then 200 + k % 5 end as int) http_status,
  case when sp in (80, 8080) and d = 1 then 'text/html' end http_content_type,
  case when sp = 80 and e % 4 = 0 then concat('s', k % 3, '.example') end tls_sni,
  case when sp = 1883 then element_at(array('CONNECT', 'PUBLISH', 'SUBSCRIBE', 'PINGREQ', 'UNSUBSCRIBE'), cast(e % 5 + 1 as int)) end mqtt_packet_type,
  case when sp = 1883 and e % 5 = 1 then concat('t/', k % 6) end mqtt_topic,
  case when sp = 1883 and e % 5 = 0 then concat('c', c) end mqtt_client_id,
  cast(case when sp = 1883 and e % 5 = 1 then k % 3 end as int) mqtt_qos,
  case when sp = 1883 and e % 5 = 1 then k % 7 = 0 end mqtt_retain,
  case when sp = 1883 and e % 5 = 1 then array(named_struct('name', 'value', 'value', cast(v as double) / 4)) end mqtt_payload_values,
  case when sp = 4840 then element_at(array('HEL', 'OPN', 'MSG', 'MSG', 'MSG', 'CLO'), cast(e % 6 + 1 as int)) end opcua_message_type,
  case when sp = 4840 then if(k % 9 = 0, 'C', 'F') end opcua_chunk_type,
  case when sp = 4840 and e % 6 = 0 then concat('opc.tcp://', si) end opcua_endpoint_url,
  case when sp = 4840 and e % 6 = 1 then concat('policy', k % 2) end opcua_security_policy_uri,
  case when sp = 4840 and e % 6 > 0 then 100 + k % 3 end opcua_secure_channel_id,
  case when sp = 4840 and e % 6 in (2, 3, 4) then k % 10 end opcua_request_id,
  case when sp = 4840 and e % 6 in (2, 3, 4) then if(k % 2 = 0, 'read', 'write') end opcua_operation,
  case when sp = 4840 and e % 6 in (2, 3, 4) and d = 0 then array(concat('ns=3;s="dev"."tag', k % 4, '"')) end opcua_node_ids,
  case when sp = 4840 and e % 6 in (2, 3, 4) and ((d = 0 and k % 2 = 1) or (d = 1 and k % 2 = 0)) then array(cast(v as double) / 2) end opcua_values,
  cast(case when sp = 502 then element_at(array(1, 3, 6, 16), cast(k % 4 + 1 as int)) end as int) modbus_function,
  cast(case when sp = 502 and k % 17 > 0 then k % 2 end as int) modbus_unit_id,
  case when sp = 502 then k end modbus_transaction_id,
  case when sp = 502 then array(cast(k % 8 as int)) end modbus_registers,
  case when sp = 502 and ((d = 0 and k % 4 >= 2) or (d = 1 and k % 4 < 2) or (d = 1 and k % 4 = 2)) then array(cast(if(k % 4 = 0, v % 2, v) as int)) end modbus_register_values
from n
"""


def packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packet view of sf_dir's events, whose times are UTC whatever the session's zone."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return spark.sql(_VIEW, events=events)
