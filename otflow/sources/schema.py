"""Schemas of the tables that sources give."""

PACKET = """pcap_file string, packet_index long, ts_us long, size int, src_ip string, dst_ip string, src_port int, dst_port int, protocol string,
high_level_protocol string, ip_layer_index int, ip_layer_count int, src_mac string, dst_mac string, tcp_flags string, tcp_seq long, tcp_ack long, payload_len int,
http_method string, http_host string, http_path string, http_status int, http_content_type string, tls_sni string,
mqtt_packet_type string, mqtt_packet_type_code int, mqtt_topic string, mqtt_qos int, mqtt_retain boolean, mqtt_dup boolean, mqtt_client_id string,
mqtt_keepalive int, mqtt_packet_id int, mqtt_payload_size int, mqtt_payload_values array<struct<name:string,value:double>>,
opcua_message_type string, opcua_chunk_type string, opcua_message_size long, opcua_secure_channel_id long, opcua_endpoint_url string,
opcua_security_policy_uri string, opcua_service_type string, opcua_operation string, opcua_request_id long, opcua_node_ids array<string>, opcua_values array<double>,
modbus_function int, modbus_unit_id int, modbus_registers array<int>, modbus_read_registers array<int>, modbus_write_registers array<int>,
modbus_register_values array<int>, modbus_transaction_id int"""
