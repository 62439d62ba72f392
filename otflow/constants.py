"""Ports, names and limits of the traffic model."""

PRIVILEGED_LIMIT = 1024
EPHEMERAL_FROM = 32768

# Ports that tell the server's side of a connection.
SERVICE_PORTS = (
    20, 21, 22, 23, 25, 53, 67, 68, 69, 80, 88, 110, 111, 123, 135, 137, 138, 139, 143, 161, 162, 389, 443, 445, 465,
    500, 502, 514, 515, 520, 587, 636, 873, 993, 995, 1080, 1433, 1434, 1521, 1883, 2049, 2222, 3306, 3389, 4443, 4840,
    5044, 5060, 5061, 5432, 5672, 5900, 6379, 6443, 7474, 7687, 8000, 8008, 8080, 8081, 8088, 8443, 8880, 8883, 9000,
    9090, 9092, 9200, 9300, 9418, 9999, 10000, 11211, 27017, 44818, 47808,
)

# Ports whose traffic is of interest, and ports that are never.
INTERESTING_PORTS = (21, 22, 23, 25, 53, 80, 110, 135, 139, 143, 161, 162, 443, 445, 502, 1433, 1883, 3389, 4840, 8883, 44818)
IGNORED_PORTS = (137, 138, 1900, 5353, 5355)

SERVICE_NAMES = {
    21: "FTP", 22: "SSH", 23: "Telnet", 25: "SMTP", 53: "DNS", 80: "HTTP", 110: "POP3", 135: "RPC", 139: "NetBIOS",
    143: "IMAP", 161: "SNMP", 162: "SNMP Trap", 443: "HTTPS", 445: "SMB", 502: "Modbus", 1433: "SQL", 1883: "MQTT",
    3389: "RDP", 4840: "OPC UA", 8883: "MQTT TLS", 44818: "EtherNet/IP",
}

HOST_NAMES = {
    "192.168.0.1": "FT-PLC-01",
    "192.168.0.5": "FT-GW-01",
    "192.168.0.10": "FT-MQTT-01",
    "192.168.0.12": "FT-CLIENT-01",
    "192.168.0.252": "FT-ROUTER",
    "192.168.42.12": "EWS-WIN-01",
    "192.168.42.20": "SCADA-01",
    "192.168.42.21": "HMI-01",
    "192.168.43.9": "PLC-01",
    "192.168.43.10": "PLC-02",
    "192.168.43.11": "PLC-03",
    "192.168.44.11": "PLC-03",
}

IGNORED_IPS = ("172.16.142.250",)
LOGGED_HOSTS = ("192.168.42.12", "192.168.42.20", "192.168.42.21", "192.168.42.22")
VERIFIED_PORTS = (22, 80, 443, 502, 8080, 44818)

MODBUS_PORT = 502
MONITOR_PORT = 8080
MQTT_PORTS = (1883, 8883)
OPCUA_PORT = 4840

MIN_PACKETS = 3
MIN_CLIENT_PORTS = 2
TOLERANCE_S = 60
RLE_RUNS = 200
TOP_VALUES = 4
SDT_TOLERANCE = 1.0
SDT_POINTS = 100
