"""Fixed reference tables: small by nature, so they are always safe to broadcast."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# ---------------------------------------------------------------------------
# They must equal the published ones for right results.
# ---------------------------------------------------------------------------

PORTS = [
    (20, "FTP-DATA", "File Transfer Protocol (Data)", "medium"),
    (21, "FTP", "File Transfer Protocol (Control)", "high"),
    (22, "SSH", "Secure Shell", "high"),
    (23, "TELNET", "Telnet (Unencrypted)", "critical"),
    (25, "SMTP", "Simple Mail Transfer Protocol", "medium"),
    (53, "DNS", "Domain Name System", "low"),
    (67, "DHCP", "DHCP Server", "low"),
    (68, "DHCP", "DHCP Client", "low"),
    (80, "HTTP", "Hypertext Transfer Protocol", "medium"),
    (110, "POP3", "Post Office Protocol v3", "medium"),
    (123, "NTP", "Network Time Protocol", "low"),
    (135, "RPC", "Microsoft RPC", "high"),
    (137, "NETBIOS", "NetBIOS Name Service", "medium"),
    (138, "NETBIOS", "NetBIOS Datagram Service", "medium"),
    (139, "NETBIOS", "NetBIOS Session Service", "high"),
    (143, "IMAP", "Internet Message Access Protocol", "medium"),
    (161, "SNMP", "Simple Network Management Protocol", "medium"),
    (389, "LDAP", "Lightweight Directory Access Protocol", "medium"),
    (443, "HTTPS", "HTTP Secure", "low"),
    (445, "SMB", "Microsoft DS (Active Directory/SMB)", "high"),
    (500, "IKE", "IPSec Internet Key Exchange", "medium"),
    (636, "LDAPS", "LDAP over SSL", "low"),
    (993, "IMAPS", "IMAP over SSL", "low"),
    (995, "POP3S", "POP3 over SSL", "low"),
    (1433, "MSSQL", "Microsoft SQL Server", "high"),
    (1521, "ORACLE", "Oracle Database", "high"),
    (3306, "MYSQL", "MySQL Database", "high"),
    (3389, "RDP", "Remote Desktop Protocol", "high"),
    (5432, "POSTGRES", "PostgreSQL Database", "high"),
    (5900, "VNC", "Virtual Network Computing", "high"),
    (6379, "REDIS", "Redis Key-Value Store", "medium"),
    (8000, "HTTP-ALT", "Common Web Server API", "medium"),
    (8080, "HTTP-PROXY", "HTTP Alternate / Proxy", "medium"),
    (8443, "HTTPS-ALT", "HTTPS Alternate", "medium"),
    (27017, "MONGODB", "MongoDB", "high"),
]

UNKNOWN_PORT = ("UNKNOWN", "Unknown Service", "unknown")

CLASS_SEVERITY = [
    ("normal", 0), ("dos", 60), ("ddos", 70), ("port_scan", 40), ("brute_force", 65),
    ("sql_injection", 85), ("xss", 75), ("malware", 90), ("data_exfiltration", 95),
    ("lateral_movement", 80), ("privilege_escalation", 85), ("ransomware", 100),
    ("phishing", 70), ("botnet", 80), ("zero_day", 95),
]
DEFAULT_SEVERITY = 50
THREAT_CLASSES = [name for name, _ in CLASS_SEVERITY]
SEVERITIES = ["low", "medium", "high", "critical"]

# (order, lowest risk, highest risk, action); bounds are inclusive
ACTION_RANGES = [
    (1, 0.0, 40.0, "monitor"),
    (2, 41.0, 60.0, "alert"),
    (3, 61.0, 80.0, "isolate"),
    (4, 81.0, 100.0, "block"),
]
DEFAULT_ACTION = "monitor"
APPROVAL_THRESHOLD = 80.0

ASSET_CRITICALITY = [
    ("database_server", 10.0), ("file_server", 7.0), ("web_server", 5.0),
    ("workstation", 2.0), ("iot_device", 1.0),
]

ZONES = [("dmz", 0.8), ("internal", 1.0), ("critical", 0.6)]

# kill-chain order, the threat class that shows a stage, stage name
KILL_CHAIN = [
    (1, "port_scan", "reconnaissance"),
    (2, "brute_force", "initial_access"),
    (3, "privilege_escalation", "privilege_escalation"),
    (4, "lateral_movement", "lateral_movement"),
    (5, "data_exfiltration", "exfiltration"),
]

# (priority, network, prefix length, type); the lowest priority wins, none = public.
# 192.0.0.9/32 and 192.0.0.10/32 are the two public exceptions in 192.0.0.0/24.
IPV4_TYPES = [
    (1, "127.0.0.0", 8, "loopback"),
    (2, "192.0.0.9", 32, "public"),
    (2, "192.0.0.10", 32, "public"),
    (3, "0.0.0.0", 8, "private"),
    (3, "10.0.0.0", 8, "private"),
    (3, "169.254.0.0", 16, "private"),
    (3, "172.16.0.0", 12, "private"),
    (3, "192.0.0.0", 24, "private"),
    (3, "192.0.2.0", 24, "private"),
    (3, "192.168.0.0", 16, "private"),
    (3, "198.18.0.0", 15, "private"),
    (3, "198.51.100.0", 24, "private"),
    (3, "203.0.113.0", 24, "private"),
    (3, "240.0.0.0", 4, "private"),
    (4, "224.0.0.0", 4, "multicast"),
]

BRUTE_FORCE_PORTS = [22, 3389, 21, 23]
C2_PORTS = [4444, 5555, 9001, 6666, 31337]
EXPLOIT_PORTS = [445, 139, 135, 8443, 9090]
DAY_NAMES = ["Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun"]

# what responses record, and the sentence of an alert
QUARANTINE_VLAN, BLOCK_RULE, QUARANTINE_PATH = "quarantine", "auto_block_001", "/quarantine"
ALERT_CHANNELS = ["email", "slack", "siem"]
ALERT_SENTENCE = "Detected %s attack from %s targeting %s. Immediate investigation recommended."

ISOLATION_FOREST = {"trees": 200, "sample": 256, "contamination": 0.01, "seed": 42}
ENSEMBLE_THRESHOLD = 0.7
DIVERGENCE_THRESHOLD = 0.9
ZERO_DAY_ANOMALY = 0.8
# ---------------------------------------------------------------------------


def ipv4_number(address: str) -> int:
    a, b, c, d = (int(part) for part in address.split("."))
    return ((a * 256 + b) * 256 + c) * 256 + d


def ipv4_ranges() -> list[tuple[int, int, int, str]]:
    """(priority, first address, last address, type) as numbers."""
    out = []
    for priority, network, bits, kind in IPV4_TYPES:
        lo = ipv4_number(network)
        out.append((priority, lo, lo + 2 ** (32 - bits) - 1, kind))
    return out


def ports(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PORTS, "port int, service string, service_desc string, port_risk string")


def asset_criticality(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ASSET_CRITICALITY, "asset_id string, asset_criticality double")


def zones(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ZONES, "zone string, multiplier double")
