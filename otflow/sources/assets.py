"""Asset inventory: hosts with addresses, role and whether they are managed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SCHEMA = "hostname string, ip_addresses array<string>, role string, zone string, has_logs boolean, is_managed boolean"


def read_assets(spark: SparkSession, path: str) -> DataFrame:
    """One row per host of a YAML inventory; managed is is_managed, else has_logs, else true.

    Needs PyYAML. The file is a bounded configuration file read on the driver.
    """
    try:
        import yaml
    except ImportError as e:
        raise RuntimeError("reading a YAML inventory needs PyYAML") from e
    with open(path, encoding="utf-8") as f:
        hosts = (yaml.safe_load(f) or {}).get("hosts") or []
    if isinstance(hosts, dict):
        hosts = [v | {"hostname": k} for k, v in hosts.items()]
    rows = []
    for h in hosts:
        ips = h.get("ip_addresses") or [h.get("ip_address") or h.get("ipAddress") or h.get("ip")]
        managed = next((h[k] for k in ("is_managed", "has_logs") if h.get(k) is not None), True)
        rows.append((h.get("hostname"), [str(i) for i in ips if i], h.get("role"), h.get("zone"), h.get("has_logs"), bool(managed)))
    return spark.createDataFrame(rows, SCHEMA)
