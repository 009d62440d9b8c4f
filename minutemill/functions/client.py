"""Who sent a request: the key that quotas are counted by."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values: `host:port` and `[v6 host]:port`. Anything else is not a host with a port.
HOST_PORT = r"^(?:\[([^\[\]]*)\]|([^:\[\]]*)):([^:\[\]]*)$"


def client_key(api_key: Column, remote_addr: Column) -> Column:
    """The API key if there is one, else the address without its port, else the raw address."""
    host = F.when(
        remote_addr.rlike(HOST_PORT),
        F.concat(F.regexp_extract(remote_addr, HOST_PORT, 1), F.regexp_extract(remote_addr, HOST_PORT, 2)),
    )
    return F.coalesce(F.nullif(api_key, F.lit("")), host, remote_addr, F.lit("unknown"))
