"""Which addresses a fetch may reach, and the names behind them: resolved once, all answers public, only those dialled."""

from __future__ import annotations

import ipaddress
import socket

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


class PrivateNetworkBlocked(Exception):
    """A host is, or resolves to, an address that is not public."""


class FetchError(Exception):
    """A capture failed."""


class RobotsDisallowed(FetchError):
    """robots.txt forbids the capture; it is not tried again."""

    def __init__(self, page: str) -> None:
        super().__init__(f"robots.txt disallows {page}")
        self.url = page


_SHARED_4, *_TUNNELS_6 = map(ipaddress.ip_network, "100.64.0.0/10 64:ff9b:1::/48 64:ff9b::/96 2001::/32 2002::/16".split())


def is_private(address: str) -> bool:
    """Whether an IP literal is none of the public internet; tunnels and translated ranges count as private."""
    ip = ipaddress.ip_address(address.split("%")[0])
    ip = getattr(ip, "ipv4_mapped", None) or ip
    if any(getattr(ip, f"is_{kind}") for kind in "unspecified reserved multicast link_local private loopback".split()):
        return True
    return any(ip in net for net in ([_SHARED_4] if ip.version == 4 else _TUNNELS_6))


def check_literal(host: str) -> None:
    """Refuses private IP literals; names pass."""
    try:
        bad = is_private(host.strip("[]"))
    except ValueError:
        return
    if bad:
        raise PrivateNetworkBlocked(f"{host} is not a public address")


def public_addresses(host: str, port: int) -> list[str]:
    """The distinct addresses of a host; one private answer refuses them all."""
    check_literal(host)
    found = list(dict.fromkeys(a[4][0] for a in socket.getaddrinfo(host.strip("[]"), port, type=socket.SOCK_STREAM)))
    for address in found:
        if is_private(address):
            raise PrivateNetworkBlocked(f"{host} resolves to {address}, which is not public")
    return found


def is_blocked(host: Column) -> Column:
    """Whether a host column holds a private IP literal."""

    @F.pandas_udf("boolean")
    def run(hosts: pd.Series) -> pd.Series:
        def one(h: str | None) -> bool:
            try:
                return h is not None and is_private(h.strip("[]"))
            except ValueError:
                return False

        return hosts.map(one).astype(bool)

    return run(host)
