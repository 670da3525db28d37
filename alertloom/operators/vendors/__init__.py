"""Vendor registry.  To add a vendor, write ``leaves`` and ``build`` and register it."""

from __future__ import annotations

from alertloom.operators.vendors import (
    crowdstrike,
    expel,
    logrhythm,
    microsoft,
    paloalto,
    sentinel,
    splunk,
    trendmicro,
)
from alertloom.operators.vendors.common import Vendor

BUILT_IN: tuple[Vendor, ...] = (
    crowdstrike.VENDOR,
    splunk.VENDOR,
    paloalto.VENDOR,
    microsoft.VENDOR,
    logrhythm.VENDOR,
    sentinel.VENDOR,
    trendmicro.VENDOR,
    expel.VENDOR,
)


def registry(vendors: tuple[Vendor, ...] = BUILT_IN) -> dict[str, str]:
    """Source name as written in alerts -> vendor name."""
    names: dict[str, str] = {}
    for vendor in vendors:
        for alias in (vendor.name, *vendor.aliases):
            if names.setdefault(alias, vendor.name) != vendor.name:
                raise ValueError(f"source {alias!r} is claimed by two vendors")
    return names
