"""Names that resolve to a code before any dictionary is asked."""

from __future__ import annotations

from ..errors import SpineError

# Map and data spellings with the code each stands for.
OVERRIDES = {
    "Ascension Island": "SHN",
    "Azores": "PRT",
    "Barbuda": "ATG",
    "Bonaire": "BES",
    "Canary Islands": "ESP",
    "Chagos Archipelago": "IOT",
    "Grenadines": "VCT",
    "Heard Island": "HMD",
    "Kosovo": "XKX",
    "Madeira Islands": "PRT",
    "Micronesia": "FSM",
    "Saba": "BES",
    "Saint Martin": "MAF",
    "Siachen Glacier": "IND",
    "Sint Eustatius": "BES",
    "Virgin Islands": "VIR",
    "Saint Barthelemy": "BLM",
    "Curacao": "CUW",
    "Madeira": "PRT",
    "Federated States of Micronesia": "FSM",
    "Micronesia, Fed. Sts.": "FSM",
    "Virgin Islands, U.S.": "VIR",
    "British Virgin Islands": "VGB",
    "Channel Islands": "GBR",
    "Kosovo, Republic of": "XKX",
}


def country_overrides(extra: dict | None = None) -> dict[str, str]:
    """The built-in name -> iso3c map; entries of extra are added and win."""
    if extra is not None and (not isinstance(extra, dict) or any(not isinstance(k, str) or not k for k in extra)):
        raise SpineError("extra overrides must map non-empty names to codes")
    return {**OVERRIDES, **{k: str(v) for k, v in (extra or {}).items()}}
