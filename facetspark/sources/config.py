"""Typed options of the pipeline, key files and named intervals."""

from __future__ import annotations

import re
from dataclasses import dataclass, fields

MANDATORY_KEYS = ("root_package", "mol_prefix", "distance_type", "chain_length", "markers", "profile_file")


@dataclass
class Options:
    """Counts of thresholds and levels, and the choices of the detector; the defaults run the scalar blob response."""

    levels: int = 10
    overlap: int = 1
    distance_bins: int = 10
    charge_thresholds: int = 2
    lj_thresholds: int = 2
    area_thresholds: int = 0
    sigma_low: float = 0.33
    sigma_high: float = 2.89
    detector: str = "dog"
    channels_combining: str = "scalar"
    use_levels: bool = True
    alpha: float = 0.05
    reload: bool = False

    @classmethod
    def parse(cls, args: list[str]) -> Options:
        """From "-name value" pairs; a name without a value keeps its default, an unknown one is refused."""
        out, known = cls(), {f.name: f.type for f in fields(cls)}
        at = 0
        while at < len(args):
            name = args[at].removeprefix("-")
            if args[at][:1] != "-" or name not in known:
                raise ValueError(f"unknown option {args[at]}")
            at += 1
            if at == len(args) or re.fullmatch(r"-[a-z_]+", args[at]):
                continue
            kind = {"int": int, "float": float, "str": str, "bool": lambda x: x.lower() in ("1", "true")}[known[name]]
            setattr(out, name, kind(args[at]))
            at += 1
        return out


def parse_keys(text: str, mandatory=MANDATORY_KEYS) -> dict[str, str]:
    """name=value lines; missing mandatory names are refused."""
    found = dict((x.strip() for x in line.split("=", 1)) for line in text.splitlines() if "=" in line)
    if lost := [k for k in mandatory if k not in found]:
        raise ValueError(f"missing: {', '.join(lost)}")
    return found


def parse_intervals(text: str) -> tuple[str, list[tuple[str, float, float]]]:
    """The kind of distance, and (name, low, high) of "a=lo:hi" lines; // begins a comment."""
    kind, found = "", []
    for line in text.splitlines():
        line = line.split("//", 1)[0].strip()
        if line.startswith("distance") and "=" in line:
            kind = line.split("=", 1)[1].strip()
        elif "=" in line and ":" in line:
            name, span = line.split("=", 1)
            low, high = span.split(":", 1)
            found.append((name.strip(), float(low), float(high)))
    return kind, found


def settings_name(prefix: str, number: int, count: int, ending: str) -> str:
    """A file name with the number padded to the width that count needs."""
    return f"{prefix}{str(number).zfill(len(str(max(count - 1, 0))))}.{ending}"
