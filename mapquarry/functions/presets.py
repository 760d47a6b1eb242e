"""Street network presets: what each excludes among ways with a highway tag."""

from __future__ import annotations

# Exact tag values that a network of the kind leaves out.
DRIVING = {
    "area": ["yes"],
    "highway": "cycleway footway path pedestrian steps track corridor elevator escalator proposed construction bridleway abandoned platform raceway".split(),
    "motor_vehicle": ["no"],
    "motorcar": ["no"],
    "service": "parking parking_aisle private emergency_access".split(),
}
WALKING = {
    "area": ["yes"],
    "highway": "cycleway motor proposed construction abandoned platform raceway motorway motorway_link".split(),
    "foot": ["no"],
    "service": ["private"],
}
CYCLING = {
    "area": ["yes"],
    "highway": "footway steps corridor elevator escalator motor proposed construction abandoned platform raceway motorway motorway_link".split(),
    "bicycle": ["no"],
    "service": ["private"],
}
#: By network type; None takes every highway. driving_psv is accepted and resolves to none.
PRESETS = {
    "driving": DRIVING | {"psv": ["yes"]},
    "driving+service": DRIVING,
    "walking": WALKING,
    "cycling": CYCLING,
    "all": None,
    "driving_psv": None,
}
#: Values of oneway that make an edge directed, and those of them against the way's direction.
ONEWAY = ["yes", "true", "1", "-1", "T", "F"]
AGAINST = ["-1", "T"]


def preset(network_type: str) -> dict | None:
    name = network_type.lower().strip()
    if name not in PRESETS:
        raise ValueError(f"network_type {network_type!r} is none of: {', '.join(PRESETS)}")
    return PRESETS[name]
