"""Constants of the safety model. All values here are fixed: results must equal those of the rules they define."""

from __future__ import annotations

EARTH_RADIUS_M = 6_371_008.8

# Facility classes, worst to best.
INFRA = ["none", "pedestrian", "shared_lane", "painted_lane", "buffered_lane", "path", "protected_track"]
SEPARATED = ["path", "protected_track"]
# Rank of a facility attached to a road.
INFRA_RANK = {"none": 0, "shared_lane": 1, "painted_lane": 2, "buffered_lane": 3, "protected_track": 4}

# Ways that cyclists may ride by default, those that need permission, service roads never used.
ALLOWED_HIGHWAYS = ["cycleway", "path", "track", "residential", "living_street", "unclassified", "service", "road", "tertiary", "tertiary_link", "secondary", "secondary_link", "primary", "primary_link", "trunk", "trunk_link"]
PERMISSION_HIGHWAYS = ["footway", "pedestrian", "bridleway"]
EXCLUDED_SERVICE = ["parking_aisle", "driveway", "drive-through", "drive_through", "emergency_access"]
BICYCLE_BARRED = ["no", "private", "dismount", "use_sidepath"]
BICYCLE_ALLOWED = ["yes", "designated", "permissive", "destination"]
TRUTHY = ["yes", "true", "1", "designated", "official"]
FALSY = ["no", "false", "0"]

# Road classes by tag, surfaces by tag.
HIGHWAYS = ["cycleway", "path", "footway", "track", "pedestrian", "living_street", "service", "residential", "unclassified", "tertiary", "secondary", "primary", "trunk"]
LINKS = ["tertiary", "secondary", "primary", "trunk"]
SURFACES = {
    "paved": ["asphalt", "concrete", "paved", "paving_stones", "chipseal", "concrete:plates"],
    "compacted": ["compacted", "fine_gravel", "gravel:fine", "pebblestone"],
    "loose": ["gravel", "dirt", "ground", "earth", "grass", "unpaved", "cobblestone", "sett", "wood"],
    "bad": ["sand", "mud"],
}
CONTROLS = ["none", "signal", "stop", "yield", "crossing", "roundabout"]

# Speed (mph) and lanes where a road has no tag for them.
DEFAULT_SPEED = {"living_street": 15, "service": 15, "residential": 30, "unclassified": 30, "tertiary": 35, "secondary": 40, "primary": 45, "trunk": 55}
DEFAULT_LANES = {"living_street": 2, "service": 2, "residential": 2, "unclassified": 2, "tertiary": 2, "secondary": 4, "primary": 4, "trunk": 4}
OTHER_SPEED, OTHER_LANES = 30, 2

# Edge cost. Lists run over stress levels 0 (unscored) to 4.
LTS_PENALTY = [3.0, 0.0, 0.35, 1.6, 5.0]
LTS_QUALITY = [0.3, 1.0, 0.8, 0.35, 0.0]
LTS_NAMES = ["unknown", "lts1", "lts2", "lts3", "lts4"]
OVER_PENALTY = 12.0
SURFACE_PENALTY = {"unknown": 0.0, "paved": 0.0, "compacted": 0.25, "loose": 1.2, "bad": 4.0}
CRASH_SCALE, HAZARD_SCALE, UNLIT_PENALTY = 2.5, 1.5, 0.8
GRADE_DEADBAND, CLIMB_PER_PCT, DESCENT_PER_PCT, STEEP_DESCENT, STEEP_DESCENT_PENALTY = 3.0, 0.12, 0.06, 8.0, 0.6

# Turn cost.
TURN_BASE = {"straight": 4.0, "right": 10.0, "left": 40.0}
UTURN_M, STRAIGHT_DEG = 300.0, 35.0
CROSSING_FACTOR = [1.5, 0.3, 0.6, 1.5, 4.0]
CONTROL_FACTOR = {"none": 1.0, "signal": 0.25, "stop": 0.7, "yield": 0.85, "crossing": 0.5, "roundabout": 0.8}
PROTECTED_FACTOR = 0.15

# Crash pressure.
CRASH_RADIUS_M, CRASH_HALF_LIFE_YEARS, CRASH_DECAY_M, CRASH_SATURATION, SEPARATED_DISCOUNT = 25.0, 4.0, 12.0, 6.0, 0.25
SEVERITY_WEIGHT = [0.5, 1.0, 2.5, 6.0, 12.0]
MIN_LENGTH_UNITS = 0.3

# Hazard reports.
HAZARD_WEIGHT = {"debris": 0.4, "pothole": 0.5, "poor_visibility": 0.6, "aggressive_traffic": 0.7, "blocked_lane": 0.8, "construction": 0.9, "dangerous_junction": 1.0, "other": 0.3}
HAZARD_RADIUS_M, HAZARD_DECAY_M, HAZARD_SATURATION = 30.0, 15.0, 1.5
HAZARD_DAYS, CONFIRM_DAYS, CONFIRM_WEIGHT, CONFIRM_MOST = 90, 14, 0.25, 8
NOTES_BYTES = 500

# Terrain, snapping, routes.
GRADE_CLAMP_PCT, GRADE_MIN_LENGTH_M, TILE_ZOOM, TILE_SIZE = 25.0, 20.0, 13, 256
SNAP_CANDIDATES, SNAP_MOST_M = 10, 1000.0
CRUISE_KMH = 15.0
ALTERNATIVE_PENALTY, MAX_OVERLAP, MAX_COST_RATIO, MAX_ATTEMPTS = 2.0, 0.7, 1.6, 6
BUDGET_BUCKETS, BUDGET_BUCKETS_MOST = 4, 16
EXPANSIONS_MOST = 4_000_000

# What is shown to riders.
SNAP_TOLD_M, M_PER_MILE, M_PER_FOOT = 25.0, 1609.344, 0.3048
