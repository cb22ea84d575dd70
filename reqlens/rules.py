"""Rule lists of the text taxonomy. Rules are data; the engine is in ``operators.taxonomy``."""

from __future__ import annotations

from typing import NamedTuple


class SubtypeRule(NamedTuple):
    subtype: str
    pattern: str
    columns: tuple[str, ...]
    confidence: str
    source: str
    match_column: str


class OutcomeRule(NamedTuple):
    outcome: str
    pattern: str
    confidence: str


class MismatchRule(NamedTuple):
    complaint_type: str
    suspected_family: str
    pattern: str
    columns: tuple[str, ...]


DESCRIPTOR = ("descriptor_norm",)
DETAILS = ("details_norm",)
COMBINED = ("combined_text",)

# UTF-8 punctuation read as Latin-1, and its replacement.
MISDECODED_SEQUENCES = {
    "â\u0080\u0099": "'",
    "â\u0080\u009c": '"',
    "â\u0080\u009d": '"',
    "â\u0080\u0093": "-",
    "â\u0080\u0094": "-",
    "â\u0080¦": "...",
}

# Families with a subtype taxonomy.
TARGET_FAMILIES = [
    "Illegal Parking",
    "Noise - Residential",
    "HEAT/HOT WATER",
    "Blocked Driveway",
    "Noise - Street/Sidewalk",
    "UNSANITARY CONDITION",
    "Street Condition",
    "Water System",
    "PLUMBING",
    "Dirty Condition",
    "PAINT/PLASTER",
]

# Subtype, pattern, searched columns, confidence, source, column quoted as match text.
SUBTYPE_RULES: dict[str, list[SubtypeRule]] = {
    "Illegal Parking": [
        SubtypeRule("blocked_hydrant", "blocked hydrant|front of fire hydrant|fire hydrant", DESCRIPTOR + DETAILS, "high", "descriptor_or_detail_rule", "descriptor_norm"),
        SubtypeRule("posted_sign_violation", "posted parking sign violation|no standing|no stopping|no parking", DESCRIPTOR + DETAILS, "high", "descriptor_or_detail_rule", "descriptor_norm"),
        SubtypeRule("blocked_sidewalk", "blocked sidewalk|parked on sidewalk", DESCRIPTOR + DETAILS, "high", "descriptor_or_detail_rule", "descriptor_norm"),
        SubtypeRule("commercial_overnight", "commercial overnight parking", DESCRIPTOR, "high", "descriptor_rule", "descriptor_norm"),
        SubtypeRule("overnight_commercial_storage", "overnight commercial storage|commercial storage", DESCRIPTOR + COMBINED, "high", "descriptor_rule", "descriptor_norm"),
        SubtypeRule("detached_trailer", "detached trailer", DESCRIPTOR + COMBINED, "high", "descriptor_rule", "descriptor_norm"),
        SubtypeRule("blocked_crosswalk", "blocked crosswalk|parked in crosswalk", DESCRIPTOR + DETAILS, "high", "descriptor_or_detail_rule", "descriptor_norm"),
        SubtypeRule("double_parked", "double parked blocking traffic|double parked blocking vehicle|double parked", DESCRIPTOR + DETAILS, "high", "descriptor_or_detail_rule", "descriptor_norm"),
        SubtypeRule("permit_misuse", "parking permit improper use", DESCRIPTOR, "high", "descriptor_rule", "descriptor_norm"),
        SubtypeRule("bike_lane_blocking", "blocked bike lane", DESCRIPTOR, "high", "descriptor_rule", "descriptor_norm"),
        SubtypeRule("plate_issue", "license plate obscured|paper license plates", DESCRIPTOR, "high", "descriptor_rule", "descriptor_norm"),
        SubtypeRule("bus_stop_or_layover", "unauthorized bus layover|parked at bus stop", DESCRIPTOR + DETAILS, "high", "descriptor_or_detail_rule", "descriptor_norm"),
    ],
    "Noise - Residential": [
        SubtypeRule("music_party", "loud music/party|party", DESCRIPTOR + COMBINED, "high", "descriptor_rule", "descriptor_norm"),
        SubtypeRule("banging_pounding", "banging/pounding", DESCRIPTOR, "high", "descriptor_rule", "descriptor_norm"),
        SubtypeRule("loud_talking", "loud talking", DESCRIPTOR, "high", "descriptor_rule", "descriptor_norm"),
        SubtypeRule("television", "loud television", DESCRIPTOR, "high", "descriptor_rule", "descriptor_norm"),
    ],
    "HEAT/HOT WATER": [
        SubtypeRule("no_heat", "^no heat$", DETAILS, "high", "additional_details_rule", "details_norm"),
        SubtypeRule("no_heat_no_hot_water", "no heat and no hot water", DETAILS, "high", "additional_details_rule", "details_norm"),
        SubtypeRule("no_hot_water", "^no hot water$", DETAILS, "high", "additional_details_rule", "details_norm"),
        SubtypeRule("heat_on_in_summer", "heat on in summer", DETAILS, "high", "additional_details_rule", "details_norm"),
    ],
    "Blocked Driveway": [
        SubtypeRule("no_access", "^no access$", DESCRIPTOR, "high", "descriptor_rule", "descriptor_norm"),
        SubtypeRule("partial_access", "^partial access$", DESCRIPTOR, "high", "descriptor_rule", "descriptor_norm"),
    ],
    "Noise - Street/Sidewalk": [
        SubtypeRule("music_party", "loud music/party|party", DESCRIPTOR + COMBINED, "high", "descriptor_rule", "descriptor_norm"),
        SubtypeRule("loud_talking", "loud talking", DESCRIPTOR, "high", "descriptor_rule", "descriptor_norm"),
    ],
    "UNSANITARY CONDITION": [
        SubtypeRule("pests", "^pests$|roaches|mice|rats|vermin|rodent", DESCRIPTOR + DETAILS + COMBINED, "high", "descriptor_or_detail_rule", "descriptor_norm"),
        SubtypeRule("mold", "^mold$|mold|fungus", DESCRIPTOR + COMBINED, "high", "descriptor_rule", "descriptor_norm"),
        SubtypeRule("garbage_storage", "garbage/recycling storage|garbage|recycling", DESCRIPTOR + COMBINED, "high", "descriptor_or_detail_rule", "descriptor_norm"),
        SubtypeRule("sewage", "^sewage$|sewage", DESCRIPTOR + COMBINED, "high", "descriptor_rule", "descriptor_norm"),
    ],
    "Street Condition": [
        SubtypeRule("pothole", "^pothole$|pothole", DESCRIPTOR + COMBINED, "high", "descriptor_rule", "descriptor_norm"),
        SubtypeRule("cave_in", "cave-in|cave in", DESCRIPTOR + COMBINED, "high", "descriptor_rule", "descriptor_norm"),
        SubtypeRule("defective_hardware", "defective hardware", DESCRIPTOR, "high", "descriptor_rule", "descriptor_norm"),
        SubtypeRule("construction_blockage", "blocked - construction|construction waste|after repaving", DESCRIPTOR + COMBINED, "high", "descriptor_or_detail_rule", "descriptor_norm"),
        SubtypeRule("failed_repair", "failed street repair|wear & tear|wear tear", DESCRIPTOR + COMBINED, "medium", "combined_text_rule", "descriptor_norm"),
        SubtypeRule("rough_or_noisy_road", "rough pitted or cracked roads|plate condition - noisy|plate condition - shifted", DESCRIPTOR + COMBINED, "medium", "descriptor_rule", "descriptor_norm"),
        SubtypeRule("faded_markings", "line/marking - faded|marking faded|line marking", DESCRIPTOR + COMBINED, "high", "descriptor_rule", "descriptor_norm"),
        SubtypeRule("crash_cushion_defect", "crash cushion defect|crash cushion|cushion defect", DESCRIPTOR + COMBINED, "high", "descriptor_rule", "descriptor_norm"),
        SubtypeRule("guard_rail_issue", "guard rail - street|guard rail", DESCRIPTOR + COMBINED, "high", "descriptor_rule", "descriptor_norm"),
        SubtypeRule("unsafe_worksite", "unsafe worksite", DESCRIPTOR, "high", "descriptor_rule", "descriptor_norm"),
        SubtypeRule("surface_depression", "depression maintenance|hummock", DESCRIPTOR + COMBINED, "medium", "descriptor_rule", "descriptor_norm"),
        SubtypeRule("plate_condition_open_or_skid", "plate condition - open|plate condition - anti-skid", DESCRIPTOR + COMBINED, "high", "descriptor_rule", "descriptor_norm"),
        SubtypeRule("defacement", "^defacement$", DESCRIPTOR, "high", "descriptor_rule", "descriptor_norm"),
        SubtypeRule("strip_paving", "^strip paving$", DESCRIPTOR, "high", "descriptor_rule", "descriptor_norm"),
        SubtypeRule("maintenance_cover", "^maintenance cover$", DESCRIPTOR, "high", "descriptor_rule", "descriptor_norm"),
    ],
    "Water System": [
        SubtypeRule("hydrant_running", "hydrant running|hydrant leaking|hydrant defective|hydrant knocked over|fire hydrant emergency", DESCRIPTOR + COMBINED, "high", "descriptor_rule", "descriptor_norm"),
        SubtypeRule("dirty_water", "dirty water", DESCRIPTOR + COMBINED, "high", "descriptor_rule", "descriptor_norm"),
        SubtypeRule("system_leak", "leak|water main break|basement", DESCRIPTOR + COMBINED, "medium", "combined_text_rule", "descriptor_norm"),
        SubtypeRule("no_water", "^no water$|no water", DESCRIPTOR + COMBINED, "high", "descriptor_rule", "descriptor_norm"),
        SubtypeRule("low_pressure", "low water pressure", DESCRIPTOR + COMBINED, "high", "descriptor_rule", "descriptor_norm"),
        SubtypeRule("valve_box_cover_missing", "hyd valve box cover missing|wv2", DESCRIPTOR + DETAILS + COMBINED, "high", "descriptor_or_detail_rule", "descriptor_norm"),
        SubtypeRule("hydrant_side_post_installation", "installation of hydrant side post|whfp", DESCRIPTOR + DETAILS + COMBINED, "high", "descriptor_or_detail_rule", "descriptor_norm"),
        SubtypeRule("high_pressure", "high water pressure", DESCRIPTOR + COMBINED, "high", "descriptor_rule", "descriptor_norm"),
    ],
    "PLUMBING": [
        SubtypeRule("no_water", "^no water$", DETAILS, "high", "additional_details_rule", "details_norm"),
        SubtypeRule("faucet_issue", "faucet broken/missing/leaking", DETAILS, "high", "additional_details_rule", "details_norm"),
        SubtypeRule("broken_missing_fixture", "broken or missing", DETAILS, "high", "additional_details_rule", "details_norm"),
        SubtypeRule("drain_blocked", "drain pipe blocked or broken|bowl stopped up", DETAILS + COMBINED, "high", "additional_details_rule", "details_norm"),
        SubtypeRule("no_hot_water", "^no hot water$|scalding hot water", DETAILS, "high", "additional_details_rule", "details_norm"),
        SubtypeRule("basin_or_pipe_leak", "basin broken/leaking|pipe leaking|cracked or leaking", DETAILS + COMBINED, "high", "additional_details_rule", "details_norm"),
        SubtypeRule("low_pressure", "low water pressure", DETAILS, "high", "additional_details_rule", "details_norm"),
        SubtypeRule("chipped_or_rusted_fixture", "chipped or rusted|chipped rusted", DETAILS + COMBINED, "high", "additional_details_rule", "details_norm"),
        SubtypeRule("sink_detached_from_wall", "sink detached from wall|detached from wall", DETAILS + COMBINED, "high", "additional_details_rule", "details_norm"),
        SubtypeRule("toilet_runs_continuously", "continuously runs|toilet continuously runs", DETAILS + COMBINED, "high", "additional_details_rule", "details_norm"),
        SubtypeRule("leak_into_other_apartment", "leaking into other apartment", DETAILS + COMBINED, "high", "additional_details_rule", "details_norm"),
        SubtypeRule("steam_pipe_or_riser", "steam pipe/riser|pipe riser|steam pipe|riser", DESCRIPTOR + COMBINED, "medium", "combined_text_rule", "descriptor_norm"),
        SubtypeRule("loose_or_wobbly_toilet", "bowl loose or wobbly|loose or wobbly", DETAILS + COMBINED, "high", "additional_details_rule", "details_norm"),
        SubtypeRule("no_cold_water", "no cold water", DETAILS + COMBINED, "high", "additional_details_rule", "details_norm"),
        SubtypeRule("radiator_valve_issue", "shut off valve broken|loose or disconnected", DETAILS + COMBINED, "medium", "additional_details_rule", "details_norm"),
        SubtypeRule("toilet_disconnected", "^disconnected$", DETAILS, "high", "additional_details_rule", "details_norm"),
        SubtypeRule("basin_missing", "^basin missing$", DETAILS, "high", "additional_details_rule", "details_norm"),
        SubtypeRule("radiator_missing_or_removed", r"radiator \| missing or removed|radiator missing or removed", COMBINED, "high", "combined_text_rule", "descriptor_norm"),
        SubtypeRule("toilet_removed_or_missing", "bowl removed or missing", DETAILS, "high", "additional_details_rule", "details_norm"),
        SubtypeRule("boiler_broken", r"boiler \| broken|boiler broken", COMBINED, "high", "combined_text_rule", "descriptor_norm"),
        SubtypeRule("sewer_blocked_or_broken", "broken or blocked pipe|broken or blocked drain", DETAILS, "high", "additional_details_rule", "details_norm"),
    ],
    "Dirty Condition": [
        SubtypeRule("littering", "littering", DETAILS + COMBINED, "high", "additional_details_rule", "details_norm"),
        SubtypeRule("owner_not_cleaned", "not cleaned by property owner", DETAILS, "high", "additional_details_rule", "details_norm"),
        SubtypeRule("dog_waste", "not picked up by dog owner", DETAILS, "high", "additional_details_rule", "details_norm"),
        SubtypeRule("dirt_or_gravel", "dirt or gravel|dirt gravel", DESCRIPTOR + COMBINED, "high", "descriptor_rule", "descriptor_norm"),
        SubtypeRule("broken_glass", "broken glass", DESCRIPTOR + COMBINED, "high", "descriptor_rule", "descriptor_norm"),
        SubtypeRule("syringes", "^syringes$|syringes", DESCRIPTOR + COMBINED, "high", "descriptor_rule", "descriptor_norm"),
        SubtypeRule("car_accident_debris", "debris from car accident|car accident", DESCRIPTOR + COMBINED, "high", "descriptor_rule", "descriptor_norm"),
    ],
    "PAINT/PLASTER": [
        SubtypeRule("chipped_flaking", "chipped/peeling/flaking|peeling or flaking paint", DETAILS + COMBINED, "high", "additional_details_rule", "details_norm"),
        SubtypeRule("bulging_cracked", "bulging/hole/cracked|hole or cracked", DETAILS + COMBINED, "high", "additional_details_rule", "details_norm"),
        SubtypeRule("collapse_risk", "collapsing or falling", DETAILS, "high", "additional_details_rule", "details_norm"),
        SubtypeRule("dirty_unsanitary", "dirty or unsanitary", DETAILS, "high", "additional_details_rule", "details_norm"),
        SubtypeRule("tile_broken_missing", "tile broken or missing", DETAILS, "high", "additional_details_rule", "details_norm"),
    ],
}

# Labels whose text reads like another family.
MISMATCH_RULES = [
    MismatchRule("Illegal Parking", "Noise", "loud music/party|banging/pounding|loud talking|loud television", DESCRIPTOR + COMBINED),
]

# Closure language, first match wins.
OUTCOME_RULES = [
    OutcomeRule("duplicate_report", "duplicate of a building-wide condition|duplicate of", "high"),
    OutcomeRule("unable_to_access_or_inspect", "unable to gain access|unable to complete the inspection|not able to gain access", "high"),
    OutcomeRule("summons_issued", "issued a summons|police issued a summons", "high"),
    OutcomeRule("violation_issued", "violations were issued|violation descriptions", "high"),
    OutcomeRule("condition_corrected", "condition was corrected|conditions were corrected|took action to fix the condition|corrected without the need to issue a summons", "high"),
    OutcomeRule("no_evidence_observed", "observed no evidence of the violation|observed no criminal violation|observed no evidence", "high"),
    OutcomeRule("no_action_needed", "police action was not necessary|action was not necessary", "high"),
    OutcomeRule("no_violation_found", "did not violate the housing laws|no criminal violation existed|no violation existed", "high"),
    OutcomeRule("external_status_or_referral", "website|learn more|status for this request is available|please call| email ", "medium"),
    OutcomeRule("inspection_completed", "conducted an inspection|inspected this condition|inspection results", "medium"),
]

# Outcome of unmatched and of missing closure text.
OTHER_OUTCOME = ("other_resolution_language", "low")
NO_TEXT_OUTCOME = ("no_resolution_text", "not_applicable")
