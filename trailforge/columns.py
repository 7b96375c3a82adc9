"""Names of derived columns and the vocabularies of states."""

from __future__ import annotations

# time
TIMESTAMP = "trk_timestamp"
PARTITION = "trk_partition"
# fragments
FRAGMENT_ID = "frag_id"
NB_POINTS = "frag_nb_points"
TRAIL = "frag_trail"
DURATION = "frag_duration_s"
START = "frag_start"
END = "frag_end"
CENTER = "frag_center"
END_LAT = "frag_end_lat"
END_LON = "frag_end_lon"
CENTER_LAT = "frag_center_lat"
CENTER_LON = "frag_center_lon"
CENTER_LAT_STD = "frag_center_lat_std"
CENTER_LON_STD = "frag_center_lon_std"
PRECISION_TRAIL = "frag_precision_trail"
DISTANCE = "frag_distance_m"
STRAIGHT = "frag_straight_line_m"
STRAIGHTNESS = "frag_straightness"
SPEED = "frag_speed_mps"
BEARING = "frag_bearing"
VISIBILITY = "frag_visibility_proportion"
VISIBILITY_CHANGE = "frag_visibility_change"
SAMPLE_ID = "frag_sample_id"
AVERAGED = "frag_"
# states
GAP_STATE = "gap_state"
MOVING_STATE = "moving_state"
COURSE_OR_STOP = "course_or_stop"
COURSE_STATE = "course_state"
MOTION_ID = "motion_id"
MOTION_DURATION = "motion_duration_s"
COURSE_ID = "course_id"
COURSE_DURATION = "course_duration_s"
TEMPO = "tempo"
TEMPO_MULTI = "tempo_is_multi"
MISSION = "mission_"
DEPARTURE = "departure_"
ARRIVAL = "arrival_"
ADDRESS_FIELDS = ("state", "postcode", "county", "country", "country_code", "city")

STILL, MOVE, GAP, NOT_GAP = "STILL", "MOVE", "GAP", "not_a_gap"
STOP, COURSE = "STOP", "COURSE"
MOTION, PAUSE = "MOTION", "PAUSE"
APPEAR, DISAPPEAR, APPEAR_DISAPPEAR = "appear", "disappear", "appear_disappear"
IRREGULAR, UNKNOWN = "tempo_irregular", "Unknown"
