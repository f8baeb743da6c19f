"""Fixed schemas of the tables; a reader with the full schema gives null for columns that older files lack."""

POSITIONS = (
    "mmsi long, msgtime timestamp, msgtime_ns long, latitude double, longitude double, speed_over_ground double, course_over_ground double, "
    "rate_of_turn double, true_heading int, navigational_status int, ship_type int, name string, stream string, ingested_at timestamp"
)
POSITION_EVENT = (
    "mmsi long, msgtime string, latitude double, longitude double, speedOverGround double, courseOverGround double, trueHeading int, "
    "rateOfTurn double, navigationalStatus int, shipType int, name string, stream string"
)
HISTORIC = "mmsi long, dateTimeUtc string, latitude double, longitude double, speedOverGround double, courseOverGround double, trueHeading int, rateOfTurn double, navigationalStatus int, shipType int, name string"
VISITS = (
    "run_id string, visit_id string, mmsi long, port_id string, activity_date date, arrival_at timestamp, last_observed_at timestamp, departure_at timestamp, "
    "arrival_censored int, end_reason string, observation_count long, observed_stay_seconds double, updated_at timestamp, is_deleted int"
)
RUNS = "run_id string, window_start timestamp, window_end timestamp, dataset_hash string, parameters string, source_rows long, visit_count long, completed_at timestamp"
METRICS = (
    "run_id string, window_start timestamp, window_end timestamp, snapshot_date date, port_id string, page_rank double, community_id long, "
    "exported_at timestamp, community_name string, community_label string, is_deleted int"
)
FEATURES = (
    "activity_date date, mmsi long, name string, window_minutes int, window_start timestamp, window_end timestamp, position_count long, avg_speed double, "
    "min_speed double, max_speed double, ship_type int, ship_type_name string, ship_category string, last_navigation_status int, last_navigation_status_name string, ingested_at timestamp"
)
GAPS = (
    "activity_date date, event_type string, mmsi long, name string, last_event_msgtime timestamp, previous_event_msgtime timestamp, resumed_event_msgtime timestamp, "
    "last_latitude double, last_longitude double, gap_detected_at timestamp, gap_ended_at timestamp, gap_duration_seconds double, gap_timeout_seconds double, ship_type int, "
    "ship_type_name string, ship_category string, navigation_status int, navigation_status_name string, previous_navigation_status int, previous_navigation_status_name string, "
    "resumed_navigation_status int, resumed_navigation_status_name string, ingested_at timestamp"
)
HISTORICAL_RAW = (
    "date_time_utc timestamp, mmsi int, longitude double, latitude double, status int, course_over_ground decimal(6,2), true_heading int, "
    "speed_over_ground decimal(6,2), rate_of_turn int, maneuvre int, data_source string, ais_class string, msg_type int, geometry binary"
)
