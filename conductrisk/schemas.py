"""Explicit schemas (DDL text) of the data sets, so that no reader infers types."""

LOGON = ("id string, user string, date timestamp, pc string, activity string")
FILE = (
    "id string, user string, date timestamp, pc string, filename string, activity string, "
    "to_removable_media string"
)
HTTP = ("id string, user string, date timestamp, pc string, url string, content string")
DEVICE = ("id string, user string, date timestamp, pc string, activity string")
USERS = ("id string, role string, dept string, pc string")

LOGS = {"logon": LOGON, "file": FILE, "http": HTTP, "device": DEVICE}
ALLOWED_ACTIVITIES = {
    "logon": ["Logon", "Logoff"],
    "file": ["File Open", "File Copy", "File Delete", "File Write"],
    "device": ["Connect", "Disconnect"],
}
REQUIRED_FIELDS = {
    "logon": ["id", "user", "date", "pc", "activity"],
    "file": ["id", "user", "date", "pc", "filename", "activity"],
    "http": ["id", "user", "date", "pc", "url"],
    "device": ["id", "user", "date", "pc", "activity"],
}

TIMELINE = (
    "id string, user string, date timestamp, pc string, source string, activity string"
)
FEEDBACK = ("user_id string, day string, is_false_positive boolean")

TELEMETRY_PAYLOAD = (
    "user_id string, timestamp string, session_id string, "
    "mouse struct<velocity_avg double, velocity_std double, click_count bigint, "
    "positions_count bigint, recent_positions array<struct<x double, y double, "
    "timestamp string, velocity double>>>, "
    "keyboard struct<flight_time_avg_ms double, flight_time_std_ms double, "
    "key_press_count bigint>, "
    "active_window struct<app_name string, window_title string, pid string>"
)

EVENTS = (
    "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, "
    "props string"
)
