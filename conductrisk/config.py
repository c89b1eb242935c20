"""Fixed values of the risk rules: thresholds, multipliers, word lists, lookup tables.

Everything here is a business constant that results depend on; nothing is computed.
"""

# --- working hours -----------------------------------------------------------
WORK_START = 7
WORK_END = 20

# --- daily feature contract (order matters for vectors) ----------------------
DAILY_FEATURES = [
    "day_of_week",
    "far", "eds", "iav", "oaf",
    "login_entropy", "file_count", "email_count",
    "file_copy_count", "usb_count", "removable_media_count",
    "delete_count", "after_hours_count", "after_hours_ratio", "event_count",
]
CORE_FEATURES = ["far", "eds", "iav", "oaf", "login_entropy", "file_count", "email_count"]

# --- sequence model ----------------------------------------------------------
SEQUENCE_LENGTH = 10
LABELLED_SEQUENCE_LENGTH = 5
LATENT_SIZE = 32
MODEL_ROLES = ["Employee", "Admin", "Contractor"]
GLOBAL_MODEL = "global"

# --- thresholding ------------------------------------------------------------
TARGET_PERCENTILE = 0.995
STD_MULTIPLIER = 3.0
IQR_MULTIPLIER = 1.5
MIN_SAMPLES = 100
ANOMALY_MEAN = 0.16
ANOMALY_STD = 0.12
TAIL_PERCENTILE = 0.95
TAIL_CONFIDENCE = 0.999
MIN_TAIL_ROWS = 20
FALSE_POSITIVE_COST = 1.0
FALSE_NEGATIVE_COST = 10.0
DRIFT_P_VALUE = 0.05
ROLLING_DAYS = 7
ROLLING_MIN_RECENT = 50

# --- risk scoring ------------------------------------------------------------
BASE_MULTIPLIER = 250.0
THRESHOLD_BASE_RISK = 45.0
Z_SCORE_SLOPE = 25.0
BASELINE_MODEL_SLOPE = 400.0
MAX_RISK = 100.0
ROLE_MULTIPLIERS = {"Admin": 1.5, "Contractor": 1.2, "Employee": 1.0}
AFTER_HOURS_MULTIPLIER = 1.5
AFTER_HOURS_RATIO = 0.3
AFTER_HOURS_MIN_EVENTS = 6
ACTIVITY_MULTIPLIERS = {"File Copy": 4.0, "Connect": 3.0, "File Delete": 2.0}
USB_BOOST = 1.5
REMOVABLE_BOOST = 1.4
COPY_VOLUME_BOOST = 1.3
COPY_VOLUME = 5
AFTER_HOURS_BOOST = 1.2
PATTERN_FLOOR = 85.0

PRODUCTIVITY_PENALTY = 1.3
VELOCITY_MULTIPLIER = 2.0
ENTROPY_CRITICAL_MULTIPLIER = 2.5
ENTROPY_HIGH_MULTIPLIER = 1.5
ENTROPY_MEDIUM_MULTIPLIER = 1.2
TORTUOSITY_LIMIT = 3.0
KEYSTROKE_LIMIT = 0.5

# activity -> tactic id, tactic name, technique id, technique name
TACTICS = {
    "File Copy": ("TA0010", "Exfiltration", "T1052", "Exfiltration Over Physical Medium"),
    "Connect": ("TA0010", "Exfiltration", "T1200", "Hardware Additions"),
    "File Delete": ("TA0040", "Impact", "T1485", "Data Destruction"),
    "After Hours Logon": ("TA0006", "Credential Access", "T1078", "Valid Accounts"),
}

# --- alerts ------------------------------------------------------------------
ALERT_MEDIUM = 70.0
ALERT_HIGH = 85.0
ALERT_CRITICAL = 95.0
ALERT_PERSISTENCE = 2
ALERT_COOLDOWN_HOURS = 24

# --- user roll-up and drift --------------------------------------------------
DECAY_RATE = 0.9
MAX_WEIGHT = 1.0
SUM_WEIGHT = 0.1
BASELINE_DAYS = 14
RECENT_DAYS = 6
DRIFT_SIGMA = 2.0
LOW_VARIANCE_JUMP = 15.0
CORRELATED_ACTIVITIES = [
    ("File Copy", "USB", 0.8),
    ("After Hours", "File Copy", 0.6),
    ("Admin Role", "High Privilege Activity", 0.7),
]

# --- entropy -----------------------------------------------------------------
ENTROPY_WEIGHTS = {"activity": 0.35, "app": 0.25, "domain": 0.25, "temporal": 0.15}
ENTROPY_CUTS = (60.0, 80.0, 95.0)
ROLE_ENTROPY_MULTIPLIERS = {
    "Admin": 1.3, "IT": 1.25, "Contractor": 1.15, "Employee": 1.0, "Analyst": 1.1,
    "Developer": 1.2,
}

# --- live telemetry ----------------------------------------------------------
ROLE_APPS = {
    "Admin": ["powershell", "terminal", "azure", "admin"],
    "Developer": ["vs code", "visual studio", "terminal", "git", "docker"],
    "HR": ["excel", "workday", "successfactors", "hris"],
    "Finance": ["excel", "quickbooks", "sap", "oracle", "bloomberg"],
    "Sales": ["salesforce", "hubspot", "dynamics", "outlook"],
    "Marketing": ["photoshop", "illustrator", "canva", "adobe"],
    "Support": ["zendesk", "freshdesk", "jira", "confluence"],
    "Analyst": ["excel", "tableau", "power bi", "sql", "python"],
    "Designer": ["photoshop", "illustrator", "figma", "sketch"],
    "Manager": ["excel", "powerpoint", "teams", "outlook", "slack"],
    "Contractor": ["vs code", "terminal", "git", "email"],
}
PRODUCTIVE_APPS = [
    "excel", "word", "powerpoint", "teams", "outlook", "vs code", "visual studio", "jira",
    "confluence", "salesforce", "sap", "tableau", "photoshop", "terminal", "git",
]
NEUTRAL_APPS = ["chrome", "firefox", "browser", "calculator", "notepad"]
DISTRACTED_APPS = [
    "netflix", "youtube", "tiktok", "instagram", "facebook", "twitter", "reddit", "steam",
    "discord", "game",
]

# role -> weights of the four live components
ROLE_PROFILES = {
    "Admin": {"productivity": 0.3, "behaviour": 0.3, "entropy": 0.2, "context": 0.2},
    "Developer": {"productivity": 0.4, "behaviour": 0.3, "entropy": 0.2, "context": 0.1},
    "HR": {"productivity": 0.45, "behaviour": 0.25, "entropy": 0.2, "context": 0.1},
    "Manager": {"productivity": 0.35, "behaviour": 0.3, "entropy": 0.2, "context": 0.15},
    "Employee": {"productivity": 0.4, "behaviour": 0.3, "entropy": 0.2, "context": 0.1},
}
LIVE_ROLE_APPS = {
    "Admin": ["admin", "console", "terminal", "powershell", "cmd"],
    "Developer": ["code", "studio", "terminal", "git", "docker", "pycharm", "intellij"],
    "HR": ["excel", "workday", "successfactors", "outlook", "teams"],
    "Manager": ["excel", "powerpoint", "outlook", "teams", "salesforce", "hubspot"],
}
LIVE_PRODUCTIVE_APPS = ["excel", "word", "powerpoint", "outlook", "teams", "slack", "zoom"]
LIVE_DISTRACTED_APPS = [
    "netflix", "youtube", "steam", "facebook", "twitter", "instagram", "tiktok",
]

# keyword lists in priority order -> tactic id, technique id
APP_TACTICS = [
    (["telegram", "signal", "whatsapp"], "TA0010", "T1048"),
    (["dropbox", "googledrive", "onedrive", "mega", "wetransfer"], "TA0010", "T1567"),
    (["7zip", "winrar", "winzip"], "TA0009", "T1560"),
    (["powershell", "cmd.exe", "bash", "terminal", "wscript", "cscript"], "TA0002", "T1059"),
    (["taskmgr", "processhacker", "procmon", "wireshark"], "TA0005", "T1562"),
    (["keepass", "lastpass", "1password", "bitwarden"], "TA0006", "T1555"),
    (["putty", "mobaxterm", "winscp", "filezilla"], "TA0008", "T1021"),
]

# --- posterior ---------------------------------------------------------------
ROLE_PRIORS = {
    "Admin": (7.0, 3.0), "Contractor": (6.0, 4.0), "Employee": (5.0, 5.0), "IT": (6.0, 4.0),
    "Developer": (5.0, 5.0), "Analyst": (5.0, 5.0),
}
DEFAULT_PRIOR = (5.0, 5.0)
ACTIVITY_LIKELIHOODS = [
    ("File Copy", 4.0), ("Connect", 3.0), ("File Delete", 2.5), ("File Write", 1.5), ("Logon", 1.0),
]
TIME_LIKELIHOODS = {"after_hours": 2.0, "weekend": 1.5, "normal": 1.0}
EVIDENCE_WEIGHTS = {
    "anomaly": 0.30, "time": 0.20, "activity": 0.25, "behaviour": 0.15, "integrity": 0.10,
}

# --- privacy -----------------------------------------------------------------
ACCESS_POLICY = [
    # role, level, can_deanonymize, can_erase
    ("Admin", 3, True, False),
    ("Analyst", 2, False, False),
    ("Viewer", 1, False, False),
    ("Compliance", 2, True, True),
]
MASK_LENGTH = 32

# --- feature contract of the event feature set: name, kind, type ---------------
EVENT_FEATURES = [
    ("hour", "cyclical", "float32"), ("day_of_week", "cyclical", "float32"),
    ("is_weekend", "binary", "int8"), ("is_after_hours", "binary", "int8"),
    ("logon_count_1h", "count", "int32"), ("logon_count_24h", "count", "int32"),
    ("file_access_count_1h", "count", "int32"), ("file_access_count_24h", "count", "int32"),
    ("http_count_1h", "count", "int32"), ("device_count_1h", "count", "int32"),
    ("after_hours_ratio", "ratio", "float32"), ("usb_events_7d", "count", "int32"),
    ("file_copy_count_24h", "count", "int32"), ("mouse_velocity", "continuous", "float32"),
    ("mouse_tortuosity", "continuous", "float32"),
    ("keystroke_flight_time", "continuous", "float32"),
    ("keystroke_anomaly_score", "continuous", "float32"),
    ("session_duration", "continuous", "float32"), ("idle_time", "continuous", "float32"),
    ("productive_app_ratio", "ratio", "float32"), ("entropy_risk_level", "ordinal", "category"),
]

# --- evaluation --------------------------------------------------------------
TRUTH_USER = "U5"
TRUTH_START_OFFSET = 25
TRUTH_START_DATE = "2024-01-20"
DETECTION_THRESHOLD = 70.0

# --- output texts: fixed values of result columns, compared by whoever reads them ----------
DRIFT_TEXTS = {
    "no_baseline": "Insufficient baseline data",
    "low_variance_jump": "Recent daily risk %s >> baseline avg=%s (low-variance user)",
    "low_variance": "Within expected range (low variance user)",
    "high": "Recent daily risk %s exceeds baseline (avg=%s, +%s sigma)",
}
PRODUCTIVITY_TEXTS = {
    "permitted": "Using role-permitted app: ",
    "neutral": "Using neutral app: ",
    "distracted": "Distracted by non-work app: ",
    "unknown": "Unknown application: ",
}
DEVIATION_TEXTS = {
    "critical": "CRITICAL: >3σ deviation - Potential account takeover",
    "high": "HIGH: >2σ deviation - Impaired user or different person",
    "moderate": "MODERATE: >1.5σ deviation - Unusual pattern",
    "normal": "NORMAL: Within expected range",
    "no_baseline": "No baseline available",
}
LIVE_FACTOR_TEXTS = {
    "productivity": "Low productivity alignment", "behaviour": "Behavioral anomaly detected",
    "entropy": "Erratic session pattern", "context": "Suspicious time context",
}
LOOKUP_ERRORS = {
    "approval": "Dual-control approval required",
    "unknown_token": "De-pseudonymization not supported: token not found in reverse map",
    "wrong_claim": "Verification failed: recovered ID does not match claimed original ID",
}
ENTROPY_TEXT = [
    "Entropy anomaly detected: Current composite entropy (", ") is {multiplier}x higher than role baseline (",
    "). This suggests erratic, multi-domain activity inconsistent with normal role behavior.",
]
QUALITY_TEXTS = {
    "missing": "High missing ratio: %.2f%%", "cardinality": "High cardinality: ", "unique": " unique values",
    "shift": "Mean shifted by %.1f std devs",
}
