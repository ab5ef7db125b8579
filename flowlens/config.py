"""Dataset descriptors, label taxonomies and default parameters.

Fixed values: the label lists, taxonomies, display names, feature names and thresholds
below must be these exact values for results to match the behaviour being rebuilt.
They are given in their natural order.
"""

from __future__ import annotations

from dataclasses import dataclass, field

# ---------------------------------------------------------------------------
# Fixed values
# ---------------------------------------------------------------------------

# Dataset family -> (label column, normal label, per-family attack lists).
# Raw label -> family taxonomy per dataset (declared, applied by LB11).
KDD_TRAIN_TAXONOMY = {
    "DoS": ["neptune", "smurf", "back", "teardrop", "pod", "land"],
    "Probe": ["satan", "ipsweep", "nmap", "portsweep"],
    "R2L": ["guess_passwd", "ftp_write", "imap", "phf", "multihop", "warezmaster", "warezclient", "spy"],
    "U2R": ["buffer_overflow", "loadmodule", "rootkit", "perl"],
}
KDD_TEST_TAXONOMY = {
    "DoS": ["neptune", "smurf", "back", "teardrop", "pod", "land", "apache2", "udpstorm", "processtable", "worm"],
    "Probe": ["satan", "ipsweep", "nmap", "portsweep", "mscan", "saint"],
    "R2L": ["guess_passwd", "ftp_write", "imap", "phf", "multihop", "warezmaster", "warezclient", "spy", "named",
            "snmpguess", "xlock", "xsnoop", "sendmail", "snmpgetattack"],
    "U2R": ["buffer_overflow", "loadmodule", "rootkit", "perl", "sqlattack", "xterm", "ps", "httptunnel"],
}
UNSW_TAXONOMY = {
    "DoS": [],
    "Probe": ["Reconnaissance"],
    "R2L": ["Exploits", "Generic", "Shellcode", "Worms"],
    "U2R": ["Backdoor", "Analysis", "Fuzzers"],
}
# The CIC web-attack names carry a damaged dash in the source configuration; we store
# them with a plain en dash and match web attacks by prefix + suffix (see labels.py).
CIC_TAXONOMY = {
    "DoS": ["DoS Hulk", "DoS GoldenEye", "DoS Slowloris", "DoS Slowhttptest"],
    "DDoS": ["DDoS"],
    "Probe": ["PortScan"],
    "R2L": ["Bot", "Infiltration", "Web Attack – Brute Force", "Web Attack – XSS",
            "Web Attack – Sql Injection"],
    "U2R": ["FTP-Patator", "SSH-Patator"],
}

# Ordered substring rules for the multi-class attack type (first match wins).
KDD_CATEGORY_RULES = [
    ("Normal", ["normal"]),
    ("DoS", ["neptune", "smurf", "back", "teardrop", "pod", "land", "apache2", "udpstorm", "processtable", "worm"]),
    ("Probe", ["satan", "ipsweep", "nmap", "portsweep", "mscan", "saint"]),
    ("R2L", ["guess_passwd", "ftp_write", "imap", "phf", "multihop", "warezmaster", "warezclient", "spy", "named",
             "snmpguess"]),
    ("U2R", ["buffer_overflow", "loadmodule", "rootkit", "perl", "sqlattack", "xterm", "ps", "httptunnel"]),
]
CIC_CATEGORY_RULES = [
    ("Normal", ["benign"]),
    ("DoS", ["dos", "ddos", "hulk", "slowloris", "goldeneye"]),
    ("Probe", ["portscan", "scan"]),
    ("BruteForce", ["patator", "brute"]),
    ("WebAttack", ["xss", "sql", "web"]),
    ("Botnet", ["bot"]),
    ("Infiltration", ["infiltration"]),
]
OTHER_CATEGORY = "Other"

# UNSW attack category -> attack type (exact match; unmapped -> Other).
UNSW_CATEGORY_MAP = {
    "Normal": "Normal",
    "Reconnaissance": "Probe",
    "Exploits": "Exploit",
    "Generic": "Malware",
    "Shellcode": "Malware",
    "Worms": "Malware",
    "Backdoor": "Backdoor",
    "Analysis": "Analysis",
    "Fuzzers": "Fuzzer",
}
# Non-strict mode also maps DoS (the strict map leaves it to Other).
UNSW_CATEGORY_EXTRA = {"DoS": "DoS"}

# Unified label id -> display name.
UNIFIED_LABELS = {0: "Normal", 1: "DoS/DDoS", 2: "Probe/Scanning", 3: "Privilege Escalation", 4: "Malware/Exploit"}
UNKNOWN_LABEL = "Unknown"

# Indicators for the estimated label when only an alternative label column exists.
NORMAL_INDICATORS = ["normal", "benign", "legitimate", "0", "false"]
# Name fragments that mark an alternative label column.
ALT_LABEL_FRAGMENTS = ["label", "attack", "target"]
# Exact names (lower case) that mark a label column in the monolithic loaders.
EXACT_LABEL_NAMES = ["label", "target", "class"]
# Normal markers for the is_attack flag.
NORMAL_MARKERS = ["normal", "benign"]

# Canonical 41 KDD feature names.
KDD_FEATURES = [
    "duration", "protocol_type", "service", "flag", "src_bytes", "dst_bytes", "land", "wrong_fragment", "urgent",
    "hot", "num_failed_logins", "logged_in", "num_compromised", "root_shell", "su_attempted", "num_root",
    "num_file_creations", "num_shells", "num_access_files", "num_outbound_cmds", "is_host_login", "is_guest_login",
    "count", "srv_count", "serror_rate", "srv_serror_rate", "rerror_rate", "srv_rerror_rate", "same_srv_rate",
    "diff_srv_rate", "srv_diff_host_rate", "dst_host_count", "dst_host_srv_count", "dst_host_same_srv_rate",
    "dst_host_diff_srv_rate", "dst_host_same_src_port_rate", "dst_host_srv_diff_host_rate", "dst_host_serror_rate",
    "dst_host_srv_serror_rate", "dst_host_rerror_rate", "dst_host_srv_rerror_rate",
]

# Feature-engineering column groups.
TIME_COLUMNS = ["duration", "response_time", "timestamp"]
COUNT_COLUMNS = ["count", "srv_count", "dst_host_count", "dst_host_srv_count"]
SERVICE_RATE_COLUMNS = ["same_srv_rate", "diff_srv_rate", "srv_diff_host_rate"]
ERROR_RATE_PAIR = ["serror_rate", "srv_serror_rate"]

# Thresholds and parameters.
ATTACK_THRESHOLD = 0.55          # realtime rule: attack iff p_attack > 0.55
ALERT_CONFIDENCE = 0.7           # production alert gate: predicted attack and p > 0.7
ANOMALY_SCORE_ALERT = 0.85       # README anomaly threshold
README_ENSEMBLE_WEIGHTS = [0.4, 0.3, 0.3]
HIGH_CARDINALITY = 100           # strings with more distinct values are dropped
FEATURE_CAP = 50                 # first N numeric columns per source
ENTROPY_BINS = 10
ENTROPY_EPS = 1e-10
QUANTILE_BINS = 5
PCA_COMPONENTS = 50
CONTAMINATION = 0.1
SEED = 42
TEST_FRACTION = 0.2
CV_FOLDS = 5
SEVERITY_CRITICAL_TYPES = ["DDoS", "DoS", "U2R"]
SEVERITY_BANDS = (0.9, 0.7)      # confidence >= .9 High, >= .7 Medium, else Low
GRADE_ACCURACY_BANDS = (0.95, 0.90, 0.80)
GRADE_TYPE_BANDS = (0.9, 0.7)
ATTACK_RATE_LOW, ATTACK_RATE_HIGH = 5.0, 70.0
RECENT_ALERTS = 10
ALERT_INFO_CHARS = 100

# Random-forest presets of the different training scripts: (trees, depth, min leaf).
RF_PRESETS = {
    "binary": (100, 10, 1),
    "advanced": (200, 15, 1),
    "complete": (100, 15, 1),
    "training": (200, 20, 2),
}
GBT_PRESET = (100, 5, 0.1)       # rounds, depth, learning rate


# ---------------------------------------------------------------------------
# Dataset descriptors
# ---------------------------------------------------------------------------

@dataclass(frozen=True)
class DatasetSpec:
    """Where a labelled flow dataset lives and how its label reads."""
    name: str
    path: str
    label_column: str
    normal_label: str
    taxonomy: dict = field(default_factory=dict)
    fmt: str = ""                 # '' -> by suffix
    drop_columns: tuple = ()      # id / secondary label columns never used as features

    @property
    def format(self) -> str:
        if self.fmt:
            return self.fmt
        return "csv" if self.path.lower().endswith(".csv") else "parquet"


def default_datasets(root: str) -> dict[str, DatasetSpec]:
    """The five datasets of the reference layout, rooted at ``root``."""
    root = root.rstrip("/")
    return {
        "nsl_kdd_train": DatasetSpec("NSL-KDD Train", f"{root}/KDDTrain.parquet", "target", "normal",
                                     KDD_TRAIN_TAXONOMY),
        "nsl_kdd_test": DatasetSpec("NSL-KDD Test", f"{root}/KDDTest.parquet", "target", "normal",
                                    KDD_TEST_TAXONOMY),
        "unsw_train": DatasetSpec("UNSW-NB15 Train", f"{root}/UNSW_NB15_training-set.parquet", "attack_cat",
                                  "Normal", UNSW_TAXONOMY, drop_columns=("label", "id")),
        "unsw_test": DatasetSpec("UNSW-NB15 Test", f"{root}/UNSW_NB15_testing-set.parquet", "attack_cat",
                                 "Normal", UNSW_TAXONOMY, drop_columns=("label", "id")),
        "cicids2017": DatasetSpec("CIC-IDS2017", f"{root}/cicids2017_cleaned.csv", "Label", "BENIGN",
                                  CIC_TAXONOMY),
    }
