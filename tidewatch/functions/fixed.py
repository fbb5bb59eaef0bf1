"""Fixed values that results depend on: labels, feature lists, weights, thresholds."""

from __future__ import annotations

# Dataset label -> class, profile v3.
LABELS_V3 = {
    "BENIGN": "Benign",
    "DoS Hulk": "DoS",
    "DoS GoldenEye": "DoS",
    "DoS slowloris": "DoS",
    "DoS Slowhttptest": "DoS",
    "PortScan": "PortScan",
    "Port Scan": "PortScan",
}
# Profile v2 also maps DDoS.
LABELS_V2 = LABELS_V3 | {"DDoS": "DoS"}
TARGET_CLASSES = ["Benign", "DoS", "PortScan"]

# CSV column -> internal column.
CSV_COLUMNS_V3 = {
    "Destination Port": "dest_port",
    "Flow Duration": "duration",
    "Total Fwd Packets": "total_fwd_packets",
    "Total Backward Packets": "total_bwd_packets",
    "Flow Packets/s": "flow_packets_per_sec",
    "Flow IAT Mean": "flow_iat_mean",
}
CSV_COLUMNS_V2 = {
    "Destination Port": "dest_port",
    "Flow Duration": "duration",
    "Total Fwd Packets": "total_fwd_packets",
    "Total Backward Packets": "total_bwd_packets",
    "Total Length of Fwd Packets": "total_fwd_bytes",
    "Total Length of Bwd Packets": "total_bwd_bytes",
    "Flow Bytes/s": "flow_bytes_per_sec",
    "Flow Packets/s": "flow_packets_per_sec",
    "Down/Up Ratio": "down_up_ratio",
    "Label": "Label",
}
REQUIRED_V3 = ["total_fwd_packets", "total_bwd_packets", "duration"]

# Feature order of each profile.
FEATURES_V3 = [
    "dest_port", "duration", "total_fwd_packets", "total_bwd_packets", "total_packets", "flow_packets_per_sec",
    "duration_ms", "fwd_bwd_ratio", "pkt_ratio", "has_response", "flow_iat_mean", "is_long_connection",
    "log_duration", "pkts_per_duration", "acc_age", "n_flushes", "log_acc_age",
]
FEATURES_V2 = [
    "dest_port", "duration", "total_fwd_packets", "total_bwd_packets", "flow_packets_per_sec", "down_up_ratio",
    "total_packets", "fwd_bwd_ratio", "duration_ms", "fwd_bytes_per_pkt", "bwd_bytes_per_pkt", "bytes_ratio",
    "pkt_size_ratio", "flow_bytes_per_pkt",
]

# Ensemble weights, default threshold, tasks in tie order, file of each task.
WEIGHTS = {"dt": 0.20, "rf": 0.30, "xgb": 0.50}
DEFAULT_THRESHOLD = 0.5
TASKS = ["PortScan", "DoS"]
TASK_FILES = {"PortScan": "Friday-WorkingHours-Afternoon-PortScan.pcap_ISCX.csv", "DoS": "Wednesday-workingHours.pcap_ISCX.csv"}
TUNED_THRESHOLDS = {"PortScan": 0.5, "DoS": 0.55}

# Signature categories that raise no alert; the class of signature alerts.
QUIET_CATEGORIES = ["Generic Protocol Command Decode", "Not Suspicious Traffic"]
SIGNATURE_CLASS = "Suricata Alert"
COOLDOWN_S = 10
# States of a flow event that close its session.
CLOSING_STATES = ["closed", "established", "fin", "rst"]
SESSION_TIMEOUT_S, MAX_SESSIONS = 60, 10_000
BEHAVIOR_WINDOW_S, MAX_SOURCES = 300, 10_000
ZERO_BYTE_COUNT, ZERO_BYTE_RATE = 3, 1.0
