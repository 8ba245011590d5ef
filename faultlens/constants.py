"""Fixed values. They must equal the published ones for results to agree; do not tune them here."""

# --- time slicing, seconds ------------------------------------------------------------------
BASELINE_SECONDS = 600.0
INCIDENT_SECONDS = 300.0
BUCKET_SECONDS = 5.0

# --- optional span sampling -----------------------------------------------------------------
SAMPLE_TRIGGER_SPANS = 12000
SAMPLE_INCIDENT_TRACES = 500
SAMPLE_BASELINE_TRACES = 300
SAMPLE_TRIGGER_ROWS = 10000
SAMPLE_INCIDENT_ROWS = 6000
SAMPLE_SEED = 42

# --- logs -----------------------------------------------------------------------------------
# Order matters: the first keyword of this list found anywhere in the line wins.
ERROR_KEYWORDS = (
    "fatal", "fail", "panic", "error", "exit", "kill", "no such file",
    "err:", "err!", "failures:", "exception", "cannot",
)
PROBE_MARKS = (
    "/healthz", "/ready", "/live", "kube-probe", "health check 200", "prometheus scraper", "/metrics",
)
STACK_PREFIXES = ("at ", "caused by:", "exception:", 'file "', "line ", "... ")
STACK_MARKS = ("traceback (most recent call last)", "goroutine ")

# Applied in this order.
MASKS = (
    (r"((25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\.){3}(25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)", "<<IP>>"),
    (r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}", "<<UUID>>"),
    (r"\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(\.\d+)?", "<<TIMESTAMP>>"),
    (r"\b\d+\b", "<<NUM>>"),
)
TOKEN_DELIMITERS = "_:=,[]"
TEMPLATE_SIMILARITY = 0.4
WILDCARD = "<*>"

CONTEXT_BEFORE = 3
CONTEXT_AFTER = 7
CONTINUATION_EXTRA = 15
LOG_TOKEN_BUDGET = 1500
MIN_TRUNCATED_TOKENS = 100
BASELINE_RUNS = 3
TRUNCATED_SUFFIX = "\n...[truncated for token budget]"

# --- metrics --------------------------------------------------------------------------------
Z_THRESHOLD = 3.0
OOM_SLOPE_BYTES_PER_SECOND = 50000.0
OOM_SLOPE_FLOOR = 10000.0
OOM_HORIZON_SECONDS = 300.0
OOM_URGENT_SECONDS = 180.0
ROBUST_FACTOR = 0.6745
MAX_ALERTS = 10
SELF_BASELINE_SHARE = 0.3
GENERIC_METRIC_PREFIXES = ("container", "http", "grpc", "node", "process", "system", "jvm", "go")
LIMIT_MARKS = ("spec_memory_limit", "memory_limit", "mem_limit")
MEMORY_MARKS = ("memory", "mem", "rss", "bytes_used", "heap")
LATENCY_MARKS = ("latency", "duration", "time", "delay", "seconds")
SEVERITIES = ("CRITICAL", "HIGH", "MEDIUM", "LOW")

# --- traces ---------------------------------------------------------------------------------
SERVICE_TAGS = ("service.name", "service", "app", "component")
ERROR_FLAG_TAGS = ("error", "otel.status_code")
STATUS_TAGS = ("http.status_code", "status_code", "grpc.status_code")
MESSAGE_TAGS = ("error.message", "exception.message", "message")
CODE_TAGS = ("error.code", "exception.type", "grpc.code")
ERROR_STATUS_WORDS = ("error", "500", "502", "503", "504", "true", "1", "fail")
ERROR_STATUS_WORDS_CSV = ERROR_STATUS_WORDS + ("failed",)
GRPC_ERROR_CODES = (2, 4, 14)
TIMEOUT_CODES = (504, 4)
TIMEOUT_WORDS = ("deadline", "timeout", "timed out", "context deadline exceeded")
NULL_PARENTS = ("", "none", "null", "None", "0")
CHILD_SHARE_OF_TIMEOUT = 0.6
CHILD_SELF_SHARE_OF_TIMEOUT = 0.5
BOTTLENECK_FLOOR_MS = 50.0
BOTTLENECK_FACTOR = 2.0
BASELINE_MIN_SPANS = 3
VOTES_PER_TRACE = 3
MAX_EVIDENCE_SPANS = 50
MAX_CALL_TREES = 5

# --- fusion ---------------------------------------------------------------------------------
WEIGHT_TRACE_LEAF = 5.0
WEIGHT_TRACE_DEPTH = 2.0
WEIGHT_METRIC_OOM = 6.0
WEIGHT_METRIC_ALERT = 3.0
WEIGHT_LOG_NOVEL = 2.5
WEIGHT_LOG_SNIPPET = 1.0
NOVEL_CAP = 10
CALLER_DAMPING = 0.60
CALLEE_BOOST = 2.0
CONSENSUS_TWO = 1.35
CONSENSUS_THREE = 1.75

EC1 = "EC-1: OOM / Resource Exhaustion"
EC2 = "EC-2: Flaky / Intermittent Latency"
EC3 = "EC-3: Cascading Service Crash"
EC4 = "EC-4: Silent Data Corruption"
EC5 = "EC-5: Infrastructure Drift / Network Partition"
CODE_BUG = "CODE_BUG: Application Exception / Logic Error"
UNKNOWN_CATEGORY = "UNKNOWN: Unclassified Failure"
# Declared order; the earlier category wins a tie.
CATEGORIES = (EC1, EC2, EC3, EC4, EC5, CODE_BUG)
FAULT_TO_CATEGORY = {
    "MEM": EC1, "MEMORY": EC1, "OOM": EC1, "DISK": EC1,
    "DELAY": EC2, "NET_DELAY": EC2, "LOSS": EC2, "NET_LOSS": EC2, "CPU": EC2,
    "CRASH": EC3,
    "CORRUPT": EC4,
    "SOCKET": EC5, "PARTITION": EC5,
}
INFRA_PHRASES = ("connection refused", "network unreachable", "dns lookup failed", "host down")
SILENT_PHRASES = ("wrong", "mismatch", "unexpected value", "corrupt", "invalid response")
FAULT_LABELS = {
    "cpu": "CPU Stress", "mem": "Memory Pressure", "delay": "Network Delay", "loss": "Packet Loss",
    "socket": "Socket Congestion", "socket-connection": "Socket Congestion", "disk": "Disk I/O",
}
MODES = ("logs-only", "logs-metrics", "logs-traces", "fusion")
MODES_WITH_METRICS = ("logs-metrics", "fusion")
MODES_WITH_TRACES = ("logs-traces", "fusion")

# --- context text ---------------------------------------------------------------------------
CONTEXT_TOKENS = 2400
CONTEXT_OVERHEAD = 300
FIXED_OVERHEAD = 120
TRACE_SHARE, TRACE_MIN = 0.45, 250
METRIC_SHARE, METRIC_MIN = 0.35, 200
LOG_MIN, LOG_SLACK = 200, 80
CONTEXT_CLOSING = (
    "\nAnalyze the telemetry evidence above, triangulate signals across modalities using the dependency topology, "
    "and produce the structured Root Cause Analysis report."
)
LOG_SECTION_TITLE = "### Extracted Log Evidence (Drain3 Novel Templates & Asymmetric Context):\n"

# --- files ----------------------------------------------------------------------------------
CASE_FILES = ("logs.parquet", "metrics.parquet", "traces.parquet", "inject_time.txt")
UNKNOWN_SERVICE = "unknown_service"
METRIC_QUERY_PREFIX = "rcaeval:"
LOCAL_ENGINE = "TELEMETRY_RAG_LOCAL"

# The column names that raw files are known to use.
# Candidate columns, best first; names are compared without case.
LOG_TIME = ("timestamp", "time", "datetime", "ts")
LOG_TIME_CSV = ("time", "timestamp", "datetime", "date", "ts")
LOG_SERVICE = ("container_name", "service", "service_name", "pod", "app")
LOG_SERVICE_CSV = ("service", "service_name", "pod", "app", "component", "container_name")
LOG_MESSAGE = ("message", "content", "log", "text", "msg", "body")
SPAN_COLUMNS = {
    "time": ("startTime", "startTimeMillis", "time", "timestamp", "ts"),
    "trace": ("traceID", "trace_id", "id"),
    "span": ("spanID", "span_id"),
    "parent": ("parentSpanID", "parent_id", "parent_span_id"),
    "service": ("serviceName", "service", "service_name", "app"),
    "operation": ("operationName", "methodName", "operation", "rpc"),
    "duration": ("duration", "duration_ms", "duration_us"),
    "status": ("statusCode", "status", "status_code", "error"),
}
SPAN_COLUMNS_CSV = {
    "time": ("time", "timestamp", "start_time", "startTime", "ts"),
    "trace": ("trace_id", "traceID", "traceId", "id"),
    "span": ("span_id", "spanID", "spanId"),
    "parent": ("parent_id", "parent_span_id", "parentSpanID", "parentId"),
    "service": ("service", "service_name", "serviceName", "app"),
    "operation": ("operation", "operation_name", "operationName", "rpc", "method"),
    "duration": ("duration", "duration_ms", "duration_us", "latency"),
    "status": ("status", "status_code", "statusCode", "error", "has_error"),
}

# Sentences of the report; {} takes a value.
REPORT = {
    "no_logs": "No log evidence evaluated.",
    "own_logs": "Isolated {} error snippet(s) in '{}' with {} novel Drain3 template(s).",
    "other_logs": "Identified {} error snippet(s) across {} microservices.",
    "oom_risk": " [Steep memory slope indicates OOM risk]",
    "no_alerts": "Metrics evaluated within normal bounds (no Z-score anomalies).",
    "own_alerts": "Detected {} anomaly alert(s) for '{}': {} (z={}){}.",
    "other_alerts": "Peak anomaly detected at '{}': {} (z={}).",
    "no_errors": "Distributed traces show no failing spans or HTTP/gRPC error tags.",
    "leaf": "DFS DAG traversal isolated deepest leaf culprit at '{}:{}' (depth={}, status={}).",
    "errors": "Encountered {} failing span(s) across call graphs.",
    "localized": "Multi-signal correlation localized root cause to '{}' under category {}.",
    "agreement": "Cross-modal consensus verified across {} telemetry modality/modalities (Primary: {}).",
    "downstream": "Trace call hierarchy confirmed this service is the downstream origin rather than an innocent caller.",
    "climbing": "Metric time series confirmed memory consumption climbing at an unsustainable slope.",
    "summary": "Telemetry-RAG localized root cause to '{}' failing under {}.",
    "action": "Inspect and scale compute / network resources for {}",
    "command": "docker update --cpus=2.0 {}",
    "impact": "Relieves resource pressure on {}",
}

# Patterns of ids in log lines and of labels in metric queries.
KEYED_ID = r"(?i)(?:trace_?id|req(?:uest)?_?id|thread|worker)[=:\s]+([a-zA-Z0-9_\-]+)"
BRACKETED_ID = r"\[([a-zA-Z0-9_\-]{6,})\]"
LABEL_KEYS = "(?:name|app|service|pod|container|service_name)"
