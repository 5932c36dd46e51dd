"""The word lists, patterns and limits that decide results.

Everything in this module is data. The operators read it; nothing here computes.
"""

# --- fixed values: profile roles (time / status / id / threshold / previous / current) ---

PROFILE_TIME = (
    "date|month|period|quarter|year|week|day|time|fiscal|fy|qtr|dt$"
)
PROFILE_STATUS = (
    "rag|status|flag|indicator|signal|alert|health|state|colour|color|"
    "traffic|light|band|tier|category|rating|grade|score_band"
)
PROFILE_ID = "^id$|_id$|code$|key$|ref$|num$|number$|no$|index$|pk$|guid|uuid"
PROFILE_THRESHOLD = (
    "threshold|limit|target|benchmark|ceiling|floor|min|max|bound|sla|"
    "tolerance|acceptable|redline|greenline|kpi_target"
)
PROFILE_PREVIOUS = (
    "prev|previous|prior|last|before|baseline|period_before|old|historic"
)
PROFILE_CURRENT = (
    "curr|current|actual|value|result|measure|metric|score|rate|pct|percent|"
    "ratio|count|amount|volume|total"
)
PROFILE_RAG_VALUES = [
    "red", "amber", "green", "grey", "gray", "n/a", "na",
    "r", "a", "g", "fail", "pass", "breach", "compliant",
    "high", "medium", "low", "critical", "warning", "ok",
    "yes", "no", "true", "false", "1", "0",
]
BOOLEAN_LIKE_VALUES = ["true", "false", "1", "0", "y", "n", "yes", "no"]
STATUS_LIKE_VALUES = [
    "red", "amber", "green", "grey", "pass", "fail",
    "breach", "compliant", "ok", "good", "bad", "high", "low",
]

# --- fixed values: visual roles ---

VISUAL_DATE_NAME = (
    r"(^year|^month|^quarter|^week|^day|^hour|^minute|^second)"
    r"|(^date(trunc|part|diff|add)?[\s(])"
    r"|[\s_](date|month|period|quarter|year|week|dt)$"
    r"|[\s_](date|month|period|quarter|year|week|dt)[\s_]"
)
VISUAL_STATUS_NAME = (
    "^(rag|status|flag|indicator|signal|alert|health|state|colour|color|"
    "traffic|band|tier|rating|grade|performance|result|outcome)$"
)
VISUAL_THRESHOLD_NAME = (
    "threshold|limit|target|benchmark|ceiling|floor|sla|"
    "tolerance|redline|greenline|upper.bound|lower.bound"
)
VISUAL_ID_NAME = (
    r"^(id|pk|key|code|ref|num|uuid|guid|serial)$"
    r"|(_id|_key|_code|_ref|_num)$"
    r"|^(row.?number|record.?id|line.?num)"
)
VISUAL_BIN_NAME = r"\(bin\)$|\bbin\b"
VISUAL_TABLE_CALC_NAME = (
    r"(running|moving|window|cumul|pct.of|percent.of|rank|index)\b"
)
VISUAL_DATE_VALUE = (
    r"^\d{4}[-/]\d{2}|^\d{2}[-/]\d{2}[-/]\d{4}"
    r"|^(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[-\s]\d{2,4}"
    r"|^(q[1-4][-\s]\d{4})|^(fy\d{2,4})|^\d{4}$"
)
VISUAL_RAG_VALUES = [
    "red", "amber", "green", "grey", "gray", "na", "n/a",
    "fail", "pass", "breach", "compliant", "ok", "good", "bad",
    "high", "medium", "low", "critical", "warning", "1", "0", "true", "false",
]
GEO_EXACT_NAMES = [
    "latitude", "longitude", "lat", "lng", "lon", "long",
    "latitude (generated)", "longitude (generated)", "x coordinate", "y coordinate",
]
GEO_NAME_WORDS = [
    "country", "state", "province", "region", "city", "town", "district",
    "county", "zip", "postal", "postcode", "territory", "continent",
    "nation", "location", "address", "geographic area", "geo",
]
MEASURE_PAIR_NAMES = ["measure names", "measure values"]

# --- fixed values: semantic roles ---

SEMANTIC_TIME_NAME = "(date|month|period|quarter|year|week|day|time|dt$|fy\\d|q[1-4])"
SEMANTIC_DATE_VALUE = (
    r"^\d{4}[-/]\d{2}|^\d{2}[-/]\d{4}|"
    r"^(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[-\s]\d{2,4}|"
    r"^q[1-4][-\s]\d{4}|^fy\d{2,4}|^\d{4}$"
)
SEMANTIC_GEO_WORDS = [
    "country", "state", "province", "city", "region", "latitude", "longitude",
    "lat", "lng", "lon", "postal", "zip", "territory", "continent", "location",
]
SEMANTIC_THRESHOLD_NAME = (
    "threshold|limit|target|benchmark|sla|tolerance|redline|ceiling"
)
SEMANTIC_STATUS_NAME = (
    "(rag|status|flag|color|colour|band|state|result|outcome|rating)"
)
SEMANTIC_RAG_VALUES = [
    "red", "amber", "green", "pass", "fail", "breach", "compliant",
    "ok", "high", "medium", "low",
]
SEMANTIC_ID_NAME = "^(id|pk|key|code|ref|uuid|guid)$|(_id|_key|_code)$"

# --- fixed values: null markers and column pairs ---

NULL_MARKERS = [
    "null", "NULL", "Null", "%null%", "N/A", "n/a", "-",
    "nan", "NaN", "", " ", "(blank)", "*",
]
TEXT_NULL_MARKERS = ["nan", "None", ""]
CSV_NULL_MARKERS = ["N/A", "-", "null", "NULL", "", " "]
THRESHOLD_PARTNER_WORDS = ["threshold", "limit", "target", "sla"]
PREVIOUS_PARTNER_WORDS = ["previous", "prior", "last", "baseline"]
SIGNAL_THRESHOLD_WORDS = ["threshold", "limit", "target"]
KPI_NAME_WORDS = ["name", "id", "kri", "metric", "indicator"]
PERCENT_NAME_WORDS = ["rate", "pct", "percent", "ratio", "%"]
PERIOD_NAME_WORDS = ["date", "month", "period"]

# --- fixed values: status words ---

BREACH_STATUS_VALUES = ["red", "fail", "breach", "critical", "no", "false"]
RAG_QUESTION_WORDS = [
    "red", "amber", "green", "fail", "pass", "breach",
    "compliant", "critical", "high", "medium", "low",
]
STATUS_BREACHING_WORDS = ["red", "fail", "breach"]
STATUS_AT_RISK_WORDS = ["amber", "warn", "at risk"]
STATUS_ON_TRACK_WORDS = ["green", "pass", "ok"]
HIGHER_IS_BETTER_WORDS = [
    "revenue", "sales", "profit", "margin", "score", "rate", "coverage",
    "completeness", "accuracy", "uptime", "availability", "satisfaction",
    "compliance", "pass", "green", "target", "achievement", "growth",
]
LOWER_IS_BETTER_WORDS = [
    "error", "failure", "breach", "violation", "cost", "expense", "risk",
    "incident", "ticket", "lag", "delay", "churn", "attrition", "miss",
    "exception", "defect", "debt", "issue", "concern", "open", "outstanding",
    "overdue", "red", "amber", "fail", "pending",
]
STATUS_ORDER = ["breaching", "at_risk", "on_track", "unknown"]
SEVERITY_ORDER = ["critical", "high", "medium", "low"]

# --- fixed values: entity types by name word, first match wins ---

ENTITY_TYPE_WORDS = [
    ("kri", ["kri", "kpi", "indicator", "metric", "control", "risk"]),
    ("geographic", ["country", "state", "city", "region", "territory"]),
    ("product", ["product", "category", "segment", "type", "class"]),
    ("person", ["team", "owner", "user", "person", "manager", "analyst"]),
    ("time", ["date", "month", "period", "year", "quarter"]),
]

# --- fixed values: dashboard type signals, ties go to the earlier type ---

DASHBOARD_SIGNALS = [
    ("kri", ["kri", "risk indicator", "key risk", "uk-k", "sg-k", "cep-k", "risk_id"]),
    ("scorecard", ["scorecard", "kpi", "performance", "metric", "measure"]),
    ("compliance", ["control", "compliance", "breach", "audit", "regulation", "sox", "policy"]),
    ("sales", ["revenue", "sales", "pipeline", "quota", "deal", "opportunity",
               "customer", "arr", "mrr"]),
    ("finance", ["p&l", "budget", "forecast", "variance", "actual", "cost",
                 "expense", "profit", "margin"]),
    ("ops", ["sla", "incident", "ticket", "ops", "operation", "uptime",
             "latency", "throughput"]),
    ("data_quality", ["data quality", "dq", "dcrm", "cde", "completeness",
                      "accuracy", "validity", "timeliness"]),
    ("hr", ["headcount", "employee", "hire", "attrition", "turnover", "workforce", "fte"]),
    ("marketing", ["campaign", "impression", "click", "conversion", "cpc",
                   "cpm", "roi", "channel"]),
    ("supply_chain", ["inventory", "supplier", "lead time", "fulfillment",
                      "shipment", "logistics", "warehouse"]),
    ("it", ["server", "cpu", "memory", "disk", "network", "latency",
            "error rate", "availability"]),
]
RECORD_TERMS = {
    "kri": "KRIs", "scorecard": "metrics", "compliance": "controls",
    "sales": "deals", "ops": "incidents", "finance": "line items",
}

# --- fixed values: question intents, first list with a hit wins ---

INTENT_WORDS = [
    ("breach", ["breach", "exceed", "fail", "violated", "out of",
                "below threshold", "above threshold"]),
    ("rag_filter", ["red", "amber", "green", "rag", "status", "failing",
                    "passing", "compliant", "flag"]),
    ("trend", ["trend", "over time", "monthly", "history", "last 6", "last 12",
               "period", "change over"]),
    ("highest", ["highest", "best", "top", "maximum", "max", "most", "largest"]),
    ("lowest", ["lowest", "worst", "bottom", "minimum", "min", "least", "smallest"]),
    ("average", ["average", "avg", "mean", "typical"]),
    ("count_sum", ["total", "sum", "count", "how many", "number of"]),
    ("variance", ["variance", "change", "delta", "difference", "improved", "deteriorated"]),
    ("distribution", ["breakdown", "distribution", "split", "proportion", "share",
                      "percentage"]),
    ("compare", ["compare", "vs", "versus", "contrast", "against", "side by side"]),
    ("ranking", ["rank", "ranking", "list all", "show all", "top 5", "top 10"]),
    ("outliers", ["outlier", "anomaly", "unusual", "spike", "drop", "unexpected"]),
    ("correlation", ["correlat", "relationship between", "link between"]),
    ("summary", ["summary", "overview", "give me", "describe", "what is this"]),
]
# Words short enough to sit inside unrelated words: matched whole, not as prefixes.
WHOLE_WORD_INTENTS = ["red", "rag", "max", "min", "top", "most", "least", "mean", "sum",
                      "count", "vs"]

LOWEST_QUESTION_WORDS = ["underperform", "worst", "lowest", "least", "bottom", "poor"]
HIGHEST_QUESTION_WORDS = ["best", "highest", "top", "most", "outperform"]
TREND_QUESTION_WORDS = ["trend", "over time", "change", "direction"]
PRIORITY_QUESTION_WORDS = ["breach", "fail", "red", "alert", "exceed"]

# --- fixed values: chart shapes and their fixed confidence ---

CHART_LABELS = {
    "time_series": "Time Series Chart",
    "multi_series_time": "Multi-Series Time Chart",
    "bar_chart": "Bar Chart",
    "pie_chart": "Pie Chart",
    "scatter_plot": "Scatter Plot",
    "bubble_chart": "Bubble Chart",
    "heat_map": "Heat Map",
    "treemap": "Treemap",
    "kpi_cards": "KPI Card Display",
    "kpi_scorecard": "KPI Scorecard (RAG/Threshold)",
    "map": "Geographic Map",
    "histogram": "Histogram",
    "box_plot": "Box Plot",
    "waterfall": "Waterfall Chart",
    "gantt": "Gantt Chart",
    "multi_measure": "Multi-Measure Chart (Measure Names/Values)",
    "crosstab": "Cross-tab / Pivot Table",
    "data_table": "Data Table",
}

# --- fixed values: English function words left out of the fact index ---

STOP_WORDS = [
    "about", "above", "after", "again", "against", "all", "also", "am", "an", "and",
    "any", "are", "as", "at", "be", "because", "been", "before", "being", "below",
    "between", "both", "but", "by", "can", "could", "did", "do", "does", "doing",
    "down", "during", "each", "ever", "every", "few", "for", "from", "further", "had",
    "has", "have", "having", "he", "her", "here", "hers", "herself", "him", "himself",
    "his", "how", "if", "in", "into", "is", "it", "its", "itself", "just",
    "me", "might", "more", "most", "must", "my", "myself", "no", "nor", "not",
    "now", "of", "off", "on", "once", "only", "or", "other", "our", "ours",
    "ourselves", "out", "over", "own", "same", "she", "should", "so", "some", "such",
    "than", "that", "the", "their", "theirs", "them", "themselves", "then", "there", "these",
    "they", "this", "those", "through", "to", "too", "under", "until", "up", "us",
    "very", "was", "we", "were", "what", "when", "where", "which", "while", "who",
    "whom", "why", "will", "with", "would", "you", "your", "yours", "yourself", "yourselves",
]

# --- fixed values: limits that are part of the results ---

ROWS_PER_CHUNK = 50
CONTEXT_TOKENS = 6000
SEARCH_MIN_SCORE = 0.05
ANSWER_MIN_CONFIDENCE = 0.70
FACT_MIN_SCORE = 0.30
