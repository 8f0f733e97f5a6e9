"""Rule thresholds, word lists and formats the results depend on."""

# Name hints. They are substring tests on the lower-cased column name.
ID_HINTS = ("id", "code", "key", "uuid", "number", "no")
AMOUNT_HINTS = ("revenue", "sales", "amount", "price", "cost", "value", "total", "qty",
                "quantity", "count", "profit", "spend")
DATE_HINTS = ("date", "time", "day", "month", "year", "timestamp", "created", "updated")
SCOPE_DATE_HINTS = ("date", "month", "time", "day")
GEOGRAPHY_HINTS = ("region", "country", "city", "state", "zone", "territory")
PRODUCT_HINTS = ("product", "sku", "item", "category")
CUSTOMER_HINTS = ("customer", "client", "user", "account")

# Units that may follow a number in a text value.
UNIT_TOKENS = ("kg", "g", "lb", "lbs", "oz", "ton", "tonne", "km", "m", "cm", "mi",
               "l", "ml", "hr", "hrs", "min", "sec", "usd", "eur", "gbp", "pkr",
               "inr", "%", "$", "€", "£")
UNIT_PATTERN = r"^\s*[-+]?\d[\d,._]*\s*([a-zA-Z%$€£]{1,5})\s*$"
OFFSET_PATTERN = r"([+-]\d{2}:?\d{2}|Z)$"

# Whitelists.
OPERATIONS = ("describe", "value_counts", "groupby_aggregate", "correlation", "time_series",
              "period_contribution", "interaction_contribution")
AGGREGATES = ("sum", "mean", "median", "count", "min", "max", "std", "nunique")
FREQUENCIES = {"M": "month", "ME": "month", "MS": "month", "Q": "quarter", "QE": "quarter",
               "Y": "year", "YE": "year", "A": "year", "D": "day", "W": "week"}
SEASON_LENGTH = {"M": 12, "ME": 12, "MS": 12, "W": 52, "D": 7, "Q": 4, "QE": 4}
SQL_BANNED = ("insert", "update", "delete", "drop", "alter", "truncate", "create",
              "attach", "copy", "install", "load")
JDBC_BANNED = ("insert", "update", "delete", "drop", "alter", "truncate", "create")
FINDING_TYPES = ("measurement", "association", "driver")
REQUEST_TYPES = ("missing_field", "missing_dataset", "missing_document", "definition",
                 "clarification")
VERSION_TYPES = ("raw", "cleaned", "enriched", "scoped")

# Limits.
RETURNED_SQL_ROWS = 500
MIN_SERIES_LENGTH = 12
MIN_SERIES_FOR_SEASONAL = 24
MAX_ACCEPTABLE_MAPE = 25.0
PSI_MODERATE, PSI_MAJOR = 0.10, 0.25
SEVERITY_PENALTY = {"high": 12, "medium": 5, "low": 2}
RECOVERY = {"high": (0.55, 0.80), "medium": (0.35, 0.60), "low": (0.15, 0.35)}
CONFIDENCE_WEIGHT = {"high": 1.0, "medium": 0.65, "low": 0.35}
URGENCY_WEIGHT = {"high": 1.0, "medium": 0.7, "low": 0.4}

# Text retrieval.
CHUNK_SIZE, CHUNK_OVERLAP = 900, 150
EMBEDDING_DIM = 256
EMBEDDING_SIGNATURE = "hashed-words-256"
MIN_ANSWER_SCORE, MIN_DEFINITION_SCORE = 0.05, 0.35
DOCUMENT_SUFFIXES = (".pdf", ".docx", ".pptx", ".txt", ".html", ".htm", ".md")
TABULAR_SUFFIXES = (".csv", ".tsv", ".xlsx", ".xls", ".json", ".parquet")
CONTENT_MARKERS = (("pdf", ".pdf"), ("wordprocessingml", ".docx"),
                   ("presentationml", ".pptx"), ("csv", ".csv"), ("plain", ".txt"))

# Site walks.
MAX_SITE_PAGES, MAX_SITE_DEPTH, MIN_PAGE_CHARS = 25, 3, 120
SKIP_LINKS = (r"(?i)\.(css|js|png|jpe?g|gif|svg|ico|woff2?|ttf|mp4|zip|gz)(\?|$)"
              r"|/(tag|tags|category|categories|search|login|signin|signup|cart|feed)(/|\?|$)")

# Redaction.
REDACTED, MIN_SECRET_CHARS = "[REDACTED]", 3

# What Python counts as white space, for strip and split.
WHITESPACE = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
              "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
              "\u2028\u2029\u202f\u205f\u3000")
