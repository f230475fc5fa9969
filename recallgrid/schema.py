"""Table schemas and the constants results depend on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, types as T

# ---- fixed values: texts the CSV reader of the reference treats as null ----
NA_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)

# ---- fixed values: uuid namespaces (RFC 4122) ----
NAMESPACE_URL = "6ba7b8119dad11d180b400c04fd430c8"
NAMESPACE_DNS = "6ba7b8109dad11d180b400c04fd430c8"

# ---- fixed values: flight table columns ----
REQUIRED_INTS = ("year", "month", "day", "flight")
REQUIRED_CODES = ("carrier", "origin", "dest")
OPTIONAL_INTS = ("sched_dep_time", "sched_arr_time", "dep_time", "arr_time", "distance", "air_time")
OPTIONAL_TEXTS = ("tailnum",)
ID_PARTS = ("year", "month", "day", "carrier", "flight", "origin", "dest", "sched_dep_time")
PAYLOAD = (
    "year", "month", "day", "origin", "dest", "carrier", "flight",
    "sched_dep_time", "sched_arr_time", "dep_time", "arr_time", "distance", "air_time", "tailnum",
)
HIT_FIELDS = (
    "carrier", "flight", "origin", "dest", "sched_dep_time", "sched_arr_time", "dep_time", "arr_time",
    "distance", "air_time", "year", "month", "day",
)
SNAPSHOT_FIELDS = (
    "flight_id", "carrier", "flight", "origin", "dest", "sched_dep_time", "sched_arr_time",
    "dep_time", "arr_time", "year", "month", "day", "distance", "air_time",
)

# ---- fixed values: departure bands, inclusive HHMM ----
TIME_BANDS = {
    "early_morning": (0, 559),
    "morning": (600, 1159),
    "afternoon": (1200, 1759),
    "evening": (1800, 2159),
    "late_night": (2200, 2359),
}

# ---- fixed values: carrier code -> name ----
CARRIERS = {
    "9E": "Endeavor Air", "AA": "American Airlines", "AS": "Alaska Airlines", "B6": "JetBlue Airways",
    "DL": "Delta Air Lines", "EV": "ExpressJet Airlines", "F9": "Frontier Airlines", "FL": "AirTran Airways",
    "HA": "Hawaiian Airlines", "MQ": "Envoy Air", "OO": "SkyWest Airlines", "UA": "United Airlines",
    "US": "US Airways", "VX": "Virgin America", "WN": "Southwest Airlines", "YV": "Mesa Airlines",
}

# ---- fixed values: airport code -> city ----
AIRPORTS = {
    "ATL": "Atlanta", "AUS": "Austin", "BDL": "Hartford", "BNA": "Nashville", "BOS": "Boston",
    "BTV": "Burlington", "BUF": "Buffalo", "BWI": "Baltimore", "CAK": "Akron Canton", "CHS": "Charleston",
    "CLE": "Cleveland", "CLT": "Charlotte", "CMH": "Columbus", "CVG": "Cincinnati", "DAY": "Dayton",
    "DCA": "Washington Reagan", "DEN": "Denver", "DFW": "Dallas Fort Worth", "DSM": "Des Moines",
    "DTW": "Detroit", "EWR": "Newark", "FLL": "Fort Lauderdale", "GRR": "Grand Rapids", "GSO": "Greensboro",
    "GSP": "Greenville", "HNL": "Honolulu", "HOU": "Houston Hobby", "IAD": "Washington Dulles",
    "IAH": "Houston", "IND": "Indianapolis", "JAX": "Jacksonville", "JFK": "New York JFK",
    "LAS": "Las Vegas", "LAX": "Los Angeles", "LGA": "LaGuardia", "LGB": "Long Beach", "MCI": "Kansas City",
    "MCO": "Orlando", "MDW": "Chicago Midway", "MEM": "Memphis", "MHT": "Manchester", "MIA": "Miami",
    "MKE": "Milwaukee", "MSN": "Madison", "MSP": "Minneapolis", "MSY": "New Orleans", "MYR": "Myrtle Beach",
    "OAK": "Oakland", "ORD": "Chicago O'Hare", "ORF": "Norfolk", "PBI": "West Palm Beach", "PDX": "Portland",
    "PHL": "Philadelphia", "PHX": "Phoenix", "PIT": "Pittsburgh", "PSE": "Ponce", "PVD": "Providence",
    "PWM": "Portland ME", "RDU": "Raleigh Durham", "RIC": "Richmond", "ROC": "Rochester", "RSW": "Fort Myers",
    "SAN": "San Diego", "SAT": "San Antonio", "SAV": "Savannah", "SEA": "Seattle", "SFO": "San Francisco",
    "SJC": "San Jose", "SJU": "San Juan", "SLC": "Salt Lake City", "SMF": "Sacramento", "SNA": "Orange County",
    "SRQ": "Sarasota", "STL": "St Louis", "STT": "St Thomas", "SYR": "Syracuse", "TPA": "Tampa",
    "TUL": "Tulsa", "TYS": "Knoxville", "XNA": "Northwest Arkansas",
}

# ---- fixed values: seed questions of the golden set (query, carrier, origin, dest) ----
SEED_QUERIES = (
    ("morning United flight from Newark to Chicago", "UA", "EWR", "ORD"),
    ("Delta flight from LaGuardia to Atlanta", "DL", "LGA", "ATL"),
    ("JetBlue morning flight from JFK to Fort Lauderdale", "B6", "JFK", "FLL"),
    ("American Airlines afternoon flight from LaGuardia to Dallas", "AA", "LGA", "DFW"),
    ("afternoon American Airlines flight from LaGuardia to Miami", "AA", "LGA", "MIA"),
    ("Southwest Airlines flight from Newark to Chicago Midway", "WN", "EWR", "MDW"),
    ("US Airways morning flight from Newark to Charlotte", "US", "EWR", "CLT"),
    ("evening Envoy Air flight from LaGuardia to Atlanta", "MQ", "LGA", "ATL"),
    ("United early morning departure from LaGuardia to Houston", "UA", "LGA", "IAH"),
    ("JetBlue afternoon flight from JFK to Orlando", "B6", "JFK", "MCO"),
)

# ---- fixed values: defaults of the service being re-expressed ----
SCORE_THRESHOLD = 0.3
MAX_TOOL_RESULTS = 20
RERANK_FETCH, RERANK_RETURN = 20, 5
CONTEXT_TOKENS, CONTEXT_MIN_MESSAGES = 20_000, 10
SESSION_TTL_SECONDS, MAX_SESSIONS = 3600, 500
MEMO_TTL_SECONDS = 3600
MAX_TOOL_ROUNDS = 10

FLIGHT_ROW = T.StructType(
    [T.StructField(c, T.IntegerType(), False) for c in ("year", "month", "day")]
    + [T.StructField("carrier", T.StringType(), False), T.StructField("flight", T.IntegerType(), False)]
    + [T.StructField(c, T.StringType(), False) for c in ("origin", "dest")]
    + [T.StructField(c, T.IntegerType(), True) for c in OPTIONAL_INTS]
    + [T.StructField("tailnum", T.StringType(), True)]
)

GOLDEN_QUERY = T.StructType([
    T.StructField("query", T.StringType()),
    T.StructField("filters", T.StructType([T.StructField(c, T.StringType()) for c in REQUIRED_CODES])),
    T.StructField("expected_flight_ids", T.ArrayType(T.StringType())),
    T.StructField("notes", T.StringType()),
])

BOOKING = T.StructType([
    T.StructField("booking_id", T.StringType(), False),
    T.StructField("flight_id", T.StringType(), False),
    T.StructField("passenger_name", T.StringType(), False),
    T.StructField("status", T.StringType(), False),
    T.StructField("idempotency_key", T.StringType(), True),
    T.StructField("flight_snapshot_json", T.StringType(), False),
    T.StructField("created_at", T.TimestampNTZType(), False),
    T.StructField("updated_at", T.TimestampNTZType(), False),
])

SNAPSHOT = T.StructType([
    T.StructField(c, T.StringType() if c in ("flight_id", "carrier", "origin", "dest") else T.IntegerType())
    for c in SNAPSHOT_FIELDS
])


def code_table(spark: SparkSession, codes: dict[str, str], code: str, name: str) -> DataFrame:
    """A fixed code/name dimension (at most the 80 rows above, so always safe to broadcast)."""
    rows = ", ".join(f'("{c}", "{n}")' for c, n in codes.items())
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t({code}, {name})")


def seed_queries(spark: SparkSession) -> DataFrame:
    rows = [(q, (c, o, d), [], None) for q, c, o, d in SEED_QUERIES]
    return spark.createDataFrame(rows, GOLDEN_QUERY)
