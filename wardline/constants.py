"""Fixed values the results depend on. Nothing here is derived."""

# --- fixed values: parties and tiers -----------------------------------------
PARTIES = ["DEM", "REP", "BLK", "WOR", "CON", "IND", "OTH"]
DEM_LEAN_PARTIES = ["DEM", "WOR"]
REP_LEAN_PARTIES = ["REP", "CON"]
UNAFFILIATED = "BLK"
TIER_LETTERS = ["X", "F", "L", "I"]
LOW_TIERS = ["I0", "F1", "L1", "F2", "L2"]
DROPOFF_TIERS = ["I0", "F1", "L1"]

# --- fixed values: packed history codes --------------------------------------
BALLOT_TYPES = {"GENERAL": "G", "PRIMARY": "P"}
BALLOT_METHODS = {
    "Election Day / Poll Site": "E",
    "Early Voting": "V",
    "Absentee": "A",
    "Federal": "F",
    "Affidavit": "D",
    "Mail": "M",
    "Other": "O",
}

# --- fixed values: street suffixes, applied in this order --------------------
STREET_SUFFIXES = [
    ("AVENUE", "AVE"), ("STREET", "ST"), ("ROAD", "RD"), ("BOULEVARD", "BLVD"),
    ("DRIVE", "DR"), ("COURT", "CT"), ("PLACE", "PL"), ("LANE", "LN"),
    ("CIRCLE", "CIR"), ("PARKWAY", "PKWY"), ("TURNPIKE", "TPKE"),
    ("HIGHWAY", "HWY"), ("TERRACE", "TER"), ("SQUARE", "SQ"), ("RIDGE", "RDG"),
]
MAJOR_ROAD_CLASSES = ["S1100", "S1200"]

# --- fixed values: donations --------------------------------------------------
DEM_CONDUITS = ["ACTBLUE"]
REP_CONDUITS = ["WINRED"]
PARTISAN_KEYWORDS = [
    "DEMOCRAT", "DNC", "DCCC", "DSCC", "HILLARY", "BIDEN", "OBAMA",
    "WARREN", "SCHUMER", "GILLIBRAND", "PROGRESSIVE",
]
POSSIBLE_CAP = 10
EMBEDDED_POSSIBLE_CAP = 5
RECENCY_WINDOW_DAYS = 3 * 365

# --- fixed values: contests ----------------------------------------------------
OFFICE_RACES = {
    "State Assembly": "assembly",
    "State Senate": "senate",
    "U.S. House": "congressional",
}
RACE_DISTRICTS = {
    "assembly": list(range(1, 23)),
    "senate": list(range(1, 10)),
    "congressional": list(range(1, 5)),
}

# --- fixed values: staleness in days -------------------------------------------
STALE_DAYS_MATCHED = 30
STALE_DAYS_NO_MATCH = 90
STALE_DAYS_TIMEOUT = 7

# --- fixed values: history and labels ------------------------------------------
NEVER_VOTED_YEARS = 99
NEVER_DONATED_DAYS = 10_000
NEVER_DONATED_DAYS_SIMPLE = 9999
MASKED = -1
PARTY_OTHER_CLASS = 2
TURNOUT_TIER_THRESHOLD = 3

# --- fixed values: graph ---------------------------------------------------------
EDGE_PRIORITY = {"household": 0, "same_address": 1, "donation": 2,
                 "spatial_knn": 3, "ed": 4}
HOUSEHOLD_CLIQUE_LIMIT = 10
SAME_ADDRESS_PEERS = 5
ED_PEERS = 5
CODONOR_PEERS = 5
COMMITTEE_MIN_DONORS = 2
COMMITTEE_MAX_DONORS = 5000
KNN_K = 10
CLUSTER_TARGET = 8000
RWSE_STEPS = 16
METRES_PER_DEGREE_LON = 111_320.0
METRES_PER_DEGREE_LAT = 110_540.0

# --- fixed values: missing markers -----------------------------------------------
NULL_TEXT = ["nan", "null", "none", "<na>", ""]
CENSUS_MISSING_BELOW = -100000
CLICK_CUTOFF_DEG2 = 3.5e-6

# --- fixed values: census tables -> short names ------------------------------------
CENSUS_TABLES = {
    "b19013": {"B19013_E001": "median_hh_income"},
    "b01002": {"B01002_E001": "median_age"},
    "b03002": {"B03002_E001": "pop_total", "B03002_E003": "white_nh",
               "B03002_E004": "black_nh", "B03002_E006": "asian_nh",
               "B03002_E012": "hispanic"},
    "b15003": {"B15003_E001": "edu_total_25plus", "B15003_E022": "edu_bachelors",
               "B15003_E023": "edu_masters", "B15003_E024": "edu_professional",
               "B15003_E025": "edu_doctorate"},
    "b25003": {"B25003_E001": "tenure_total", "B25003_E002": "tenure_owner"},
}
