"""Fixed values shared by all jobs. They must equal the registry's own codes."""

# Status names and their codes; 0 stands for an unknown name.
STATUS_CODES = {
    "WORKING": 1,
    "TRANSIT": 2,
    "DISCONN": 3,
    "RESERVED": 4,
    "UNAVAIL": 5,
    "ASSIGNED": 6,
    "SUSPEND": 7,
}
WORKING, TRANSIT, DISCONN, RESERVED, UNAVAIL, ASSIGNED, SUSPEND = range(1, 8)

# The number segments, ascending and in order of introduction.
SEGMENTS = (800, 833, 844, 855, 866, 877, 888)
SEGMENTS_BY_AGE = (800, 888, 877, 866, 855, 844, 833)

# Category slugs with a special meaning. Directories with further slugs of the kind, such as
# one for entries that are no owners, pass their own lists.
# Every caller names the hidden ones; this is the list of the test data.
HIDDEN_SLUGS = ("hidden",)
META_SLUGS = ("unknown", "hidden")

# Thresholds of the reports.
DORMANT_MAX = 14
DEFAULT_TEST_NUMBERS = 14
OPPORTUNISM_MIN_ACQUIRED = 1000
GROWTH_MIN_START = 10000
ENRICHMENT_MIN_WORKING = 5000
ABBREVIATED_MAX_PERIODS = 2
NOTABLE_SEGMENT = 800
NOTABLE_MAX_RANK = 5000
NOTABLE_MIN_SCORE = 1000
MISSING_RANK = 999999
SALABLE_STATUSES = ("WORKING", "FEATURE", "REQUEST", "RESERVED")

# Pseudo nodes of the flow graph.
DISC_NODE = "DISC"
SPARE_NODE = "SPARE"
EDGE_TYPES = ("TRANSFER", "HARVEST", "DISCONNECT", "REACTIVATE", "FIRST_ASSIGN", "TO_SPARE")
