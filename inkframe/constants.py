"""Fixed values shared by the operators. Each one decides results, so none may drift."""

# calibration
MM_PER_PT = 0.352778
PT_PER_MM = 2.834645669
DEFAULT_DPI = 200

# recognition
CONFIDENCE_THRESHOLD = 0.85
BATCH_SIZE = 64
DICT_HIT_CONF = 0.86
DICT_CANDIDATE_CONF = 0.80
DICT_LOW_CONF_MAX = 0.5
PAGE_BUDGET = 0.5
STRUCTURAL_CHARS = ("氏", "公")

# cost per 100 characters and round, by provider
COST_PER_100 = {"gemini": 0.01, "openai": 0.012, "anthropic": 0.03, "custom": 0.008}

# raster and segmentation
KERNEL_LEN = 80
KERNEL_LINE_V_LEN = 40
MIN_LINE_LEN = 40
CHAR_MIN_SIZE = 6
CHAR_MAX_SIZE = 400
CHAR_MIN_AREA = 20
CHAR_MIN_REL_SIDE = 0.55
FONT_CLUSTER_REL_TOL = 0.15
SPLIT_REL_AREA = 1.6
MERGE_REL_AREA_MAX = 1.4
MERGE_OVERLAP_MIN = 0.6
MERGE_GAP_FACTOR = 0.25
MARGIN_EDGE_RATIO = 0.14
MARGIN_INSET_RATIO = 0.012
DENOISE_MIN_AREA = 8
BLANK_MAX_INK_RATIO = 0.0015
BLANK_DARK_THRESHOLD = 240
NODE_R_MIN = 6
NODE_R_MAX = 28
MAX_ARTIFACTS = 300
SKEW_RANGE_DEG = 5

# evidence memory
MEMORY_SIG_BITS = 400
MEMORY_MAX_HAMMING = 28
FINGERPRINT_MAX_HAMMING = 56
LEGACY_MIN_SIMILARITY = 0.97
EVIDENCE_KEYS_KEPT = 80

# logs
UNDO_LIMIT = 100
AUDIT_RETENTION_DAYS = 30
AUDIT_LIST_LIMIT = 500
TITLE_MIN_VOTES = 2
TITLE_SCAN_PAGES = 60

STATUS_ORDER = ("imported", "preprocessed", "analyzed", "recognized", "proofread", "exported")
NOTES = ("ok", "blurry", "damaged", "multi", "empty", "split", "merge", "spacing")
