"""Fixed values.

Everything in this module is data whose exact value decides results: phase
names, run-name vocabulary, dataset sizes, measured bandwidths, concurrency
tables and the axis lists of the comparison reports.
"""

# -- task phases found in event logs ---------------------------------------
DRIVER = "driver_program"
READ_FILE = "read_file"
WRITE_FILE = "write_file"
READ_IMG = "read_img"
INCREMENT = "increment_data"
SAVE = "save_incremented"
INC_CHUNK = "inc_chunk"
SAVE_RESULTS = "save_results"

# Two phases were once logged with a blank in the name; they are normalized.
IRREGULAR_PHASES = {"Read file": READ_FILE, "Write file": WRITE_FILE}

# File name that driver rows carry instead of a chunk.
ALL_FILES = "allfiles"

# -- run-name vocabulary ----------------------------------------------------
ENGINES = ["sp", "np"]
FILE_SYSTEMS = ["mem", "tmpfs", "local", "lustre"]
IMAGES = ["MRI", "HBB", "BB"]
BASELINE_FS = "mem"
SHARED_FS = "lustre"
MEMORY_BACKED_FS = "tmpfs"

# dataset name -> (tag in the run name, chunks at a time on one node)
DATASETS = {
    "bb_125dir": ("125BB", 9),
    "bb_30dir": ("30BB", 2),
    "bb_750dir": ("750BB", 25),
    "hbb_125dir": ("125HBB", 9),
    "mri_125dir": ("125MRI", 9),
}

# dataset name -> (chunk directory, legend file), relative to a data root
DATASET_PATHS = {
    "bb_125dir": ("125_splits", "125_splits_legend.txt"),
    "bb_30dir": ("30_splits", "30_splits_legend.txt"),
    "bb_750dir": ("750_splits", "750_splits_legend.txt"),
    "hbb_125dir": ("half_bb/125_splits", "half_bb/125_splits_legend.txt"),
    "mri_125dir": ("mri/125_splits", "mri/125_splits_legend.txt"),
}

# -- model dimensions -------------------------------------------------------
IMAGE_MIB = {"MRI": 13016 / 1024, "HBB": 39284504 / 1024, "BB": 78568516 / 1024}
FS_MIB_PER_S = {"lustre": 504.03, "local": 193.64, "tmpfs": 1377.18}
NODE_CONCURRENCY = {30: 2, 125: 9, 750: 25}
# 750 chunks: 375 = 15 nodes x 25 at a time; an older table has 350 instead.
CLUSTER_CONCURRENCY = {30: 30, 125: 125, 750: 375}
CLUSTER_CONCURRENCY_OLD = {30: 30, 125: 125, 750: 350}

# -- I/O study --------------------------------------------------------------
# Chunk sizes there are in MB of 2**20 bytes, and differ from IMAGE_MIB.
MRI_CHUNK_BYTES = 102752
HBB_CHUNK_BYTES = 321813010
BB_TOTAL_MB = 76727
MIB = 1024 * 1024
ZERO_DURATION_FLOOR_S = 0.004

# -- comparison reports -----------------------------------------------------
SERIES = [
    ("sp", "mem"),
    ("sp", "tmpfs"),
    ("sp", "local"),
    ("sp", "lustre"),
    ("np", "tmpfs"),
    ("np", "local"),
    ("np", "lustre"),
]
EXP1_DELAY = 3.44
EXP2_DELAYS = [0.59, 3.52, 14.67]
EXP3_DELAY = 1.76
EXP4_DELAYS = [2.4, 3.44, 7.68, 320.0]
EXP4_ITERATIONS = 10
AXES = {
    1: ["1", "10", "100"],
    2: ["30", "125", "750"],
    3: ["MRI", "HBB", "BB"],
    4: ["2.4", "3.44", "7.68", "320"],
}

# -- cluster split ----------------------------------------------------------
NODES = 15

# -- break-even example: one subject is 2 GB + 100 MB in 20 minutes, and the
# resulting write rate is quoted as 1.8 MB/s
SUBJECT_MB = 2 * 1024 + 100
SUBJECT_SECONDS = 20 * 60
QUOTED_RATE = 1.8

# Whitespace as a plain split() of Python sees it.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

#: Event times from here on are seconds since 1970, not since a run's start.
ABSOLUTE_FROM = 1e9
