"""Fixed values of the file formats and record layouts."""

from __future__ import annotations

from dataclasses import dataclass

# --- fixed values: console log tokens -------------------------------------------------
LOG_TOKEN_PREFIX = "YUKON_"
# Letters, numbers and underscore of any script, then digits of any script. Spelled with
# Unicode categories so that every regex engine agrees on it.
LOG_TOKEN_PATTERN = LOG_TOKEN_PREFIX + r"[\p{L}\p{N}_]+=\p{Nd}+"
INSTRUCTIONS = "instructions"

# --- fixed values: counter CSV (0-based physical line numbers) ------------------------
HEADER_LINE = 3
DATA_LINE = 7
WARMUP_SAMPLES = 6
DROPPED_COLUMNS = ("description",)
CYCLES = "Clock cycles elapsed in the local domain."
CLOCK_HZ = 1e9

# --- fixed values: counters with a misses-per-thousand-instructions ratio -------------
MPKI_COUNTERS = ("l1_htlb", "l2_htlb", "l1_tlb", "l2_tlb")

# --- fixed values: file names ---------------------------------------------------------
LOG_FILE = "uartlog"
COUNTER_FILE = "AUTOCOUNTERFILE0.csv"
DESCRIPTION_FILE = "description.txt"
UNKNOWN_DESCRIPTION = "Unk."

# --- fixed values: fields of a configuration record -----------------------------------
CONFIG_FIELDS = (
    "overlay_path string, config_dir string, sim_config string, sim_img string, sim_prog string,"
    " log_dir string, results_dir string, partitions array<string>, nodelist array<string>,"
    " verbosity int, dry_run boolean"
)

# --- fixed values: job records --------------------------------------------------------
NO_JOB_ID = -1
NIL_RUN_ID = "00000000-0000-0000-0000-000000000000"
UNBOUNDED_CYCLE = -1
RUN_NAME_PATTERN = r"\A[a-zA-Z0-9.\-_]+\z"
SUBMITTED_PATTERN = r"\ASubmitted batch job (\p{Nd}+)\n?\z"

# --- fixed values: column names of the per-run CSV that differ from ours --------------
CSV_COLUMN_NAMES = {"artifact_md5": "libyukon_md5", "bitstream_info": "bitstream info"}


@dataclass(frozen=True)
class Rule:
    """What one member of a configuration must satisfy."""

    member: str
    kind: str | None = None
    readable: bool = False
    writable: bool = False
    executable: bool = False
    suffix: str | None = None


# --- fixed values: required members ---------------------------------------------------
RUN_RULES = (
    Rule("config_dir", kind="dir", readable=True),
    Rule("bitstream_dir", kind="dir", readable=True),
    Rule("driver", kind="file", readable=True, executable=True),
    Rule("bitstream", kind="file", readable=True),
    Rule("overlay", kind="dir", readable=True),
    Rule("image", kind="file", readable=True, suffix=".img"),
    Rule("program", kind="file", readable=True, executable=True),
)
BATCH_RULES = RUN_RULES + (Rule("results_dir", kind="dir", readable=True, writable=True),)
BASE_RULES = (Rule("log_dir", kind="dir", readable=True, writable=True),)
