"""Literal patterns and constants shared by Spark code and the SQL oracles.

Patterns are written for both Java regex (Spark) and RE2 (DuckDB); each one
below behaves the same in both engines on the test tables.
"""

# --- Fixed values: these must equal the source pipeline's for equal results ---
ROWSEP = "| \n |"                 # separator between rendered table rows
PIPE_RE = r"\s*\|\s*"            # first-choice cell separator of pipe tables
PIPE_RE2 = r"\s+\|\s"            # fallback separator (ragged tables)
BUDGET_MARKER = "\n*syncopation*\n"  # appended when a text is cut to its budget
CODE_NEWLINE = "@@@"             # newline escape inside stored code
TABLE_BUDGET = 3500              # token budget of a table in a prompt
CODE_SIM_THRESHOLD = 0.9         # two-signal gate, strictly greater
ROW_SELECT_K = 5                 # rows kept by row selection
EXAMPLE_TABLE_ROWS = 6           # text rows (header included) of a shown example table
HEAD_ROWS_FOR_TABLE_SIM = 2      # header + first row, for table similarity
REPAIR_ATTEMPTS = 3              # failed executions before the last reply is kept
PROGRESS_EVERY = 50              # items between progress lines
FEW_SHOT = 1                     # examples per prompt
KEYWORD_NGRAM = 1                # words per keyword
SAMPLE_N = 100                   # questions sampled for asking
BANK_FIRST_N = 1000              # training rows tried when building the bank
ERROR_MARK = "Traceback"         # an execution result holding this is an error
ACTION_MARK = "Action Input:"    # reply marker before the code
OBSERVATION_MARK = "Observation:"  # reply marker after the code
OUTPUT_WORD = "Output"           # reply lines holding this are dropped
FENCE_OPEN = "```python"
FENCE_CLOSE = "```"
MASK = "'MASK'"                  # replacement for a closed quoted literal
# pandas' default missing-value tokens (read_csv na_values default)
NA_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
)
# --- end of fixed values ---

# Our own patterns (documented in SURVEY §2.0).
TRIM_RE = r"^[\s\p{Z}]+|[\s\p{Z}]+$"                       # Python-like strip
NUM_RE = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"   # numeric gate
SPECIAL_NUM_RE = r"^\s*[+-]?(?i:inf|infinity|nan)\s*$"         # words Python's float() reads
WORD_RE = r"[\p{L}\p{N}_]{2,}"                               # vectoriser words
NON_WORD_RE = r"[^\p{L}\p{N}_]+"                              # separators between words
WORD_RUN_RE = r"[\p{L}\p{N}_]+"                               # one budget word token
TOKEN_RE = r"\s*(?:[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s])"         # budget tokens
NON_ASCII_RE = r"[^\x00-\x7F]"
